"""3 x 3 x 3 neighbourhoods as numbers: bit x + 3 y + 9 z of a code is the cell (x, y, z), the centre is bit 13.

Rotations are permutations of the 27 bits. A rule is a mask and a value (cells that must be on or off); a set of rules closed
under rotations is a table of such pairs, and is matched against whole arrays of codes at a time.
"""

from __future__ import annotations

from itertools import product

import numpy as np

CENTRE = 1 << 13
CELLS = [(x, y, z) for z, y, x in product(range(3), repeat=3)]  # by bit
_AXES = ((1, 2), (2, 0), (0, 1))


def bit(x: int, y: int, z: int) -> int:
    return 1 << (x + 3 * y + 9 * z)


def xyz_of_bit(number: int) -> tuple[int, int, int]:
    return number % 3, number // 3 % 3, number // 9


def to_cube(code: int) -> np.ndarray:
    """The code as a 3 x 3 x 3 array of booleans."""
    cube = np.zeros((3, 3, 3), bool)
    for i, at in enumerate(CELLS):
        cube[at] = code >> i & 1
    return cube


def to_code(cube: np.ndarray) -> int:
    return sum(1 << i for i, at in enumerate(CELLS) if cube[at])


def without_centre(code: np.ndarray) -> np.ndarray:
    """Codes of 26 bits: the bits above the centre move down by one."""
    return code & (CENTRE - 1) | code >> 1 & ~np.int64(CENTRE - 1)


def rotate(cube: np.ndarray, axis: int = 2, steps: int = 1) -> np.ndarray:
    """Quarter turns about an axis."""
    return np.rot90(cube, -steps, _AXES[axis])


def reflect(cube: np.ndarray) -> np.ndarray:
    """Reflection at the centre."""
    return cube[::-1, ::-1, ::-1]


def rotations() -> list[np.ndarray]:
    """The 24 rotations as permutations: entry i is the bit that moves to bit i."""
    bits = np.zeros((3, 3, 3), np.int64)
    for i, at in enumerate(CELLS):
        bits[at] = i
    found: dict[bytes, np.ndarray] = {}
    for a, b, c in product(range(4), repeat=3):
        turned = rotate(rotate(rotate(bits, 0, a), 1, b), 2, c)
        order = np.array([turned[at] for at in CELLS])
        found.setdefault(order.tobytes(), order)
    return list(found.values())


def permuted(code: int, order: np.ndarray) -> int:
    return sum(1 << i for i, j in enumerate(order.tolist()) if code >> j & 1)


def closure(rules: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """All distinct (mask, value) pairs that rotations make of these."""
    turns = rotations()
    return sorted({(permuted(m, t), permuted(v, t)) for m, v in rules for t in turns})


def matches(codes: np.ndarray, rules: list[tuple[int, int]]) -> np.ndarray:
    """Whether any rule holds for each code."""
    hit = np.zeros(codes.shape, bool)
    for mask, value in rules:
        hit |= (codes & mask) == value
    return hit


def codes_of(on: np.ndarray) -> np.ndarray:
    """The code of every place of a 3-d array of booleans; outside is off. One pass for each axis."""
    now = on.astype(np.int64)
    for axis in range(3):
        step = 3**axis
        wide = np.pad(now, [(1, 1) if a == axis else (0, 0) for a in range(3)])
        part = lambda k: wide[tuple(slice(k, k + now.shape[axis]) if a == axis else slice(None) for a in range(3))]  # noqa: E731, B023
        now = part(0) + (part(1) << step) + (part(2) << 2 * step)
    return now


def shell(steps: int) -> int:
    """Mask of the neighbours that differ from the centre on at most so many axes: 1 gives 6, 2 gives 18, 3 gives 26."""
    return sum(bit(*c) for c in CELLS if 1 <= sum(k != 1 for k in c) <= steps)


def directions() -> list[tuple[int, int, int]]:
    """One of each pair of opposite neighbours: 13 offsets."""
    return [d for d in product((-1, 0, 1), repeat=3) if d > (0, 0, 0)]
