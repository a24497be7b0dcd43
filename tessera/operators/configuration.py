"""Smoothing of binary volumes by the configuration of each voxel's 3 x 3 x 3 neighbourhood.

A voxel that is on goes if it sticks out: it has one neighbour at most, or its neighbourhood matches a rule in any
of the 24 rotations. One that is off comes on if it is mostly surrounded, bridges a gap between two opposite faces, or
if the inverted neighbourhood matches a rule. Rules are (mask, value) pairs on 27-bit codes; the closed table of
rotated rules (74 pairs) is built once and matched against the distinct codes of a block.

All iterations run in one pass with a halo of one voxel for each.
"""

from __future__ import annotations

from functools import cache

import numpy as np
from pyspark.sql import DataFrame

from tessera.operators import neighbourhoods as N
from tessera.plans.blocks import BLOCK, Shape, map_blocks

# The published rules, in one rotation; cells are written xyz. Cells that are on besides the centre, and cells that are off.
RULES = [
    ("112", "000 100 200 010 110 210 020 120 220 001 101 201 011 211 021 121 221"),
    ("112 021 022", "000 100 200 010 110 210 020 120 220 001 101 201 011 211 121 221"),
    ("112 121 122", "000 100 200 010 110 210 020 120 220 001 101 201 011 211 021 221"),
    ("122", "000 100 200 010 110 210 020 120 220 001 101 201 011 211 002 102 202"),
    ("022", "000 100 200 010 110 210 020 120 220 001 101 201 211 221 002 102 202 212 222"),
]
#: With so many of the 27 cells on, a voxel comes on.
SURROUNDED = 20
ALL = (1 << 27) - 1


def _bits(cells: str) -> int:
    return sum(N.bit(*map(int, c)) for c in cells.split())


@cache
def table() -> tuple[tuple[int, int], ...]:
    """(mask, value) of every rotated rule; the centre is on in all of them."""
    pairs = [(_bits(on) | _bits(off) | N.CENTRE, _bits(on) | N.CENTRE) for on, off in RULES]
    return tuple(N.closure(pairs))


def smoothed(codes: np.ndarray) -> np.ndarray:
    """Whether the centre is on afterwards, for an array of codes."""
    kinds, back = np.unique(codes, return_inverse=True)
    on = (kinds & N.CENTRE) != 0
    count = np.bitwise_count(kinds)
    rules = list(table())
    stays = ~((count <= 2) | N.matches(kinds, rules))
    faces = kinds & N.shell(1)
    opposite = [N.bit(*a) | N.bit(*b) for a, b in (((1, 1, 0), (1, 1, 2)), ((1, 0, 1), (1, 2, 1)), ((0, 1, 1), (2, 1, 1)))]
    bridge = np.zeros(len(kinds), bool)
    for pair in opposite:
        bridge |= (kinds & pair) == pair
    comes = (count >= SURROUNDED) | (bridge & (np.bitwise_count(faces) >= 3)) | N.matches(ALL ^ kinds, rules)
    return np.where(on, stays, comes)[back].reshape(codes.shape)


def smooth_by_configuration(vox: DataFrame, iterations: int = 1, block: Shape = BLOCK) -> DataFrame:
    """vol_id, x, y, z, v (0 or 1) of every stored voxel; what is not stored is off and stays so."""

    def run(values, stored, _, owned):
        on = (values > 0) & stored
        for _ in range(iterations):
            on = smoothed(N.codes_of(on)) & stored
        return {"v": on.astype(np.int64)}

    return map_blocks(vox, run, {"v": "int"}, block, (max(1, iterations),) * 3)
