"""Parallel thinning in twelve directions (Palagyi and Kuba 1999), block by block.

An iteration finds the border voxels (a face neighbour is off), then goes through twelve diagonal directions;
in each, all border voxels that match one of the fourteen deletion masks turned that way go at once. What
becomes of a voxel in one iteration depends on voxels at most thirteen away (one for the border, one for each direction), so a block
with a halo of thirteen does a whole iteration by itself, and blocks meet once an iteration. A block with nothing in its halo goes on to
its end at once. A block whose halo lost nothing in the last iteration can't change in the next: only blocks near a change are sent again, and to no others any voxel. Each round is a written table.

Only voxels that are on travel. Memory is one block with its halo. Outside of the volume is off; nothing wraps.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import neighbourhoods as N
from tessera.plans.blocks import Shape, map_blocks
from tessera.plans.scratch import Scratch

AXES = ("x", "y", "z")
BLOCK: Shape = (128, 128, 128)
HALO = 13
#: Blocks, or pairs of them, that are joined by broadcast.
FEW = 200_000
#: Cells of a block that shares an array with others, and of such an array: an iteration takes some 400 calls on arrays, whatever their size.
CELLS = 1 << 13, 1 << 17

# The deletion masks of the published algorithm, for the first direction. Cells are written xyz. Of each mask: cells that
# are on, cells that are off, cells of which one is on at least, pairs that are not both on, pairs of which exactly one is on.
MASKS = [
    ("110", "002 102 202 012 112 212 022 122 222", "000 100 200 010 210 020 120 220 001 101 201 011 211 021 121 221", "", ""),
    ("121", "000 100 200 001 101 201 002 102 202", "010 110 210 020 120 220 011 211 021 221 012 112 212 022 122 222", "", ""),
    ("120", "000 100 200 001 101 201 002 102 202 012 112 212 022 122 222", "010 210 020 220 011 211 021 221", "", ""),
    ("110 121", "101 002 102 202 112", "", "001-012 201-212", ""),
    ("110 121 202", "101 002 102 112", "", "001-012", "201-212"),
    ("110 121 002", "101 102 202 112", "", "201-212", "001-012"),
    ("110 211 121", "101 002 102 112", "", "001-012", ""),
    ("110 011 121", "101 102 202 112", "", "201-212", ""),
    ("110 211 002 121", "101 102 112", "", "", "001-012"),
    ("110 011 202 121", "101 102 112", "", "", "201-212"),
    ("210 120", "000 100 001 101 002 102 202 012 112 212 022 122 222", "", "", ""),
    ("010 120", "100 200 101 201 002 102 202 012 112 212 022 122 222", "", "", ""),
    ("120 221", "000 100 200 001 101 201 002 102 202 012 112 022 122", "", "", ""),
    ("120 021", "000 100 200 001 101 201 002 102 202 112 212 122 222", "", "", ""),
]
# The order of the directions, each as quarter turns (axis, steps) of the first one.
DIRECTIONS = [
    (), ((2, 2), (1, 3)), ((1, 2), (2, 1)), ((1, 3),), ((2, 1),), ((1, 2), (2, 2)),
    ((1, 1),), ((2, 2),), ((1, 2), (2, 3)), ((2, 2), (1, 1)), ((2, 3),), ((1, 2),),
]


def _bits(cells: str) -> int:
    return sum(N.bit(*map(int, c)) for c in cells.split())


def _pairs(cells: str) -> list[tuple[int, int]]:
    return [tuple(_bits(c) for c in p.split("-")) for p in cells.split()]


_PARSED = [(_bits(on), _bits(off), _bits(some), _pairs(not_both), _pairs(one)) for on, off, some, not_both, one in MASKS]


def deletable(codes: np.ndarray) -> np.ndarray:
    """Whether a voxel with this neighbourhood goes in the first direction."""
    out = np.zeros(codes.shape, bool)
    for on, off, some, not_both, one in _PARSED:
        hit = (codes & (on | off)) == on
        if some:
            hit &= (codes & some) != 0
        for a, b in not_both:
            hit &= (codes & (a | b)) != (a | b)
        for a, b in one:
            hit &= ((codes & a) != 0) ^ ((codes & b) != 0)
        out |= hit
    return out


def lookup_table() -> np.ndarray:
    """All 2^26 neighbourhoods (the centre left out) as packed bits, 8 MB: bit i of byte j is neighbourhood 8 j + i."""
    out = np.zeros(1 << 23, np.uint8)
    for lo in range(0, 1 << 26, 1 << 20):
        c = np.arange(lo, lo + (1 << 20), dtype=np.int64)
        codes = c & (N.CENTRE - 1) | (c & ~np.int64(N.CENTRE - 1)) << 1 | N.CENTRE
        out[lo // 8 : (lo + (1 << 20)) // 8] = np.packbits(deletable(codes), bitorder="little")
    return out


def _turned() -> list[np.ndarray]:
    """For each direction and bit, the offset of the cell that stands for it."""
    places = np.zeros((3, 3, 3), np.int64)
    for i, at in enumerate(N.CELLS):
        places[at] = i
    out = []
    for turns in DIRECTIONS:
        cube = places
        for axis, steps in turns:
            cube = N.rotate(cube, axis, steps)
        offsets = np.zeros((27, 3), np.int64)
        for at in N.CELLS:
            offsets[cube[at]] = np.array(at) - 1
        out.append(offsets)
    return out


_OFFSETS = _turned()
_FACES = np.array([(1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)])


_PLACE = {c: _bits(c).bit_length() - 1 for c in ("102", "101", "112", "002", "202")}


def may_go(flat: np.ndarray, border: np.ndarray, steps: list[int]) -> np.ndarray:
    """The voxels that a few cells do not rule out. In every mask 102 is off; 101 and 112 are too, but for one of them in the first two masks, where 002 and 202 are off."""
    at = border[~flat[border + steps[_PLACE["102"]]]]
    a, b = flat[at + steps[_PLACE["101"]]], flat[at + steps[_PLACE["112"]]]
    one = at[a ^ b]
    return np.concatenate([at[~(a | b)], one[~(flat[one + steps[_PLACE["002"]]] | flat[one + steps[_PLACE["202"]]])]])


def iterate(on: np.ndarray) -> np.ndarray:
    """One iteration on an array (changed in place): the number of the direction (from 0) in which a voxel went, -1 elsewhere."""
    wide = np.pad(on, 1)
    gone = np.full(wide.shape, -1, np.int8)
    strides = np.array([wide.shape[1] * wide.shape[2], wide.shape[2], 1])
    flat, at = wide.ravel(), np.flatnonzero(wide)
    inner = np.ones(len(at), bool)
    for step in (_FACES @ strides).tolist():
        inner &= flat[at + step]
    border = at[~inner]
    for i, offsets in enumerate(_OFFSETS):
        steps = (offsets @ strides).tolist()
        some = may_go(flat, border, steps)
        codes = np.zeros(len(some), np.int32)
        for k, step in enumerate(steps):
            codes |= flat[some + step].astype(np.int32) << k
        hit = some[deletable(codes)]
        flat[hit] = False
        gone.ravel()[hit] = i
        border = border[flat[border]]
    cut = (slice(1, -1),) * 3
    on[...] = wide[cut]
    return gone[cut]


def thin(vox: DataFrame, iterations: int | None = None, block: Shape = BLOCK, scratch: Scratch | None = None) -> tuple[DataFrame, DataFrame]:
    """(vol_id, x, y, z of voxels that stay; vol_id, x, y, z, step of those that went: 12 times the iteration, from 1, plus the direction, from 0).

    ``iterations``: at most so many; without it until nothing goes.
    """
    scratch = scratch or Scratch(vox.sparkSession, "thin")
    at = ["vol_id", *AXES]
    own = [F.floor(F.col(a) / s).cast("int").alias(f"o{a}") for a, s in zip(AXES, block)]
    blocks, owners = ["vol_id", "bx", "by", "bz"], ["vol_id", "ox", "oy", "oz"]

    def kernel(left: int | None):
        """``left``: iterations that may still be done."""

        def run(values, stored, _, owned):
            on = stored.copy()
            step = iterate(on).astype(np.int64)
            alone = int(stored[owned].sum()) == int(stored.sum())
            k, went = 1, bool((step >= 0).any())
            while alone and went and (left is None or k < left):
                gone = iterate(on)
                went = bool((gone >= 0).any())
                step[gone >= 0] = gone[gone >= 0] + 12 * k
                k += 1
            return {"v": step, "open": np.full(stored.shape, not alone)}

        return run

    now = scratch.save(vox.filter("v > 0").select("vol_id", *[F.col(a).cast("int").alias(a) for a in AXES], *own).filter("x is not null and y is not null and z is not null").distinct(), "voxels-0")
    # what never grows is made once: blocks, and which of them see voxels of which
    known = scratch.save(now.groupBy(*owners).agg(*[f(a).alias(n + a) for a in AXES for n, f in (("lo", F.min), ("hi", F.max))]), "blocks")
    there = known.select("vol_id", *[F.col(f"o{a}").alias(f"b{a}") for a in AXES])
    pairs = scratch.save(explode_seers(known, block).join(there.hint("merge"), blocks, "left_semi").select(*owners, *blocks[1:]), "pairs")
    active, near, removed, i = None, pairs, [], 0
    while iterations is None or i < iterations:
        i += 1
        if active is not None:
            near = pairs.join(F.broadcast(active) if active.count() <= FEW else active.hint("merge"), blocks, "left_semi")
            near = scratch.save(near, f"near-{i}")
        few = near.count() <= FEW
        sent = sent_to(now, near, block, few).withColumn("v", F.lit(1))
        # across a plane that is off nothing has an effect
        got = map_blocks(sent, kernel(None if iterations is None else iterations - i + 1), {"v": "bigint", "open": "boolean"}, block, (HALO,) * 3, pack=1, sent=True, cells=CELLS)
        got = scratch.save(got.select(*at, *own, F.when(F.col("v") >= 0, F.col("v") + 12 * i).cast("int").alias("step"), "open"), f"done-{i}")
        lost = got.filter("step is not null")
        removed.append(lost.select(*at, "step"))
        left = got.filter("step is null").select(*at, *owners[1:])
        if active is not None:  # voxels of other blocks stay as they are
            done = active.select("vol_id", *[F.col(f"b{a}").alias(f"o{a}") for a in AXES])
            left = left.unionByName(now.join(F.broadcast(done) if few else done.hint("merge"), owners, "left_anti"))
        now = scratch.save(left, f"voxels-{i}")
        active = scratch.save(seers(lost.filter("open"), block).join(there.hint("merge"), blocks, "left_semi"), f"active-{i}")
        scratch.drop(f"voxels-{i - 1}")
        if not active.take(1):
            break
    gone = None
    for lost in removed:
        gone = lost if gone is None else gone.unionByName(lost)
    gone = gone if gone is not None else now.select(*at, F.lit(0).alias("step")).limit(0)
    return now.select(*at), gone


def explode_seers(boxes: DataFrame, block: Shape) -> DataFrame:
    """The rows, each with the places bx, by, bz of the blocks that hold or see something between lox, loy, loz and hix, hiy, hiz."""
    for a, size in zip(AXES, block):
        boxes = boxes.withColumn(f"b{a}", F.explode(F.sequence(F.floor((F.col(f"lo{a}") - HALO) / size).cast("int"), F.floor((F.col(f"hi{a}") + HALO) / size).cast("int"))))
    return boxes


def seers(vox: DataFrame, block: Shape) -> DataFrame:
    """vol_id, bx, by, bz of the places of blocks that hold or see a voxel. Voxels that are seen by the same blocks are one row before these are listed."""
    first = [(F.floor((F.col(a) - HALO) / s) * s + HALO).alias(f"lo{a}") for a, s in zip(AXES, block)]
    last = [(F.floor((F.col(a) + HALO) / s) * s - HALO).alias(f"hi{a}") for a, s in zip(AXES, block)]
    return explode_seers(vox.select("vol_id", *first, *last).distinct(), block).select("vol_id", "bx", "by", "bz").distinct()


def sent_to(vox: DataFrame, near: DataFrame, block: Shape, few: bool) -> DataFrame:
    """vol_id, bx, by, bz, x, y, z: the voxels (with their own block ox, oy, oz) that the blocks bx, by, bz in ``near`` (for each own block those that may see its voxels) hold or see."""
    near = near.groupBy("vol_id", "ox", "oy", "oz").agg(F.collect_list(F.struct("bx", "by", "bz")).alias("_near"))  # at most the blocks that a halo reaches
    sees = " and ".join(f"b.b{a} between floor(({a} - {HALO}) / {size}) and floor(({a} + {HALO}) / {size})" for a, size in zip(AXES, block))
    sent = vox.join(F.broadcast(near) if few else near.hint("merge"), ["vol_id", "ox", "oy", "oz"]).withColumn("_b", F.explode(F.expr(f"filter(_near, b -> {sees})")))
    return sent.select("vol_id", *[F.col(f"_b.b{a}").alias(f"b{a}") for a in AXES], *AXES)


def skeletonize(vox: DataFrame, iterations: int | None = None, block: Shape = BLOCK) -> DataFrame:
    """vol_id, x, y, z of the voxels of the skeleton of v > 0."""
    return thin(vox, iterations, block)[0]


def skeleton_radii(skeleton: DataFrame, gone: DataFrame) -> DataFrame:
    """vol_id, x, y, z, v: for each skeleton voxel the sum of the steps at which its 18 nearest neighbours went, which grows with the radius."""
    offsets = [tuple(k - 1 for k in c) for c in N.CELLS if N.bit(*c) & N.shell(2)]
    steps = F.array(*[F.struct(*[F.lit(d).alias(f"d{a}") for a, d in zip(AXES, o)]) for o in offsets])
    near = gone.withColumn("o", F.explode(steps)).select("vol_id", *[(F.col(a) + F.col(f"o.d{a}")).alias(a) for a in AXES], "step")
    at = ["vol_id", *AXES]
    return skeleton.join(near.groupBy(*at).agg(F.sum("step").alias("v")).hint("merge"), at, "left").select(*at, F.coalesce("v", F.lit(0)).alias("v"))
