"""Reconnecting broken vessels: an end of a skeleton is traced to the nearest unconnected end, or else to the mask.

An end only looks at the patch of ``radius`` voxels around it. So a voxel is sent to the blocks that hold an end of their own near it, and nowhere
else: one join of the voxels with the list of such blocks and one shuffle, whatever the number of ends, and no volume is ever whole in a task. The ends travel
with the voxels as rows of their own. Blocks share arrays, and the patches of a batch are searched side by side.

Entering a voxel costs max(1 / (reward * score), least) times the step's length, and 1 where the score is not
positive; voxels that are not stored cannot be entered.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.plans.blocks import BLOCK, Shape, whole_blocks

AXES = ("x", "y", "z")
STEPS = [(np.array(d), sum(c * c for c in d) ** 0.5) for d in product((-1, 0, 1), repeat=3) if any(d)]
#: Kinds of a connection.
TO_END, TO_MASK = 1, 2
#: Cells of patches, with their borders, that are searched side by side.
CELLS = 1 << 19
#: Cells of blocks that share an array (one block at least), and rows that are looked at together.
SHARED, ROWS = 1 << 21, 1 << 16
#: Bits of a row's mark: in the mask, in the skeleton, and a row that stands for an end instead of a voxel.
MASK, SKELETON, END = 1, 2, 4


def voxel_cost(score: np.ndarray, stored: np.ndarray, least: float, reward: float) -> np.ndarray:
    with np.errstate(divide="ignore"):
        cost = np.maximum(np.where(score > 0, 1 / (reward * np.where(score > 0, score, 1)), 1.0), least)
    return np.where(stored, cost, np.inf)


def _flat(a: np.ndarray, fill) -> tuple[np.ndarray, np.ndarray, int]:
    """(patches, stacked on the first axis, each with a border of ``fill``, flattened; what to add to a flat place for a step along each axis; places of one patch)."""
    wide = np.pad(a, ((0, 0), (1, 1), (1, 1), (1, 1)), constant_values=fill)
    return wide.ravel(), np.array([wide.shape[2] * wide.shape[3], wide.shape[3], 1]), int(np.prod(wide.shape[1:]))


def cheapest_paths(cost: np.ndarray, start: np.ndarray, goal: np.ndarray) -> list[tuple[np.ndarray, float]]:
    """For each patch (first axis of ``cost`` and ``goal``): (voxels from its start to the cheapest true voxel of its goal, total cost); no voxels and infinity if none is reached.
    Of equally cheap goals the first in order counts.

    A wave over arrays: costs are cut into ranges as wide as a patch's cheapest step, and all voxels of its lowest open range are relaxed
    together, one pass for each of the 26 directions, until the range is settled. A patch ends with the range that holds its nearest goal.
    The waves of all patches run side by side, and none sees another.
    """
    n = len(cost)
    price, stride, cells = _flat(cost, np.inf)
    aim, _, _ = _flat(goal, False)
    steps = [(int(d @ stride), length) for d, length in STEPS]
    width = np.where(np.isfinite(cost), cost, np.inf).reshape(n, -1).min(axis=1)
    width = np.maximum(np.where(np.isfinite(width), width, 1.0), 1e-9)
    far, came, open_ = np.full(len(price), np.inf), np.full(len(price), -1), np.zeros(len(price), bool)
    first = (np.asarray(start) + 1) @ stride + np.arange(n) * cells
    far[first], open_[first] = 0.0, True
    best, top, live = np.where(aim[first], 0.0, np.inf), np.zeros(n), np.ones(n, bool)
    front = np.zeros(0, np.int64)
    while True:
        idle = live.copy()
        idle[front // cells] = False
        if idle.any():  # their next range
            waiting = np.flatnonzero(open_)
            waiting = waiting[idle[waiting // cells]]
            owner, lowest = waiting // cells, np.full(n, np.inf)
            np.minimum.at(lowest, owner, far[waiting])
            live &= ~idle | (lowest < best)
            idle &= live
            top[idle] = (np.floor(lowest[idle] / width[idle]) + 1) * width[idle]
            top[idle] = np.maximum(top[idle], np.nextafter(lowest[idle], np.inf))
            front = np.sort(np.concatenate([front, waiting[live[owner] & (far[waiting] < top[owner])]]))
        if not len(front):
            break
        open_[front] = False
        touched = []
        for step, length in steps:
            q = front + step
            new = far[front] + price[q] * length
            better = new < far[q]
            q = q[better]
            far[q], came[q], open_[q] = new[better], front[better], True
            touched.append(q)
        q = np.unique(np.concatenate(touched))
        hit = q[aim[q]]
        np.minimum.at(best, hit // cells, far[hit])
        front = q[far[q] < top[q // cells]]
    ends = np.where(aim, far, np.inf).reshape(n, cells)
    last = ends.argmin(axis=1)
    at, back = np.arange(n) * cells + last, []
    while (at >= 0).any():  # all patches step by step back to their starts
        back.append(at)
        at = np.where(at >= 0, came[at], -1)
    back = np.array(back)
    length = (back >= 0).sum(axis=0)
    places = np.stack(np.unravel_index(np.maximum(back, 0) % cells, tuple(k + 2 for k in cost.shape[1:])), axis=2) - 1
    totals = ends[np.arange(n), last].tolist()
    return [(np.zeros((0, 3), int), np.inf) if total == np.inf else (places[: length[i], i][::-1], total) for i, total in enumerate(totals)]


def cheapest_path(cost: np.ndarray, start: tuple[int, ...], goal: np.ndarray) -> tuple[np.ndarray, float]:
    """``cheapest_paths`` of one patch."""
    return cheapest_paths(cost[None], np.array([start]), goal[None])[0]


def components_at(mask: np.ndarray, at: np.ndarray) -> np.ndarray:
    """In each patch the 26-connected component of the mask that holds the patch's voxel ``at``; empty if the voxel is not in the mask. Only the rim of what is found grows."""
    left, stride, cells = _flat(mask, False)
    left = left.copy()
    got = np.zeros(len(left), bool)
    front = (np.asarray(at) + 1) @ stride + np.arange(len(mask)) * cells
    front = front[left[front]]
    while len(front):
        got[front], left[front] = True, False
        near = np.unique(np.concatenate([front + int(d @ stride) for d, _ in STEPS]))
        front = near[left[near]]
    return got.reshape(len(mask), *(k + 2 for k in mask.shape[1:]))[:, 1:-1, 1:-1, 1:-1]


def nearest(where: np.ndarray, at: np.ndarray) -> np.ndarray | None:
    """The true voxel nearest to a position, the first in order among equals."""
    found = np.argwhere(where)
    return found[((found - at) ** 2).sum(1).argmin()] if len(found) else None


def line_of(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Voxels of a straight line after a, up to b."""
    n = int(np.abs(b - a).max())
    return np.rint(a + (b - a) * (np.arange(1, n + 1) / n)[:, None]).astype(int) if n else np.zeros((0, 3), int)


def near_ends(vox: DataFrame, ends: DataFrame, radius: int, block: Shape) -> DataFrame:
    """vol_id, bx, by, bz, x, y, z, v, mark: voxels and ends (rows of their own) of what the ends of each block may see, sent to that block only."""
    kind = vox.schema["vol_id"].dataType.simpleString()
    place = ["vol_id", *[F.col(a).cast("int").alias(a) for a in AXES]]
    block_of = lambda p: [F.floor(F.col(a) / s).cast("int").alias(p + a) for a, s in zip(AXES, block)]
    flag = lambda c, bit: F.when(F.col(c).cast("int") > 0, bit).otherwise(0)
    given = " and ".join(f"{c} is not null" for c in ("vol_id", *AXES))
    tips = ends.select(F.col("vol_id").cast(kind).alias("vol_id"), *place[1:]).filter(given).distinct()
    rows = vox.select(*place, F.col("score").cast("double").alias("v"), (flag("mask", MASK) + flag("skeleton", SKELETON)).alias("mark")).filter(given).filter("v is not null")
    rows = rows.unionByName(tips.select("*", F.lit(0.0).alias("v"), F.lit(END).alias("mark"))).select("*", *block_of("o"))
    # blocks that hold ends, by the blocks whose voxels those ends may see
    bounds = [f(a).alias(n + a) for a in AXES for n, f in (("lo", F.min), ("hi", F.max))]
    near = tips.select("*", *block_of("b")).groupBy("vol_id", "bx", "by", "bz").agg(*bounds)
    for a, size in zip(AXES, block):
        near = near.withColumn(f"lo{a}", F.col(f"lo{a}") - radius).withColumn(f"hi{a}", F.col(f"hi{a}") + radius)
        near = near.withColumn(f"o{a}", F.explode(F.sequence(F.floor(F.col(f"lo{a}") / size).cast("int"), F.floor(F.col(f"hi{a}") / size).cast("int"))))
    sent = rows.join(near.hint("merge"), ["vol_id", "ox", "oy", "oz"]).filter(" and ".join(f"{a} between lo{a} and hi{a}" for a in AXES))
    return sent.select("vol_id", "bx", "by", "bz", *AXES, "v", "mark")


def connect_ends(vox: DataFrame, ends: DataFrame, radius: int = 20, min_quality: float | None = 15.0, to_ends: bool = True, to_skeleton: bool = True, least: float = 1 / 60, reward: float = 4.0, block: Shape = BLOCK) -> DataFrame:
    """vol_id, x, y, z, sx, sy, sz, step, kind, cost: the voxels of the connection of each end (sx, sy, sz).

    vox: vol_id, x, y, z, score, mask, skeleton; ends: vol_id, x, y, z. A path is accepted if its cost per voxel is below
    ``min_quality`` (None: always). First the nearest end of another mask component is tried (``to_ends``, kind 1),
    then the mask without the end's own component (kind 2); such a path goes on in a straight line to the nearest skeleton voxel of the
    component it met (``to_skeleton``), whose voxels are not counted in the cost. Ends without an accepted path give no rows. Repeated ends count once;
    nulls among mask and skeleton are false, voxels with a null score are left out.
    """
    limit = np.inf if min_quality is None else min_quality

    def connections(cost, mask, skeleton, end, c):
        """(path, total, kind) or None for each of the patches, ``c`` being their ends."""
        local = components_at(mask, c)
        got: list[tuple | None] = [None] * len(c)
        if to_ends:
            aim = end & ~local
            aim[np.arange(len(c)), *c.T] = False
            goal, some = np.zeros(mask.shape, bool), []
            for i in np.flatnonzero(aim.any(axis=(1, 2, 3))).tolist():
                goal[(i, *nearest(aim[i], c[i]))] = True
                some.append(i)
            if some:
                for i, (path, total) in zip(some, cheapest_paths(cost[some], c[some], goal[some])):
                    if len(path) and total / len(path) < limit:
                        got[i] = path, total, TO_END
        rest = [i for i, g in enumerate(got) if g is None]
        if not rest:
            return got
        found = [(i, path, total) for i, (path, total) in zip(rest, cheapest_paths(cost[rest], c[rest], (mask & ~local)[rest])) if len(path) and total / len(path) < limit]
        if to_skeleton and found:
            which = [i for i, _, _ in found]
            aim = skeleton[which] & components_at(mask[which], np.array([path[-1] for _, path, _ in found]))
            hits = [nearest(a, path[-1]) for a, (_, path, _) in zip(aim, found)]
            found = [(i, path if hit is None else np.concatenate([path, line_of(path[-1], hit)]), total) for (i, path, total), hit in zip(found, hits)]
        for i, path, total in found:
            got[i] = path, total, TO_MASK
        return got

    def patches(cut: np.ndarray, at: np.ndarray, number: np.ndarray, value: np.ndarray, mark: np.ndarray, low: np.ndarray, shape: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """(row of an end, its connections' voxels and their rows' ends, steps, kinds and costs) of blocks in one array, ``CELLS`` cells of patches at a time (one patch at least)."""
        cells = shape.prod(axis=1)
        stride = np.stack([shape[:, 1] * shape[:, 2], shape[:, 2], np.ones(len(shape), int)], axis=1)
        base = np.cumsum(cells) - cells
        k = np.repeat(np.arange(len(shape)), np.diff(cut))
        place = base[k] + ((at - low[k]) * stride[k]).sum(axis=1)
        voxel, tip = np.flatnonzero(mark < END), np.flatnonzero(mark >= END)
        cost, stored, mask, skeleton, end = np.full(cells.sum(), np.inf), *np.zeros((4, cells.sum()), bool)
        stored[place[voxel]] = True
        cost[place[voxel]] = voxel_cost(value[voxel], True, least, reward)
        mask[place[voxel]], skeleton[place[voxel]] = mark[voxel] & MASK > 0, mark[voxel] & SKELETON > 0
        tip = tip[stored[place[tip]]]
        end[place[tip]] = True
        tip = tip[(at[tip] // np.array(block) == number[tip]).all(axis=1)]
        k = k[tip]
        c = at[tip] - low[k]
        first = np.maximum(c - radius, 0)
        wide = np.minimum(c + radius + 1, shape[k]) - first
        sizes, start = wide.tolist(), 0
        while start < len(tip):
            stop, most = start, [0, 0, 0]
            while stop < len(tip):
                more = [max(a, b) for a, b in zip(most, sizes[stop])]
                if stop > start and (stop + 1 - start) * (more[0] + 2) * (more[1] + 2) * (more[2] + 2) > CELLS:
                    break
                stop, most = stop + 1, more
            part = slice(start, stop)
            inside, there = True, base[k[part], None, None, None]
            for i, steps in enumerate(np.ix_(*map(np.arange, most))):
                inside = inside & (steps < wide[part, i, None, None, None])
                there = there + (first[part, i, None, None, None] + steps) * stride[k[part], i, None, None, None]
            there[~inside] = 0
            layers = [np.where(inside, cost[there], np.inf), *(layer[there] & inside for layer in (mask, skeleton, end))]
            found = [(i, *got) for i, got in enumerate(connections(*layers, (c - first)[part])) if got is not None]
            if found:
                which, paths, totals, kinds = zip(*found)
                n = [len(p) for p in paths]
                row = np.repeat(np.array(which) + start, n)
                step = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                yield tip[row], np.concatenate(paths) + (first + low[k])[row], at[tip[row]], step, np.repeat(kinds, n), np.repeat(totals, n)
            start = stop

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, cuts in whole_blocks(batches, ROWS):
            vol = rows["vol_id"].combine_chunks()
            at, number = (np.stack([rows[p + a].to_numpy() for a in AXES], axis=1).astype(np.int64) for p in ("", "b"))
            value, mark = rows["v"].to_numpy(), rows["mark"].to_numpy()
            low = np.minimum.reduceat(at, cuts[:-1])
            shape = np.maximum.reduceat(at, cuts[:-1]) - low + 1
            total = np.cumsum(shape.prod(axis=1))
            i = 0
            while i < len(total):
                j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + SHARED, side="right")))
                s = slice(int(cuts[i]), int(cuts[j]))
                for row, path, start, step, kind, cost in patches(cuts[i : j + 1], at[s], number[s], value[s], mark[s], low[i:j], shape[i:j]):
                    ints = [*path.T, *start.T, step, kind]
                    yield pa.RecordBatch.from_arrays([vol.take(pa.array(row + s.start)), *[pa.array(c.astype(np.int32)) for c in ints], pa.array(cost)], names)
                i = j

    names = ["vol_id", *AXES, "sx", "sy", "sz", "step", "kind", "cost"]
    kind = vox.schema["vol_id"].dataType.simpleString()
    keys = ["vol_id", "bx", "by", "bz"]
    sent = near_ends(vox, ends, radius, block).repartition(*keys).sortWithinPartitions(*keys)
    return sent.mapInArrow(run, f"vol_id {kind}, " + ", ".join(f"{c} int" for c in names[1:-1]) + ", cost double")


def trace_to_mask(vox: DataFrame, starts: DataFrame, radius: int = 20, least: float = 1 / 60, reward: float = 4.0, block: Shape = BLOCK) -> DataFrame:
    """The cheapest path of each start to the mask (without the start's own component) within the radius; columns as in ``connect_ends``. vox: vol_id, x, y, z, score, mask."""
    return connect_ends(vox.withColumn("skeleton", F.lit(False)), starts, radius, None, False, False, least, reward, block)


def add_connections(voxels: DataFrame, paths: DataFrame, within: DataFrame, dilate: int = 1) -> DataFrame:
    """vol_id, x, y, z: the listed voxels and all within ``dilate`` of a path's voxels, where ``within`` (vol_id, x, y, z) stores them."""
    at = ["vol_id", *AXES]
    wide = paths.select(*at).distinct()
    for a in AXES:
        wide = wide.withColumn(a, F.explode(F.sequence(F.col(a) - dilate, F.col(a) + dilate)))
    return voxels.select(*at).unionByName(wide.distinct().join(within.select(*at), at, "left_semi")).distinct()
