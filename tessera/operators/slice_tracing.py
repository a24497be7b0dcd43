"""Shifts of slices along a stack: errors of all shifts, slices that show something, and the best path through them.

Slices of an overlap travel as rows and are compared as arrays, small ones of many pairs side by side. A pair's table of errors (slices times
shifts) is traced by dynamic programming: the least sum of errors and of steps between neighbouring slices.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.plans.runs import whole_groups

AXES = ("x", "y", "z")
#: Cells of a side of slices that are compared in one array, shifts included; a larger slice has an array of its own.
CELLS = 1 << 18


def normalize(bands: DataFrame, clip: tuple[float | None, float | None] | None = None, axis: str = "z") -> DataFrame:
    """``bands`` (pre, post, side, x, y, z, v) with v clipped, and of every slice of a side the mean taken away and the length made 1 (a flat slice becomes 0)."""
    v = F.col("v").cast("double")
    low, high = clip or (None, None)
    v = F.greatest(v, F.lit(float(low))) if low is not None else v
    v = F.least(v, F.lit(float(high))) if high is not None else v
    w = Window.partitionBy("pre", "post", "side", axis)
    centred = bands.withColumn("v", v).withColumn("v", F.col("v") - F.avg("v").over(w))
    size = F.sqrt(F.sum(F.col("v") * F.col("v")).over(w))
    return centred.withColumn("v", F.when(size > 0, F.col("v") / size).otherwise(0.0))


def foreground(bands: DataFrame, valid_range: tuple[float | None, float | None], size: int | None = None, fraction: float | None = None, axis: str = "z") -> DataFrame:
    """pre, post, s, valid: whether both sides of a slice hold enough voxels in the range: at least ``size``, or ``fraction`` of the slice, or one.

    Of a range with both ends the inside counts, without them; with one end it counts as well.
    """
    low, high = valid_range
    v = F.col("v")
    if low is None and high is None:
        on = F.lit(True)
    elif low is not None and high is not None:
        on = (v > low) & (v < high)
    else:
        on = v >= low if low is not None else v <= high
    counted = bands.groupBy("pre", "post", F.col(axis).alias("s"), "side").agg(F.count(F.when(on, 1)).alias("k"), F.count("*").alias("n"))
    need = F.lit(fraction) * F.col("n") if fraction is not None else F.lit(size if size is not None else 1)
    return counted.groupBy("pre", "post", "s").agg((F.min((F.col("k") >= need).cast("int")) == 1).alias("valid"))


def slice_errors(bands: DataFrame, axis: str = "z", max_shift: int = 3) -> DataFrame:
    """pre, post, s, dx, dy, dz, error, n: the mean squared difference of a slice of the first side and the shifted slice of the second one over
    the n voxels that both hold. Each voxel is sent once; small slices are compared in packs of at most ``CELLS`` cells, a larger one by itself."""
    rest = [a for a in AXES if a != axis]
    m = max_shift
    shifts = [(i, j) for i in range(-m, m + 1) for j in range(-m, m + 1)]
    keys = ["pre", "post", axis]

    def compare(columns: dict[str, np.ndarray], cuts: np.ndarray, shape: np.ndarray, low: np.ndarray) -> pa.RecordBatch:
        """All shifts of the slices in rows cuts[0]..cuts[-1], in one array."""
        first, rows, n = cuts[:-1], slice(int(cuts[0]), int(cuts[-1])), len(cuts) - 1
        k = np.repeat(np.arange(n), np.diff(cuts))
        at = [columns[a][rows] - low[k, i] for i, a in enumerate(rest)]
        size = shape.max(axis=0)
        values, stored = np.zeros((2, n, *(size + 2 * m))), np.zeros((2, n, *(size + 2 * m)), bool)
        place = (columns["side"][rows], k, at[0] + m, at[1] + m)
        values[place], stored[place] = columns["v"][rows], True
        inner = (slice(None), slice(m, m + int(size[0])), slice(m, m + int(size[1])))
        a, has_a = values[0][inner], stored[0][inner]
        found = []
        for i, j in shifts:
            moved = (slice(None), *(slice(s.start - d, s.stop - d) for s, d in zip(inner[1:], (i, j))))
            both = has_a & stored[1][moved]
            count = both.sum(axis=(1, 2))
            d = np.where(both, a - values[1][moved], 0.0)
            some = np.flatnonzero(count)
            found.append((some, np.full(len(some), i), np.full(len(some), j), (d * d).sum(axis=(1, 2))[some] / count[some], count[some]))
        which, i, j, error, count = (np.concatenate(x) for x in zip(*found))
        step = {rest[0]: i, rest[1]: j, axis: np.zeros(len(i), np.int64)}
        names = [columns[c][first][which] for c in keys]
        return pa.RecordBatch.from_arrays([pa.array(names[0]), pa.array(names[1]), pa.array(names[2]), *[pa.array(step[a].astype(np.int32)) for a in AXES], pa.array(error), pa.array(count)], ["pre", "post", "s", "dx", "dy", "dz", "error", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns, cuts in whole_groups(batches, keys):
            low, high = (np.stack([f.reduceat(columns[a], cuts[:-1]) for a in rest], axis=1) for f in (np.minimum, np.maximum))
            shape = (high - low + 1).astype(np.int64)
            at = 0
            while at < len(shape):
                stop, size = at, np.zeros(2, np.int64)
                while stop < len(shape) and (stop == at or (stop + 1 - at) * int((np.maximum(size, shape[stop]) + 2 * m).prod()) <= CELLS):
                    size = np.maximum(size, shape[stop])
                    stop += 1
                yield compare(columns, cuts[at : stop + 1], shape[at:stop], low[at:stop])
                at = stop

    rows = bands.select("pre", "post", F.col("side").cast("int").alias("side"), *[F.col(a).cast("int").alias(a) for a in AXES], F.col("v").cast("double").alias("v"))
    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "pre bigint, post bigint, s int, dx int, dy int, dz int, error double, n bigint")


def best_path(errors: np.ndarray, shifts: np.ndarray, gaps: np.ndarray, penalty: float) -> np.ndarray:
    """The column of each row so that the sum of errors[row, column] and of ``penalty`` times the step between the shifts of neighbouring rows (divided by their
    gap) is least; ties go to the first column. Missing errors are infinite."""
    n, k = errors.shape
    step = np.sqrt(((shifts[:, None, :] - shifts[None, :, :]) ** 2).sum(-1)) * penalty
    cost = errors[0].copy()
    came = np.zeros((n, k), np.int64)
    for i in range(1, n):
        total = cost[:, None] + step / gaps[i]
        came[i] = total.argmin(0)
        cost = total[came[i], np.arange(k)] + errors[i]
    out = np.zeros(n, np.int64)
    out[-1] = cost.argmin()
    for i in range(n - 1, 0, -1):
        out[i - 1] = came[i, out[i]]
    return out


def trace_slices(errors: DataFrame, penalty: float, valid: DataFrame | None = None, least: int = 1, longest_gap: int | None = None) -> DataFrame:
    """pre, post, s, dx, dy, dz, quality: the shifts along the best path of each pair. ``valid`` (pre, post, s, valid): slices that are not valid take no
    part; ``longest_gap``: a longer run of missing slices begins a new path. The quality is minus the error at the shift."""
    rows = errors.filter(F.col("n") >= least)
    if valid is not None:
        rows = rows.join(valid.filter("valid").select("pre", "post", "s"), ["pre", "post", "s"], "left_semi")

    def trace(df: pd.DataFrame) -> pd.DataFrame:
        shifts, which = np.unique(df[["dx", "dy", "dz"]].to_numpy(), axis=0, return_inverse=True)
        order = np.lexsort((*shifts.T[::-1], (shifts**2).sum(1)))  # smaller shifts first, so ties go to them
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        shifts, which = shifts[order], place[which.ravel()]
        slices, at = np.unique(df["s"].to_numpy(), return_inverse=True)
        table = np.full((len(slices), len(shifts)), np.inf)
        table[at, which] = df["error"].to_numpy()
        gap = np.concatenate([[1], np.diff(slices)])
        starts = [0, *(np.flatnonzero(gap > longest_gap).tolist() if longest_gap else []), len(slices)]
        path = np.concatenate([best_path(table[a:b], shifts, gap[a:b], penalty) for a, b in zip(starts, starts[1:]) if b > a])
        found = shifts[path]
        return pd.DataFrame({"pre": df["pre"].iloc[0], "post": df["post"].iloc[0], "s": slices.astype("int32"), **{f"d{a}": found[:, i].astype("int32") for i, a in enumerate(AXES)}, "quality": -table[np.arange(len(slices)), path]})

    return rows.groupBy("pre", "post").applyInPandas(trace, "pre bigint, post bigint, s int, dx int, dy int, dz int, quality double")
