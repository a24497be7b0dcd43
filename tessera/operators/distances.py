"""Euclidean distances of voxels to the nearest source voxel, with a spacing for each axis.

The squared distance separates: along one axis after the other every line takes the lower envelope of parabolas that stand on its
voxels (Felzenszwalb and Huttenlocher). Building and reading an envelope is linear in the line. Many lines are done side by side; a
task holds one batch of lines, and one line at least. Longer lines are cut into parts: what is lowest somewhere outside of its own part (few parabolas of a part are)
is compared along the line, and each part gets the parabolas that are lowest somewhere in it. Volumes are boxes whose voxels are all stored: a distance is handed on from voxel to voxel,
so a place that is not stored hands on none.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.plans.lines import map_lines
from tessera.plans.scratch import Scratch

AXES = ("x", "y", "z")
#: Cells (lines times the longest line) that are worked on at a time.
CELLS = 1 << 20
#: Places of a part of a line; lines up to this length are not cut.
PART = 1 << 12


def lowest(at: np.ndarray, height: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places of the parabolas of every line's envelope; from where on each is the lowest, and infinity behind the last; the number of the last, -1 without any)."""
    lines, n = at.shape
    stack = np.zeros((lines, n), np.int64)  # parabolas of the envelope, and from where on each is the lowest
    begin = np.full((lines, n + 1), np.inf)
    top = np.full(lines, -1)
    usable = valid & np.isfinite(height)
    for k in range(n):
        live = np.flatnonzero(usable[:, k])
        cut = np.full(lines, -np.inf)
        todo = live
        while len(todo):  # parabolas that the new one covers go
            todo = todo[top[todo] >= 0]
            j = stack[todo, top[todo]]
            p, q = at[todo, j], at[todo, k]
            meet = ((height[todo, k] + q * q) - (height[todo, j] + p * p)) / (2 * (q - p))
            covered = meet <= begin[todo, top[todo]]
            cut[todo[~covered]] = meet[~covered]
            todo = todo[covered]
            top[todo] -= 1
            cut[todo] = -np.inf
        top[live] += 1
        stack[live, top[live]] = k
        begin[live, top[live]] = cut[live]
        begin[live, top[live] + 1] = np.inf
    return stack, begin, top


def _level(height: np.ndarray, usable: np.ndarray) -> bool:
    """Whether all parabolas stand equally high, as they do along the first axis."""
    some = height[usable]
    return not len(some) or bool((some == some[0]).all())


def envelope(at: np.ndarray, height: np.ndarray, valid: np.ndarray) -> np.ndarray:
    """min over j of height[i, j] + (at[i, j] - at[i, k])^2 for every line i and place k. ``at`` ascends in each line; infinite heights hold no parabola."""
    usable = valid & np.isfinite(height)
    if _level(height, usable):  # the nearest one, before or behind
        before = np.maximum.accumulate(np.where(usable, at, -np.inf), axis=1)
        behind = np.minimum.accumulate(np.where(usable, at, np.inf)[:, ::-1], axis=1)[:, ::-1]
        d = np.minimum(at - before, behind - at)
        return np.where(valid, height[usable][:1].sum() + d * d, np.inf)
    lines, n = at.shape
    stack, begin, top = lowest(at, height, valid)
    row = np.arange(lines)
    out = np.full((lines, n), np.inf)
    some = top >= 0
    now = np.zeros(lines, np.int64)
    for k in range(n):
        ask = row[some & valid[:, k]]
        todo = ask
        while len(todo):
            todo = todo[(now[todo] < top[todo]) & (begin[todo, now[todo] + 1] < at[todo, k])]
            now[todo] += 1
        j = stack[ask, now[ask]]
        d = at[ask, k] - at[ask, j]
        out[ask, k] = height[ask, j] + d * d
    return out


def spans(at: np.ndarray, height: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(heights, infinite where a place's parabola is nowhere the lowest; from where and to where it is)."""
    stack, begin, top = lowest(at, height, valid)
    i, k = np.nonzero(np.arange(at.shape[1]) <= top[:, None])
    kept, first, last = np.full(at.shape, np.inf), np.zeros(at.shape), np.zeros(at.shape)
    j = stack[i, k]
    kept[i, j], first[i, j], last[i, j] = height[i, j], begin[i, k], begin[i, k + 1]
    return kept, first, last


def outside(at: np.ndarray, height: np.ndarray, valid: np.ndarray) -> np.ndarray:
    """Heights, infinite where a place's parabola is not the lowest anywhere before or behind the line's places."""
    usable = valid & np.isfinite(height)
    if _level(height, usable):  # the first one and the last one
        ends = (np.cumsum(usable, axis=1) == 1) | (np.cumsum(usable[:, ::-1], axis=1) == 1)[:, ::-1]
        return np.where(usable & ends, height, np.inf)
    kept, first, last = spans(at, height, valid)
    low = np.where(valid, at, np.inf).min(axis=1, keepdims=True)
    high = np.where(valid, at, -np.inf).max(axis=1, keepdims=True)
    return np.where((first <= low) | (last >= high), kept, np.inf)


def _pass(at: DataFrame, a: str, s: float, boxes: DataFrame | None, scratch: Scratch | None, size: int) -> DataFrame:
    """``at`` (vol_id, x, y, z, d2) after one axis. With ``boxes`` (vol_id, lox..hiz) lines are cut into parts of ``size`` places."""
    scaled = lambda kernel: lambda places, heights, valid: kernel(places * s, heights, valid)
    if boxes is None:
        return map_lines(at, a, "d2", scaled(envelope), float("inf"), CELLS)
    part = lambda c: F.floor(c / size).cast("int")
    own = scratch.save(at.withColumn("part", part(F.col(a))), f"parts-{a}")
    tips = map_lines(own, a, "d2", scaled(outside), float("inf"), CELLS, by=("part",)).filter(F.col("d2") < float("inf"))
    tips = map_lines(tips.withColumns({"first": F.lit(0.0), "last": F.lit(0.0)}), a, "d2", scaled(spans), float("inf"), CELLS, also=("first", "last")).filter(F.col("d2") < float("inf"))
    # one place more on either side, for what rounding does to the bounds
    reach = F.sequence(part(F.greatest(F.col("first") / s - 1, F.col("lo"))), part(F.least(F.col("last") / s + 1, F.col("hi"))))
    far = tips.join(boxes.select("vol_id", F.col(f"lo{a}").alias("lo"), F.col(f"hi{a}").alias("hi")).hint("merge"), "vol_id").filter((F.col("first") / s - 1 <= F.col("hi")) & (F.col("last") / s + 1 >= F.col("lo")))
    far = far.withColumn("to", F.explode(reach)).filter("to <> part").select("vol_id", *AXES, "d2", F.col("to").alias("part"), F.lit(False).alias("own"))
    every = own.withColumn("own", F.lit(True)).unionByName(far)
    return map_lines(every, a, "d2", scaled(envelope), float("inf"), CELLS, by=("part",)).filter("own").select("vol_id", *AXES, "d2")


def distances(vox: DataFrame, spacing: tuple[float, float, float] = (1.0, 1.0, 1.0), part: int = PART) -> DataFrame:
    """vol_id, x, y, z, v: the distance of every stored voxel to the nearest one with ``source`` (boolean); infinity in a volume without any. Null places are left out.

    ``part``: places of a part of a line that is longer."""
    at = vox.filter(" and ".join(f"{a} is not null" for a in AXES)).select("vol_id", *[F.col(a).cast("int").alias(a) for a in AXES], F.when(F.coalesce("source", F.lit(False)), 0.0).otherwise(float("inf")).alias("d2"))
    boxes = at.groupBy("vol_id").agg(*[f(a).alias(n + a) for a in AXES for n, f in (("lo", F.min), ("hi", F.max))])
    longest = boxes.agg(*[F.max(F.col(f"hi{a}").cast("long") - F.col(f"lo{a}") + 1) for a in AXES]).first()
    cut = [n is not None and n > part for n in longest]
    scratch = Scratch(vox.sparkSession, "distances") if any(cut) else None
    boxes = scratch.save(boxes, "boxes") if scratch else boxes
    for a, s, long in zip(AXES, spacing, cut):
        at = _pass(at, a, float(s), boxes if long else None, scratch, part)
    return at.select("vol_id", *AXES, F.sqrt("d2").alias("v"))


def distance_transform(vox: DataFrame, spacing: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> DataFrame:
    """vol_id, x, y, z, v: distance of foreground voxels (v > 0) to the nearest background voxel; 0 on the background; infinity without background."""
    return distances(vox.select("vol_id", *AXES, (F.coalesce("v", F.lit(0)) <= 0).alias("source")), spacing)


def annotation_distance(atlas: DataFrame, spacing: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> DataFrame:
    """The same for an atlas (vol_id, x, y, z, id): how deep a voxel lies inside the annotated body."""
    return distance_transform(atlas.select("vol_id", *AXES, F.col("id").alias("v")), spacing)


def borders(atlas: DataFrame) -> DataFrame:
    """vol_id, x, y, z, border: whether a stored face neighbour has another id. One window for each axis, no join."""
    at = atlas.select("vol_id", *[F.col(a).cast("int").alias(a) for a in AXES], "id")
    flag = F.lit(False)
    for i, a in enumerate(AXES):
        w = Window.partitionBy("vol_id", *[c for c in AXES if c != a]).orderBy(a)
        other = lambda f, d, a=a, w=w: (f(a).over(w) == F.col(a) + d) & ~f("id").over(w).eqNullSafe(F.col("id"))
        at = at.withColumn(f"_b{i}", F.coalesce(other(F.lag, -1), F.lit(False)) | F.coalesce(other(F.lead, 1), F.lit(False)))
        flag = flag | F.col(f"_b{i}")
    return at.select("vol_id", *AXES, flag.alias("border"))


def border_distance(atlas: DataFrame, spacing: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> DataFrame:
    """vol_id, x, y, z, v: the distance of every voxel to the nearest voxel at a border of regions (0 there)."""
    return distances(borders(atlas).withColumnRenamed("border", "source"), spacing)
