"""Topology and morphology of voxel tables: components, hole filling, hysteresis, reconstruction, distances,
smoothing, skeletons, watersheds, maxima, gridded local statistics, minimum-cost paths.

Neighbour relations are equi-joins on exact coordinates, so nothing wraps at a
border. They are merged by hint: Spark takes an exploded table for as small as what it is exploded from, and a written one
for as small as its compressed file, and would broadcast either through the driver. Skeletons and watersheds have modules of their own (``thinning``, ``flooding``) and go by this one's name too. The cheapest path of one volume runs in one
Arrow group; its docstring says so.
"""

from __future__ import annotations

import heapq
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.components import connected_components
from tessera.operators.convolve import local_max
from tessera.operators.distances import distance_transform as distance_transform
from tessera.operators.flooding import watershed as watershed
from tessera.operators.thinning import skeletonize as skeletonize
from tessera.plans.blocks import BLOCK, Shape, box, gather, map_blocks
from tessera.plans.scratch import Scratch

AXES = ("x", "y", "z")
FACES = [(1, 0, 0), (0, 1, 0), (0, 0, 1)]
#: Steps to the 26 neighbours and their lengths.
MOVES = [(*d, sum(c * c for c in d) ** 0.5) for d in product((-1, 0, 1), repeat=3) if any(d)]
HALF = [d for d in product((-1, 0, 1), repeat=3) if d > (0, 0, 0)]


def label_voxels(mask: DataFrame, faces_only: bool = True) -> DataFrame:
    """vol_id, x, y, z, label (one number per connected component) of the listed voxels."""
    scratch = Scratch(mask.sparkSession, "voxels")
    at = ["vol_id", *AXES]
    m = scratch.save(mask.select("vol_id", *[F.col(a).cast("int").alias(a) for a in AXES]).distinct().withColumn("node", F.monotonically_increasing_id()), "mask")
    steps = F.array(*[F.struct(F.lit(a).alias("dx"), F.lit(b).alias("dy"), F.lit(c).alias("dz")) for a, b, c in (FACES if faces_only else HALF)])
    near = m.withColumn("o", F.explode(steps)).select("vol_id", *[(F.col(a) + F.col(f"o.d{a}")).alias(a) for a in AXES], F.col("node").alias("a"))
    links = near.join(m.withColumnRenamed("node", "b").hint("merge"), at).select("a", "b")
    found = connected_components(links, scratch)
    return m.join(found.hint("merge"), "node", "left").select(*at, F.coalesce("component", "node").alias("label"))


def fill_holes(vox: DataFrame) -> DataFrame:
    """vol_id, x, y, z, v (0 or 1): background components that touch no face of the volume become foreground."""
    ext = vox.groupBy("vol_id").agg(*[f(a).alias(f"{n}{a}") for a in AXES for n, f in (("lo", F.min), ("hi", F.max))])
    back = label_voxels(vox.filter("v <= 0"))
    touch = " or ".join(f"{a} = lo{a} or {a} = hi{a}" for a in AXES)
    outside = back.join(ext, "vol_id").filter(touch).select("vol_id", "label").distinct()
    holes = back.join(outside.hint("merge"), ["vol_id", "label"], "left_anti").select("vol_id", *AXES, F.lit(True).alias("hole"))
    return vox.join(holes.hint("merge"), ["vol_id", *AXES], "left").select("vol_id", *AXES, (F.coalesce("hole", F.lit(False)) | (F.col("v") > 0)).cast("int").alias("v"))


def threshold(vox: DataFrame, level: float, hysteresis: float | None = None, seeds: DataFrame | None = None) -> DataFrame:
    """vol_id, x, y, z, v: 1 for v >= level (or a seed); with ``hysteresis`` also what is joined to one of those by faces through v >= hysteresis; -1 elsewhere."""
    start = vox.filter(F.col("v") >= level).select("vol_id", *AXES) if seeds is None else seeds.select("vol_id", *AXES)
    if hysteresis is None:
        on = start
    else:
        parts = label_voxels(vox.filter(F.col("v") >= hysteresis).select("vol_id", *AXES).unionByName(start))
        hit = parts.join(start.hint("merge"), ["vol_id", *AXES], "left_semi").select("vol_id", "label").distinct()
        on = parts.join(hit.hint("merge"), ["vol_id", "label"], "left_semi").select("vol_id", *AXES)
    return vox.join(on.distinct().withColumn("on", F.lit(1)).hint("merge"), ["vol_id", *AXES], "left").select("vol_id", *AXES, F.coalesce("on", F.lit(-1)).alias("v"))


def reconstruct(vox: DataFrame, method: str = "dilation", offsets: np.ndarray | None = None, block: Shape = BLOCK, check: bool = True) -> DataFrame:
    """Grey reconstruction. vox: vol_id, x, y, z, seed, mask. Dilation needs seed <= mask, erosion seed >= mask (ValueError).

    Each round converges inside every block, then blocks see their neighbours' new border; rounds end when
    nothing changes.
    """
    sign = {"dilation": 1.0, "erosion": -1.0}.get(method)
    if sign is None:
        raise ValueError(f"unknown method {method}")
    if check and vox.filter(F.col("seed") * sign > F.col("mask") * sign).limit(1).count():
        raise ValueError("seed and mask are in the wrong order")
    offs = box() if offsets is None else offsets

    def kernel(values, stored, _, owned):
        seed, mask = values[..., 0] * sign, values[..., 1] * sign
        seed = np.where(stored, seed, -np.inf)
        while True:
            v, s = gather(seed, stored, offs)
            new = np.where(stored, np.minimum(np.where(s, v, -np.inf).max(-1), mask), -np.inf)
            new = np.maximum(new, seed)
            if np.array_equal(new, seed):
                return {"v": np.where(stored, seed * sign, 0.0), "mask": values[..., 1], "changed": (stored & (seed * sign != values[..., 0])).astype(np.int64)}
            seed = new

    scratch = Scratch(vox.sparkSession, "reconstruct")
    now = scratch.save(vox.select("vol_id", *AXES, F.col("seed").cast("double").alias("v"), F.col("mask").cast("double").alias("mask")), "0")
    halo = tuple(int(a) for a in np.abs(offs).max(0))
    i = 0
    while True:
        i += 1
        now = scratch.save(map_blocks(now, kernel, {"v": "double", "mask": "double", "changed": "bigint"}, block, halo, "float64", ("mask",), pack=max(halo)), str(i))
        scratch.drop(str(i - 1))
        if not now.filter("changed = 1").limit(1).count():
            return now.select("vol_id", *AXES, "v")


def h_max(vox: DataFrame, h: float, block: Shape = BLOCK) -> DataFrame:
    """Reconstruction of v - h (not below 0 for whole numbers) under v."""
    kind = vox.schema["v"].dataType.simpleString()
    low = F.col("v") - h if kind in ("double", "float") else F.greatest(F.col("v") - h, F.lit(0))
    return reconstruct(vox.select("vol_id", *AXES, low.alias("seed"), F.col("v").alias("mask")), block=block)


def find_maxima(vox: DataFrame, h: float | None = None, shape: int = 5, level: float | None = None) -> DataFrame:
    """Local maxima of the (h-max transformed) volume whose own value reaches the level."""
    top = local_max(vox if not h else h_max(vox, h), shape).select("vol_id", *AXES)
    out = vox.join(top.hint("merge"), ["vol_id", *AXES], "left_semi")
    return out if level is None else out.filter(F.col("v") >= level)


def centers_of_maxima(vox: DataFrame, maxima: DataFrame) -> DataFrame:
    """vol_id, x, y, z: intensity-weighted centre of every plateau (26-connected)."""
    parts = label_voxels(maxima, faces_only=False).join(vox.hint("merge"), ["vol_id", *AXES])
    return parts.groupBy("vol_id", "label").agg(*[(F.sum(F.col(a) * F.col("v")) / F.sum("v")).alias(a) for a in AXES]).drop("label")


def smooth_by_counting(vox: DataFrame, low: int = 5, high: int = 10, block: Shape = BLOCK) -> DataFrame:
    """v: 1 where at least ``high`` foreground voxels are in the 3 x 3 x 3 box (centre included), 0 below ``low``, else unchanged."""

    def kernel(values, stored, _, owned):
        v, s = gather(values, stored, box())
        n = ((v > 0) & s).sum(-1)
        return {"v": np.where(n >= high, 1, np.where(n < low, 0, (values > 0).astype(np.int64)))}

    return map_blocks(vox, kernel, {"v": "bigint"}, block, pack=1)


def smooth_binary_iterated(vox: DataFrame, iterations: int = 1, low: int = 5, high: int = 10, block: Shape = BLOCK) -> DataFrame:
    for _ in range(iterations):
        vox = smooth_by_counting(vox, low, high, block)
    return vox


def _per_volume(vox: DataFrame, function, schema: str) -> DataFrame:
    """function(array, low corner) -> rows, one volume per group: the volume must fit one task."""

    def run(df: pd.DataFrame) -> pd.DataFrame:
        lo = df[list(AXES)].min().to_numpy()
        shape = df[list(AXES)].max().to_numpy() - lo + 1
        a = np.zeros(shape, float)
        a[tuple((df[c].to_numpy() - lo[i]) for i, c in enumerate(AXES))] = df["v"]
        rows = function(a, lo, df)
        rows.insert(0, "vol_id", df["vol_id"].iloc[0])
        return rows

    return vox.groupBy("vol_id").applyInPandas(run, f"vol_id {vox.schema['vol_id'].dataType.simpleString()}, {schema}")


def trace_path(vox: DataFrame, ends: DataFrame, least: float = 1 / 60, reward: float = 4.0) -> DataFrame:
    """vol_id, step, x, y, z, cost of the cheapest 26-neighbour path from start to stop, where entering a voxel costs
    max(1 / (reward * v), least) times the step length. ends: vol_id, sx, sy, sz, tx, ty, tz. One volume per group."""
    both = vox.join(ends, "vol_id")

    def search(a: np.ndarray, lo: np.ndarray, df: pd.DataFrame) -> pd.DataFrame:
        r = df.iloc[0]
        start, stop = (tuple(int(r[f"{e}{c}"] - lo[i]) for i, c in enumerate(AXES)) for e in "st")
        nx, ny, nz = a.shape
        price = np.maximum(np.where(a > 0, 1 / (reward * np.where(a > 0, a, 1)), 1.0), least).tolist()
        cost, came, heap = {start: 0.0}, {}, [(0.0, start)]
        while heap:
            c, p = heapq.heappop(heap)
            if p == stop:
                break
            if c > cost[p]:
                continue
            x, y, z = p
            for dx, dy, dz, length in MOVES:
                i, j, k = x + dx, y + dy, z + dz
                if 0 <= i < nx and 0 <= j < ny and 0 <= k < nz:
                    q, new = (i, j, k), c + price[i][j][k] * length
                    if new < cost.get(q, np.inf) - 1e-12:
                        cost[q], came[q] = new, p
                        heapq.heappush(heap, (new, q))
        path, p = [stop], stop
        while p != start and p in came:
            p = came[p]
            path.append(p)
        path.reverse()
        return pd.DataFrame([(i, *(x + y for x, y in zip(p, lo)), cost.get(p, np.inf)) for i, p in enumerate(path)], columns=["step", *AXES, "cost"]).astype({"step": "int32", "x": "int32", "y": "int32", "z": "int32"})

    return _per_volume(both, search, "step int, x int, y int, z int, cost double")


def windows(vox: DataFrame, selem: Shape, spacing: Shape, step: Shape = (1, 1, 1)) -> DataFrame:
    """``vox`` once for each window (cx, cy, cz) of size ``selem`` around grid centres every ``spacing`` that holds the voxel.

    Centre number c sits at c * spacing + spacing // 2. A voxel is sent to the few centres whose
    window holds it; ``step`` takes every n-th voxel only.
    """
    rows = vox.filter(" and ".join(f"{a} % {s} = 0" for a, s in zip(AXES, step)))
    ext = vox.groupBy("vol_id").agg(*[F.max(a).alias(f"hi{a}") for a in AXES])
    rows = rows.join(ext, "vol_id")
    for a, n, s in zip(AXES, selem, spacing):
        # window of c: [c s + s // 2 - n // 2, c s + s // 2 - n // 2 + n)
        base = s // 2 - n // 2
        first = F.greatest(F.ceil((F.col(a) - base - n + 1) / s), F.lit(0)).cast("int")
        last = F.least(F.floor((F.col(a) - base) / s), F.floor(F.greatest(F.col(f"hi{a}") - s // 2, F.lit(0)) / s)).cast("int")
        rows = rows.withColumn("_f", first).withColumn("_l", last).filter("_f <= _l").withColumn(f"c{a}", F.explode(F.sequence("_f", "_l"))).drop("_f", "_l", f"hi{a}")
    return rows


def local_statistic(vox: DataFrame, function, selem: Shape, spacing: Shape, step: Shape = (1, 1, 1)) -> DataFrame:
    """vol_id, cx, cy, cz, v: an aggregate column of the voxels in each of the ``windows``."""
    return windows(vox, selem, spacing, step).groupBy("vol_id", *[f"c{a}" for a in AXES]).agg(function.alias("v"))


def local_percentile(vox: DataFrame, share: float, selem: Shape, spacing: Shape, step: Shape = (1, 1, 1)) -> DataFrame:
    """Exact linear percentile in windows of a grid."""
    return local_statistic(vox, F.percentile("v", share), selem, spacing, step)


def local_histogram(vox: DataFrame, selem: Shape, spacing: Shape) -> DataFrame:
    """vol_id, cx, cy, cz, bin, n."""
    marked = vox.withColumn("bin", F.col("v"))
    rows = local_statistic(marked, F.collect_list("bin"), selem, spacing)
    return rows.select("vol_id", "cx", "cy", "cz", F.explode("v").alias("bin")).groupBy("vol_id", "cx", "cy", "cz", "bin").agg(F.count("*").alias("n"))


def interpolate_grid(vox: DataFrame, grid: DataFrame, spacing: Shape) -> DataFrame:
    """vox with g: the grid's values interpolated linearly between centres (the nearest beyond the outer ones). Eight equi-joins' worth of corners as one exploded join."""
    top = grid.groupBy("vol_id").agg(*[F.max(f"c{a}").alias(f"top{a}") for a in AXES])
    rows = vox.join(top, "vol_id")
    for a, s in zip(AXES, spacing):
        t = F.least(F.greatest((F.col(a) - s // 2) / F.lit(float(s)), F.lit(0.0)), F.col(f"top{a}").cast("double"))
        rows = rows.withColumn(f"_t{a}", t).withColumn(f"_b{a}", F.floor(f"_t{a}").cast("int"))
    corners = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(k).alias("k")) for i in (0, 1) for j in (0, 1) for k in (0, 1)])
    rows = rows.withColumn("_c", F.explode(corners))
    weight = F.lit(1.0)
    for a, i in zip(AXES, "ijk"):
        part = F.col(f"_t{a}") - F.col(f"_b{a}")
        weight = weight * F.when(F.col(f"_c.{i}") == 1, part).otherwise(1 - part)
    rows = rows.withColumn("_w", weight).filter("_w > 0").withColumns({f"c{a}": F.col(f"_b{a}") + F.col(f"_c.{i}") for a, i in zip(AXES, "ijk")})
    hit = rows.join(grid.withColumnRenamed("v", "_g"), ["vol_id", "cx", "cy", "cz"])
    return hit.groupBy("vol_id", *AXES).agg(F.first("v").alias("v"), F.sum(F.col("_g") * F.col("_w")).alias("g"))


def correct_lightsheet(vox: DataFrame, share: float, line: Shape, background: Shape, spacing: Shape, factor: float = 2.0) -> DataFrame:
    """v - min(v, min(l, factor * b)), with l the local percentile along a line and b a gridded one."""
    grid_l, grid_b = local_percentile(vox, share, line, (1, 1, 1)), local_percentile(vox, share, background, spacing)
    l_ = interpolate_grid(vox, grid_l, (1, 1, 1)).select("vol_id", *AXES, F.col("g").alias("l"))
    b_ = interpolate_grid(vox, grid_b, spacing).select("vol_id", *AXES, F.col("g").alias("b"))
    v = F.col("v") - F.least(F.col("v"), F.least(F.col("l"), F.col("b") * factor))
    return vox.join(l_, ["vol_id", *AXES]).join(b_, ["vol_id", *AXES]).select("vol_id", *AXES, v.alias("v"))


def equalize_local(vox: DataFrame, low: float, high: float, top: float, selem: Shape, spacing: Shape) -> DataFrame:
    """v times 1 / max(p0, 1), capped so that p1 times the factor is at most ``top``."""
    p0 = interpolate_grid(vox, local_percentile(vox, low, selem, spacing), spacing).select("vol_id", *AXES, F.col("g").alias("p0"))
    p1 = interpolate_grid(vox, local_percentile(vox, high, selem, spacing), spacing).select("vol_id", *AXES, F.col("g").alias("p1"))
    f = 1 / F.greatest("p0", F.lit(1.0))
    f = F.when(F.col("p1") * f > top, top / F.col("p1")).otherwise(f)
    return vox.join(p0, ["vol_id", *AXES]).join(p1, ["vol_id", *AXES]).select("vol_id", *AXES, (F.col("v") * f).alias("v"))


def threshold_isodata(vox: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """``keys`` (vol_id), level: the largest value t at which t is the middle between the means of v <= t and v > t (rounded down); 1 if there is none."""
    keys = keys or ["vol_id"]
    h = vox.groupBy(*keys, "v").agg(F.count("*").alias("n"))
    entries = h.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("v", "n"))).alias("h"))  # at most one entry per grey value

    def level(df):
        for part in df:
            out = []
            for hist in part["h"]:
                v, n = np.array([x["v"] for x in hist], float), np.array([x["n"] for x in hist], float)
                c, s = np.cumsum(n), np.cumsum(n * v)
                with np.errstate(divide="ignore", invalid="ignore"):
                    mid = (s / c + (s[-1] - s) / (c[-1] - c)) / 2
                ok = np.flatnonzero((c < c[-1]) & (mid >= v) & (mid < np.append(v[1:], np.inf)))
                out.append(float(v[ok[-1]]) if len(ok) else 1.0)
            yield part[keys].assign(level=out)

    kinds = ", ".join(f"{k} {vox.schema[k].dataType.simpleString()}" for k in keys)
    return entries.mapInPandas(level, f"{kinds}, level double")


def skeleton_ends(skeleton: DataFrame) -> DataFrame:
    """vol_id, x, y, z, degree of skeleton voxels with at most one 26-neighbour."""
    s = skeleton.select("vol_id", *AXES)
    steps = F.array(*[F.struct(F.lit(a).alias("dx"), F.lit(b).alias("dy"), F.lit(c).alias("dz")) for a, b, c in product((-1, 0, 1), repeat=3) if (a, b, c) != (0, 0, 0)])
    near = s.withColumn("o", F.explode(steps)).select("vol_id", *[(F.col(a) + F.col(f"o.d{a}")).alias(a) for a in AXES])
    degree = near.groupBy("vol_id", *AXES).agg(F.count("*").alias("degree"))
    return s.join(degree.hint("merge"), ["vol_id", *AXES], "left").fillna(0, ["degree"]).filter("degree <= 1")
