"""Alignment and placement of tiles: rigid by maximum projections, and slice by slice.

tiles: tile, lox, loy, loz, hix, hiy, hiz (half-open boxes in mosaic coordinates); voxels: tile, x, y, z, v (inside the
tile); alignments: pre, post, dx, dy, dz (what post is to be moved by against its box, relative to pre), quality.

Overlap bands are cut and projected by equi-joins and partial aggregation, so a task
gets one pair's projections (two tile faces), never its volumes.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import slice_tracing
from tessera.operators.ordered import smooth
from tessera.operators.spatial import AXES, best_shift, filter_alignments, overlaps, positions_from_optimization, stitch


def sort_by_position(tiles: DataFrame) -> DataFrame:
    """tiles with ``rank``: the order of their low corners (x, then y, then z, then tile). A layout has at most thousands of tiles: one task."""
    return tiles.withColumn("rank", F.row_number().over(Window.orderBy(*[f"lo{a}" for a in AXES], "tile")))


def center_tile(tiles: DataFrame) -> DataFrame:
    """The tile whose centre is nearest to the middle of the layout (ties: the smallest)."""
    ext = tiles.agg(*[((F.min(f"lo{a}") + F.max(f"hi{a}")) / 2).alias(f"m{a}") for a in AXES])
    far = sum(((F.col(f"lo{a}") + F.col(f"hi{a}")) / 2 - F.col(f"m{a}")) ** 2 for a in AXES)
    return tiles.join(F.broadcast(ext)).select("tile", far.alias("far")).groupBy().agg(F.min_by("tile", F.struct("far", "tile")).alias("tile"))  # one row each side


def aligned_tiles(alignments: DataFrame) -> DataFrame:
    """tile: those that an alignment names."""
    return alignments.select(F.col("pre").alias("tile")).union(alignments.select("post")).distinct()


def alignments_from_positions(tiles: DataFrame, positions: DataFrame, pairs: DataFrame) -> DataFrame:
    """pre, post, dx, dy, dz of pairs, from positions (tile, x, y, z) against the tiles' boxes."""
    moved = positions.join(tiles, "tile").select("tile", *[(F.col(a) - F.col(f"lo{a}")).alias(f"m{a}") for a in AXES])
    at = lambda t: moved.select(F.col("tile").alias(t), *[F.col(f"m{a}").alias(f"{t}_{a}") for a in AXES])
    return pairs.select("pre", "post").join(at("pre"), "pre").join(at("post"), "post").select("pre", "post", *[(F.col(f"post_{a}") - F.col(f"pre_{a}")).alias(f"d{a}") for a in AXES])


def bands(tiles: DataFrame, voxels: DataFrame, pairs: DataFrame) -> DataFrame:
    """pre, post, side (0 or 1), x, y, z (in the pair's overlap box), v: both tiles' voxels of every overlap."""
    box = pairs.select("pre", "post", *[f"{n}{a}" for a in AXES for n in ("lo", "hi")])
    origin = tiles.select("tile", *[F.col(f"lo{a}").alias(f"o{a}") for a in AXES])
    out = None
    for side, tile in enumerate(("pre", "post")):
        rows = voxels.join(origin, "tile").select("tile", *[(F.col(a) + F.col(f"o{a}")).alias(a) for a in AXES], "v").join(box, F.col("tile") == F.col(tile))
        for a in AXES:
            rows = rows.filter((F.col(a) >= F.col(f"lo{a}")) & (F.col(a) < F.col(f"hi{a}")))
        one = rows.select("pre", "post", F.lit(side).alias("side"), *[(F.col(a) - F.col(f"lo{a}")).cast("int").alias(a) for a in AXES], "v")
        out = one if out is None else out.unionByName(one)
    return out


def _arrays(df: pd.DataFrame, axes: list[str], value: str = "v") -> list[np.ndarray]:
    """Both sides' dense arrays over the same box; 0 where nothing is stored."""
    shape = [int(df[a].max()) + 1 for a in axes]
    out = []
    for side in (0, 1):
        a = np.zeros(shape)
        part = df[df["side"] == side]
        a[tuple(part[c].to_numpy() for c in axes)] = part[value]
        out.append(a)
    return out


def align_pairs_mip(tiles: DataFrame, voxels: DataFrame, pairs: DataFrame, max_shift: int = 5, project: tuple[str, ...] = AXES) -> DataFrame:
    """pre, post, dx, dy, dz, quality. Each overlap is projected (maximum) along the named axes; every projection gives the two shifts of its plane, and
    an axis takes the mean of what the projections say, rounded. Quality: the least of the projections' (minus the mean squared difference)."""
    found = bands(tiles, voxels, pairs)
    flat = None
    for a in project:
        rest = [b for b in AXES if b != a]
        one = found.groupBy("pre", "post", "side", *rest).agg(F.max("v").cast("double").alias("v")).select("pre", "post", "side", F.lit(a).alias("along"), F.col(rest[0]).alias("i"), F.col(rest[1]).alias("j"), "v")
        flat = one if flat is None else flat.unionByName(one)

    def run(df: pd.DataFrame) -> pd.DataFrame:
        shifts: dict[str, list[int]] = {a: [] for a in AXES}
        quality = np.inf
        for a, part in df.groupby("along"):
            if part["side"].nunique() < 2:
                continue
            shift, q = best_shift(*_arrays(part, ["i", "j"]), max_shift)
            for b, s in zip([b for b in AXES if b != a], shift):
                shifts[b].append(s)
            quality = min(quality, q)
        d = [int(np.rint(np.mean(shifts[a]))) if shifts[a] else 0 for a in AXES]
        return pd.DataFrame([(df["pre"].iloc[0], df["post"].iloc[0], *d, float(quality) if np.isfinite(quality) else float("-inf"))], columns=["pre", "post", "dx", "dy", "dz", "quality"])

    return flat.groupBy("pre", "post").applyInPandas(run, "pre bigint, post bigint, dx int, dy int, dz int, quality double")


def align_layout(tiles: DataFrame, voxels: DataFrame, cell: int, max_shift: int = 5, axis: str | None = None) -> DataFrame:
    """Alignments of all overlapping pairs; with ``axis`` from the projection along it only (shifts along it are 0)."""
    return align_pairs_mip(tiles, voxels, overlaps(tiles, cell), max_shift, AXES if axis is None else (axis,))


def place_layout(tiles: DataFrame, alignments: DataFrame, min_quality: float = float("-inf")) -> DataFrame:
    """tile, component, x, y, z: boxes moved by the least-squares solution of all alignments; the lowest corner of a component is 0."""
    solved = positions_from_optimization(tiles, filter_alignments(alignments, min_quality).select("pre", "post", *[F.col(f"d{a}").cast("double").alias(f"d{a}") for a in AXES], "quality"))
    at = solved.join(tiles, "tile").select("tile", "component", *[(F.col(a) + F.col(f"lo{a}")).alias(a) for a in AXES])
    w = Window.partitionBy("component")
    return at.select("tile", "component", *[(F.col(a) - F.min(a).over(w)).alias(a) for a in AXES])


def slice_layout(tiles: DataFrame, axis: str, step: int) -> DataFrame:
    """Tiles cut into slabs of ``step`` along an axis: tile, slab and the slab's box."""
    lo, hi = F.col(f"lo{axis}"), F.col(f"hi{axis}")
    cut = tiles.withColumn("slab", F.explode(F.sequence(F.floor(lo / step), F.floor((hi - 1) / step))))
    return cut.withColumns({f"lo{axis}": F.greatest(lo, F.col("slab") * step), f"hi{axis}": F.least(hi, (F.col("slab") + 1) * step)})


def stitch_layout(tiles: DataFrame, voxels: DataFrame, alignments: DataFrame, method: str = "interpolation", shape=None) -> DataFrame:
    """x, y, z, v: align, place and stitch in one."""
    return stitch(voxels, place_layout(tiles, alignments), method, shape)


def overlay(tiles_vox: DataFrame, positions: DataFrame, colors: DataFrame) -> DataFrame:
    """x, y, z, r, g, b: tiles in their colors (tile, r, g, b in 0..1) on top of each other, channel by channel the largest value."""
    p = positions.select("tile", *[F.round(a).cast("int").alias(f"p{a}") for a in AXES])
    at = tiles_vox.join(p, "tile").join(colors, "tile")
    return at.groupBy(*[(F.col(a) + F.col(f"p{a}")).alias(a) for a in AXES]).agg(*[F.max(F.col("v") * F.col(c)).alias(c) for c in "rgb"])


# slice by slice: a tile whose slices along one axis move for themselves
def slice_errors(tiles: DataFrame, voxels: DataFrame, pairs: DataFrame, axis: str = "z", max_shift: int = 3) -> DataFrame:
    """pre, post, s (slice of the overlap along ``axis``), dx, dy, dz, error, n: the mean squared difference of every shift of post's slice within ``max_shift``
    across the other two axes. Each voxel travels once."""
    return slice_tracing.slice_errors(bands(tiles, voxels, pairs), axis, max_shift)


def align_slices(errors: DataFrame, least: int = 1) -> DataFrame:
    """pre, post, s, dx, dy, dz, quality: each slice's best shift (ties: the smallest step, then the smallest shift) among those compared in at least ``least`` voxels."""
    size = sum(F.col(f"d{a}") * F.col(f"d{a}") for a in AXES)
    best = errors.filter(F.col("n") >= least).groupBy("pre", "post", "s").agg(F.min(F.struct(F.col("error"), size.alias("size"), *[f"d{a}" for a in AXES])).alias("m"))
    return best.select("pre", "post", "s", *[F.col(f"m.d{a}").alias(f"d{a}") for a in AXES], (-F.col("m.error")).alias("quality"))


def smooth_slices(aligned: DataFrame, length: int = 5, window: str = "bartlett") -> DataFrame:
    """Slice shifts smoothed along the slices of a pair (columns dx, dy, dz as doubles)."""
    out = aligned
    for a in AXES:
        out = smooth(out.withColumn(f"d{a}", F.col(f"d{a}").cast("double")), ["pre", "post"], "s", f"d{a}", length, window).drop(f"d{a}").withColumnRenamed("smooth", f"d{a}")
    return out


def place_slices(tiles: DataFrame, aligned: DataFrame, axis: str = "z", pairs: DataFrame | None = None) -> DataFrame:
    """tile, s (slice of the mosaic along ``axis``), x, y, z: least-squares positions of every slice of every tile. Slices are solved one by one, as
    one group per (slice, component); slices of a tile that no alignment names keep the tile's box."""
    if pairs is None:
        widest = tiles.agg(F.max(F.greatest(*[F.col(f"hi{a}") - F.col(f"lo{a}") for a in AXES]))).first()[0]
        pairs = overlaps(tiles, max(1, int(widest or 1)))
    boxes = pairs
    at = aligned.join(boxes.select("pre", "post", F.col(f"lo{axis}").alias("_lo")), ["pre", "post"]).withColumn("s", F.col("s") + F.col("_lo"))
    every = tiles.select("tile", *[f"lo{a}" for a in AXES], F.explode(F.sequence(F.col(f"lo{axis}"), F.col(f"hi{axis}") - 1)).alias("s"))
    key = lambda t: F.col("s").cast("long") * (1 << 32) + F.col(t)
    nodes = every.select(key("tile").alias("tile"))
    edges = at.select(key("pre").alias("pre"), key("post").alias("post"), *[F.col(f"d{a}").cast("double").alias(f"d{a}") for a in AXES], "quality")
    solved = positions_from_optimization(nodes, edges).select(F.col("tile").alias("_key"), *[F.col(a).alias(f"_{a}") for a in AXES])
    return every.withColumn("_key", key("tile")).join(solved, "_key", "left").select("tile", "s", *[(F.col(f"lo{a}") + F.coalesce(f"_{a}", F.lit(0.0))).alias(a) for a in AXES])


def stitch_slices(tiles: DataFrame, voxels: DataFrame, placed: DataFrame, axis: str = "z", method: str = "mean") -> DataFrame:
    """x, y, z, v of a mosaic whose slices were placed for themselves; max, min or mean of what meets."""
    value = {"max": F.max("v"), "min": F.min("v"), "mean": F.avg("v")}.get(method)
    if value is None:
        raise ValueError(f"unknown method {method}")
    origin = tiles.select("tile", F.col(f"lo{axis}").alias("_o"))
    rows = voxels.join(origin, "tile").withColumn("s", F.col(axis) + F.col("_o"))
    p = placed.select("tile", "s", *[F.round(a).cast("int").alias(f"p{a}") for a in AXES])
    at = rows.join(p, ["tile", "s"]).select(*[(F.col("s") if a == axis else F.col(a) + F.col(f"p{a}")).alias(a) for a in AXES], "v")
    return at.groupBy(*AXES).agg(value.alias("v"))
