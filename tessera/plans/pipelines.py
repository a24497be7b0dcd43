"""Whole pipelines, composed of the operators: cells of a volume, region tables, group comparison, binary vessels and their graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.plans.scratch import Scratch

from tessera.functions import stats as T
from tessera.operators import cells as C
from tessera.operators import convolve as K
from tessera.operators import elementwise as E
from tessera.operators import hierarchy as H
from tessera.operators import morphology as M
from tessera.operators import scatter as S
from tessera.operators.graph import Graph, graph_from_skeleton
from tessera.operators.rank import rank_filter

AXES = ("x", "y", "z")


def detect_cells(vox: DataFrame, flatfield: DataFrame | None = None, background: tuple[int, int] | None = (5, 5), dog: tuple[int, int, int] | None = None, shape: int = 5, h: float | None = None, level: float | None = None, shape_level: float | None = None, measure: str = "max") -> DataFrame:
    """vol_id, x, y, z, size, source: illumination correction, background removal, difference of Gaussians, maxima, watershed
    shapes above ``shape_level``, and the intensity of each shape. Cells of size 0 are left out. Steps that are None are skipped."""
    now = E.correct_illumination(vox, flatfield)
    if background is not None:
        now = K.remove_background(now, background)
    filtered = K.dog_filter(now, dog)
    maxima = M.find_maxima(filtered, h, shape, level)
    if shape_level is None:
        out = maxima.select("vol_id", *AXES, F.lit(1).cast("long").alias("size"))
        return out.join(vox.withColumnRenamed("v", "source"), ["vol_id", *AXES])
    seeds = maxima.withColumn("label", (F.col("x").cast("long") * (1 << 40)) + (F.col("y").cast("long") * (1 << 20)) + F.col("z") + 1)
    shapes = M.watershed(now, seeds, shape_level)
    sizes = S.measure_labels(vox, shapes, measure)
    return sizes.join(seeds.select("vol_id", "label", *AXES), ["vol_id", "label"]).filter("size > 0").select("vol_id", *AXES, "size", F.col("v").alias("source"))


def annotate_cells(cells: DataFrame, atlas: DataFrame, paths: DataFrame, transform: list[Column] | None = None) -> DataFrame:
    """cells with xt, yt, zt (atlas space), id, hemisphere, name and preorder; cells outside the atlas have id 0."""
    at = transform or [F.col(a).cast("double") for a in AXES]
    moved = cells.withColumns({f"{a}t": c for a, c in zip(AXES, at)})
    key = atlas.select(F.col("x").alias("_x"), F.col("y").alias("_y"), F.col("z").alias("_z"), F.col("id").alias("_id"), "hemisphere")
    hit = moved.join(key, (F.col("xt").cast("int") == F.col("_x")) & (F.col("yt").cast("int") == F.col("_y")) & (F.col("zt").cast("int") == F.col("_z")), "left")
    return H.enrich(hit.withColumn("id", F.coalesce("_id", F.lit(0)).cast("long")).drop("_x", "_y", "_z", "_id"), paths, ("name", "preorder"))


def region_table(cells: DataFrame, atlas: DataFrame, paths: DataFrame, scale: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> DataFrame:
    """hemisphere, id, name, preorder, volume, counts, mean_size of every atlas region and side."""
    volumes = H.volume_map(atlas, scale, ("id", "hemisphere"))
    regions = H.enrich(volumes, paths, ("name", "preorder"))
    return C.region_statistics(cells, regions)


def compare_groups(counts: DataFrame, first: list[str], second: list[str], p_cutoff: float | None = None) -> DataFrame:
    """id, hemisphere, means, deviations, t, p, q, p_sign of two groups of samples. ``counts``: sample, id, hemisphere, counts; a region a sample lacks counts 0."""
    scaffold = counts.select("id", "hemisphere").distinct().withColumn("sample", F.explode(F.array(*[F.lit(s) for s in (*first, *second)])))
    full = scaffold.join(counts, ["sample", "id", "hemisphere"], "left").fillna(0, ["counts"]).withColumn("grp", F.when(F.col("sample").isin(first), 1).otherwise(2))
    tests = T.t_test(full, ["id", "hemisphere"], "grp", "counts", 1, 2, signed=True, p_cutoff=p_cutoff)
    return T.correct_p_values(T.drop_empty_regions(tests))


def voxel_p_values(vox: DataFrame, group: str, first, second) -> DataFrame:
    """x, y, z, t, p of two groups of volumes, voxel by voxel (equal variances)."""
    return T.t_test(vox, list(AXES), group, "v", first, second, equal_var=True)


def binarize(vox: DataFrame, low: int, high: int, median: bool = True, level: float | None = None, fill: bool = True, smooth: bool = True) -> DataFrame:
    """vol_id, x, y, z, v (0 or 1): clip, median, threshold (by default each volume's own ISODATA level), bright voxels, smoothing, hole filling."""
    flags = E.clip_with_flags(vox, low, high)
    now = flags.select("vol_id", *AXES, F.col("clipped").cast("long").alias("v"))
    if median:
        now = rank_filter(now, "median")
    if level is None:
        bars = M.threshold_isodata(now)
        now = now.join(bars, "vol_id").select("vol_id", *AXES, (F.col("v") > F.col("level")).cast("int").alias("v"))
    else:
        now = now.select("vol_id", *AXES, (F.col("v") > level).cast("int").alias("v"))
    now = now.join(flags.select("vol_id", *AXES, "high"), ["vol_id", *AXES]).select("vol_id", *AXES, F.greatest("v", F.col("high").cast("int")).alias("v"))
    if smooth:
        now = M.smooth_by_counting(now)
    return M.fill_holes(now) if fill else now.select("vol_id", *AXES, F.col("v").cast("int").alias("v"))


def vessel_graph(binary: DataFrame, annotation: DataFrame | None = None) -> Graph:
    """One volume's graph: skeleton, radii from the distance transform, cleaned branch points, chains reduced; vertices annotated by voxel."""
    scratch = Scratch(binary.sparkSession, "vessel-graph")
    # every step reads its graph several times
    written = lambda g, name: Graph(scratch.save(g.vertices, f"{name}-vertices"), scratch.save(g.edges, f"{name}-edges"))
    skeleton = M.skeletonize(binary).drop("vol_id")
    radii = M.distance_transform(binary).select(*AXES, F.col("v").alias("radius"))
    raw = graph_from_skeleton(skeleton.withColumn("v", F.lit(1)))
    g = Graph(raw.vertices.join(radii.hint("merge"), list(AXES), "left"), raw.edges.withColumn("length", F.lit(1.0)))
    g = written(g.define_edge_property("radius", F.lit(0.0)), "raw")
    cleaned = written(g.clean(), "cleaned")
    scratch.drop("raw-vertices", "raw-edges")
    reduced = cleaned.reduce()
    if annotation is None:
        return reduced
    label = annotation.select(F.col("x").alias("_x"), F.col("y").alias("_y"), F.col("z").alias("_z"), F.col("id").alias("annotation"))
    v = reduced.vertices
    at = [F.round(v[a]).cast("int") for a in AXES]
    return Graph(v.join(label, (at[0] == F.col("_x")) & (at[1] == F.col("_y")) & (at[2] == F.col("_z")), "left").drop("_x", "_y", "_z"), reduced.edges)


#: Bounds of one axis that are joined by broadcast.
FEW_BOUNDS = 100_000


def _numbered_bounds(tiles: DataFrame, a: str, scratch: Scratch) -> tuple[DataFrame, int]:
    """(b, n of the distinct bounds of one axis, from 0 in ascending order; how many they are)."""
    bounds = tiles.select(F.col(f"lo{a}").alias("b")).union(tiles.select(F.col(f"hi{a}"))).filter("b is not null").distinct()
    saved = scratch.save(bounds.repartitionByRange("b").sortWithinPartitions("b").withColumn("_id", F.monotonically_increasing_id()), f"bounds-{a}")
    part = F.shiftright("_id", 33)
    sizes = saved.groupBy(part.alias("p")).count().orderBy("p").collect()  # a row for each partition
    total, offsets = 0, []
    for p, n in sizes:
        offsets.append((p, total))
        total += n
    first = tiles.sparkSession.createDataFrame(offsets, "_p bigint, _first bigint")
    return saved.withColumn("_p", part).join(F.broadcast(first), "_p").select("b", (F.col("_first") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))).alias("n")), total


def embedding(tiles: DataFrame, few_bounds: int = FEW_BOUNDS) -> DataFrame:
    """lox..hiz, tiles: the union of boxes as disjoint elementary boxes, each with the tiles that cover it.

    Coordinate compression per tile: bounds are numbered in their order, so the bounds between a tile's own on an axis are a range of numbers,
    and an elementary box is made only where a tile is. All joins are by equality.
    """
    out, scratch = tiles, Scratch(tiles.sparkSession, "embedding")
    for a in AXES:
        bounds, count = _numbered_bounds(tiles, a, scratch)
        near = (lambda df: F.broadcast(df)) if count <= few_bounds else (lambda df: df.hint("merge"))
        for end in ("lo", "hi"):
            out = out.join(near(bounds.select(F.col("b").alias(f"{end}{a}"), F.col("n").alias(f"_{end}"))), f"{end}{a}")
        out = out.withColumn("_n", F.explode(F.when(F.col("_lo") < F.col("_hi"), F.sequence(F.col("_lo"), F.col("_hi") - 1)))).drop("_lo", "_hi", f"lo{a}", f"hi{a}")
        parts = [bounds.select(F.col("b").alias(f"{end}{a}"), (F.col("n") - k).alias("_n")) for k, end in enumerate(("lo", "hi"))]
        for part in parts:
            out = out.join(near(part), "_n")
        out = out.drop("_n")
    return out.groupBy(*[f"{n}{a}" for a in AXES for n in ("lo", "hi")]).agg(F.array_sort(F.collect_set("tile")).alias("tiles"))
