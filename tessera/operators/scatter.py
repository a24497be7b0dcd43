"""Scatter of points into voxels, measures around points, block sums and projections.

Scatter and measure joins use an explicit table of offsets: a point
meets each offset once and the sum over equal voxels is pre-aggregated before the
shuffle. Offsets come from a radius, so their number is bounded by the parameters, not by
the data.
"""

from __future__ import annotations

from itertools import product
from math import ceil, sqrt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

AXES = ("x", "y", "z")


def sphere_offsets(spark: SparkSession, radius: tuple[float, float, float]) -> DataFrame:
    """dx, dy, dz, dist (normalised), rank of the ellipsoid sum((d / r)^2) <= 1, by distance then position."""
    rows = []
    for d in product(*[range(-ceil(r), ceil(r) + 1) for r in radius]):
        s = sum((a / r) ** 2 if r > 0 else (0.0 if a == 0 else 2.0) for a, r in zip(d, radius))
        if s <= 1:
            rows.append((sqrt(s), *d))
    rows.sort()
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "rank int, dist double, dx int, dy int, dz int")


def box_offsets(spark: SparkSession, radius: tuple[int, int, int]) -> DataFrame:
    rows = sorted((sqrt(sum(a * a for a in d)), *d) for d in product(*[range(-r, r + 1) for r in radius]))
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "rank int, dist double, dx int, dy int, dz int")


def _inside(shape: tuple[int, int, int]) -> Column:
    return (F.col("x") >= 0) & (F.col("x") < shape[0]) & (F.col("y") >= 0) & (F.col("y") < shape[1]) & (F.col("z") >= 0) & (F.col("z") < shape[2])


def devolve(points: DataFrame, shape: tuple[int, int, int], offsets: DataFrame | None = None, weights: str | None = None, kernel: str | None = None) -> DataFrame:
    """x, y, z, v: sum over points and offsets of 1, the point's weight, the offset's kernel value, or their product. Coordinates are truncated; voxels outside ``shape`` are dropped."""
    at = points.select(*[F.col(a).cast("int").alias(f"p{a}") for a in AXES], (F.col(weights) if weights else F.lit(1)).alias("w"))
    if offsets is None:
        at = at.select(*[F.col(f"p{a}").alias(a) for a in AXES], "w", F.lit(1).alias("k"))
    else:
        o = F.broadcast(offsets.select("dx", "dy", "dz", (F.col(kernel) if kernel else F.lit(1)).alias("k")))
        at = at.crossJoin(o).select(*[(F.col(f"p{a}") + F.col(f"d{a}")).alias(a) for a in AXES], "w", "k")
    return at.filter(_inside(shape)).groupBy(*AXES).agg(F.sum(F.col("w") * F.col("k")).alias("v"))


def average(points: DataFrame, shape: tuple[int, int, int], weights: str, offsets: DataFrame | None = None) -> DataFrame:
    """x, y, z, v (mean weight), n."""
    at = points.select(*[F.col(a).cast("int").alias(f"p{a}") for a in AXES], F.col(weights).alias("w"))
    if offsets is None:
        at = at.select(*[F.col(f"p{a}").alias(a) for a in AXES], "w")
    else:
        at = at.crossJoin(F.broadcast(offsets.select("dx", "dy", "dz"))).select(*[(F.col(f"p{a}") + F.col(f"d{a}")).alias(a) for a in AXES], "w")
    return at.filter(_inside(shape)).groupBy(*AXES).agg(F.avg("w").alias("v"), F.count("*").alias("n"))


def voxelize(points: DataFrame, shape: tuple[int, int, int], method: str = "sphere", radius: tuple = (1, 1, 1), weights: str | None = None) -> DataFrame:
    """devolve over a sphere, a rectangle or the single voxel (pixel) around each point."""
    spark = points.sparkSession
    offsets = {"sphere": sphere_offsets, "rectangle": box_offsets}.get(method)
    if offsets is None and method != "pixel":
        raise ValueError(f"unknown method {method}")
    return devolve(points, shape, offsets(spark, radius) if offsets else None, weights)


_MEASURES = {"max": F.max, "min": F.min, "mean": F.avg, "sum": F.sum}


def measure_expression(points: DataFrame, vox: DataFrame, method: str = "max", radius: str = "radius", max_radius: int = 3) -> DataFrame:
    """point_id, v: max, min, mean or sum of the voxels within each point's own radius (inclusive; the centre always counts).

    vox may have a vol_id; points then have one too and only meet their own volume.
    """
    offsets = F.broadcast(sphere_offsets(points.sparkSession, (max_radius,) * 3).select("dx", "dy", "dz", (F.col("dist") * max_radius).alias("d")))
    keys = ["vol_id"] if "vol_id" in vox.columns else []
    near = points.select("point_id", *keys, *[F.col(a).cast("int").alias(f"p{a}") for a in AXES], F.col(radius).alias("r")).join(offsets, F.col("d") <= F.greatest("r", F.lit(0.0)) + 1e-9)
    near = near.select("point_id", *keys, *[(F.col(f"p{a}") + F.col(f"d{a}")).alias(a) for a in AXES])
    return near.join(vox, [*keys, *AXES]).groupBy("point_id").agg(_MEASURES[method]("v").alias("v"))


def measure_list(points: DataFrame, vox: DataFrame, offsets: DataFrame, method: str = "max", count: str = "count") -> DataFrame:
    """point_id, v: max, min, mean or sum of the voxels at the first ``count`` (a column of points) of the offsets (dx, dy, dz, rank from 0) around each point; null where none is stored.

    Offsets are a table whose size comes from parameters; it is broadcast.
    """
    keys = ["vol_id"] if "vol_id" in vox.columns else []
    at = points.select("point_id", *keys, *[F.col(a).cast("int").alias(f"p{a}") for a in AXES], F.col(count).alias("_k"))
    near = at.join(F.broadcast(offsets.select("dx", "dy", "dz", "rank")), F.col("rank") < F.col("_k"))
    near = near.select("point_id", *keys, *[(F.col(f"p{a}") + F.col(f"d{a}")).alias(a) for a in AXES])
    found = near.join(vox, [*keys, *AXES]).groupBy("point_id").agg(_MEASURES[method]("v").alias("v"))
    return points.select("point_id").join(found, "point_id", "left")


def measure_radius(points: DataFrame, vox: DataFrame, offsets: DataFrame, value: Column | None = None, fraction: float | None = None, default: float | None = None) -> DataFrame:
    """point_id, radius: distance of the first offset (by rank) whose voxel is at most ``value`` (a column of points), or ``fraction`` of the centre; ``default`` if there is none."""
    keys = ["vol_id"] if "vol_id" in vox.columns else []
    at = points.select("point_id", *keys, *[F.col(a).cast("int").alias(a) for a in AXES], *([value.alias("bar")] if value is not None else []))
    if value is None:
        at = at.join(vox, [*keys, *AXES], "left").withColumn("bar", F.col("v") * fraction).drop("v")
    near = at.crossJoin(F.broadcast(offsets)).select("point_id", *keys, "bar", "rank", "dist", *[(F.col(a) + F.col(f"d{a}")).alias(a) for a in AXES])
    first = near.join(vox, [*keys, *AXES]).filter(F.col("v") <= F.col("bar")).groupBy("point_id").agg(F.min_by("dist", "rank").alias("radius"))
    return at.select("point_id").join(first, "point_id", "left").withColumn("radius", F.coalesce("radius", F.lit(default)))


def block_sums(vox: DataFrame, size: int) -> DataFrame:
    """vol_id, block (along z), n: voxels with v > 0 per block."""
    return vox.groupBy("vol_id", F.floor(F.col("z") / size).cast("int").alias("block")).agg(F.count_if(F.col("v") > 0).alias("n"))


def projection(vox: DataFrame, axis: str = "z", function=F.max) -> DataFrame:
    """The volume reduced along an axis by an aggregate function."""
    return vox.groupBy("vol_id", *[a for a in AXES if a != axis]).agg(function("v").alias("v"))


def measure_labels(vox: DataFrame, labels: DataFrame, method: str = "sum") -> DataFrame:
    """vol_id, label, size, v: voxels and sum / max / min / mean of intensity per label."""
    return vox.join(labels.select("vol_id", *AXES, "label"), ["vol_id", *AXES]).groupBy("vol_id", "label").agg(F.count("*").alias("size"), _MEASURES[method]("v").alias("v"))
