"""Reports that compare two groups of samples, from the samples' tables to colored p-values.

A sample is a folder with ``cells.parquet`` (id, hemisphere, name ...) and ``density.parquet`` (x, y, z, v). All samples of a
group are one table with a column ``sample``: nothing is looped over but the short list of folders.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import stats as T
from tessera.operators import cells as C

AXES = ("x", "y", "z")
#: Colors that p-value images are drawn in.
COLORS = {
    "red": (255, 0, 0),
    "green": (0, 255, 0),
    "blue": (0, 0, 255),
}


def read_group(spark: SparkSession, folders: list[str], name: str = "cells") -> DataFrame:
    """One table of all samples; ``sample`` is the folder's last part."""
    parts = [spark.read.parquet(f"{f.rstrip('/')}/{name}.parquet").withColumn("sample", F.lit(f.rstrip("/").rpartition("/")[2])) for f in folders]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def are_comparable(densities: DataFrame) -> bool:
    """Whether all samples (sample, x, y, z, v) have the same extent and number of voxels."""
    ext = densities.groupBy("sample").agg(F.count("*").alias("n"), *[f(a).alias(f"{n}{a}") for a in AXES for n, f in (("lo", F.min), ("hi", F.max))])
    return ext.drop("sample").distinct().limit(2).count() <= 1


def average_density(densities: DataFrame) -> DataFrame:
    """x, y, z, v: the mean over samples."""
    return densities.groupBy(*AXES).agg(F.avg("v").alias("v"))


def summary(first: DataFrame, second: DataFrame, names: tuple[str, str], volumes: DataFrame, p_cutoff: float | None = None) -> DataFrame:
    """id, hemisphere, volume, a count column of each sample, mean and deviation of both groups, p_value, q_value, p_sign.

    ``first``, ``second``: cells with sample, id, hemisphere (0 or 255), name. Every structure that any sample names has a row for each side with a volume; where a sample
    has no cell it counts 0; rows with a mean of 0 in a group are left out.
    """
    sides = F.explode(F.array(F.lit(0), F.lit(255)))
    ids = first.select("id").union(second.select("id")).filter("id is not null").distinct()
    rows = ids.select("id", sides.alias("hemisphere")).join(volumes.select("id", "hemisphere", "volume"), ["id", "hemisphere"])
    out, long = rows, None
    for g, (cells, name) in enumerate(zip((first, second), names)):
        cells = cells.withColumn("sample", F.col("sample").cast("string"))
        samples = sorted(r[0] for r in cells.select("sample").distinct().collect())  # one row for each sample of the group
        counts = cells.filter("hemisphere in (0, 255)").groupBy("sample", "id", "hemisphere").agg(F.count("*").alias("n"))
        wide = counts.groupBy("id", "hemisphere").pivot("sample", samples).agg(F.sum("n"))
        wide = rows.select("id", "hemisphere").join(wide, ["id", "hemisphere"], "left").fillna(0, samples).withColumnsRenamed({s: f"{name}_counts_{s}" for s in samples})
        values = [F.col(f"`{name}_counts_{s}`") for s in samples]
        mean = sum(values, F.lit(0)) / len(samples)
        spread = F.sqrt(sum(((v - mean) ** 2 for v in values), F.lit(0.0)) / F.lit(len(samples) - 1)) if len(samples) > 1 else F.lit(None).cast("double")
        out = out.join(wide.withColumns({f"mean_{name}": mean, f"sd_{name}": spread}), ["id", "hemisphere"])
        one = wide.select("id", "hemisphere", F.lit(g).alias("grp"), F.explode(F.array(*values)).alias("counts"))
        long = one if long is None else long.unionByName(one)
    out = out.filter((F.col(f"mean_{names[0]}") != 0) & (F.col(f"mean_{names[1]}") != 0))
    tests = T.t_test(long.join(out.select("id", "hemisphere"), ["id", "hemisphere"], "left_semi"), ["id", "hemisphere"], "grp", "counts", 0, 1, equal_var=True, signed=True, p_cutoff=p_cutoff)
    q = T.estimate_q_values(tests.select("id", "hemisphere", "p", "p_sign"))
    return out.join(q.select("id", "hemisphere", F.col("p").alias("p_value"), F.col("q").alias("q_value"), "p_sign"), ["id", "hemisphere"])


def density_p_values(first: DataFrame, second: DataFrame, p_cutoffs: tuple[float, float] = (0.05, 0.01), colors=(("red", "green"), ("green", "blue"))) -> DataFrame:
    """x, y, z, t, p, r, g, b: unequal-variance tests of two groups' densities voxel by voxel; undefined tests are t 0, p 1. The colors
    of every cutoff are (cutoff - p) times the sign's color, and channel by channel the largest of them."""
    both = first.withColumn("grp", F.lit(0)).unionByName(second.withColumn("grp", F.lit(1)))
    t = T.t_test(both, list(AXES), "grp", "v", 0, 1)
    bad = F.col("p").isNull() | F.isnan("p")
    t = t.select(*AXES, F.when(bad, 0.0).otherwise(F.col("t")).alias("t"), F.when(bad, 1.0).otherwise(F.col("p")).alias("p"))
    layers = []
    for cut, (plus, minus) in zip(p_cutoffs, colors):
        layers.append(T.color_p_values(F.col("p"), F.col("t"), cut, COLORS[plus], COLORS[minus]))
    return t.select("*", *[F.greatest(*[layer[i] for layer in layers]).alias(c) for i, c in enumerate("rgb")])
