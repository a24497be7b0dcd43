"""Cell tables and region statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIDES = {0: "LH", 255: "RH"}


def side(hemisphere: Column) -> Column:
    """LH for 0, RH for 255, else null."""
    out = F.lit(None).cast("string")
    for k, v in SIDES.items():
        out = F.when(hemisphere == k, v).otherwise(out)
    return out


def count_cells(cells: DataFrame) -> DataFrame:
    """id, hemisphere, counts: cells with a name per region and side; cells on neither side are not counted."""
    return cells.withColumn("hemisphere", side(F.col("hemisphere"))).filter("hemisphere is not null and id is not null").groupBy("id", "hemisphere").agg(F.count("name").alias("counts"))


def group_counts(counts: DataFrame, samples: list[str]) -> DataFrame:
    """id, hemisphere and one count column per sample, 0 where a sample has none. ``counts``: sample, id, hemisphere, counts."""
    return counts.groupBy("id", "hemisphere").agg(*[F.coalesce(F.sum(F.when(F.col("sample") == s, F.col("counts"))), F.lit(0)).alias(f"counts_{s}") for s in samples])


def collapse_structures(counts: DataFrame, mapping: DataFrame, hemispheres: bool = False) -> DataFrame:
    """Counts summed by the mapped id (child, parent); unmapped ids stay. ``hemispheres``: sum both sides."""
    values = [c for c in counts.columns if c not in ("id", "hemisphere")]
    m = mapping.select(F.col("child").alias("id"), F.col("parent").alias("_p"))
    out = counts.join(m, "id", "left").withColumn("id", F.coalesce("_p", "id")).drop("_p")
    return out.groupBy("id", *([] if hemispheres else ["hemisphere"])).agg(*[F.sum(c).alias(c) for c in values])


def normalize(df: DataFrame, by: DataFrame, columns: list[str]) -> DataFrame:
    """Each column in percent of the other frame's column total (one row, broadcast)."""
    totals = by.agg(*[F.sum(c).alias(f"_t_{c}") for c in columns])
    out = df.crossJoin(F.broadcast(totals))
    return out.withColumns({c: F.col(c) * 100 / F.col(f"_t_{c}") for c in columns}).drop(*[f"_t_{c}" for c in columns])


def region_statistics(cells: DataFrame, regions: DataFrame | None = None) -> DataFrame:
    """Per side and region: count of named cells and mean size. With ``regions`` (id, hemisphere, name, volume) every region has a row; counts of empty ones stay null."""
    stats = cells.groupBy("hemisphere", "id").agg(F.count("name").alias("counts"), F.avg("size").alias("mean_size"))
    return stats if regions is None else regions.join(stats, ["hemisphere", "id"], "left")


def group_scaffold(ids: DataFrame, sides: DataFrame, counts: DataFrame, volumes: DataFrame) -> DataFrame:
    """(ids x sides) with each sample's counts (missing: 0) and the volume; rows without a volume are dropped. ``sides`` has two rows."""
    values = [c for c in counts.columns if c not in ("id", "hemisphere")]
    return ids.crossJoin(F.broadcast(sides)).join(counts, ["id", "hemisphere"], "left").fillna(0, values).join(volumes, ["id", "hemisphere"])
