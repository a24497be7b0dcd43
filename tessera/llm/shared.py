"""What the corpus operators share: table access, and joins whose small side is checked."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.plans.scratch import Scratch

__all__ = ["BROADCAST_KEYS", "Scratch", "arrow_rows", "join_hot", "plain", "semi_by_key", "table"]

#: Largest number of 8-byte keys that is sent to every executor; more keys are joined by a shuffle.
BROADCAST_KEYS = 1_000_000
#: A key is hot if it has more than one in so many of all rows; so there are at most so many hot keys.
HOT_SHARE = 4_096


@contextmanager
def arrow_rows(spark: SparkSession, most: int) -> Iterator[None]:
    """Arrow batches of at most so many rows for what is run inside: a task then holds few whole texts at a time."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    own = int(before)
    spark.conf.set(name, str(most if own <= 0 else min(own, most)))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def semi_by_key(df: DataFrame, keys: DataFrame, key: str, count: int) -> DataFrame:
    """Rows of ``df`` whose key is among ``keys`` (``count`` distinct rows): broadcast up to a checked size, else shuffled."""
    if count <= BROADCAST_KEYS:
        return df.join(F.broadcast(keys), key, "left_semi")
    return df.join(keys.hint("shuffle_hash"), key, "left_semi")


def join_hot(rows: DataFrame, facts: DataFrame, key: str, scratch: Scratch, name: str) -> DataFrame:
    """``rows`` (a written table) left-joined to ``facts`` (one narrow row for each key), whatever share of the rows one key has.

    Keys with more than 1 / ``HOT_SHARE`` of the rows are at most ``HOT_SHARE`` many by that definition: their facts
    are broadcast and their rows stay where they are. The other rows are shuffled.
    """
    total = rows.count()
    hot = scratch.save(rows.groupBy(key).count().filter(F.col("count") * HOT_SHARE > total).filter(F.col(key).isNotNull()).select(key, F.lit(True).alias("_hot")), name)
    marked = rows.join(F.broadcast(hot), key, "left")
    few = facts.join(F.broadcast(hot.select(key)), key, "left_semi")
    near = marked.filter("_hot").drop("_hot").join(F.broadcast(few), key, "left")
    far = marked.filter("_hot is null").drop("_hot").join(facts, key, "left")
    return near.unionByName(far)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def plain(df: DataFrame, *columns: str) -> DataFrame:
    """The named columns only, so that others cannot clash with what an operator adds."""
    return df.select(*[F.col(f"`{c}`") for c in columns])
