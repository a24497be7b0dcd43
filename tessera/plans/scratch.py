"""Scratch tables in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Row group size that no task's output reaches.
WHOLE = 2_000_000_000


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a temporary folder only where it is unset and the master is local.

    On a cluster a folder of one machine would lose tables, so an unset folder is an error there.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = getattr(spark, "_tessera_dir", None)
        if not base:
            base = "file://" + tempfile.mkdtemp(prefix="tessera-")
            spark._tessera_dir = base
            spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder through Hadoop's file system, so any shared store works."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


class Scratch:
    """Written tables of one operator call.

    ``save`` cuts the lineage: the table is in the shared folder, so losing an
    executor costs a reread. Tables that the result still reads stay until the
    session ends; ``drop`` deletes the others early.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.path = f"{shared_dir(spark)}/tessera-{name}-{uuid.uuid4().hex}"
        atexit.register(self._end)

    def save(self, df: DataFrame, name: str, whole_files: bool = False, by: str | None = None) -> DataFrame:
        """``whole_files``: each file is one row group, so a later scan never divides what one task wrote; ``by``: a folder for each value of that column."""
        path = f"{self.path}/{name}"
        writer = df.write.option("parquet.block.size", WHOLE) if whole_files else df.write
        (writer.partitionBy(by) if by else writer).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            delete(self.spark, f"{self.path}/{name}")

    def _end(self) -> None:
        try:
            delete(self.spark, self.path)
        except Exception:  # the session has ended, and its context with it
            pass
