"""Point files of registration programs: binary (a flag, a count, doubles) and text, and the text that a transform program reports.

Binary files are read by byte ranges; each task writes files of at most ``rows`` points that are complete by themselves, so a
folder of them is read like one file. Text goes through Spark's own reader.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.sliced import _place, names, open_file

AXES = ("x", "y", "z")
SCHEMA = "path string, pos bigint, x double, y double, z double"
TASK_POINTS = 1 << 20
FLAGS = {True: "index", False: "point"}


def write_points(points: DataFrame, folder: str, indices: bool = False, binary: bool = True, rows: int = TASK_POINTS) -> DataFrame:
    """path, n_points of the written files: the points in order of their partitions. Rows with a null coordinate are an error, since the format has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        from pyspark import TaskContext

        task, k, held, n = TaskContext.get().partitionId(), 0, [], 0

        def flush() -> pa.RecordBatch:
            p = np.concatenate(held)
            path = f"{folder}/part-{task:05d}-{k:05d}.{'bin' if binary else 'txt'}"
            system, place = _place(path)
            system.create_dir(place.rsplit("/", 1)[0], recursive=True)
            part = f"{place}.{uuid.uuid4().hex}.part"
            with system.open_output_stream(part) as out:
                if binary:
                    out.write(struct.pack("<qq", indices, len(p)) + p.astype("<f8").tobytes())
                else:
                    out.write("\n".join([FLAGS[indices], str(len(p)), *(" ".join(repr(v) for v in r) for r in p.tolist())]).encode() + b"\n")
            system.move(part, place)
            return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([len(p)], pa.int64())], ["path", "n_points"])

        for b in batches:
            if any(c.null_count for c in b.columns):
                raise ValueError("a point without a coordinate")
            p = np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns], axis=1)
            while len(p):
                take = p[: rows - n]
                held.append(take)
                n += len(take)
                p = p[len(take) :]
                if n == rows:
                    yield flush()
                    k, held, n = k + 1, [], 0
        if n:
            yield flush()

    from tessera.plans.scratch import Scratch

    written = points.select(*[F.col(a).cast("double") for a in AXES]).mapInArrow(run, "path string, n_points bigint")
    return Scratch(points.sparkSession, "points").save(written, "files")


def read_points(spark: SparkSession, path: str, task_points: int = TASK_POINTS) -> DataFrame:
    """path, pos (place in its file), x, y, z of binary files. The driver reads 16 bytes of each file; tasks read ranges."""
    ranges = []
    for name in names(spark, path):
        with open_file(name) as f:
            head = f.read_at(16, 0)
            _, n = struct.unpack("<qq", head)
            if f.size() != 16 + 24 * n:
                raise ValueError(f"{name}: {f.size()} bytes for {n} points")
        ranges += [(name, at, min(task_points, n - at)) for at in range(0, n, task_points)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, at, n in zip(*(c.to_pylist() for c in b.columns)):
                with open_file(name) as f:
                    p = np.frombuffer(f.read_at(24 * n, 16 + 24 * at), "<f8").reshape(n, 3)
                yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(name), n), pa.array(np.arange(at, at + n)), *(pa.array(np.ascontiguousarray(p[:, a])) for a in range(3))], ["path", "pos", *AXES])

    plan = spark.createDataFrame(ranges, "path string, at bigint, n bigint")
    return plan.repartition(max(1, min(len(ranges), 10_000)), "path", "at").mapInArrow(run, SCHEMA)


def are_indices(path: str) -> bool:
    """Whether a file's points are voxel indices: the flag of a binary or text file."""
    with open_file(path) as f:
        head = f.read(8)
    return head.startswith(b"index") if head[:5] in (b"index", b"point") else struct.unpack("<q", head)[0] != 0


_NUMBER = r"(-?[\d.]+(?:[eE][-+]?\d+)?)"


def read_text_points(spark: SparkSession, path: str) -> DataFrame:
    """path, x, y, z of text files: two lines of head, then a point a line. Lines of three numbers are points, so the head needs no order."""
    line = rf"^\s*{_NUMBER}\s+{_NUMBER}\s+{_NUMBER}\s*$"
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), "value").filter(F.col("value").rlike(line))
    return rows.select("path", *[F.regexp_extract("value", line, i + 1).cast("double").alias(a) for i, a in enumerate(AXES)])


def read_reported_points(spark: SparkSession, path: str, what: str = "OutputPoint") -> DataFrame:
    """point, x, y, z of a transform program's report, whose lines hold fields ``name = [ x y z ]``: InputIndex, InputPoint, OutputIndexFixed, OutputPoint, Deformation."""
    place = rf"\b{what}\s*=\s*\[\s*{_NUMBER}\s+{_NUMBER}\s+{_NUMBER}\s*\]"
    rows = spark.read.text(path).filter(F.col("value").rlike(place))
    return rows.select(F.regexp_extract("value", r"^Point\s+(\d+)", 1).cast("long").alias("point"), *[F.regexp_extract("value", place, i + 1).cast("double").alias(a) for i, a in enumerate(AXES)])
