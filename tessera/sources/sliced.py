"""Slices of volume files, read by byte ranges: a Spark data source for npy and tif.

A file is planned from its header: which bytes hold the planes and rows of the wanted box. Each task gets ranges of at most
``task_bytes`` and reads those only, so a slice costs its own bytes, and a file may be far larger than a task. Conditions on x, y and z that
Spark hands to the source narrow the box too (``spark.sql.python.filterPushdown.enabled``).

npy: any order of axes, little or big endian. tif: grey pages, uncompressed (rows are ranges) or deflate (whole strips are read).
Axes are x, y, z as in ``volumes``. Files are opened by pyarrow's file systems (local, and stores with a URI of their own); names are
listed through Hadoop's. ``write_volumes`` writes from the tasks in the same way.
"""

from __future__ import annotations

import ast
import json
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

AXES = ("x", "y", "z")
TASK_BYTES = 64 << 20
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
SCHEMA = "path string, x int, y int, z int, v double"
Box = list[list[int]]


def _place(path: str) -> tuple[fs.FileSystem, str]:
    if "://" not in path:
        return fs.LocalFileSystem(), path.removeprefix("file:")
    return fs.FileSystem.from_uri(path)


def open_file(path: str) -> pa.NativeFile:
    system, name = _place(path)
    return system.open_input_file(name)


@dataclass
class Header:
    """shape (x, y, z), element type, and where data lies: npy from ``first`` on in C or F order; tif pages by their strips."""

    shape: tuple[int, ...]
    dtype: np.dtype
    first: int = 0
    fortran: bool = False
    pages: list[dict] = field(default_factory=list)


def npy_header(f: pa.NativeFile) -> Header:
    start = f.read_at(12, 0)
    if start[:6] != b"\x93NUMPY":
        raise ValueError("no npy file")
    size, first = (struct.unpack("<H", start[8:10])[0], 10) if start[6] == 1 else (struct.unpack("<I", start[8:12])[0], 12)
    facts = ast.literal_eval(f.read_at(size, first).decode("latin1"))
    if len(facts["shape"]) > 3:
        raise ValueError(f"{len(facts['shape'])} dimensions; three at most")
    return Header(tuple(facts["shape"]) + (1,) * (3 - len(facts["shape"])), np.dtype(facts["descr"]), first + size, facts["fortran_order"])


def tif_header(f: pa.NativeFile) -> Header:
    """Directories are followed from page to page; no pixel is read."""
    head = f.read_at(16, 0)
    end = {b"II": "<", b"MM": ">"}[head[:2]]
    big = struct.unpack(end + "H", head[2:4])[0] == 43
    at = struct.unpack(end + ("Q" if big else "I"), head[8:16] if big else head[4:8])[0]
    count, entry, offset = ("Q", 20, "Q") if big else ("H", 12, "I")
    sizes = {1: 1, 2: 1, 3: 2, 4: 4, 16: 8}
    letters = {1: "B", 3: "H", 4: "I", 16: "Q"}
    pages, kind = [], None
    while at:
        head_size = struct.calcsize(count)
        n = struct.unpack(end + count, f.read_at(head_size, at))[0]
        body = f.read_at(n * entry + struct.calcsize(offset), at + head_size)
        tags: dict[int, tuple[int, ...]] = {}
        for i in range(n):
            tag, what, m = struct.unpack_from(end + "HH" + offset, body, i * entry)
            if what in letters:
                size = m * sizes[what]
                place = i * entry + struct.calcsize(end + "HH" + offset)
                inline = struct.calcsize(offset)
                raw = body[place : place + size] if size <= inline else f.read_at(size, struct.unpack_from(end + offset, body, place)[0])
                tags[tag] = struct.unpack(f"{end}{m}{letters[what]}", raw)
        width, height, bits, form = tags[256][0], tags[257][0], tags.get(258, (8,))[0], tags.get(339, (1,))[0]
        if tags.get(277, (1,))[0] != 1 or tags.get(317, (1,))[0] != 1:
            raise ValueError("only grey pages without a predictor")
        if tags.get(259, (1,))[0] not in (1, 8, 32946):
            raise ValueError("only uncompressed and deflate pages")
        own = np.dtype(f"{end}{ {1: 'u', 2: 'i', 3: 'f'}[form] }{bits // 8}")
        if kind is not None and (own, width, height) != kind:
            raise ValueError("pages of different kinds")
        kind = (own, width, height)
        pages.append({"rows": min(tags.get(278, (height,))[0], height), "packed": tags.get(259, (1,))[0] != 1, "offsets": list(tags[273]), "counts": list(tags[279])})
        at = struct.unpack_from(end + offset, body, n * entry)[0]
    if kind is None:
        raise ValueError("no page")
    return Header((kind[1], kind[2], len(pages)), kind[0], pages=pages)


def header(path: str, fmt: str | None = None) -> Header:
    fmt = fmt or path.rsplit(".", 1)[-1].lower()
    readers = {"npy": npy_header, "tif": tif_header, "tiff": tif_header}
    if fmt not in readers:
        raise ValueError(f"no ranges for {fmt} files")
    with open_file(path) as f:
        return readers[fmt](f)


@dataclass
class Piece(InputPartition):
    """Byte ranges (first byte, bytes, packed, first index of the slowest and of the middle axis, rows) of one task."""

    path: str
    dtype: str
    order: tuple[int, int, int]  # axes from the slowest to the fastest
    fast: int
    box: Box
    ranges: list[tuple[int, int, bool, int, int, int]]

    def bytes(self) -> int:
        return sum(r[1] for r in self.ranges)


def pieces(path: str, h: Header, box: Box, task_bytes: int = TASK_BYTES) -> Iterator[Piece]:
    """The tasks of one file. ``box``: half-open [low, high) for x, y, z."""
    box = [[max(0, lo), min(n, hi)] for (lo, hi), n in zip(box, h.shape)]
    if any(lo >= hi for lo, hi in box):
        return
    order = (2, 1, 0) if h.fortran or h.pages else (0, 1, 2)
    slow, middle, fast = order
    row = h.shape[fast] * h.dtype.itemsize
    held: list[tuple[int, int, bool, int, int, int]] = []
    size = 0
    for i in range(*box[slow]):
        for r in _page_ranges(h, i, box[middle], row) if h.pages else _plane_ranges(h, i, box[middle], row, h.shape[middle], task_bytes):
            if held and size + r[1] > task_bytes:
                yield Piece(path, h.dtype.str, order, h.shape[fast], box, held)
                held, size = [], 0
            held.append(r)
            size += r[1]
    if held:
        yield Piece(path, h.dtype.str, order, h.shape[fast], box, held)


def _plane_ranges(h: Header, i: int, rows: list[int], row: int, height: int, task_bytes: int) -> Iterator[tuple[int, int, bool, int, int, int]]:
    step = max(1, task_bytes // max(1, row))
    for j in range(rows[0], rows[1], step):
        n = min(step, rows[1] - j)
        yield h.first + (i * height + j) * row, n * row, False, i, j, n


def _page_ranges(h: Header, i: int, rows: list[int], row: int) -> Iterator[tuple[int, int, bool, int, int, int]]:
    page = h.pages[i]
    for k, (at, n) in enumerate(zip(page["offsets"], page["counts"])):
        first = k * page["rows"]
        last = min(first + page["rows"], h.shape[1])
        lo, hi = max(first, rows[0]), min(last, rows[1])
        if lo >= hi:
            continue
        if page["packed"]:
            yield at, n, True, i, first, last - first
        else:
            yield at + (lo - first) * row, (hi - lo) * row, False, i, lo, hi - lo


def _batches(p: Piece) -> Iterator[pa.RecordBatch]:
    slow, middle, fast = p.order
    with open_file(p.path) as f:
        for at, n, packed, i, j, rows in p.ranges:
            raw = f.read_at(n, at)
            raw = zlib.decompress(raw) if packed else raw
            plane = np.frombuffer(raw, p.dtype, rows * p.fast).reshape(rows, p.fast)
            lo, hi = max(j, p.box[middle][0]), min(j + rows, p.box[middle][1])
            part = plane[lo - j : hi - j, p.box[fast][0] : p.box[fast][1]]
            m, k = np.indices(part.shape)
            place = {slow: np.full(part.size, i, np.int32), middle: (m.ravel() + lo).astype(np.int32), fast: (k.ravel() + p.box[fast][0]).astype(np.int32)}
            yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(p.path), part.size), *[pa.array(place[a]) for a in range(3)], pa.array(part.ravel().astype(float))], ["path", *AXES, "v"])


class SlicedReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.paths = json.loads(options["paths"])
        self.fmt = options.get("format")
        self.task_bytes = int(options.get("taskBytes", TASK_BYTES))
        big = 1 << 62
        self.box: Box = json.loads(options["box"]) if "box" in options else [[0, big] for _ in AXES]

    def partitions(self) -> list[Piece]:
        return [p for path in self.paths for p in pieces(path, header(path, self.fmt), self.box, self.task_bytes)] or [Piece("", "u1", (0, 1, 2), 0, self.box, [])]

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        if partition.ranges:
            yield from _batches(partition)


class NarrowedReader(SlicedReader):
    """The same for sessions that hand conditions to sources."""

    def pushFilters(self, filters: list[Filter]):
        """Conditions on coordinates become the box; the others go back to Spark."""
        for f in filters:
            name = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            known = name in AXES and (isinstance(f, In) and f.value and all(isinstance(v, int) for v in f.value) or isinstance(getattr(f, "value", None), int))
            if not known:
                yield f
                continue
            b = self.box[AXES.index(name)]
            if isinstance(f, EqualTo):
                b[:] = [max(b[0], f.value), min(b[1], f.value + 1)]
            elif isinstance(f, GreaterThan):
                b[0] = max(b[0], f.value + 1)
            elif isinstance(f, GreaterThanOrEqual):
                b[0] = max(b[0], f.value)
            elif isinstance(f, LessThan):
                b[1] = min(b[1], f.value)
            elif isinstance(f, LessThanOrEqual):
                b[1] = min(b[1], f.value + 1)
            else:
                if isinstance(f, In):  # the span of the values; Spark picks among them
                    b[:] = [max(b[0], min(f.value)), min(b[1], max(f.value) + 1)]
                yield f


class SlicedVolumes(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sliced_volumes"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> SlicedReader:
        options = {k: self.options[k] for k in ("paths", "box", "format", "taskBytes", "narrow") if k in self.options}
        return (NarrowedReader if options.get("narrow") == "true" else SlicedReader)(options)


def names(spark: SparkSession, path: str) -> list[str]:
    """Files that a path or glob names, through Hadoop's file system."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = p.getFileSystem(spark._jsc.hadoopConfiguration())
    found = system.globStatus(p)
    out = []
    for s in found or []:
        name = s.getPath().toString()
        out.append(name.replace("file:/", "file:///", 1) if name.startswith("file:/") and not name.startswith("file://") else name)
    if not out:
        raise FileNotFoundError(path)
    return sorted(out)


def read_slices(spark: SparkSession, path: str, bounds: dict[str, tuple[int, int]] | None = None, fmt: str | None = None, task_bytes: int = TASK_BYTES) -> DataFrame:
    """path, x, y, z, v of the voxels in the half-open ``bounds`` (x, y, z: (low, high)); other conditions on x, y, z narrow it further."""
    spark.dataSource.register(SlicedVolumes)
    read = spark.read.format("sliced_volumes").option("paths", json.dumps(names(spark, path))).option("taskBytes", str(task_bytes))
    read = read.option("narrow", str(spark.conf.get(PUSHDOWN, "false")).lower())
    if bounds:
        read = read.option("box", json.dumps([list(bounds.get(a, (0, 1 << 62))) for a in AXES]))
    return (read.option("format", fmt) if fmt else read).load()


def plan(spark: SparkSession, path: str, bounds: dict[str, tuple[int, int]] | None = None, fmt: str | None = None, task_bytes: int = TASK_BYTES) -> list[tuple[str, int, int]]:
    """(path, ranges, bytes) of every task that reading these bounds takes."""
    box = [list((bounds or {}).get(a, (0, 1 << 62))) for a in AXES]
    return [(p.path, len(p.ranges), p.bytes()) for name in names(spark, path) for p in pieces(name, header(name, fmt), box, task_bytes)]


def headers(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    """path, shape, dtype of files, read from their headers by the tasks."""
    return headers_of(spark.createDataFrame([(n,) for n in names(spark, path)], "path string"), fmt)


def headers_of(files: DataFrame, fmt: str | None = None) -> DataFrame:
    """The same of the files named by a column ``path``; nothing is listed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [header(p, fmt) for p in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([list(h.shape) for h in found], pa.list_(pa.int32())), pa.array([h.dtype.newbyteorder("=").name for h in found], pa.string())], ["path", "shape", "dtype"])

    return files.select("path").mapInArrow(run, "path string, shape array<int>, dtype string")


def write_volumes(files: DataFrame, folder: str, name: Column) -> DataFrame:
    """path, n_bytes of every written file. ``files``: content (and what ``name`` needs). Tasks write; each file gets its name when it is complete, so a
    task that runs again leaves the same files. The result is a table of its own: reading it again writes nothing."""
    from tessera.plans.scratch import Scratch

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        made: set[str] = set()
        for b in batches:
            paths, sizes = [], []
            for n, content in zip(b.column(0).to_pylist(), b.column(1)):
                path = f"{folder}/{n}"
                system, place = _place(path)
                part = f"{place}.{uuid.uuid4().hex}.part"
                if (parent := place.rsplit("/", 1)[0]) not in made:
                    system.create_dir(parent, recursive=True)
                    made.add(parent)
                with system.open_output_stream(part) as out:
                    out.write(content.as_buffer())
                system.move(part, place)
                paths.append(path)
                sizes.append(len(content.as_buffer()))
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(sizes, pa.int64())], ["path", "n_bytes"])

    rows = files.select(name.alias("name"), "content").mapInArrow(run, "path string, n_bytes bigint")
    return Scratch(files.sparkSession, "written").save(rows, "files")
