"""Binary property-graph files (.gt, version 1): read into vertex and edge tables, and written from them.

A file holds a head (magic, version, byte order, comment, directed or not, number of vertices), for each vertex the list of vertices its
edges go to, and named properties of the graph, the vertices and the edges, in vertex order or in the order of the lists. It has no index, and
lists, texts and vectors have lengths of their own. So one task runs through it once, in bounded memory, skipping what it need not
see, and notes where every ``chunk``-th vertex or edge begins in each section. Tasks then read chunks: one makes whole rows of
all properties, and nothing is joined or shuffled but the notes.

Writing sorts vertices and edges by range; tasks turn them to bytes, whose places follow from sums of lengths, and put
them there side by side. A vertex with very many edges is divided like all others. This needs a mounted file system, where several
tasks can write one file; a task that runs again writes the same bytes to the same place.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators.graph import Graph
from tessera.plans.scratch import Scratch
from tessera.sources.sliced import _place, open_file

#: Fixed values of the format: the first bytes, and the value types by their numbers.
MAGIC = "⛾ gt".encode()
VERSION = 1
TYPES = ["boolean", "short", "int", "bigint", "double", "long double", "string", "array<boolean>", "array<short>", "array<int>", "array<bigint>", "array<double>", "array<long double>", "array<string>", "binary"]
KEYS = ("graph", "vertex", "edge")

WIDTHS = ["u1", "i2", "i4", "i8", "f8"]
STRING, STRINGS, OBJECT, FIRST_VECTOR = 6, 13, 14, 7
CHUNK = 1 << 16
STEP = 4 << 20
NOTES = "key int, prop int, name string, kind int, first bigint, n bigint, offset bigint, vertex bigint, remaining bigint"


def element_type(kind: int, end: str) -> np.dtype:
    """The numbers of a type or of its vectors."""
    k = kind - FIRST_VECTOR if kind >= FIRST_VECTOR else kind
    return np.dtype(np.longdouble).newbyteorder(end) if k == 5 else np.dtype(end + WIDTHS[k])


def vertex_type(n: int, end: str) -> np.dtype:
    """The smallest unsigned numbers that hold the number of vertices."""
    return np.dtype(end + next(u for u, b in (("u1", 8), ("u2", 16), ("u4", 32), ("u8", 64)) if n < 1 << b))


def spark_type(kind: int) -> str:
    return TYPES[kind].replace("long double", "double")


def kind_of(spark_name: str) -> int:
    name = {"float": "double", "array<float>": "array<double>", "tinyint": "short", "smallint": "short", "array<smallint>": "array<short>"}.get(spark_name, spark_name)
    if name not in TYPES:
        raise ValueError(f"no value type for {spark_name}")
    return TYPES.index(name)


class _Stream:
    """A file from a place on, read in steps; what is skipped is not read."""

    def __init__(self, f: pa.NativeFile, at: int = 0) -> None:
        self.f, self.at, self.base, self.held = f, at, at, b""

    def take(self, n: int) -> bytes:
        lo = self.at - self.base
        if lo + n > len(self.held):
            self.base, lo, self.held = self.at, 0, self.f.read_at(max(n, STEP), self.at)
            if len(self.held) < n:
                raise ValueError("the file ends early")
        self.at += n
        return self.held[lo : lo + n]

    def number(self, end: str) -> int:
        return int.from_bytes(self.take(8), "little" if end == "<" else "big")

    def skip(self, n: int) -> None:
        self.at += n


@dataclass(frozen=True)
class Head:
    end: str
    comment: str
    directed: bool
    n_vertices: int
    first: int


def read_head(f: pa.NativeFile) -> Head:
    s = _Stream(f)
    start = s.take(8)
    if start[:6] != MAGIC or start[6] != VERSION or start[7] > 1:
        raise ValueError("no graph file of version 1")
    end = "<>"[start[7]]
    comment = s.take(s.number(end)).decode()
    directed = s.take(1)[0] != 0
    n = s.number(end)
    return Head(end, comment, directed, n, s.at)


def _pass_value(s: _Stream, kind: int, end: str) -> None:
    n = s.number(end)
    if kind == STRINGS:
        for _ in range(n):
            s.skip(s.number(end))
    else:
        s.skip(n if kind in (STRING, OBJECT) else n * element_type(kind, end).itemsize)


def _notes(path: str, chunk: int) -> Iterator[tuple]:
    with open_file(path) as f:
        h = read_head(f)
        s, width = _Stream(f, h.first), vertex_type(h.n_vertices, h.end).itemsize
        edges, begin, held = 0, 0, None
        for v in range(h.n_vertices):
            n = s.number(h.end)
            while begin < edges + n:
                if held:
                    yield held
                held = (2, -1, None, None, begin, chunk, s.at + (begin - edges) * width, v, edges + n - begin)
                begin += chunk
            edges += n
            s.skip(n * width)
        if held:
            yield (*held[:5], edges - held[4], *held[6:])
        counts = (1, h.n_vertices, edges)
        yield -1, -1, None, None, -1, edges, 0, 0, 0
        for p in range(s.number(h.end)):
            key = s.take(1)[0]
            name = s.take(s.number(h.end)).decode()
            kind = s.take(1)[0]
            if key > 2 or kind >= len(TYPES):
                raise ValueError(f"unknown property {name}: {key}, {kind}")
            yield key, p, name, kind, -1, 0, 0, 0, 0
            for first in range(0, counts[key], chunk):
                n = min(chunk, counts[key] - first)
                yield key, p, name, kind, first, n, s.at, 0, 0
                if kind < STRING:
                    s.skip(n * element_type(kind, h.end).itemsize)
                else:
                    for _ in range(n):
                        _pass_value(s, kind, h.end)
        if s.at != f.size():
            raise ValueError(f"{s.at} bytes announced, {f.size()} there")


def _decode(s: _Stream, kind: int, n: int, end: str) -> pa.Array:
    """n values of a type."""
    if kind < STRING:
        kept = element_type(kind, end)
        values = np.frombuffer(s.take(n * kept.itemsize), kept)
        return pa.array(values.astype(bool if kind == 0 else float if kind == 5 else kept.newbyteorder("=")))
    if kind in (STRING, OBJECT):
        values = [s.take(s.number(end)) for _ in range(n)]
        return pa.array(values, pa.binary()) if kind == OBJECT else pa.array([v.decode() for v in values], pa.string())
    if kind == STRINGS:
        return pa.array([[s.take(s.number(end)).decode() for _ in range(s.number(end))] for _ in range(n)], pa.list_(pa.string()))
    kept, lists, sizes = element_type(kind, end), [], []
    for _ in range(n):
        m = s.number(end)
        lists.append(s.take(m * kept.itemsize))
        sizes.append(m)
    flat = np.frombuffer(b"".join(lists), kept)
    flat = flat.astype(bool if kind == FIRST_VECTOR else float if kind == FIRST_VECTOR + 5 else kept.newbyteorder("="))
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(flat))


def _edges_of(s: _Stream, vertex: int, remaining: int, n: int, width: np.dtype, end: str) -> tuple[np.ndarray, np.ndarray]:
    sources, targets = [], []
    while n:
        m = min(remaining, n)
        if m:
            targets.append(np.frombuffer(s.take(m * width.itemsize), width).astype(np.int64))
            sources.append(np.full(m, vertex, np.int64))
            n -= m
        if n:
            vertex, remaining = vertex + 1, s.number(end)
    return np.concatenate(sources), np.concatenate(targets)


@dataclass
class GraphFile:
    """``graph``: vertices (vid and their properties) and edges (eid, src, dst and theirs), numbered as in the file. ``properties``: one row of the graph's own."""

    graph: Graph
    properties: DataFrame
    directed: bool
    comment: str
    n_vertices: int
    n_edges: int


def read_graph(spark: SparkSession, path: str, chunk: int = CHUNK) -> GraphFile:
    """The tables of a file. A property whose name is taken (vid, eid, src, dst, another's) gets its number as an ending. Long doubles become doubles; pickled objects
    stay bytes, and are never unpickled."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in NOTES.split(", ")]
        types = [pa.int32(), pa.int32(), pa.string(), pa.int32(), *[pa.int64()] * 5]
        give = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
        for b in batches:
            for name in b.column(0).to_pylist():
                rows = []
                for row in _notes(name, chunk):
                    rows.append(row)
                    if len(rows) == 4096:
                        yield give(rows)
                        rows = []
                yield give(rows)

    with open_file(path) as f:
        head = read_head(f)
    notes = Scratch(spark, "graph-file").save(spark.createDataFrame([(path,)], "path string").mapInArrow(scan, NOTES), "notes")
    declared = notes.filter("first = -1").orderBy("prop").collect()  # one row a property
    n_edges = next(r.n for r in declared if r.key == -1)

    def table(key: int, fixed: dict[str, str]) -> DataFrame:
        taken, columns = set(fixed), {}
        for r in declared:
            if r.key == key:
                name = r["name"] if r["name"] and r["name"].lower() not in taken else f"{r['name']}_{r.prop}"
                taken.add(name.lower())
                columns[r.prop] = (name, r.kind)
        names, end, width = [*fixed, *(n for n, _ in columns.values())], head.end, vertex_type(head.n_vertices, head.end)
        schema = ", ".join([*(f"{n} {t}" for n, t in fixed.items()), *(f"`{n}` {spark_type(k)}" for n, k in columns.values())])

        def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for first, n, parts in zip(*(c.to_pylist() for c in b.columns)):
                    out = {}
                    with open_file(path) as f:
                        for part in parts:
                            s = _Stream(f, part["offset"])
                            out[part["prop"]] = _edges_of(s, part["vertex"], part["remaining"], n, width, end) if part["prop"] < 0 else _decode(s, columns[part["prop"]][1], n, end)
                    own = [pa.array(np.arange(first, first + n)), *(pa.array(c) for c in out.get(-1, ()))]
                    yield pa.RecordBatch.from_arrays([*own[: len(fixed)], *(out[p] for p in columns)], names)

        parts = notes.filter((F.col("key") == key) & (F.col("first") >= 0)).groupBy("first", "n").agg(F.collect_list(F.struct("prop", "offset", "vertex", "remaining")).alias("parts"))
        total = (1, head.n_vertices, n_edges)[key]
        return parts.repartition(max(1, min(-(-total // chunk), 10_000)), "first").mapInArrow(parse, schema)

    with_vertices = any(r.key == 1 for r in declared)
    vertices = table(1, {"vid": "bigint"}) if with_vertices else spark.range(head.n_vertices).select(F.col("id").alias("vid"))
    return GraphFile(Graph(vertices, table(2, {"eid": "bigint", "src": "bigint", "dst": "bigint"})), table(0, {}) if any(r.key == 0 for r in declared) else spark.range(1).select(), head.directed, head.comment, head.n_vertices, n_edges)


def _text(b: bytes) -> bytes:
    return struct.pack("<Q", len(b)) + b


def _encode(values: pa.Array, kind: int) -> bytes:
    if values.null_count:
        raise ValueError("the format has no nulls: fill or drop them before")
    if kind < STRING:
        return values.to_numpy(zero_copy_only=False).astype(element_type(kind, "<")).tobytes()
    if kind in (STRING, OBJECT):
        return b"".join(_text(v.encode() if kind == STRING else v) for v in values.to_pylist())
    if kind == STRINGS:
        return b"".join(struct.pack("<Q", len(v)) + b"".join(_text(t.encode()) for t in v) for v in values.to_pylist())
    flat = values.flatten()
    if flat.null_count:
        raise ValueError("the format has no nulls: fill or drop them before")
    raw = flat.to_numpy(zero_copy_only=False).astype(element_type(kind, "<"))
    ends = np.cumsum(values.value_lengths().to_numpy(zero_copy_only=False)).tolist()
    return b"".join(struct.pack("<Q", e - b) + raw[b:e].tobytes() for b, e in zip([0, *ends], ends))


def _segments(rows: DataFrame, kinds: list[int], sections: list[int], listed: np.dtype | None) -> DataFrame:
    """section, task, seq, content of sorted rows, a batch at a time. ``listed``: rows are (kind, number, values); kind 0 is a list's length and kind 1 one of its vertices."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        for seq, b in enumerate(batches):
            columns, content = list(b.columns), []
            if listed is not None:
                entry, number = (c.to_numpy(zero_copy_only=False) for c in columns[:2])
                sizes = np.where(entry == 0, 8, listed.itemsize)
                at = np.cumsum(sizes) - sizes
                out = np.zeros(int(sizes.sum()), np.uint8)
                for what, kept in ((0, np.dtype("<u8")), (1, listed)):
                    here = entry == what
                    out[(at[here][:, None] + np.arange(kept.itemsize)).ravel()] = np.ascontiguousarray(number[here].astype(kept)).view(np.uint8)
                content.append(out.tobytes())
                columns = [c.filter(pa.array(entry == 1)) for c in columns[2:]]
            content += [_encode(c, k) for c, k in zip(columns, kinds)]
            yield pa.RecordBatch.from_arrays([pa.array(sections, pa.int32()), pa.array([task] * len(content), pa.int32()), pa.array([seq] * len(content), pa.int64()), pa.array(content, pa.large_binary()).cast(pa.binary())], ["section", "task", "seq", "content"])

    return rows.mapInArrow(run, "section int, task int, seq bigint, content binary")


def write_graph(graph: Graph, path: str, directed: bool = False, comment: str = "", properties: dict | None = None, ids: str | None = None) -> int:
    """Bytes of the written file. Vertices are numbered 0..n-1 in the order of vid (``ids``: a vertex property that keeps vid); edges are ordered by src, then by dst and by their values.
    All other columns become properties; columns that order nothing by themselves (maps) and nulls are errors. Edges whose ends are no vertices are dropped. ``properties``: the graph's own, by
    name: bool, int, float, str, bytes or lists of one of these."""
    if "://" in path and not path.startswith("file://"):
        raise ValueError("graph files are written to a mounted file system")
    system, place = _place(path)
    spark = graph.vertices.sparkSession
    scratch = Scratch(spark, "graph-write")
    kept = Graph(graph.vertices.withColumn(ids, F.col("vid")) if ids else graph.vertices, graph.edges.drop("eid")).renumbered()
    vertices, edges = scratch.save(kept.vertices, "vertices"), scratch.save(kept.edges, "edges")
    n = vertices.count()
    listed = vertex_type(n, "<")
    of_vertex, of_edge = ([c for c in df.columns if c not in own] for df, own in ((vertices, ("vid",)), (edges, ("src", "dst"))))
    kinds = [[kind_of(df.schema[c].dataType.simpleString()) for c in cs] for df, cs in ((vertices, of_vertex), (edges, of_edge))]
    values = {name: _own_value(v) for name, v in (properties or {}).items()}

    # sections: 0 the head, 1 the lists, 2 + 2p the name of property p, 3 + 2p its values
    glue = [(0, MAGIC + bytes([VERSION, 0]) + _text(comment.encode()) + bytes([directed]) + struct.pack("<Q", n))]
    named = [*((0, c, k) for c, (k, _) in values.items()), *((1, c, k) for c, k in zip(of_vertex, kinds[0])), *((2, c, k) for c, k in zip(of_edge, kinds[1]))]
    for p, (key, name, kind) in enumerate(named):
        glue.append((2 + 2 * p, (struct.pack("<Q", len(named)) if p == 0 else b"") + bytes([key]) + _text(name.encode()) + bytes([kind])))
    if not named:
        glue.append((2, struct.pack("<Q", 0)))
    glue += [(3 + 2 * p, raw) for p, (_, raw) in enumerate(values.values())]
    first = len(values)
    sections = [3 + 2 * (first + i) for i in range(len(named) - first)]

    degrees = edges.groupBy("src").agg(F.count("*").alias("_n"))
    lengths = vertices.select("vid").join(degrees, F.col("vid") == F.col("src"), "left").select(F.col("vid").alias("src"), F.lit(0).alias("_entry"), F.coalesce("_n", F.lit(0)).cast("long").alias("_number"))
    lists = edges.select("src", F.lit(1).alias("_entry"), F.col("dst").cast("long").alias("_number"), *of_edge)
    order = ["src", "_entry", "_number", *of_edge]
    tokens = lists.unionByName(lengths, allowMissingColumns=True).repartitionByRange(*order).sortWithinPartitions(*order).select("_entry", "_number", *of_edge)
    made = _segments(tokens, kinds[1], [1, *sections[len(of_vertex) :]], listed)
    if of_vertex:
        rows = vertices.repartitionByRange("vid").sortWithinPartitions("vid").select(*of_vertex)
        made = made.unionByName(_segments(rows, kinds[0], sections[: len(of_vertex)], None))
    fixed = spark.createDataFrame([(s, 0, 0, bytearray(b)) for s, b in glue], "section int, task int, seq bigint, content binary")
    made = scratch.save(made.unionByName(fixed).filter(F.length("content") > 0), "segments")

    # where each segment begins: sums of lengths within tasks, over the tasks of a section, over sections
    tasks = made.groupBy("section", "task").agg(F.sum(F.length("content").cast("long")).alias("_size"))  # sections x tasks rows
    begin = tasks.select("section", "task", (F.sum("_size").over(Window.orderBy("section", "task")) - F.col("_size")).alias("_begin"))
    sizes = made.select("section", "task", "seq", F.length("content").cast("long").alias("_len"))
    inner = sizes.select("section", "task", "seq", (F.sum("_len").over(Window.partitionBy("section", "task").orderBy("seq")) - F.col("_len")).alias("_inner"))
    placed = made.join(inner.join(begin, ["section", "task"]), ["section", "task", "seq"]).select((F.col("_begin") + F.col("_inner")).alias("at"), "content")
    total = tasks.agg(F.sum("_size")).first()[0]

    part = f"{place}.part"
    system.create_dir(place.rsplit("/", 1)[0], recursive=True)
    with open(part, "wb") as f:
        f.truncate(total)

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            with open(part, "r+b") as f:
                for at, content in zip(b.column(0).to_pylist(), b.column(1)):
                    f.seek(at)
                    f.write(content.as_buffer())
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], ["n"])

    placed.mapInArrow(put, "n bigint").agg(F.sum("n")).collect()
    system.move(part, place)
    scratch.drop("segments")
    return total


def _own_value(v) -> tuple[int, bytes]:
    of = lambda x: next(k for t, k in ((bool, "boolean"), (int, "bigint"), (float, "double"), (str, "string"), (bytes, "binary")) if isinstance(x, t))
    name = f"array<{of(v[0]) if v else 'double'}>" if isinstance(v, list) else of(v)
    kind = kind_of(name)
    return kind, _encode(pa.array([v], pa.list_(pa.float64()) if v == [] else None), kind)
