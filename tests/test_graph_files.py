"""Graph files: bytes made by hand, every value type, chunks of any size, hubs, round trips."""

import struct

import pytest

from tessera.operators.graph import Graph
from tessera.sources import graph_files as G


def _by_hand(end, lists, properties, directed=1, comment="made by hand", width="B"):
    """A file byte by byte: lists of targets, (key, name, kind, values as bytes)."""
    q = lambda n: struct.pack(end + "Q", n)
    out = "⛾ gt".encode() + bytes([1, int(end == ">")]) + q(len(comment)) + comment.encode() + bytes([directed]) + q(len(lists))
    for targets in lists:
        out += q(len(targets)) + struct.pack(f"{end}{len(targets)}{width}", *targets)
    out += q(len(properties))
    for key, name, kind, raw in properties:
        out += bytes([key]) + q(len(name.encode())) + name.encode() + bytes([kind]) + raw
    return out


@pytest.mark.parametrize("end", ["<", ">"])
@pytest.mark.parametrize("chunk", [1, 2, 3, 100])
def test_every_type_of_value(spark, tmp_path, end, chunk):
    q = lambda n: struct.pack(end + "Q", n)
    text = lambda t: q(len(t.encode())) + t.encode()
    v = lambda f, *xs: q(len(xs)) + struct.pack(f"{end}{len(xs)}{f}", *xs)
    lists = [[1, 2, 2], [], [0], [], [3, 0]]  # parallel edges, a loop, vertices without edges
    properties = [
        (0, "title", 6, text("graph é")), (0, "shape", 9, v("i", 4, 5, 6)),
        (1, "on", 0, bytes([1, 0, 1, 0, 1])), (1, "short", 1, struct.pack(end + "5h", -1, 2, 3, 4, 5)), (1, "name", 6, b"".join(map(text, ["a", "", "ccc", "ü", "e"]))),
        (1, "vid", 3, struct.pack(end + "5q", 1 << 40, 8, 7, 6, 5)), (1, "tags", 13, q(0) + (q(2) + text("x") + text("")) + q(0) + (q(1) + text("y")) + q(0)),
        (2, "length", 4, struct.pack(end + "6d", *[0.5 * i for i in range(6)])), (2, "n", 2, struct.pack(end + "6i", *range(6))),
        (2, "points", 11, b"".join(v("d", *[1.5] * i) for i in range(6))), (2, "flags", 7, b"".join(v("B", *[1, 0][: i % 3]) for i in range(6))),
        (2, "object", 14, b"".join(q(2) + bytes([i, 255]) for i in range(6))),
    ]
    path = tmp_path / "a.gt"
    path.write_bytes(_by_hand(end, lists, properties))
    g = G.read_graph(spark, str(path), chunk)
    assert (g.directed, g.comment, g.n_vertices, g.n_edges) == (True, "made by hand", 5, 6)
    assert g.properties.first().asDict() == {"title": "graph é", "shape": [4, 5, 6]}
    vertices = g.graph.vertices.orderBy("vid").collect()
    assert [tuple(r) for r in vertices] == list(zip(range(5), [True, False, True, False, True], [-1, 2, 3, 4, 5], ["a", "", "ccc", "ü", "e"], [1 << 40, 8, 7, 6, 5], [[], ["x", ""], [], ["y"], []]))
    assert g.graph.vertices.columns[4] == "vid_5"
    edges = g.graph.edges.orderBy("eid").collect()
    assert [(r.src, r.dst) for r in edges] == [(0, 1), (0, 2), (0, 2), (2, 0), (4, 3), (4, 0)]
    assert [(r.length, r.n, r.points, r.flags, bytes(r.object)) for r in edges] == [(0.5 * i, i, [1.5] * i, [True, False][: i % 3], bytes([i, 255])) for i in range(6)]


def test_no_graph_files(spark, tmp_path):
    good = _by_hand("<", [[0]], [(1, "n", 2, struct.pack("<i", 1))])
    for name, raw in (("short", good[:-1]), ("long", good + b"x")):
        (tmp_path / name).write_bytes(raw)
        with pytest.raises(Exception, match="bytes announced|ends early"):
            G.read_graph(spark, str(tmp_path / name))
    for name, raw in (("other", b"GIF89a" + good), ("version", good[:6] + b"\x02" + good[7:])):
        (tmp_path / name).write_bytes(raw)
        with pytest.raises(ValueError, match="no graph file"):
            G.read_graph(spark, str(tmp_path / name))


def test_number_of_vertices_decides_the_width(spark, tmp_path):
    for n, width in ((255, "B"), (256, "H"), (70_000, "I")):
        path = tmp_path / f"{n}.gt"
        path.write_bytes(_by_hand("<", [[n - 1]] + [[]] * (n - 1), [], width=width))
        g = G.read_graph(spark, str(path))
        assert g.graph.vertices.count() == n and [(r.src, r.dst) for r in g.graph.edges.collect()] == [(0, n - 1)]


def _tables(spark):
    vertices = spark.createDataFrame([(10 * i, float(i), f"v{i}", [i] * (i % 3), i % 2 == 0) for i in range(300)], "vid bigint, x double, name string, l array<int>, on boolean")
    hub = [(500, 10 * (i % 300), float(i), [0.5 * i] * (i % 4)) for i in range(2000)]  # one vertex has nearly all edges
    edges = spark.createDataFrame([*hub, (0, 0, 1.0, []), (2990, 0, 2.0, [1.0]), (2990, 0, 2.0, [1.0])], "src bigint, dst bigint, length double, points array<double>")
    return vertices, edges


def test_round_trip(spark, tmp_path):
    vertices, edges = _tables(spark)
    path = str(tmp_path / "deep" / "a.gt")
    size = G.write_graph(Graph(vertices, edges), path, comment="c", properties={"shape": [1, 2], "scale": 0.5, "none": [], "what": "w", "yes": True, "raw": b"\x00\x01"}, ids="was")
    assert size == (tmp_path / "deep" / "a.gt").stat().st_size
    g = G.read_graph(spark, path, 64)
    assert not g.directed and g.comment == "c" and (g.n_vertices, g.n_edges) == (300, 2003)
    own = g.properties.first().asDict()
    assert own == {"shape": [1, 2], "scale": 0.5, "none": [], "what": "w", "yes": True, "raw": bytearray(b"\x00\x01")}
    assert sorted((r.was, r.x, r.name, r.l, r.on) for r in g.graph.vertices.collect()) == sorted(tuple(r) for r in vertices.collect())
    assert all(r.was == 10 * r.vid for r in g.graph.vertices.collect())
    assert sorted((10 * r.src, 10 * r.dst, r.length, r.points) for r in g.graph.edges.collect()) == sorted(tuple(r) for r in edges.collect())
    again = str(tmp_path / "b.gt")
    G.write_graph(Graph(vertices.repartition(7), edges.repartition(5)), again, comment="c", properties={"shape": [1, 2], "scale": 0.5, "none": [], "what": "w", "yes": True, "raw": b"\x00\x01"}, ids="was")
    assert open(path, "rb").read() == open(again, "rb").read()  # whatever the order of rows


def test_empty_and_bare_graphs(spark, tmp_path):
    none = Graph(spark.createDataFrame([], "vid bigint, x double"), spark.createDataFrame([], "src bigint, dst bigint, w int"))
    G.write_graph(none, str(tmp_path / "none.gt"))
    g = G.read_graph(spark, str(tmp_path / "none.gt"))
    assert g.graph.vertices.columns == ["vid", "x"] and g.graph.edges.columns == ["eid", "src", "dst", "w"] and g.graph.vertices.count() == g.graph.edges.count() == 0
    bare = Graph(spark.range(5).toDF("vid"), spark.createDataFrame([(0, 4), (7, 1)], "src bigint, dst bigint"))  # one end is no vertex
    G.write_graph(bare, str(tmp_path / "bare.gt"))
    g = G.read_graph(spark, str(tmp_path / "bare.gt"))
    assert g.graph.vertices.count() == 5 and [(r.src, r.dst) for r in g.graph.edges.collect()] == [(0, 4)] and g.properties.count() == 1


def test_what_the_format_cannot_hold(spark, tmp_path):
    edges = spark.createDataFrame([], "src bigint, dst bigint")
    with pytest.raises(Exception, match="no nulls"):
        G.write_graph(Graph(spark.createDataFrame([(1, None)], "vid bigint, x double"), edges), str(tmp_path / "a.gt"))
    with pytest.raises(ValueError, match="no value type"):
        G.write_graph(Graph(spark.createDataFrame([(1, {"a": 1})], "vid bigint, x map<string, int>"), edges), str(tmp_path / "a.gt"))
    with pytest.raises(ValueError, match="mounted"):
        G.write_graph(Graph(spark.range(1).toDF("vid"), edges), "s3://bucket/a.gt")
