"""Graph queries over suppliers and parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import graph as G
from tessera.plans import fixtures as fx
from tessera.registry import register

_G = f"WITH {fx.GRAPH_SQL}"
_R = f"WITH RECURSIVE {fx.GRAPH_SQL}"


def _graph(spark, sf_dir):
    return G.Graph(*fx.graph(spark, sf_dir))


@register("graph_vertex_degrees", f"{_G} SELECT vid, count(*) AS degree FROM ends GROUP BY vid")
def _degrees(spark, sf_dir):
    return _graph(spark, sf_dir).vertex_degrees()


@register("graph_neighbours", f"{_G} SELECT src AS vid, dst AS other FROM edges UNION ALL SELECT dst, src FROM edges")
def _neighbours(spark, sf_dir):
    return _graph(spark, sf_dir).neighbours()


@register("graph_info", f"{_G} SELECT (SELECT count(*) FROM vertices) AS vertices, (SELECT count(*) FROM edges) AS edges")
def _info(spark, sf_dir):
    return _graph(spark, sf_dir).info()


@register("graph_sub_graph", f"{_G} SELECT src, dst FROM edges WHERE length > 20 AND src IN (SELECT vid FROM vertices WHERE radius < 4) AND dst IN (SELECT vid FROM vertices WHERE radius < 4)")
def _sub(spark, sf_dir):
    return _graph(spark, sf_dir).sub_graph(F.col("radius") < 4, F.col("length") > 20).edge_connectivity()


@register("graph_sub_slice", f"{_G} SELECT vid FROM vertices WHERE x >= 10 AND x < 60 AND y >= 0 AND y < 50")
def _slice(spark, sf_dir):
    return _graph(spark, sf_dir).sub_slice({"x": (10, 60), "y": (0, 50)}).vertices.select("vid")


@register("graph_remove_vertices", f"{_G} SELECT src, dst FROM edges WHERE src % 11 <> 0 AND dst % 11 <> 0")
def _remove(spark, sf_dir):
    g = _graph(spark, sf_dir)
    return g.remove_vertices(g.vertices.filter("label")).edge_connectivity()


@register("graph_add_and_remove_edges", f"{_G} SELECT src, dst FROM edges WHERE radius <> 3 UNION ALL SELECT 1::BIGINT, 2::BIGINT")
def _edit(spark, sf_dir):
    g = _graph(spark, sf_dir)
    return g.remove_edges(g.edges.filter("radius = 3")).add_edges(spark.createDataFrame([(1, 2)], "src bigint, dst bigint")).edge_connectivity()


@register("graph_renumbered", f"{_G}, n AS (SELECT vid, row_number() OVER (ORDER BY vid) - 1 AS new FROM vertices) SELECT a.new AS src, b.new AS dst FROM edges JOIN n a ON a.vid = src JOIN n b ON b.vid = dst")
def _renumbered(spark, sf_dir):
    return _graph(spark, sf_dir).renumbered().edge_connectivity()


@register("graph_remove_self_loops", f"{_G} SELECT src % 50 AS src, dst % 50 AS dst FROM edges WHERE src % 50 <> dst % 50")
def _loops(spark, sf_dir):
    v, e = fx.graph(spark, sf_dir)
    return G.Graph(v, e.select((F.col("src") % 50).alias("src"), (F.col("dst") % 50).alias("dst"))).remove_self_loops().edges


@register("graph_remove_isolated_edges", f"{_G}, d AS (SELECT vid, count(*) AS degree FROM ends GROUP BY vid) SELECT src, dst FROM edges JOIN d a ON a.vid = src JOIN d b ON b.vid = dst WHERE NOT (a.degree = 1 AND b.degree = 1)")
def _isolated(spark, sf_dir):
    return _graph(spark, sf_dir).remove_isolated_edges().edge_connectivity()


_COMPONENTS = f"{_R}, reach(vid, c) AS (SELECT vid, vid FROM vertices UNION SELECT CASE WHEN e.src = r.vid THEN e.dst ELSE e.src END, r.c FROM reach r JOIN ends e ON e.vid = r.vid), comp AS (SELECT vid, min(c) AS component FROM reach GROUP BY vid)"


@register("graph_components", f"{_COMPONENTS} SELECT vid, component FROM comp")
def _components(spark, sf_dir):
    return _graph(spark, sf_dir).label_components()


@register("graph_component_sizes", f"{_COMPONENTS} SELECT component, count(*) AS size FROM comp GROUP BY component")
def _sizes(spark, sf_dir):
    return _graph(spark, sf_dir).component_sizes()


@register("graph_largest_component", f"{_COMPONENTS} SELECT vid FROM comp WHERE component = (SELECT component FROM comp GROUP BY component ORDER BY count(*) DESC, component LIMIT 1)")
def _largest(spark, sf_dir):
    return _graph(spark, sf_dir).largest_component().vertices.select("vid")


@register("graph_edge_label", f"{_G} SELECT src, dst, label FROM edges JOIN vertices ON vid = src")
def _edge_label(spark, sf_dir):
    return _graph(spark, sf_dir).edge_label("label")


@register("graph_edge_to_vertex", f"{_G} SELECT vid, max(radius) AS radius FROM ends GROUP BY vid")
def _edge_to_vertex(spark, sf_dir):
    return _graph(spark, sf_dir).edge_to_vertex("radius")


@register("graph_vertex_to_edge", f"{_G} SELECT src, dst, (a.radius + b.radius) / 2 AS radius FROM edges JOIN vertices a ON a.vid = src JOIN vertices b ON b.vid = dst")
def _vertex_to_edge(spark, sf_dir):
    return _graph(spark, sf_dir).vertex_to_edge("radius")


_DILATE = "SELECT v.vid, v.label OR coalesce((SELECT bool_or(w.label) FROM ends e JOIN {t} w ON w.vid = CASE WHEN e.src = v.vid THEN e.dst ELSE e.src END WHERE e.vid = v.vid), false) AS label FROM {t} v"
_ERODE = "SELECT v.vid, v.label AND coalesce((SELECT bool_and(w.label) FROM ends e JOIN {t} w ON w.vid = CASE WHEN e.src = v.vid THEN e.dst ELSE e.src END WHERE e.vid = v.vid), true) AS label FROM {t} v"


@register("graph_vertex_dilate", f"{_G} {_DILATE.format(t='vertices')}")
def _dilate(spark, sf_dir):
    return _graph(spark, sf_dir).vertex_dilate("label")


@register("graph_vertex_erode", f"{_G} {_ERODE.format(t='vertices')}")
def _erode(spark, sf_dir):
    return _graph(spark, sf_dir).vertex_erode("label")


@register("graph_vertex_close", f"{_G}, d AS ({_DILATE.format(t='vertices')}) {_ERODE.format(t='d')}")
def _close(spark, sf_dir):
    return _graph(spark, sf_dir).vertex_close("label")


@register("graph_vertex_open", f"{_G}, d AS ({_ERODE.format(t='vertices')}) {_DILATE.format(t='d')}")
def _open(spark, sf_dir):
    return _graph(spark, sf_dir).vertex_open("label")


@register("graph_edge_dilate", f"{_G}, h AS (SELECT src AS vid FROM edges WHERE radius = 0 UNION SELECT dst FROM edges WHERE radius = 0) SELECT src, dst, src IN (SELECT vid FROM h) OR dst IN (SELECT vid FROM h) AS label FROM edges")
def _edge_dilate(spark, sf_dir):
    return _graph(spark, sf_dir).define_edge_property("label", F.col("radius") == 0).edge_dilate("label")


@register("graph_edge_graph_components", f"{_COMPONENTS} SELECT component, count(*) AS n FROM comp JOIN edges ON src = vid GROUP BY component")
def _line(spark, sf_dir):
    g = _graph(spark, sf_dir)
    line = g.edge_graph()
    labels = line.label_components().join(line.vertices.select("vid", "src"), "vid").join(g.label_components().select(F.col("vid").alias("src"), F.col("component").alias("own")), "src")
    return labels.groupBy("component").agg(F.min("own").alias("own"), F.count("*").alias("n")).select(F.col("own").alias("component"), "n")


@register("graph_trace_vertices", f"{_R}, t(vid) AS (SELECT vid FROM vertices WHERE label UNION SELECT v.vid FROM t JOIN ends e ON e.vid = t.vid JOIN vertices v ON v.vid = CASE WHEN e.src = t.vid THEN e.dst ELSE e.src END WHERE v.radius <= 3) SELECT vid, vid IN (SELECT vid FROM t) AS label FROM vertices")
def _trace(spark, sf_dir):
    return _graph(spark, sf_dir).trace_vertices("label", F.col("radius") <= 3)


@register("graph_trace_edges", f"""{_R}, t(src, dst) AS (SELECT src, dst FROM edges WHERE radius = 0 UNION SELECT e.src, e.dst FROM t JOIN edges e ON e.src = t.src OR e.dst = t.dst OR e.src = t.dst OR e.dst = t.src WHERE e.radius IN (1, 2))
SELECT e.src, e.dst, (e.src, e.dst) IN (SELECT (src, dst) FROM t) AS label FROM edges e""")
def _trace_edges(spark, sf_dir):
    return _graph(spark, sf_dir).define_edge_property("label", F.col("radius") == 0).trace_edges("label", F.col("radius").isin(1.0, 2.0))


@register("graph_edge_vectors", f"{_G} SELECT src, dst, a.x - b.x AS vx, a.y - b.y AS vy, a.z - b.z AS vz FROM edges JOIN vertices a ON a.vid = src JOIN vertices b ON b.vid = dst")
def _vectors(spark, sf_dir):
    return _graph(spark, sf_dir).edge_vectors()


@register("graph_expand_length", f"{_G} SELECT src, dst, CAST(part AS INTEGER) AS part, round(length / n, 6) AS length FROM (SELECT *, greatest(CAST(ceil(length / 5) AS BIGINT), 1) AS n FROM edges), LATERAL (SELECT unnest(range(n)) AS part)")
def _expand(spark, sf_dir):
    return _graph(spark, sf_dir).expand_length("length", 5.0).withColumn("length", F.round("length", 6))


@register("graph_clean", f"""WITH RECURSIVE {fx.GRAPH_SQL}, d AS (SELECT vid FROM ends GROUP BY vid HAVING count(*) >= 3), inner_ AS (SELECT src, dst FROM edges WHERE src IN (SELECT vid FROM d) AND dst IN (SELECT vid FROM d)),
both_ AS (SELECT src AS a, dst AS b FROM inner_ UNION SELECT dst, src FROM inner_), reach(vid, c) AS (SELECT a, a FROM both_ UNION SELECT b.b, r.c FROM reach r JOIN both_ b ON b.a = r.vid), grp AS (SELECT vid, min(c) AS t FROM reach GROUP BY vid),
m AS (SELECT coalesce(a.t, src) AS s, coalesce(b.t, dst) AS d FROM edges LEFT JOIN grp a ON a.vid = src LEFT JOIN grp b ON b.vid = dst)
SELECT DISTINCT least(s, d) AS src, greatest(s, d) AS dst FROM m WHERE s <> d""")
def _clean(spark, sf_dir):
    return _graph(spark, sf_dir).clean().edge_connectivity()


@register("graph_reduce_totals", f"{_G} SELECT round(sum(length), 2) AS length, max(radius) AS radius, CAST(count(*) AS BIGINT) AS n_edges FROM edges")
def _reduce(spark, sf_dir):
    e = _graph(spark, sf_dir).reduce().edges
    return e.agg(F.round(F.sum("length"), 2).alias("length"), F.max("radius").alias("radius"), F.sum("n_edges").alias("n_edges"))


@register("graph_reduce")
def _reduced(spark, sf_dir):
    return _graph(spark, sf_dir).reduce().edges


@register("graph_coloring", f"{_G} SELECT count(*) AS conflicts FROM edges WHERE false")
def _coloring(spark, sf_dir):
    g = _graph(spark, sf_dir)
    c = G.greedy_coloring(g)
    at = lambda end: c.select(F.col("vid").alias(end), F.col("color").alias(f"c_{end}"))
    return g.edges.join(at("src"), "src").join(at("dst"), "dst").agg(F.count_if(F.col("c_src") == F.col("c_dst")).alias("conflicts"))


_SKELETON = f"WITH {fx.VOX_SQL}, s AS (SELECT CAST(x + vol_id * 6 AS INTEGER) AS x, y, z FROM vox WHERE v > 100)"


def _bright(spark, sf_dir):
    """All volumes side by side along x, bright voxels 1."""
    v = fx.vox(spark, sf_dir)
    return v.select((F.col("x") + F.col("vol_id") * 6).cast("int").alias("x"), "y", "z", (F.col("v") > 100).cast("int").alias("v"))



@register("graph_from_skeleton", f"""{_SKELETON} SELECT a.x AS ax, a.y AS ay, a.z AS az, b.x AS bx, b.y AS by, b.z AS bz FROM s a JOIN s b ON abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 AND abs(a.z - b.z) <= 1 AND (b.x, b.y, b.z) > (a.x, a.y, a.z)""")
def _skeleton(spark, sf_dir):
    g = G.graph_from_skeleton(_bright(spark, sf_dir))
    at = lambda end, p: g.vertices.select(F.col("vid").alias(end), *[F.col(c).alias(f"{p}{c}") for c in "xyz"])
    return g.edges.join(at("src", "a"), "src").join(at("dst", "b"), "dst").drop("src", "dst")


@register("graph_to_skeleton", f"{_SKELETON} SELECT x, y, z, 1 AS v FROM s")
def _to_skeleton(spark, sf_dir):
    return G.graph_to_skeleton(G.graph_from_skeleton(_bright(spark, sf_dir)))


@register("index_neighbours", "WITH k AS (SELECT DISTINCT CAST(l_orderkey AS BIGINT) AS idx FROM lineitem) SELECT a.idx AS i, b.idx AS j FROM k a JOIN k b ON b.idx = a.idx + 7")
def _index(spark, sf_dir):
    return G.index_neighbours(fx.read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("long").alias("idx")).distinct(), 7)


@register("group_labels", "SELECT CAST(c_nationkey AS BIGINT) AS nation, array_to_string(list(c_custkey ORDER BY c_custkey), ',') AS rows FROM customer GROUP BY c_nationkey")
def _group(spark, sf_dir):
    c = fx.read(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("long").alias("nation"), "c_custkey")
    return G.group_labels(c, "nation", "c_custkey").select("nation", F.array_join(F.transform("rows", lambda r: r.cast("string")), ",").alias("rows"))
