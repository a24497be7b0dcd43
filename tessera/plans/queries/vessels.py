"""Vessel-graph steps over the tree of regions, nations, customers and suppliers, and status counts of volumes."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import connect as C
from tessera.operators import graph as G
from tessera.operators import morphology as M
from tessera.operators import polylines as L
from tessera.operators import scatter as S
from tessera.operators import vessel_filters as VF
from tessera.operators import vessels as V
from tessera.plans import fixtures as fx
from tessera.registry import register

_G = f"WITH {fx.GRAPH_SQL}"
#: Parts as voxels; a vertex meets the part whose number gives its coordinates.
_PARTS = ", parts AS (SELECT CAST(p_partkey % 97 AS INTEGER) AS x, CAST(p_partkey % 89 AS INTEGER) AS y, CAST(p_partkey % 83 AS INTEGER) AS z, CAST(p_size AS DOUBLE) AS v FROM part)"
_AT = ", seen AS (SELECT t.vid, coalesce(p.v, 0) AS v FROM vertices t LEFT JOIN parts p ON t.x = p.x AND t.y = p.y AND t.z = p.z)"


def _graph(spark, sf_dir):
    return G.Graph(*fx.graph(spark, sf_dir))


def _parts(spark, sf_dir):
    p = F.col("p_partkey")
    return fx.read(spark, sf_dir, "part").select((p % 97).cast("int").alias("x"), (p % 89).cast("int").alias("y"), (p % 83).cast("int").alias("z"), F.col("p_size").cast("double").alias("v"))


@register("vessel_arteriness", f"{_G}{_PARTS}{_AT} SELECT e.src, e.dst, (a.v + b.v) / 2 AS artery_raw FROM edges e JOIN seen a ON e.src = a.vid JOIN seen b ON e.dst = b.vid")
def _arteriness(spark, sf_dir):
    return V.set_arteriness(_graph(spark, sf_dir), _parts(spark, sf_dir)).edges.select("src", "dst", "artery_raw")


@register("vessel_artery_binary", f"{_G}{_PARTS}{_AT} SELECT vid, v > 25 AS artery_binary FROM seen")
def _binary(spark, sf_dir):
    mask = _parts(spark, sf_dir).withColumn("v", F.col("v") - 25)
    return V.set_artery_binary(_graph(spark, sf_dir), mask).vertices.select("vid", "artery_binary")


@register("vessel_annotate", f"{_G}{_PARTS}{_AT} SELECT vid, CAST(v AS BIGINT) AS annotation FROM seen")
def _annotate(spark, sf_dir):
    atlas = _parts(spark, sf_dir).select("x", "y", "z", F.col("v").cast("long").alias("id"))
    return V.annotate(_graph(spark, sf_dir), atlas).vertices.select("vid", "annotation")


@register("vessel_pre_filter_veins", f"{_G} SELECT src, dst, radius >= 4 AND length <= 20 AS vein FROM edges")
def _veins(spark, sf_dir):
    return V.pre_filter_veins(_graph(spark, sf_dir), 4, 20, arteriness="length")


@register("vessel_post_filter_veins", f"{_G} SELECT src, dst, radius >= 3 AND NOT length > 20 AS vein FROM edges")
def _post(spark, sf_dir):
    g = _graph(spark, sf_dir).define_edge_property("artery", F.col("length") > 20)
    return V.post_filter_veins(g, 3).edges.select("src", "dst", "vein")


@register("vessel_remove_small_components", f"{_G}, l AS (SELECT src, dst, src >= 1000 AND length > 30 AS artery FROM edges) SELECT src, dst, artery AND count(*) OVER (PARTITION BY dst, artery) >= 3 AS artery FROM l")
def _small(spark, sf_dir):
    g = _graph(spark, sf_dir).define_edge_property("artery", (F.col("src") >= 1000) & (F.col("length") > 30))
    return V.remove_small_components(g, "artery", 3).edges.select("src", "dst", "artery")


@register("vessel_pre_filter_arteries", f"{_G}, l AS (SELECT src, dst, src >= 1000 AND length > 30 AND NOT radius > 4 AS artery FROM edges) SELECT src, dst, artery AND count(*) OVER (PARTITION BY dst, artery) >= 2 AS artery FROM l")
def _arteries(spark, sf_dir):
    g = _graph(spark, sf_dir).define_edge_property("artery", (F.col("src") >= 1000) & (F.col("length") > 30)).define_edge_property("vein", F.col("radius") > 4)
    return V.pre_filter_arteries(g, artery="artery", least_edges=2).edges.select("src", "dst", "artery")


@register("vessel_structure_sub_graph", f"{_G} SELECT src, dst FROM edges WHERE src IN (SELECT vid FROM vertices WHERE radius IN (1, 3)) AND dst IN (SELECT vid FROM vertices WHERE radius IN (1, 3))")
def _structure(spark, sf_dir):
    ids = spark.range(1, 4, 2).select(F.col("id").cast("double").alias("id"))
    return _graph(spark, sf_dir).structure_sub_graph(ids, "radius").edge_connectivity()


@register("graph_transform_properties", f"{_G} SELECT vid, 2 * x + 1 AS x, y + z AS y, -z + 0.5 AS z FROM vertices")
def _transform(spark, sf_dir):
    return _graph(spark, sf_dir).transform_properties([[2, 0, 0], [0, 1, 1], [0, 0, -1]], (1, 0, 0.5)).vertices.select("vid", "x", "y", "z")


@register("graph_expand", f"""{_G}, c AS (SELECT e.*, greatest(ceil(length / 5), 1) AS n, a.x AS ax, b.x AS bx FROM edges e JOIN vertices a ON e.src = a.vid JOIN vertices b ON e.dst = b.vid)
SELECT CAST(sum(n) AS BIGINT) AS edges, CAST(sum(n - 1) AS BIGINT) + (SELECT count(*) FROM vertices) AS vertices, round(sum(length), 6) AS length, round(sum((ax + bx) / 2 * (n - 1)), 6) + (SELECT sum(x) FROM vertices) AS x FROM c""")
def _expand(spark, sf_dir):
    g = _graph(spark, sf_dir).expand(step=5)
    e = g.edges.agg(F.count("*").alias("edges"), F.round(F.sum("length"), 6).alias("length"))
    return e.crossJoin(g.vertices.agg(F.count("*").alias("vertices"), F.round(F.sum("x"), 6).alias("x")))  # two one-row tables


@register("graph_expand_vertex_filter", f"{_G} SELECT vid FROM vertices WHERE label UNION SELECT e.src FROM edges e JOIN vertices v ON e.dst = v.vid WHERE v.label UNION SELECT e.dst FROM edges e JOIN vertices v ON e.src = v.vid WHERE v.label")
def _filter(spark, sf_dir):
    return _graph(spark, sf_dir).expand_vertex_filter("label")


def _rings(spark, sf_dir):
    """For each customer two vertices joined by two equal edges and by a third path over a vertex of its own."""
    c = fx.read(spark, sf_dir, "customer").select((F.col("c_custkey") * 3).cast("long").alias("a"))
    e = c.select(F.explode(F.array(*[F.struct((F.col("a") + p).alias("src"), (F.col("a") + q).alias("dst"), F.lit(float(n)).alias("length"), F.lit(float(r)).alias("radius")) for p, q, n, r in ((0, 1, 1, 2), (0, 1, 1, 2), (0, 2, 2, 1), (2, 1, 3, 5))])).alias("e")).select("e.*")
    return G.Graph(e.select(F.col("src").alias("vid")).union(e.select("dst")).distinct(), e)


@register("graph_reduce_parallel", "SELECT CAST(c_custkey * 3 AS BIGINT) AS src, CAST(c_custkey * 3 + 1 AS BIGINT) AS dst, length, radius, CAST(n AS BIGINT) AS n_edges FROM customer, (VALUES (1.0::DOUBLE, 2.0::DOUBLE, 1), (1.0::DOUBLE, 2.0::DOUBLE, 1), (5.0::DOUBLE, 5.0::DOUBLE, 2)) t(length, radius, n)")
def _parallel(spark, sf_dir):
    return _rings(spark, sf_dir).reduce().edges


@register("graph_trace_edges_parallel", """SELECT CAST(c_custkey * 3 + a AS BIGINT) AS src, CAST(c_custkey * 3 + b AS BIGINT) AS dst, n, on_ OR (c_custkey % 2 = 0 AND n >= 2) AS label
FROM customer, (VALUES (0, 1, 1, true), (0, 1, 0, false), (0, 2, 2, false), (2, 1, 3, false)) t(a, b, n, on_)""")
def _trace_parallel(spark, sf_dir):
    """One of two parallel edges is marked, the other one never passes; the way round passes in every other ring."""
    c = fx.read(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") * 3).cast("long").alias("a"))
    e = c.select("c_custkey", F.explode(F.array(*[F.struct((F.col("a") + p).alias("src"), (F.col("a") + q).alias("dst"), F.lit(n).alias("n"), F.lit(on).alias("label")) for p, q, n, on in ((0, 1, 1, True), (0, 1, 0, False), (0, 2, 2, False), (2, 1, 3, False))])).alias("e")).select("c_custkey", "e.*")
    g = G.Graph(e.select(F.col("src").alias("vid")).union(e.select("dst")).distinct(), e)
    return g.trace_edges("label", (F.col("c_custkey") % 2 == 0) & (F.col("n") >= 2), keep=("n",))


@register("vessel_remove_small_parallel", """SELECT CAST(c_custkey * 3 + a AS BIGINT) AS src, CAST(c_custkey * 3 + b AS BIGINT) AS dst, n, n > 0 AND c_custkey % 2 = 0 AS artery
FROM customer, (VALUES (0, 1, 1), (0, 1, 0), (0, 2, 2), (2, 1, 3)) t(a, b, n)""")
def _small_parallel(spark, sf_dir):
    """Three marked edges stay a component, a single marked one is too small; the unmarked parallel edge stays unmarked."""
    c = fx.read(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") * 3).cast("long").alias("a"))
    e = c.select("c_custkey", F.explode(F.array(*[F.struct((F.col("a") + p).alias("src"), (F.col("a") + q).alias("dst"), F.lit(n).alias("n")) for p, q, n in ((0, 1, 1), (0, 1, 0), (0, 2, 2), (2, 1, 3))])).alias("e")).select("c_custkey", "e.*")
    g = G.Graph(e.select(F.col("src").alias("vid")).union(e.select("dst")).distinct(), e.withColumn("artery", F.when(F.col("c_custkey") % 2 == 0, F.col("n") > 0).otherwise(F.col("n") == 1)))
    return V.remove_small_components(g, "artery", 3).edges.select("src", "dst", "n", "artery")


@register("graph_edge_graph", "SELECT count(*) * 4 AS vertices, count(*) * 4 AS edges FROM customer")
def _edge_graph(spark, sf_dir):
    """Vertices: four edges a customer. Links: the first edge to each other one, and the two that meet at the third vertex."""
    return _rings(spark, sf_dir).edge_graph().info()


_STATUS = ("High", "Equalized", "Deconvolved", "Adaptive", "Tube", "Fill", "Tracing")
_BITS = ", ".join(f"CASE WHEN (s >> {i}) & 1 = 1 THEN '{n}' END" for i, n in enumerate(_STATUS))


@register("binary_statistics", f"WITH {fx.VOX_SQL}, t AS (SELECT v % 128 AS s FROM vox) SELECT s AS status, CASE WHEN s = 0 THEN 'Background' ELSE concat_ws(',', {_BITS}) END AS description, count(*) AS n FROM t GROUP BY ALL")
def _status(spark, sf_dir):
    return V.binary_statistics(fx.vox(spark, sf_dir).withColumn("v", F.col("v") % 128))


@register("clean_open_branches")
def _branches(spark, sf_dir):
    return V.clean_open_branches(fx.vox(spark, sf_dir).filter("v > 110"), 2)


_W = [0.1353352832366127**4, 0.1353352832366127, 1.0, 0.1353352832366127, 0.1353352832366127**4]
_K = ", ".join(f"({d}, {w / sum(_W)!r}::DOUBLE)" for d, w in zip(range(-2, 3), _W))
_MIRROR = lambda a: f"CASE WHEN {a} + d < 0 THEN -({a} + d) - 1 WHEN {a} + d > 3 THEN 7 - ({a} + d) ELSE {a} + d END"


@register("vessel_deconvolve", f"""WITH {fx.VOX_SQL}, w(d, k) AS (VALUES {_K}), s AS (SELECT *, CASE WHEN v > 110 THEN CAST(v AS DOUBLE) ELSE 0 END AS s FROM vox),
a AS (SELECT p.vol_id, p.x, p.y, p.z, p.v, sum(q.s * k) AS s FROM s p, w, s q WHERE q.vol_id = p.vol_id AND q.y = p.y AND q.z = p.z AND q.x = {_MIRROR('p.x')} GROUP BY ALL),
b AS (SELECT p.vol_id, p.x, p.y, p.z, p.v, sum(q.s * k) AS s FROM a p, w, a q WHERE q.vol_id = p.vol_id AND q.x = p.x AND q.z = p.z AND q.y = {_MIRROR('p.y')} GROUP BY ALL)
SELECT vol_id, x, y, z, round(CASE WHEN v > 110 THEN v ELSE v - least(v, s) END, 6) AS v FROM b""")
def _deconvolve(spark, sf_dir):
    v = fx.vox(spark, sf_dir).withColumn("on", F.col("v") > 110)
    return VF.deconvolve(v, 0.5).withColumn("v", F.round("v", 6))


@register("vessel_threshold_adaptive", f"""WITH {fx.VOX_SQL}, g AS (SELECT vol_id, CAST(x // 2 AS INTEGER) AS cx, CAST(y // 2 AS INTEGER) AS cy, CAST(z // 2 AS INTEGER) AS cz, quantile_cont(CAST(v AS DOUBLE), 0.5) AS q FROM vox GROUP BY ALL),
t AS (SELECT *, greatest(least((x - 1) / 2.0, 1.0), 0.0) AS tx, greatest(least((y - 1) / 2.0, 1.0), 0.0) AS ty, greatest(least((z - 1) / 2.0, 1.0), 0.0) AS tz FROM vox)
SELECT t.vol_id, x, y, z, v, round(sum(q * (CASE cx WHEN 1 THEN tx ELSE 1 - tx END) * (CASE cy WHEN 1 THEN ty ELSE 1 - ty END) * (CASE cz WHEN 1 THEN tz ELSE 1 - tz END)), 6) AS level
FROM t JOIN g ON t.vol_id = g.vol_id GROUP BY ALL""")
def _adaptive(spark, sf_dir):
    return VF.threshold_adaptive(fx.vox(spark, sf_dir), (2, 2, 2), (2, 2, 2), share=0.5).withColumn("level", F.round("level", 6))


@register("vessel_binarize_adaptive")
def _binarize_adaptive(spark, sf_dir):
    return VF.binarize_adaptive(fx.slab(spark, sf_dir), (60, 6, 6), (20, 4, 4))


@register("vessel_postprocess")
def _postprocess(spark, sf_dir):
    return VF.postprocess(fx.slab(spark, sf_dir).withColumn("v", (F.col("v") > 97).cast("int")), 3, block=(64, 8, 8))


def _polylines(spark, sf_dir):
    """Each edge as three points: its ends in the plane z = 0, and a point above their middle."""
    v, e = fx.graph(spark, sf_dir)
    at = lambda end: v.select(F.col("vid").alias(end), F.struct("x", "y", F.lit(0.0).alias("z"), F.col("radius").alias("r")).alias(f"_{end}"))
    both = e.join(at("src"), "src").join(at("dst"), "dst")
    middle = F.struct(*[((F.col("_src")[c] + F.col("_dst")[c]) / 2 + (5 if c == "z" else 0)).alias(c) for c in ("x", "y", "z", "r")])
    return both.select("src", "dst", F.array("_src", middle, "_dst").alias("geometry"))


@register("edge_polylines_resized", f"""{_G}, p AS (SELECT src, dst, a.x AS ax, a.y AS ay, 0.0::DOUBLE AS az, a.radius AS ar, b.x AS bx, b.y AS b_y, 0.0::DOUBLE AS bz, b.radius AS br FROM edges JOIN vertices a ON src = a.vid JOIN vertices b ON dst = b.vid),
m AS (SELECT *, (ax + bx) / 2 AS mx, (ay + b_y) / 2 AS m_y, (az + bz) / 2 + 5 AS mz, (ar + br) / 2 AS mr FROM p), k AS (SELECT unnest(range(5)) AS pos)
SELECT src, dst, CAST(pos AS INTEGER) AS pos, {", ".join(f"round(CASE WHEN pos <= 2 THEN {a} + ({m} - {a}) * pos / 2 ELSE {m} + ({b} - {m}) * (pos - 2) / 2 END, 6) AS {n}" for n, a, m, b in (("x", "ax", "mx", "bx"), ("y", "ay", "m_y", "b_y"), ("z", "az", "mz", "bz"), ("r", "ar", "mr", "br")))} FROM m, k""")
def _resized(spark, sf_dir):
    e = L.resize(_polylines(spark, sf_dir), F.lit(5)).select("src", "dst", F.posexplode("geometry").alias("pos", "p"))
    return e.select("src", "dst", "pos", *[F.round(F.col("p")[c], 6).alias(c) for c in ("x", "y", "z", "r")])


@register("edge_polylines_length", f"{_G} SELECT src, dst, round(2 * sqrt(((a.x - b.x) ** 2 + (a.y - b.y) ** 2) / 4 + 25), 6) AS length FROM edges JOIN vertices a ON src = a.vid JOIN vertices b ON dst = b.vid")
def _polyline_length(spark, sf_dir):
    return _polylines(spark, sf_dir).select("src", "dst", F.round(L.length(), 6).alias("length"))


@register("edge_polylines_from_property", f"{_G} SELECT src, dst, radius AS label, CAST(3 AS INTEGER) AS points FROM edges")
def _from_property(spark, sf_dir):
    e = _polylines(spark, sf_dir).join(fx.graph(spark, sf_dir)[1].select("src", "dst", "radius"), ["src", "dst"])
    marked = L.set_points(e, F.col("radius"), "label")
    return marked.select("src", "dst", F.array_min(F.transform("geometry", lambda p: p["label"])).alias("label"), F.size("geometry").alias("points"))


@register("measure_list", f"""WITH {fx.VOX_SQL}, o(dx, dy, dz, k) AS (VALUES (0, 0, 0, 0), (-1, 0, 0, 1), (0, -1, 0, 2), (0, 0, -1, 3), (0, 0, 1, 4), (0, 1, 0, 5), (1, 0, 0, 6))
SELECT p.vol_id * 64 + p.x * 16 + p.y * 4 + p.z AS point_id, sum(q.v)::BIGINT AS v FROM vox p, o, vox q WHERE k < p.v % 8 AND q.vol_id = p.vol_id AND q.x = p.x + dx AND q.y = p.y + dy AND q.z = p.z + dz AND p.v % 8 > 0 GROUP BY ALL""")
def _measure_list(spark, sf_dir):
    v = fx.vox(spark, sf_dir)
    points = v.select((F.col("vol_id") * 64 + F.col("x") * 16 + F.col("y") * 4 + F.col("z")).alias("point_id"), "vol_id", "x", "y", "z", (F.col("v") % 8).alias("count"))
    return S.measure_list(points, v, S.sphere_offsets(spark, (1, 1, 1)), "sum").filter("v is not null")


def _broken(spark, sf_dir):
    """Bright voxels are the mask, and their own skeleton."""
    on = F.col("v") > 112
    return fx.vox(spark, sf_dir).select("vol_id", "x", "y", "z", (F.col("v") / 100).alias("score"), on.alias("mask"), on.alias("skeleton"))


@register("connect_ends")
def _connect(spark, sf_dir):
    v = _broken(spark, sf_dir)
    ends = M.skeleton_ends(v.filter("skeleton"))
    return C.connect_ends(v, ends, radius=3, block=(2, 2, 2)).withColumn("cost", F.round("cost", 9))


@register("trace_to_mask")
def _trace(spark, sf_dir):
    v = _broken(spark, sf_dir)
    return C.trace_to_mask(v, v.filter("x = 0 and y = 0 and z = 0"), radius=3).withColumn("cost", F.round("cost", 9))


@register("add_connections", f"""WITH {fx.VOX_SQL} SELECT DISTINCT w.vol_id, w.x, w.y, w.z FROM vox w JOIN vox p ON w.vol_id = p.vol_id
WHERE w.v > 112 OR (p.x = 0 AND p.v > 105 AND abs(w.x - p.x) <= 1 AND abs(w.y - p.y) <= 1 AND abs(w.z - p.z) <= 1)""")
def _add(spark, sf_dir):
    v = fx.vox(spark, sf_dir)
    return C.add_connections(v.filter("v > 112"), v.filter("x = 0 and v > 105"), v)
