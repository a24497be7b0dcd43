"""Pipeline queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import cells as C
from tessera.operators import hierarchy as H
from tessera.plans import fixtures as fx
from tessera.plans import pipelines as P
from tessera.registry import register


@register("pipeline_detect_cells")
def _detect(spark, sf_dir):
    return P.detect_cells(fx.vox(spark, sf_dir), background=(3, 3), shape=3, shape_level=4)


@register("pipeline_detect_cells_points", f"WITH {fx.NEIGHBOURS_SQL} SELECT vol_id, x, y, z, CAST(1 AS BIGINT) AS size, g AS source FROM nb GROUP BY vol_id, x, y, z, g HAVING g = max(v) AND g >= 110")
def _detect_points(spark, sf_dir):
    return P.detect_cells(fx.vox(spark, sf_dir), background=None, shape=3, level=110)


def _atlas(spark, sf_dir):
    v = fx.vox(spark, sf_dir)
    return v.groupBy("x", "y", "z").agg(F.max(F.col("v")).alias("m")).select("x", "y", "z", (F.pmod("m", F.lit(5)) + 1).cast("long").alias("id"), F.when(F.col("x") < 2, 0).otherwise(255).alias("hemisphere"))


_ATLAS = "atlas AS (SELECT x, y, z, CAST(max(v) % 5 + 1 AS BIGINT) AS id, CASE WHEN x < 2 THEN 0 ELSE 255 END AS hemisphere FROM vox GROUP BY x, y, z)"


@register("pipeline_annotate_cells", f"WITH {fx.VOX_SQL}, {_ATLAS}, {fx.HIERARCHY_SQL} SELECT c.vol_id, c.x, c.y, c.z, coalesce(a.id, 0) AS id, a.hemisphere, t.name FROM vox c LEFT JOIN atlas a ON a.x = c.x * 2 AND a.y = c.y AND a.z = c.z LEFT JOIN tree t ON t.id = coalesce(a.id, 0) WHERE c.v > 112")
def _annotate(spark, sf_dir):
    cells = fx.vox(spark, sf_dir).filter("v > 112")
    out = P.annotate_cells(cells, _atlas(spark, sf_dir), H.with_paths(fx.hierarchy(spark, sf_dir)), [F.col("x") * 2.0, F.col("y") * 1.0, F.col("z") * 1.0])
    return out.select("vol_id", "x", "y", "z", "id", "hemisphere", "name")


@register("pipeline_region_table", f"""WITH {fx.VOX_SQL}, {_ATLAS}, {fx.HIERARCHY_SQL}, v AS (SELECT id, hemisphere, count(*) * 2.0::DOUBLE AS volume FROM atlas GROUP BY ALL),
c AS (SELECT a.id, a.hemisphere, count(*) AS counts FROM vox JOIN atlas a ON a.x = vox.x AND a.y = vox.y AND a.z = vox.z WHERE v > 112 GROUP BY ALL)
SELECT v.id, v.hemisphere, t.name, v.volume, c.counts FROM v LEFT JOIN tree t ON t.id = v.id LEFT JOIN c ON c.id = v.id AND c.hemisphere = v.hemisphere""")
def _region(spark, sf_dir):
    paths = H.with_paths(fx.hierarchy(spark, sf_dir))
    cells = P.annotate_cells(fx.vox(spark, sf_dir).filter("v > 112").withColumn("size", F.col("v")), _atlas(spark, sf_dir), paths)
    return P.region_table(cells, _atlas(spark, sf_dir), paths, (1.0, 1.0, 2.0)).select("id", "hemisphere", "name", "volume", "counts")


@register("pipeline_compare_groups", f"""WITH {fx.CELLS_SQL}, k AS (SELECT sample, id, CASE hemisphere WHEN 0 THEN 'LH' ELSE 'RH' END AS hemisphere, count(name) AS counts FROM cells WHERE hemisphere IS NOT NULL GROUP BY ALL),
f AS (SELECT r.id, r.hemisphere, s.sample, coalesce(k.counts, 0) AS counts FROM (SELECT DISTINCT id, hemisphere FROM k) r CROSS JOIN range(1, 8) s(sample) LEFT JOIN k ON k.id = r.id AND k.hemisphere = r.hemisphere AND k.sample = s.sample),
m AS (SELECT id, hemisphere, avg(counts) FILTER (sample <= 3) AS m1, avg(counts) FILTER (sample > 3) AS m2 FROM f GROUP BY ALL) SELECT id, hemisphere, round(m1, 6) AS m1, round(m2, 6) AS m2 FROM m WHERE m1 <> 0 AND m2 <> 0""")
def _compare(spark, sf_dir):
    c = fx.cells(spark, sf_dir).withColumn("hemisphere", C.side(F.col("hemisphere"))).filter("hemisphere is not null")
    counts = c.groupBy(F.col("sample").cast("string").alias("sample"), "id", "hemisphere").agg(F.count("name").alias("counts"))
    out = P.compare_groups(counts, ["1", "2", "3"], ["4", "5", "6", "7"])
    return out.select("id", "hemisphere", F.round("m1", 6).alias("m1"), F.round("m2", 6).alias("m2"))


@register("pipeline_compare_groups_p_and_q")
def _compare_p(spark, sf_dir):
    c = fx.cells(spark, sf_dir).withColumn("hemisphere", C.side(F.col("hemisphere"))).filter("hemisphere is not null")
    counts = c.groupBy(F.col("sample").cast("string").alias("sample"), "id", "hemisphere").agg(F.count("name").alias("counts"))
    return P.compare_groups(counts, ["1", "2", "3"], ["4", "5", "6", "7"])


@register("pipeline_binarize")
def _binarize(spark, sf_dir):
    return P.binarize(fx.vox(spark, sf_dir), 70, 140)


@register("pipeline_vessel_graph")
def _vessels(spark, sf_dir):
    v = fx.vox(spark, sf_dir)
    whole = v.select(F.lit(0).cast("long").alias("vol_id"), (F.col("x") + F.col("vol_id") * 4).cast("int").alias("x"), "y", "z", (F.col("v") > 104).cast("int").alias("v"))
    return P.vessel_graph(whole).edges


@register("layout_embedding", """WITH t AS (SELECT CAST(p_partkey AS BIGINT) AS tile, p_partkey % 40 * 30 AS lo, p_partkey % 40 * 30 + p_size + 10 AS hi, p_partkey // 40 AS k FROM part), b AS (SELECT DISTINCT b FROM (SELECT lo AS b FROM t UNION ALL SELECT hi FROM t))
SELECT count(*) AS parts FROM (SELECT DISTINCT k, x.b FROM t JOIN b x ON x.b >= lo AND x.b < hi)""")
def _embedding(spark, sf_dir):
    k = F.col("p_partkey").cast("long")
    p = fx.read(spark, sf_dir, "part").select(k.alias("tile"), (k % 40 * 30).alias("lox"), (k % 40 * 30 + F.col("p_size") + 10).cast("long").alias("hix"), F.floor(k / 40).alias("loy"), (F.floor(k / 40) + 1).alias("hiy"), F.lit(0).cast("long").alias("loz"), F.lit(1).cast("long").alias("hiz"))
    return P.embedding(p).agg(F.count("*").alias("parts"))
