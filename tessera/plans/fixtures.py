"""Views of the driver's tables in this engine's shapes, and the same views in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vox(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each embedding as a 4 x 4 x 4 volume of whole numbers."""
    e = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("vol_id"), F.posexplode("embedding").alias("p", "f"))
    return e.select("vol_id", F.expr("cast(p div 16 as int)").alias("x"), F.expr("cast((p div 4) % 4 as int)").alias("y"), F.expr("cast(p % 4 as int)").alias("z"), F.round((F.col("f").cast("double") + 1) * 100).cast("long").alias("v"))


VOX_SQL = """vox AS (
  SELECT vol_id, CAST(p // 16 AS INTEGER) AS x, CAST((p // 4) % 4 AS INTEGER) AS y, CAST(p % 4 AS INTEGER) AS z, CAST(round((CAST(f AS DOUBLE) + 1) * 100) AS BIGINT) AS v
  FROM (SELECT vec_id AS vol_id, unnest(embedding) AS f, unnest(range(len(embedding))) AS p FROM embeddings)
)"""

def slab(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings as one volume: x the vector, y and z its 64 components as 8 x 8."""
    e = read(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("int").alias("x"), F.posexplode("embedding").alias("p", "f"))
    return e.select(F.lit(0).cast("long").alias("vol_id"), "x", F.expr("cast(p div 8 as int)").alias("y"), F.expr("cast(p % 8 as int)").alias("z"), F.round((F.col("f").cast("double") + 1) * 100).cast("long").alias("v"))


SLAB_SQL = """slab AS (
  SELECT CAST(0 AS BIGINT) AS vol_id, CAST(vec_id AS INTEGER) AS x, CAST(p // 8 AS INTEGER) AS y, CAST(p % 8 AS INTEGER) AS z, CAST(round((CAST(f AS DOUBLE) + 1) * 100) AS BIGINT) AS v
  FROM (SELECT vec_id, unnest(embedding) AS f, unnest(range(len(embedding))) AS p FROM embeddings)
)"""
#: Bits of the neighbourhood of every voxel of the slab (v > 100 is on), first axis fastest.
SLAB_CODES_SQL = f"""{SLAB_SQL}, codes AS (
  SELECT c.vol_id, c.x, c.y, c.z, c.v, sum(CASE WHEN n.v > 100 THEN 1 << CAST((n.x - c.x + 1) + 3 * (n.y - c.y + 1) + 9 * (n.z - c.z + 1) AS BIGINT) ELSE 0 END) AS code
  FROM slab c JOIN slab n ON n.x BETWEEN c.x - 1 AND c.x + 1 AND n.y BETWEEN c.y - 1 AND c.y + 1 AND n.z BETWEEN c.z - 1 AND c.z + 1 GROUP BY ALL
)"""

#: Voxels c with the stored voxels n of their 3 x 3 x 3 neighbourhood; g is the centre's value.
NEIGHBOURS_SQL = f"""{VOX_SQL}, nb AS (
  SELECT c.vol_id, c.x, c.y, c.z, c.v AS g, n.v, n.x - c.x AS dx, n.y - c.y AS dy, n.z - c.z AS dz
  FROM vox c JOIN vox n ON n.vol_id = c.vol_id AND n.x BETWEEN c.x - 1 AND c.x + 1 AND n.y BETWEEN c.y - 1 AND c.y + 1 AND n.z BETWEEN c.z - 1 AND c.z + 1
)"""


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as weighted points: x quantity, y discount in percent, z line number."""
    return read(spark, sf_dir, "lineitem").select(
        F.monotonically_increasing_id().alias("point_id"), F.col("l_quantity").cast("double").alias("x"), F.round(F.col("l_discount").cast("double") * 100).alias("y"), F.col("l_linenumber").cast("double").alias("z"), F.col("l_extendedprice").cast("double").alias("w")
    )


POINTS_SQL = "points AS (SELECT CAST(l_quantity AS DOUBLE) AS x, round(CAST(l_discount AS DOUBLE) * 100) AS y, CAST(l_linenumber AS DOUBLE) AS z, CAST(l_extendedprice AS DOUBLE) AS w FROM lineitem)"


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as cells: id the supplier, hemisphere from the return flag."""
    return read(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").cast("long").alias("id"), F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "R", 255).cast("int").alias("hemisphere"),
        F.col("l_linestatus").alias("name"), F.col("l_quantity").cast("double").alias("size"), F.col("l_extendedprice").cast("double").alias("source"), F.col("l_linenumber").cast("int").alias("sample"),
    )


CELLS_SQL = "cells AS (SELECT CAST(l_suppkey AS BIGINT) AS id, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'R' THEN 255 END AS hemisphere, l_linestatus AS name, CAST(l_quantity AS DOUBLE) AS size, CAST(l_extendedprice AS DOUBLE) AS source, CAST(l_linenumber AS INTEGER) AS sample FROM lineitem)"


def hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tree of regions, nations and customers below one root: id, parent_id, name."""
    r = read(spark, sf_dir, "region").select((F.col("r_regionkey") + 1).cast("long").alias("id"), F.lit(0).cast("long").alias("parent_id"), F.col("r_name").alias("name"))
    n = read(spark, sf_dir, "nation").select((F.col("n_nationkey") + 100).cast("long").alias("id"), (F.col("n_regionkey") + 1).cast("long").alias("parent_id"), F.col("n_name").alias("name"))
    c = read(spark, sf_dir, "customer").select((F.col("c_custkey") + 1000).cast("long").alias("id"), (F.col("c_nationkey") + 100).cast("long").alias("parent_id"), F.col("c_name").alias("name"))
    root = spark.range(1).select(F.col("id").cast("long").alias("id"), F.lit(None).cast("long").alias("parent_id"), F.lit("root").alias("name"))
    return root.unionByName(r).unionByName(n).unionByName(c)


HIERARCHY_SQL = """tree AS (
  SELECT CAST(0 AS BIGINT) AS id, CAST(NULL AS BIGINT) AS parent_id, 'root' AS name
  UNION ALL SELECT CAST(r_regionkey + 1 AS BIGINT), CAST(0 AS BIGINT), r_name FROM region
  UNION ALL SELECT CAST(n_nationkey + 100 AS BIGINT), CAST(n_regionkey + 1 AS BIGINT), n_name FROM nation
  UNION ALL SELECT CAST(c_custkey + 1000 AS BIGINT), CAST(c_nationkey + 100 AS BIGINT), c_name FROM customer
)"""


def graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(vertices, edges): customers and suppliers joined to their nations, nations to their regions."""
    part = lambda name, key, other, a, b: read(spark, sf_dir, name).select((F.col(key) + a).cast("long").alias("src"), (F.col(other) + b).cast("long").alias("dst"))
    pairs = part("customer", "c_custkey", "c_nationkey", 10000000, 100).unionByName(part("supplier", "s_suppkey", "s_nationkey", 1000, 100)).unionByName(part("nation", "n_nationkey", "n_regionkey", 100, 0))
    edges = pairs.select("src", "dst", (F.pmod("src", F.lit(37)) + 1).cast("double").alias("length"), F.pmod("src", F.lit(7)).cast("double").alias("radius"))
    ends = edges.select(F.col("src").alias("vid")).union(edges.select("dst")).distinct()
    vertices = ends.select("vid", F.pmod("vid", F.lit(97)).cast("double").alias("x"), F.pmod("vid", F.lit(89)).cast("double").alias("y"), F.pmod("vid", F.lit(83)).cast("double").alias("z"), F.pmod("vid", F.lit(5)).cast("double").alias("radius"), (F.pmod("vid", F.lit(11)) == 0).alias("label"))
    return vertices, edges


GRAPH_SQL = """pairs_ AS (
  SELECT CAST(c_custkey + 10000000 AS BIGINT) AS src, CAST(c_nationkey + 100 AS BIGINT) AS dst FROM customer
  UNION ALL SELECT CAST(s_suppkey + 1000 AS BIGINT), CAST(s_nationkey + 100 AS BIGINT) FROM supplier
  UNION ALL SELECT CAST(n_nationkey + 100 AS BIGINT), CAST(n_regionkey AS BIGINT) FROM nation
), edges AS (SELECT src, dst, CAST(src % 37 + 1 AS DOUBLE) AS length, CAST(src % 7 AS DOUBLE) AS radius FROM pairs_
), vertices AS (
  SELECT vid, CAST(vid % 97 AS DOUBLE) AS x, CAST(vid % 89 AS DOUBLE) AS y, CAST(vid % 83 AS DOUBLE) AS z, CAST(vid % 5 AS DOUBLE) AS radius, vid % 11 = 0 AS label
  FROM (SELECT src AS vid FROM edges UNION SELECT dst FROM edges)
), ends AS (SELECT src AS vid, src, dst, length, radius FROM edges UNION ALL SELECT dst, src, dst, length, radius FROM edges)"""
