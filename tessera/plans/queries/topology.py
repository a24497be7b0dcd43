"""Morphology, topology and tracking queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import configuration as C
from tessera.operators import convolve as K
from tessera.operators import distances as D
from tessera.operators import morphology as M
from tessera.operators import thinning as S
from tessera.operators import tracking as R
from tessera.plans import fixtures as fx
from tessera.registry import register

_N = f"WITH {fx.NEIGHBOURS_SQL}"
_FACE = "a.vol_id = b.vol_id AND abs(a.x - b.x) + abs(a.y - b.y) + abs(a.z - b.z) = 1"


def _components(cond: str, touch: str = _FACE) -> str:
    return f"""WITH RECURSIVE {fx.VOX_SQL}, m AS (SELECT vol_id, x, y, z, v, vol_id * 64 + x * 16 + y * 4 + z AS k FROM vox WHERE {cond}),
l AS (SELECT a.k AS s, b.k AS t FROM m a JOIN m b ON {touch}), r(k, c) AS (SELECT k, k FROM m UNION SELECT l.t, r.c FROM r JOIN l ON l.s = r.k WHERE r.c < l.t), comp AS (SELECT m.vol_id, m.x, m.y, m.z, m.v, m.k, min(r.c) AS c FROM m JOIN r ON r.k = m.k GROUP BY ALL)"""


@register("label_voxels", f"{_components('v > 105')} SELECT vol_id, x, y, z, c AS label FROM comp")
def _label(spark, sf_dir):
    parts = M.label_voxels(fx.vox(spark, sf_dir).filter("v > 105"))
    k = F.col("vol_id") * 64 + F.col("x") * 16 + F.col("y") * 4 + F.col("z")
    first = parts.groupBy("label").agg(F.min(k).alias("c"))
    return parts.join(first, "label").select("vol_id", "x", "y", "z", F.col("c").alias("label"))


@register("fill_holes", f"""{_components('v <= 92')}, o AS (SELECT DISTINCT c FROM comp WHERE x IN (0, 3) OR y IN (0, 3) OR z IN (0, 3))
SELECT v.vol_id, v.x, v.y, v.z, CAST(v.v > 92 OR coalesce(h.c NOT IN (SELECT c FROM o), false) AS INTEGER) AS v FROM vox v LEFT JOIN comp h ON h.vol_id = v.vol_id AND h.x = v.x AND h.y = v.y AND h.z = v.z""")
def _fill(spark, sf_dir):
    return M.fill_holes(fx.vox(spark, sf_dir).withColumn("v", (F.col("v") > 92).cast("int")))


@register("threshold_hysteresis", f"""{_components('v >= 105')}, s AS (SELECT DISTINCT c FROM comp WHERE v >= 118)
SELECT v.vol_id, v.x, v.y, v.z, CASE WHEN h.c IN (SELECT c FROM s) THEN 1 ELSE -1 END AS v FROM vox v LEFT JOIN comp h ON h.vol_id = v.vol_id AND h.x = v.x AND h.y = v.y AND h.z = v.z""")
def _hysteresis(spark, sf_dir):
    return M.threshold(fx.vox(spark, sf_dir), 118, 105)


@register("threshold", f"WITH {fx.VOX_SQL} SELECT vol_id, x, y, z, CASE WHEN v >= 110 THEN 1 ELSE -1 END AS v FROM vox")
def _threshold(spark, sf_dir):
    return M.threshold(fx.vox(spark, sf_dir), 110)


@register("smooth_by_counting", f"{_N} SELECT vol_id, x, y, z, CAST(CASE WHEN count(*) FILTER (v > 100) >= 10 THEN 1 WHEN count(*) FILTER (v > 100) < 5 THEN 0 ELSE CAST(g > 100 AS INTEGER) END AS BIGINT) AS v FROM nb GROUP BY vol_id, x, y, z, g")
def _counting(spark, sf_dir):
    return M.smooth_by_counting(fx.vox(spark, sf_dir).withColumn("v", F.greatest(F.col("v") - 100, F.lit(0))))


@register("distance_transform", f"""WITH {fx.VOX_SQL} SELECT f.vol_id, f.x, f.y, f.z, round(CASE WHEN f.v <= 92 THEN 0 ELSE min(sqrt((f.x-b.x)*(f.x-b.x)+(f.y-b.y)*(f.y-b.y)+(f.z-b.z)*(f.z-b.z))) END, 6) AS v
FROM vox f JOIN vox b ON b.vol_id = f.vol_id AND b.v <= 92 GROUP BY f.vol_id, f.x, f.y, f.z, f.v""")
def _distance(spark, sf_dir):
    return M.distance_transform(fx.vox(spark, sf_dir).withColumn("v", (F.col("v") > 92).cast("int"))).filter(F.col("v") < float("inf")).withColumn("v", F.round("v", 6))


_GAP = "sqrt((f.x-b.x)*(f.x-b.x)*0.25 + (f.y-b.y)*(f.y-b.y) + (f.z-b.z)*(f.z-b.z)*4)"


@register("distance_anisotropic", f"WITH {fx.SLAB_SQL} SELECT f.vol_id, f.x, f.y, f.z, round(CASE WHEN f.v <= 84 THEN 0 ELSE min({_GAP}) END, 6) AS v FROM slab f JOIN slab b ON b.v <= 84 WHERE f.x < 60 GROUP BY f.vol_id, f.x, f.y, f.z, f.v")
def _anisotropic(spark, sf_dir):
    """Distances over the whole slab; the SQL, which compares all pairs, and this report look at its first 60 planes."""
    got = D.distance_transform(fx.slab(spark, sf_dir).withColumn("v", (F.col("v") > 84).cast("int")), (0.5, 1.0, 2.0))
    return got.filter("x < 60").withColumn("v", F.round("v", 6))


@register("border_distance", f"""WITH {fx.VOX_SQL}, l AS (SELECT *, v > 100 AS id FROM vox), e AS (SELECT DISTINCT a.vol_id, a.x, a.y, a.z FROM l a JOIN l b ON {_FACE} AND a.id <> b.id)
SELECT f.vol_id, f.x, f.y, f.z, round(min(sqrt((f.x-b.x)*(f.x-b.x) + (f.y-b.y)*(f.y-b.y) + (f.z-b.z)*(f.z-b.z))), 6) AS v FROM l f JOIN e b ON f.vol_id = b.vol_id GROUP BY f.vol_id, f.x, f.y, f.z""")
def _border_distance(spark, sf_dir):
    v = fx.vox(spark, sf_dir).select("vol_id", "x", "y", "z", (F.col("v") > 100).alias("id"))
    return D.border_distance(v).filter(F.col("v") < float("inf")).withColumn("v", F.round("v", 6))


@register("reconstruct_dilation")
def _reconstruct(spark, sf_dir):
    v = fx.vox(spark, sf_dir)
    return M.reconstruct(v.select("vol_id", "x", "y", "z", (F.col("v") - 5).alias("seed"), F.col("v").alias("mask")))


@register("find_maxima", f"{_N}, m AS (SELECT vol_id, x, y, z, g FROM nb GROUP BY vol_id, x, y, z, g HAVING g = max(v)) SELECT vol_id, x, y, z, g AS v FROM m WHERE g >= 108")
def _maxima(spark, sf_dir):
    return M.find_maxima(fx.vox(spark, sf_dir), shape=3, level=108)


@register("centers_of_maxima", f"""{_components('true', 'a.vol_id = b.vol_id AND a.k <> b.k AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 AND abs(a.z - b.z) <= 1 AND a.v > 112 AND b.v > 112')}
SELECT vol_id, round(sum(x * v)::DOUBLE / sum(v), 6) AS x, round(sum(y * v)::DOUBLE / sum(v), 6) AS y, round(sum(z * v)::DOUBLE / sum(v), 6) AS z FROM comp WHERE v > 112 GROUP BY vol_id, c""")
def _centers(spark, sf_dir):
    v = fx.vox(spark, sf_dir)
    return M.centers_of_maxima(v, v.filter("v > 112")).select("vol_id", *[F.round(a, 6).alias(a) for a in "xyz"])


@register("skeletonize")
def _skeleton(spark, sf_dir):
    return M.skeletonize(fx.vox(spark, sf_dir).withColumn("v", (F.col("v") > 95).cast("int")))


@register("skeleton_ends", f"WITH {fx.VOX_SQL}, s AS (SELECT vol_id, x, y, z FROM vox WHERE v > 112) SELECT a.vol_id, a.x, a.y, a.z, count(b.x) AS degree FROM s a LEFT JOIN s b ON a.vol_id = b.vol_id AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 AND abs(a.z - b.z) <= 1 AND (a.x, a.y, a.z) <> (b.x, b.y, b.z) GROUP BY ALL HAVING count(b.x) <= 1")
def _ends(spark, sf_dir):
    return M.skeleton_ends(fx.vox(spark, sf_dir).filter("v > 112"))


@register("watershed")
def _watershed(spark, sf_dir):
    v = fx.vox(spark, sf_dir)
    seeds = M.find_maxima(v, shape=3, level=108).withColumn("label", F.col("x") * 16 + F.col("y") * 4 + F.col("z") + 1)
    return M.watershed(v, seeds, 95)


@register("skeletonize_blocks")
def _skeleton_blocks(spark, sf_dir):
    """One volume of all embeddings, in blocks smaller than the halo: voxels that stay, and when the others went."""
    stay, gone = S.thin(fx.slab(spark, sf_dir).withColumn("v", (F.col("v") > 97).cast("int")), block=(64, 8, 4))
    return stay.withColumn("step", F.lit(0)).unionByName(gone)


@register("skeleton_radii")
def _skeleton_radii(spark, sf_dir):
    return S.skeleton_radii(*S.thin(fx.slab(spark, sf_dir).withColumn("v", (F.col("v") > 97).cast("int"))))


@register("watershed_blocks")
def _watershed_blocks(spark, sf_dir):
    v = fx.slab(spark, sf_dir)
    seeds = K.local_max(v.withColumn("v", F.col("v").cast("double")), 3, 115.0, block=(32, 4, 8)).withColumn("label", F.col("x") * 64 + F.col("y") * 8 + F.col("z") + 1)
    return M.watershed(v, seeds, 95, block=(32, 4, 8))


# faces, opposite faces and rules of the closed table, as SQL on the codes
_RULES = " OR ".join(f"(c & {m}) = {v}" for m, v in C.table())
_ON = f"NOT (bit_count(c) <= 2 OR {_RULES})"
_PAIRS = " OR ".join(f"(c & {p}) = {p}" for p in ((1 << 4) + (1 << 22), (1 << 10) + (1 << 16), (1 << 12) + (1 << 14)))
_SIX = sum(1 << i for i in (4, 10, 12, 14, 16, 22))
_OFF = f"bit_count(c) >= 20 OR (({_PAIRS}) AND bit_count(c & {_SIX}) >= 3) OR {_RULES.replace('(c &', '((134217727 - c) &')}"


@register("smooth_by_configuration", f"""WITH {fx.SLAB_CODES_SQL}, k AS (SELECT *, CAST(code AS BIGINT) AS c FROM codes)
SELECT vol_id, x, y, z, CAST(CASE WHEN v > 100 THEN {_ON} ELSE {_OFF} END AS INTEGER) AS v FROM k""")
def _configuration(spark, sf_dir):
    return C.smooth_by_configuration(fx.slab(spark, sf_dir).withColumn("v", F.greatest(F.col("v") - 100, F.lit(0))), block=(32, 4, 4))


@register("cube_codes_blocks", f"WITH {fx.SLAB_CODES_SQL} SELECT vol_id, x, y, z, CAST(code AS BIGINT) AS v FROM codes")
def _codes_blocks(spark, sf_dir):
    return K.cube_codes(fx.slab(spark, sf_dir).withColumn("v", F.greatest(F.col("v") - 100, F.lit(0))), block=(32, 4, 4))


@register("trace_path")
def _trace(spark, sf_dir):
    v = fx.vox(spark, sf_dir)
    ends = v.select("vol_id").distinct().selectExpr("vol_id", "0 as sx", "0 as sy", "0 as sz", "3 as tx", "3 as ty", "3 as tz")
    return M.trace_path(v.withColumn("v", F.col("v") / 100.0), ends)


@register("local_percentile", f"WITH {fx.VOX_SQL} SELECT vol_id, CAST(x // 2 AS INTEGER) AS cx, CAST(y // 2 AS INTEGER) AS cy, CAST(z // 2 AS INTEGER) AS cz, round(quantile_cont(CAST(v AS DOUBLE), 0.25), 6) AS v FROM vox GROUP BY ALL")
def _percentile(spark, sf_dir):
    return M.local_percentile(fx.vox(spark, sf_dir), 0.25, (2, 2, 2), (2, 2, 2)).withColumn("v", F.round("v", 6))


@register("local_histogram", f"WITH {fx.VOX_SQL} SELECT vol_id, CAST(x // 2 AS INTEGER) AS cx, CAST(y // 2 AS INTEGER) AS cy, CAST(z // 2 AS INTEGER) AS cz, v AS bin, count(*) AS n FROM vox GROUP BY ALL")
def _histogram(spark, sf_dir):
    return M.local_histogram(fx.vox(spark, sf_dir), (2, 2, 2), (2, 2, 2))


@register("correct_lightsheet")
def _lightsheet(spark, sf_dir):
    return M.correct_lightsheet(fx.vox(spark, sf_dir), 0.25, (3, 1, 1), (2, 2, 2), (2, 2, 2))


@register("equalize_local")
def _equalize(spark, sf_dir):
    return M.equalize_local(fx.vox(spark, sf_dir), 0.5, 0.95, 1.5, (2, 2, 2), (2, 2, 2))


@register("threshold_isodata", f"""WITH {fx.VOX_SQL}, h AS (SELECT vol_id, v, count(*) AS n FROM vox GROUP BY ALL),
c AS (SELECT vol_id, v, lead(v) OVER w AS nxt, CAST(sum(n) OVER w AS DOUBLE) AS c, CAST(sum(n * v) OVER w AS DOUBLE) AS s, sum(n) OVER (PARTITION BY vol_id) AS tc, sum(n * v) OVER (PARTITION BY vol_id) AS ts FROM h WINDOW w AS (PARTITION BY vol_id ORDER BY v))
SELECT vol_id, CAST(coalesce(max(v) FILTER (c < tc AND (s / c + (ts - s) / nullif(tc - c, 0)) / 2 >= v AND (s / c + (ts - s) / nullif(tc - c, 0)) / 2 < nxt), 1) AS DOUBLE) AS level FROM c GROUP BY vol_id""")
def _isodata(spark, sf_dir):
    return M.threshold_isodata(fx.vox(spark, sf_dir))


@register("track_positions")
def _track(spark, sf_dir):
    v = fx.vox(spark, sf_dir).filter("v > 112").select(F.lit(0).cast("long").alias("key"), F.col("vol_id").alias("t"), (F.col("vol_id") * 64 + F.col("x") * 16 + F.col("y") * 4 + F.col("z")).alias("id"), "x", "y", "z")
    return R.track(v, 2.0, 3.0)
