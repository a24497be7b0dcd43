"""Group statistics, scalar, resampling and layout queries."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tessera.functions import fits as L
from tessera.functions import scalars as X
from tessera.functions import stats as T
from tessera.operators import spatial as P
from tessera.plans import fixtures as fx
from tessera.registry import register


def _groups(spark, sf_dir):
    e = fx.read(spark, sf_dir, "embeddings").filter("label in (0, 1)")
    return e.select("label", F.posexplode("embedding").alias("test", "f")).select("label", F.col("test").cast("long").alias("test"), F.col("f").cast("double").alias("value"))


_E = "e AS (SELECT label, unnest(range(len(embedding))) AS test, CAST(unnest(embedding) AS DOUBLE) AS value FROM embeddings WHERE label IN (0, 1))"
_T = f"""WITH {_E}, a AS (SELECT test, avg(value) FILTER (label = 0) AS m1, avg(value) FILTER (label = 1) AS m2, var_samp(value) FILTER (label = 0) AS v1, var_samp(value) FILTER (label = 1) AS v2, count(*) FILTER (label = 0) AS n1, count(*) FILTER (label = 1) AS n2 FROM e GROUP BY test)"""


@register("t_test_welch", f"{_T} SELECT CAST(test AS BIGINT) AS test, round(m1, 6) AS m1, round(m2, 6) AS m2, round(sqrt(v1), 6) AS sd1, round((m1 - m2) / sqrt(v1 / n1 + v2 / n2), 6) AS t FROM a")
def _welch(spark, sf_dir):
    t = T.t_test(_groups(spark, sf_dir), ["test"], "label", "value", 0, 1)
    return t.select("test", *[F.round(c, 6).alias(c) for c in ("m1", "m2", "sd1", "t")])


@register("t_test_pooled", f"{_T} SELECT CAST(test AS BIGINT) AS test, round((m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2) * (1.0::DOUBLE / n1 + 1.0::DOUBLE / n2)), 6) AS t, CASE WHEN m1 < m2 THEN -1 ELSE 1 END AS p_sign FROM a")
def _pooled(spark, sf_dir):
    t = T.t_test(_groups(spark, sf_dir), ["test"], "label", "value", 0, 1, equal_var=True, signed=True)
    return t.select("test", F.round("t", 6).alias("t"), "p_sign")


@register("t_test_p_values")
def _p(spark, sf_dir):
    return T.t_test(_groups(spark, sf_dir), ["test"], "label", "value", 0, 1, p_cutoff=0.5).select("test", "p")


def _pvals(spark, sf_dir):
    return fx.read(spark, sf_dir, "events").select("event_id", (F.col("value").cast("double") / 500).alias("p"))


_P = "p AS (SELECT event_id, CAST(value AS DOUBLE) / 500 AS p FROM events)"


@register("correct_p_values_bh", f"""WITH {_P}, r AS (SELECT event_id, p, p * (SELECT count(*) FROM p) / (SELECT count(*) FROM p q WHERE q.p <= o.p) AS q FROM p o)
SELECT event_id, p, round(least(min(q) OVER (ORDER BY p DESC RANGE UNBOUNDED PRECEDING), 1), 9) AS q FROM r""")
def _bh(spark, sf_dir):
    return T.correct_p_values(_pvals(spark, sf_dir)).withColumn("q", F.round("q", 9))


@register("correct_p_values_bonferroni", f"WITH {_P} SELECT event_id, p, round(least(p * count(*) OVER (), 1), 9) AS q FROM p")
def _bonferroni(spark, sf_dir):
    return T.correct_p_values(_pvals(spark, sf_dir), method="Bonferroni").withColumn("q", F.round("q", 9))


# the value at the last of 90 levels of the cubic through the shares is a fixed combination of the shares
_LEVELS = np.arange(90) / 100
_HAT = np.vander(_LEVELS, 4)[-1] @ np.linalg.pinv(np.vander(_LEVELS, 4))
_PI0 = " + ".join(f"({w!r}) * avg(CASE WHEN p > {a!r} THEN 1.0::DOUBLE ELSE 0 END) / {1 - a!r}" for w, a in zip(_HAT.tolist(), _LEVELS.tolist()))


@register("estimate_q_values", f"""WITH {_P}, f AS (SELECT CASE WHEN count(*) < 100 THEN 1 ELSE {_PI0} END AS f FROM p), g AS (SELECT CASE WHEN f > 1 OR f <= 0 THEN 1 ELSE f END AS pi0 FROM f),
k AS (SELECT *, count(*) OVER (ORDER BY p) AS rank, count(*) OVER () AS n FROM p), q AS (SELECT *, min(p * n / rank) OVER (ORDER BY p DESC) AS q FROM k)
SELECT event_id, p, round(least(least(q, 1) * pi0, 1), 9) AS q FROM q, g""")
def _q(spark, sf_dir):
    return T.estimate_q_values(_pvals(spark, sf_dir)).withColumn("q", F.round("q", 9))


@register("mid_ranks", "SELECT user_id, event_id, rank() OVER (PARTITION BY user_id ORDER BY round(CAST(value AS DOUBLE))) + (count(*) OVER (PARTITION BY user_id, round(CAST(value AS DOUBLE))) - 1) / 2.0::DOUBLE AS rank FROM events")
def _ranks(spark, sf_dir):
    e = fx.read(spark, sf_dir, "events").select("user_id", "event_id", F.round(F.col("value").cast("double")).alias("v"))
    return T.mid_ranks(e, ["user_id"], "v").select("user_id", "event_id", F.col("rank").cast("double").alias("rank"))


@register("kolmogorov_smirnov", f"""WITH {_E}, c AS (SELECT test, value, count(*) FILTER (label = 0) AS a, count(*) FILTER (label = 1) AS b FROM e GROUP BY ALL)
SELECT CAST(test AS BIGINT) AS test, round(max(d), 6) AS d FROM (SELECT test, abs(sum(a) OVER w / sum(a) OVER (PARTITION BY test) - sum(b) OVER w / sum(b) OVER (PARTITION BY test)) AS d FROM c WINDOW w AS (PARTITION BY test ORDER BY value)) GROUP BY test""")
def _ks(spark, sf_dir):
    return T.kolmogorov_smirnov(_groups(spark, sf_dir), ["test"], "label", "value", 0, 1).withColumn("d", F.round("d", 6))


@register("cramer_von_mises", f"""WITH {_E}, r AS (SELECT test, label, value, rank() OVER (PARTITION BY test ORDER BY value) + (count(*) OVER (PARTITION BY test, value) - 1) / 2.0::DOUBLE AS r, row_number() OVER (PARTITION BY test, label ORDER BY value) AS i FROM e)
SELECT CAST(test AS BIGINT) AS test, round(count(*) FILTER (label = 0) * sum((r - i) * (r - i)) FILTER (label = 0) + count(*) FILTER (label = 1) * sum((r - i) * (r - i)) FILTER (label = 1), 3) AS u FROM r GROUP BY test""")
def _cvm(spark, sf_dir):
    return T.cramer_von_mises(_groups(spark, sf_dir), ["test"], "label", "value", 0, 1).select("test", F.round("u", 3).alias("u"))


@register("complete_samples", f"""WITH {_E}, n AS (SELECT test, label, count(*) AS n FROM e GROUP BY ALL), m AS (SELECT test, max(n) AS most FROM n GROUP BY test) SELECT CAST(test AS BIGINT) AS test, most AS n FROM m, (VALUES (0), (1)) l(label)""")
def _complete(spark, sf_dir):
    c = T.complete_samples(_groups(spark, sf_dir), ["test"], "label", "value")
    return c.groupBy("test", "label").agg(F.count("*").alias("n")).select("test", "n")


@register("weights_from_percentiles", "WITH b AS (SELECT quantile_cont(CAST(value AS DOUBLE), [0.25, 0.5, 0.75, 1.0]) AS q FROM events) SELECT event_id, CAST(len(list_filter(q, lambda x: CAST(value AS DOUBLE) > x)) AS INTEGER) AS weight FROM events, b")
def _weights(spark, sf_dir):
    e = fx.read(spark, sf_dir, "events").select("event_id", F.col("value").cast("double").alias("value"))
    return T.weights_from_percentiles(e, "value").select("event_id", "weight")


@register("color_p_values", f"WITH {_P} SELECT event_id, round((0.5 - least(p, 0.5)) * CASE WHEN event_id % 2 = 1 THEN 1 ELSE 0 END, 9) AS red, round((0.5 - least(p, 0.5)) * CASE WHEN event_id % 2 = 1 THEN 0 ELSE 1 END, 9) AS green FROM p")
def _color(spark, sf_dir):
    p = _pvals(spark, sf_dir)
    red, green = T.color_p_values(F.col("p"), F.col("event_id") % 2, 0.5)
    return p.select("event_id", F.round(red, 9).alias("red"), F.round(green, 9).alias("green"))


@register("scalar_colors", "SELECT p_partkey, p_partkey % 256 AS r, (p_partkey * 7) % 256 AS g, (p_partkey * 13) % 256 AS b, lower(printf('#%02x%02x%02x', p_partkey % 256, (p_partkey * 7) % 256, (p_partkey * 13) % 256)) AS hex, (p_partkey % 256) * 65536 + ((p_partkey * 7) % 256) * 256 + (p_partkey * 13) % 256 AS lut FROM part")
def _colors(spark, sf_dir):
    p = fx.read(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % 256).alias("r"), (F.col("p_partkey") * 7 % 256).alias("g"), (F.col("p_partkey") * 13 % 256).alias("b"))
    return p.withColumn("hex", X.rgb_to_hex(F.col("r"), F.col("g"), F.col("b"))).withColumn("lut", X.rgb_to_lut(F.col("r"), F.col("g"), F.col("b")))


@register("scalar_hex_to_rgb", "SELECT p_partkey, CAST(p_partkey % 256 AS INTEGER) AS r FROM part")
def _hex(spark, sf_dir):
    p = fx.read(spark, sf_dir, "part").select("p_partkey", X.rgb_to_hex(F.col("p_partkey") % 256, F.lit(1), F.lit(2)).alias("h"))
    return p.select("p_partkey", X.hex_to_rgb(F.col("h"))[0].alias("r"))


@register("scalar_casts", "SELECT c_custkey, lower(replace(c_name, ' ', '_')) AS snake, TRY_CAST(c_name AS DOUBLE) AS number FROM customer")
def _casts(spark, sf_dir):
    return fx.read(spark, sf_dir, "customer").select("c_custkey", X.title_to_snake(F.col("c_name")).alias("snake"), X.ensure(F.col("c_name"), "double").alias("number"))


@register("resample_points", f"WITH {fx.POINTS_SQL} SELECT round(29 - x * 0.5::DOUBLE + 0.5::DOUBLE, 6) AS x, round(y * 2.0::DOUBLE, 6) AS y, round(z, 6) AS z FROM points")
def _points(spark, sf_dir):
    # 60 voxels become 30: the mirrored axis is n - 1 - x on the sink grid, 29 - x / 2
    out = P.resample_points(fx.points(spark, sf_dir).select("x", "y", "z"), (60, 12, 8), (30, 24, 8), (-1, 2, 3))
    return out.select(F.round(F.col("x") + 0.5, 6).alias("x"), F.round("y", 6).alias("y"), F.round("z", 6).alias("z"))


@register("resample_nearest", f"WITH {fx.VOX_SQL} SELECT vol_id, CAST(i AS INTEGER) AS x, CAST(j AS INTEGER) AS y, z, v FROM vox, range(8) a(i), range(2) b(j) WHERE x = i // 2 AND y = j * 2 + 1")
def _nearest(spark, sf_dir):
    return P.resample_nearest(fx.vox(spark, sf_dir), (4, 4, 4), (8, 2, 4)).select("vol_id", "x", "y", "z", "v")


@register("resample_area", f"WITH {fx.VOX_SQL} SELECT vol_id, CAST(x // 2 AS INTEGER) AS x, CAST(y // 2 AS INTEGER) AS y, CAST(z // 4 AS INTEGER) AS z, round(avg(v), 6) AS v FROM vox GROUP BY ALL")
def _area(spark, sf_dir):
    return P.resample_area(fx.vox(spark, sf_dir), (2, 2, 4)).withColumn("v", F.round("v", 6))


@register("resample_linear", f"WITH {fx.VOX_SQL} SELECT vol_id, CAST(x // 2 AS INTEGER) AS x, y, z, round(avg(v), 6) AS v FROM vox GROUP BY vol_id, x // 2, y, z")
def _linear(spark, sf_dir):
    return P.resample_linear(fx.vox(spark, sf_dir), (4, 4, 4), (2, 4, 4)).withColumn("v", F.round("v", 6))


@register("affine_points", f"WITH {fx.POINTS_SQL} SELECT 2 * x + y + 1 AS x, 3 * y AS y, z - 0.5::DOUBLE AS z FROM points")
def _affine(spark, sf_dir):
    return P.affine_points(fx.points(spark, sf_dir).select("x", "y", "z"), [[2, 1, 0], [0, 3, 0], [0, 0, 1]], [1, 0, -0.5])


@register("deformation_distance", f"WITH {fx.POINTS_SQL} SELECT x AS dx, y AS dy, z AS dz, round(sqrt(x * x + y * y * 4 + z * z), 6) AS distance FROM points")
def _deformation(spark, sf_dir):
    p = fx.points(spark, sf_dir).select(F.col("x").alias("dx"), F.col("y").alias("dy"), F.col("z").alias("dz"))
    return P.deformation_distance(p, (1.0, 2.0, 1.0)).withColumn("distance", F.round("distance", 6))


def _tiles(spark, sf_dir):
    k = F.col("p_partkey").cast("long")
    p = fx.read(spark, sf_dir, "part")
    lo = {"x": F.pmod(k, F.lit(20)) * 40, "y": F.floor(k / 20) % 20 * 40, "z": F.floor(k / 400) * 1000}
    return p.select(k.alias("tile"), *[c.alias(f"lo{a}") for a, c in lo.items()], *[(c + F.col("p_size").cast("long") + 10).alias(f"hi{a}") for a, c in lo.items()])


_TILES = "tiles AS (SELECT CAST(p_partkey AS BIGINT) AS tile, p_partkey % 20 * 40 AS lox, p_partkey // 20 % 20 * 40 AS loy, p_partkey // 400 * 1000 AS loz, p_partkey % 20 * 40 + p_size + 10 AS hix, p_partkey // 20 % 20 * 40 + p_size + 10 AS hiy, p_partkey // 400 * 1000 + p_size + 10 AS hiz FROM part)"
_PAIRS = f"{_TILES}, pairs AS (SELECT p.tile AS pre, q.tile AS post FROM tiles p JOIN tiles q ON p.tile < q.tile AND greatest(p.lox, q.lox) < least(p.hix, q.hix) AND greatest(p.loy, q.loy) < least(p.hiy, q.hiy) AND greatest(p.loz, q.loz) < least(p.hiz, q.hiz))"


@register("layout_overlaps", f"WITH {_PAIRS} SELECT pre, post FROM pairs")
def _overlaps(spark, sf_dir):
    return P.overlaps(_tiles(spark, sf_dir), 64).select("pre", "post")


def _alignments(spark, sf_dir):
    return P.overlaps(_tiles(spark, sf_dir), 64).select("pre", "post", *[(F.col("post") % (i + 3) - F.col("pre") % (i + 3)).cast("double").alias(f"d{a}") for i, a in enumerate("xyz")], (-(F.col("pre") + F.col("post")) % 10).cast("double").alias("quality"))


@register("layout_filter_alignments", f"WITH {_PAIRS} SELECT pre, post FROM pairs WHERE (-(pre + post)) % 10 > -5")
def _alignment_filter(spark, sf_dir):
    return P.filter_alignments(_alignments(spark, sf_dir), -5).select("pre", "post")


@register("layout_components", f"WITH RECURSIVE {_PAIRS}, b AS (SELECT pre AS s, post AS t FROM pairs UNION ALL SELECT post, pre FROM pairs), r(tile, c) AS (SELECT tile, tile FROM tiles UNION SELECT b.t, r.c FROM r JOIN b ON b.s = r.tile WHERE r.c < b.t) SELECT tile, min(c) AS component FROM r GROUP BY tile")
def _components(spark, sf_dir):
    return P.layout_components(_tiles(spark, sf_dir), _alignments(spark, sf_dir))


@register("layout_positions_from_tree", f"""WITH RECURSIVE {_PAIRS}, b AS (SELECT pre AS s, post AS t FROM pairs UNION ALL SELECT post, pre FROM pairs),
r(tile, steps) AS (SELECT CAST(21 AS BIGINT), 0 UNION SELECT b.t, r.steps + 1 FROM r JOIN b ON b.s = r.tile WHERE r.steps < 80)
SELECT tile, CAST(tile % 3 - 21 % 3 AS DOUBLE) AS x, CAST(tile % 4 - 21 % 4 AS DOUBLE) AS y, CAST(tile % 5 - 21 % 5 AS DOUBLE) AS z, CAST(min(steps) AS INTEGER) AS steps FROM r GROUP BY tile""")
def _tree(spark, sf_dir):
    return P.positions_from_tree(_alignments(spark, sf_dir), 21)


@register("layout_positions_from_optimization", f"""WITH RECURSIVE {_PAIRS}, b AS (SELECT pre AS s, post AS t FROM pairs UNION ALL SELECT post, pre FROM pairs), r(tile, c) AS (SELECT tile, tile FROM tiles UNION SELECT b.t, r.c FROM r JOIN b ON b.s = r.tile WHERE r.c < b.t),
c AS (SELECT tile, min(c) AS component FROM r GROUP BY tile) SELECT tile, component, round(CAST(tile % 3 - component % 3 AS DOUBLE), 4) + 0 AS x FROM c""")
def _optimization(spark, sf_dir):
    out = P.positions_from_optimization(_tiles(spark, sf_dir), _alignments(spark, sf_dir))
    return out.select("tile", "component", (F.round("x", 4) + 0.0).alias("x"))


def _stitched(method, sql, digits=None):
    base = f"WITH {fx.VOX_SQL}, t AS (SELECT vol_id AS tile, x + vol_id * 3 AS x, y, z, v, least(least(x, 3 - x), least(y, 3 - y), least(z, 3 - z)) + 1 AS w FROM vox)"

    def run(spark, sf_dir):
        v = fx.vox(spark, sf_dir).withColumnRenamed("vol_id", "tile")
        p = v.select("tile").distinct().select("tile", (F.col("tile") * 3.0).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"))
        out = P.stitch(v, p, method, (4, 4, 4))
        return out.withColumn("v", F.round("v", digits)) if digits else out

    register(f"stitch_{method}", f"{base} SELECT CAST(x AS INTEGER) AS x, y, z, {sql} AS v FROM t GROUP BY ALL")(run)


_stitched("max", "max(v)")
_stitched("min", "min(v)")
_stitched("mean", "round(avg(v), 6)", 6)
_stitched("interpolation", "round(sum(v * w)::DOUBLE / sum(w), 6)", 6)


@register("flatfield_line_polynomial")
def _line_polynomial(spark, sf_dir):
    li = fx.read(spark, sf_dir, "lineitem").select(F.col("l_quantity").cast("int").alias("x"), F.col("l_extendedprice").cast("double").alias("y"))
    return L.flatfield_line_from_regression(li).withColumn("f", F.round("f", 4))


@register("flatfield_line_gaussian")
def _line_gaussian(spark, sf_dir):
    counts = fx.vox(spark, sf_dir).groupBy(F.col("v").alias("x")).agg(F.count("*").alias("y"))
    return L.flatfield_line_from_regression(counts, "gaussian", reverse=True).withColumn("f", F.round("f", 4))
