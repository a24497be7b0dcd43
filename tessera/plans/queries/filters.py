"""Convolution, derivative, code and ordered-window queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import convolve as K
from tessera.operators import ordered as O
from tessera.plans import fixtures as fx
from tessera.registry import register

_V = f"WITH {fx.VOX_SQL}"
_N = f"WITH {fx.NEIGHBOURS_SQL}"


@register("correlate1d", f"{_V} SELECT c.vol_id, c.x, c.y, c.z, round(sum(n.v * CASE n.x - c.x WHEN -1 THEN 1.0::DOUBLE WHEN 0 THEN 2.0 ELSE 3.0 END), 6) AS v FROM vox c JOIN vox n ON n.vol_id = c.vol_id AND n.y = c.y AND n.z = c.z AND abs(n.x - c.x) <= 1 GROUP BY ALL")
def _correlate1d(spark, sf_dir):
    return K.correlate1d(fx.vox(spark, sf_dir), [1.0, 2.0, 3.0], "x").withColumn("v", F.round("v", 6))


@register("correlate3d_mean", f"{_N} SELECT vol_id, x, y, z, round(sum(v) / 27.0::DOUBLE, 6) AS v FROM nb GROUP BY vol_id, x, y, z")
def _mean(spark, sf_dir):
    return K.correlate(fx.vox(spark, sf_dir), K.filter_kernel("mean", (3, 3, 3))).withColumn("v", F.round("v", 6))


_DOG = K.filter_kernel("dog", (3, 3, 3))
_DOG_AT = " ".join(f"WHEN dx = {i - 1} AND dy = {j - 1} AND dz = {k - 1} THEN {float(_DOG[i, j, k])!r}::DOUBLE" for i in range(3) for j in range(3) for k in range(3))


@register("dog_filter", f"{_N} SELECT vol_id, x, y, z, round(greatest(sum(v * CASE {_DOG_AT} END), 0), 6) + 0 AS v FROM nb GROUP BY vol_id, x, y, z")
def _dog(spark, sf_dir):
    return K.dog_filter(fx.vox(spark, sf_dir), (3, 3, 3)).withColumn("v", F.round("v", 6) + 0.0)


@register("convolve_points", f"{_N} SELECT vol_id, x, y, z, CAST(sum(v) AS DOUBLE) AS v FROM nb WHERE g > 115 GROUP BY vol_id, x, y, z")
def _points(spark, sf_dir):
    v = fx.vox(spark, sf_dir)
    return K.convolve_points(v, v.filter("v > 115"), K.cube((3, 3, 3)))


@register("convolve_points_smaller", f"{_N} SELECT vol_id, x, y, z, sum(v) < 1200 AS v FROM nb WHERE g > 115 GROUP BY vol_id, x, y, z")
def _smaller(spark, sf_dir):
    v = fx.vox(spark, sf_dir)
    return K.convolve_points(v, v.filter("v > 115"), K.cube((3, 3, 3)), 1200)


_G = ", ".join(f"coalesce(lead(v) OVER (PARTITION BY vol_id, {b}, {c} ORDER BY {a}) - v, 0) AS g{a}" for a, b, c in (("x", "y", "z"), ("y", "x", "z"), ("z", "x", "y")))


@register("gradient", f"{_V} SELECT vol_id, x, y, z, v, {_G} FROM vox")
def _gradient(spark, sf_dir):
    return K.gradient(fx.vox(spark, sf_dir))


@register("gradient_abs", f"{_V}, g AS (SELECT vol_id, x, y, z, {_G} FROM vox) SELECT vol_id, x, y, z, abs(gx) + abs(gy) + abs(gz) AS v FROM g")
def _abs(spark, sf_dir):
    return K.gradient_abs(fx.vox(spark, sf_dir))


@register("gradient_square", f"{_V}, g AS (SELECT vol_id, x, y, z, {_G} FROM vox) SELECT vol_id, x, y, z, gx * gx + gy * gy + gz * gz AS v FROM g")
def _square(spark, sf_dir):
    return K.gradient_square(fx.vox(spark, sf_dir))


def _at(dx, dy, dz):
    return f"(SELECT 1) IS NOT NULL AND n.x = least(greatest(c.x + {dx}, 0), 3) AND n.y = least(greatest(c.y + {dy}, 0), 3) AND n.z = least(greatest(c.z + {dz}, 0), 3)"


@register("hessian_xx", f"""{_V} SELECT c.vol_id, c.x, c.y, c.z, CAST(a.v - 2 * c.v + b.v AS DOUBLE) AS xx FROM vox c
JOIN vox a ON a.vol_id = c.vol_id AND a.x = least(c.x + 1, 3) AND a.y = c.y AND a.z = c.z JOIN vox b ON b.vol_id = c.vol_id AND b.x = greatest(c.x - 1, 0) AND b.y = c.y AND b.z = c.z""")
def _hessian(spark, sf_dir):
    return K.hessian(fx.vox(spark, sf_dir)).select("vol_id", "x", "y", "z", F.col("v")[0].alias("xx"))


@register("hessian_trace_by_eigenvalues", f"""{_V} SELECT c.vol_id, c.x, c.y, c.z, CAST(round(sum(n.v) - 6 * c.v, 3) AS DOUBLE) AS trace FROM vox c JOIN (SELECT * FROM (VALUES (1,0,0),(-1,0,0),(0,1,0),(0,-1,0),(0,0,1),(0,0,-1)) o(dx,dy,dz)) o ON true
JOIN vox n ON n.vol_id = c.vol_id AND n.x = least(greatest(c.x + dx, 0), 3) AND n.y = least(greatest(c.y + dy, 0), 3) AND n.z = least(greatest(c.z + dz, 0), 3) GROUP BY c.vol_id, c.x, c.y, c.z, c.v""")
def _eigen(spark, sf_dir):
    return K.eigenvalues(fx.vox(spark, sf_dir)).select("vol_id", "x", "y", "z", (F.round(F.col("v")[0] + F.col("v")[1] + F.col("v")[2], 3) + 0.0).alias("trace"))


@register("tubeness")
def _tubeness(spark, sf_dir):
    return K.tubeness(fx.vox(spark, sf_dir))


@register("lambda123")
def _lambda(spark, sf_dir):
    return K.lambda123(fx.vox(spark, sf_dir))


@register("remove_background", f"""WITH {fx.VOX_SQL}, e AS (SELECT c.vol_id, c.x, c.y, c.z, min(n.v) AS v FROM vox c JOIN vox n ON n.vol_id = c.vol_id AND n.z = c.z AND abs(n.x - c.x) <= 1 AND abs(n.y - c.y) <= 1 GROUP BY ALL),
o AS (SELECT c.vol_id, c.x, c.y, c.z, max(n.v) AS v FROM e c JOIN e n ON n.vol_id = c.vol_id AND n.z = c.z AND abs(n.x - c.x) <= 1 AND abs(n.y - c.y) <= 1 GROUP BY ALL)
SELECT v.vol_id, v.x, v.y, v.z, CAST(v.v - least(v.v, o.v) AS DOUBLE) AS v FROM vox v JOIN o ON o.vol_id = v.vol_id AND o.x = v.x AND o.y = v.y AND o.z = v.z""")
def _background(spark, sf_dir):
    return K.remove_background(fx.vox(spark, sf_dir), (3, 3), "Cube")


@register("local_max", f"{_N} SELECT vol_id, x, y, z, CAST(g AS DOUBLE) AS v FROM nb GROUP BY vol_id, x, y, z, g HAVING g = max(v) AND g >= 110")
def _local_max(spark, sf_dir):
    return K.local_max(fx.vox(spark, sf_dir), 3, 110)


@register("cube_codes", f"{_N} SELECT vol_id, x, y, z, CAST(sum(CASE WHEN v > 100 THEN 1 << ((dx + 1) + 3 * (dy + 1) + 9 * (dz + 1)) ELSE 0 END) AS BIGINT) AS v FROM nb GROUP BY vol_id, x, y, z")
def _codes(spark, sf_dir):
    return K.cube_codes(fx.vox(spark, sf_dir).withColumn("v", F.greatest(F.col("v") - 100, F.lit(0))))


def _series(spark, sf_dir):
    return fx.read(spark, sf_dir, "events").select("user_id", "event_id", F.col("value").cast("double").alias("value"), ((F.col("event_id") % 4) != 0).alias("valid"))


_W = O.window_weights(5, "hamming")
_LEADS = " + ".join(f"{k!r}::DOUBLE * CASE WHEN i + ({j - 2}) < 1 THEN f WHEN i + ({j - 2}) > n THEN l ELSE lead(value, {j - 2}) OVER w END" for j, k in enumerate(_W))
_SERIES = "s AS (SELECT user_id, event_id, CAST(value AS DOUBLE) AS value, event_id % 4 <> 0 AS valid FROM events)"


@register("smooth_window", f"""WITH {_SERIES}, t AS (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY user_id) AS n, first(value) OVER u AS f, last(value) OVER u AS l FROM s
WINDOW w AS (PARTITION BY user_id ORDER BY event_id), u AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT user_id, event_id, round({_LEADS}, 6) AS smooth FROM t WINDOW w AS (PARTITION BY user_id ORDER BY event_id)""")
def _smooth(spark, sf_dir):
    return O.smooth(_series(spark, sf_dir), ["user_id"], "event_id", "value", 5, "hamming").select("user_id", "event_id", F.round("smooth", 6).alias("smooth"))


@register("runs", f"""WITH {_SERIES}, c AS (SELECT *, CASE WHEN lag(valid) OVER (PARTITION BY user_id ORDER BY event_id) IS NOT DISTINCT FROM valid THEN 0 ELSE 1 END AS c FROM s)
SELECT user_id, event_id, CAST(sum(c) OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS run FROM c""")
def _runs(spark, sf_dir):
    return O.runs(_series(spark, sf_dir), ["user_id"], "event_id", "valid").select("user_id", "event_id", "run")


def _valid_sql(length: int, window: str) -> str:
    weights = O.window_weights(length, window)
    leads = " + ".join(f"{k!r}::DOUBLE * CASE WHEN i + ({j - length // 2}) < 1 THEN f WHEN i + ({j - length // 2}) > n THEN l ELSE lead(value, {j - length // 2}) OVER w END" for j, k in enumerate(weights))
    return f"""WITH {_SERIES}, c AS (SELECT *, CASE WHEN lag(valid) OVER (PARTITION BY user_id ORDER BY event_id) IS NOT DISTINCT FROM valid THEN 0 ELSE 1 END AS c FROM s),
r AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM c),
t AS (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY user_id, run) AS n, first(value) OVER u AS f, last(value) OVER u AS l FROM r
WINDOW w AS (PARTITION BY user_id, run ORDER BY event_id), u AS (PARTITION BY user_id, run ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT user_id, event_id, CASE WHEN valid THEN {leads} ELSE value END AS smooth FROM t WINDOW w AS (PARTITION BY user_id, run ORDER BY event_id)"""


@register("smooth_valid", _valid_sql(3, "bartlett"))
def _smooth_valid(spark, sf_dir):
    return O.smooth_valid(_series(spark, sf_dir), ["user_id"], "event_id", "value", "valid", 3).select("user_id", "event_id", "smooth")


@register("smooth_valid_wide", f"SELECT user_id, event_id, round(smooth, 6) AS smooth FROM ({_valid_sql(6, 'blackman')})")
def _smooth_valid_wide(spark, sf_dir):
    return O.smooth_valid(_series(spark, sf_dir), ["user_id"], "event_id", "value", "valid", 6, "blackman").select("user_id", "event_id", F.round("smooth", 6).alias("smooth"))


@register("smooth_binary")
def _smooth_binary(spark, sf_dir):
    e = _series(spark, sf_dir).select("user_id", "event_id", F.floor(F.col("value") / 150).cast("double").alias("step"))
    return O.smooth_binary(e, ["user_id"], "event_id", "step", 3).select("user_id", "event_id", "smooth")


@register("interpolate_gaps", f"""WITH {_SERIES}, k AS (SELECT *, last_value(CASE WHEN valid THEN event_id END IGNORE NULLS) OVER b AS ao, last_value(CASE WHEN valid THEN value END IGNORE NULLS) OVER b AS av,
first_value(CASE WHEN valid THEN event_id END IGNORE NULLS) OVER a AS bo, first_value(CASE WHEN valid THEN value END IGNORE NULLS) OVER a AS bv FROM s
WINDOW b AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT user_id, event_id, round(CASE WHEN valid THEN value WHEN ao IS NOT NULL AND bo IS NOT NULL THEN av + (bv - av) * (event_id - ao) / (bo - ao) ELSE coalesce(av, bv) END, 6) AS filled FROM k""")
def _gaps(spark, sf_dir):
    return O.interpolate_gaps(_series(spark, sf_dir), ["user_id"], "event_id", "value", "valid").select("user_id", "event_id", F.round("filled", 6).alias("filled"))


@register("best_shifts", "SELECT user_id, arg_min(event_id, (CAST(value AS DOUBLE), event_id)) AS shift, -min(CAST(value AS DOUBLE)) AS quality FROM events GROUP BY user_id")
def _shifts(spark, sf_dir):
    return O.best_shifts(_series(spark, sf_dir).select("user_id", F.col("event_id").alias("shift"), F.col("value").alias("error")), ["user_id"])


@register("local_minima", "SELECT user_id, shift, error FROM (SELECT user_id, event_id AS shift, CAST(value AS DOUBLE) AS error, min(CAST(value AS DOUBLE)) OVER (PARTITION BY user_id ORDER BY event_id RANGE BETWEEN 50 PRECEDING AND 50 FOLLOWING) AS m FROM events) WHERE error = m")
def _minima(spark, sf_dir):
    return O.local_minima(_series(spark, sf_dir).select("user_id", F.col("event_id").alias("shift"), F.col("value").alias("error")), ["user_id"], 50)


@register("interpolate_1d", """WITH k AS (SELECT user_id AS key, CAST(event_id AS DOUBLE) AS x, CAST(value AS DOUBLE) AS y FROM events WHERE event_id % 4 <> 0), q AS (SELECT user_id AS key, CAST(event_id AS DOUBLE) AS x FROM events WHERE event_id % 4 = 0)
SELECT q.key, q.x, round(CASE WHEN a.x IS NULL THEN b.y WHEN b.x IS NULL THEN a.y ELSE a.y + (b.y - a.y) * (q.x - a.x) / (b.x - a.x) END, 6) AS y
FROM q LEFT JOIN LATERAL (SELECT x, y FROM k WHERE k.key = q.key AND k.x <= q.x ORDER BY x DESC LIMIT 1) a ON true LEFT JOIN LATERAL (SELECT x, y FROM k WHERE k.key = q.key AND k.x >= q.x ORDER BY x LIMIT 1) b ON true""")
def _interpolate(spark, sf_dir):
    s = _series(spark, sf_dir).select(F.col("user_id").alias("key"), F.col("event_id").cast("double").alias("x"), F.col("value").alias("y"), "valid")
    return O.interpolate_1d(s.filter("valid").drop("valid"), s.filter("not valid").select("key", "x")).withColumn("y", F.round("y", 6))
