"""Rank filters over the volumes of the embeddings table."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators.rank import rank_filter
from tessera.plans import fixtures as fx
from tessera.registry import register

#: Bins in these queries; the volumes' values are below.
BINS = 256

_SORTED = "list(v ORDER BY v)"
_BAND = "(SELECT {f} FROM (SELECT unnest(s) AS q) WHERE (SELECT count(*) FROM (SELECT unnest(s) AS r) WHERE r <= q) BETWEEN {p0} * n AND {p1} * n)"

#: name: (parameters, aggregate over v with the centre g, result type)
_SQL: dict[str, tuple[dict, str, str]] = {
    "autolevel": ({}, f"CASE WHEN max(v) > min(v) THEN {BINS - 1} * (g - min(v)) // (max(v) - min(v)) ELSE 0 END", "BIGINT"),
    "bottomhat": ({}, "g - min(v)", "BIGINT"),
    "tophat": ({}, "max(v) - g", "BIGINT"),
    "equalize": ({}, f"{BINS - 1} * count(*) FILTER (v <= g) // count(*)", "BIGINT"),
    "gradient": ({}, "max(v) - min(v)", "BIGINT"),
    "mean": ({}, "sum(v) // count(*)", "BIGINT"),
    "geometric_mean": ({}, "round(exp(avg(ln(v + 1))) - 1)", "BIGINT"),
    "subtract_mean": ({}, "round((g - avg(v)) / 2 + 127, 6)", "DOUBLE"),
    "median": ({}, f"{_SORTED}[count(*) // 2 + 1]", "BIGINT"),
    "maximum": ({}, "max(v)", "BIGINT"),
    "minimum": ({}, "min(v)", "BIGINT"),
    "enhance_contrast": ({}, "CASE WHEN max(v) - g < g - min(v) THEN max(v) ELSE min(v) END", "BIGINT"),
    "pop": ({}, "count(*)", "BIGINT"),
    "sum": ({}, "sum(v)", "BIGINT"),
    "threshold": ({}, "CASE WHEN g * count(*) > sum(v) THEN 1 ELSE 0 END", "BIGINT"),
    "noise_filter": ({}, "min(abs(v - g)) FILTER (dx <> 0 OR dy <> 0 OR dz <> 0)", "BIGINT"),
    "entropy": ({}, "round(entropy(v), 6)", "DOUBLE"),
    "std": ({}, "round(stddev_pop(v), 6)", "DOUBLE"),
    "percentile": ({"p0": 0.25}, f"{_SORTED}[CAST(greatest(1, ceil(0.25 * count(*))) AS BIGINT)]", "BIGINT"),
    "gradient_percentile": ({"p0": 0.1, "p1": 0.9}, f"{_SORTED}[CAST(greatest(1, ceil(0.9 * count(*))) AS BIGINT)] - {_SORTED}[CAST(greatest(1, ceil(0.1 * count(*))) AS BIGINT)]", "BIGINT"),
    "threshold_percentile": ({"p0": 0.75}, f"{BINS - 1} * CAST(g >= {_SORTED}[CAST(greatest(1, ceil(0.75 * count(*))) AS BIGINT)] AS BIGINT)", "BIGINT"),
    "mean_bilateral": ({"s0": 12, "s1": 9}, "coalesce(sum(v) FILTER (g > v - 12 AND g < v + 9) // count(*) FILTER (g > v - 12 AND g < v + 9), 0)", "BIGINT"),
    "pop_bilateral": ({"s0": 12, "s1": 9}, "count(*) FILTER (g > v - 12 AND g < v + 9)", "BIGINT"),
    "sum_bilateral": ({"s0": 12, "s1": 9}, "coalesce(sum(v) FILTER (g >= v - 12 AND g <= v + 9), 0)", "BIGINT"),
    "sum_relative_bilateral": ({"s0": 0.5, "s1": 1.5}, "round(coalesce(sum(v) FILTER (v >= trunc(g * 0.5) AND v < trunc(g * 1.5 + 1)), 0) / greatest(trunc(g * 1.5 + 1) - trunc(g * 0.5), 1), 6)", "DOUBLE"),
    "mean_scale_bilateral": ({"p0": 10, "q0": 0.1, "p1": 5, "q1": 0.0}, "coalesce(min(v) FILTER (v > g - (10 + g * 0.1::DOUBLE) AND v <= g + 5 + 1), 0)", "BIGINT"),
    "nilblack": ({"k": 0.2}, "round(avg(v) + 0.2::DOUBLE * stddev_pop(v), 6)", "DOUBLE"),
    "sauvola": ({"k": 0.2, "r": 128.0}, "round(avg(v) * (1 + 0.2::DOUBLE * (stddev_pop(v) / 128.0::DOUBLE - 1)), 6)", "DOUBLE"),
}


def _query(name: str, parameters: dict, kind: str):
    def run(spark, sf_dir):
        out = rank_filter(fx.vox(spark, sf_dir), name, max_bin=BINS, **parameters)
        return out.withColumn("v", F.round("v", 6)) if kind == "DOUBLE" else out

    return run


for _name, (_parameters, _expr, _kind) in _SQL.items():
    register(f"rank_{_name}", f"WITH {fx.NEIGHBOURS_SQL} SELECT vol_id, x, y, z, CAST({_expr} AS {_kind}) AS v FROM nb GROUP BY vol_id, x, y, z, g")(_query(_name, _parameters, _kind))


@register("rank_modal", f"""WITH {fx.NEIGHBOURS_SQL}, c AS (SELECT vol_id, x, y, z, v, count(*) AS n FROM nb GROUP BY ALL)
SELECT vol_id, x, y, z, CAST(first(v ORDER BY n DESC, v) AS BIGINT) AS v FROM c GROUP BY vol_id, x, y, z""")
def _modal(spark, sf_dir):
    return rank_filter(fx.vox(spark, sf_dir), "modal", max_bin=BINS)


@register("rank_minmax", f"WITH {fx.NEIGHBOURS_SQL} SELECT vol_id, x, y, z, CAST(min(v) AS BIGINT) AS low, CAST(max(v) AS BIGINT) AS high FROM nb GROUP BY vol_id, x, y, z")
def _minmax(spark, sf_dir):
    return rank_filter(fx.vox(spark, sf_dir), "minmax", max_bin=BINS).select("vol_id", "x", "y", "z", F.col("v")[0].alias("low"), F.col("v")[1].alias("high"))


_CUMULATIVE = f"""WITH {fx.NEIGHBOURS_SQL}, c AS (
  SELECT vol_id, x, y, z, g, v, count(*) OVER (PARTITION BY vol_id, x, y, z ORDER BY v RANGE UNBOUNDED PRECEDING) AS upto, count(*) OVER (PARTITION BY vol_id, x, y, z) AS n FROM nb)"""


def _banded(name: str, expr: str, kind: str) -> None:
    register(f"rank_{name}", f"{_CUMULATIVE} SELECT vol_id, x, y, z, CAST({expr} AS {kind}) AS v FROM c GROUP BY vol_id, x, y, z, g")(_query(name, {"p0": 0.2, "p1": 0.8}, kind))


_IN = "FILTER (upto >= 0.2::DOUBLE * n AND upto <= 0.8::DOUBLE * n)"
_banded("mean_percentile", f"coalesce(sum(v) {_IN} // count(*) {_IN}, 0)", "BIGINT")
_banded("pop_percentile", f"count(*) {_IN}", "BIGINT")
_banded("sum_percentile", f"coalesce(sum(v) {_IN}, 0)", "BIGINT")
_banded("subtract_mean_percentile", f"round(coalesce((g - avg(v) {_IN} + {BINS}) / 2, 0), 6)", "DOUBLE")


@register("rank_otsu", f"""WITH {fx.NEIGHBOURS_SQL}, c AS (
  SELECT vol_id, x, y, z, v, count(*) OVER w AS c, sum(v) OVER w AS s, count(*) OVER k AS n, sum(v) OVER k AS t FROM nb
  WINDOW k AS (PARTITION BY vol_id, x, y, z), w AS (PARTITION BY vol_id, x, y, z ORDER BY v RANGE UNBOUNDED PRECEDING)),
o AS (SELECT *, CASE WHEN c < n THEN CAST(c * (n - c) AS DOUBLE) * ((CAST(s AS DOUBLE) / c - CAST(t - s AS DOUBLE) / (n - c)) * (CAST(s AS DOUBLE) / c - CAST(t - s AS DOUBLE) / (n - c))) ELSE -1 END AS score FROM c)
SELECT vol_id, x, y, z, CAST(CASE WHEN max(score) > 0 THEN first(v ORDER BY score DESC, v) ELSE 0 END AS BIGINT) AS v FROM o GROUP BY vol_id, x, y, z""")
def _otsu(spark, sf_dir):
    return rank_filter(fx.vox(spark, sf_dir), "otsu", max_bin=BINS)


@register("rank_contrast_limited_percentile")
def _contrast(spark, sf_dir):
    return rank_filter(fx.vox(spark, sf_dir), "contrast_limited_percentile", max_bin=BINS)


@register("rank_light_sheet_artifact_correction")
def _light(spark, sf_dir):
    return rank_filter(fx.vox(spark, sf_dir), "light_sheet_artifact_correction", max_bin=BINS)


@register("rank_autolevel_percentile", f"""WITH {fx.NEIGHBOURS_SQL}, b AS (SELECT vol_id, x, y, z, g, {_SORTED}[CAST(floor(0.1 * count(*)) AS BIGINT) + 1] AS lo, {_SORTED}[CAST(greatest(1, ceil(0.9 * count(*))) AS BIGINT)] AS hi FROM nb GROUP BY vol_id, x, y, z, g)
SELECT vol_id, x, y, z, CAST(CASE WHEN hi > lo THEN {BINS - 1} * (least(greatest(g, lo), hi) - lo) // (hi - lo) ELSE 0 END AS BIGINT) AS v FROM b""")
def _autolevel(spark, sf_dir):
    return rank_filter(fx.vox(spark, sf_dir), "autolevel_percentile", max_bin=BINS, p0=0.1, p1=0.9)


@register("rank_enhance_contrast_percentile", f"""WITH {fx.NEIGHBOURS_SQL}, b AS (SELECT vol_id, x, y, z, g, {_SORTED}[CAST(greatest(1, ceil(0.1 * count(*))) AS BIGINT)] AS lo, {_SORTED}[CAST(greatest(1, ceil(0.9 * count(*))) AS BIGINT)] AS hi FROM nb GROUP BY vol_id, x, y, z, g)
SELECT vol_id, x, y, z, CAST(CASE WHEN hi - g < g - lo THEN hi ELSE lo END AS BIGINT) AS v FROM b""")
def _enhance(spark, sf_dir):
    return rank_filter(fx.vox(spark, sf_dir), "enhance_contrast_percentile", max_bin=BINS, p0=0.1, p1=0.9)


@register("rank_sum_above_percentile", f"""{_CUMULATIVE}, b AS (SELECT vol_id, x, y, z, g, min(v) FILTER (upto >= 0.5::DOUBLE * n) AS bar, list(v) AS vs FROM c GROUP BY vol_id, x, y, z, g)
SELECT vol_id, x, y, z, CAST(CASE WHEN g <= bar THEN g ELSE coalesce(list_sum(list_filter(vs, lambda q: q > bar)), 0) END AS BIGINT) AS v FROM b""")
def _above(spark, sf_dir):
    return rank_filter(fx.vox(spark, sf_dir), "sum_above_percentile", max_bin=BINS, p0=0.5)


@register("rank_histogram_entropy_check", f"WITH {fx.NEIGHBOURS_SQL} SELECT vol_id, x, y, z, CAST(count(DISTINCT v) AS BIGINT) AS bins FROM nb GROUP BY vol_id, x, y, z")
def _histogram(spark, sf_dir):
    h = rank_filter(fx.vox(spark, sf_dir), "histogram", max_bin=BINS)
    return h.select("vol_id", "x", "y", "z", F.size(F.filter("v", lambda p: p > 0)).cast("long").alias("bins"))
