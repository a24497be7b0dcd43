"""Statistics of group comparisons: t-tests, corrections for multiple tests, two-sample tests, p-value colors.

Means and variances are native aggregates. The Student t and normal tails are
vectorised Arrow functions of one column (numpy only).
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.plans.scratch import Scratch


def _log_gamma(x: np.ndarray) -> np.ndarray:
    return np.array([math.lgamma(a) for a in np.atleast_1d(x)])


def incomplete_beta(a: np.ndarray, b: float, x: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta function by its continued fraction (modified Lentz), vectorised."""
    a, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(x, float))
    flip = x > (a + 1) / (a + b + 2)
    p, q, y = np.where(flip, b, a), np.where(flip, a, b), np.where(flip, 1 - x, x)
    y = np.clip(y, 1e-300, 1 - 1e-16)
    front = np.exp(_log_gamma(p + q).reshape(p.shape) - _log_gamma(p.ravel()).reshape(p.shape) - _log_gamma(q.ravel()).reshape(p.shape) + p * np.log(y) + q * np.log1p(-y)) / p
    tiny = 1e-300
    c = np.ones_like(y)
    d = 1 / np.where(np.abs(1 - (p + q) * y / (p + 1)) < tiny, tiny, 1 - (p + q) * y / (p + 1))
    h = d.copy()
    for m in range(1, 300):
        for num in (m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + num / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            h = h * d * c
        if np.all(np.abs(d * c - 1) < 1e-14):
            break
    out = front * h
    return np.where(flip, 1 - out, out)


def _t_tail(t: pd.Series, df: pd.Series) -> pd.Series:
    t_, n = t.to_numpy(float), df.to_numpy(float)
    ok = np.isfinite(t_) & np.isfinite(n) & (n > 0)
    out = np.full(len(t_), np.nan)
    if ok.any():
        out[ok] = incomplete_beta(n[ok] / 2, 0.5, n[ok] / (n[ok] + t_[ok] ** 2))
    out[np.isinf(t_) & (n > 0)] = 0.0
    return pd.Series(out)


def t_p_value(t: Column, df: Column) -> Column:
    """Two-sided p of Student's t."""
    f = F.pandas_udf(_t_tail, "double")
    return f(t, df)


def t_test(df: DataFrame, keys: list[str], group: str, value: str, first, second, equal_var: bool = False, signed: bool = False, p_cutoff: float | None = None) -> DataFrame:
    """keys, means, deviations, t and p of two groups' values per key: Welch, or with ``equal_var`` the pooled form.

    p that is not a number becomes 1 and t becomes 0; p is clipped to ``p_cutoff``;
    ``signed`` adds p_sign (-1 where t < 0, else 1).
    """
    part = lambda g, f: f(F.when(F.col(group) == g, F.col(value)))
    agg = df.groupBy(*keys).agg(*[part(g, f).alias(f"{n}{i}") for i, g in ((1, first), (2, second)) for n, f in (("m", F.avg), ("v", F.var_samp), ("n", F.count))])
    m1, m2, v1, v2, n1, n2 = (F.col(c) for c in ("m1", "m2", "v1", "v2", "n1", "n2"))
    if equal_var:
        dof = (n1 + n2 - 2).cast("double")
        se2 = ((n1 - 1) * v1 + (n2 - 1) * v2) / dof * (1 / n1 + 1 / n2)
    else:
        a, b = v1 / n1, v2 / n2
        se2 = a + b
        dof = F.when(se2 > 0, se2 * se2 / (a * a / (n1 - 1) + b * b / (n2 - 1)))
    t = F.when(se2 > 0, (m1 - m2) / F.sqrt(se2))
    out = agg.withColumns({"t": t, "df": dof}).withColumn("p", t_p_value(F.coalesce("t", F.lit(float("nan"))), F.coalesce("df", F.lit(float("nan")))))
    bad = F.isnan("p") | F.col("p").isNull()
    out = out.withColumns({"t": F.when(bad, 0.0).otherwise(F.col("t")), "p": F.when(bad, 1.0).otherwise(F.col("p"))})
    if p_cutoff is not None:
        out = out.withColumn("p", F.least("p", F.lit(p_cutoff)))
    if signed:
        out = out.withColumn("p_sign", F.when(F.col("t") < 0, -1).otherwise(1))
    return out.select(*keys, "m1", "m2", F.sqrt("v1").alias("sd1"), F.sqrt("v2").alias("sd2"), "t", "p", *(["p_sign"] if signed else []))


#: Ranges that a single family of p-values is cut into.
RANGES = 256


def correct_p_values(df: DataFrame, p: str = "p", method: str = "BH", keys: list[str] | None = None) -> DataFrame:
    """df with q: Benjamini-Hochberg or Bonferroni within ``keys``. A null p has a null q and is not counted.

    Without keys all rows are one family of any size: see ``_correct_one_family``. With keys a family is one window.
    """
    if method not in ("BH", "Bonferroni"):
        raise ValueError(f"unknown method {method}")
    if not keys:
        return _correct_one_family(df, p, method)
    n = F.count(p).over(Window.partitionBy(*keys))
    if method == "Bonferroni":
        return df.withColumn("q", F.least(F.col(p) * n, F.when(F.col(p).isNotNull(), 1.0)))
    up = Window.partitionBy(*keys).orderBy(p)
    out = df.withColumn("_r", F.rank().over(up) + F.count(p).over(Window.partitionBy(*keys, p)) - 1 - F.count_if(F.col(p).isNull()).over(Window.partitionBy(*keys)))
    out = out.withColumn("_q", F.col(p) * n / F.col("_r"))
    down = Window.partitionBy(*keys).orderBy(F.desc(p)).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return out.withColumn("q", F.when(F.col(p).isNotNull(), F.least(F.min("_q").over(down), F.lit(1.0)))).drop("_r", "_q")


def _correct_one_family(df: DataFrame, p: str, method: str) -> DataFrame:
    """Equal values are counted first, then cut into ``RANGES`` ranges of about equally many distinct values. Ranks and minima run inside
    each range; what the ranges add to one another is a table of that many rows."""
    if method == "Bonferroni":
        n = df.select(F.count(p)).first()[0]
        return df.withColumn("q", F.when(F.col(p).isNotNull(), F.least(F.col(p) * n, F.lit(1.0))))
    values = Scratch(df.sparkSession, "p-values").save(df.filter(F.col(p).isNotNull()).groupBy(F.col(p).cast("double").alias("_p")).agg(F.count("*").alias("_k")), "values")
    cuts = values.agg(F.percentile_approx("_p", [i / RANGES for i in range(1, RANGES)], 10_000)).first()[0] or []
    bounds = F.array(*[F.lit(c) for c in sorted(set(cuts))]) if cuts else F.array().cast("array<double>")
    ranged = values.withColumn("_b", F.size(F.filter(bounds, lambda c: c < F.col("_p"))))
    sizes = ranged.groupBy("_b").agg(F.sum("_k").alias("_size"))  # at most RANGES rows, so these two windows are small
    before = sizes.select("_b", (F.sum("_size").over(Window.orderBy("_b")) - F.col("_size")).alias("_before"), F.sum("_size").over(Window.partitionBy()).alias("_n"))
    inside = ranged.join(F.broadcast(before), "_b").withColumn("_r", F.col("_before") + F.sum("_k").over(Window.partitionBy("_b").orderBy("_p")))
    scored = inside.withColumn("_q", F.col("_p") * F.col("_n") / F.col("_r"))
    after = Window.orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1)
    later = scored.groupBy("_b").agg(F.min("_q").alias("_least")).select("_b", F.min("_least").over(after).alias("_later"))
    up = Window.partitionBy("_b").orderBy(F.desc("_p"))
    done = scored.withColumn("_m", F.min("_q").over(up)).join(F.broadcast(later), "_b")
    done = done.select("_p", F.least("_m", "_later", F.lit(1.0)).alias("q"))
    return df.withColumn("_p", F.col(p).cast("double")).drop("q").join(done, "_p", "left").drop("_p")


def estimate_q_values(df: DataFrame, p: str = "p", pi0: float | None = None) -> DataFrame:
    """Storey q-values. pi0, the share of true null tests, is 1 below 100 tests, else a cubic through the shares of p above 90 levels (one aggregate row), taken at the last level."""
    if pi0 is None:
        lam = [i / 100 for i in range(90)]
        row = df.agg(F.count(p), *[F.avg((F.col(p) > a).cast("double")) for a in lam]).first()
        if row[0] < 100:
            pi0 = 1.0
        else:
            shares = np.array([(row[i + 1] or 0.0) / (1 - a) for i, a in enumerate(lam)])
            fit = float(np.polyval(np.polyfit(np.array(lam), shares, 3), lam[-1]))
            pi0 = 1.0 if fit > 1 or fit <= 0 else fit
    return correct_p_values(df, p).withColumn("q", F.least(F.col("q") * pi0, F.lit(1.0)))


def mid_ranks(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """df with rank: the average rank of equal values."""
    w = Window.partitionBy(*keys).orderBy(value)
    return df.withColumn("rank", F.rank().over(w) + (F.count("*").over(Window.partitionBy(*keys, value)) - 1) / 2)


def cramer_von_mises(df: DataFrame, keys: list[str], group: str, value: str, first, second) -> DataFrame:
    """keys, u, t, z, p of the two-sample Cramer-von Mises test (midranks, normal approximation)."""
    both = df.filter(F.col(group).isin([first, second]) & F.col(value).isNotNull())
    r = mid_ranks(both, keys, value)
    w = Window.partitionBy(*keys, group).orderBy(value, "rank")
    r = r.withColumn("_i", F.row_number().over(w))
    part = lambda g, c: F.sum(F.when(F.col(group) == g, c))
    sq = (F.col("rank") - F.col("_i")) * (F.col("rank") - F.col("_i"))
    a = r.groupBy(*keys).agg(part(first, F.lit(1)).alias("n"), part(second, F.lit(1)).alias("m"), part(first, sq).alias("s1"), part(second, sq).alias("s2"))
    n, m = F.col("n").cast("double"), F.col("m").cast("double")
    a = a.withColumn("u", n * F.col("s1") + m * F.col("s2"))
    a = a.withColumn("t", F.col("u") / (n * m * (n + m)) - (4 * n * m - 1) / (6 * (n + m)))
    mean = (1 + 1 / (n + m)) / 6
    var = (n + m + 1) * (4 * n * m * (n + m) - 3 * (n * n + m * m) - 2 * n * m) / (45 * (n + m) * (n + m) * 4 * n * m)
    a = a.withColumn("z", (F.col("t") - mean) / F.sqrt(var))
    tail = F.pandas_udf(_normal_tail, "double")
    return a.select(*keys, "u", "t", "z", F.least(2 * tail(F.abs("z")), F.lit(1.0)).alias("p"))


def _normal_tail(z: pd.Series) -> pd.Series:
    return pd.Series([0.5 * math.erfc(a / math.sqrt(2)) if a == a else math.nan for a in z])


def kolmogorov_smirnov(df: DataFrame, keys: list[str], group: str, value: str, first, second) -> DataFrame:
    """keys, d: the largest distance of the two groups' cumulative shares."""
    both = df.filter(F.col(group).isin([first, second]) & F.col(value).isNotNull())
    c = both.groupBy(*keys, value).agg(F.count_if(F.col(group) == first).alias("a"), F.count_if(F.col(group) == second).alias("b"))
    w = Window.partitionBy(*keys).orderBy(value)
    whole = Window.partitionBy(*keys)
    d = F.abs(F.sum("a").over(w) / F.sum("a").over(whole) - F.sum("b").over(w) / F.sum("b").over(whole))
    return c.withColumn("_d", d).groupBy(*keys).agg(F.max("_d").alias("d"))


def complete_samples(df: DataFrame, keys: list[str], group: str, value: str, offset: float = 1.0, inverted: bool = False) -> DataFrame:
    """Smaller groups padded to the largest group's size with the maximum plus ``offset`` (``inverted``: of the negated values)."""
    v = -F.col(value) if inverted else F.col(value)
    rows = df.select(*keys, group, v.alias(value))
    n = rows.groupBy(*keys, group).agg(F.count("*").alias("n"))
    top = rows.groupBy(*keys).agg(F.max(value).alias("top"))
    most = n.groupBy(*keys).agg(F.max("n").alias("most"))
    pad = n.join(most, keys).join(top, keys).filter("n < most").select(*keys, group, (F.col("top") + offset).alias(value), F.explode(F.sequence(F.lit(1).cast("long"), F.col("most") - F.col("n"))).alias("_i")).drop("_i")
    return rows.unionByName(pad)


def color_p_values(p: Column, sign: Column, p_max: float, positive=(1, 0), negative=(0, 1)) -> list[Column]:
    """One channel each: (p_max - p) times the color of the sign."""
    return [(F.lit(p_max) - F.least(p, F.lit(p_max))) * F.when(sign > 0, a).otherwise(b) for a, b in zip(positive, negative)]


def weights_from_percentiles(df: DataFrame, value: str, percentiles=(25, 50, 75, 100)) -> DataFrame:
    """df with weight: how many of the percentile bars the value exceeds (one aggregate row, broadcast)."""
    bars = df.agg(F.percentile(value, F.array(*[F.lit(p / 100) for p in percentiles])).alias("_bars"))
    return df.crossJoin(F.broadcast(bars)).withColumn("weight", F.size(F.filter("_bars", lambda b: F.col(value) > b))).drop("_bars")


def drop_empty_regions(df: DataFrame, means: tuple[str, str] = ("m1", "m2")) -> DataFrame:
    """Rows where neither group's mean is 0 or missing."""
    keep = F.lit(True)
    for c in means:
        keep = keep & F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.col(c) != 0)
    return df.filter(keep)
