"""One-dimensional ordered operators: smoothing, gap filling, arg-min shifts; native windows per key."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Slice states.
ISOLATED, INVALID, VALID, FIXED, MEASURED, UNALIGNED = -2, -1, 0, 1, 0, -3


def window_weights(length: int, window: str = "bartlett") -> list[float]:
    """flat, bartlett, hanning, hamming or blackman weights that sum to 1 (flat if all are 0)."""
    n = max(length, 1)
    x = [2 * math.pi * i / max(n - 1, 1) for i in range(n)]
    w = {
        "flat": [1.0] * n,
        "bartlett": [1 - abs(2 * i / max(n - 1, 1) - 1) for i in range(n)],
        "hanning": [0.5 - 0.5 * math.cos(a) for a in x],
        "hamming": [0.54 - 0.46 * math.cos(a) for a in x],
        "blackman": [0.42 - 0.5 * math.cos(a) + 0.08 * math.cos(2 * a) for a in x],
    }.get(window)
    if w is None:
        raise ValueError(f"unknown window {window}")
    total = sum(w)
    return [a / total for a in w] if total > 0 else [1 / n] * n


def smooth(df: DataFrame, keys: list[str], order: str, value: str, length: int = 10, window: str = "bartlett") -> DataFrame:
    """``value`` smoothed along ``order`` within keys; rows beyond an end repeat the end's value."""
    weights = window_weights(length, window)
    half = length // 2
    w = Window.partitionBy(*keys).orderBy(order)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first, last = F.first(value).over(whole), F.last(value).over(whole)
    n, i = F.count(F.lit(1)).over(whole), F.row_number().over(w)
    total: Column = F.lit(0.0)
    for j, k in enumerate(weights):
        d = j - half
        v = F.lead(value, d).over(w) if d > 0 else (F.lag(value, -d).over(w) if d < 0 else F.col(value))
        total = total + F.lit(k) * F.when(F.col("_i") + d < 1, F.col("_first")).when(F.col("_i") + d > F.col("_n"), F.col("_last")).otherwise(v)
    return df.withColumns({"_first": first, "_last": last, "_n": n, "_i": i}).withColumn("smooth", total).drop("_first", "_last", "_n", "_i")


def smooth_binary(df: DataFrame, keys: list[str], order: str, value: str, width: int = 1) -> DataFrame:
    """``smooth``: both ends of ``width`` + 1 rows take their median; then stretches between two equal rows at most that far apart take their value, from the widest to the narrowest and along the order.

    What a step changes the next one sees, so a key (a line of slices) is one group; null values belong to no line and stay null."""
    kept = [c for c in df.columns if c != "smooth"]
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in kept)

    def line(part):
        part = part.sort_values(order)
        here = part[value].notna().to_numpy()
        x = part.loc[here, value].to_numpy(dtype=float)
        span = min(width + 1, len(x))
        if len(x):
            x[:span] = np.median(x[:span])
            x[-span:] = np.median(x[-span:])
        for w in range(span, 1, -1):
            for i in range(len(x) - w):
                if x[i] == x[i + w]:
                    x[i : i + w] = x[i]
        out = np.full(len(part), np.nan)
        out[here] = x
        part = part[kept].assign(smooth=pd.Series(out, index=part.index).astype("Float64"))
        part["smooth"] = part["smooth"].where(here, pd.NA)
        return part

    return df.groupBy(*keys).applyInPandas(line, f"{kinds}, smooth double")


def runs(df: DataFrame, keys: list[str], order: str, flag: str) -> DataFrame:
    """Gaps and islands: run number of consecutive rows with the same flag."""
    w = Window.partitionBy(*keys).orderBy(order)
    change = F.when(F.lag(flag).over(w).eqNullSafe(F.col(flag)), 0).otherwise(1)
    return df.withColumn("_c", change).withColumn("run", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_c")


def smooth_valid(df: DataFrame, keys: list[str], order: str, value: str, valid: str, length: int = 10, window: str = "bartlett") -> DataFrame:
    """smooth within each run of valid rows; invalid rows keep their value."""
    out = smooth(runs(df, keys, order, valid), [*keys, "run"], order, value, length, window)
    return out.withColumn("smooth", F.when(F.col(valid), F.col("smooth")).otherwise(F.col(value)))


def interpolate_gaps(df: DataFrame, keys: list[str], order: str, value: str, valid: str, borders: bool = True, digits: int | None = None) -> DataFrame:
    """Rows that are not valid get the linear interpolation between the nearest valid rows, a copy at one-sided ends
    (with ``borders``), and null where a key has no valid row."""
    w = Window.partitionBy(*keys).orderBy(order)
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    known = F.when(F.col(valid), F.struct(F.col(order).alias("o"), F.col(value).alias("v")))
    out = df.withColumn("_k", known).withColumn("_a", F.last("_k", ignorenulls=True).over(back)).withColumn("_b", F.first("_k", ignorenulls=True).over(ahead))
    line = F.col("_a.v") + (F.col("_b.v") - F.col("_a.v")) * (F.col(order) - F.col("_a.o")) / (F.col("_b.o") - F.col("_a.o"))
    side = F.coalesce("_a.v", "_b.v") if borders else F.lit(None)
    value_ = F.when(F.col(valid), F.col(value)).when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), line).otherwise(side)
    return out.withColumn("filled", F.round(value_, digits) if digits is not None else value_).drop("_k", "_a", "_b")


def best_shifts(errors: DataFrame, keys: list[str]) -> DataFrame:
    """keys, shift of the least error (ties: smallest shift), quality = -error. ``errors``: keys, shift, error."""
    return errors.groupBy(*keys).agg(F.min(F.struct("error", "shift")).alias("m")).select(*keys, F.col("m.shift").alias("shift"), (-F.col("m.error")).alias("quality"))


def local_minima(errors: DataFrame, keys: list[str], distance: int = 1) -> DataFrame:
    """Rows whose error is the least within ``distance`` places of their shift."""
    w = Window.partitionBy(*keys).orderBy("shift").rangeBetween(-distance, distance)
    return errors.withColumn("_m", F.min("error").over(w)).filter("error = _m").drop("_m")


def interpolate_1d(knots: DataFrame, at: DataFrame, extrapolation: str = "constant") -> DataFrame:
    """x, y of the piecewise linear curve through ``knots`` (x, y); outside constant or linear.

    One merged order of knots and questions, so no join on ranges. The curve is one
    key: give many curves a ``key`` column in both tables.
    """
    keys = ["key"] if "key" in knots.columns else []
    k = knots.withColumn("_k", F.struct("x", "y")).select(*keys, "x", "_k", F.lit(0).alias("_ask"))
    a = at.select(*keys, "x", F.lit(None).cast(k.schema["_k"].dataType).alias("_k"), F.lit(1).alias("_ask"))
    w = Window.partitionBy(*keys).orderBy("x", "_ask")
    v = Window.partitionBy(*keys).orderBy(F.desc("x"), "_ask")
    nxt = lambda n: F.nth_value("_k", n, ignoreNulls=True)
    out = k.unionByName(a).withColumn("_a", F.last("_k", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_b", F.last("_k", ignorenulls=True).over(v.rowsBetween(Window.unboundedPreceding, 0)))
    if extrapolation == "linear":
        whole = Window.partitionBy(*keys).orderBy("x").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        rev = Window.partitionBy(*keys).orderBy(F.desc("x")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        out = out.withColumns({"_f1": nxt(1).over(whole), "_f2": nxt(2).over(whole), "_l1": nxt(1).over(rev), "_l2": nxt(2).over(rev)})
        out = out.withColumn("_p", F.when(F.col("_a").isNull(), F.col("_f1")).when(F.col("_b").isNull(), F.col("_l2")).otherwise(F.col("_a"))).withColumn("_q", F.when(F.col("_a").isNull(), F.col("_f2")).when(F.col("_b").isNull(), F.col("_l1")).otherwise(F.col("_b")))
    else:
        out = out.withColumn("_p", F.coalesce("_a", "_b")).withColumn("_q", F.coalesce("_b", "_a"))
    y = F.when(F.col("_p.x") == F.col("_q.x"), F.col("_p.y")).otherwise(F.col("_p.y") + (F.col("_q.y") - F.col("_p.y")) * (F.col("x") - F.col("_p.x")) / (F.col("_q.x") - F.col("_p.x")))
    return out.filter("_ask = 1").select(*keys, "x", y.alias("y"))
