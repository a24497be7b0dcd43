"""Assignment of positions between steps, and trajectories."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.components import connected_components
from tessera.plans.scratch import Scratch


def assign(cost: np.ndarray) -> list[tuple[int, int]]:
    """Cheapest one-to-one assignment of rows to columns (rows <= columns), by shortest augmenting paths with potentials."""
    n, m = cost.shape
    u, v, match = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, dtype=int)
    for i in range(1, n + 1):
        match[0], at = i, 0
        least, prev, used = np.full(m + 1, np.inf), np.zeros(m + 1, dtype=int), np.zeros(m + 1, dtype=bool)
        while True:
            used[at] = True
            row = match[at]
            free = ~used
            free[0] = False
            slack = cost[row - 1] - u[row] - v[1:]
            better = free[1:] & (slack < least[1:])
            least[1:][better], prev[1:][better] = slack[better], at
            j = int(np.flatnonzero(free)[np.argmin(least[free])])
            step = least[j]
            u[match[used]] += step
            v[used] -= step
            least[~used] -= step
            at = j
            if match[at] == 0:
                break
        while at:
            match[at], at = match[prev[at]], prev[at]
    return [(int(match[j]) - 1, j - 1) for j in range(1, m + 1) if match[j]]


def match_points(pre: np.ndarray, post: np.ndarray, new_cost: float, cutoff: float | None = None) -> list[tuple[int, int]]:
    """Pairs of the cheapest matching by distance, where ending or starting a trajectory costs ``new_cost``; pairs beyond ``cutoff`` are forbidden."""
    n, m = len(pre), len(post)
    if not n or not m:
        return []
    d = np.sqrt(((pre[:, None, :] - post[None, :, :]) ** 2).sum(-1))
    big = 1e12
    if cutoff is not None:
        d = np.where(d > cutoff, big, d)
    c = np.zeros((n + m, n + m))
    c[:n, :m] = d
    c[:n, m:] = np.where(np.eye(n, dtype=bool), new_cost, big)
    c[n:, :m] = np.where(np.eye(m, dtype=bool), new_cost, big)
    return [(i, j) for i, j in assign(c) if i < n and j < m and d[i, j] < big]


def match_steps(positions: DataFrame, new_cost: float, cutoff: float | None = None) -> DataFrame:
    """key, t, pre, post: matched point ids of steps t and t + 1. positions: key, t, id, x, y, z. One pair of steps per group."""
    both = positions.withColumn("_t", F.explode(F.array(F.col("t") - 1, F.col("t"))))

    def run(df: pd.DataFrame) -> pd.DataFrame:
        t = df["_t"].iloc[0]
        a, b = df[df["t"] == t].sort_values("id"), df[df["t"] == t + 1].sort_values("id")
        pairs = match_points(a[["x", "y", "z"]].to_numpy(float), b[["x", "y", "z"]].to_numpy(float), new_cost, cutoff)
        return pd.DataFrame({"key": [df["key"].iloc[0]] * len(pairs), "t": [t] * len(pairs), "pre": [a["id"].iloc[i] for i, _ in pairs], "post": [b["id"].iloc[j] for _, j in pairs]}).astype({"t": "int64", "pre": "int64", "post": "int64"})

    return both.groupBy("key", "_t").applyInPandas(run, "key bigint, t bigint, pre bigint, post bigint")


def track(positions: DataFrame, new_cost: float, cutoff: float | None = None) -> DataFrame:
    """positions with trajectory: chains of matches as connected components (point ids are unique)."""
    scratch = Scratch(positions.sparkSession, "track")
    links = scratch.save(match_steps(positions, new_cost, cutoff), "links")
    found = connected_components(links.select(F.col("pre").alias("a"), F.col("post").alias("b")), scratch)
    return positions.join(found.withColumnRenamed("node", "id"), "id", "left").withColumn("trajectory", F.coalesce("component", "id")).drop("component")
