"""Curves fitted to intensities along an axis, by least squares over the mean of each position; only sums leave the tasks."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.plans.scratch import Scratch


@dataclass(frozen=True)
class LineFit:
    """polynomial: a + b (x - m)^2 + c (x - m)^4 + d (x - m)^6, parameters m, a, b, c, d. gaussian: a exp(-(x - m)^2 / (2 s)) + b, parameters a, m, s, b."""

    method: str
    parameters: tuple[float, ...]
    low: float
    high: float

    def column(self, x: str | Column) -> Column:
        x = F.col(x) if isinstance(x, str) else x
        p = self.parameters
        if self.method == "gaussian":
            return p[0] * F.exp(-(x - p[1]) * (x - p[1]) / (2 * p[2])) + p[3]
        r = (x - p[0]) * (x - p[0])
        return p[1] + r * (p[2] + r * (p[3] + r * p[4]))


def fit_line(points: DataFrame, method: str = "polynomial", x: str = "x", y: str = "y") -> LineFit:
    """Fit of y by x. Every position counts once, by the mean of its values; rows with nulls count for nothing. Fewer positions than parameters give one of the curves through them
    (polynomial) or an error (gaussian); no position is an error."""
    method = method.lower()
    if method not in ("polynomial", "gaussian"):
        raise ValueError(f"unknown method {method}")
    given = points.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).filter("x is not null and y is not null")
    means = Scratch(points.sparkSession, "line").save(given.groupBy("x").agg(F.avg("y").alias("y")), "means")
    low, high, n, least, most = means.agg(F.min("x"), F.max("x"), F.count("*"), F.min("y"), F.max("y")).first()
    if not n:
        raise ValueError("no position to fit to")
    middle, half = (low + high) / 2, (high - low) / 2 or 1.0
    u = means.select(((F.col("x") - middle) / half).alias("u"), "y")  # -1 to 1
    if method == "polynomial":
        m, a, b, c, d = _polynomial(u)
        return LineFit(method, (middle + half * m, a, b / half**2, c / half**4, d / half**6), low, high)
    if n < 4:
        raise ValueError(f"{n} positions for 4 parameters")
    a, m, s, b = _gaussian(u, least, most)
    return LineFit(method, (a, middle + half * m, s * half**2, b), low, high)


def _polynomial(points: DataFrame) -> tuple[float, ...]:
    """One pass: power sums tell the least squares of every centre m; the best m is searched on a grid and then by bisection."""
    u, y = F.col("u"), F.col("y")
    row = points.agg(*[F.sum(F.pow(u, k)) for k in range(13)], *[F.sum(y * F.pow(u, k)) for k in range(7)], F.sum(y * y)).first()
    powers = np.array([[row[i + j] for j in range(7)] for i in range(7)])
    right, square = np.array(row[13:20]), row[20]

    def solve(m: float) -> tuple[float, np.ndarray]:
        rows = np.zeros((4, 7))
        for k in range(4):
            rows[k, : 2 * k + 1] = [math.comb(2 * k, j) * (-m) ** (2 * k - j) for j in range(2 * k + 1)]
        best = np.linalg.lstsq(rows @ powers @ rows.T, rows @ right, rcond=1e-13)[0]
        return square - 2 * best @ rows @ right + best @ rows @ powers @ rows.T @ best, best

    grid = np.linspace(-1.5, 1.5, 601)
    at = grid[int(np.argmin([solve(m)[0] for m in grid]))]
    step = grid[1] - grid[0]
    while step > 1e-9:
        at = min((at - step, at, at + step), key=lambda m: solve(m)[0])
        step /= 2
    return (float(at), *map(float, solve(at)[1]))


def _gaussian(points: DataFrame, least: float, most: float, rounds: int = 100) -> tuple[float, ...]:
    """Damped Gauss-Newton steps (a, m, log s, b): a round's sums in one pass, the best of several dampings in another."""
    u, y = F.col("u"), F.col("y")
    w = y - least
    total, first, second = points.agg(F.sum(w), F.sum(w * u), F.sum(w * u * u)).first()
    m = first / total if total else 0.0
    p = np.array([most - least, m, math.log(max(second / total - m * m, 1e-4) if total else 1.0), least])

    def model(p) -> tuple[Column, Column]:
        e = F.exp(-(u - p[1]) * (u - p[1]) / (2 * math.exp(p[2])))
        return float(p[0]) * e + float(p[3]), e

    damping = 1e-3
    cost = points.agg(F.sum((y - model(p)[0]) ** 2)).first()[0]
    for _ in range(rounds):
        value, e = model(p)
        s = math.exp(p[2])
        slope = [e, float(p[0]) * e * (u - float(p[1])) / s, float(p[0]) * e * (u - float(p[1])) * (u - float(p[1])) / (2 * s), F.lit(1.0)]
        pairs = [(i, j) for i in range(4) for j in range(i, 4)]
        row = points.agg(*[F.sum(slope[i] * slope[j]) for i, j in pairs], *[F.sum(g * (y - value)) for g in slope]).first()
        h = np.zeros((4, 4))
        for (i, j), v in zip(pairs, row):
            h[i, j] = h[j, i] = v
        dampings = [damping * k for k in (1e-4, 1e-2, 1.0, 1e2, 1e4, 1e8)]
        tries = [p + np.linalg.lstsq(h + d * np.diag(np.diag(h) + 1e-12), np.array(row[10:]), rcond=None)[0] for d in dampings]
        for t in tries:
            t[2] = np.clip(t[2], -20, 20)
        costs = points.agg(*[F.sum((y - model(t)[0]) ** 2) for t in tries]).first()
        best = int(np.argmin([c if math.isfinite(c) else math.inf for c in costs]))
        if not costs[best] < cost:
            break
        small = cost - costs[best] <= 1e-14 * cost and np.abs(tries[best] - p).max() < 1e-9
        p, cost, damping = tries[best], costs[best], min(max(dampings[best], 1e-10), 1e4)
        if small:
            break
    return float(p[0]), float(p[1]), math.exp(p[2]), float(p[3])


def flatfield_line_from_regression(points: DataFrame, method: str = "polynomial", x: str = "x", y: str = "y", reverse: bool = False) -> DataFrame:
    """x, f: the fitted intensity at each position; ``reverse`` takes the fit from the mirrored place."""
    fit = fit_line(points, method, x, y)
    places = points.select(F.col(x).alias("x")).filter(F.col("x").isNotNull()).distinct()
    at = F.col("x").cast("double")
    return places.select("x", fit.column(fit.low + fit.high - at if reverse else at).alias("f"))
