"""Values against brute force: line measures, local thresholds, rank filters of histograms, fitted lines, stitched overlaps, colors of layouts, smoothed steps."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.functions import fits as L
from tessera.operators import convolve as K
from tessera.operators import morphology as M
from tessera.operators import ordered as O
from tessera.operators import spatial as P

RNG = np.random.default_rng(11)


def _vox(spark, a, vol=0):
    i = np.indices(a.shape).reshape(3, -1)
    return spark.createDataFrame(pd.DataFrame({"vol_id": vol, **{c: v.astype(np.int32) for c, v in zip("xyz", i)}, "v": a.ravel()}))


def _array(df, shape):
    out = np.full(shape, np.nan)
    for r in df.collect():
        assert np.isnan(out[r.x, r.y, r.z])
        out[r.x, r.y, r.z] = r.v
    return out


def _eigenvalues(a):
    """Of second differences with repeated borders, a voxel at a time, descending."""
    at = lambda p: a[tuple(np.clip(p, 0, np.array(a.shape) - 1))]
    out = np.zeros((*a.shape, 3))
    unit = np.eye(3, dtype=int)
    for p in np.ndindex(a.shape):
        h = np.zeros((3, 3))
        for i in range(3):
            for j in range(3):
                if i == j:
                    h[i, i] = at(p + unit[i]) - 2 * a[p] + at(p - unit[i])
                else:
                    h[i, j] = (at(p + unit[i] + unit[j]) - at(p + unit[i] - unit[j]) - at(p - unit[i] + unit[j]) + at(p - unit[i] - unit[j])) / 4
        out[p] = sorted(np.linalg.eigvalsh(h), reverse=True)
    return out


@pytest.mark.parametrize("block", [(3, 4, 2), (16, 16, 16)])
def test_line_measures(spark, block):
    a = RNG.normal(size=(7, 6, 5)) * 10
    e = _eigenvalues(a)
    e1, e2, e3 = np.moveaxis(e, -1, 0)
    both = (e2 < 0) & (e3 < 0)
    tube = np.where(both, np.sqrt(np.abs(e2 * e3)), 0)
    assert both.sum() > 20
    assert np.allclose(_array(K.tubeness(_vox(spark, a), block=block), a.shape), tube)
    assert np.array_equal(_array(K.tubeness(_vox(spark, a), 12.0, block), a.shape), tube > 12)
    for g12, g23, alpha in ((1.0, 1.0, 0.25), (0.5, 2.0, 0.4)):
        want = np.zeros(a.shape)
        for p in np.ndindex(a.shape):
            if both[p]:
                tail = 1 + e1[p] / abs(e2[p]) if e1[p] <= 0 else 1 - alpha * e1[p] / abs(e2[p])
                want[p] = abs(e3[p]) * (e2[p] / e3[p]) ** g23 * tail**g12 if tail > 0 else 0
        assert np.allclose(_array(K.lambda123(_vox(spark, a), g12, g23, alpha, block), a.shape), want)


def _percentiles(a, share, selem, spacing):
    """Values at the centres of a grid, then interpolated voxel by voxel."""
    n = [(max(s - 1 - p // 2, 0)) // p + 1 for s, p in zip(a.shape, spacing)]
    grid = np.zeros(n)
    for c in np.ndindex(*n):
        low = [i * p + p // 2 - w // 2 for i, p, w in zip(c, spacing, selem)]
        grid[c] = np.quantile(a[tuple(slice(max(b, 0), max(b + w, 0)) for b, w in zip(low, selem))], share)
    out = np.zeros(a.shape)
    for p in np.ndindex(a.shape):
        t = [min(max((x - s // 2) / s, 0), m - 1) for x, s, m in zip(p, spacing, n)]
        for c in np.ndindex(*n):
            out[p] += grid[c] * np.prod([max(0, 1 - abs(x - y)) for x, y in zip(t, c)])
    return out


def test_lightsheet_and_local_equalisation(spark):
    a = RNG.integers(0, 300, (9, 7, 5)).astype(float)
    got = _array(M.correct_lightsheet(_vox(spark, a), 0.25, (5, 1, 1), (4, 4, 3), (3, 2, 2), 1.5), a.shape)
    l, b = _percentiles(a, 0.25, (5, 1, 1), (1, 1, 1)), _percentiles(a, 0.25, (4, 4, 3), (3, 2, 2))  # noqa: E741
    assert np.allclose(got, a - np.minimum(a, np.minimum(l, 1.5 * b)))
    got = _array(M.equalize_local(_vox(spark, a), 0.5, 0.9, 1.5, (4, 4, 3), (3, 2, 2)), a.shape)
    p0, p1 = _percentiles(a, 0.5, (4, 4, 3), (3, 2, 2)), _percentiles(a, 0.9, (4, 4, 3), (3, 2, 2))
    f = 1 / np.maximum(p0, 1)
    assert np.allclose(got, a * np.where(p1 * f > 1.5, 1.5 / p1, f)) and (p1 * f > 1.5).any() and (p1 * f < 1.5).any()


def test_polynomial_line(spark):
    x = np.repeat(np.arange(40.0, 140.0), 3)
    f = lambda x: 500 + 0.3 * (x - 83.7) ** 2 - 1e-4 * (x - 83.7) ** 4 + 2e-8 * (x - 83.7) ** 6
    points = spark.createDataFrame(pd.DataFrame({"x": x, "y": f(x) + np.tile([-5.0, 0.0, 5.0], 100)})).unionByName(spark.createDataFrame([(50.0, None), (None, 1e9)], "x double, y double"))
    fit = L.fit_line(points)
    assert np.allclose(fit.parameters, (83.7, 500, 0.3, -1e-4, 2e-8), rtol=1e-4)
    noisy = pd.DataFrame({"x": np.arange(60.0), "y": 100 + RNG.normal(size=60) * 20 + (np.arange(60) - 22.0) ** 2})
    fit = L.fit_line(spark.createDataFrame(noisy))
    cost = lambda m: np.linalg.lstsq(np.stack([((noisy.x - m) / 30) ** k for k in (0, 2, 4, 6)], 1), noisy.y, rcond=None)[1][0]
    p = fit.parameters
    own = sum((noisy.y - sum(c * (noisy.x - p[0]) ** k for c, k in zip(p[1:], (0, 2, 4, 6)))) ** 2)
    assert own <= min(cost(m) for m in np.linspace(-10, 70, 2000)) * (1 + 1e-6)


def test_gaussian_line(spark):
    x = np.arange(200.0)
    points = spark.createDataFrame(pd.DataFrame({"x": x, "y": 900 * np.exp(-((x - 70) ** 2) / (2 * 400)) + 50}))
    fit = L.fit_line(points, "Gaussian")
    assert np.allclose(fit.parameters, (900, 70, 400, 50), rtol=1e-5)
    rows = {r.x: r.f for r in L.flatfield_line_from_regression(points, "gaussian", reverse=True).collect()}
    assert len(rows) == 200 and all(abs(rows[199 - k] - (900 * np.exp(-((k - 70) ** 2) / 800) + 50)) < 1e-3 for k in range(200))
    for bad in (points.limit(0), points.limit(2)):
        with pytest.raises(ValueError):
            L.fit_line(bad, "gaussian")
    with pytest.raises(ValueError):
        L.fit_line(points, "spline")


def test_overlaps_keep_their_largest_value(spark):
    shape, places = (6, 5, 4), {0: (0, 0, 0), 1: (4, 0, 0), 2: (2, 3, 0)}
    tiles = {t: RNG.integers(0, 100, shape).astype(float) for t in places}
    vox = None
    for t, a in tiles.items():
        rows = _vox(spark, a).drop("vol_id").withColumn("tile", F.lit(t))
        vox = rows if vox is None else vox.unionByName(rows)
    positions = spark.createDataFrame([(t, *map(float, p)) for t, p in places.items()], "tile int, x double, y double, z double")
    at: dict = {}
    for t, a in tiles.items():
        for p in np.ndindex(shape):
            w = 1 + min(min(i, n - 1 - i) for i, n in zip(p, shape))
            at.setdefault(tuple(np.add(p, places[t])), []).append((t, a[p], w))
    mean = {p: sum(v * w for _, v, w in e) / sum(w for *_, w in e) for p, e in at.items()}
    region = {p: tuple(sorted(t for t, *_ in e)) for p, e in at.items()}
    most = {r: max(v for p, e in at.items() if region[p] == r for _, v, _ in e) / max(mean[p] for p in at if region[p] == r) for r in set(region.values())}
    got = {(r.x, r.y, r.z): r.v for r in P.stitch_adjusted(vox, positions, shape).collect()}
    assert got.keys() == mean.keys() and all(abs(got[p] - mean[p] * most[region[p]]) < 1e-9 for p in got) and len(most) >= 5


def test_colors_of_a_layout(spark):
    boxes = [(10 * i - (i % 2) * 3, 8 * j, 0, 10 * i + 12, 8 * j + 10, 5) for i in range(4) for j in range(3)]
    tiles = spark.createDataFrame([(t, *b) for t, b in enumerate(boxes)], "tile bigint, lox int, loy int, loz int, hix int, hiy int, hiz int")
    colors = {r.tile: r for r in P.layout_coloring(tiles, 16).collect()}
    meet = [(i, j) for i, a in enumerate(boxes) for j, b in enumerate(boxes) if i < j and all(max(a[k], b[k]) < min(a[k + 3], b[k + 3]) for k in range(3))]
    assert len(meet) > 12 and len(colors) == 12 and all(colors[i].color != colors[j].color and (colors[i].red, colors[i].green, colors[i].blue) != (colors[j].red, colors[j].green, colors[j].blue) for i, j in meet)
    for t in range(12):  # the first free color in the order of tiles
        assert colors[t].color == min(set(range(13)) - {colors[i].color for i, j in meet if j == t})
    apart = P.layout_coloring(tiles.filter("tile in (0, 11)"), 16, [(0.1, 0.2, 0.3)]).collect()
    assert {(r.color, r.red, r.green, r.blue) for r in apart} == {(0, 0.1, 0.2, 0.3)}


def _steps(x, width):
    x = list(x)
    w = min(width + 1, len(x))
    head, tail = float(np.median(x[:w])), None
    x = [head] * w + x[w:]
    tail = float(np.median(x[len(x) - w :]))
    x = x[: len(x) - w] + [tail] * w
    while w > 1:
        for s in range(len(x) - w):
            if x[s] == x[s + w]:
                for k in range(s, s + w):
                    x[k] = x[s]
        w -= 1
    return x


@pytest.mark.parametrize("width", [1, 3, 50])
def test_steps_are_smoothed(spark, width):
    lines = {k: RNG.integers(0, 3, n).astype(float) for k, n in enumerate((1, 2, 5, 40, 60))}
    rows = [(k, i, float(v)) for k, x in lines.items() for i, v in enumerate(x)] + [(9, 0, None), (9, 1, None), (8, 0, 1.0), (8, 1, None), (8, 2, 1.0)]
    got = O.smooth_binary(spark.createDataFrame(rows, "key int, at int, v double").repartition(3), ["key"], "at", "v", width).orderBy("key", "at").collect()
    for k, x in lines.items():
        assert [r.smooth for r in got if r.key == k] == _steps(x, width)
    assert [r.smooth for r in got if r.key == 9] == [None, None] and [r.smooth for r in got if r.key == 8] == [1.0, None, 1.0]
