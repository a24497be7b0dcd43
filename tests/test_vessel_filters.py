"""Deconvolution, thresholds that follow the place, post-processing, polylines and point lists against plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import morphology as M
from tessera.operators import polylines as L
from tessera.operators import scatter as S
from tessera.operators import vessel_filters as V
from tests.test_blockwise import VOX, _blobs, _rows, _smooth_one


def _gauss(a, sigma, axis):
    radius = int(4 * sigma + 0.5)
    k = np.arange(-radius, radius + 1)
    w = np.exp(-0.5 * (k / sigma) ** 2)
    w /= w.sum()
    n = a.shape[axis]
    out = np.zeros(a.shape)
    for d, x in zip(k, w):
        index = [i if i < n else 2 * n - 1 - i for i in ((np.arange(n) + d) % (2 * n))]
        out += x * np.take(a, index, axis)
    return out


@pytest.mark.parametrize("sigma", [0.4, 2.0])
def test_deconvolution(spark, sigma):
    a = np.round(_blobs(2, (9, 5, 3)) * 100)
    b = np.round(_blobs(3, (4, 11, 2)) * 100)
    rows = _rows(a) + _rows(b, 1, (5, -2, 7))
    df = spark.createDataFrame(rows, VOX).withColumn("on", F.col("v") > 55)
    got = {(g.vol_id, g.x, g.y, g.z): g.v for g in V.deconvolve(df, sigma).collect()}
    for vol, (v, low) in enumerate(((a, (0, 0, 0)), (b, (5, -2, 7)))):
        on = v > 55
        spread = _gauss(_gauss(np.where(on, v, 0), sigma, 0), sigma, 1)
        want = np.where(on, v, v - np.minimum(v, spread))
        assert all(got[(vol, *(int(i + o) for i, o in zip(p, low)))] == pytest.approx(want[p]) for p in np.ndindex(v.shape))
    assert V.deconvolve(df.limit(0)).count() == 0


def _isodata(values):
    v, n = np.unique(values, return_counts=True)
    best = 1.0
    for i in range(len(v) - 1):
        low, high = values[values <= v[i]], values[values > v[i]]
        mid = (low.mean() + high.mean()) / 2
        if v[i] <= mid < v[i + 1]:
            best = float(v[i])
    return best


def test_thresholds_follow_the_place(spark):
    a = np.round(_blobs(4, (12, 9, 4)) * 60 + np.arange(12)[:, None, None] * 5)
    selem, spacing = (6, 5, 4), (4, 3, 2)
    df = spark.createDataFrame(_rows(a), VOX)
    got = {(g.x, g.y, g.z): (g.v, g.level) for g in V.threshold_adaptive(df, selem, spacing).collect()}
    tops = [max(0, n - 1 - s // 2) // s for n, s in zip(a.shape, spacing)]
    grid = np.zeros([t + 1 for t in tops])
    for c in np.ndindex(grid.shape):
        cut = tuple(slice(max(0, i * s + s // 2 - n // 2), i * s + s // 2 - n // 2 + n) for i, n, s in zip(c, selem, spacing))
        grid[c] = _isodata(a[cut].ravel())
    for p in np.ndindex(a.shape):
        t = [min(max((x - s // 2) / s, 0.0), float(top)) for x, s, top in zip(p, spacing, tops)]
        low = [int(np.floor(x)) for x in t]
        want = 0.0
        for corner in np.ndindex(2, 2, 2):
            w = np.prod([(x - b) if k else 1 - (x - b) for x, b, k in zip(t, low, corner)])
            if w > 0:
                want += w * grid[tuple(b + k for b, k in zip(low, corner))]
        assert got[p] == (a[p], pytest.approx(want))
    flags = {(g.x, g.y, g.z): g.v for g in V.binarize_adaptive(df, selem, spacing).collect()}
    assert flags == {p: int(v > level) for p, (v, level) in got.items()}
    whole = V.threshold_adaptive(df, (99, 99, 99), (99, 99, 99), share=0.5).select("level").distinct().collect()
    assert [r.level for r in whole] == [np.median(a)]


def test_postprocessing(spark):
    a = (_blobs(6, (9, 9, 9)) > 0.5).astype(int)
    a[2:7, 2:7, 2:7] = 1
    a[3:6, 3:6, 3:6] = 0
    df = spark.createDataFrame(_rows(a), VOX)
    wide = np.pad(a > 0, 1)
    once = np.array([_smooth_one(wide[x : x + 3, y : y + 3, z : z + 3]) for x, y, z in np.ndindex(a.shape)]).reshape(a.shape).astype(int)
    want = {(g.x, g.y, g.z): g.v for g in M.fill_holes(spark.createDataFrame(_rows(once), VOX)).collect()}
    assert {(g.x, g.y, g.z): g.v for g in V.postprocess(df, 1).collect()} == want and want[4, 4, 4] == 1
    assert {(g.x, g.y, g.z): g.v for g in V.postprocess(df, 0, False).collect()} == {p: int(a[p]) for p in np.ndindex(a.shape)}


POINTS = "src int, dst int, geometry array<struct<x:double,y:double,z:double,r:double>>"


def _resize(points, n):
    p = np.array(points, float)
    if len(p) == 1:
        return np.repeat(p, n, 0)
    arc = np.concatenate([[0], np.cumsum(np.linalg.norm(np.diff(p[:, :3], axis=0), axis=1))])
    t = np.linspace(0, arc[-1], n)
    return np.stack([np.interp(t, arc, p[:, i]) for i in range(p.shape[1])], axis=1)


def test_polylines(spark):
    r = np.random.default_rng(8)
    lines = [r.normal(0, 5, (k, 4)).round(3).tolist() for k in (2, 3, 7, 15)] + [[[1.0, 2.0, 3.0, 4.0]], [[0.0] * 4, [0.0] * 4], [], None]
    rows = [(i, i + 1, None if p is None else [tuple(q) for q in p]) for i, p in enumerate(lines)]
    e = spark.createDataFrame(rows, POINTS)
    for n in (2, 5, 40):
        got = {g.src: g.geometry for g in L.resize(e, F.lit(n)).collect()}
        assert got[6] == [] and got[7] is None
        assert all(np.allclose(np.array(got[i]), _resize(p, n)) for i, p in enumerate(lines[:6]))
    lengths = {g.src: g.n for g in e.select("src", L.length().alias("n")).collect()}
    assert lengths[4] == 0 and lengths[6] is None and lengths[7] is None and lengths[3] == pytest.approx(np.linalg.norm(np.diff(np.array(lines[3])[:, :3], axis=0), axis=1).sum())
    even = {g.src: np.array(g.geometry) for g in L.smooth(e.filter("size(geometry) > 0"), 2).collect()}
    for i, p in enumerate(lines[:6]):
        p = np.array(p)
        want = [p[max(0, k - m) : k + m + 1].mean(0) for k in range(len(p)) for m in [min(2, k, len(p) - 1 - k)]]
        assert np.allclose(even[i], want)
    fine = {g.src: (g.geometry, g.n) for g in L.interpolate(e.filter("src < 4"), 0.5, 1).withColumn("n", L.length()).collect()}
    assert all(len(fine[i][0]) == max(2, int(np.ceil(sum(np.linalg.norm(np.diff(even_i[:, :3], axis=0), axis=1)) * 0.5)) + 1) for i, even_i in ((g.src, np.array(g.geometry)) for g in L.smooth(e.filter("src < 4"), 1).collect()))
    flat = e.filter("src < 4").select("src", "dst", F.posexplode("geometry").alias("pos", "p")).select("src", "dst", "pos", "p.*")
    back = L.set_geometry(e.filter("src < 4"), flat.orderBy(F.desc("pos")))
    assert {g.src: g.geometry for g in back.collect()} == {g.src: g.geometry for g in e.filter("src < 4").collect()}
    marked = L.set_points(e.filter("src < 4"), F.col("dst"), "label")
    assert all({q.label for q in g.geometry} == {g.dst} for g in marked.collect())
    assert L.remove_field(marked, "label").schema["geometry"].dataType.elementType.fieldNames() == ["x", "y", "z", "r"]


@pytest.mark.parametrize("method, function", [("max", max), ("min", min), ("sum", sum), ("mean", lambda v: sum(v) / len(v))])
def test_measures_at_point_lists(spark, method, function):
    a = np.random.default_rng(1).integers(0, 50, (5, 5, 5))
    vox = spark.createDataFrame(_rows(a), VOX)
    offsets = S.sphere_offsets(spark, (2, 2, 2))
    order = [(o.dx, o.dy, o.dz) for o in offsets.orderBy("rank").collect()]
    rows = [(0, 2, 2, 2, 0, 9), (1, 0, 0, 0, 0, 33), (2, 4, 4, 4, 0, 1), (3, 2, 2, 2, 0, 0), (4, 99, 0, 0, 0, 5)]
    points = spark.createDataFrame(rows, "point_id int, x int, y int, z int, vol_id bigint, count int")
    got = {g.point_id: g.v for g in S.measure_list(points, vox, offsets, method).collect()}
    for i, x, y, z, _, k in rows:
        seen = [float(a[q]) for q in (tuple(np.add((x, y, z), o)) for o in order[:k]) if all(0 <= c < 5 for c in q)]
        assert got[i] == (pytest.approx(function(seen)) if seen else None)
