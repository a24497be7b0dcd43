"""Operators against independent computations and on edge cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import scalars as X
from tessera.functions import stats as T
from tessera.operators import convolve as K
from tessera.operators import elementwise as E
from tessera.operators import morphology as M
from tessera.operators import ordered as O
from tessera.operators import scatter as S
from tessera.operators import spatial as P
from tessera.operators import tracking as R
from tessera.operators.graph import Graph
from tessera.operators import rank as RK
from tessera.operators.rank import FILTERS, rank_filter
from tessera.sources import slicing, tags, volumes


def _vox(spark, a, vol=0):
    rows = [(vol, *map(int, p), a[p].item()) for p in np.ndindex(a.shape)]
    kind = "double" if a.dtype.kind == "f" else "bigint"
    return spark.createDataFrame(rows, f"vol_id bigint, x int, y int, z int, v {kind}")


def _array(df, shape, column="v"):
    a = np.zeros(shape)
    for r in df.collect():
        a[r.x, r.y, r.z] = r[column]
    return a


def test_blocks_join_without_seams(spark):
    a = np.random.default_rng(0).integers(0, 50, (9, 7, 5))
    whole = _array(rank_filter(_vox(spark, a), "median"), a.shape)
    cut = _array(rank_filter(_vox(spark, a), "median", block=(4, 3, 2)), a.shape)
    assert np.array_equal(whole, cut)
    p = np.pad(a.astype(float), 1, constant_values=np.nan)
    for x, y, z in np.ndindex(a.shape):
        v = np.sort(p[x : x + 3, y : y + 3, z : z + 3].ravel())
        v = v[~np.isnan(v)]
        assert whole[x, y, z] == v[len(v) // 2]


@pytest.mark.parametrize("name", sorted(FILTERS))
def test_every_filter_on_flat_and_empty_volumes(spark, name):
    flat = _vox(spark, np.full((2, 2, 2), 7))
    assert rank_filter(flat, name, max_bin=16).count() == 8
    assert rank_filter(flat.limit(0), name, max_bin=16).count() == 0


@pytest.mark.parametrize("name", sorted(RK.BY_SUMS | set(RK.BY_RANKS)))
@pytest.mark.parametrize("shape, block", [((3, 3, 3), (64, 64, 32)), ((4, 1, 5), (3, 4, 2))])
def test_box_windows_by_axes(spark, monkeypatch, name, shape, block):
    """Passes along the axes give what gathered neighbourhoods give, with holes in the volume, even windows and block borders."""
    r = np.random.default_rng(3)
    rows = [(0, x - 2, y, z, int(r.integers(0, 40))) for x in range(8) for y in range(5) for z in range(6) if r.random() > 0.15]
    df = spark.createDataFrame(rows, "vol_id bigint, x int, y int, z int, v int")
    offsets = RK.box(shape)
    parameters = {"p0": 0.2, "p1": 0.7} if name.endswith("_percentile") and not name.startswith(("threshold", "sum_above")) else {}
    got = []
    for sums, large in ((RK.BY_SUMS, 1), (set(), 10**9)):
        monkeypatch.setattr(RK, "BY_SUMS", sums)
        monkeypatch.setattr(RK, "LARGE", large)
        got.append({(g.x, g.y, g.z): g.v for g in RK.rank_filter(df, name, offsets, max_bin=64, block=block, **parameters).collect()})
    assert got[0].keys() == got[1].keys() and all(np.allclose(got[0][k], got[1][k]) for k in got[1])


def test_windows_of_a_hundred_voxels(spark):
    """One array for each offset would be 10^6 arrays."""
    r = np.random.default_rng(5)
    a = r.integers(0, 200, (40, 40, 3))
    got = _array(RK.rank_filter(_vox(spark, a), "median", RK.box((101, 101, 101)), max_bin=256), a.shape)
    v = np.sort(a.ravel())
    assert (got == v[len(v) // 2]).all()
    low = _array(RK.rank_filter(_vox(spark, a), "minimum", RK.box((101, 3, 101))), a.shape)
    assert all(low[0, y, 0] == a[:, max(0, y - 1) : y + 2].min() for y in range(40))


def test_skeleton_keeps_components_and_thins(spark):
    a = np.zeros((9, 5, 5), dtype=int)
    a[1:8, 1:4, 1:4] = 1
    left = M.skeletonize(_vox(spark, a)).collect()
    assert 1 <= len(left) < 30
    cells = [(r.x, r.y, r.z) for r in left]
    assert len({r.label for r in M.label_voxels(spark.createDataFrame([(0, *c) for c in cells], "vol_id bigint, x int, y int, z int"), faces_only=False).collect()}) == 1


def test_fill_holes_and_hysteresis(spark):
    a = np.ones((5, 5, 5), dtype=int)
    a[2, 2, 2] = 0
    a[0, 0, 0] = 0
    filled = _array(M.fill_holes(_vox(spark, a)), a.shape)
    assert filled[2, 2, 2] == 1 and filled[0, 0, 0] == 0
    line = np.array([9, 5, 5, 1, 5]).reshape(5, 1, 1)
    assert _array(M.threshold(_vox(spark, line), 9, 5), line.shape).ravel().tolist() == [1, 1, 1, -1, -1]


def test_distance_transform(spark):
    a = np.ones((6, 5, 4), dtype=int)
    a[0, 0, 0] = a[5, 4, 3] = 0
    d = _array(M.distance_transform(_vox(spark, a)), a.shape)
    zeros = np.argwhere(a == 0)
    for p in np.ndindex(a.shape):
        assert d[p] == pytest.approx(np.sqrt(((zeros - p) ** 2).sum(1)).min())


def test_reconstruct(spark):
    mask = np.array([5, 5, 1, 5, 5]).reshape(5, 1, 1).astype(float)
    seed = np.array([4, 0, 0, 0, 0]).reshape(5, 1, 1).astype(float)
    df = _vox(spark, mask).withColumnRenamed("v", "mask").join(_vox(spark, seed).withColumnRenamed("v", "seed"), ["vol_id", "x", "y", "z"])
    assert _array(M.reconstruct(df, block=(2, 2, 2)), mask.shape).ravel().tolist() == [4, 4, 1, 1, 1]
    with pytest.raises(ValueError):
        M.reconstruct(df.withColumn("seed", F.lit(9.0)))


def test_watershed_splits_at_the_valley(spark):
    a = np.array([1, 5, 2, 6, 1]).reshape(5, 1, 1)
    seeds = spark.createDataFrame([(0, 1, 0, 0, 1), (0, 3, 0, 0, 2)], "vol_id bigint, x int, y int, z int, label bigint")
    got = {r.x: r.label for r in M.watershed(_vox(spark, a), seeds, 0.5).collect()}
    assert got[0] == got[1] == 1 and got[3] == got[4] == 2


def test_cheapest_path(spark):
    a = np.full((5, 5, 1), 0.01)
    a[:, 0, 0] = a[4, :, 0] = 10
    ends = spark.createDataFrame([(0, 0, 0, 0, 4, 4, 0)], "vol_id bigint, sx int, sy int, sz int, tx int, ty int, tz int")
    path = sorted((r.step, r.x, r.y) for r in M.trace_path(_vox(spark, a), ends).collect())
    assert path[0][1:] == (0, 0) and path[-1][1:] == (4, 4) and all(a[x, y, 0] == 10 for _, x, y in path)


def test_graph_reduction_of_chains_and_rings(spark):
    v = spark.createDataFrame([(i, 0.0, 0.0, 0.0, float(i)) for i in range(9)], "vid bigint, x double, y double, z double, radius double")
    e = spark.createDataFrame([(0, 1), (1, 2), (2, 3), (3, 4), (3, 5), (6, 7), (7, 8), (8, 6)], "src bigint, dst bigint").withColumns({"length": F.lit(1.0), "radius": F.col("dst").cast("double")})
    got = {(r.src, r.dst, r.length, r.n_edges) for r in Graph(v, e).reduce().edges.collect()}
    assert got == {(0, 3, 3.0, 3), (3, 4, 1.0, 1), (3, 5, 1.0, 1), (6, 6, 3.0, 3)}


def test_graph_on_empty_tables(spark):
    v = spark.createDataFrame([], "vid bigint, x double, y double, z double, radius double")
    e = spark.createDataFrame([], "src bigint, dst bigint, length double, radius double")
    g = Graph(v, e)
    assert g.label_components().count() == 0 and g.vertex_degrees().count() == 0 and g.reduce().edges.count() == 0


def test_t_test_p_values(spark):
    rows = [(0, g, float(x)) for g, xs in ((0, [1, 2, 3, 4, 5]), (1, [2, 4, 6, 8, 12])) for x in xs] + [(1, 0, 1.0), (1, 1, 1.0)]
    got = {r.k: r for r in T.t_test(spark.createDataFrame(rows, "k int, g int, v double"), ["k"], "g", "v", 0, 1).collect()}
    # t = -1.8378, df = 5.315: two-sided p by numeric integration of the density
    t, df = got[0].t, 5.0
    assert t == pytest.approx((3 - 6.4) / np.sqrt(2.5 / 5 + 14.8 / 5), rel=1e-9)
    x = np.linspace(-60, 60, 2_000_001)
    a, b = 2.5 / 5, 14.8 / 5
    df = (a + b) ** 2 / (a**2 / 4 + b**2 / 4)
    density = (1 + x**2 / df) ** (-(df + 1) / 2)
    p = density[np.abs(x) >= abs(t)].sum() / density.sum()
    assert got[0].p == pytest.approx(p, rel=1e-3)
    assert got[1].p == 1.0 and got[1].t == 0.0


def test_alignment_finds_the_shift():
    a = np.random.default_rng(1).normal(size=(20, 20))
    shift, quality = P.best_shift(a[:15, :15], a[3:18, 2:17], 5)
    assert shift == (3, 2) and quality == pytest.approx(0, abs=1e-9)


def test_assignment_is_optimal():
    from itertools import permutations

    rng = np.random.default_rng(2)
    for n in range(1, 6):
        c = rng.integers(0, 20, (n, n)).astype(float)
        best = min(sum(c[i, p[i]] for i in range(n)) for p in permutations(range(n)))
        assert sum(c[i, j] for i, j in R.assign(c)) == best
    assert R.match_points(np.zeros((1, 3)), np.full((1, 3), 9.0), 1.0, 5.0) == []


def test_volume_formats():
    rng = np.random.default_rng(3)
    for dtype in ("uint8", "uint16", "int32", "float32", "float64"):
        a = (rng.random((4, 3, 2)) * 100).astype(dtype)
        for name in ("npy", "tif", "nrrd"):
            assert np.array_equal(volumes.DECODERS[name](volumes.ENCODERS[name](a)), a), (name, dtype)
        head, raw = volumes.encode_mhd(a, "a.raw")
        assert np.array_equal(volumes.decode_mhd(head, raw), a)
    with pytest.raises(ValueError):
        volumes.format_of("a.unknown")
    with pytest.raises(ValueError):
        volumes.validate((1, 2), like={"shape": (2, 2)})


def test_slices():
    shape = (10, 9, 8)
    a = np.arange(720).reshape(shape)
    for first, second in (((slice(1, 9, 2), 3), (slice(None, None, -1), slice(2, 5))), (Ellipsis, (1, slice(2, 4), -1)), ((slice(8, 2, -2), Ellipsis, slice(3)), (slice(1, 3),))):
        assert np.array_equal(a[first][second], a[slicing.compose(second, first, shape)])
        assert slicing.sliced_shape(first, shape) == a[first].shape
    with pytest.raises(IndexError):
        slicing.unpack((Ellipsis, Ellipsis), 3)


def test_tags():
    e = tags.Expression("a_<X,2>_<Y,I,3>.npy")
    assert e.string({"X": 3, "Y": 7}) == "a_03_007.npy" and e.values("a_03_007.npy") == {"X": 3, "Y": 7} and e.values("b") == {}
    assert e.glob() == "a_??_???.npy" and e.indices("a_12_345.npy") == [12, 345]
    found = tags.detect(["t_01_x.tif", "t_02_x.tif", "t_13_x.tif"], ["Z"])
    assert found.text == "t_<Z,I,2>_x.tif"
    w = tags.Workspace("/data/s1", "s1")
    assert w.filename("raw", {"X": 1, "Y": 2}) == "/data/s1/Raw/s1_raw_01_02.npy"


def test_parameters():
    a = {"x": {"y": 1}, "k": 2}
    assert X.get(a, "x.y") == 1 and X.get(a, "x.q", 5) == 5 and X.put(a, "x.z", 3)["x"] == {"y": 1, "z": 3} and a["x"] == {"y": 1}
    assert X.deep_merge(a, {"x": {"y": 9, "w": 4}, "n": 0}) == {"x": {"y": 1, "w": 4}, "k": 2, "n": 0}
    assert X.remove_extra_keys(a, {"x": {}}) == {"x": {}}


def test_scatter_outside_and_empty(spark):
    p = spark.createDataFrame([(0, 1.9, 0.0, 0.0, 2.0), (1, 5.0, 0.0, 0.0, 1.0)], "point_id bigint, x double, y double, z double, w double")
    assert [(r.x, r.v) for r in S.devolve(p, (3, 1, 1), weights="w").collect()] == [(1, 2.0)]
    assert S.voxelize(p.limit(0), (3, 3, 3)).count() == 0
    with pytest.raises(ValueError):
        S.voxelize(p, (3, 3, 3), "unknown")


def test_gaps_at_the_ends(spark):
    rows = [(0, i, v, v is not None) for i, v in enumerate([None, 2.0, None, 6.0, None])] + [(1, 0, None, False)]
    got = O.interpolate_gaps(spark.createDataFrame(rows, "k int, i int, v double, ok boolean"), ["k"], "i", "v", "ok").orderBy("k", "i").collect()
    assert [r.filled for r in got] == [2.0, 2.0, 4.0, 6.0, 6.0, None]


def test_kernels():
    assert K.filter_kernel("gaussian", (5, 5, 5)).sum() == pytest.approx(1)
    assert K.filter_kernel("dog", (5, 5, 5)).sum() == pytest.approx(0, abs=1e-9)
    assert K.disk((3, 3)).sum() == 9 and not K.disk((7, 7))[0, 0] and K.structure_element_offsets((3, 4)) == [(1, 2), (2, 2)]
    with pytest.raises(ValueError):
        K.structure_element((3, 3), "none")


def test_orientations():
    for o in ((1, 2, 3), (-1, 2, 3), (3, -1, 2), (-2, -3, -1)):
        i = P.inverse_orientation(o)
        assert P.inverse_orientation(i) == o
        assert P.orient(P.orient((4, 5, 6), o), i) == (4, 5, 6)
    assert P.format_orientation("left") is None and P.format_orientation("right") == (-1, 2, 3)
    assert P.resample_shape((10, 20, 30), None, (2, 2, 2), (5, 5, 5))[1] == (4, 8, 12)


def test_resampled_points_come_back(spark):
    p = spark.createDataFrame([(0, 3.0, 4.0, 5.0)], "point_id bigint, x double, y double, z double")
    for o in (None, (-1, 2, 3), (3, -1, 2)):
        sink = P.orient((20, 5, 40), o)
        there = P.resample_points(p, (10, 10, 10), sink, o)
        r = P.resample_points_inverse(there, (10, 10, 10), sink, o).first()
        assert (r.x, r.y, r.z) == pytest.approx((3, 4, 5))


def test_missing_columns(spark):
    df = spark.createDataFrame([(1,)], "a int")
    with pytest.raises(KeyError):
        E.rename_columns(df, {"b": "c"}, strict=True)


def test_stream(spark, tmp_path):
    from tessera.streaming.windows import file_stream, run_once, windowed

    spark.sql("select timestamp '2024-01-01 00:10:00' as ts, 1 as k, 2.0 as v").write.parquet(f"{tmp_path}/in")
    spark.sql("select timestamp '2024-01-01 03:10:00' as ts, 1 as k, 3.0 as v").write.mode("append").parquet(f"{tmp_path}/in")
    out = windowed(file_stream(spark, f"{tmp_path}/in"), "ts", "v", ["k"], "1 hour", "10 minutes")
    run_once(out, f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    assert [(r.n, r.total) for r in spark.read.parquet(f"{tmp_path}/out").orderBy("start").collect()][:1] == [(1, 2.0)]
