"""Distances by lower envelopes, and slice shifts traced along a stack, against brute force and exhaustive search."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import distances as D
from tessera.operators import slice_tracing as T

VOX = "vol_id bigint, x int, y int, z int, v double"


def _brute(places, sources, spacing):
    s = np.array(spacing)
    return {p: min((float(np.sqrt((((np.array(p) - q) * s) ** 2).sum())) for q in sources), default=float("inf")) for p in places}


@pytest.mark.parametrize("spacing", [(1.0, 1.0, 1.0), (0.5, 2.0, 3.25)])
@pytest.mark.parametrize("cells", [D.CELLS, 7])
def test_distances_as_brute_force(spark, monkeypatch, spacing, cells):
    """Volumes with and without sources, and of one voxel; lines in one batch or one by one; negative places; null places are left out."""
    monkeypatch.setattr(D, "CELLS", cells)
    r = np.random.default_rng(2)
    rows = [(0, x - 4, y, z + 9, float(r.random() > 0.08)) for x in range(9) for y in range(7) for z in range(6)]
    rows += [(1, x, 0, 0, 1.0) for x in range(5)] + [(2, 0, 0, 0, 0.0), (3, None, 0, 0, 1.0)]
    got = {(g.vol_id, g.x, g.y, g.z): g.v for g in D.distance_transform(spark.createDataFrame(rows, VOX).repartition(3), spacing).collect()}
    want = {}
    for vol in range(3):
        own = [q for q in rows if q[0] == vol]
        want |= {(vol, *p): d for p, d in _brute([q[1:4] for q in own], [q[1:4] for q in own if q[4] <= 0], spacing).items()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    assert D.distance_transform(spark.createDataFrame(rows, VOX).limit(0)).count() == 0


@pytest.mark.parametrize("spacing", [(1.0, 1.0, 1.0), (0.5, 2.0, 3.25)])
def test_distances_of_lines_in_parts(spark, spacing):
    """Long lines are cut: sources in few parts, in a part without any of its own, on bounds of parts; a volume that lies far off, and one without sources."""
    r = np.random.default_rng(5)
    rows = [(0, x - 13, y - 5, z, float(r.random() > 0.02)) for x in range(40) for y in range(11) for z in range(3)]
    rows += [(1, x + 900, y, 0, float((x, y) != (9, 2))) for x in range(10) for y in range(9)] + [(2, x, 0, 0, 1.0) for x in range(17)] + [(3, x, 0, 0, float(x % 8 != 7)) for x in range(24)]
    vox = spark.createDataFrame(rows, VOX).select("vol_id", "x", "y", "z", (F.col("v") <= 0).alias("source"))
    got = {(g.vol_id, g.x, g.y, g.z): g.v for g in D.distances(vox.repartition(3), spacing, part=4).collect()}
    want = {}
    for vol in range(4):
        own = [q for q in rows if q[0] == vol]
        want |= {(vol, *p): d for p, d in _brute([q[1:4] for q in own], [q[1:4] for q in own if q[4] <= 0], spacing).items()}
    assert len(got) == len(rows) and got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_parts_hand_on_what_is_lowest_outside():
    """The lowest of a part's parabolas outside of it are the lowest of those that it hands on, at any heights."""
    r = np.random.default_rng(6)
    at = np.sort(r.choice(60, (40, 12)), axis=1) + np.arange(12) * 1.0
    for height in (np.zeros((40, 12)), r.integers(0, 900, (40, 12)).astype(float)):
        height = np.where(r.random((40, 12)) < 0.3, np.inf, height)
        valid = r.random((40, 12)) < 0.9
        height[0], valid[1] = np.inf, False
        kept = D.outside(at, height, valid)
        for i in range(40):
            own = at[i][valid[i]]
            beyond = [x for x in range(-40, 140) if not len(own) or x < own.min() or x > own.max()]
            lowest = lambda h: [(np.where(valid[i], h[i], np.inf) + (at[i] - x) ** 2).min() for x in beyond]  # noqa: B023, E731
            assert np.array_equal(lowest(height), lowest(kept))


def test_envelope_is_the_lowest_of_all_parabolas():
    r = np.random.default_rng(3)
    at = np.sort(r.choice(400, (30, 25)), axis=1) + np.arange(25) * 0.5
    height = np.where(r.random((30, 25)) < 0.3, np.inf, r.integers(0, 3000, (30, 25)).astype(float))
    valid = r.random((30, 25)) < 0.9
    height[0], valid[1] = np.inf, False
    got = D.envelope(at, height, valid)
    usable = np.where(valid, height, np.inf)
    want = (usable[:, None, :] + (at[:, :, None] - at[:, None, :]) ** 2).min(-1)
    assert np.allclose(got[valid], want[valid]) and np.isinf(got[~valid]).all()


def test_borders_of_regions(spark):
    ids = np.ones((5, 4, 3), int)
    ids[2:, :, :] = 2
    ids[4, 3, 2] = 0
    rows = [(0, *p, int(ids[p])) for p in np.ndindex(ids.shape) if p != (1, 0, 0)]
    atlas = spark.createDataFrame(rows, "vol_id bigint, x int, y int, z int, id int")
    stored = {q[1:4]: q[4] for q in rows}
    steps = [d for d in itertools.product((-1, 0, 1), repeat=3) if sum(map(abs, d)) == 1]
    edge = [p for p, v in stored.items() if any(stored.get(tuple(np.add(p, d)), v) != v for d in steps)]
    assert {(g.x, g.y, g.z) for g in D.borders(atlas).filter("border").collect()} == set(edge)
    got = {(g.x, g.y, g.z): g.v for g in D.border_distance(atlas).collect()}
    assert got == pytest.approx(_brute(list(stored), edge, (1, 1, 1)))
    assert {(g.x, g.y, g.z) for g in D.annotation_distance(atlas).filter("v = 0").collect()} == {(4, 3, 2)}


def test_best_path_is_that_of_exhaustive_search():
    r = np.random.default_rng(5)
    shifts = np.array([(i, j, 0) for i in (-1, 0, 1) for j in (0, 1)])
    for _ in range(20):
        errors = r.random((5, len(shifts)))
        errors[r.random(errors.shape) < 0.2] = np.inf
        errors[:, 0] = r.random(5)
        gaps, penalty = np.array([1, 1, 3, 1, 2]), float(r.random())
        cost = lambda p: sum(errors[i, k] for i, k in enumerate(p)) + sum(penalty * np.linalg.norm(shifts[p[i]] - shifts[p[i - 1]]) / gaps[i] for i in range(1, 5))  # noqa: E731, B023
        best = min(itertools.product(range(len(shifts)), repeat=5), key=cost)
        assert cost(T.best_path(errors, shifts, gaps, penalty)) == pytest.approx(cost(best))


@pytest.fixture(scope="module")
def bands(spark):
    """Two overlaps of 14 slices; the second side drifts slowly, and some slices are nearly noise."""
    r = np.random.default_rng(7)
    rows, truth = [], {}
    for pre in (1, 2):
        drift = np.cumsum(r.integers(-1, 2, 14).clip(-1, 1)).clip(-2, 2)
        for s in range(14):
            base = r.random((16, 16)) * 100
            d = (int(drift[s]), int(drift[s] // 2))
            truth[pre, s] = (-d[0], -d[1])  # what moves the second side back
            noise = 220.0 if s % 5 == 3 else 8.0
            for p in range(3, 12):
                for q in range(3, 12):
                    rows.append((pre, pre + 1, 0, p, q, s, float(base[p, q] + r.normal(0, noise))))
                    rows.append((pre, pre + 1, 1, p + d[0], q + d[1], s, float(base[p, q] + r.normal(0, noise))))
    return spark.createDataFrame(rows, "pre bigint, post bigint, side int, x int, y int, z int, v double"), truth


def test_errors_of_slices(spark, bands):
    df, _ = bands
    got = {(g.pre, g.s, g.dx, g.dy): (g.error, g.n) for g in T.slice_errors(df, max_shift=2).filter("pre = 1 and s in (0, 3)").collect()}
    data = {}
    for g in df.filter("pre = 1 and z in (0, 3)").collect():
        data[g.side, g.z, g.x, g.y] = g.v
    for (_, s, i, j), (error, n) in got.items():
        d = [v - data[1, s, x - i, y - j] for (side, z, x, y), v in data.items() if side == 0 and z == s and (1, s, x - i, y - j) in data]
        assert n == len(d) and error == pytest.approx(np.mean(np.square(d)))
    assert len(got) == 50


def test_tracing_beats_independent_minima(spark, bands):
    df, truth = bands
    errors = T.slice_errors(T.normalize(df), max_shift=3)
    traced = {(g.pre, g.s): (g.dx, g.dy) for g in T.trace_slices(errors, 0.002, least=20).collect()}
    alone = {}
    for g in errors.filter("n >= 20").collect():
        alone.setdefault((g.pre, g.s), []).append((g.error, g.dx, g.dy))
    alone = {k: min(v)[1:] for k, v in alone.items()}
    wrong = lambda found: sum(found[k] != truth[k] for k in truth)
    assert wrong(traced) < wrong(alone) and wrong(traced) <= 3


def test_slices_that_show_nothing(spark, bands):
    df, truth = bands
    dim = df.withColumn("v", F.when((F.col("z") == 6) & (F.col("side") == 1), 0.0).otherwise(F.col("v")))
    valid = T.foreground(dim, (30.0, None), fraction=0.2)
    assert {(g.pre, g.s) for g in valid.filter("not valid").collect()} >= {(1, 6), (2, 6)}
    traced = T.trace_slices(T.slice_errors(dim, max_shift=1), 1.0, valid, longest_gap=1)
    assert {g.s for g in traced.collect()} == {g.s for g in valid.filter("valid").collect()}
    assert T.foreground(df, (None, None)).filter("not valid").count() == 0 and T.foreground(df, (1e9, 2e9)).filter("valid").count() == 0
    flat = T.normalize(df.withColumn("v", F.lit(3.0)), (None, 2.0))
    assert {g.v for g in flat.collect()} == {0.0}
    one = T.normalize(df, (10.0, 80.0)).groupBy("pre", "side", "z").agg(F.sum("v").alias("m"), F.sum(F.col("v") * F.col("v")).alias("q")).collect()
    assert all(abs(g.m) < 1e-9 and g.q == pytest.approx(1) for g in one)
