"""Alignment, placement and vessel steps against synthetic images and brute force; group reports end to end."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import alignment as A
from tessera.operators import graph as G
from tessera.operators import morphology as M
from tessera.operators import spatial as P
from tessera.operators import vessels as V
from tessera.plans import group_reports as R
from tessera.plans.pipelines import vessel_graph

TILES = "tile bigint, lox int, loy int, loz int, hix int, hiy int, hiz int"


@pytest.fixture(scope="module")
def mosaic(spark):
    """A random image and three tiles of it whose true places differ from their boxes."""
    rng = np.random.default_rng(1)
    image = rng.integers(0, 1000, (40, 16, 12))
    true = {1: (2, 2, 2), 2: (11, 3, 1), 3: (20, 2, 3)}
    boxes = [(1, 2, 2, 2, 14, 12, 10), (2, 10, 2, 2, 22, 12, 10), (3, 19, 2, 2, 31, 12, 10)]
    rows = [(t, x, y, z, int(image[p[0] + x, p[1] + y, p[2] + z])) for t, p in true.items() for x in range(12) for y in range(10) for z in range(8)]
    return image, true, spark.createDataFrame(boxes, TILES), spark.createDataFrame(rows, "tile bigint, x int, y int, z int, v int")


def test_align_and_place(mosaic):
    image, true, tiles, voxels = mosaic
    found = {(r.pre, r.post): (r.dx, r.dy, r.dz) for r in A.align_layout(tiles, voxels, 16, 3).collect()}
    box = {r.tile: (r.lox, r.loy, r.loz) for r in tiles.collect()}
    for (a, b), d in found.items():
        want = tuple((true[b][i] - box[b][i]) - (true[a][i] - box[a][i]) for i in range(3))
        assert d == want or tuple(-x for x in d) == want
    assert sorted(found) == [(1, 2), (2, 3)]


def test_place_layout_from_alignments(spark, mosaic):
    _, true, tiles, _ = mosaic
    box = {r.tile: (r.lox, r.loy, r.loz) for r in tiles.collect()}
    rows = [(a, b, *[float((true[b][i] - box[b][i]) - (true[a][i] - box[a][i])) for i in range(3)], 1.0) for a, b in ((1, 2), (2, 3))]
    placed = {r.tile: (r.x, r.y, r.z) for r in A.place_layout(tiles, spark.createDataFrame(rows, "pre bigint, post bigint, dx double, dy double, dz double, quality double")).collect()}
    low = [min(p[i] for p in true.values()) for i in range(3)]
    assert all(np.allclose(placed[t], [true[t][i] - low[i] for i in range(3)]) for t in true)


def test_slices_find_their_own_shift(spark):
    rng = np.random.default_rng(2)
    image = rng.integers(0, 500, (30, 20, 4))
    shift = [(0, 0), (1, 0), (-1, 1), (0, -1)]
    tiles = spark.createDataFrame([(1, 4, 4, 0, 14, 14, 4), (2, 9, 4, 0, 19, 14, 4)], TILES)
    rows = [(1, x, y, z, int(image[4 + x, 4 + y, z])) for x in range(10) for y in range(10) for z in range(4)]
    rows += [(2, x, y, z, int(image[9 + x + shift[z][0], 4 + y + shift[z][1], z])) for x in range(10) for y in range(10) for z in range(4)]
    voxels = spark.createDataFrame(rows, "tile bigint, x int, y int, z int, v int")
    pairs = P.overlaps(tiles, 16)
    aligned = A.align_slices(A.slice_errors(tiles, voxels, pairs, "z", 2), 8)
    assert {r.s: (r.dx, r.dy) for r in aligned.collect()} == dict(enumerate(shift))
    placed = {(r.tile, r.s): (r.x, r.y) for r in A.place_slices(tiles, aligned, "z", pairs).collect()}
    for z, (dx, dy) in enumerate(shift):
        assert np.allclose(np.subtract(placed[2, z], placed[1, z]), (5 + dx, dy))
    out = A.stitch_slices(tiles, voxels, A.place_slices(tiles, aligned, "z", pairs), "z", "max")
    by = {(r.x, r.y, r.z): r.v for r in out.collect()}
    off = {z: placed[1, z] for z in range(4)}
    assert all(by[round(off[z][0]) + x, round(off[z][1]) + y, z] == image[4 + x, 4 + y, z] for x in range(10) for y in range(10) for z in range(4))
    assert A.smooth_slices(aligned, 3).count() == 4


def test_parallel_edges_stay_apart(spark):
    e = spark.createDataFrame([(0, 1, 1.0, 1.0), (0, 1, 1.0, 1.0), (0, 2, 1.0, 1.0), (1, 3, 1.0, 1.0)], "src bigint, dst bigint, length double, radius double")
    g = G.Graph(spark.range(4).select("id").withColumnRenamed("id", "vid"), e)
    got = sorted((r.src, r.dst, r.length, r.n_edges) for r in g.reduce().edges.collect())
    assert got == [(0, 1, 1.0, 1), (0, 1, 1.0, 1), (0, 2, 1.0, 1), (1, 3, 1.0, 1)]
    assert g.edge_graph().vertices.count() == 4
    assert [r.vid for r in g.renumbered().vertices.orderBy("vid").collect()] == [0, 1, 2, 3]


def test_skeletons_of_volumes_stay_apart(spark):
    v = spark.createDataFrame([(1, 0, 0, 0, 1), (1, 1, 1, 1, 1), (2, 0, 0, 1, 1), (2, 3, 3, 3, 1)], "vol_id bigint, x int, y int, z int, v int")
    g = G.graph_from_skeleton(v)
    assert g.vertices.count() == 4 and g.edges.count() == 1


def test_skeletons_beyond_21_bits_an_axis(spark):
    """Places that packing can't hold: too far along x, equal when packed, or next to each other only when packed."""
    n = 1 << 21
    shape = [(0, 0, 0), (1, 1, 0), (2, 2, 1), (2, 2, 2), (4, 0, 0)]
    voxels = lambda places: spark.createDataFrame([(*p, 1) for p in places], "x int, y int, z int, v int")

    def edges(g):
        at = {r.vid: (r.x, r.y, r.z) for r in g.vertices.collect()}
        return len(at), sorted(tuple(sorted((at[e.src], at[e.dst]))) for e in g.edges.collect())

    def moved(x, y, z):
        return [(a + x, b + y, c + z) for a, b, c in shape]

    want = [(shape[i], shape[i + 1]) for i in range(3)]
    for by in ((0, 0, 0), (n, 0, 0), (-2 * n, 0, 0), (5, n, -n), (2**31 - 5, 0, 0)):
        got = edges(G.graph_from_skeleton(voxels(moved(*by))))
        assert got == (5, [tuple(tuple(c + d for c, d in zip(p, by)) for p in e) for e in want])
    for places in ([(0, n, 0), (1, 0, 0)], [(0, 0, n), (0, 1, 0)], [(0, n - 1, 0), (1, 0, 0)]):
        assert edges(G.graph_from_skeleton(voxels(places))) == (2, [])


def test_vessel_graph_far_along_an_axis(spark):
    """The same vessels give the same graph wherever they lie."""
    on = {(x, 2, 2) for x in range(1, 30)} | {(12, y, 2) for y in range(2, 14)} | {(x, 13, 2) for x in range(12, 22)}
    rows = [(x, y, z, int((x, y, z) in on)) for x in range(31) for y in range(15) for z in range(5)]

    def found(by):
        binary = spark.createDataFrame([(0, x + by, y, z, v) for x, y, z, v in rows], "vol_id bigint, x int, y int, z int, v int")
        g = vessel_graph(binary)
        vertices = g.vertices.collect()
        at = {r.vid: (round(r.x - by, 6), round(r.y, 6), round(r.z, 6)) for r in vertices}
        return sorted((*at[r.vid], r.radius) for r in vertices), sorted((at[e.src], at[e.dst], e.length, e.n_edges) for e in g.edges.collect())

    near = found(0)
    assert len(near[0]) == 4 and len(near[1]) == 3 and all(v[3] >= 1.0 for v in near[0])
    assert found(3_000_000) == near


def test_reconstruction_of_fractions_ends(spark):
    rng = np.random.default_rng(4)
    mask = rng.random((9, 5, 4))
    seed = np.where(rng.random(mask.shape) < 0.05, mask, 0.0)
    rows = [(1, *map(int, p), float(seed[p]), float(mask[p])) for p in np.ndindex(mask.shape)]
    got = {(r.x, r.y, r.z): r.v for r in M.reconstruct(spark.createDataFrame(rows, "vol_id bigint, x int, y int, z int, seed double, mask double"), block=(3, 2, 2)).collect()}
    want = seed.copy()
    while True:
        pad = np.pad(want, 1, constant_values=-1)
        new = np.minimum(np.max([pad[1 + i : 10 + i, 1 + j : 6 + j, 1 + k : 5 + k] for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)], axis=0), mask)
        if np.array_equal(new, want):
            break
        want = new
    assert got == {p: float(want[p]) for p in np.ndindex(mask.shape)}


def test_open_branches(spark):
    line = [(x, 5, 5) for x in range(-6, 16)]
    twig, long = [(6, 6, 5), (6, 7, 5)], [(3, 4 - i, 5) for i in range(5)]
    rows = [(1, *p) for p in line + twig + long] + [(2, 0, 0, 0), (2, 1, 0, 0)]
    got = {tuple(r) for r in V.clean_open_branches(spark.createDataFrame(rows, "vol_id bigint, x int, y int, z int"), 3).collect()}
    assert (1, 6, 7, 5) not in got and {(1, *p) for p in long[1:]} <= got and {(2, 0, 0, 0), (2, 1, 0, 0)} <= got
    assert {(1, *p) for p in line if p[0] < 2 or p[0] > 8} <= got and (1, 6, 6, 5) in got


def test_vessel_radii_and_traces(spark):
    binary = spark.createDataFrame([(1, x, y, z, int(1 <= y <= 3 and 1 <= z <= 3)) for x in range(8) for y in range(5) for z in range(5)], "vol_id bigint, x int, y int, z int, v int")
    v = spark.createDataFrame([(i, float(i), 2.0, 2.0) for i in range(8)], "vid bigint, x double, y double, z double")
    e = spark.createDataFrame([(i, i + 1, 1.0, i == 0, float(i)) for i in range(7)], "src bigint, dst bigint, length double, artery boolean, artery_raw double")
    g = V.measure_radii(G.Graph(v, e), binary)
    assert {r.radius for r in g.vertices.collect()} == {2.0} and {r.radius for r in g.edges.collect()} == {2.0}
    grown = {(r.src, r.dst) for r in V.trace_arteries(g, 1.0, 3).filter("artery").collect()}
    assert grown == {(0, 1), (1, 2), (2, 3), (3, 4)}
    assert V.status_to_description(0) == "Background" and V.status_to_description(5) == "High,Deconvolved"


def test_volumes_stay_apart(spark):
    """Two volumes with the same places: no vertex and no edge is repeated, and each sees its own values."""
    binary = spark.createDataFrame([(vol, x, y, z, int(1 <= y <= 2 + vol and 1 <= z <= 3)) for vol in (1, 2) for x in range(5) for y in range(7) for z in range(5)], "vol_id bigint, x int, y int, z int, v int")
    v = spark.createDataFrame([(10 * vol + i, vol, float(i), 2.0, 2.0) for vol in (1, 2) for i in range(4)], "vid bigint, vol_id bigint, x double, y double, z double")
    e = spark.createDataFrame([(10 * vol + i, 10 * vol + i + 1) for vol in (1, 2) for i in range(3)], "src bigint, dst bigint")
    g = V.measure_radii(G.Graph(v, e), binary)
    want = {(r.vol_id, r.x, r.y, r.z): r.v for r in M.distance_transform(binary).collect()}
    got = g.vertices.collect()
    assert len(got) == 8 and all(r.radius == want[r.vol_id, r.x, r.y, r.z] for r in got) and len(g.edges.collect()) == 6
    mask = binary.withColumn("v", F.col("vol_id") - 1)
    assert {(r.vid, r.artery_binary) for r in V.set_artery_binary(G.Graph(v, e), mask).vertices.collect()} == {(r.vid, r.vol_id == 2) for r in got}
    marked = V.annotate(G.Graph(v, e), binary.withColumn("id", F.col("vol_id"))).vertices.collect()
    assert len(marked) == 8 and all(r.annotation == r.vol_id for r in marked)
    assert V.distance_to_surface(V.annotate(G.Graph(v, e), binary.withColumn("id", F.col("vol_id"))), binary).edges.count() == 6
    with pytest.raises(Exception, match="several volumes"):
        V.annotate(G.Graph(v.drop("vol_id"), e), binary.withColumn("id", F.col("vol_id"))).vertices.collect()


def test_parallel_edges_are_judged_apart(spark):
    rows = [(1, 2, True, 5.0, False), (1, 2, False, 0.0, False), (2, 3, False, 5.0, False), (2, 3, False, 0.0, False), (3, 4, True, 5.0, False), (7, 8, True, 5.0, False), (7, 8, False, 5.0, True)]
    e = spark.createDataFrame(rows, "src bigint, dst bigint, artery boolean, radius double, vein boolean")
    g = G.Graph(spark.range(1, 9).select(F.col("id").alias("vid")), e)
    marks = lambda df, c: sorted((r.src, r.dst, r[c]) for r in df.select("src", "dst", c).collect())
    assert marks(g.trace_edges("artery", F.col("radius") > 1), "artery") == [(1, 2, False), (1, 2, True), (2, 3, False), (2, 3, True), (3, 4, True), (7, 8, True), (7, 8, True)]
    assert marks(V.remove_small_components(g, "artery", 1).edges, "artery") == sorted((r[0], r[1], r[2]) for r in rows)
    assert not any(m[2] for m in marks(V.remove_small_components(g, "artery", 2).edges, "artery"))
    assert marks(V.pre_filter_arteries(g, artery="artery", least_edges=1).edges, "artery") == sorted((r[0], r[1], r[2] and not r[4]) for r in rows)
    assert marks(V.trace_veins(g, 0, 1.0), "vein") == [(1, 2, False)] * 2 + [(2, 3, False)] * 2 + [(3, 4, False), (7, 8, False), (7, 8, True)]
    assert len(V.trace_veins(g, 1, 1.0).collect()) == len(rows) and g.trace_edges("artery", F.lit(True), 0).count() == len(rows)


def _dense(p, q, d, n):
    a = np.zeros((len(p) + 1, n))
    a[np.arange(len(p)), q] += 1
    a[np.arange(len(p)), p] -= 1
    a[len(p), 0] = 1
    return np.linalg.lstsq(a, np.vstack([d, np.zeros(d.shape[1])]), rcond=None)[0]


def test_conjugate_gradients_are_the_dense_solution():
    r = np.random.default_rng(4)
    for n in (1, 2, 5, 40, 120):
        tree = [(int(r.integers(0, i)), i) for i in range(1, n)]
        more = [tuple(map(int, r.choice(n, 2, replace=False))) for _ in range(2 * n)] if n > 2 else []
        p, q = (np.array([e[i] for e in tree + more], int) for i in (0, 1))
        if not len(p):
            continue
        d = r.normal(0, 30, (len(p), 3))
        assert np.allclose(P.solve_layout(p, q, d, n), _dense(p, q, d, n), atol=1e-6)


def test_a_mosaic_of_many_slices():
    """A grid of 10^5 slices with noise: residuals are at right angles to every move of a slice."""
    side = 320
    at = np.arange(side * side).reshape(side, side)
    p, q = np.concatenate([at[:-1].ravel(), at[:, :-1].ravel()]), np.concatenate([at[1:].ravel(), at[:, 1:].ravel()])
    d = np.random.default_rng(1).normal(10, 3, (len(p), 3))
    x = P.solve_layout(p, q, d, side * side, 1e-8)
    e = x[q] - x[p] - d
    force = np.stack([np.bincount(q, e[:, c], side * side) - np.bincount(p, e[:, c], side * side) for c in range(3)])
    assert np.abs(force).max() < 1e-3 and (x[0] == 0).all()


@pytest.mark.parametrize("task_alignments", [1_000_000, 6])
def test_positions_in_tasks_and_in_rounds(spark, task_alignments):
    r = np.random.default_rng(6)
    pairs = [(0, 1), (1, 2), (2, 3), (3, 0), (0, 2), (1, 3), (2, 4), (10, 11), (11, 12), (12, 10)]
    rows = [(a, b, *map(float, r.normal(0, 9, 3)), 1.0) for a, b in pairs]
    tiles = spark.createDataFrame([(i,) for i in [0, 1, 2, 3, 4, 10, 11, 12, 20]], "tile bigint")
    df = spark.createDataFrame(rows, "pre bigint, post bigint, dx double, dy double, dz double, quality double")
    got = {g.tile: (g.component, g.x, g.y, g.z) for g in P.positions_from_optimization(tiles, df, task_alignments=task_alignments).collect()}
    for ids in ([0, 1, 2, 3, 4], [10, 11, 12]):
        own = [row for row in rows if row[0] in ids]
        want = _dense(np.array([ids.index(row[0]) for row in own]), np.array([ids.index(row[1]) for row in own]), np.array([row[2:5] for row in own]), len(ids))
        assert np.allclose([got[i][1:] for i in ids], want, atol=1e-6) and len({got[i][0] for i in ids}) == 1
    assert got[20][1:] == (0.0, 0.0, 0.0)


def _p(a, b, equal):
    """Two-sided p of a t-test by numerical integration."""
    m, n = len(a), len(b)
    va, vb = np.var(a, ddof=1), np.var(b, ddof=1)
    if equal:
        df, se = m + n - 2, math.sqrt(((m - 1) * va + (n - 1) * vb) / (m + n - 2) * (1 / m + 1 / n))
    else:
        se = math.sqrt(va / m + vb / n)
        df = (va / m + vb / n) ** 2 / ((va / m) ** 2 / (m - 1) + (vb / n) ** 2 / (n - 1))
    t = (np.mean(a) - np.mean(b)) / se
    x = np.linspace(0, abs(t), 200_001)
    y = (1 + x * x / df) ** (-(df + 1) / 2) * math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi)
    return t, 1 - 2 * float(np.sum((y[1:] + y[:-1]) / 2) * (x[1] - x[0]))


def test_group_reports_end_to_end(spark, tmp_path):
    """Two groups of samples in folders: cells to a summary with p-values, densities to colored p-values."""
    r = random.Random(3)
    ids, counts = [440, 7, 201], {}
    folders = {"a": [], "b": []}
    for g in "ab":
        for s in range(4):
            folder = tmp_path / f"{g}{s}"
            cells, density = [], []
            for k, i in enumerate(ids):
                for h in (0, 255):
                    n = 10 + 5 * k + (20 if g == "b" and i == 7 else 0) + r.randint(0, 4)
                    counts[g, s, i, h] = n
                    cells += [(i, h, "x")] * n
                    density.append((k, h // 255, 0, float(n)))
            density.append((9, 9, 9, 0.0))
            spark.createDataFrame(cells, "id int, hemisphere int, name string").write.parquet(f"{folder}/cells.parquet")
            spark.createDataFrame(density, "x int, y int, z int, v double").write.parquet(f"{folder}/density.parquet")
            folders[g].append(str(folder))
    volumes = spark.createDataFrame([(i, h, 2.0) for i in ids for h in (0, 255)], "id int, hemisphere int, volume double")
    first, second = (R.read_group(spark, folders[g]) for g in "ab")
    rows = {(x.id, x.hemisphere): x for x in R.summary(first, second, ("a", "b"), volumes).collect()}
    assert sorted(rows) == sorted((i, h) for i in ids for h in (0, 255))
    for (i, h), x in rows.items():
        a, b = ([counts[g, s, i, h] for s in range(4)] for g in "ab")
        t, p = _p(a, b, True)
        assert (x["a_counts_a1"], x["b_counts_b3"]) == (a[1], b[3])
        assert x.mean_a == pytest.approx(np.mean(a)) and x.sd_b == pytest.approx(np.std(b, ddof=1))
        assert x.p_value == pytest.approx(p, abs=1e-7) and x.p_sign == (-1 if t < 0 else 1) and x.q_value >= x.p_value - 1e-12
    d1, d2 = (R.read_group(spark, folders[g], "density") for g in "ab")
    assert R.are_comparable(d1.unionByName(d2)) and not R.are_comparable(d1.filter("sample <> 'a1' or x <> 9"))
    assert {(x.x, x.y): x.v for x in R.average_density(d1).collect()}[1, 0] == pytest.approx(np.mean([counts["a", s, 7, 0] for s in range(4)]))
    for x in R.density_p_values(d1, d2).collect():
        if x.x == 9:
            assert (x.t, x.p, x.r, x.g, x.b) == (0.0, 1.0, 0, 0, 0)
            continue
        t, p = _p(*([counts[g, s, ids[x.x], 255 * x.y] for s in range(4)] for g in "ab"), False)
        assert (x.t, x.p) == (pytest.approx(t), pytest.approx(p, abs=1e-7))
        low = 0.05 - min(p, 0.05)
        assert (x.r, x.b) == (pytest.approx(255 * low * (t > 0), abs=1e-4), pytest.approx(255 * (0.01 - min(p, 0.01)) * (t <= 0), abs=1e-4))
