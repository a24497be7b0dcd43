"""Steps that once took a Python group, a broadcast or a nested loop for what is small or many."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import slice_tracing as T
from tessera.operators import spatial as P
from tessera.plans import pipelines


def _plan(df):
    return df._jdf.queryExecution().toString()


def _boxes(spark, n, seed):
    r = np.random.default_rng(seed)
    rows = [(i, *[int(v) for v in r.integers(-40, 40, 3)]) for i in range(n)]
    sizes = r.integers(1, 30, (n, 3)).tolist()
    return spark.createDataFrame([(t, *lo, *[a + b for a, b in zip(lo, size)]) for (t, *lo), size in zip(rows, sizes)], "tile long, lox long, loy long, loz long, hix long, hiy long, hiz long")


@pytest.mark.parametrize("cells", [1, 40, 1 << 18])
def test_slices_are_compared_in_packs(spark, monkeypatch, cells):
    monkeypatch.setattr(T, "CELLS", cells)
    r = np.random.default_rng(cells)
    rows = [(p, p + 1, side, x, y, s, float(r.integers(0, 9))) for p in range(6) for s in range(3) for side in (0, 1) for x in range(p, 3 + p) for y in range(2 + s) if r.random() < 0.8]
    df = spark.createDataFrame(rows, "pre long, post long, side int, x int, y int, z int, v double")
    got = T.slice_errors(df, max_shift=1)
    assert "FlatMapGroupsInPandas" not in _plan(got)
    at = {(p, side, x, y, s): v for p, _, side, x, y, s, v in rows}
    want = {}
    for (p, side, x, y, s), v in at.items():
        for i in (-1, 0, 1):
            for j in (-1, 0, 1):
                other = at.get((p, 1, x - i, y - j, s))
                if side == 0 and other is not None:
                    want.setdefault((p, s, i, j), []).append((v - other) ** 2)
    assert {(g.pre, g.s, g.dx, g.dy): (round(g.error, 9), g.n) for g in got.collect()} == {k: (round(float(np.mean(v)), 9), len(v)) for k, v in want.items()}


def test_components_are_solved_side_by_side(spark):
    r = np.random.default_rng(5)
    p, q, d, part, parts = [], [], [], [], []
    for k, n in enumerate([1, 4, 30, 2, 1, 12]):
        a = [i for i in range(1, n)] + (r.integers(0, n, 2 * n).tolist() if n > 2 else [])
        b = [int(r.integers(0, i)) for i in range(1, n)] + (r.integers(0, n, 2 * n).tolist() if n > 2 else [])
        e = np.array([(x, y) for x, y in zip(a, b) if x != y], int).reshape(-1, 2)
        shift = r.normal(size=(len(e), 3))
        parts.append((len(part), n, e, shift))
        p += (e[:, 0] + len(part)).tolist()
        q += (e[:, 1] + len(part)).tolist()
        d += shift.tolist()
        part += [k] * n
    got = P.solve_layouts(np.array(p), np.array(q), np.array(d), np.array(part))
    for first, n, e, shift in parts:
        m = np.zeros((len(e), n))
        m[np.arange(len(e)), e[:, 1]] += 1
        m[np.arange(len(e)), e[:, 0]] -= 1
        want = np.linalg.lstsq(m, shift, rcond=None)[0] if len(e) else np.zeros((n, 3))
        assert np.allclose(got[first : first + n], want - want[0], atol=1e-7)
    tiles = spark.range(5).select(F.col("id").alias("tile"))
    pairs = spark.createDataFrame([(0, 1, 1.0, 0.0, 0.0, 1.0), (3, 4, 2.0, 0.0, 0.0, 1.0)], "pre long, post long, dx double, dy double, dz double, quality double")
    out = P.positions_from_optimization(tiles, pairs)
    assert "FlatMapGroupsInPandas" not in _plan(out)
    assert sorted((r.tile, r.component, round(r.x, 9)) for r in out.collect()) == [(0, 0, 0.0), (1, 0, 1.0), (2, 2, 0.0), (3, 3, 0.0), (4, 3, 2.0)]


def test_overlaps_broadcast_no_cells(spark):
    tiles = _boxes(spark, 60, 1)
    got = P.overlaps(tiles, 8)
    assert "Broadcast" not in _plan(got)
    rows = tiles.collect()
    want = {(a.tile, b.tile, *[f(a[f"{n}{x}"], b[f"{n}{x}"]) for x in "xyz" for n, f in (("lo", max), ("hi", min))]) for a in rows for b in rows if a.tile < b.tile and all(max(a[f"lo{x}"], b[f"lo{x}"]) < min(a[f"hi{x}"], b[f"hi{x}"]) for x in "xyz")}
    assert sorted(tuple(r) for r in got.select("pre", "post", *[f"{n}{x}" for x in "xyz" for n in ("lo", "hi")]).collect()) == sorted(want)


@pytest.mark.parametrize("few", [0, 100_000])
def test_embedding_joins_by_equality(spark, few):
    tiles = _boxes(spark, 12, 2)
    got = pipelines.embedding(tiles, few)
    assert "NestedLoop" not in _plan(got) and "CartesianProduct" not in _plan(got)
    rows, want = tiles.collect(), {}
    cuts = {x: sorted({r[f"{n}{x}"] for r in rows for n in ("lo", "hi")}) for x in "xyz"}
    for r in rows:
        parts = [[(a, b) for a, b in zip(cuts[x], cuts[x][1:]) if r[f"lo{x}"] <= a and b <= r[f"hi{x}"]] for x in "xyz"]
        for i in parts[0]:
            for j in parts[1]:
                for k in parts[2]:
                    want.setdefault((*i, *j, *k), []).append(r.tile)
    assert {tuple(r[f"{n}{x}"] for x in "xyz" for n in ("lo", "hi")): r.tiles for r in got.collect()} == want
