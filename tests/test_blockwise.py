"""Operators that run block by block give what a whole volume gives: thinning, watersheds, smoothing by configuration."""

import functools
import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import configuration as C
from tessera.operators import flooding, thinning
from tessera.operators import neighbourhoods as N
from tessera.operators.convolve import cube_codes

VOX = "vol_id bigint, x int, y int, z int, v double"


def _rows(a, vol=0, low=(0, 0, 0)):
    return [(vol, *(int(i + o) for i, o in zip(p, low)), float(a[p])) for p in np.ndindex(a.shape)]


def _blobs(seed, shape):
    r = np.random.default_rng(seed)
    a = r.random(shape)
    for axis in range(3):
        a = (a + np.roll(a, 1, axis) + np.roll(a, -1, axis)) / 3
    return a


@functools.cache
def _thin_bytes(data, shape):
    return _thin(np.frombuffer(data, np.int64).reshape(shape))


def _thin(a):
    """Whole volume, voxel by voxel, with neighbourhoods turned back instead of masks turned forward."""
    on = np.pad(a > 0, 1)
    step = 0
    went = {}
    while True:
        step += 1
        border = [p for p in map(tuple, np.argwhere(on)) if not all(on[tuple(np.add(p, d))] for d in thinning._FACES)]
        before = len(went)
        for i, turns in enumerate(thinning.DIRECTIONS):
            hit = []
            for p in border:
                if on[p]:
                    cube = on[p[0] - 1 : p[0] + 2, p[1] - 1 : p[1] + 2, p[2] - 1 : p[2] + 2]
                    for axis, steps in reversed(turns):
                        cube = N.rotate(cube, axis, -steps)
                    if _goes(cube):
                        hit.append(p)
            for p in hit:
                on[p] = False
                went[tuple(c - 1 for c in p)] = 12 * step + i
        if len(went) == before:
            return {tuple(c - 1 for c in p) for p in map(tuple, np.argwhere(on))}, went


def _goes(cube):
    at = lambda cells: [bool(cube[tuple(map(int, c))]) for c in cells.split()]
    for on, off, some, not_both, one in thinning.MASKS:
        pairs = lambda text: [at(p.replace("-", " ")) for p in text.split()]
        if all(at(on)) and not any(at(off)) and (not some or any(at(some))) and not any(all(p) for p in pairs(not_both)) and all(p[0] != p[1] for p in pairs(one)):
            return True
    return False


def _parts(cells, near):
    left, n = set(cells), 0
    while left:
        n += 1
        stack = [left.pop()]
        while stack:
            p = stack.pop()
            hit = [q for q in (tuple(np.add(p, d)) for d in near) if q in left]
            left.difference_update(hit)
            stack += hit
    return n


_ALL = [d for d in itertools.product((-1, 0, 1), repeat=3) if any(d)]


@pytest.mark.parametrize("block", [(128, 128, 128), (5, 4, 6), (3, 16, 2)])
def test_thinning_by_blocks(spark, block):
    a = (_blobs(1, (14, 11, 12)) > 0.5).astype(int)
    b = np.zeros((9, 9, 20), int)
    b[2:7, 2:7, 2:18] = 1  # a thick bar, with a tunnel
    b[4, 4, :] = 0
    rows = _rows(a, 0, (-3, 5, 100)) + _rows(b, 1) + [(2, 0, 0, 0, 1.0), (3, 7, 7, 7, 0.0)]
    stay, gone = thinning.thin(spark.createDataFrame(rows, VOX), block=block)
    stay, gone = {tuple(r) for r in stay.collect()}, {tuple(r)[:4]: r.step for r in gone.collect()}
    for vol, (v, low) in enumerate(((a, (-3, 5, 100)), (b, (0, 0, 0)))):
        want, went = _thin_bytes(v.astype(np.int64).tobytes(), v.shape)
        shift = lambda p: tuple(int(c + o) for c, o in zip(p, low))  # noqa: E731, B023
        assert {p[1:] for p in stay if p[0] == vol} == {shift(p) for p in want}
        assert {k[1:]: s for k, s in gone.items() if k[0] == vol} == {shift(p): s for p, s in went.items()}
        before = {tuple(p) for p in np.argwhere(v > 0)}
        assert _parts(want, _ALL) == _parts(before, _ALL)  # topology stays
        holes = lambda cells: _parts({p for p in itertools.product(*[range(-1, n + 1) for n in v.shape]) if p not in cells}, [tuple(d) for d in thinning._FACES])  # noqa: E731, B023
        assert holes(want) == holes(before)
    assert (2, 0, 0, 0) in stay and not any(p[0] == 3 for p in stay)


def test_thinning_limits_and_radii(spark):
    b = np.zeros((9, 9, 20), int)
    b[2:7, 2:7, 2:18] = 1
    df = spark.createDataFrame(_rows(b), VOX)
    stay, gone = thinning.thin(df, iterations=1)
    assert {r.step // 12 for r in gone.collect()} == {1} and stay.count() + gone.count() == int(b.sum())
    stay, gone = thinning.thin(df)
    death = {(r.x, r.y, r.z): r.step for r in gone.collect()}
    near = [d for d in _ALL if sum(map(abs, d)) <= 2]
    for r in thinning.skeleton_radii(stay, gone).collect():
        assert r.v == sum(death.get((r.x + d[0], r.y + d[1], r.z + d[2]), 0) for d in near)
    assert thinning.skeletonize(df.limit(0)).count() == 0 and thinning.thin(df.limit(0))[1].count() == 0


def test_lookup_of_deletable_neighbourhoods():
    table = thinning.lookup_table()
    r = np.random.default_rng(4)
    codes = r.integers(0, 1 << 26, 2000)
    full = codes & (N.CENTRE - 1) | (codes & ~np.int64(N.CENTRE - 1)) << 1 | N.CENTRE
    assert np.array_equal(table[codes >> 3] >> (codes & 7) & 1, thinning.deletable(full).astype(np.uint8))
    assert [_goes(N.to_cube(int(c))) for c in full[:300]] == thinning.deletable(full[:300]).tolist()
    assert np.array_equal(N.without_centre(full), codes)


def _forest(values, seeds, level):
    """Best edges first, one seed a tree: the watershed of a whole volume."""
    parent, label = {}, {}
    for p, v in values.items():
        if v > level:
            parent[p], label[p] = p, seeds.get(p, 0)

    def find(p):
        while parent[p] != p:
            parent[p] = parent[parent[p]]
            p = parent[p]
        return p

    edges = []
    for p in parent:
        for axis in range(3):
            q = tuple(c + (i == axis) for i, c in enumerate(p))
            if q in parent:
                edges.append((-min(values[p], values[q]), -max(values[p], values[q]), *p, axis, p, q))
    for *_, p, q in sorted(edges):
        a, b = find(p), find(q)
        if a != b and not (label[a] and label[b]):
            parent[b] = a
            label[a] = label[a] or label[b]
    return {p: label[find(p)] for p in parent if label[find(p)]}


@pytest.mark.parametrize("block, task_edges", [((64, 64, 32), 1_000_000), ((3, 4, 2), 1_000_000), ((1, 1, 1), 1_000_000), ((3, 4, 2), 5), ((2, 2, 2), 0)])
def test_watershed_by_blocks(spark, block, task_edges):
    """Ties, plateaus, several seeds of a label, seeds below the level, parts that no seed reaches; in memory and in rounds."""
    a = np.round(_blobs(3, (8, 9, 7)) * 12)
    b = np.full((4, 4, 4), 5.0)  # a plateau
    vols = {0: (a, (-4, 3, 50)), 1: (b, (0, 0, 0))}
    r = np.random.default_rng(9)
    seeds = {vol: {} for vol in vols}
    for vol, (v, low) in vols.items():
        for k in range(7):
            p = tuple(int(r.integers(0, n)) + o for n, o in zip(v.shape, low))
            seeds[vol][p] = k // 2 + 1
    rows = [row for vol, (v, low) in vols.items() for row in _rows(v, vol, low)]
    marks = [(vol, *p, k) for vol, s in seeds.items() for p, k in s.items()]
    marks += [(vol, *p, k + 50) for vol, s in seeds.items() for p, k in s.items()] + [(0, -4, 3, 50, 0), (9, 0, 0, 0, 1)]
    got = flooding.watershed(spark.createDataFrame(rows, VOX).repartition(4), spark.createDataFrame(marks, "vol_id bigint, x int, y int, z int, label bigint"), 5.0 if task_edges else 4.0, block, task_edges).collect()
    for vol in vols:
        values = {row[1:4]: row[4] for row in rows if row[0] == vol}
        assert {(g.x, g.y, g.z): g.label for g in got if g.vol_id == vol} == _forest(values, seeds[vol], 5.0 if task_edges else 4.0)


def test_watershed_of_nothing(spark):
    df = spark.createDataFrame(_rows(np.ones((2, 2, 2))), VOX)
    marks = spark.createDataFrame([], "vol_id bigint, x int, y int, z int, label bigint")
    assert flooding.watershed(df, marks, 0).count() == 0 and flooding.watershed(df.limit(0), marks, 0).count() == 0


def _smooth_one(cube):
    """One voxel by the rules as they are told, turned by quarter turns of the array."""

    def rule(c, on, off):
        return all(c[tuple(map(int, k))] for k in on.split()) and not any(c[tuple(map(int, k))] for k in off.split())

    turned = lambda c: [N.rotate(N.rotate(N.rotate(c, 0, i), 1, j), 2, k) for i, j, k in itertools.product(range(4), repeat=3)]
    if cube[1, 1, 1]:
        return not (cube.sum() <= 2 or any(rule(c, *r) for c in turned(cube) for r in C.RULES))
    six = [cube[1, 1, 0], cube[1, 1, 2], cube[1, 0, 1], cube[1, 2, 1], cube[0, 1, 1], cube[2, 1, 1]]
    return bool(cube.sum() >= 20 or (any(six[i] and six[i + 1] for i in (0, 2, 4)) and sum(six) >= 3) or any(rule(c, *r) for c in turned(~cube) for r in C.RULES))


def test_rules_over_random_neighbourhoods():
    r = np.random.default_rng(8)
    codes = np.concatenate([(r.random((150, 27)) < p) @ (1 << np.arange(27)) for p in (0.05, 0.1, 0.2, 0.5, 0.8, 0.92)]).astype(np.int64)
    codes = np.concatenate([codes, [v for _, v in C.table()[:60]], [C.ALL ^ v for _, v in C.table()[:60]]])
    assert len(C.table()) == 74 and len(N.rotations()) == 24
    assert C.smoothed(codes).tolist() == [_smooth_one(N.to_cube(int(c))) for c in codes]
    assert all(N.to_code(N.to_cube(int(c))) == c for c in codes[:50])


@pytest.mark.parametrize("block", [(64, 64, 32), (3, 2, 4)])
def test_smoothing_by_blocks(spark, block):
    a = (_blobs(5, (8, 7, 9)) > 0.52).astype(int)
    df = spark.createDataFrame(_rows(a), VOX)
    want = a > 0
    for _ in range(2):
        wide = np.pad(want, 1)
        want = np.array([_smooth_one(wide[x : x + 3, y : y + 3, z : z + 3]) for x, y, z in np.ndindex(a.shape)]).reshape(a.shape)
    got = {(r.x, r.y, r.z): r.v for r in C.smooth_by_configuration(df, 2, block).collect()}
    assert got == {p: int(want[p]) for p in np.ndindex(a.shape)} and (want != (a > 0)).any()
    codes = {(r.x, r.y, r.z): r.v for r in cube_codes(df, block=block).collect()}
    wide = np.pad(a > 0, 1)
    assert codes == {(x, y, z): N.to_code(wide[x : x + 3, y : y + 3, z : z + 3]) for x, y, z in np.ndindex(a.shape)}


def test_thinning_sends_voxels_to_active_blocks_only(spark):
    block, at = (64, 8, 4), "vol_id bigint, x int, y int, z int"
    rows = [(0, x, y, z) for x in range(0, 256, 3) for y in range(8) for z in range(8)] + [(1, -1, -9, 70)]
    own = [F.floor(F.col(a) / s).cast("int").alias(f"o{a}") for a, s in zip("xyz", block)]
    vox = spark.createDataFrame(rows, at).select("*", *own)
    seen = {(v, bx, by, bz) for v, *p in rows for bx, by, bz in itertools.product(*(range((c - 13) // s, (c + 13) // s + 1) for c, s in zip(p, block)))}
    assert {tuple(r) for r in thinning.seers(vox, block).collect()} == seen
    near = spark.createDataFrame([(0, x, 0, z, 1, 0, 0) for x in range(4) for z in range(2)], "vol_id bigint, ox int, oy int, oz int, bx int, by int, bz int")
    for few in (True, False):
        sent = [tuple(r) for r in thinning.sent_to(vox, near, block, few).collect()]
        assert sorted(sent) == sorted((0, 1, 0, 0, x, y, z) for v, x, y, z in rows if v == 0 and 64 - 13 <= x < 128 + 13)


def test_no_mask_deletes_what_a_few_cells_rule_out():
    r = np.random.default_rng(0)
    hits = 0
    for share in (0.1, 0.25, 0.5, 0.75):
        on = np.pad(r.random((20, 20, 20)) < share, 1)
        flat, strides = on.ravel(), np.array([22 * 22, 22, 1])
        at = np.flatnonzero(on)
        for offsets in thinning._OFFSETS:
            steps = (offsets @ strides).tolist()
            codes = sum(flat[at + s].astype(np.int64) << k for k, s in enumerate(steps))
            goes = at[thinning.deletable(codes)]
            hits += len(goes)
            some = thinning.may_go(flat, at, steps)
            assert set(goes.tolist()) <= set(some.tolist()) and len(some) == len(set(some.tolist())) <= 0.95 * len(at)
    assert hits > 100
