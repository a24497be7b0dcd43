"""Transforms from parameter files against sums over all nodes, joins against arrays, inverses, volumes, point files."""

import itertools
import struct

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.operators import nonrigid as N
from tessera.sources import point_files

RNG = np.random.default_rng(3)


def _spline(order=3, size=(7, 6, 8), scale=1.0, turned=False):
    angle = N._rotation(np.array([0.1, -0.2, 0.3]), False) if turned else np.eye(3)
    return N.Spline(RNG.normal(size=(3, *size)) * scale, np.array([3.0, 4.0, 2.5]), np.array([-4.0, -5.0, -3.0]), angle, np.array([1.0, 0.0, -1.0]) if turned else np.zeros(3), order)


def _plain(s: N.Spline, p):
    """Sum over all nodes of the grid, one point and one node at a time."""

    def b(u):
        u = abs(u)
        if s.order == 1:
            return max(0.0, 1 - u)
        if s.order == 2:
            return 0.75 - u**2 if u < 0.5 else (1.5 - u) ** 2 / 2 if u < 1.5 else 0.0
        return 2 / 3 - u**2 + u**3 / 2 if u < 1 else (2 - u) ** 3 / 6 if u < 2 else 0.0

    c = np.linalg.solve(s.direction @ np.diag(s.spacing), p - s.origin) - s.index
    half = (s.order - 1) / 2
    if any(c[a] < half or c[a] > s.size[a] - 1 - half for a in range(3)):
        return p
    nodes = itertools.product(*(range(n) for n in s.size))
    return p + sum(s.coefficients[:, i, j, k] * b(c[0] - i) * b(c[1] - j) * b(c[2] - k) for i, j, k in nodes)


def _frame(spark, p):
    return spark.createDataFrame(pd.DataFrame({"n": np.arange(len(p)), "x": p[:, 0], "y": p[:, 1], "z": p[:, 2]}))


def _rows(df):
    return np.array([[r.x, r.y, r.z] for r in df.orderBy("n").collect()])


@pytest.mark.parametrize("order", [1, 2, 3])
@pytest.mark.parametrize("turned", [False, True])
def test_spline_is_the_sum_over_all_nodes(order, turned):
    s = _spline(order, turned=turned)
    p = RNG.uniform(-8, 20, (60, 3))
    want = np.array([_plain(s, q) for q in p])
    assert np.allclose(s(p), want) and 0 < (want != p).any(axis=1).sum() < 60


@pytest.mark.parametrize("order", [1, 3])
@pytest.mark.parametrize("how", [N.COMPOSE, N.ADD])
def test_joins_give_what_arrays_give(spark, monkeypatch, order, how):
    t = N.Transform(((N.COMPOSE, N.Affine(np.eye(3) * 0.9, np.array([1.0, 0.5, 0.2]))), (how, _spline(order, turned=True)), (how, _spline(order))))
    p = np.vstack([RNG.uniform(-8, 20, (50, 3)), [[np.nan, 1, 1]], [[np.inf, 0, 0]], RNG.uniform(0, 1, (1, 3)).repeat(3, 0)])
    points = _frame(spark, p).withColumn("y", F.when(F.col("n") != 3, F.col("y")))
    small = N.transform_points(points, t)
    monkeypatch.setattr(N, "GRID_BYTES", 0)
    large = N.transform_points(points, t)
    assert small.columns == large.columns == ["n", "x", "y", "z"]
    a, b = (_rows(d).astype(object) for d in (small, large))
    none = [3, 50, 51]
    assert all((v[none] == None).all() for v in (a, b))  # noqa: E711
    kept = np.delete(np.arange(len(p)), none)
    assert np.allclose(a[kept].astype(float), b[kept].astype(float)) and np.allclose(a[kept].astype(float), t(p[kept]))
    with pytest.raises(ValueError):
        N.inverse_points(points, t)


def test_no_points_and_no_steps(spark):
    t = N.Transform(())
    p = RNG.normal(size=(4, 3))
    assert np.allclose(_rows(N.transform_points(_frame(spark, p), t)), p)
    assert N.transform_points(_frame(spark, p).filter("n < 0"), N.Transform(((N.COMPOSE, _spline()),))).count() == 0


def test_parameter_files(tmp_path):
    s, a = _spline(turned=True), N.Affine(RNG.normal(size=(3, 3)), RNG.normal(size=3))
    (tmp_path / "a.txt").write_text(N.parameter_text(a))
    (tmp_path / "s.txt").write_text("// a comment\n" + N.parameter_text(s, "a.txt"))
    (tmp_path / "t.txt").write_text(N.parameter_text(s, str(tmp_path / "a.txt"), N.ADD))
    p = RNG.uniform(-5, 15, (40, 3))
    assert np.allclose(N.read_transform(str(tmp_path / "s.txt"))(p), s(a(p)))
    assert np.allclose(N.read_transform(str(tmp_path / "t.txt"))(p), a(p) + s(p) - p)
    (tmp_path / "loop.txt").write_text(N.parameter_text(a, "loop.txt"))
    with pytest.raises(ValueError):
        N.read_transform(str(tmp_path / "loop.txt"))
    for text in ('(Transform "SplineKernelTransform")\n(NumberOfParameters 0)', '(Transform "TranslationTransform")\n(NumberOfParameters 3)\n(TransformParameters 1 2)'):
        with pytest.raises(ValueError):
            N.transform_of(N.parse_parameters(text))


def test_kinds_of_linear_steps():
    centre = np.array([1.0, 2.0, 3.0])
    move = N.transform_of(N.parse_parameters('(Transform "TranslationTransform")\n(NumberOfParameters 3)\n(TransformParameters 1 -2 0.5)'))
    assert np.allclose(move(centre[None]), [[2, 0, 3.5]])
    turn = N.transform_of(N.parse_parameters(f'(Transform "EulerTransform")\n(NumberOfParameters 6)\n(TransformParameters 0 0 {np.pi / 2} 10 0 0)\n(CenterOfRotationPoint 1 2 3)\n(ComputeZYX "false")'))
    assert np.allclose(turn(np.array([centre, centre + [1, 0, 0]])), [centre + [10, 0, 0], centre + [10, 1, 0]])
    affine = N.transform_of(N.parse_parameters('(Transform "AffineTransform")\n(NumberOfParameters 12)\n(TransformParameters 2 0 0 0 1 1 0 0 1 5 6 7)\n(CenterOfRotationPoint 1 2 3)'))
    assert np.allclose(affine(centre[None] + [1, 1, 1]), [centre + [2, 2, 1] + [5, 6, 7]])


def test_first_axis_of_the_grid_is_fastest():
    text = N.parameter_text(N.Spline(np.arange(3 * 4 * 5 * 6.0).reshape(3, 6, 5, 4), np.ones(3), np.zeros(3)))
    values = N.parse_parameters(text)["TransformParameters"]
    grid = np.arange(360.0).reshape(3, 6, 5, 4)
    assert values[:3] == [grid[0, 0, 0, 0], grid[0, 1, 0, 0], grid[0, 2, 0, 0]] and values[6] == grid[0, 0, 1, 0] and values[120] == grid[1, 0, 0, 0]


def test_inverse(spark):
    t = N.Transform(((N.COMPOSE, N.Affine(np.array([[1.2, 0.1, 0], [0, 0.8, 0.1], [0.2, 0, 1.0]]), np.array([0.5, 0, -0.2]))), (N.COMPOSE, N.Spline(RNG.normal(size=(3, 12, 12, 12)) * 0.3, np.full(3, 3.0), np.full(3, -12.0)))))
    p = RNG.uniform(-2, 10, (200, 3))
    back = N.inverse_points(_frame(spark, t(p)), t)
    assert np.allclose(_rows(back), p, atol=1e-7) and back.filter("residual > 1e-9").count() == 0
    folded = N.Transform(((N.COMPOSE, N.Spline(RNG.normal(size=(3, 12, 12, 12)) * 30, np.full(3, 3.0), np.full(3, -12.0))),))
    assert N.inverse_points(_frame(spark, p), folded, rounds=5).filter("residual > 1e-9").count() > 0


@pytest.mark.parametrize("linear", [True, False])
def test_volume(spark, linear):
    t = N.Transform(((N.COMPOSE, N.Affine(np.eye(3), np.array([0.3, -0.2, 0.4]))), (N.COMPOSE, _spline(scale=0.4))))
    source, shape = RNG.normal(size=(2, 6, 7, 5)), (5, 6, 7)
    vox = spark.createDataFrame([(v, x, y, z, float(source[v, x, y, z])) for v, x, y, z in np.ndindex(*source.shape)], "vol_id bigint, x int, y int, z int, v double")
    got = {(r.vol_id, r.x, r.y, r.z): r.v for r in N.transform_volume(vox, source.shape[1:], shape, t, linear).collect()}
    want = {}
    for place in np.ndindex(*shape):
        q = t(np.array([place], float))[0]
        if (q >= 0).all() and (q <= np.array(source.shape[1:]) - 1).all():
            for v in range(2):
                if linear:
                    near = itertools.product(*(range(n) for n in source.shape[1:]))
                    want[(v, *place)] = sum(source[(v, *n)] * np.prod(np.maximum(0, 1 - np.abs(q - n))) for n in near)
                else:
                    want[(v, *place)] = source[(v, *np.floor(q + 0.5).astype(int))]
    assert want.keys() == got.keys() and len(want) > 100 and all(abs(want[k] - got[k]) < 1e-9 for k in want)


def test_field_keeps_other_columns(spark):
    s = _spline()
    field = N.deformation_field(N.grid_of(spark, (4, 3, 2)).withColumn("_extra", F.lit("a")), N.Transform(((N.COMPOSE, s),)), (2.0, 1.0, 0.5), (1.0, 0.0, -1.0))
    for r in field.collect():
        p = np.array([[2.0 * r.x + 1, r.y, 0.5 * r.z - 1]])
        assert np.allclose([r.dx, r.dy, r.dz], s(p)[0] - p[0]) and r._extra == "a"
    assert field.count() == 24


@pytest.mark.parametrize("binary", [True, False])
def test_point_files(spark, tmp_path, binary):
    p = np.vstack([RNG.normal(size=(57, 3)) * [1, 1e-9, 1e12], np.zeros((1, 3))])
    written = point_files.write_points(_frame(spark, p).coalesce(2), str(tmp_path / "out"), indices=True, binary=binary, rows=10)
    assert sum(r.n_points for r in written.collect()) == 58 and max(r.n_points for r in written.collect()) == 10
    path = written.first()["path"]
    assert point_files.are_indices(path)
    back = point_files.read_points(spark, f"{tmp_path}/out/*.bin", 3) if binary else point_files.read_text_points(spark, str(tmp_path / "out"))
    assert sorted((r.x, r.y, r.z) for r in back.collect()) == sorted(map(tuple, p.tolist()))
    with pytest.raises(Exception, match="without a coordinate"):
        point_files.write_points(_frame(spark, p).withColumn("x", F.lit(None).cast("double")), str(tmp_path / "none"))


def test_binary_layout(spark, tmp_path):
    (tmp_path / "p.bin").write_bytes(struct.pack("<qq6d", 0, 2, 1, 2, 3, 4, 5, 6))
    (tmp_path / "q.bin").write_bytes(struct.pack("<qq", 0, 0))
    rows = point_files.read_points(spark, f"{tmp_path}/*.bin").collect()
    assert sorted((r.pos, r.x, r.y, r.z) for r in rows) == [(0, 1, 2, 3), (1, 4, 5, 6)]
    (tmp_path / "q.bin").write_bytes(struct.pack("<qq", 0, 1))
    with pytest.raises(ValueError):
        point_files.read_points(spark, f"{tmp_path}/q.bin")


def test_reported_points(spark, tmp_path):
    line = "Point\t{}\t; InputIndex = [ {} 2 3 ]\t; InputPoint = [ 1.5 2.5 -3.0e-01 ]\t; OutputIndexFixed = [ 4 5 6 ]\t; OutputPoint = [ {}.25 -8 9 ]\t; Deformation = [ 1 0 0 ]"
    (tmp_path / "out.txt").write_text("\n".join(line.format(i, i, i) for i in range(3)) + "\n")
    got = {r.point: (r.x, r.y, r.z) for r in point_files.read_reported_points(spark, str(tmp_path / "out.txt")).collect()}
    assert got == {i: (i + 0.25, -8.0, 9.0) for i in range(3)}
    assert {r.x for r in point_files.read_reported_points(spark, str(tmp_path / "out.txt"), "InputIndex").collect()} == {0.0, 1.0, 2.0}
    assert {r.z for r in point_files.read_reported_points(spark, str(tmp_path / "out.txt"), "InputPoint").collect()} == {-0.3}
