"""Queries of transforms from parameter files, over line items as points and embeddings as one volume."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tessera.operators import nonrigid as N
from tessera.plans import fixtures as fx
from tessera.plans.scratch import Scratch
from tessera.registry import register
from tessera.sources import point_files

_SIZE = (8, 7, 6)
_LINEAR = N.Affine(np.array([[1.1, 0.05, 0.0], [-0.1, 0.9, 0.2], [0.0, 0.1, 1.2]]), np.array([0.7, -0.3, 0.4]))


def _coefficients() -> np.ndarray:
    c, i, j, k = np.indices((3, *_SIZE))
    return ((7 * i + 13 * j + 29 * k + 5 * c) % 11 - 5) / 10


def _spline(spacing, origin) -> N.Spline:
    return N.Spline(_coefficients(), np.array(spacing), np.array(origin))


_POINTS = _spline((14.3, 3.7, 3.1), (-17.937, -5.371, -4.313))
_SLAB = _spline((31.3, 3.9, 4.1), (-37.7, -5.1, -5.3))


def _shift_sql(s: N.Spline, source: str, at: str, keys: str) -> str:
    """The spline's shift dx, dy, dz of the rows of ``source`` (keys, px, py, pz) inside its valid part."""
    node = [f"({p} - ({s.origin[a]})) / {s.spacing[a]}" for a, p in enumerate(("px", "py", "pz"))]
    valid = " AND ".join(f"{n} BETWEEN 1 AND {_SIZE[a] - 2}" for a, n in enumerate(node))
    b = lambda u: f"(CASE WHEN abs({u}) < 1 THEN (4 - 6 * abs({u}) ** 2 + 3 * abs({u}) ** 3) / 6 WHEN abs({u}) < 2 THEN (2 - abs({u})) ** 3 / 6 ELSE 0 END)"
    value = lambda c: f"(CAST((7 * i + 13 * j + 29 * k + {5 * c}) % 11 - 5 AS DOUBLE) / 10)"
    w = " * ".join(b(f"(c{a} - {n})") for a, n in enumerate("ijk"))
    first = lambda a: f"least(CAST(floor(c{a}) AS BIGINT) - 1, {_SIZE[a] - 4})"
    step = lambda a, n: f"(SELECT unnest(range({first(a)}, {first(a)} + 4)) AS {n}) AS t{n}"
    sums = ", ".join(f"sum({w} * {value(c)}) AS d{a}" for c, a in enumerate("xyz"))
    return f"{at} AS (SELECT {keys}, {sums} FROM (SELECT {keys}, {', '.join(f'{n} AS c{a}' for a, n in enumerate(node))} FROM {source} WHERE {valid}), LATERAL {step(0, 'i')}, LATERAL {step(1, 'j')}, LATERAL {step(2, 'k')} GROUP BY {keys})"


_AFFINE_SQL = ", ".join(f"{' + '.join(f'({m}) * {a}' for m, a in zip(row, 'xyz'))} + ({o}) AS p{c}" for row, o, c in zip(_LINEAR.matrix, _LINEAR.offset, "xyz"))
_CHAIN_SQL = f"""WITH {fx.POINTS_SQL}, places AS (SELECT DISTINCT x, y, z FROM points), moved AS (SELECT x, y, z, {_AFFINE_SQL} FROM places),
{_shift_sql(_POINTS, "moved", "shifts", "x, y, z")}"""


def _chain(spark, step: N.Spline) -> N.Transform:
    """An affine step and a spline, written as two parameter files and read again."""
    folder = f"{Scratch(spark, 'transform').path}/files"
    rows = [("linear.txt", N.parameter_text(_LINEAR)), ("spline.txt", N.parameter_text(step, "linear.txt"))]
    from tessera.sources.sliced import write_volumes

    write_volumes(spark.createDataFrame(rows, "name string, text string").select("name", F.encode("text", "utf-8").alias("content")), folder, F.col("name"))
    return N.read_transform(f"{folder}/spline.txt")


@register("transform_points_bspline", f"""{_CHAIN_SQL} SELECT p.w, round(px + coalesce(dx, 0), 6) + 0.0 AS x, round(py + coalesce(dy, 0), 6) + 0.0 AS y, round(pz + coalesce(dz, 0), 6) + 0.0 AS z
FROM points p JOIN moved m ON p.x = m.x AND p.y = m.y AND p.z = m.z LEFT JOIN shifts s ON p.x = s.x AND p.y = s.y AND p.z = s.z""")
def _points(spark, sf_dir):
    moved = N.transform_points(fx.points(spark, sf_dir), _chain(spark, _POINTS))
    return moved.select("w", *[(F.round(a, 6) + 0.0).alias(a) for a in "xyz"])


@register("inverse_transform_points", f"WITH {fx.POINTS_SQL} SELECT x, y, z, w FROM points")
def _inverse(spark, sf_dir):
    t = N.Transform(((N.COMPOSE, _LINEAR), (N.COMPOSE, N.Spline(_coefficients(), np.array((25.3, 9.7, 11.1)), np.array((-60.0, -25.0, -25.0))))))
    back = N.inverse_points(N.transform_points(fx.points(spark, sf_dir), t), t)
    return back.filter("residual < 1e-8").select("w", *[(F.round(a, 5) + 0.0).alias(a) for a in "xyz"])


_SLAB_SHIFTS = f"WITH {fx.SLAB_SQL}, places AS (SELECT x, y, z, v, CAST(x AS DOUBLE) AS px, CAST(y AS DOUBLE) AS py, CAST(z AS DOUBLE) AS pz FROM slab), {_shift_sql(_SLAB, 'places', 'shifts', 'x, y, z')}"


@register("deformation_field", f"{_SLAB_SHIFTS} SELECT x, y, z, {', '.join(f'round(coalesce(d{a}, 0), 6) + 0.0 AS d{a}' for a in 'xyz')} FROM places LEFT JOIN shifts USING (x, y, z)")
def _field(spark, sf_dir):
    field = N.deformation_field(fx.slab(spark, sf_dir).select("x", "y", "z"), N.Transform(((N.COMPOSE, _SLAB),)))
    return field.select("x", "y", "z", *[(F.round(f"d{a}", 6) + 0.0).alias(f"d{a}") for a in "xyz"])


@register("transform_volume_bspline", f"""{_SLAB_SHIFTS}, n AS (SELECT max(x) AS m FROM slab), t AS (SELECT x, y, z, px + coalesce(dx, 0) AS tx, py + coalesce(dy, 0) AS ty, pz + coalesce(dz, 0) AS tz FROM places LEFT JOIN shifts USING (x, y, z)),
c AS (SELECT t.x, t.y, t.z, s.v * (1 - abs(tx - s.x)) * (1 - abs(ty - s.y)) * (1 - abs(tz - s.z)) AS share
  FROM t JOIN (VALUES (0), (1)) a(i) ON TRUE JOIN (VALUES (0), (1)) b(j) ON TRUE JOIN (VALUES (0), (1)) d(k) ON TRUE
  JOIN slab s ON s.x = CAST(floor(tx) AS INTEGER) + i AND s.y = CAST(floor(ty) AS INTEGER) + j AND s.z = CAST(floor(tz) AS INTEGER) + k
  WHERE tx BETWEEN 0 AND (SELECT m FROM n) AND ty BETWEEN 0 AND 7 AND tz BETWEEN 0 AND 7)
SELECT x, y, z, round(sum(share), 4) AS v FROM c GROUP BY x, y, z""")
def _volume(spark, sf_dir):
    slab = fx.slab(spark, sf_dir)
    shape = (slab.agg(F.max("x")).first()[0] + 1, 8, 8)
    out = N.transform_volume(slab, shape, shape, N.Transform(((N.COMPOSE, _SLAB),)))
    return out.select("x", "y", "z", F.round("v", 4).alias("v"))


def _files(binary: bool):
    def run(spark, sf_dir):
        folder = f"{Scratch(spark, 'points').path}/files"
        point_files.write_points(fx.points(spark, sf_dir), folder, binary=binary, rows=5000)
        back = point_files.read_points(spark, f"{folder}/*.bin", 2000) if binary else point_files.read_text_points(spark, folder)
        return back.select("x", "y", "z")

    return run


for _name, _binary in (("binary", True), ("text", False)):
    register(f"point_files_{_name}", f"WITH {fx.POINTS_SQL} SELECT x, y, z FROM points")(_files(_binary))
