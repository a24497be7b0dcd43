"""Transforms from registration parameter files: affine and B-spline steps, chained; points, fields, volumes, inverses.

A parameter file holds lines ``(Key value value ...)``. A file may name an initial one; it comes first, and the two are composed,
T(x) = T1(T0(x)), or added, T(x) = T0(x) + T1(x) - x. Points go from the fixed to the moving image, in physical units.

A B-spline step moves a point by the weighted coefficients of the (order + 1)^3 grid nodes around it. Points beyond the grid's
valid part, (order - 1) / 2 nodes from its border, are not moved by that step.

Grids up to ``GRID_BYTES`` go to the workers once as a broadcast array and points pass in Arrow batches without a shuffle; larger
ones become a table that the nodes of the points are joined with, with the same result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.plans.scratch import Scratch
from tessera.sources.sliced import open_file

AXES = ("x", "y", "z")
#: Coefficients that are sent to every worker.
GRID_BYTES = 64 << 20
COMPOSE, ADD = "Compose", "Add"


def parse_parameters(text: str) -> dict[str, list]:
    """The values of each key: numbers as float, quoted values as text. Lines that start with // are comments."""
    out: dict[str, list] = {}
    for line in text.splitlines():
        m = re.match(r"\s*\(\s*(\w+)(.*)\)\s*(//.*)?$", line)
        if m:
            out[m[1]] = [quoted if bare == "" else float(bare) for quoted, bare in re.findall(r'"([^"]*)"|([^\s"]+)', m[2])]
    return out


@dataclass(frozen=True)
class Affine:
    """x -> matrix x + offset."""

    matrix: np.ndarray
    offset: np.ndarray

    def __call__(self, p: np.ndarray) -> np.ndarray:
        return p @ self.matrix.T + self.offset


def basis(u, order: int):
    """The centred B-spline of order 1 to 3 at u (arrays, or columns by ``_basis_column``)."""
    a = np.abs(u)
    if order == 1:
        return np.maximum(1 - a, 0)
    if order == 2:
        return np.where(a < 0.5, 0.75 - a * a, np.where(a < 1.5, (1.5 - a) ** 2 / 2, 0))
    return np.where(a < 1, (4 - 6 * a * a + 3 * a**3) / 6, np.where(a < 2, (2 - a) ** 3 / 6, 0))


def _basis_column(u: Column, order: int) -> Column:
    a = F.abs(u)
    if order == 1:
        return F.greatest(1 - a, F.lit(0.0))
    if order == 2:
        return F.when(a < 0.5, 0.75 - a * a).when(a < 1.5, (1.5 - a) * (1.5 - a) / 2).otherwise(0.0)
    return F.when(a < 1, (4 - 6 * a * a + 3 * a * a * a) / 6).when(a < 2, (2 - a) * (2 - a) * (2 - a) / 6).otherwise(0.0)


@dataclass(frozen=True)
class Spline:
    """``coefficients[c, i, j, k]``: shift along axis c at node (i, j, k), which lies at origin + direction (spacing * (index + node))."""

    coefficients: np.ndarray
    spacing: np.ndarray
    origin: np.ndarray
    direction: np.ndarray = field(default_factory=lambda: np.eye(3))
    index: np.ndarray = field(default_factory=lambda: np.zeros(3))
    order: int = 3

    @property
    def size(self) -> np.ndarray:
        return np.array(self.coefficients.shape[1:])

    @property
    def to_nodes(self) -> Affine:
        back = np.linalg.inv(self.direction * self.spacing)
        return Affine(back, -back @ self.origin - self.index)

    def __call__(self, p: np.ndarray) -> np.ndarray:
        c = self.to_nodes(p)
        half = (self.order - 1) / 2
        inside = ((c >= half) & (c <= self.size - 1 - half)).all(axis=1)
        c = c[inside]
        first = np.minimum(np.floor(c - half).astype(int), self.size - 1 - self.order)
        w = [[basis(c[:, a] - first[:, a] - k, self.order) for k in range(self.order + 1)] for a in range(3)]
        moved = np.zeros((len(c), 3))
        for i, j, k in np.ndindex(*(self.order + 1,) * 3):
            moved += self.coefficients[:, first[:, 0] + i, first[:, 1] + j, first[:, 2] + k].T * (w[0][i] * w[1][j] * w[2][k])[:, None]
        out = p.copy()
        out[inside] += moved
        return out


@dataclass(frozen=True)
class Transform:
    """Steps in order, each with how it joins those before it."""

    steps: tuple[tuple[str, Affine | Spline], ...]

    def __call__(self, p: np.ndarray) -> np.ndarray:
        q = p
        for how, step in self.steps:
            q = step(q) if how == COMPOSE else q + step(p) - p
        return q

    def linear(self) -> Affine:
        """The transform without its splines."""
        bare = Transform(tuple(s for s in self.steps if isinstance(s[1], Affine)))
        at = bare(np.vstack([np.zeros(3), np.eye(3)]))
        return Affine((at[1:] - at[0]).T, at[0])

    def grid_bytes(self) -> int:
        return sum(s.coefficients.nbytes for _, s in self.steps if isinstance(s, Spline))


def _rotation(angles: np.ndarray, zyx: bool) -> np.ndarray:
    (cx, cy, cz), (sx, sy, sz) = np.cos(angles), np.sin(angles)
    x, y, z = np.array([[1, 0, 0], [0, cx, -sx], [0, sx, cx]]), np.array([[cy, 0, sy], [0, 1, 0], [-sy, 0, cy]]), np.array([[cz, -sz, 0], [sz, cz, 0], [0, 0, 1]])
    return z @ y @ x if zyx else z @ x @ y


def transform_of(parameters: dict[str, list]) -> Affine | Spline:
    """The one step that a file's parameters describe: translation, Euler, affine or B-spline in three dimensions."""
    kind = parameters["Transform"][0]
    p = np.array(parameters.get("TransformParameters", []), float)
    if int(parameters["NumberOfParameters"][0]) != len(p):
        raise ValueError(f"{len(p)} parameters where {parameters['NumberOfParameters'][0]:g} are announced")
    centre = np.array(parameters.get("CenterOfRotationPoint", [0.0] * 3))
    if kind == "TranslationTransform":
        return Affine(np.eye(3), p)
    if kind in ("AffineTransform", "EulerTransform"):
        euler = kind == "EulerTransform"
        m = _rotation(p[:3], parameters.get("ComputeZYX", ["false"])[0] == "true") if euler else p[:9].reshape(3, 3)
        return Affine(m, centre + p[3 if euler else 9 :] - m @ centre)
    if kind in ("BSplineTransform", "RecursiveBSplineTransform"):
        if parameters.get("UseCyclicTransform", ["false"])[0] == "true":
            raise ValueError("cyclic splines are not supported")
        size = [int(n) for n in parameters["GridSize"]]
        order = int(parameters.get("BSplineTransformSplineOrder", [3])[0])
        if order not in (1, 2, 3) or min(size) <= order:
            raise ValueError(f"order {order} on a grid of {size}")
        # the first axis is the fastest; a column of the direction follows the one before it
        direction = np.array(parameters.get("GridDirection", list(np.eye(3).ravel()))).reshape(3, 3).T
        grid = p.reshape(3, *size[::-1]).transpose(0, 3, 2, 1)
        return Spline(np.ascontiguousarray(grid), np.array(parameters["GridSpacing"]), np.array(parameters["GridOrigin"]), direction, np.array(parameters.get("GridIndex", [0.0] * 3)), order)
    raise ValueError(f"unknown transform {kind}")


def read_transform(path: str) -> Transform:
    """The chain of a parameter file. An initial file's name counts as given, or else as a name in the same folder."""
    seen: list[str] = []
    steps: list[tuple[str, Affine | Spline]] = []
    while path != "NoInitialTransform":
        if path in seen:
            raise ValueError(f"{path} is its own initial transform")
        seen.append(path)
        with open_file(path) as f:
            parameters = parse_parameters(f.read().decode())
        steps.insert(0, (parameters.get("HowToCombineTransforms", [COMPOSE])[0], transform_of(parameters)))
        initial = next((parameters[k][0] for k in ("InitialTransformParameterFileName", "InitialTransformParametersFileName") if k in parameters), "NoInitialTransform")
        path = initial if initial == "NoInitialTransform" or "/" in initial else f"{path.rpartition('/')[0]}/{initial}"
    return Transform((((COMPOSE, steps[0][1]),) + tuple(steps[1:])) if steps else ())


def parameter_text(step: Affine | Spline, initial: str = "NoInitialTransform", how: str = COMPOSE) -> str:
    """A parameter file of one step."""
    line = lambda key, values: f"({key} {' '.join(repr(float(v)) for v in values)})"
    if isinstance(step, Affine):
        kind, p, more = "AffineTransform", [*step.matrix.ravel(), *step.offset], [line("CenterOfRotationPoint", [0, 0, 0])]
    else:
        kind, p = "BSplineTransform", step.coefficients.transpose(0, 3, 2, 1).ravel()
        more = [f"(GridSize {' '.join(str(n) for n in step.size)})", line("GridIndex", step.index), line("GridSpacing", step.spacing), line("GridOrigin", step.origin), line("GridDirection", step.direction.T.ravel()), f"(BSplineTransformSplineOrder {step.order})"]
    return "\n".join([f'(Transform "{kind}")', f"(NumberOfParameters {len(p)})", line("TransformParameters", p), f'(InitialTransformParameterFileName "{initial}")', f'(HowToCombineTransforms "{how}")', *more]) + "\n"


def _mapped(points: DataFrame, transform: Transform, run, more: str = "") -> DataFrame:
    """Replace x, y and z by what ``run`` makes of the finite points of a batch (k x 3); the others get null."""
    others = [c for c in points.columns if c not in AXES]
    held = points.sparkSession.sparkContext.broadcast(transform)
    kinds = [f"`{c}` {points.schema[c].dataType.simpleString()}" for c in others]
    schema = ", ".join([*kinds, "x double", "y double", "z double", *([more] if more else [])])
    names = [*others, *AXES, *([more.split()[0]] if more else [])]

    def batches(them: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in them:
            p = np.stack([b.column(len(others) + a).to_numpy(zero_copy_only=False).astype(float) for a in range(3)], axis=1)
            good = np.isfinite(p).all(axis=1)
            out = np.full((len(p), 3 + bool(more)), np.nan)
            out[good] = run(held.value, p[good])
            columns = [pa.array(np.where(good, out[:, a], 0), mask=~good) for a in range(out.shape[1])]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(others))), *columns], names)

    return points.select(*others, *[F.col(a).cast("double") for a in AXES]).mapInArrow(batches, schema)


def transform_points(points: DataFrame, transform: Transform) -> DataFrame:
    """x, y and z of each row moved; rows with a null or non-finite coordinate get nulls. Other columns stay."""
    if transform.grid_bytes() <= GRID_BYTES:
        return _mapped(points, transform, lambda t, p: t(p))
    return _joined(points, transform)


def _grid_table(spark: SparkSession, s: Spline) -> DataFrame:
    import pandas as pd

    i, j, k = (n.ravel() for n in np.indices(s.size))
    c = s.coefficients.reshape(3, -1)
    return spark.createDataFrame(pd.DataFrame({"_i": i, "_j": j, "_k": k, "_cx": c[0], "_cy": c[1], "_cz": c[2]}))


def _joined(points: DataFrame, transform: Transform) -> DataFrame:
    """The same by joins: each step's nodes around a point are joined with the grid's table, and their shares added up by point."""
    scratch = Scratch(points.sparkSession, "nonrigid")
    others = [c for c in points.columns if c not in AXES]
    good = F.lit(True)
    for a in AXES:
        good = good & F.col(a).isNotNull() & ~F.isnan(F.col(a).cast("double")) & (F.abs(F.col(a).cast("double")) < float("inf"))
    rows = points.withColumn("_good", good).select(*others, *[F.when(F.col("_good"), F.col(a).cast("double")).alias(a) for a in AXES], F.monotonically_increasing_id().alias("_row"))
    rows = scratch.save(rows, "rows")  # the numbers must be the same when a task runs again
    at = rows.select("_row", *AXES, *[F.col(a).alias(f"_s{a}") for a in AXES])
    for n, (how, step) in enumerate(transform.steps):
        start = [F.col(a if how == COMPOSE else f"_s{a}") for a in AXES]
        if isinstance(step, Affine):
            shift = [sum((float(step.matrix[r, a]) * start[a] for a in range(3)), F.lit(float(step.offset[r]))) - start[r] for r in range(3)]
            at = at.select("_row", *[(F.col(a) + d).alias(a) for a, d in zip(AXES, shift)], *[f"_s{a}" for a in AXES])
            continue
        at = scratch.save(at.join(_shifts(at, start, step), "_row", "left").select("_row", *[(F.col(a) + F.coalesce(F.col(f"_d{a}"), F.lit(0.0))).alias(a) for a in AXES], *[f"_s{a}" for a in AXES]), f"step-{n}")
    return rows.drop(*AXES).join(at.select("_row", *AXES), "_row").select(*others, *AXES)


def _shifts(at: DataFrame, start: list[Column], s: Spline) -> DataFrame:
    half, into, names = (s.order - 1) / 2, s.to_nodes, ("_i", "_j", "_k")
    node = [sum((float(into.matrix[r, a]) * start[a] for a in range(3)), F.lit(float(into.offset[r]))).alias(f"_c{r}") for r in range(3)]
    around = at.select("_row", *node).filter(" and ".join(f"_c{r} >= {half} and _c{r} <= {int(s.size[r]) - 1 - half}" for r in range(3)))
    for r, name in enumerate(names):
        first = F.least(F.floor(F.col(f"_c{r}") - half), F.lit(int(s.size[r]) - 1 - s.order))
        around = around.withColumn(name, F.explode(F.sequence(first, first + s.order))).withColumn(f"_w{r}", _basis_column(F.col(f"_c{r}") - F.col(name), s.order))
    nodes = around.select("_row", *names, (F.col("_w0") * F.col("_w1") * F.col("_w2")).alias("_w"))
    return nodes.join(_grid_table(at.sparkSession, s).hint("shuffle_hash"), list(names)).groupBy("_row").agg(*[F.sum(F.col("_w") * F.col(f"_c{a}")).alias(f"_d{a}") for a in AXES])


def inverse_points(points: DataFrame, transform: Transform, tolerance: float = 1e-9, rounds: int = 200) -> DataFrame:
    """The x with T(x) = the row's point, by rounds x + B (y - T(x)), B the inverse of the linear part; ``residual`` is the largest |y - T(x)| left.

    The rounds converge where the splines fold nothing and bend by less than the linear part; elsewhere the residual stays above the
    tolerance. A point whose way crosses the edge of a grid may have no inverse, since the shift ends there at once. Grids above ``GRID_BYTES`` are refused."""
    if transform.grid_bytes() > GRID_BYTES:
        raise ValueError("the grid is larger than what workers hold; invert a coarser one")
    linear = transform.linear()
    back = np.linalg.inv(linear.matrix)

    def run(t: Transform, y: np.ndarray) -> np.ndarray:
        x = (y - linear.offset) @ back.T
        left = y - t(x)
        best, least = x.copy(), np.abs(left).max(axis=1, initial=0)
        for _ in range(rounds):
            open_ = np.flatnonzero(least > tolerance)
            if not len(open_):
                break
            x[open_] += left[open_] @ back.T
            left[open_] = y[open_] - t(x[open_])
            now = np.abs(left[open_]).max(axis=1)
            better = open_[now < least[open_]]
            best[better], least[better] = x[better], np.abs(left[better]).max(axis=1)
        return np.column_stack([best, least])

    return _mapped(points, transform, run, "residual double")


def deformation_field(voxels: DataFrame, transform: Transform, spacing=(1.0, 1.0, 1.0), origin=(0.0, 0.0, 0.0)) -> DataFrame:
    """dx, dy, dz = T(p) - p at the physical place p = origin + spacing * voxel of each row (x, y, z, and whatever else it holds)."""
    place = [F.col(a) * float(s) + float(o) for a, s, o in zip(AXES, spacing, origin)]
    kept = voxels.select(*[c for c in voxels.columns if c not in AXES], *[F.col(a).alias(f"_v{a}") for a in AXES], *[p.alias(f"_p{a}") for a, p in zip(AXES, place)], *[p.alias(a) for a, p in zip(AXES, place)])
    moved = transform_points(kept, transform)
    return moved.select(*[c for c in voxels.columns if c not in AXES], *[F.col(f"_v{a}").alias(a) for a in AXES], *[(F.col(a) - F.col(f"_p{a}")).alias(f"d{a}") for a in AXES])


def grid_of(spark: SparkSession, shape: tuple[int, int, int]) -> DataFrame:
    """All voxels of a shape."""
    nx, ny, nz = shape
    return spark.range(nx * ny * nz).select(F.expr(f"cast(id div {ny * nz} as int)").alias("x"), F.expr(f"cast(id div {nz} % {ny} as int)").alias("y"), F.expr(f"cast(id % {nz} as int)").alias("z"))


def transform_volume(vox: DataFrame, source_shape, sink_shape, transform: Transform, linear: bool = True) -> DataFrame:
    """Volumes (vol_id, x, y, z, v) seen from the fixed image: voxel p of the sink takes the value at T(p), between voxels linearly or from the nearest.

    Sink voxels whose T(p) lies outside the source have no row, nor have those around which nothing is stored; missing source voxels count
    as 0. Units are voxels. The places are made once for all volumes and joined with the voxels they need."""
    moved = deformation_field(grid_of(vox.sparkSession, sink_shape), transform)
    at = moved.select(*[F.col(a).alias(f"_o{a}") for a in AXES], *[(F.col(a) + F.col(f"d{a}")).alias(a) for a in AXES])
    inside = F.lit(True)
    for a, n in zip(AXES, source_shape):
        inside = inside & F.col(a).between(0, n - 1)
    at = at.filter(inside).withColumn("_w", F.lit(1.0))
    for a in AXES:
        low = F.floor(a)
        if linear:
            share = F.col(a) - low
            ends = F.array(F.struct(low.cast("int").alias("i"), (1 - share).alias("w")), F.struct((low + 1).cast("int").alias("i"), share.alias("w")))
            at = at.withColumn("_e", F.explode(ends)).filter("_e.w > 0").withColumn(a, F.col("_e.i")).withColumn("_w", F.col("_w") * F.col("_e.w")).drop("_e")
        else:
            at = at.withColumn(a, F.floor(F.col(a) + 0.5).cast("int"))
    shares = at.join(vox.select("vol_id", *AXES, "v"), list(AXES))
    return shares.groupBy("vol_id", *[F.col(f"_o{a}").alias(a) for a in AXES]).agg(F.sum(F.col("_w") * F.col("v")).alias("v"))
