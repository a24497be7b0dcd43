"""Polylines of edges: arrays of points (structs with x, y, z and other numbers), in built-in array functions, and in Arrow batches for arc lengths' steps. Each edge is a row; nothing is joined or shuffled but by ``set_geometry``."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PLACE = ("x", "y", "z")


def _fields(edges: DataFrame, name: str) -> list[str]:
    return edges.schema[name].dataType.elementType.fieldNames()


def set_geometry(edges: DataFrame, points: DataFrame, keys: tuple[str, ...] = ("src", "dst"), name: str = "geometry") -> DataFrame:
    """``edges`` with the points (keys, pos, and their numbers) as an array in order of pos; null where an edge has none."""
    values = [c for c in points.columns if c not in (*keys, "pos")]
    lists = points.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", F.struct(*values).alias("p")))).alias("_l")).select(*keys, F.transform("_l", lambda e: e["p"]).alias(name))
    return edges.drop(name).join(lists, list(keys), "left")


def set_points(edges: DataFrame, value: Column, field: str, name: str = "geometry") -> DataFrame:
    """Every point with a field: a number of the edge, the same for all its points."""
    return edges.withColumn("_v", value).withColumn(name, F.transform(name, lambda p: p.withField(field, F.col("_v")))).drop("_v")


def remove_field(edges: DataFrame, field: str, name: str = "geometry") -> DataFrame:
    return edges.withColumn(name, F.transform(name, lambda p: p.dropFields(field)))


def _gap(p: Column, q: Column) -> Column:
    return F.sqrt(sum(((q[c] - p[c]) * (q[c] - p[c]) for c in PLACE), F.lit(0.0)))


def arc_lengths(name: str = "geometry") -> Column:
    """Length from the first point to each point."""
    steps = F.transform(F.sequence(F.lit(2), F.size(name)), lambda i: _gap(F.element_at(name, i - 1), F.element_at(name, i)))
    start = F.array(F.lit(0.0))
    return F.when(F.size(name) < 2, F.transform(name, lambda p: F.lit(0.0))).otherwise(F.aggregate(steps, start, lambda acc, s: F.concat(acc, F.array(F.element_at(acc, -1) + s))))


def length(name: str = "geometry") -> Column:
    """Length of the polyline; 0 for one point, null without any."""
    return F.when(F.size(name) > 0, F.element_at(arc_lengths(name), -1))


def resize(edges: DataFrame, count: Column, name: str = "geometry") -> DataFrame:
    """Polylines of ``count`` (at least 2) points at equal steps of arc length; first and last points stay. All numbers of a point are interpolated. A
    polyline of one point becomes copies of it; empty and null ones stay. Arrow batches of edges: nested lambdas over arrays are evaluated point by point and take far longer."""
    fields = _fields(edges, name)
    others = [c for c in edges.columns if c != name]
    kinds = [f"`{c}` {edges.schema[c].dataType.simpleString()}" for c in others]
    schema = ", ".join([*kinds, f"`{name}` array<struct<{', '.join(f'`{c}`: double' for c in fields)}>>"])
    k = len(others)

    def one(points: np.ndarray, n: int) -> np.ndarray:
        if len(points) < 2:
            return np.repeat(points, n if len(points) else 1, axis=0)
        place = points[:, [fields.index(c) for c in PLACE]]
        arc = np.concatenate([[0.0], np.cumsum(np.sqrt((np.diff(place, axis=0) ** 2).sum(1)))])
        t = np.linspace(0.0, arc[-1], n)
        return np.stack([np.interp(t, arc, points[:, i]) for i in range(points.shape[1])], axis=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, n = batch.column(k), batch.column(k + 1).to_pylist()
            flat = lists.flatten()
            numbers = np.column_stack([flat.field(c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in fields]) if len(flat) else np.zeros((0, len(fields)))
            valid = lists.is_valid().to_numpy(zero_copy_only=False)
            size = np.where(valid, lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), 0)
            begin = np.concatenate([[0], np.cumsum(size)])
            got = [one(numbers[begin[i] : begin[i + 1]], n[i]) for i in range(len(size))]
            every = np.concatenate([np.zeros((0, len(fields))), *got])
            offsets = np.concatenate([[0], np.cumsum([len(g) for g in got])]).astype(np.int32)
            points = pa.StructArray.from_arrays([pa.array(every[:, i].copy()) for i in range(len(fields))], fields)
            yield pa.RecordBatch.from_arrays([*batch.columns[:k], pa.ListArray.from_arrays(pa.array(offsets), points, mask=pa.array(~valid))], [*others, name])

    return edges.select(*others, name, F.greatest(count.cast("int"), F.lit(2)).alias("_n")).mapInArrow(run, schema).select(*edges.columns)


def smooth(edges: DataFrame, half: int, name: str = "geometry") -> DataFrame:
    """Each point the mean of those at most ``half`` places away on both sides (fewer near the ends, the same number on each); ends stay."""
    fields = _fields(edges, name)

    def point(p: Column, i: Column) -> Column:
        k = F.least(F.lit(half), i, F.size(name) - 1 - i)
        part = F.slice(name, i + 1 - k, 2 * k + 1)
        mean = lambda c: F.aggregate(part, F.lit(0.0), lambda acc, q: acc + q[c]) / (2 * k + 1)
        return F.struct(*[mean(c).alias(c) for c in fields])

    return edges.withColumn(name, F.transform(name, point))


def interpolate(edges: DataFrame, points_per_unit: float = 0.5, half: int = 2, name: str = "geometry") -> DataFrame:
    """Smoothed polylines with ``points_per_unit`` points for each unit of length (at least 2)."""
    even = smooth(edges, half, name) if half else edges
    return resize(even, F.ceil(F.coalesce(length(name), F.lit(0.0)) * points_per_unit) + 1, name)
