"""Projections, filters and predicates on voxel and point tables; single-stage native plans."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AXES = ("x", "y", "z")


def clip(v: Column, low: float, high: float, norm: float | None = None) -> Column:
    """norm * (clamp(v) - low) / (high - low); without norm the clamped value."""
    inside = F.least(F.greatest(v, F.lit(low)), F.lit(high))
    return inside if norm is None else F.lit(norm) * (inside - low) / (high - low)


def clip_with_flags(vox: DataFrame, low: int, high: int, norm: int = 4096) -> DataFrame:
    """clipped (truncated to a whole number), mask (inside), high (v >= high), low (v < low)."""
    c = F.floor((F.least(F.greatest(F.col("v"), F.lit(low)), F.lit(high)) - low) * (norm - 1) / (high - low)).cast("int")
    return vox.select("vol_id", *AXES, c.alias("clipped"), ((F.col("v") >= low) & (F.col("v") < high)).alias("mask"), (F.col("v") >= high).alias("high"), (F.col("v") < low).alias("low"))


def apply_lut(vox: DataFrame, lut: list) -> DataFrame:
    """v replaced by lut[v]; v outside the table is null."""
    table = F.array(*[F.lit(x) for x in lut])
    return vox.withColumn("v", F.get(table, F.col("v").cast("int")))


def where_positive(vox: DataFrame, cutoff: float = 0) -> DataFrame:
    """Coordinates of voxels with v > cutoff."""
    return vox.filter(F.col("v") > cutoff).select("vol_id", *AXES)


def filter_cells(cells: DataFrame, thresholds: dict[str, float | tuple[float | None, float | None] | None]) -> DataFrame:
    """A number keeps c >= number, a pair low <= c < high. A threshold that is None or 0 is no threshold."""
    for c, t in thresholds.items():
        if not t:
            continue
        low, high = t if isinstance(t, tuple) else (t, None)
        if low is not None:
            cells = cells.filter(F.col(c) >= low)
        if high is not None:
            cells = cells.filter(F.col(c) < high)
    return cells


def in_range(v: Column, low: float, high: float) -> Column:
    return v.between(low, high)


def sanitize_ids(df: DataFrame, column: str = "id") -> DataFrame:
    """Rows with 0 < id < 65536, without the root's id 997."""
    return df.filter((F.col(column) > 0) & (F.col(column) < 65536) & (F.col(column) != 997))


def rename_columns(df: DataFrame, names: dict[str, str], strict: bool = False) -> DataFrame:
    """Rename; with ``strict`` a missing column is an error, else it is ignored."""
    missing = [c for c in names if c not in df.columns]
    if strict and missing:
        raise KeyError(f"no columns {missing}")
    return df.withColumnsRenamed({a: b for a, b in names.items() if a in df.columns})


def filter_structures(df: DataFrame, ids: list[int], hemispheres: list | None = None, exclude: bool = False) -> DataFrame:
    """Rows whose id is (with ``exclude``: is not) listed; the hemisphere, if there is one, is always inclusive."""
    keep = F.col("id").isin(ids)
    df = df.filter(~keep if exclude else keep)
    return df.filter(F.col("hemisphere").isin(hemispheres)) if hemispheres is not None and "hemisphere" in df.columns else df


def extents(vox: DataFrame) -> DataFrame:
    return vox.groupBy("vol_id").agg(*[f(a).alias(f"{n}_{a}") for a in AXES for n, f in (("lo", F.min), ("hi", F.max))])


def on_border(vox: DataFrame) -> DataFrame:
    """vox with a flag: the voxel is on one of its volume's six faces."""
    faces = [(F.col(a) == F.col(f"lo_{a}")) | (F.col(a) == F.col(f"hi_{a}")) for a in AXES]
    return vox.join(extents(vox), "vol_id").withColumn("border", reduce(lambda a, b: a | b, faces)).drop(*[f"{n}_{a}" for a in AXES for n in ("lo", "hi")])


def delete_border(vox: DataFrame, value: int = 0) -> DataFrame:
    return on_border(vox).withColumn("v", F.when(F.col("border"), F.lit(value)).otherwise(F.col("v"))).drop("border")


def check_border(vox: DataFrame, value: int = 0) -> DataFrame:
    """vol_id, clean: all border voxels have the value."""
    return on_border(vox).filter("border").groupBy("vol_id").agg(F.bool_and(F.col("v") == value).alias("clean"))


def flatfield_from_line(line: DataFrame, n: int) -> DataFrame:
    """(x, f) repeated along y = 0..n-1."""
    return line.select("x", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("y"), "f")


def correct_illumination(vox: DataFrame, flatfield: DataFrame | None, background: DataFrame | None = None, scaling: str | None = None) -> DataFrame:
    """v / flat, or (v - bg) / (flat - bg), per (x, y); ``scaling`` mean or max multiplies by that of the flat field. The fields are one plane; null flat field: identity."""
    if flatfield is None:
        return vox
    flat = flatfield.select("x", "y", "f")
    if background is not None:
        flat = flat.join(background.select("x", "y", F.col("f").alias("b")), ["x", "y"])
        value = (F.col("v") - F.col("b")) / (F.col("f") - F.col("b"))
    else:
        value = F.col("v") / F.col("f")
    out = vox.join(flat, ["x", "y"])
    if scaling:
        factor = {"mean": F.avg, "max": F.max}[scaling]
        out = out.crossJoin(F.broadcast(flatfield.agg(factor("f").alias("scale"))))  # one row
        value = value * F.col("scale")
    return out.select("vol_id", *AXES, value.alias("v"))


def combine_binary(a: DataFrame, b: DataFrame) -> DataFrame:
    """Foreground voxels of either."""
    return a.select("vol_id", *AXES).unionByName(b.select("vol_id", *AXES)).distinct()
