"""Steps of a vessel volume's binarisation: what bright spots spread is taken away, and thresholds follow the place."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import morphology as M
from tessera.operators.configuration import smooth_by_configuration
from tessera.plans.blocks import BLOCK, Shape
from tessera.plans.lines import map_lines

AXES = ("x", "y", "z")
#: A Gaussian ends after so many sigmas.
TRUNCATE = 4.0


def gaussian_line(sigma: float):
    """Kernel of a Gaussian along lines, mirrored at their ends (the end's voxel is repeated). Lines are dense."""
    radius = int(TRUNCATE * sigma + 0.5)
    k = np.arange(-radius, radius + 1)
    weights = np.exp(-0.5 * (k / sigma) ** 2)
    weights /= weights.sum()

    def run(at: np.ndarray, values: np.ndarray, valid: np.ndarray) -> np.ndarray:
        out = np.zeros_like(values)
        sizes = valid.sum(1)
        for n in np.unique(sizes):  # lines of a length together
            rows = np.flatnonzero(sizes == n)
            part = values[rows, :n]
            total = np.zeros_like(part)
            for d, w in zip(k.tolist(), weights.tolist()):
                i = (np.arange(n) + d) % (2 * n)
                total += w * part[:, np.where(i < n, i, 2 * n - 1 - i)]
            out[rows, :n] = total
        return out

    return run


def gaussian(vox: DataFrame, sigma: float, axes: tuple[str, ...] = AXES, value: str = "v") -> DataFrame:
    """``vox`` with ``value`` (double) smoothed along the axes, one after the other."""
    for a in axes:
        vox = map_lines(vox, a, value, gaussian_line(sigma))
    return vox


def deconvolve(vox: DataFrame, sigma: float = 10.0) -> DataFrame:
    """vol_id, x, y, z, v: voxels that are ``on`` keep v; the others lose what a Gaussian in their plane carries over from those that are on, down to 0."""
    at = vox.select("vol_id", *[F.col(a).cast("int").alias(a) for a in AXES], F.col("v").cast("double").alias("v"), "on")
    spread = gaussian(at.withColumn("_s", F.when(F.col("on"), F.col("v")).otherwise(0.0)), sigma, ("x", "y"), "_s")
    return spread.select("vol_id", *AXES, F.when(F.col("on"), F.col("v")).otherwise(F.col("v") - F.least("v", "_s")).alias("v"))


def threshold_adaptive(vox: DataFrame, selem: Shape = (100, 100, 3), spacing: Shape = (25, 25, 3), step: Shape = (1, 1, 1), share: float | None = None) -> DataFrame:
    """vol_id, x, y, z, v, level: each voxel's threshold, interpolated from those of windows of size ``selem`` around a grid of centres every ``spacing``.

    A window's threshold is its ISODATA level, or with ``share`` that percentile. Windows are histograms that are summed before they meet.
    """
    cells = ["vol_id", *[f"c{a}" for a in AXES]]
    rows = M.windows(vox, selem, spacing, step)
    grid = M.threshold_isodata(rows, cells).withColumnRenamed("level", "v") if share is None else rows.groupBy(*cells).agg(F.percentile("v", share).alias("v"))
    return M.interpolate_grid(vox, grid, spacing).withColumnRenamed("g", "level")


def binarize_adaptive(vox: DataFrame, selem: Shape = (100, 100, 3), spacing: Shape = (25, 25, 3), step: Shape = (1, 1, 1)) -> DataFrame:
    """vol_id, x, y, z, v (0 or 1): above the threshold of its place."""
    return threshold_adaptive(vox, selem, spacing, step).select("vol_id", *AXES, (F.col("v") > F.col("level")).cast("int").alias("v"))


def postprocess(binary: DataFrame, iterations: int = 6, fill: bool = True, block: Shape = BLOCK) -> DataFrame:
    """vol_id, x, y, z, v (0 or 1): smoothed by configuration, then holes filled."""
    now = smooth_by_configuration(binary, iterations, block) if iterations else binary.select("vol_id", *AXES, (F.col("v") > 0).cast("int").alias("v"))
    return M.fill_holes(now) if fill else now
