"""Kernels, correlation, derivative filters and local maxima.

Kernels are small arrays made on the driver. Correlation treats voxels
outside the volume as 0; derivative filters repeat the border.
"""

from __future__ import annotations

from itertools import product

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import neighbourhoods as N
from tessera.plans.blocks import BLOCK, Shape, box, gather, map_blocks

AXES = ("x", "y", "z")


def _grid(shape: tuple[int, ...]) -> list[np.ndarray]:
    """Signed distances to the centre along each axis; even sizes are centred between voxels."""
    return np.meshgrid(*[np.arange(n) - (n - 1) / 2 for n in shape], indexing="ij")


def sphere(shape: tuple[int, ...] = (3, 3, 3)) -> np.ndarray:
    """1 - sum((d / r)^2) clipped at 0, with r half the size rounded up; sums to 1."""
    w = np.clip(1 - sum((g / max(1, (n + 1) // 2)) ** 2 for g, n in zip(_grid(shape), shape)), 0, None)
    return w / w.sum()


def disk(shape: tuple[int, ...] = (3, 3)) -> np.ndarray:
    return sphere(shape) > 0


def cube(shape: tuple[int, ...] = (3, 3, 3)) -> np.ndarray:
    return np.ones(shape)


def structure_element(shape: tuple[int, ...] = (3, 3), form: str = "Disk") -> np.ndarray:
    made = {"disk": disk, "sphere": sphere, "cube": cube, "rectangle": cube}.get(form.lower())
    if made is None:
        raise ValueError(f"unknown form {form}")
    return made(shape)


def structure_element_offsets(shape: tuple[int, ...]) -> list[tuple[int, int]]:
    """(low, high) reach of a window of each size."""
    return [(n // 2, n - n // 2) for n in shape]


def filter_kernel(ftype: str = "Gaussian", shape: tuple[int, ...] = (5, 5, 5), sigma=None, sigma2=None) -> np.ndarray:
    """mean, gaussian, sphere, disk, log (Laplacian of Gaussian, zero sum) or dog (narrow ``sigma`` less wide ``sigma2``, zero sum)."""
    ftype = ftype.lower()
    wide = tuple(n / 2 / np.sqrt(2 * np.log(2)) for n in shape)
    given = lambda s, default: tuple(np.broadcast_to(s, len(shape))) if s is not None else default
    grid = _grid(shape)

    def gaussian(s) -> np.ndarray:
        g = np.exp(-sum((x**2) / (2 * a**2) for x, a in zip(grid, s)))
        return g / g.sum()

    if ftype == "mean":
        return np.full(shape, 1 / np.prod(shape))
    if ftype == "gaussian":
        return gaussian(given(sigma, wide))
    if ftype in ("sphere", "disk"):
        w = structure_element(shape, ftype).astype(float)
        return w / w.sum()
    if ftype == "log":
        sigma = given(sigma, tuple(a / 2 for a in wide))
        g = gaussian(sigma) * sum(x**2 / a**4 - 1 / a**2 for x, a in zip(grid, sigma))
        return -(g - g.mean())
    if ftype == "dog":
        outer = given(sigma2, wide)
        k = gaussian(given(sigma, tuple(a / 1.5 for a in outer))) - gaussian(outer)
        return k - k.mean()
    raise ValueError(f"unknown kernel {ftype}")


def _halo(shape) -> Shape:
    return tuple(int(n) // 2 for n in shape)  # type: ignore[return-value]


def correlate(vox: DataFrame, kernel: np.ndarray, block: Shape = BLOCK) -> DataFrame:
    """v = sum of kernel times neighbourhood, centred."""
    offsets, weights = box(kernel.shape), kernel.reshape(-1).astype(float)

    def run(values, stored, _, owned):
        out = np.zeros(values.shape)
        for i in range(0, len(offsets), 32):
            v, _ = gather(values, stored, offsets[i : i + 32])  # what is not stored is 0
            out += v @ weights[i : i + 32]
        return {"v": out}

    return map_blocks(vox, run, {"v": "double"}, block, _halo(kernel.shape), "float64")


def correlate1d(vox: DataFrame, kernel: list[float], axis: str = "x") -> DataFrame:
    """Zero-padded correlation along one axis as an ordered window: v(i) = sum_j k[j] v(i + j - len // 2). Missing voxels are 0."""
    half = len(kernel) // 2
    w = Window.partitionBy("vol_id", *[a for a in AXES if a != axis]).orderBy(axis)
    pairs = F.collect_list(F.struct(axis, "v")).over(w.rangeBetween(-half, len(kernel) - 1 - half))
    k = F.array(*[F.lit(float(x)) for x in kernel])
    total = F.aggregate("_near", F.lit(0.0), lambda a, p: a + p["v"] * F.get(k, p[axis] - F.col(axis) + half))
    return vox.withColumn("_near", pairs).select("vol_id", *AXES, total.alias("v"))


def convolve_points(vox: DataFrame, points: DataFrame, kernel: np.ndarray, max_value: float | None = None) -> DataFrame:
    """Kernel sums at listed voxels only (vol_id, x, y, z); with ``max_value`` whether the sum is below it. Voxels outside are 0."""
    offsets = [(*map(int, o), float(w)) for o, w in zip(box(kernel.shape), kernel.reshape(-1)) if w]
    o = points.sparkSession.createDataFrame(offsets, "dx int, dy int, dz int, k double")
    near = points.select("vol_id", *[F.col(a).alias(f"p{a}") for a in AXES]).crossJoin(F.broadcast(o)).select("vol_id", "px", "py", "pz", "k", *[(F.col(f"p{a}") + F.col(f"d{a}")).alias(a) for a in AXES])
    total = near.join(vox, ["vol_id", *AXES], "left").groupBy("vol_id", "px", "py", "pz").agg(F.sum(F.coalesce("v", F.lit(0)) * F.col("k")).alias("v"))
    value = F.col("v") if max_value is None else F.col("v") < max_value
    return total.select("vol_id", *[F.col(f"p{a}").alias(a) for a in AXES], value.alias("v"))


def gradient(vox: DataFrame) -> DataFrame:
    """gx, gy, gz: forward differences; 0 at the far border."""
    for a in AXES:
        w = Window.partitionBy("vol_id", *[b for b in AXES if b != a]).orderBy(a)
        vox = vox.withColumn(f"g{a}", F.coalesce(F.lead("v").over(w) - F.col("v"), F.lit(0)))
    return vox


def gradient_abs(vox: DataFrame) -> DataFrame:
    return gradient(vox).select("vol_id", *AXES, sum((F.abs(f"g{a}") for a in AXES), F.lit(0)).alias("v"))


def gradient_square(vox: DataFrame) -> DataFrame:
    return gradient(vox).select("vol_id", *AXES, sum((F.col(f"g{a}") * F.col(f"g{a}") for a in AXES), F.lit(0)).alias("v"))


def _fill_border(values: np.ndarray, stored: np.ndarray) -> np.ndarray:
    """Voxels outside repeat the nearest stored one along each axis (blocks are dense boxes; only the volume's border is outside)."""
    return np.pad(values.astype(float), 1, mode="edge")


def _hessian(p: np.ndarray) -> np.ndarray:
    """xx, xy, xz, yy, yz, zz second differences of a padded array."""
    c = p[1:-1, 1:-1, 1:-1]

    def at(dx: int, dy: int, dz: int) -> np.ndarray:
        n = [s - 2 for s in p.shape]
        return p[1 + dx : 1 + dx + n[0], 1 + dy : 1 + dy + n[1], 1 + dz : 1 + dz + n[2]]

    out = []
    unit = np.eye(3, dtype=int)
    for a in range(3):
        for b in range(a, 3):
            if a == b:
                out.append(at(*unit[a]) - 2 * c + at(*-unit[a]))
            else:
                out.append((at(*(unit[a] + unit[b])) - at(*(unit[a] - unit[b])) - at(*(unit[b] - unit[a])) + at(*(-unit[a] - unit[b]))) / 4)
    return np.stack(out, axis=-1)


def hessian(vox: DataFrame, block: Shape = BLOCK) -> DataFrame:
    """v: array of xx, xy, xz, yy, yz, zz second differences."""
    return map_blocks(vox, lambda v, s, o, own: {"v": _hessian(_fill_border(v, s))}, {"v": "array<double>"}, block, (1, 1, 1), "float64")


def _eigen(h: np.ndarray) -> np.ndarray:
    m = np.empty((*h.shape[:-1], 3, 3))
    for i, (a, b) in enumerate(((0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2))):
        m[..., a, b] = m[..., b, a] = h[..., i]
    return np.linalg.eigvalsh(m)[..., ::-1]


def eigenvalues(vox: DataFrame, block: Shape = BLOCK) -> DataFrame:
    """v: eigenvalues of the Hessian, descending."""
    return map_blocks(vox, lambda v, s, o, own: {"v": _eigen(_hessian(_fill_border(v, s)))}, {"v": "array<double>"}, block, (1, 1, 1), "float64")


def tubeness(vox: DataFrame, threshold: float | None = None, block: Shape = BLOCK) -> DataFrame:
    """sqrt(e2 * e3) where both are negative, else 0; with a threshold 0 or 1."""

    def run(v, s, o, own):
        e = _eigen(_hessian(_fill_border(v, s)))
        t = np.where((e[..., 1] < 0) & (e[..., 2] < 0), np.sqrt(np.abs(e[..., 1] * e[..., 2])), 0.0)
        return {"v": t if threshold is None else (t > threshold).astype(float)}

    return map_blocks(vox, run, {"v": "double"}, block, (1, 1, 1), "float64")


def lambda123(vox: DataFrame, gamma12: float = 1.0, gamma23: float = 1.0, alpha: float = 0.25, block: Shape = BLOCK) -> DataFrame:
    """Sato's line measure of the Hessian's eigenvalues e1 >= e2 >= e3.

    With e3 < e2 < 0: |e3| (e2 / e3)^gamma23 times (1 + e1 / |e2|)^gamma12 for e1 <= 0, or
    (1 - alpha e1 / |e2|)^gamma12 for 0 < e1 < |e2| / alpha; else 0.
    """

    def run(v, s, o, own):
        e1, e2, e3 = np.moveaxis(_eigen(_hessian(_fill_border(v, s))), -1, 0)
        ok = (e2 < 0) & (e3 < 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            base = np.abs(e3) * (e2 / e3) ** gamma23
            inner = np.where(e1 <= 0, 1 + e1 / np.abs(e2), 1 - alpha * e1 / np.abs(e2))
            out = np.where(ok & (inner > 0), base * np.clip(inner, 0, None) ** gamma12, 0.0)
        return {"v": out}

    return map_blocks(vox, run, {"v": "double"}, block, (1, 1, 1), "float64")


def dog_filter(vox: DataFrame, shape: Shape | None, sigma=None, sigma2=None, block: Shape = BLOCK) -> DataFrame:
    """Difference of Gaussians, negative results 0; no shape: unchanged."""
    if shape is None:
        return vox
    return correlate(vox, filter_kernel("dog", shape, sigma, sigma2), block).withColumn("v", F.greatest("v", F.lit(0.0)))


def grey(vox: DataFrame, offsets: np.ndarray, function, block: Shape = BLOCK) -> DataFrame:
    """Grey erosion (np.min) or dilation (np.max) with a structure element."""
    worst = np.inf if function is np.min else -np.inf

    def run(values, stored, _, owned):
        v, s = gather(values, stored, offsets)
        return {"v": function(np.where(s, v, worst), axis=-1)}

    return map_blocks(vox, run, {"v": "double"}, block, tuple(int(a) for a in np.abs(offsets).max(0)), "float64", pack=int(np.abs(offsets).max()))


def remove_background(vox: DataFrame, shape: tuple[int, int], form: str = "Disk", block: Shape = BLOCK) -> DataFrame:
    """v - min(v, grey opening) plane by plane."""
    selem = np.argwhere(structure_element(shape, form) > 0) - np.array(shape) // 2
    offsets = np.column_stack([selem, np.zeros(len(selem), int)])
    opened = grey(grey(vox, offsets, np.min, block), -offsets, np.max, block).withColumnRenamed("v", "o")
    return vox.join(opened.hint("merge"), ["vol_id", *AXES]).select("vol_id", *AXES, (F.col("v") - F.least("v", "o")).alias("v"))


def local_max(vox: DataFrame, shape: int = 3, threshold: float | None = None, block: Shape = BLOCK) -> DataFrame:
    """Voxels that equal the maximum of the box around them (and reach ``threshold``)."""
    offsets = box((shape,) * 3)

    def run(values, stored, _, owned):
        v, s = gather(values, stored, offsets)
        top = np.where(s, v, -np.inf).max(-1)
        return {"v": values.astype(float), "is_max": (values == top) & stored}

    out = map_blocks(vox, run, {"v": "double", "is_max": "boolean"}, block, _halo((shape,) * 3), "float64", pack=shape // 2).filter("is_max").drop("is_max")
    return out if threshold is None else out.filter(F.col("v") >= threshold)


def cube_codes(vox: DataFrame, centre: bool = True, block: Shape = BLOCK) -> DataFrame:
    """v: the 27 bits of foreground (v > 0) around each voxel, first axis fastest; without ``centre`` 26 bits. One pass for each axis."""

    def run(values, stored, _, owned):
        codes = N.codes_of((values > 0) & stored)
        return {"v": codes if centre else N.without_centre(codes)}

    return map_blocks(vox, run, {"v": "bigint"}, block)
