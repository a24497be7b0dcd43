"""Neighbourhood rank filters on whole-number volumes.

Every filter looks at the stored voxels of a structure element around each voxel
(outside and masked voxels don't count) and gives one value per voxel.
Histogram-type filters have ``max_bin`` bins. Parameters of percentile
filters are shares (0..1) of the neighbourhood's population. Where a
neighbourhood is empty the result is 0. Box windows are filtered by passes along the axes
where extrema and sums are enough, and for ranks if they are large; memory doesn't grow with the window then.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.plans.blocks import BLOCK, Shape, box, gather, map_blocks

MAX_BIN = 4096
_BIG = np.iinfo(np.int64).max


class Neighbourhood:
    """Sorted values of all neighbourhoods of a block: v ascending with absent ones last, n present, g centre."""

    def __init__(self, v: np.ndarray, s: np.ndarray, g: np.ndarray, max_bin: int) -> None:
        self.n = s.sum(-1)
        self.g, self.max_bin = g, max_bin
        self.v = np.sort(np.where(s, v, _BIG), axis=-1)
        self.has = np.arange(v.shape[-1]) < self.n[..., None]
        self.safe = np.maximum(self.n, 1)

    def pick(self, i: np.ndarray) -> np.ndarray:
        got = np.take_along_axis(self.v, np.clip(i, 0, self.safe - 1)[..., None], -1)[..., 0]
        return np.where(self.n > 0, got, 0)

    def lo(self) -> np.ndarray:
        return self.pick(np.zeros_like(self.n))

    def hi(self) -> np.ndarray:
        return self.pick(self.n - 1)

    def where(self, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sum, count) of present values that are kept."""
        k = keep & self.has
        return np.where(k, self.v, 0).sum(-1), k.sum(-1)

    def total(self) -> np.ndarray:
        return np.where(self.has, self.v, 0).sum(-1)

    def mean(self) -> np.ndarray:
        return self.total() / self.safe

    def std(self) -> np.ndarray:
        m = self.mean()[..., None]
        return np.sqrt(np.where(self.has, (self.v - m) ** 2, 0).sum(-1) / self.safe)

    def at_share(self, p: float, strict: bool = False) -> np.ndarray:
        """Smallest value whose cumulative count reaches (or, strict, exceeds) the share p."""
        want = p * self.n
        i = np.floor(want) if strict else np.ceil(want) - 1
        return self.pick(np.maximum(i, 0).astype(np.int64))

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        """(first of a run of equal values, the run's length there)."""
        first = self.has.copy()
        first[..., 1:] &= self.v[..., 1:] != self.v[..., :-1]
        k = self.v.shape[-1]
        same = (self.v[..., :, None] == self.v[..., None, :]) & self.has[..., :, None] & self.has[..., None, :] if k <= 32 else None
        if same is not None:
            return first, np.where(first, same.sum(-1), 0)
        run = np.zeros(self.v.shape, np.int64)
        for i in range(k):
            run += np.where(self.has & (self.v == self.v[..., i : i + 1]) & self.has[..., i : i + 1], 1, 0)
        return first, np.where(first, run, 0)

    def cumulative(self) -> np.ndarray:
        """Number of present values up to each value, ties included."""
        k = self.v.shape[-1]
        c = np.tile(np.arange(1, k + 1), (*self.v.shape[:-1], 1))
        for i in range(k - 2, -1, -1):
            same = self.v[..., i] == self.v[..., i + 1]
            c[..., i] = np.where(same & self.has[..., i + 1], c[..., i + 1], c[..., i])
        return c

    def band(self, p0: float, p1: float) -> tuple[np.ndarray, np.ndarray]:
        """(sum, count) of values whose cumulative count is within the two shares."""
        c, n = self.cumulative(), self.n[..., None]
        return self.where((c >= p0 * n) & (c <= p1 * n))


class BoxWindow:
    """The same facts for box windows of any size, from passes along the axes: a few arrays of the block's size, whatever the window.

    Sums are differences of running sums, extrema are doubled, and ranks come from counts at thresholds on two levels: first of
    runs of ``fine`` grey values, then inside the run that holds the rank.
    """

    def __init__(self, values: np.ndarray, stored: np.ndarray, owned: tuple[slice, ...], low: np.ndarray, high: np.ndarray, max_bin: int) -> None:
        self.values, self.stored, self.owned, self.low, self.high, self.max_bin = values, stored, owned, low, high, max_bin
        self.g = values[owned]
        self.n = self._sum(stored.astype(np.int64))
        self.safe = np.maximum(self.n, 1)

    def _sum(self, a: np.ndarray) -> np.ndarray:
        for axis in range(3):
            m = a.shape[axis]
            run = np.concatenate([np.zeros_like(a.take([0], axis)), np.cumsum(a, axis)], axis)
            at = np.arange(m)[self.owned[axis]]
            a = run.take(np.clip(at + self.high[axis] + 1, 0, m), axis) - run.take(np.clip(at + self.low[axis], 0, m), axis)
        return a

    def _extreme(self, a: np.ndarray, f: Callable, fill: int) -> np.ndarray:
        for axis in range(3):
            k = int(self.high[axis] - self.low[axis]) + 1
            before, after = max(0, -int(self.low[axis])), max(0, int(self.high[axis]))
            a = np.pad(a, [(before, after) if i == axis else (0, 0) for i in range(3)], constant_values=fill)
            cut = lambda x, lo, hi, axis=axis: x[tuple(slice(lo, hi) if i == axis else slice(None) for i in range(3))]
            size = 1
            while size * 2 <= k:
                a = f(cut(a, 0, a.shape[axis] - size), cut(a, size, None))
                size *= 2
            if k > size:
                a = f(cut(a, 0, a.shape[axis] - (k - size)), cut(a, k - size, None))
            first = before + int(self.low[axis])
            a = a.take(np.arange(self.values.shape[axis])[self.owned[axis]] + first, axis)
        return np.where(self.n > 0, a, 0)

    @cached_property
    def _lo(self) -> np.ndarray:
        return self._extreme(np.where(self.stored, self.values, _BIG), np.minimum, _BIG)

    @cached_property
    def _hi(self) -> np.ndarray:
        return self._extreme(np.where(self.stored, self.values, -_BIG), np.maximum, -_BIG)

    @cached_property
    def _total(self) -> np.ndarray:
        return self._sum(np.where(self.stored, self.values, 0))

    def lo(self) -> np.ndarray:
        return self._lo

    def hi(self) -> np.ndarray:
        return self._hi

    def total(self) -> np.ndarray:
        return self._total

    def mean(self) -> np.ndarray:
        return self._total / self.safe

    def std(self) -> np.ndarray:
        squares = self._sum(np.where(self.stored, self.values**2, 0))
        return np.sqrt(np.maximum(self.n * squares - self._total**2, 0)) / self.safe

    def below(self, level: int) -> np.ndarray:
        return self._sum((self.stored & (self.values < level)).astype(np.int64))

    def pick(self, i: np.ndarray) -> np.ndarray:
        """The value of rank i (from 0) in each window."""
        rank = np.clip(i, 0, self.safe - 1)
        out, open_ = np.zeros(self.n.shape, np.int64), self.n > 0
        if not open_.any():
            return out
        first, last = int(self.values[self.stored].min()), int(self.values[self.stored].max())
        fine = max(1, int(np.sqrt(last - first + 1)))
        before = np.zeros(self.n.shape, np.int64)
        for level in range(first, last + 1, fine):
            upto = self.below(level + fine)
            here = open_ & (upto > rank)
            if here.any():  # the run holds the rank of these: its grey values one by one
                left, under = here.copy(), before
                for v in range(level, level + fine):
                    under = self.below(v + 1) if fine > 1 else upto
                    hit = left & (under > rank)
                    out[hit] = v
                    left &= ~hit
                    if not left.any():
                        break
                open_ &= ~here
                if not open_.any():
                    break
            before = upto
        return out

    def at_share(self, p: float, strict: bool = False) -> np.ndarray:
        want = p * self.n
        i = np.floor(want) if strict else np.ceil(want) - 1
        return self.pick(np.maximum(i, 0).astype(np.int64))

    def sweep(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(value, number of values up to it, their sum) in each window, for every value of the block in order."""
        for v in np.unique(self.values[self.stored]).tolist():
            on = self.stored & (self.values <= v)
            yield v, self._sum(on.astype(np.int64)), self._sum(np.where(on, self.values, 0))

    def band(self, p0: float, p1: float) -> tuple[np.ndarray, np.ndarray]:
        shape = self.n.shape
        begun, last = np.zeros(shape, bool), (np.zeros(shape, np.int64), np.zeros(shape, np.int64))
        base, top = [np.zeros(shape, np.int64) for _ in range(2)], [np.zeros(shape, np.int64) for _ in range(2)]
        for _, count, total in self.sweep():
            start = ~begun & (count >= p0 * self.n) & (count > 0)
            for to, have in zip(base, last):
                to[start] = have[start]
            begun |= start
            inside = begun & (count <= p1 * self.n)
            for to, have in zip(top, (count, total)):
                to[inside] = have[inside]
            last = (count, total)
        some = begun & (top[0] > base[0])
        return np.where(some, top[1] - base[1], 0), np.where(some, top[0] - base[0], 0)

    def upto(self, bar: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number, sum) of each window's values that are at most ``bar``."""
        count, total = np.zeros(self.n.shape, np.int64), np.zeros(self.n.shape, np.int64)
        for v, c, t in self.sweep():
            on = bar >= v
            count[on], total[on] = c[on], t[on]
        return count, total


Filter = Callable[..., np.ndarray]


def _autolevel(h: Neighbourhood) -> np.ndarray:
    d = h.hi() - h.lo()
    return np.where(d > 0, (h.max_bin - 1) * (h.g - h.lo()) // np.maximum(d, 1), 0)


def _enhance(h: Neighbourhood, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    return np.where(high - h.g < h.g - low, high, low)


def _modal(h: Neighbourhood) -> np.ndarray:
    _, run = h.counts()
    return np.where(h.n > 0, np.take_along_axis(h.v, run.argmax(-1)[..., None], -1)[..., 0], 0)


def _entropy(h: Neighbourhood) -> np.ndarray:
    first, run = h.counts()
    p = run / h.safe[..., None]
    return -np.where(first, p * np.log2(np.where(first, p, 1)), 0).sum(-1)


def _otsu(h: Neighbourhood) -> np.ndarray:
    """First value at which the between-class variance of 'up to it' and 'above it' is largest."""
    c = h.cumulative()
    k = h.v.shape[-1]
    run = np.cumsum(np.where(h.has, h.v, 0), axis=-1)
    upto = np.take_along_axis(run, np.minimum(c, k) - 1, -1)
    total, n = h.total()[..., None], h.n[..., None]
    above = n - c
    with np.errstate(divide="ignore", invalid="ignore"):
        score = np.where(h.has & (above > 0), c * above * (upto / c - (total - upto) / above) ** 2, -1.0)
    return np.where((h.n > 0) & (score.max(-1) > 0), np.take_along_axis(h.v, score.argmax(-1)[..., None], -1)[..., 0], 0)


def _noise(h: Neighbourhood) -> np.ndarray:
    """Distance to the nearest value of the neighbourhood without its centre."""
    d = np.where(h.has, np.abs(np.where(h.has, h.v, 0) - h.g[..., None]), _BIG)
    return np.where(h.n > 0, d.min(-1), 0)


def _histogram(h: Neighbourhood) -> np.ndarray:
    out = np.zeros((*h.n.shape, h.max_bin))
    first, run = h.counts()
    i = np.argwhere(first)
    out[(*i[:, :-1].T, np.clip(h.v[first], 0, h.max_bin - 1))] += run[first]
    return out / h.safe[..., None]


def _contrast(h: Neighbourhood, p: float, limit: float) -> np.ndarray:
    """Percentile of the histogram clipped at ``limit`` of the population, with the cut spread evenly over all bins."""
    out = np.zeros(h.n.shape, np.int64)
    first, run = h.counts()
    for i in np.ndindex(h.n.shape):
        if not h.n[i]:
            continue
        hist = np.zeros(h.max_bin)
        hist[np.clip(h.v[i][first[i]], 0, h.max_bin - 1)] = run[i][first[i]]
        top = limit * h.n[i]
        hist = np.minimum(hist, top) + np.maximum(hist - top, 0).sum() / h.max_bin
        out[i] = int(np.searchsorted(np.cumsum(hist), p * h.n[i]))
    return np.minimum(out, h.max_bin - 1)


def _bilateral(h: Neighbourhood, s0: float, s1: float, closed: bool = False):
    g, v = h.g[..., None], h.v
    return h.where((g >= v - s0) & (g <= v + s1)) if closed else h.where((g > v - s0) & (g < v + s1))


def _relative(h: Neighbourhood, s0: float, s1: float) -> np.ndarray:
    """Sum over [int(g s0), int(g s1 + 1)) by the number of bins of that range."""
    lo, hi = (h.g * s0).astype(np.int64), (h.g * s1 + 1).astype(np.int64)
    total, _ = h.where((h.v >= lo[..., None]) & (h.v < hi[..., None]))
    return total / np.maximum(hi - lo, 1)


def _scale(h: Neighbourhood, p0: float, q0: float, p1: float, q1: float) -> np.ndarray:
    """Lowest value in (g - (p0 + g q0), g + (p1 + g q1) + 1]; 0 if there is none."""
    low, high = h.g - (p0 + h.g * q0), h.g + (p1 + h.g * q1) + 1
    keep = h.has & (h.v > low[..., None]) & (h.v <= high[..., None])
    got = np.where(keep, h.v, _BIG).min(-1)
    return np.where(keep.any(-1), got, 0)


#: name: (result type, filter of a neighbourhood and parameters)
FILTERS: dict[str, tuple[str, Filter]] = {
    "autolevel": ("bigint", _autolevel),
    "bottomhat": ("bigint", lambda h: h.g - h.lo()),
    "tophat": ("bigint", lambda h: h.hi() - h.g),
    "equalize": ("bigint", lambda h: (h.max_bin - 1) * h.where(h.v <= h.g[..., None])[1] // h.safe),
    "gradient": ("bigint", lambda h: h.hi() - h.lo()),
    "mean": ("bigint", lambda h: h.total() // h.safe),
    "geometric_mean": ("bigint", lambda h: np.rint(np.exp(np.where(h.has, np.log1p(np.where(h.has, h.v, 0)), 0).sum(-1) / h.safe) - 1).astype(np.int64)),
    "subtract_mean": ("double", lambda h: (h.g - h.mean()) / 2 + 127),
    "median": ("bigint", lambda h: h.pick(h.n // 2)),
    "maximum": ("bigint", lambda h: h.hi()),
    "minimum": ("bigint", lambda h: h.lo()),
    "minmax": ("array<bigint>", lambda h: np.stack([h.lo(), h.hi()], axis=-1)),
    "modal": ("bigint", _modal),
    "enhance_contrast": ("bigint", lambda h: _enhance(h, h.lo(), h.hi())),
    "pop": ("bigint", lambda h: h.n),
    "sum": ("bigint", lambda h: h.total()),
    "threshold": ("bigint", lambda h: (h.g * h.safe > h.total()).astype(np.int64)),
    "noise_filter": ("bigint", _noise),
    "entropy": ("double", _entropy),
    "otsu": ("bigint", _otsu),
    "std": ("double", lambda h: h.std()),
    "histogram": ("array<double>", _histogram),
    "autolevel_percentile": ("bigint", lambda h, p0=0.0, p1=1.0: (lambda a, b: np.where(b > a, (h.max_bin - 1) * (np.clip(h.g, a, b) - a) // np.maximum(b - a, 1), 0))(h.at_share(p0, True), h.at_share(p1))),
    "gradient_percentile": ("bigint", lambda h, p0=0.0, p1=1.0: h.at_share(p1) - h.at_share(p0)),
    "mean_percentile": ("bigint", lambda h, p0=0.0, p1=1.0: (lambda b: b[0] // np.maximum(b[1], 1))(h.band(p0, p1))),
    "subtract_mean_percentile": ("double", lambda h, p0=0.0, p1=1.0: (lambda b: np.where(b[1] > 0, (h.g - b[0] / np.maximum(b[1], 1) + h.max_bin) / 2, 0))(h.band(p0, p1))),
    "enhance_contrast_percentile": ("bigint", lambda h, p0=0.0, p1=1.0: _enhance(h, h.at_share(p0), h.at_share(p1))),
    "percentile": ("bigint", lambda h, p0=0.5: h.hi() if p0 == 1 else h.at_share(p0)),
    "pop_percentile": ("bigint", lambda h, p0=0.0, p1=1.0: h.band(p0, p1)[1]),
    "sum_percentile": ("bigint", lambda h, p0=0.0, p1=1.0: h.band(p0, p1)[0]),
    "sum_above_percentile": ("bigint", lambda h, p0=0.5: (lambda a: np.where(h.g <= a, h.g, h.where(h.v > a[..., None])[0]))(h.at_share(p0))),
    "threshold_percentile": ("bigint", lambda h, p0=0.5: (h.max_bin - 1) * (h.g >= h.at_share(p0)).astype(np.int64)),
    "mean_bilateral": ("bigint", lambda h, s0=10, s1=10: (lambda b: b[0] // np.maximum(b[1], 1))(_bilateral(h, s0, s1))),
    "pop_bilateral": ("bigint", lambda h, s0=10, s1=10: _bilateral(h, s0, s1)[1]),
    "sum_bilateral": ("bigint", lambda h, s0=10, s1=10: _bilateral(h, s0, s1, True)[0]),
    "sum_relative_bilateral": ("double", lambda h, s0=0.5, s1=1.5: _relative(h, s0, s1)),
    "mean_scale_bilateral": ("bigint", lambda h, p0=10, q0=0.0, p1=10, q1=0.0: _scale(h, p0, q0, p1, q1)),
    "nilblack": ("double", lambda h, k=0.2: h.mean() + k * h.std()),
    "sauvola": ("double", lambda h, k=0.2, r=128.0: h.mean() * (1 + k * (h.std() / r - 1))),
    "contrast_limited_percentile": ("bigint", lambda h, p0=0.5, contrast_limit=0.5: _contrast(h, p0, contrast_limit)),
    "light_sheet_artifact_correction": ("bigint", lambda h, p0=0.5, contrast_limit=0.5: np.maximum(h.g - np.minimum(h.g, _contrast(h, p0, contrast_limit)), 0)),
}


#: Filters that need extrema and sums only, and those that need ranks: box windows are filtered by passes along the axes, the latter from ``LARGE`` cells on.
BY_SUMS = {"autolevel", "bottomhat", "tophat", "gradient", "mean", "subtract_mean", "maximum", "minimum", "minmax", "enhance_contrast", "pop", "sum", "threshold", "std", "nilblack", "sauvola"}
BY_RANKS: dict[str, Filter | None] = {
    "median": None, "percentile": None, "gradient_percentile": None, "autolevel_percentile": None, "enhance_contrast_percentile": None, "threshold_percentile": None,
    "mean_percentile": None, "pop_percentile": None, "sum_percentile": None, "subtract_mean_percentile": None,
    "equalize": lambda h: (h.max_bin - 1) * h.upto(h.g)[0] // h.safe,
    "sum_above_percentile": lambda h, p0=0.5: (lambda a: np.where(h.g <= a, h.g, h.total() - h.upto(a)[1]))(h.at_share(p0)),
}
LARGE = 512


def _is_box(offsets: np.ndarray) -> bool:
    if not len(offsets):
        return False
    low, high = offsets.min(axis=0), offsets.max(axis=0)
    return len(np.unique(offsets, axis=0)) == len(offsets) == np.prod(high - low + 1)


def rank_filter(vox: DataFrame, name: str, selem: np.ndarray | None = None, mask: DataFrame | None = None, max_bin: int = MAX_BIN, block: Shape = BLOCK, **parameters: float) -> DataFrame:
    """vol_id, x, y, z, v of the named filter. ``selem``: offsets (n x 3), default 3 x 3 x 3; ``mask``: vol_id, x, y, z of the voxels that count."""
    kind, function = FILTERS[name]
    offsets = box() if selem is None else np.asarray(selem)
    if name == "noise_filter":
        offsets = offsets[(offsets != 0).any(axis=1)]
    halo = tuple(int(x) for x in (np.abs(offsets).max(axis=0) if len(offsets) else (0, 0, 0)))
    if mask is not None:
        vox = vox.join(mask.select("vol_id", "x", "y", "z").distinct(), ["vol_id", "x", "y", "z"], "left_semi")

    axes = _is_box(offsets) and (name in BY_SUMS or (name in BY_RANKS and len(offsets) >= LARGE))
    by_axes = BY_RANKS.get(name) or function

    def kernel(values, stored, _, owned):
        if axes:
            if isinstance(owned, np.ndarray):  # of packed blocks everything is computed
                owned = tuple(slice(0, n) for n in values.shape)
            got = by_axes(BoxWindow(values, stored, owned, offsets.min(axis=0), offsets.max(axis=0), max_bin), **parameters)
            whole = np.zeros((*values.shape, *got.shape[3:]), got.dtype)
            whole[owned] = got
            return {"v": whole}
        v, s = gather(values, stored, offsets)
        got = function(Neighbourhood(v[owned], s[owned], values[owned], max_bin), **parameters)
        whole = np.zeros((*values.shape, *got.shape[values[owned].ndim :]), got.dtype)
        whole[owned] = got
        return {"v": whole}

    return map_blocks(vox.select("vol_id", "x", "y", "z", F.col("v").cast("long").alias("v")), kernel, {"v": kind}, block, halo, pack=max(halo))
