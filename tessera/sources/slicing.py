"""Slices of volumes: normal forms, shapes and compositions; a slice becomes a filter on coordinates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AXES = ("x", "y", "z")


def unpack(slicing, ndim: int) -> tuple:
    """All axes named: Ellipsis and missing axes become full slices; two Ellipsis are an error."""
    s = slicing if isinstance(slicing, tuple) else (slicing,)
    if sum(a is Ellipsis for a in s) > 1:
        raise IndexError("more than one Ellipsis")
    if Ellipsis in s:
        i = s.index(Ellipsis)
        s = s[:i] + (slice(None),) * (ndim - len(s) + 1) + s[i + 1 :]
    s = s + (slice(None),) * (ndim - len(s))
    if len(s) > ndim:
        raise IndexError("too many axes")
    return s


def to_range(s: slice | int, n: int) -> range:
    if isinstance(s, int):
        i = s + n if s < 0 else s
        if not 0 <= i < n:
            raise IndexError(f"{s} is outside {n}")
        return range(i, i + 1)
    return range(*s.indices(n))


def is_trivial(slicing, shape) -> bool:
    return all(isinstance(s, slice) and to_range(s, n) == range(n) for s, n in zip(unpack(slicing, len(shape)), shape))


def sliced_shape(slicing, shape) -> tuple[int, ...]:
    return tuple(len(to_range(s, n)) for s, n in zip(unpack(slicing, len(shape)), shape) if not isinstance(s, int))


def sliced_ndim(slicing, ndim: int) -> int:
    return sum(not isinstance(s, int) for s in unpack(slicing, ndim))


def sliced_start(slicing, shape) -> tuple[int, ...]:
    return tuple(to_range(s, n).start for s, n in zip(unpack(slicing, len(shape)), shape))


def compose(second, first, shape) -> tuple:
    """One slicing that equals ``first`` and then ``second``."""
    s = list(unpack(first, len(shape)))
    kept = [i for i, a in enumerate(s) if not isinstance(a, int)]
    for i, b in zip(kept, unpack(second, len(kept))):
        r = to_range(s[i], shape[i])
        if isinstance(b, int):
            s[i] = r[b]
        else:
            q = r[b]
            s[i] = slice(q.start, q.stop if q.stop >= 0 else None, q.step)
    return tuple(s)


def condition(slicing, shape) -> Column:
    """The slicing as a predicate that reaches the scan."""
    keep = F.lit(True)
    for a, s, n in zip(AXES, unpack(slicing, len(shape)), shape):
        r = to_range(s, n)
        if not len(r):
            return F.lit(False)
        lo, hi = min(r), max(r)
        if (lo, hi) != (0, n - 1):
            keep = keep & F.col(a).between(lo, hi)
        if abs(r.step) > 1:
            keep = keep & ((F.col(a) - lo) % abs(r.step) == 0)
    return keep


def apply(vox: DataFrame, slicing, shape) -> DataFrame:
    return vox.filter(condition(slicing, shape))
