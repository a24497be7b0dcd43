"""Kernels over whole lines of voxels: one shuffle by line, then many lines side by side in a padded array.

A task holds one batch of lines (``CELLS`` padded cells), and one line at least.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

AXES = ("x", "y", "z")
CELLS = 1 << 20
#: (places, values, valid) of lines, one in a row, places ascending, padded at the end -> values, or a tuple of them
Kernel = Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray | tuple[np.ndarray, ...]]


def map_lines(vox: DataFrame, axis: str, value: str, kernel: Kernel, fill: float = 0.0, cells: int = CELLS, by: tuple[str, ...] = (), also: tuple[str, ...] = ()) -> DataFrame:
    """``vox`` (vol_id, x, y, z int, and more) with the double column ``value`` replaced by the kernel's, line by line along an axis.

    ``by``: whole numbers that cut a line; ``also``: more double columns to replace, by what the kernel gives behind the values."""
    rest = [c for c in ("vol_id", *AXES) if c != axis] + list(by)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in vox.schema)

    def finish(t: pa.Table, cuts: np.ndarray) -> Iterator[pa.RecordBatch]:
        size = np.diff(cuts)
        lo = 0
        while lo < len(size):
            hi, longest = lo + 1, size[lo]
            while hi < len(size) and max(longest, size[hi]) * (hi + 1 - lo) <= cells:
                longest = max(longest, size[hi])
                hi += 1
            a, b = int(cuts[lo]), int(cuts[hi])
            part = t.slice(a, b - a)
            line = np.repeat(np.arange(hi - lo), size[lo:hi])
            place = np.arange(b - a) - np.repeat(cuts[lo:hi] - a, size[lo:hi])
            at, values, valid = np.zeros((hi - lo, longest)), np.full((hi - lo, longest), fill), np.zeros((hi - lo, longest), bool)
            at[line, place] = part[axis].to_numpy()
            values[line, place] = part[value].to_numpy()
            valid[line, place] = True
            got = kernel(at, values, valid)
            for name, column in zip((value, *also), got if isinstance(got, tuple) else (got,)):
                part = part.set_column(part.schema.get_field_index(name), name, pa.array(column[line, place]))
            yield from part.to_batches()
            lo = hi

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch])
            t = (t if held is None else pa.concat_tables([held, t])).combine_chunks()
            change = np.zeros(t.num_rows - 1, bool)
            for c in rest:
                k = t[c].to_numpy()
                change |= k[1:] != k[:-1]
            cuts = np.concatenate([[0], np.flatnonzero(change) + 1])
            if len(cuts) > 1:
                yield from finish(t, cuts)
            held = t.slice(int(cuts[-1]))
        if held is not None:
            yield from finish(held, np.array([0, held.num_rows]))

    return vox.repartition(*rest).sortWithinPartitions(*rest, axis).mapInArrow(run, schema)
