"""Rows that come sorted by group, as tables of whole groups: many small groups at a time, and a large one by itself."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def first_rows(columns: dict[str, np.ndarray], keys: list[str]) -> np.ndarray:
    """First row of each run of rows with equal keys."""
    change = np.zeros(len(columns[keys[0]]), bool)
    change[:1] = True
    for c in keys:
        change[1:] |= columns[c][1:] != columns[c][:-1]
    return np.flatnonzero(change)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[dict[str, np.ndarray], np.ndarray]]:
    """(columns, first row of each group and the number of rows): the last group of what has arrived waits for its end."""

    def out(parts: list[pa.RecordBatch]) -> tuple[dict[str, np.ndarray], np.ndarray]:
        t = pa.Table.from_batches(parts)
        columns = {c: t[c].to_numpy() for c in t.column_names}
        return columns, np.append(first_rows(columns, keys), t.num_rows)

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        last = int(first_rows({c: batch[c].to_numpy() for c in keys}, keys)[-1])
        if last or held and any(held[-1][c][-1] != batch[c][0] for c in keys):
            done = held + ([batch.slice(0, last)] if last else [])
            yield out(done)
            held = []
        held.append(batch.slice(last))
    if held:
        yield out(held)
