"""Dense kernels over voxel tables, block by block.

A voxel table has vol_id, x, y, z, v: one row per stored voxel. A kernel
that needs a neighbourhood runs on blocks: each voxel goes to its own block and, if it lies
within ``halo`` of the border, to the neighbours that need it (a native explode
of the few block numbers). One shuffle by (vol_id, block) later the blocks of a task stream through
an Arrow function in order; each is a small dense array, and the kernel's result is cut back to the
owned voxels.

The shuffle carries (1 + 2 halo / block)^3 of the input, where the join with a table of offsets
would carry one row per offset. Memory is bounded by one block and one batch. A voxel
that is not stored counts as outside the volume. Null coordinates or values are left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Shape = tuple[int, int, int]
BLOCK: Shape = (64, 64, 32)
#: Cells of a block that is packed with others, and of a pack.
SMALL, PACKED = 1 << 11, 1 << 14
#: Rows that wait for each other where blocks are packed.
ROWS = 1 << 16
#: (values, stored, origin, owned) of a block -> named result arrays of the block's shape, or rows with x, y, z.
Kernel = Callable[[np.ndarray, np.ndarray, np.ndarray, tuple[slice, slice, slice]], dict[str, np.ndarray]]


def block_numbers(c: Column, size: int, halo: int) -> Column:
    """Numbers of the blocks along one axis that hold or see coordinate c."""
    return F.sequence(F.floor((c - halo) / size).cast("int"), F.floor((c + halo) / size).cast("int"))


def spread(vox: DataFrame, block: Shape, halo: Shape, more: tuple[str, ...] = ()) -> DataFrame:
    rows = vox.select("vol_id", *[F.col(a).cast("int").alias(a) for a in "xyz"], "v", *more).filter("x is not null and y is not null and z is not null and v is not null")
    if any(2 * h > s for s, h in zip(block, halo)):
        return _spread_far(rows, block, halo)
    for a, size, h in zip("xyz", block, halo):
        rows = rows.withColumn(f"b{a}", F.explode(block_numbers(F.col(a), size, h)) if h else F.floor(F.col(a) / size).cast("int"))
    return rows


def _spread_far(rows: DataFrame, block: Shape, halo: Shape) -> DataFrame:
    """``spread`` for halos that reach over several blocks: a voxel is sent only to blocks that hold a voxel of their own. Each block's list of such blocks near it
    is joined by the voxel's own block (at most the blocks that a halo reaches)."""
    own = rows
    for a, size in zip("xyz", block):
        own = own.withColumn(f"o{a}", F.floor(F.col(a) / size).cast("int"))
    keys = ["vol_id", "ox", "oy", "oz"]
    there = own.select(*keys).distinct()
    near = there
    for a, size, h in zip("xyz", block, halo):
        reach = -(-h // size)
        near = near.withColumn(f"b{a}", F.explode(F.sequence(F.col(f"o{a}") - reach, F.col(f"o{a}") + reach)))
    near = near.join(there.select("vol_id", *[F.col(f"o{a}").alias(f"b{a}") for a in "xyz"]).hint("merge"), ["vol_id", "bx", "by", "bz"], "left_semi")
    near = near.groupBy(*keys).agg(F.collect_list(F.struct("bx", "by", "bz")).alias("_near"))
    sees = " and ".join(f"b.b{a} between floor(({a} - {h}) / {size}) and floor(({a} + {h}) / {size})" for a, size, h in zip("xyz", block, halo))
    sent = own.join(near.hint("merge"), keys).withColumn("_b", F.explode(F.expr(f"filter(_near, b -> {sees})")))
    return sent.select(*rows.columns, *[F.col(f"_b.b{a}").alias(f"b{a}") for a in "xyz"])


def whole_blocks(batches: Iterator[pa.RecordBatch], least: int = 1) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """(rows, where each block begins, and the end) of batches that come sorted by vol_id, bx, by, bz: at least so many rows at a time, but for the last. The last block of
    what has arrived waits for the next batch."""
    held: list[pa.RecordBatch] = []

    def gathered() -> tuple[pa.Table, np.ndarray]:
        rows = pa.Table.from_batches(held).combine_chunks()
        change = np.zeros(rows.num_rows - 1, bool)
        for c in ("vol_id", "bx", "by", "bz"):
            k = rows[c].to_numpy()
            change |= k[1:] != k[:-1]
        return rows, np.concatenate([[0], np.flatnonzero(change) + 1, [rows.num_rows]])

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if sum(b.num_rows for b in held) < least:
            continue
        rows, cuts = gathered()
        if len(cuts) > 2:
            yield rows.slice(0, int(cuts[-2])), cuts[:-1]
        held = rows.slice(int(cuts[-2])).to_batches()
    if held:
        yield gathered()


def map_blocks(vox: DataFrame, kernel: Kernel, out: dict[str, str], block: Shape = BLOCK, halo: Shape = (1, 1, 1), dtype: str = "int64", more: tuple[str, ...] = (), many: bool = False, pack: int | None = None, sent: bool = False, cells: tuple[int, int] = (SMALL, PACKED)) -> DataFrame:
    """With ``many`` the kernel gets a list of blocks (those of one batch), and gives a list of results. With ``pack`` small blocks of a batch are laid
    behind each other along x, so many voxels apart, and the kernel gets them as one, with a mask of the owned voxels for the slices: for kernels in which a voxel depends on none farther away and takes places that aren't stored for outside; ``cells``: most cells of a block that is packed, and of a pack. With ``more`` value columns the kernel gets them stacked behind v on a last axis. With ``sent`` the rows of ``vox`` already name the block (bx, by, bz) that each is sent to.

    vol_id, x, y, z and the kernel's columns ``out`` (name: SQL type) of every owned voxel, or of the rows the kernel gives."""
    kind = vox.schema["vol_id"].dataType.simpleString()
    target = {"bigint": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "int": pa.int32(), "array<bigint>": pa.list_(pa.int64()), "array<double>": pa.list_(pa.float64())}

    def dense(columns: dict[str, np.ndarray], lo: int, hi: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, tuple[slice, slice, slice]]:
        """What the kernel gets of the block in rows lo..hi."""
        at = np.array([columns[f"b{a}"][lo] for a in "xyz"])
        x, y, z = (columns[c][lo:hi] for c in "xyz")
        low = np.array([x.min(), y.min(), z.min()])
        shape = np.array([x.max(), y.max(), z.max()]) - low + 1
        place = (x - low[0], y - low[1], z - low[2])
        stored = np.zeros(shape, bool)
        stored[place] = True
        layers = []
        for c in ("v", *more):
            layer = np.zeros(shape, dtype)
            layer[place] = columns[c][lo:hi]
            layers.append(layer)
        values = np.stack(layers, axis=-1) if more else layers[0]
        begin = np.maximum(at * np.array(block) - low, 0)
        end = np.minimum((at + 1) * np.array(block) - low, shape)
        owned = tuple(slice(int(i), int(max(i, j))) for i, j in zip(begin, end))
        return values, stored, low, owned

    def cut(got: dict[str, np.ndarray], stored: np.ndarray, low: np.ndarray, owned: tuple[slice, slice, slice]) -> dict[str, np.ndarray]:
        """Result columns of the owned voxels of a block."""
        if "x" in got:
            return got
        inside = stored[owned]
        where = np.argwhere(inside) + np.array([s.start for s in owned]) + low
        return {c: where[:, i] for i, c in enumerate("xyz")} | {c: got[c][owned][inside] for c in out}

    def together(columns: dict[str, np.ndarray], own: np.ndarray, cuts: np.ndarray, which: np.ndarray, low: np.ndarray, shape: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        """(first row of the block of each result row, result columns) of small blocks, in one array."""
        size, some = np.diff(cuts), np.zeros(len(cuts) - 1, bool)
        some[which] = True
        row, k = np.flatnonzero(np.repeat(some, size)), np.repeat(np.arange(len(which)), size[which])
        low, wide = low[which], shape[which, 0] + pack
        base = np.stack([np.cumsum(wide) - wide, np.zeros(len(which), int), np.zeros(len(which), int)], axis=1)
        place = tuple(columns[a][row] - low[k, i] + base[k, i] for i, a in enumerate("xyz"))
        whole = (int(wide.sum()), *shape[which, 1:].max(axis=0))
        stored, owned = np.zeros(whole, bool), np.zeros(whole, bool)
        stored[place], owned[place] = True, own[row]
        layers = []
        for c in ("v", *more):
            layer = np.zeros(whole, dtype)
            layer[place] = columns[c][row]
            layers.append(layer)
        got = kernel(np.stack(layers, axis=-1) if more else layers[0], stored, np.zeros(3, int), owned)
        where = np.argwhere(owned)
        b = np.searchsorted(base[:, 0], where[:, 0], side="right") - 1
        where += low[b] - base[b]
        return cuts[which][b], {c: where[:, i] for i, c in enumerate("xyz")} | {c: got[c][owned] for c in out}

    def packs(columns: dict[str, np.ndarray], own: np.ndarray, cuts: np.ndarray, has: np.ndarray) -> Iterator[tuple[np.ndarray, dict[str, np.ndarray]]]:
        """Small blocks in packs (never those with and those without anything in their halo in one), and the others."""
        low, high = (np.stack([f.reduceat(columns[a], cuts[:-1]) for a in "xyz"], axis=1).astype(np.int64) for f in (np.minimum, np.maximum))
        shape = high - low + 1
        small = has & (shape.prod(axis=1) <= cells[0])
        alone = np.logical_and.reduceat(own, cuts[:-1])
        for group in (small & alone, small & ~alone):
            which = np.flatnonzero(group)
            at = 0
            while at < len(which):
                stop, wide, flat = at, 0, np.zeros(2, int)
                while stop < len(which):
                    more_wide, more_flat = wide + shape[which[stop], 0] + pack, np.maximum(flat, shape[which[stop], 1:])
                    if stop > at and more_wide * more_flat.prod() > cells[1]:
                        break
                    stop, wide, flat = stop + 1, more_wide, more_flat
                yield together(columns, own, cuts, which[at:stop], low, shape)
                at = stop
        for i in np.flatnonzero(has & ~small):
            b = dense(columns, int(cuts[i]), int(cuts[i + 1]))
            got = cut(kernel(*b), *b[1:])
            yield np.full(len(got["x"]), cuts[i]), got

    def finish(rows: pa.Table, cuts: np.ndarray) -> Iterator[pa.RecordBatch]:
        columns = {c: rows[c].to_numpy() for c in rows.column_names if c != "vol_id"}
        own = np.ones(rows.num_rows, bool)
        for a, size in zip("xyz", block):
            own &= columns[a] // size == columns[f"b{a}"]
        has = np.logical_or.reduceat(own, cuts[:-1])  # blocks that own nothing give nothing
        if not has.any():
            return
        if pack is not None:
            first, parts = zip(*packs(columns, own, cuts, has))
            at = np.concatenate(first)
        else:
            blocks = (dense(columns, int(cuts[i]), int(cuts[i + 1])) for i in np.flatnonzero(has))
            if many:
                whole = list(blocks)
                parts = [cut(got, *b[1:]) for got, b in zip(kernel(whole), whole)]
            else:
                parts = [cut(kernel(*b), *b[1:]) for b in blocks]
            at = np.repeat(cuts[:-1][has], [len(p["x"]) for p in parts])
        vol = rows["vol_id"].combine_chunks().take(pa.array(at))
        arrays = [vol, *[pa.array(np.concatenate([p[c] for p in parts]).astype(np.int32)) for c in "xyz"]]
        for c, t in out.items():
            values = np.concatenate([p[c] for p in parts])
            if t.startswith("array"):
                size = values.shape[1] if values.ndim > 1 else 0
                arrays.append(pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype=np.int32) * size), pa.array(values.reshape(-1))).cast(target[t]))
            else:
                arrays.append(pa.array(values).cast(target[t]))
        yield pa.RecordBatch.from_arrays(arrays, ["vol_id", "x", "y", "z", *out])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, cuts in whole_blocks(batches, ROWS if pack is not None else 1):
            yield from finish(rows, cuts)

    schema = f"vol_id {kind}, x int, y int, z int, " + ", ".join(f"{c} {t}" for c, t in out.items())
    keys = ["vol_id", "bx", "by", "bz"]
    rows = vox.select(*keys, *"xyz", "v", *more) if sent else spread(vox, block, halo, more)
    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def gather(values: np.ndarray, stored: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(values, present) at every offset of every voxel: arrays of the block's shape with the offsets last."""
    pad = np.abs(offsets).max(axis=0) if len(offsets) else np.zeros(3, int)
    width = [(int(p), int(p)) for p in pad]
    v, s = np.pad(values, width), np.pad(stored, width)
    nx, ny, nz = values.shape
    out_v = np.empty((*values.shape, len(offsets)), values.dtype)
    out_s = np.empty((*values.shape, len(offsets)), bool)
    for i, (dx, dy, dz) in enumerate(offsets):
        sl = (slice(pad[0] + dx, pad[0] + dx + nx), slice(pad[1] + dy, pad[1] + dy + ny), slice(pad[2] + dz, pad[2] + dz + nz))
        out_v[..., i], out_s[..., i] = v[sl], s[sl]
    return out_v, out_s


def box(shape: Shape = (3, 3, 3)) -> np.ndarray:
    """Offsets of a box; an even size has its extra voxel on the low side."""
    axes = [np.arange(-(n // 2), n - n // 2) for n in shape]
    return np.stack(np.meshgrid(*axes, indexing="ij"), axis=-1).reshape(-1, 3)


def offsets_of(selem: np.ndarray) -> np.ndarray:
    """Offsets of the true cells of a 3-d structure element around its centre."""
    return np.argwhere(np.asarray(selem) > 0) - np.array(selem.shape) // 2
