"""Volume files as voxel tables: npy, tif, nrrd, mhd + raw, csv.

Reading: Spark's ``binaryFile`` source finds and reads the files (any store, any glob), one
Arrow function decodes them, and every voxel becomes a row (path, x, y, z, v). Axes are x, y,
z; files that store them reversed (tif pages) are turned. Files whose paths are in a table already are opened by the tasks (``read_listed``), without a listing. Writing:
``encode`` packs each volume of a voxel table into a file's bytes; ``write`` lets the tasks write them, and cuts a large npy or tif volume into
pieces that are put in place side by side; ``write_files`` goes through Hadoop's file system, one file at a time.
"""

from __future__ import annotations

import bz2
import gzip
import io
import os
import struct
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

AXES = ("x", "y", "z")
#: Voxels of a batch of rows that are read.
BATCH_ROWS = 1 << 16
#: Bytes of files from which a batch of them goes on.
BATCH_BYTES = 1 << 24
#: Voxels up to which a volume is written by one task, and of the pieces of a larger one.
WHOLE = 1 << 20
PIECE = 1 << 18
#: Large volumes (a name and a shape each) that may be broadcast.
BROADCAST_VOLUMES = 100_000


def _as_3d(a: np.ndarray) -> np.ndarray:
    if a.ndim > 3:
        raise ValueError(f"{a.ndim} dimensions; three at most")
    return a.reshape(a.shape + (1,) * (3 - a.ndim))


# npy
def decode_npy(data: bytes) -> np.ndarray:
    return np.load(io.BytesIO(data), allow_pickle=False)


def encode_npy(a: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, np.asfortranarray(a))
    return out.getvalue()


# tif: baseline, uncompressed or deflate, grey, one strip or more per page, little or big endian, BigTIFF
_TIF_KINDS = {1: "B", 2: "s", 3: "H", 4: "I", 16: "Q"}


def decode_tif(data: bytes) -> np.ndarray:
    """Pages become z; rows y; columns x."""
    import zlib

    end = {b"II": "<", b"MM": ">"}[data[:2]]
    big = struct.unpack(end + "H", data[2:4])[0] == 43
    at = struct.unpack(end + ("Q" if big else "I"), data[8:16] if big else data[4:8])[0]
    pages = []
    while at:
        n = struct.unpack_from(end + ("Q" if big else "H"), data, at)[0]
        at += 8 if big else 2
        tags = {}
        for _ in range(n):
            tag, kind = struct.unpack_from(end + "HH", data, at)
            count = struct.unpack_from(end + ("Q" if big else "I"), data, at + 4)[0]
            code = _TIF_KINDS.get(kind)
            if code and code != "s":
                size = struct.calcsize(code) * count
                room, where = (8, at + 12) if big else (4, at + 8)
                if size > room:
                    where = struct.unpack_from(end + ("Q" if big else "I"), data, where)[0]
                tags[tag] = struct.unpack_from(f"{end}{count}{code}", data, where)
            at += 20 if big else 12
        at = struct.unpack_from(end + ("Q" if big else "I"), data, at)[0]
        bits, form = tags.get(258, (8,))[0], tags.get(339, (1,))[0]
        compression = tags.get(259, (1,))[0]
        if compression not in (1, 8, 32946):
            raise ValueError(f"tif compression {compression} is not supported")
        raw = b"".join((lambda s: s if compression == 1 else zlib.decompress(s))(data[o : o + c]) for o, c in zip(tags[273], tags[279]))
        dtype = np.dtype({1: "u", 2: "i", 3: "f"}[form] + str(bits // 8)).newbyteorder(end)
        pages.append(np.frombuffer(raw, dtype, tags[257][0] * tags[256][0]).reshape(tags[257][0], tags[256][0]))
    return np.stack(pages).transpose(2, 1, 0)


def _tif_directory(shape: tuple[int, int], dtype: np.dtype, start: int, size: int, following: int) -> bytes:
    """The directory of one page: its body's place and size, and where the next directory is (0: nowhere)."""
    kind = {"u": 1, "i": 2, "f": 3}[dtype.kind]
    entries = [(256, 4, shape[0]), (257, 4, shape[1]), (258, 3, dtype.itemsize * 8), (259, 3, 1), (262, 3, 1), (273, 4, start), (277, 3, 1), (278, 4, shape[1]), (279, 4, size), (339, 3, kind)]
    out = struct.pack("<H", len(entries))
    for tag, t, v in entries:
        out += struct.pack("<HHI", tag, t, 1) + (struct.pack("<HH", v, 0) if t == 3 else struct.pack("<I", v))
    return out + struct.pack("<I", following)


def _tif_places(shape: tuple[int, int, int], dtype: np.dtype) -> tuple[int, int, int]:
    """(bytes of a page's body, the same made even, bytes from one page to the next). The first page begins at byte 8."""
    size = shape[0] * shape[1] * dtype.itemsize
    return size, size + size % 2, size + size % 2 + len(_tif_directory((1, 1), dtype, 0, 0, 0))


def tif_heads(shape: tuple[int, int, int], dtype: np.dtype) -> Iterator[tuple[int, bytes]]:
    """(place, bytes) of all that is not a pixel."""
    size, even, step = _tif_places(shape, dtype)
    if 8 + shape[2] * step >= 1 << 32:
        raise ValueError("a tif file of this kind ends below 4 GB")
    yield 0, b"II*\0" + struct.pack("<I", 8 + even if shape[2] else 0)
    for z in range(shape[2]):
        start = 8 + z * step
        yield start + even, _tif_directory(shape[:2], dtype, start, size, start + step + even if z + 1 < shape[2] else 0)


def encode_tif(a: np.ndarray) -> bytes:
    a = _as_3d(a)
    size, _, step = _tif_places(a.shape, a.dtype)
    out = bytearray(8 + a.shape[2] * step)
    for at, raw in tif_heads(a.shape, a.dtype):
        out[at : at + len(raw)] = raw
    for z in range(a.shape[2]):
        out[8 + z * step : 8 + z * step + size] = np.ascontiguousarray(a[:, :, z].T).astype(a.dtype.newbyteorder("<")).tobytes()
    return bytes(out)


# nrrd; fixed values of the format: its type names
NRRD_TYPES = {
    "signed char": "i1", "int8": "i1", "unsigned char": "u1", "uchar": "u1", "uint8": "u1", "short": "i2", "int16": "i2", "ushort": "u2", "unsigned short": "u2", "uint16": "u2",
    "int": "i4", "int32": "i4", "uint": "u4", "unsigned int": "u4", "uint32": "u4", "longlong": "i8", "int64": "i8", "ulonglong": "u8", "uint64": "u8", "float": "f4", "double": "f8",
}


def decode_nrrd(data: bytes) -> np.ndarray:
    head, _, body = data.partition(b"\n\n")
    fields = {}
    for line in head.decode("ascii", "replace").splitlines()[1:]:
        if not line.startswith("#") and ":" in line:
            k, _, v = line.partition(":")
            fields[k.strip().lower()] = v.lstrip("=").strip()
    dtype = np.dtype(NRRD_TYPES[fields["type"].lower()]).newbyteorder(">" if fields.get("endian") == "big" else "<")
    how = fields.get("encoding", "raw").lower()
    body = {"raw": bytes, "gzip": gzip.decompress, "gz": gzip.decompress, "bzip2": bz2.decompress, "bz2": bz2.decompress}[how](body)
    shape = tuple(map(int, fields["sizes"].split()))
    return np.frombuffer(body, dtype, int(np.prod(shape))).reshape(shape, order="F")


def encode_nrrd(a: np.ndarray, encoding: str = "gzip") -> bytes:
    name = next(k for k, v in NRRD_TYPES.items() if v == f"{a.dtype.kind}{a.dtype.itemsize}")
    head = f"NRRD0004\ntype: {name}\ndimension: {a.ndim}\nsizes: {' '.join(map(str, a.shape))}\nendian: little\nencoding: {encoding}\n\n"
    raw = a.astype(a.dtype.newbyteorder("<")).tobytes(order="F")
    return head.encode() + {"raw": bytes, "gzip": gzip.compress, "bzip2": bz2.compress}[encoding](raw)


# mhd; fixed values of the format: its element types
MHD_TYPES = {"MET_CHAR": "i1", "MET_UCHAR": "u1", "MET_SHORT": "i2", "MET_USHORT": "u2", "MET_INT": "i4", "MET_UINT": "u4", "MET_LONG_LONG": "i8", "MET_ULONG_LONG": "u8", "MET_FLOAT": "f4", "MET_DOUBLE": "f8"}


def mhd_header(text: str) -> dict[str, str]:
    return {k.strip(): v.strip() for k, _, v in (line.partition("=") for line in text.splitlines()) if v}


def decode_mhd(header: str, raw: bytes) -> np.ndarray:
    h = mhd_header(header)
    dtype = np.dtype(MHD_TYPES[h["ElementType"]]).newbyteorder(">" if h.get("BinaryDataByteOrderMSB", "False") == "True" else "<")
    shape = tuple(map(int, h["DimSize"].split()))
    return np.frombuffer(raw, dtype, int(np.prod(shape))).reshape(shape, order="F")


def encode_mhd(a: np.ndarray, raw_name: str) -> tuple[str, bytes]:
    name = next(k for k, v in MHD_TYPES.items() if v == f"{a.dtype.kind}{a.dtype.itemsize}")
    head = {"ObjectType": "Image", "NDims": a.ndim, "DimSize": " ".join(map(str, a.shape)), "BinaryData": "True", "BinaryDataByteOrderMSB": "False", "ElementType": name, "ElementDataFile": raw_name}
    return "".join(f"{k} = {v}\n" for k, v in head.items()), a.astype(a.dtype.newbyteorder("<")).tobytes(order="F")


# csv of numbers
def decode_csv(data: bytes) -> np.ndarray:
    return np.loadtxt(io.BytesIO(data), delimiter=",", ndmin=2)


def encode_csv(a: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savetxt(out, a if a.ndim <= 2 else a.reshape(a.shape[0], -1), delimiter=",", fmt="%.5e")
    return out.getvalue()


DECODERS: dict[str, Callable[[bytes], np.ndarray]] = {"npy": decode_npy, "tif": decode_tif, "tiff": decode_tif, "nrrd": decode_nrrd, "nrdh": decode_nrrd, "csv": decode_csv}
ENCODERS: dict[str, Callable[[np.ndarray], bytes]] = {"npy": encode_npy, "tif": encode_tif, "tiff": encode_tif, "nrrd": encode_nrrd, "csv": encode_csv}


def format_of(path: str) -> str:
    """The format by the name's end; an unknown one is an error."""
    end = path.rsplit(".", 1)[-1].lower()
    if end not in (*DECODERS, "mhd"):
        raise ValueError(f"no format for {path}")
    return end


def read_volumes(spark: SparkSession, path: str, fmt: str | None = None, bounds: dict[str, tuple[int, int]] | None = None) -> DataFrame:
    """path, x, y, z, v (double) of every voxel. ``bounds``: half-open ranges per axis, cut before rows are made."""
    fmt = fmt or format_of(path)
    if fmt == "mhd":
        return _read_mhd(spark, path, bounds)
    decode = DECODERS[fmt]
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(lambda batches: _rows(batches, lambda b, i: decode(b.column(1)[i].as_py()), bounds), "path string, x int, y int, z int, v double")


def _read_mhd(spark: SparkSession, path: str, bounds) -> DataFrame:
    read = spark.read.format("binaryFile")
    heads = read.load(path).select("path", F.decode("content", "UTF-8").alias("head"))
    heads = heads.withColumn("raw_path", F.concat(F.regexp_extract("path", r"^(.*/)", 1), F.regexp_extract("head", r"ElementDataFile\s*=\s*(\S+)", 1)))
    raws = read.option("pathGlobFilter", "*.raw").load(path.rsplit("/", 1)[0]).select(F.col("path").alias("raw_path"), "content")
    both = heads.join(raws, "raw_path").select("path", "content", "head")
    return both.mapInArrow(lambda batches: _rows(batches, lambda b, i: decode_mhd(b.column(2)[i].as_py(), b.column(1)[i].as_py()), bounds), "path string, x int, y int, z int, v double")


def _voxels(volumes: Iterator[tuple[pa.Scalar, np.ndarray]], bounds) -> Iterator[pa.RecordBatch]:
    """A large volume goes out plane by plane; small ones share a batch."""
    held: list[list[pa.Array]] = []
    rows = 0

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in zip(*held)], ["path", "x", "y", "z", "v"])

    for path, a in volumes:
        a = _as_3d(a)
        cut = [slice(*(bounds or {}).get(c, (0, n))) for c, n in zip(AXES, a.shape)]
        part = a[tuple(cut)]
        step = max(1, BATCH_ROWS // max(1, part.shape[0] * part.shape[1]))
        for z in range(0, part.shape[2], step):
            planes = part[:, :, z : z + step]
            x, y, k = np.indices(planes.shape, np.int32).reshape(3, -1)
            held.append([pa.repeat(path, planes.size), pa.array(x + np.int32(cut[0].start)), pa.array(y + np.int32(cut[1].start)), pa.array(k + np.int32(z + cut[2].start)), pa.array(planes.ravel().astype(float))])
            rows += planes.size
            if rows >= BATCH_ROWS:
                yield out()
                held.clear()
                rows = 0
    if held:
        yield out()


def _rows(batches: Iterator[pa.RecordBatch], decode, bounds) -> Iterator[pa.RecordBatch]:
    yield from _voxels(((batch.column(0)[i], decode(batch, i)) for batch in batches for i in range(batch.num_rows)), bounds)


def read_listed(files: DataFrame, fmt: str, bounds: dict[str, tuple[int, int]] | None = None) -> DataFrame:
    """As ``read_volumes``, of the files named by a column ``path``: tasks open them by pyarrow's file systems, and nothing is listed."""
    from tessera.sources.sliced import open_file

    decode = DECODERS[fmt]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def volumes() -> Iterator[tuple[pa.Scalar, np.ndarray]]:
            for batch in batches:
                for path in batch.column(0):
                    with open_file(path.as_py()) as f:
                        yield path, decode(f.read())

        yield from _voxels(volumes(), bounds)

    return files.select("path").mapInArrow(run, "path string, x int, y int, z int, v double")


def catalog(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    """path, shape, dtype of volume files: npy and tif by their headers, others are decoded."""
    if (fmt or format_of(path)) in ("npy", "tif", "tiff"):
        from tessera.sources.sliced import headers

        return headers(spark, path, fmt)
    decode = DECODERS[fmt or format_of(path)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            arrays = [decode(c.as_py()) for c in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([list(a.shape) for a in arrays], pa.list_(pa.int32())), pa.array([str(a.dtype) for a in arrays])], ["path", "shape", "dtype"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, shape array<int>, dtype string")


def _by_volume(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """(rows, first row of each volume and the number of rows) of rows that come sorted by their first column: whole volumes, as many as arrived together."""
    held: list[pa.RecordBatch] = []  # of the volume that has not ended

    def out(parts: list[pa.RecordBatch], edges: np.ndarray) -> tuple[pa.Table, np.ndarray]:
        return pa.Table.from_batches(parts).combine_chunks(), edges

    for b in batches:
        if not b.num_rows:
            continue
        code = b.column(0).dictionary_encode(null_encoding="encode").indices.to_numpy()
        edges = np.concatenate([[0], np.flatnonzero(code[1:] != code[:-1]) + 1])
        before = sum(h.num_rows for h in held)
        if held and not held[-1].column(0)[-1].equals(b.column(0)[0]):
            yield out(held, np.array([0, before]))
            held, before = [], 0
        last = int(edges[-1])
        if last:  # volumes end here
            yield out([*held, b.slice(0, last)], np.append(0, edges[1:] + before))
            held = []
        held.append(b.slice(last))
    if held:
        yield out(held, np.array([0, sum(h.num_rows for h in held)]))


def encode(vox: DataFrame, fmt: str, dtype: str = "float32") -> DataFrame:
    """vol_id, content: each volume as the bytes of a file; voxels that are not stored are 0. A task takes whole volumes, one after the other."""
    pack = ENCODERS[fmt]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, edges in _by_volume(batches):
            at = [t[a].to_numpy() for a in AXES]
            v = t["v"].to_numpy()
            shapes = np.stack([np.maximum.reduceat(a, edges[:-1]) for a in at], axis=1) + 1
            ids, made, size, first = t["vol_id"], [], 0, 0
            for i, (lo, hi) in enumerate(zip(edges.tolist(), edges[1:].tolist())):
                a = np.zeros(shapes[i], dtype)
                a[at[0][lo:hi], at[1][lo:hi], at[2][lo:hi]] = v[lo:hi]
                made.append(pack(a))
                size += len(made[-1])
                if size >= BATCH_BYTES or i == len(edges) - 2:
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(edges[first : i + 1])).combine_chunks(), pa.array(made, pa.binary())], ["vol_id", "content"])
                    made, size, first = [], 0, i + 1

    rows = vox.select("vol_id", *AXES, "v").repartition("vol_id").sortWithinPartitions("vol_id")
    return rows.mapInArrow(run, f"vol_id {vox.schema['vol_id'].dataType.simpleString()}, content binary")


def write(vox: DataFrame, folder: str, fmt: str, name: Column, dtype: str = "float32") -> DataFrame:
    """path, n_bytes of every volume's file, written by the tasks; ``name`` comes from vol_id.

    A npy or tif volume of more than ``WHOLE`` voxels is cut into runs of ``PIECE`` voxels, which are put at their places in the file side by side; on stores that are not
    mounted, and in other formats, one task holds the volume.
    """
    from tessera.plans.scratch import Scratch
    from tessera.sources.sliced import _place, write_volumes

    if fmt not in ("npy", "tif", "tiff") or not isinstance(_place(folder)[0], fs.LocalFileSystem):
        return write_volumes(encode(vox, fmt, dtype), folder, name)
    scratch = Scratch(vox.sparkSession, "large")
    sizes = vox.groupBy("vol_id").agg(*[(F.max(a).cast("long") + 1).alias(f"n{a}") for a in AXES])
    large = scratch.save(sizes.filter(F.col("nx") * F.col("ny") * F.col("nz") > WHOLE).select("vol_id", name.alias("name"), "nx", "ny", "nz"), "volumes")
    count = large.count()
    if not count:
        return write_volumes(encode(vox, fmt, dtype), folder, name)
    near = (lambda df: F.broadcast(df)) if count <= BROADCAST_VOLUMES else (lambda df: df.hint("shuffle_hash"))
    rest = write_volumes(encode(vox.join(near(large), "vol_id", "left_anti"), fmt, dtype), folder, name)
    return rest.unionByName(_write_large(vox.join(near(large), "vol_id"), large, folder, fmt, np.dtype(dtype).newbyteorder("<"), scratch))


def _npy_head(shape: tuple[int, ...], dtype: np.dtype) -> bytes:
    out = io.BytesIO()
    np.lib.format.write_array_header_1_0(out, {"descr": np.lib.format.dtype_to_descr(dtype), "fortran_order": True, "shape": shape})
    return out.getvalue()


def _runs(fmt: str, shape: tuple[int, int, int], dtype: np.dtype, first: int, n: int) -> Iterator[tuple[int, int, int]]:
    """(place in the file, first voxel, voxels) of ``n`` voxels from ``first`` on, x running fastest."""
    if fmt == "npy":
        yield len(_npy_head(shape, dtype)) + first * dtype.itemsize, first, n
        return
    page, step = shape[0] * shape[1], _tif_places(shape, dtype)[2]
    while n:
        z, inside = divmod(first, page)
        m = min(n, page - inside)
        yield 8 + z * step + inside * dtype.itemsize, first, m
        first, n = first + m, n - m


def _write_large(vox: DataFrame, large: DataFrame, folder: str, fmt: str, dtype: np.dtype, scratch) -> DataFrame:
    """Files get their length and heads, then their pieces, then their names; every step leaves the same bytes when a task runs again."""
    from tessera.sources.sliced import _place

    place, mark = _place(folder)[1], uuid.uuid4().hex

    def total(shape: tuple[int, int, int]) -> int:
        return 8 + shape[2] * _tif_places(shape, dtype)[2] if fmt != "npy" else len(_npy_head(shape, dtype)) + int(np.prod(shape)) * dtype.itemsize

    def shapes(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, tuple[int, int, int]]]:
        for b in batches:
            for n, *shape in zip(*[c.to_pylist() for c in b.columns]):
                yield n, tuple(shape)

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for n, shape in shapes(batches):
            part = f"{place}/{n}.{mark}.part"
            os.makedirs(os.path.dirname(part), exist_ok=True)
            f = os.open(part, os.O_CREAT | os.O_RDWR, 0o644)
            try:
                os.ftruncate(f, total(shape))  # what is not written is 0
                for at, raw in [(0, _npy_head(shape, dtype))] if fmt == "npy" else tif_heads(shape, dtype):
                    os.pwrite(f, raw, at)
            finally:
                os.close(f)
            yield pa.RecordBatch.from_arrays([pa.array([n])], ["name"])

    def put(piece: pa.Table) -> pa.Table:
        n, shape = piece["name"][0].as_py(), tuple(piece[f"n{a}"][0].as_py() for a in AXES)
        first = piece["piece"][0].as_py() * PIECE
        values = np.zeros(min(PIECE, int(np.prod(shape)) - first), dtype)
        values[piece["at"].to_numpy() - first] = piece["v"].to_numpy()
        f = os.open(f"{place}/{n}.{mark}.part", os.O_RDWR)
        try:
            for at, k, m in _runs(fmt, shape, dtype, first, len(values)):
                raw = memoryview(values[k - first : k - first + m]).cast("B")
                while raw:
                    done = os.pwrite(f, raw, at)
                    raw, at = raw[done:], at + done
        finally:
            os.close(f)
        return pa.table({"name": [n]})

    def end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for n, shape in shapes(batches):
            part = f"{place}/{n}.{mark}.part"
            if os.path.exists(part):  # else the task ran before
                os.replace(part, f"{place}/{n}")
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{n}"]), pa.array([total(shape)], pa.int64())], ["path", "n_bytes"])

    named = large.select("name", "nx", "ny", "nz")
    scratch.save(named.mapInArrow(begin, "name string"), "begun")
    at = F.col("x") + F.col("nx") * (F.col("y") + F.col("ny") * F.col("z"))
    placed = vox.select("name", "nx", "ny", "nz", at.alias("at"), "v").withColumn("piece", F.expr(f"at div {PIECE}"))
    scratch.save(placed.groupBy("name", "piece").applyInArrow(put, "name string"), "pieces")
    return scratch.save(named.mapInArrow(end, "path string, n_bytes bigint"), "files")


def write_files(files: DataFrame, folder: str, name: Callable[[object], str]) -> int:
    """Write (vol_id, content) rows as files into stores that only Hadoop opens; the driver holds one file at a time. Elsewhere ``sliced.write_volumes`` lets the tasks write."""
    spark = files.sparkSession
    jvm = spark._jvm
    n = 0
    for r in files.toLocalIterator():
        path = jvm.org.apache.hadoop.fs.Path(f"{folder}/{name(r['vol_id'])}")
        out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path, True)
        try:
            out.write(bytearray(r["content"]))
        finally:
            out.close()
        n += 1
    return n


def convert(spark: SparkSession, source: str, folder: str, fmt: str, dtype: str = "float32") -> int:
    """Every file of ``source`` written again in another format under ``folder``, with its own name; tasks write."""
    vox = read_volumes(spark, source).withColumnRenamed("path", "vol_id")
    name = F.concat(F.regexp_extract("vol_id", r"([^/]*)\.[^./]*$", 1), F.lit(f".{fmt}"))
    return write(vox, folder, fmt, name, dtype).count()


# limits of element types
def max_value(dtype: str) -> float:
    d = np.dtype(dtype)
    return float(np.finfo(d).max) if d.kind == "f" else int(np.iinfo(d).max)


def min_value(dtype: str) -> float:
    d = np.dtype(dtype)
    return float(np.finfo(d).min) if d.kind == "f" else int(np.iinfo(d).min)


def validate(shape=None, dtype=None, like: dict | None = None, hint: dict | None = None) -> dict:
    """shape and dtype of a sink: explicit values must agree with ``like``; what is missing comes from ``like``, then ``hint``."""
    out = {}
    for k, v in (("shape", tuple(shape) if shape is not None else None), ("dtype", dtype)):
        known = (like or {}).get(k)
        if v is not None and known is not None and v != known:
            raise ValueError(f"{k} {v} does not fit {known}")
        out[k] = v if v is not None else known if known is not None else (hint or {}).get(k)
    return out
