"""Volumes that tasks write: large ones in pieces, small ones read back without a listing."""

import io

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.sources import sliced, volumes


def _voxels(spark, arrays):
    rows = [(i, int(x), int(y), int(z), float(a[x, y, z])) for i, a in enumerate(arrays) for x, y, z in np.argwhere(a)]
    return spark.createDataFrame(rows, "vol_id long, x int, y int, z int, v double")


@pytest.mark.parametrize("dtype", ["float32", "uint8", "int16"])
@pytest.mark.parametrize("fmt", ["npy", "tif"])
def test_large_volumes_are_written_in_pieces(spark, tmp_path, monkeypatch, fmt, dtype):
    monkeypatch.setattr(volumes, "WHOLE", 30)
    monkeypatch.setattr(volumes, "PIECE", 16)
    seen = []
    held = volumes.encode
    monkeypatch.setattr(volumes, "encode", lambda vox, *a: seen.append({r.vol_id for r in vox.select("vol_id").distinct().collect()}) or held(vox, *a))
    r = np.random.default_rng(5)
    arrays = [r.integers(1, 99, s) for s in ((5, 7, 3), (3, 3, 1), (2, 3, 5), (1, 1, 60), (40, 1, 2))]
    arrays[0][:4, :6, 1] = 0  # a piece without voxels is 0
    arrays[4][3:36, 0, 0] = 0
    written = volumes.write(_voxels(spark, arrays), f"file://{tmp_path}/out", fmt, F.format_string(f"v%d.{fmt}", "vol_id"), dtype)
    assert seen == [{1, 2}]
    sizes = {x.path: x.n_bytes for x in written.collect()}
    assert sorted(p.name for p in (tmp_path / "out").iterdir() if not p.name.startswith(".")) == [f"v{i}.{fmt}" for i in range(5)] and len(sizes) == 5
    for i, a in enumerate(arrays):
        raw = (tmp_path / f"out/v{i}.{fmt}").read_bytes()
        got = np.load(io.BytesIO(raw)) if fmt == "npy" else volumes.decode_tif(raw)
        assert got.dtype == np.dtype(dtype) and got.shape == a.shape and np.array_equal(got, a) and sizes[f"file://{tmp_path}/out/v{i}.{fmt}"] == len(raw)
    if fmt == "tif":
        assert raw == volumes.encode_tif(arrays[4].astype(dtype))
    back = sliced.read_slices(spark, f"{tmp_path}/out/v0.{fmt}", {"x": (1, 4), "z": (1, 3)}).collect()
    assert sorted((x.x, x.y, x.z, x.v) for x in back) == [(x, y, z, float(arrays[0][x, y, z])) for x in range(1, 4) for y in range(7) for z in (1, 2)]


@pytest.mark.parametrize("fmt", ["npy", "tif", "nrrd"])
def test_listed_files_are_read_as_by_listing(spark, tmp_path, fmt):
    r = np.random.default_rng(6)
    arrays = [r.integers(1, 99, s) for s in ((2, 3, 4), (5, 1, 1), (3, 2, 2))]
    written = volumes.write(_voxels(spark, arrays), f"file://{tmp_path}/in", fmt, F.format_string(f"v%d.{fmt}", "vol_id"))
    rows = lambda df: sorted((x.path.rsplit("/", 1)[1], x.x, x.y, x.z, x.v) for x in df.collect())
    for bounds in (None, {"x": (1, 3), "z": (0, 2)}):
        got = rows(volumes.read_listed(written, fmt, bounds))
        assert got == rows(volumes.read_volumes(spark, f"{tmp_path}/in/*.{fmt}", bounds=bounds))
    assert got == sorted((f"v{i}.{fmt}", x, y, z, float(v)) for i, a in enumerate(arrays) for (x, y, z), v in np.ndenumerate(a) if 1 <= x < 3 and z < 2)


def test_small_volumes_share_a_batch():
    small = ((pa.scalar(str(i)), np.full((4, 4, 4), i)) for i in range(500))
    assert len(list(volumes._voxels(small, None))) == 1
    big = list(volumes._voxels(iter([(pa.scalar("a"), np.arange(300 * 300 * 5).reshape(300, 300, 5))]), None))
    assert len(big) == 5 and sum(b.num_rows for b in big) == 450_000


def test_volumes_come_whole_whatever_the_batches():
    ids = pa.array([None, None, "a", "a", "a", "b", "c", "c"])
    whole = pa.RecordBatch.from_arrays([ids, pa.array(range(8))], ["vol_id", "v"])
    for cuts in ([], [1], [2], [3, 4], [5, 6], list(range(1, 8))):
        edges = [0, *cuts, 8]
        got = [t["v"].to_pylist()[a:b] for t, e in volumes._by_volume(whole.slice(a, b - a) for a, b in zip(edges, edges[1:])) for a, b in zip(e, e[1:])]
        assert got == [[0, 1], [2, 3, 4], [5], [6, 7]]
