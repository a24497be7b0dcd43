"""Slices of volume files: right values, only the bytes that are needed, conditions that reach the source, writing by tasks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.sources import sliced, volumes

BOUNDS = {"x": (3, 9), "y": (2, 5), "z": (1, 4)}


def _volume(order="C", kind="<u2"):
    return np.asarray(np.arange(12 * 7 * 5).reshape(12, 7, 5), kind, order=order)


def _put(path, a, fmt):
    path.write_bytes(volumes.ENCODERS[fmt](a))


def _got(df):
    rows = df.collect()
    assert len({(r.path, r.x, r.y, r.z) for r in rows}) == len(rows)
    return {(r.x, r.y, r.z): r.v for r in rows}


def _want(a, bounds):
    cut = [range(*bounds.get(c, (0, n))) for c, n in zip("xyz", a.shape)]
    return {(x, y, z): float(a[x, y, z]) for x in cut[0] for y in cut[1] for z in cut[2] if x < a.shape[0] and y < a.shape[1] and z < a.shape[2]}


@pytest.mark.parametrize("kind", ["<u2", ">f8", "|i1"])
@pytest.mark.parametrize("order", ["C", "F"])
@pytest.mark.parametrize("task_bytes", [1, 100, 1 << 20])
def test_npy_slices(spark, tmp_path, kind, order, task_bytes):
    a = _volume(order, kind)
    np.save(tmp_path / "a.npy", a)
    path = str(tmp_path / "a.npy")
    assert _got(sliced.read_slices(spark, path, task_bytes=task_bytes)) == _want(a, {})
    assert _got(sliced.read_slices(spark, path, BOUNDS, task_bytes=task_bytes)) == _want(a, BOUNDS)
    tasks = sliced.plan(spark, path, BOUNDS, task_bytes=task_bytes)
    row = (a.shape[2] if order == "C" else a.shape[0]) * a.itemsize
    assert all(t[2] <= max(task_bytes, row) for t in tasks)
    assert sum(t[2] for t in tasks) == (6 if order == "C" else 3) * 3 * row  # planes x rows of the box
    assert sliced.read_slices(spark, path, {"x": (50, 60)}).count() == 0


@pytest.mark.parametrize("dims", [(9,), (4, 6)])
def test_npy_of_fewer_axes(spark, tmp_path, dims):
    a = np.arange(np.prod(dims)).reshape(dims)
    np.save(tmp_path / "a.npy", a)
    assert _got(sliced.read_slices(spark, str(tmp_path / "a.npy"))) == _want(a.reshape(dims + (1,) * (3 - len(dims))), {})


def test_tif_slices(spark, tmp_path):
    a = _volume()
    _put(tmp_path / "a.tif", a, "tif")
    path = str(tmp_path / "a.tif")
    assert _got(sliced.read_slices(spark, path)) == _want(a, {}) == _got(volumes.read_volumes(spark, path))
    assert _got(sliced.read_slices(spark, path, BOUNDS, task_bytes=60)) == _want(a, BOUNDS)
    tasks = sliced.plan(spark, path, {"z": (2, 3), "y": (1, 2)})
    assert sum(t[2] for t in tasks) in (a.shape[0] * a.itemsize, a.shape[0] * a.shape[1] * a.itemsize)  # a row of a page, or its one strip


def test_a_slice_of_a_file_larger_than_a_task(spark, tmp_path):
    """A sparse file of 6 GB: two small pieces of it are read."""
    shape = (3000, 1000, 1000)
    with open(tmp_path / "big.npy", "wb") as f:
        np.lib.format.write_array_header_1_0(f, {"descr": "<u2", "fortran_order": False, "shape": shape})
        first = f.tell()
        f.seek(first + (2999 * 1_000_000 + 999 * 1000 + 998) * 2)
        f.write(np.array([7, 9], "<u2").tobytes())
    path = str(tmp_path / "big.npy")
    bounds = {"x": (2990, 3000), "y": (990, 1000), "z": (990, 1000)}
    assert sum(t[2] for t in sliced.plan(spark, path, bounds)) == 10 * 10 * 1000 * 2
    got = _got(sliced.read_slices(spark, path, bounds))
    assert len(got) == 1000 and got[2999, 999, 998] == 7 and got[2999, 999, 999] == 9 and sum(got.values()) == 16
    assert [tuple(r.shape) for r in sliced.headers(spark, path).collect()] == [shape]


def test_conditions_reach_the_source(spark, tmp_path):
    a = _volume()
    np.save(tmp_path / "a.npy", a)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        df = sliced.read_slices(spark, str(tmp_path / "a.npy"))
        got = df.filter("x >= 3 and x < 9 and y in (2, 4) and z = 1 and v > 120")
        assert _got(got) == {k: v for k, v in _want(a, {"x": (3, 9), "z": (1, 2)}).items() if k[1] in (2, 4) and v > 120}
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    reader = sliced.NarrowedReader({"paths": "[]"})
    left = list(reader.pushFilters([sliced.GreaterThan(("x",), 3), sliced.LessThanOrEqual(("y",), 7), sliced.EqualTo(("z",), 2), sliced.EqualTo(("path",), "p"), sliced.In(("x",), (5, 9))]))
    assert reader.box == [[5, 10], [0, 8], [2, 3]] and len(left) == 2


def test_tasks_write_files(spark, tmp_path):
    a = _volume(kind="<f4")
    rows = [(vol, *map(int, p), float(a[p] + vol)) for vol in (1, 2) for p in np.ndindex(a.shape)]
    vox = spark.createDataFrame(rows, "vol_id bigint, x int, y int, z int, v double")
    written = sliced.write_volumes(volumes.encode(vox, "npy"), f"file://{tmp_path}/out", F.format_string("v%d.npy", "vol_id"))
    assert {r.path.rsplit("/", 1)[-1] for r in written.collect()} == {"v1.npy", "v2.npy"} and sorted(p.name for p in (tmp_path / "out").iterdir()) == ["v1.npy", "v2.npy"]
    for vol in (1, 2):
        assert np.array_equal(np.load(tmp_path / "out" / f"v{vol}.npy"), a + vol)


def test_bad_files(spark, tmp_path):
    (tmp_path / "a.npy").write_bytes(b"not one")
    with pytest.raises(Exception, match="no npy file"):
        sliced.header(str(tmp_path / "a.npy"))
    with pytest.raises(ValueError, match="no ranges"):
        sliced.header("a.csv")
    with pytest.raises(FileNotFoundError):
        sliced.read_slices(spark, str(tmp_path / "none*.npy"))
