"""Matrix files: round trips, foreign files, splits, and files that are refused."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.sources import matrices


def test_round_trip_by_several_tasks(spark, tmp_path):
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(1000, 7)).astype("<f4")
    df = spark.createDataFrame([(f"doc {i:04d}", v.tolist()) for i, v in enumerate(vectors)], "id string, v array<float>").orderBy(F.rand(1)).repartition(5)
    at = str(tmp_path / "m")
    matrices.write(df, at, "id", "v")
    assert len(list((tmp_path / "m").glob("rows-*.npy"))) > 1
    found = matrices.with_ids(spark, at, 1 << 12)
    got = {r["id"]: np.array(r["values"], "<f4") for r in found.collect()}
    assert len(got) == 1000 and all((got[f"doc {i:04d}"] == vectors[i]).all() for i in range(1000))
    (tmp_path / "m" / matrices.MANIFEST).unlink()
    with pytest.raises(Exception, match=matrices.MANIFEST):
        matrices.read(spark, at).count()


@pytest.mark.parametrize("dtype", ["<f4", "<f8", "<i4", ">f4", "|u1"])
def test_arrays_of_numpy(spark, tmp_path, dtype):
    data = np.arange(60).reshape(12, 5).astype(dtype)
    np.save(tmp_path / "x.npy", data)
    df = matrices.read(spark, str(tmp_path / "x.npy"), 40)
    assert df.rdd.getNumPartitions() > 1
    assert [r["values"] for r in df.orderBy("row").collect()] == data.astype(float).tolist()
    np.save(tmp_path / "y.npy", data[:, 0])
    assert [r["values"] for r in matrices.read(spark, str(tmp_path / "y.npy")).orderBy("row").collect()] == [[float(x)] for x in data[:, 0]]
    np.save(tmp_path / "none.npy", data[:0])
    assert matrices.read(spark, str(tmp_path / "none.npy")).collect() == []


def test_flat_index(spark, tmp_path):
    data = np.arange(12, dtype="<f4").reshape(4, 3)
    head = b"IxFI" + struct.pack("<iqqq?iQ", 3, 4, 1 << 20, 1 << 20, True, 0, 12)
    (tmp_path / "flat.index").write_bytes(head + data.tobytes())
    assert [r["values"] for r in matrices.read(spark, str(tmp_path / "flat.index"), 12).orderBy("row").collect()] == data.tolist()


def test_refused_files(spark, tmp_path):
    np.save(tmp_path / "x.npy", np.ones((10, 4), "<f4"))
    raw = (tmp_path / "x.npy").read_bytes()
    for name, data in (("short", raw[:-3]), ("long", raw + b"\0"), ("other", b"PK" + raw), ("fortran", None)):
        path = tmp_path / f"{name}.npy"
        np.save(path, np.asfortranarray(np.ones((3, 2)))) if data is None else path.write_bytes(data)
        with pytest.raises(ValueError):
            matrices.shape_of(str(path))
        with pytest.raises(Exception, match="bytes where|no matrix|not rows"):
            matrices.read(spark, str(path)).collect()
    with pytest.raises(ValueError, match="unlike"):
        matrices.write(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "id int, v array<double>"), str(tmp_path / "u"), "id", "v")
