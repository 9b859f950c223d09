"""HDF5 and MAT records: round trips, ranges, what a failing task leaves, and odd fields."""

from __future__ import annotations

import os
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from skeinwork.sources import hdf5, mat5, records

TEXT = ["one", "", "  padded", "élan 𝄞", "x" * 300]


@pytest.fixture
def table(spark):
    records.use(spark)
    rows = [(k, TEXT[k % 5], float(k) if k % 7 else None, [k, -k, 2 * k], k % 3) for k in range(1000)]
    return spark.createDataFrame(rows, "id long, name string, x double, m array<int>, small int").repartition(3)


def kept(df, path, layout, **options):
    df.write.format("records").option("layout", layout).options(**options).mode("append").save(str(path))
    return df.sparkSession.read.format("records").option("layout", layout)


@pytest.mark.parametrize("layout", ["hdf5", "mat"])
def test_round_trip(spark, table, tmp_path, layout):
    back = kept(table, tmp_path / "t", layout, rows=150).option("split", 4096).load(str(tmp_path / "t"))
    want = {r["id"]: (r["name"].strip(), r["x"], r["m"], r["small"]) for r in table.collect()}
    got = {r["id"]: (r["name"], None if np.isnan(r["x"]) else r["x"], r["m"], r["small"]) for r in back.collect()}
    assert got == want and back.count() == 1000
    assert dict(back.dtypes) == dict(table.dtypes)
    files = [f for f in os.listdir(tmp_path / "t") if not f.startswith(".")]
    assert len(files) >= 7 and all(f.endswith(records.ENDING[layout]) for f in files)
    assert back.rdd.getNumPartitions() > len(files) if layout == "hdf5" else back.rdd.getNumPartitions() == len(files)


@pytest.mark.parametrize("layout", ["hdf5", "mat"])
def test_asked_columns_and_overwriting(spark, table, tmp_path, layout):
    path = str(tmp_path / "t")
    read = kept(table, path, layout)
    two = read.schema("small int, name string").load(path)
    assert two.columns == ["small", "name"] and two.groupBy("small").count().count() == 3
    kept(table.limit(10), path, layout)
    assert read.load(path).count() == 1010
    table.limit(5).write.format("records").option("layout", layout).mode("overwrite").save(path)
    assert read.load(path).count() == 5
    table.where("false").write.format("records").option("layout", layout).mode("overwrite").save(path)
    assert read.schema(table.schema).load(path).count() == 0


@pytest.mark.parametrize("layout", ["hdf5", "mat"])
def test_a_failing_task_leaves_nothing(spark, table, tmp_path, layout):
    path = tmp_path / "t"
    read = kept(table, path, layout, rows=100)
    before = sorted(os.listdir(path))
    bad = table.withColumn("id", F.when(F.col("id") != 777, F.col("id")))  # a null among integers, in one of three tasks
    with pytest.raises(Exception, match="a null among integers"):
        kept(bad, path, layout, rows=100)
    with pytest.raises(Exception, match="one length"):
        kept(table.withColumn("m", F.slice("m", 1, F.col("small") + 1)), path, layout)
    with pytest.raises(Exception, match="no place in a matrix"):
        kept(table.withColumn("m", F.col("small") > 0), path, layout)
    assert sorted(os.listdir(path)) == before and read.load(str(path)).count() == 1000


@pytest.mark.parametrize("layout", ["hdf5", "mat"])
def test_a_task_that_outlives_its_write_leaves_nothing(tmp_path, layout):
    """Other tasks of a failed write end after its folder has been removed; some stores make the folder again with a file."""
    batch = pa.record_batch({"id": pa.array(range(10))})
    writer = records.Records({"path": str(tmp_path), "layout": layout}).writer(StructType(), False)
    writer.write(iter([batch]))
    writer.abort([])
    for again in (False, True):
        if again:
            (tmp_path / writer.pending).mkdir()
        with pytest.raises(OSError):
            writer.write(iter([batch]))
        assert os.listdir(tmp_path) == []
    writer = records.Records({"path": str(tmp_path), "layout": layout}).writer(StructType(), False)
    writer.commit([writer.write(iter([batch])), None])
    assert [f.suffix for f in tmp_path.iterdir()] == [records.ENDING[layout]]


def test_only_the_bytes_of_a_range_are_read(tmp_path):
    x = {"v": np.arange(50_000.0), "m": np.random.default_rng(1).integers(0, 255, (50_000, 7)).astype(np.uint8), "one": np.array([42.0])}
    data, seen = hdf5.written("a", x, step=1000), []

    def read(at, n):
        seen.append(n)
        return data[at : at + n]

    found = hdf5.datasets(read, "a")
    assert {k: (d.shape, d.rows) for k, d in found.items()} == {"v": ((1, 50_000), 50_000), "m": ((7, 50_000), 50_000), "one": ((1, 1), 1)}
    for name, low, high in (("v", 10, 20), ("m", 1999, 2001), ("m", 49_990, 50_000), ("m", 7, 7)):
        seen.clear()
        assert (hdf5.rows_of(read, found[name], low, high) == x[name].reshape(50_000, -1)[low:high]).all()
        assert sum(seen) < 20_000
    with pytest.raises(ValueError, match="early format"):
        hdf5.datasets(lambda at, n: b"\0" * n, "a")


def test_trees_of_several_levels_and_shuffled_chunks():
    """A chunk tree with an inner node, and the shuffle filter before deflate, laid down by hand."""
    x = np.arange(12, dtype=np.int32).reshape(1, 12)
    out = hdf5._Out()
    leaves = []
    for half in (0, 6):
        keys = b""
        for a in (half, half + 3):
            block = x[:, a : a + 3].tobytes()
            packed = zlib.compress(np.frombuffer(block, np.uint8).reshape(-1, 4).T.tobytes())
            keys += struct.pack("<IIQQQQ", len(packed), 0, 0, a, 0, out.put(packed))
        leaves.append((half, out.put(b"TREE" + struct.pack("<BBHQQ", 1, 0, 2, hdf5.NOWHERE, hdf5.NOWHERE) + keys)))
    inner = b"".join(struct.pack("<IIQQQQ", 0, 0, 0, a, 0, at) for a, at in leaves)
    top = out.put(b"TREE" + struct.pack("<BBHQQ", 1, 1, 2, hdf5.NOWHERE, hdf5.NOWHERE) + inner)
    filters = hdf5._message(hdf5.FILTERS, struct.pack("<BB6xHHHHIIHHHHII", 1, 2, hdf5.SHUFFLE, 0, 1, 1, 4, 0, hdf5.DEFLATE, 0, 1, 1, 6, 0))
    space = hdf5._message(hdf5.SPACE, struct.pack("<BBBx4xQQ", 1, 2, 0, 1, 12))
    layout = hdf5._message(hdf5.LAYOUT, struct.pack("<BBBQIII", 3, 2, 3, top, 1, 3, 4))
    header = out.put(hdf5._header(space, hdf5._message(hdf5.TYPE, hdf5._type(np.dtype("<i4"))), layout, filters))
    data = b"".join(out.parts)
    found = hdf5._dataset(lambda at, n: data[at : at + n], header)
    assert (hdf5.rows_of(lambda at, n: data[at : at + n], found, 2, 11)[:, 0] == np.arange(2, 11)).all()


def test_struct_fields_of_every_kind(tmp_path):
    fields = {"text": TEXT, "v": np.arange(5.0), "m": np.arange(10, dtype=np.int16).reshape(5, 2), "u": np.arange(5, dtype=np.uint8)}
    back = mat5.columns(mat5.written("rec", fields), "rec")
    assert back["text"] == TEXT and all((back[k] == fields[k]).all() and back[k].dtype == fields[k].dtype for k in "vmu")
    # a matrix of characters, not deflated, and numbers stored more narrowly than their class
    chars = mat5._matrix(mat5.CHAR, (2, 3), "", mat5._element(mat5.UINT16, np.frombuffer(b"adbecf", np.uint8).astype("<u2").tobytes()))
    narrow = mat5._matrix(6, (2, 1), "", struct.pack("<HH4s", 2, 2, bytes([7, 9, 0, 0])))
    names = mat5._element(1, b"text\0\0\0\0num\0\0\0\0\0")
    whole = b"x".ljust(116) + b"\0" * 8 + b"\0\1IM" + mat5._matrix(mat5.STRUCT, (1, 1), "rec", struct.pack("<HHi", 5, 4, 8), names, chars, narrow)
    found = mat5.columns(whole, "rec")
    assert found["text"] == ["abc", "def"] and found["num"].tolist() == [7.0, 9.0]
    with pytest.raises(KeyError):
        mat5.columns(whole, "other")


def test_a_field_of_one_entry_holds_for_all_rows(spark, tmp_path):
    records.use(spark)
    (tmp_path / "a.h5").write_bytes(hdf5.written("syn", {"count": np.array([3.0]), "group": np.array([1.0, 2.0, 0.0]), "name": np.frombuffer(b"a b c ", np.uint8).reshape(3, 2)}))
    got = spark.read.format("records").option("group", "syn").load(str(tmp_path)).orderBy("name").collect()
    assert [(r["count"], r["group"], r["name"]) for r in got] == [(3.0, 1.0, "a"), (3.0, 2.0, "b"), (3.0, 0.0, "c")]
    with pytest.raises(Exception, match="state a schema"):
        spark.read.format("records").load(str(tmp_path / "none"))
