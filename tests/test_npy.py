"""Matrices written by row ranges and read back by the source and by numpy."""

import glob

import numpy as np
import pytest
from pyspark.sql import functions as F

from assaylake.sources import npy


def frame(spark, x, parts=5):
    return spark.createDataFrame([(k, [float(v) for v in row]) for k, row in enumerate(x)], "ord bigint, values array<double>").repartition(parts)


def test_rows_are_written_to_their_places(spark, tmp_path, monkeypatch):
    x = np.random.default_rng(1).normal(size=(200, 7)).astype(np.float32)
    path = f"file://{tmp_path}/sub/m.npy"
    npy.write(frame(spark, x), path, 200, 7)
    assert np.array_equal(np.load(tmp_path / "sub/m.npy"), x) and not glob.glob(f"{tmp_path}/sub/*.part")
    back = spark.read.format("npy").option("path", path).load()
    assert np.array_equal(np.array([r["values"] for r in back.orderBy("ord").collect()], np.float32), x)
    npy.write(frame(spark, x + 1), path, 200, 7, reuse="true")  # same size and header: kept
    assert np.array_equal(np.load(tmp_path / "sub/m.npy"), x)
    npy.write(frame(spark, x + 1), path, 200, 7)
    assert np.array_equal(np.load(tmp_path / "sub/m.npy"), x + 1)


@pytest.mark.parametrize(("change", "message"), [
    (lambda df: df.filter("ord <> 3"), "not each place once"), (lambda df: df.withColumn("ord", F.when(F.col("ord") == 3, 4).otherwise(F.col("ord"))), "not each place once"), (lambda df: df.withColumn("ord", F.col("ord") + 1), "not among"),
    (lambda df: df.withColumn("values", F.when(F.col("ord") == 3, F.slice("values", 1, 2)).otherwise(F.col("values"))), "has not"),
    (lambda df: df.withColumn("values", F.when(F.col("ord") == 3, F.array(*[F.lit(float("nan"))] * 3)).otherwise(F.col("values"))), "not finite"),
])
def test_a_failed_write_leaves_what_was_there(spark, tmp_path, change, message):
    x = np.arange(30, dtype=np.float32).reshape(10, 3)
    path = f"file://{tmp_path}/m.npy"
    npy.write(frame(spark, x), path, 10, 3)
    with pytest.raises(Exception, match=message):
        npy.write(change(frame(spark, x + 5)), path, 10, 3)
    assert np.array_equal(np.load(tmp_path / "m.npy"), x) and not glob.glob(f"{tmp_path}/*.part")


def test_a_repeated_attempt_writes_the_same(tmp_path):
    import pyarrow as pa

    x = np.arange(12, dtype=np.float32).reshape(4, 3)
    writer = npy.NpyWriter({"path": f"file://{tmp_path}/m.npy", "rows": "4", "columns": "3"})
    batch = lambda at: pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array([x[k].tolist() for k in at], pa.list_(pa.float32()))], names=["ord", "values"])
    writer.write(iter([batch([2, 0])]))  # an attempt that is lost
    messages = [writer.write(iter([batch([2, 0])])), writer.write(iter([batch([3]), batch([1])]))]
    writer.commit(messages)
    assert np.array_equal(np.load(tmp_path / "m.npy"), x)
