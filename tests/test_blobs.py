"""The blob store: round trips, failed writes, deletes."""

import os

import pytest
from pyspark.sql import functions as F

from vellumflow.sources import blobs


def stored(spark, path):
    return sorted((r.name, bytes(r.content)) for r in blobs.load(spark, path).collect())


def test_round_trip(spark, tmp_path):
    path = f"file://{tmp_path}/s"
    assert stored(spark, path) == []
    names = ["a/b.html", "../../etc/x", "é ü", "日本", "%41", "A", ".", "x" * 60]
    rows = [(n, n.encode() * 3) for n in names] + [("empty", None), ("zero", b"")]
    blobs.store(spark.createDataFrame(rows, "name string, content binary").repartition(4), path)
    assert stored(spark, path) == sorted((n, c or b"") for n, c in rows)
    assert not os.path.exists(f"{tmp_path}/etc")
    blobs.store(spark.createDataFrame([("A", b"newer"), ("B", b"b")], "name string, content binary"), path)
    assert dict(stored(spark, path))["A"] == b"newer" and len(stored(spark, path)) == len(rows) + 1
    assert blobs.delete(spark.createDataFrame([("A",), ("nobody",), (None,), ("B",)], "name string"), path) == 2
    assert {"A", "B"}.isdisjoint(dict(stored(spark, path)))
    blobs.store(spark.createDataFrame([("only", b"1")], "name string, content binary"), path, "overwrite")
    assert stored(spark, path) == [("only", b"1")]


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    path = f"file://{tmp_path}/s"
    blobs.store(spark.createDataFrame([("a", b"1")], "name string, content binary"), path)
    bad = spark.range(20).select(F.when(F.col("id") < 19, F.concat(F.lit("n"), "id")).alias("name"), F.lit(b"x").alias("content"))
    with pytest.raises(Exception, match="name"):
        blobs.store(bad.repartition(4), path)
    assert stored(spark, path) == [("a", b"1")] and len(os.listdir(f"{tmp_path}/s/data")) == 1
