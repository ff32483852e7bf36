"""Bounded samples to fit classifiers on. The bound is a parameter of each operator; scoring never samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def smallest_hashes(rows: DataFrame, key: str, bound: int) -> DataFrame:
    """At most bound rows: those whose key has the smallest hashes, so a rerun takes the same."""
    return rows.orderBy(F.xxhash64(key), key).limit(bound)


def labelled(docs: DataFrame, labels: DataFrame, label: str, bound: int) -> DataFrame:
    """Documents of at most bound labelled rows, with their label as a long. Of repeated labels the largest counts, null labels don't.

    Of rows that repeat an id one is taken, by the smallest digest of its text, so there are at most bound rows.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).cast("long").alias("_label"))
    picked = smallest_hashes(known, "doc_id", bound).withColumnRenamed("doc_id", "_label_of")  # bounded, so it may be broadcast
    found = docs.join(F.broadcast(picked), F.col("doc_id") == F.col("_label_of")).drop("_label_of")
    digest = F.coalesce(F.sha2(F.encode("text", "UTF-8"), 256), F.lit(""))
    one = found.groupBy("doc_id").agg(F.min_by(F.struct(*(c for c in found.columns if c != "doc_id")), digest).alias("_row"))
    return one.select("doc_id", *(F.col("_row")[c].alias(c) for c in found.columns if c != "doc_id"))
