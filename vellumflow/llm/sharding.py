"""Sharding by a Feistel permutation over global row numbers.

Rows get gapless numbers that depend on their values only. A balanced Feistel network permutes the smallest even-bit
domain that holds all numbers; a number that leaves the table walks the cycle until it is back inside. Shard and slot are
arithmetic on the permuted number, and can be computed, and undone, for any row number without a table.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROUNDS = 6
BUCKETS = 4096  # of the numbering; fixed, so that numbers do not depend on the cluster
LAW = "rows"


def _domain(n: int) -> tuple[int, int]:
    """Bits of half the domain, the smallest b with 2^(2b) >= n, and the mask of one half."""
    bits = max(1, ((max(n, 2) - 1).bit_length() + 1) // 2)
    return bits, (1 << bits) - 1


def _round(half: np.ndarray, seed: int, k: int, mask: int) -> np.ndarray:
    """Round function: a multiply-xorshift mixer keyed by seed and round."""
    x = half + np.uint64((seed * 0x9E3779B97F4A7C15 + (k + 1) * 0xD1B54A32D192ED03) % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(31))) & np.uint64(mask)


def _walk(numbers: np.ndarray, n: int, once) -> np.ndarray:
    """Apply a permutation of the domain until every number lies in the table."""
    out = once(numbers.astype(np.uint64))
    outside = np.flatnonzero(out >= n)
    while outside.size:
        out[outside] = once(out[outside])
        outside = outside[out[outside] >= n]
    return out.astype(np.int64)


def permute(numbers: np.ndarray, n: int, seed: int) -> np.ndarray:
    """Positions of row numbers 0 .. n - 1 under the permutation."""
    bits, mask = _domain(n)

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(bits), x & np.uint64(mask)
        for k in range(ROUNDS):
            left, right = right, left ^ _round(right, seed, k, mask)
        return (left << np.uint64(bits)) | right

    return _walk(np.asarray(numbers), n, once)


def unpermute(positions: np.ndarray, n: int, seed: int) -> np.ndarray:
    """The row numbers at these positions: the rounds backwards."""
    bits, mask = _domain(n)

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(bits), x & np.uint64(mask)
        for k in reversed(range(ROUNDS)):
            left, right = right ^ _round(left, seed, k, mask), left
        return (left << np.uint64(bits)) | right

    return _walk(np.asarray(positions), n, once)


def number_rows(df: DataFrame, by: list[str], name: str = "row_number", buckets: int = BUCKETS) -> DataFrame:
    """Gapless numbers from 0, a function of the columns in by alone (rows equal in all of them are interchangeable).

    Rows are dealt to buckets by a hash of all of by, buckets are counted and their counts summed up (one row each), and
    rows are numbered within their bucket. No task sees more than one bucket's rows at a time, whatever values repeat.
    """
    marked = df.withColumn("_bucket", F.pmod(F.xxhash64(*by), F.lit(buckets)).cast("int"))
    counts = marked.groupBy("_bucket").count()
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col("_bucket").alias("_start_of"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy("_bucket").orderBy(*[F.asc_nulls_last(c) for c in by])) - 1
    # starts has one row per bucket, so it is small at any size of the table
    return marked.withColumn("_inside", inside).join(F.broadcast(starts), F.col("_bucket") == F.col("_start_of")).withColumn(name, F.col("_start") + F.col("_inside")).drop("_bucket", "_start_of", "_start", "_inside")


def position(number: Column, n: int, seed: int) -> Column:
    """Column of permuted row numbers."""

    @F.pandas_udf("long")
    def at(numbers: pd.Series) -> pd.Series:
        return pd.Series(permute(numbers.to_numpy(), n, seed))

    return at(number)


def shard(docs: DataFrame, shards: int = 8, seed: int = 20240229, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, row_number, position, shard, slot: one row per input row.

    Shard counts differ by one at most, and slots of a shard run from 0 without gaps. Size is the text's bytes in UTF-8
    plus 1; a null text has none, and the CRC of the empty string. Null and repeated ids are numbered like any others. An
    empty table gives no rows. Other columns are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    slim = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))
    n = docs.count()
    numbered = number_rows(slim, ["doc_id", "size", "text_crc32"])
    placed = numbered.withColumn("position", position(F.col("row_number"), n, seed))
    return placed.withColumn("shard", (F.col("position") % shards).cast("int")).withColumn("slot", F.expr(f"position div {shards}").cast("long"))
