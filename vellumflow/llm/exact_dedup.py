"""Exact deduplication by a content sort.

Sampled splitters range-partition the normalised text, each partition is sorted externally so that equal texts lie
side by side, and neighbouring rows are compared in full. One exchange carries the text.

A text that a large part of a partition's rows share cannot be split by ranges of the text alone. A sample shows such texts
(a few for each partition at most); their rows get a salt as second sort key, so splitters may fall inside the run, and the few
rows that sum up the salted runs are put together afterwards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellumflow.llm.shared import SPACE, cut, unused

#: A text counts as hot from this share of the sampled rows on, and in any case if it has a quarter of what a partition holds.
HOT_SHARE = 0.005
PARTITION_SHARE = 0.25
SAMPLE = 0.05
SALTS = 64
HEAD = 64  # characters that splitters look at


def normalised(text: Column) -> Column:
    """The text without the characters of SPACE; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE + "+", "")


def hot_hashes(docs: DataFrame, text: str = "text", sample: float = SAMPLE) -> list[int]:
    """Hashes of texts that hold more than a share of the sampled rows: at most 1 / share values. Only a hint for the layout."""
    share = min(HOT_SHARE, PARTITION_SHARE / int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    seen = docs.sample(fraction=sample, seed=7).select(F.xxhash64(normalised(F.col(text))).alias("h")).groupBy("h").count()
    total = seen.agg(F.sum("count")).first()[0] or 0
    if total < 100:
        return []
    return [r.h for r in seen.where(F.col("count") > share * total).select("h").collect()]


def content_sort(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical without white space. Of equal texts the row with the most code points in the original
    text stays, then the smallest id; a null id comes last. Null texts count as empty, so all null, empty and blank texts
    are one group. Of rows that repeat id and text one is kept. Other columns are ignored; an empty table gives no rows.
    """
    hot = hot_hashes(docs, text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), normalised(F.col(text_col)).alias("norm"), F.coalesce(F.char_length(F.col(text_col)), F.lit(0)).alias("n"))
    rows = rows.withColumn("head", F.substring("norm", 1, HEAD)).withColumn("hash", F.xxhash64("norm"))
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(salts))
    rows = rows.withColumn("salt", F.when(F.col("hash").isin(hot), salt + 1).otherwise(0) if hot else F.lit(0))
    # Splitters go by the head of the text, then by its hash: short keys, however long the texts are. The window keeps
    # equal (head, hash, salt) together, which the ranges already give, so there is no second exchange; the text itself
    # is compared in full between neighbours.
    ranges = ["head", "hash", "salt"] if hot else ["head", "hash"]
    run = Window.partitionBy(*ranges, "norm")
    first = run.orderBy(F.desc("n"), F.asc_nulls_last("doc_id"))
    ranged = rows.repartitionByRange(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), *ranges)
    runs = ranged.select(
        "doc_id", "salt", "n",
        F.sha2(F.encode("norm", "UTF-8"), 256).alias("text_sha256"),
        F.first("doc_id").over(first).alias("run_keep"),
        F.first("n").over(first).alias("run_n"),
        F.count(F.lit(1)).over(run).alias("run_size"),
        (F.row_number().over(first) == 1).alias("leads"),
    )
    if not hot:
        return runs.select("doc_id", F.col("run_keep").alias("keep_id"), F.col("run_size").alias("group_size"), F.col("leads").alias("kept"), "text_sha256")
    runs = cut(runs, "content-sort")
    # One row per hot text, of which there are a few for each partition, so it may be broadcast.
    whole = (
        runs.where((F.col("salt") > 0) & F.col("leads"))
        .groupBy(F.col("text_sha256").alias("hot_sha256"))
        .agg(F.min(F.struct(-F.col("run_n"), F.col("run_keep").isNull(), F.col("run_keep"))).alias("best"), F.sum("run_size").alias("whole_size"))
        .select("hot_sha256", F.col("best.run_keep").alias("whole_keep"), "whole_size")
    )
    joined = runs.join(F.broadcast(whole), runs.text_sha256 == whole.hot_sha256, "left")
    is_hot = F.col("hot_sha256").isNotNull()
    keep = F.when(is_hot, F.col("whole_keep")).otherwise(F.col("run_keep"))
    return joined.select(
        "doc_id",
        keep.alias("keep_id"),
        F.when(is_hot, F.col("whole_size")).otherwise(F.col("run_size")).alias("group_size"),
        (F.col("leads") & F.col("doc_id").eqNullSafe(keep)).alias("kept"),
        "text_sha256",
    )


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, all columns as they came; the same choice as content_sort() makes.

    Rows travel whole, once; the normalised text is made again behind the exchange. Of rows that repeat id and text one
    stays, by an arbitrary but valid choice if they differ in other columns.
    """
    hot = hot_hashes(docs, text_col)
    head, digest, salt, norm, n, place = (unused(docs, c) for c in ("head", "digest", "salt", "norm", "n", "place"))
    rows = docs.withColumns({head: F.substring(normalised(F.col(text_col)), 1, HEAD), digest: F.xxhash64(normalised(F.col(text_col)))})
    salted = F.pmod(F.xxhash64(id_col), F.lit(SALTS)) + 1
    rows = rows.withColumn(salt, F.when(F.col(digest).isin(hot), salted).otherwise(0) if hot else F.lit(0))
    ranges = [head, digest, salt] if hot else [head, digest]
    ranged = rows.repartitionByRange(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), *ranges)
    ranged = ranged.withColumns({norm: normalised(F.col(text_col)), n: F.coalesce(F.char_length(F.col(text_col)), F.lit(0))})
    order = [F.desc(n), F.asc_nulls_last(id_col)]
    leaders = ranged.withColumn(place, F.row_number().over(Window.partitionBy(*ranges, norm).orderBy(*order))).where(F.col(place) == 1)
    if not hot:
        return leaders.select(*docs.columns)
    leaders = cut(leaders.drop(place), "leaders")
    # a hot text has one leader for each salt
    first = leaders.where(F.col(salt) > 0).withColumn(place, F.row_number().over(Window.partitionBy(norm).orderBy(*order))).where(F.col(place) == 1)
    return leaders.where(F.col(salt) == 0).select(*docs.columns).unionByName(first.select(*docs.columns))
