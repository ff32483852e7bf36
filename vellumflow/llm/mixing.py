"""Mixing sources to target weights by systematic sampling.

Each source gets a target by water filling over its weight. Within a source every document expects the same number of
copies, target / size; documents stand in the order of their size, expected copies are summed along that order, one
offset per source is added, and a document is emitted once for every integer that its stretch of the sum crosses. With
documents in the order of size, every stretch of the order gives its share of words, so the taken words come near the
target whatever the sizes are.

Ranks within a source need no task that holds the source: rows are counted by (source, size band, slice), the small
table of counts is summed along each source, and only rows of one slice are numbered together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellumflow.llm.shared import cut, unused, words_of

MOST = 3  # a target is at most so many times its source's size
CYCLE = 3  # weights 1, 2, 3, repeating
BANDS = 8  # size bands for each doubling of the size
SLICES = 64  # of each band of a source; fixed, so that a mix does not depend on the cluster


def targets(sizes: DataFrame, most: int = MOST, cycle: int = CYCLE) -> DataFrame:
    """source, source_size, docs, target: one row per source.

    Sources come by code point, null last. Water filling has a closed form: in the order of (limit / weight) the sources
    that reach their limit come first, and the rest share what is left by weight.
    The window without a partition sees one row per source, never documents.
    """
    order = Window.orderBy(F.asc_nulls_last("source"))
    weighed = sizes.withColumn("weight", (F.row_number().over(order) - 1) % cycle + 1).withColumn("limit", F.col("source_size") * most)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_ratio = Window.orderBy(F.col("limit") / F.col("weight"), F.asc_nulls_last("source"))
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    # level: the words per unit of weight if this source is the first that stays below its limit
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum("limit").over(before), F.lit(0))) / F.sum("weight").over(after)
    ranked = weighed.withColumn("level", level).withColumn("free", F.col("level") * F.col("weight") <= F.col("limit"))
    shared = F.min(F.when(F.col("free"), F.struct(F.col("limit") / F.col("weight"), F.col("level").alias("level")))).over(every)["level"]
    return ranked.withColumn("shared", shared).select(
        "source", "source_size", "docs",
        F.least(F.col("limit").cast("double"), F.coalesce(F.col("shared") * F.col("weight"), F.col("limit").cast("double"))).alias("target"),
    )


def _cells(rows: DataFrame, size: str, id_col: str, slices: int, names: dict[str, str]) -> DataFrame:
    """Adds the size band and the slice of each row, under the names given."""
    band = F.floor(F.log2(F.col(size) + 1) * BANDS).cast("int")
    part = F.pmod(F.xxhash64(size, id_col), F.lit(slices)).cast("int")
    return rows.withColumns({names["band"]: band, names["slice"]: part})


def _with_copies(rows: DataFrame, counted: DataFrame, id_col: str, source_col: str, names: dict[str, str], most: int, seed: int) -> DataFrame:
    """Adds source_size, target and copies. counted: the same rows' source, size, band and slice, for the counts."""
    counts = counted.groupBy("source", "band", "slice").agg(F.count(F.lit(1)).alias("cell_rows"), F.sum("size").alias("cell_size"))
    per_source = targets(counts.groupBy("source").agg(F.sum("cell_size").alias("source_size"), F.sum("cell_rows").alias("docs")), most)
    ahead = Window.partitionBy("source").orderBy("band", "slice").rowsBetween(Window.unboundedPreceding, -1)
    # offset: one number in [0, 1) per source, a multiple of 2^-20, so that sums of whole ratios stay exact
    offset = F.pmod(F.xxhash64(F.coalesce("source", F.lit("")), F.col("source").isNull(), F.lit(seed)), F.lit(1 << 20)) / float(1 << 20)
    cells = (
        counts.withColumn("ahead", F.coalesce(F.sum("cell_rows").over(ahead), F.lit(0)))
        .join(per_source.withColumnRenamed("source", "of_source"), F.col("source").eqNullSafe(F.col("of_source")))
        .select(*[F.col(c).alias(f"{names['cell']}_{c}") for c in ("source", "band", "slice", "ahead", "source_size", "target")], offset.alias(f"{names['cell']}_offset"))
    )
    cell = lambda c: F.col(f"{names['cell']}_{c}")
    order = Window.partitionBy(source_col, names["band"], names["slice"]).orderBy(names["size"], F.asc_nulls_last(id_col))
    ranked = rows.withColumn(names["rank"], F.row_number().over(order))
    same = F.col(source_col).eqNullSafe(cell("source")) & (F.col(names["band"]) == cell("band")) & (F.col(names["slice"]) == cell("slice"))
    last = cell("ahead") + F.col(names["rank"])
    each = F.when(cell("source_size") > 0, cell("target") / cell("source_size")).otherwise(F.lit(0.0))
    copies = F.floor(last * each + cell("offset")) - F.floor((last - 1) * each + cell("offset"))
    joined = ranked.join(cells, same)
    return joined.withColumns({names["source_size"]: cell("source_size"), names["target"]: cell("target"), names["copies"]: F.greatest(copies, F.lit(0)).cast("long")})


_PLAIN = {c: c for c in ("size", "band", "slice", "cell", "rank", "source_size", "target", "copies")}


def _sizes(docs: DataFrame, id_col: str, text_col: str, source_col: str, slices: int) -> DataFrame:
    """doc_id, source, size, band, slice of all rows, cut: texts are counted once however often the sizes are read."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), words_of(F.col(text_col)).alias("size"))
    return cut(_cells(rows, "size", "doc_id", slices, _PLAIN), "sizes")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", most: int = MOST, seed: int = 1, slices: int | None = None) -> DataFrame:
    """doc_id, size, source, source_size, target, copies: one row per input row, also where copies is 0.

    Null texts have size 0; a source without words has target 0 and takes nothing; null sources are one source of their
    own. Rows that repeat an id count each for themselves. Reruns agree: ranks depend on values only (equal rows are
    interchangeable) and the offset on source and seed. An empty table gives no rows; other columns are ignored.
    """
    slices = slices or SLICES
    rows = _sizes(docs, id_col, text_col, source_col, slices)
    return _with_copies(rows, rows, "doc_id", "source", _PLAIN, most, seed).select("doc_id", "size", "source", "source_size", "target", "copies")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", most: int = MOST, seed: int = 1, slices: int | None = None) -> DataFrame:
    """The rows that the mix takes, each as often as mix() gives it copies, all columns as they came."""
    slices = slices or SLICES
    names = {c: unused(docs, f"mix_{c}") for c in _PLAIN}
    counted = _sizes(docs, id_col, text_col, source_col, slices)
    rows = _cells(docs.withColumn(names["size"], words_of(F.col(text_col))), names["size"], id_col, slices, names)
    taken = _with_copies(rows, counted, id_col, source_col, names, most, seed).where(F.col(names["copies"]) > 0)
    return taken.withColumn(names["rank"], F.explode(F.sequence(F.lit(1), F.col(names["copies"]).cast("int")))).select(*docs.columns)
