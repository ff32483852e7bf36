"""Joins, groupings and rankings over documents, field rows and runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellumflow.functions import model as M
from vellumflow.functions import values as V
from vellumflow.functions.text import fold


def unused(df: DataFrame, name: str) -> str:
    """A column name that the frame does not have yet."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name = f"_{name}"
    return name


# -- statistics ------------------------------------------------------------------------------------------------------------


def statistics(docs: DataFrame) -> DataFrame:
    """One row of counts and bytes; 0 where there is nothing. Containers count only for review, derived files carry no bytes."""
    counted = ~F.col("is_container")
    per = [F.count_if(counted & (F.col("lifecycle_status") == code)).alias(name) for code, name in ((M.UPLOADED, "uploaded"), (M.PROCESSING, "processing"), (M.PENDING_REVIEW, "pending_review"), (M.READY, "ready"), (M.FAILED, "failed"))]
    attention = (F.col("review_reasons") != 0) & (F.col("review_disposition") != M.REJECTED)
    size = F.when(counted & F.col("origin_document_id").isNull(), F.col("file_size"))
    return docs.agg(F.count_if(counted).alias("total"), *per, F.count_if(attention).alias("needs_review"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes"))


def prompt_budget(definitions: DataFrame, prompt: Column, budget: int = M.PROMPT_BUDGET) -> DataFrame:
    """Characters of the prompts of each type that are not blank, and whether they fit the budget."""
    used = F.coalesce(F.sum(F.when(F.trim(prompt) != "", F.char_length(prompt))), F.lit(0))
    return definitions.groupBy("document_type_id").agg(used.alias("chars")).withColumn("fits", F.col("chars") <= budget)


# -- joins ---------------------------------------------------------------------------------------------------------------------


def missing_required(docs: DataFrame, fields: DataFrame, definitions: DataFrame) -> DataFrame:
    """(id, name) of live required fields that a typed document has no value for. Definitions are a small table by nature and joined by type."""
    needed = definitions.where("is_required AND NOT is_deleted").select("document_type_id", F.col("id").alias("field_definition_id"), "name")
    wanted = docs.select("id", "document_type_id").join(needed, "document_type_id")
    have = fields.select(F.col("document_id").alias("id"), "field_definition_id")
    return wanted.join(have, ["id", "field_definition_id"], "left_anti").select("id", "name")


def fingerprints(docs: DataFrame, fields: DataFrame, definitions: DataFrame) -> DataFrame:
    """id, fingerprint: sha256 over the canonical values of the type's unique-key fields.

    A field is written as 'definition=value', further values behind 0x1F each, and ends with 0x1E; fields come by
    definition, values by order. Texts are folded and lower-cased, numbers keep all digits. Null if the type has no such
    field, or if one of them has no value or a value that is blank or of another type than the field's.
    """
    keys = definitions.where("is_unique_key AND NOT is_deleted").select("document_type_id", F.col("id").alias("field_definition_id"), "data_type")
    needed = keys.groupBy("document_type_id").agg(F.count(F.lit(1)).alias("needed"))
    folded = lambda c: F.nullif(F.lower(fold(F.col(c))), F.lit(""))
    kind = F.col("data_type")
    canonical = (
        F.when(kind == "Text", folded("text_value"))
        .when(kind == "LongText", folded("long_text_value"))
        .when(kind == "Number", V.full_number(F.col("number_value")))
        .when(kind == "Boolean", F.when(F.col("boolean_value"), "true").when(~F.col("boolean_value"), "false"))
        .when(kind == "Date", F.date_format("date_value", "yyyy-MM-dd"))
        .when(kind == "DateTime", F.date_format("datetime_value", "yyyy-MM-dd'T'HH:mm:ss"))
    )
    valued = fields.join(keys.select("field_definition_id", "data_type"), "field_definition_id").select("document_id", "field_definition_id", "order_no", canonical.alias("value"))
    each = valued.groupBy("document_id", "field_definition_id").agg(F.array_sort(F.collect_list(F.struct("order_no", "value"))).alias("list"), F.bool_and(F.col("value").isNotNull()).alias("whole"))
    part = F.concat(F.col("field_definition_id").cast("string"), F.lit("="), F.array_join(F.transform("list", lambda v: v["value"]), "\x1f"), F.lit("\x1e"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("field_definition_id", part.alias("part")))), lambda p: p["part"]), "")
    whole = each.groupBy(F.col("document_id").alias("id")).agg(F.count_if("whole").alias("have"), joined.alias("joined"))
    rows = docs.select("id", "document_type_id").join(needed, "document_type_id", "left").join(whole, "id", "left")
    return rows.select("id", F.when(F.col("have") == F.col("needed"), F.sha2(F.col("joined"), 256)).alias("fingerprint"))


def duplicate_basis(docs: DataFrame, document_type_id: int) -> DataFrame:
    """Documents of a type, deleted ones too, whose duplicates may have to be looked at again: with a fingerprint, or suspected before."""
    return docs.where((F.col("document_type_id") == document_type_id) & (F.col("fingerprint").isNotNull() | V.has(F.col("review_reasons"), M.DUPLICATE)))


def running_lines(pages: DataFrame, edge: int = 3, share: float = 0.5, least: int = 2) -> DataFrame:
    """document, band, line, pages: running headers and footers, from pages (document, page, lines: array of texts).

    A line counts if it stands among the first or last `edge` lines of a page and not only blank; digits are one '#', white
    space is folded, case ignored. It runs if at least max(least, ceil(share * pages)) pages of the document have it in the
    same band.
    """
    same = lambda t: F.lower(fold(F.regexp_replace(t, "[0-9\uff10-\uff19]+", "#")))
    band = lambda name, lines: F.transform(lines, lambda t: F.struct(F.lit(name).alias("band"), same(t).alias("line")))
    last = F.slice("lines", F.greatest(F.size("lines") - edge + 1, F.lit(1)), F.lit(edge))
    # one exchange, of pages by document: all groupings are within a document
    met = pages.select("document", "page", F.struct(F.slice("lines", 1, edge).alias("first"), last.alias("last")).alias("ends")).repartition("document")
    each = met.groupBy("document", "page").agg(F.collect_set("ends").alias("ends"))
    lines = F.flatten(F.transform("ends", lambda e: F.concat(band("top", e["first"]), band("bottom", e["last"]))))
    edges = each.select("document", "page", F.explode(F.array_distinct(lines)).alias("e")).select("document", "page", "e.*")
    counts = edges.where("line <> ''").groupBy("document", "band", "line").agg(F.count("page").alias("pages")).where(F.col("pages") >= least)
    of = met.groupBy("document").agg(F.count_distinct("page").alias("all_pages"))
    running = counts.join(of, "document").where(F.col("pages") >= F.ceil(F.col("all_pages") * share))
    return running.select("document", "band", "line", "pages")


def duplicate_candidates(docs: DataFrame, most: int = M.DUPLICATE_CANDIDATES) -> DataFrame:
    """id, candidate: other documents of the same tenant, type and fingerprint, the first by creation time and id.

    Documents are ranked in their group first, and only the first most + 1 are joined to all, so a large group of copies
    gives rows in proportion to its size.
    """
    key = ["tenant", "document_type_id", "fingerprint"]
    rows = docs.where("fingerprint IS NOT NULL AND document_type_id IS NOT NULL").select("id", F.coalesce("tenant_id", F.lit(-1)).alias("tenant"), "document_type_id", "fingerprint", "creation_time")
    ranked = rows.withColumn("place", F.row_number().over(Window.partitionBy(*key).orderBy("creation_time", "id")))
    first = ranked.where(F.col("place") <= most + 1).select(*key, F.col("id").alias("candidate"), F.col("place").alias("candidate_place"))
    # a document among the first ones skips itself, so the last of the first is one more for it
    own = F.col("place") <= most
    return ranked.join(first, key).where((F.col("id") != F.col("candidate")) & (F.col("candidate_place") <= F.when(own, most + 1).otherwise(most))).select("id", "candidate")


def current_values(fields: DataFrame, extracted: DataFrame, definitions: DataFrame) -> DataFrame:
    """Values whose definition is live, with the type and multiplicity they were extracted under (schema drift drops the others)."""
    now = definitions.where(~F.col("is_deleted")).select(F.col("id").alias("field_definition_id"), F.col("data_type").alias("now_type"), F.col("allow_multiple").alias("now_multiple"))
    then = extracted.select(F.col("id").alias("field_definition_id"), "data_type", "allow_multiple")
    return fields.join(now, "field_definition_id").join(then, "field_definition_id").where((F.col("now_type") == F.col("data_type")) & (F.col("now_multiple") == F.col("allow_multiple"))).select(*fields.columns)


# -- runs ------------------------------------------------------------------------------------------------------------------------


def latest_runs(runs: DataFrame) -> DataFrame:
    """The run with the highest attempt of each document and pipeline: a grouped maximum, with partial sums before the exchange."""
    return runs.groupBy("document_id", "pipeline").agg(F.max(F.struct("attempt", "status")).alias("last")).select("document_id", "pipeline", "last.attempt", "last.status")


def next_attempt(runs: DataFrame) -> DataFrame:
    return runs.groupBy("document_id", "pipeline").agg((F.coalesce(F.max("attempt"), F.lit(0)) + 1).alias("next_attempt"))


def derive_lifecycle(docs: DataFrame, runs: DataFrame) -> DataFrame:
    """id, derived status: failed, pending review, ready or processing, from the latest runs and the blocking reasons.

    Containers need no field extraction. A missing, pending, running or skipped run has not succeeded.
    """
    state = latest_runs(runs).groupBy(F.col("document_id").alias("id")).agg(*[F.max(F.when(F.col("pipeline") == p, F.col("status"))).alias(f"s{k}") for k, p in enumerate(M.PIPELINES)])
    rows = docs.join(state, "id", "left")
    used = [(F.col(f"s{k}"), F.lit(True) if p != "field-extraction" else ~F.col("is_container")) for k, p in enumerate(M.PIPELINES)]
    failed = F.greatest(*[F.when(u & (s == 90), 1).otherwise(0) for s, u in used]) == 1
    open_ = F.greatest(*[F.when(u & ~F.coalesce(s == 30, F.lit(False)), 1).otherwise(0) for s, u in used]) == 1
    status = F.when(failed, M.FAILED).when(V.blocking(F.col("review_reasons")), M.PENDING_REVIEW).when(~open_, M.READY).otherwise(M.PROCESSING)
    return rows.select("id", status.cast("long").alias("derived_status"))


def retry_verdict(status: Column) -> Column:
    """Whether a pipeline may be retried, by the status of its latest run."""
    return F.when(status.isNull(), "NeverRan").when(status.isin(10, 20), "InProgress").when(status.isin(30, 95), "NotRetryable").otherwise("Ok")


def first_per_key(rows: DataFrame, keys: list[str], place: str, cap: int | None = None, within: list[str] | None = None) -> DataFrame:
    """The first row of each key by place; with a cap at most so many rows within each group of `within`, in the order of place."""
    if cap is not None and not within:
        raise ValueError("a cap needs the columns of the group that it holds for")
    n = unused(rows, "_n")
    out = rows.withColumn(n, F.row_number().over(Window.partitionBy(*keys).orderBy(place))).where(F.col(n) == 1)
    if cap is not None:
        out = out.withColumn(n, F.row_number().over(Window.partitionBy(*within).orderBy(place))).where(F.col(n) <= cap)
    return out.drop(n)


def fill_forward(rows: DataFrame, column: str, keys: list[str], place: str) -> DataFrame:
    window = Window.partitionBy(*keys).orderBy(place).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn(column, F.last(column, ignorenulls=True).over(window))


def uncovered(rows: DataFrame, keys: list[str], start: str, stop: str) -> DataFrame:
    """keys, gap_start, gap_stop: stretches that no interval covers, between the first and the last. A running maximum of stops tells them."""
    window = Window.partitionBy(*keys).orderBy(start, stop).rowsBetween(Window.unboundedPreceding, -1)
    reach = unused(rows, "_reach")
    reached = rows.withColumn(reach, F.max(stop).over(window))
    return reached.where(F.col(start) > F.col(reach)).select(*keys, F.col(reach).alias("gap_start"), F.col(start).alias("gap_stop"))


# -- differences ------------------------------------------------------------------------------------------------------------------


def reconcile(existing: DataFrame, incoming: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, value, action: what to remove, update, keep or add so that existing becomes incoming."""
    old = existing.select(*keys, F.col(value).alias("_old"), F.lit(True).alias("_had"))
    new = incoming.select(*keys, F.col(value).alias("_new"), F.lit(True).alias("_has"))
    action = F.when(F.col("_has").isNull(), "Remove").when(F.col("_had").isNull(), "Add").when(F.col("_old").eqNullSafe(F.col("_new")), "Keep").otherwise("Update")
    return old.join(new, keys, "full_outer").select(*keys, F.coalesce("_new", "_old").alias(value), action.alias("action"))
