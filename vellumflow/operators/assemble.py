"""What goes out: list items, field maps, export tables and texts of tool answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumflow.functions import model as M
from vellumflow.functions import text as X
from vellumflow.functions import values as V


def field_map(fields: DataFrame, definitions: DataFrame) -> DataFrame:
    """id, fields: map of field name to JSON text. Several values give an array in order, single ones the value of the least order; values of unknown definitions are left out."""
    dims = definitions.select(F.col("id").alias("field_definition_id"), "name", "data_type", "allow_multiple")
    rows = fields.join(dims, "field_definition_id").withColumn("json", V.json_text(F.col("data_type")))
    # not a filter on json: that would spell each value twice
    valued = F.when(F.col("json").isNotNull(), F.struct("name", "order_no", "json", "allow_multiple"))
    found = rows.groupBy(F.col("document_id").alias("id")).agg(F.array_sort(F.collect_list(valued)).alias("found")).where("size(found) > 0")

    def entry(name: Column) -> Column:
        several = lambda own: F.concat(F.lit("["), F.array_join(F.transform(own, lambda v: v["json"]), ","), F.lit("]"))
        value = X.once(F.filter("found", lambda v: v["name"] == name), lambda own: F.when(own[0]["allow_multiple"], several(own)).otherwise(own[0]["json"]))
        return F.struct(name.alias("name"), value.alias("value"))

    # one grouping by document: a document has few fields, so their values are told apart inside its row
    return found.select("id", F.map_from_entries(F.transform(F.array_distinct(F.transform("found", lambda v: v["name"])), entry)).alias("fields"))


def list_items(docs: DataFrame, fields: DataFrame, definitions: DataFrame, types: DataFrame) -> DataFrame:
    """List rows with the type's code, also of deleted types, and the field map."""
    codes = types.select(F.col("id").alias("document_type_id"), "type_code")
    return docs.join(codes, "document_type_id", "left").join(field_map(fields, definitions), "id", "left").select("id", "title", "type_code", V.name_of(F.col("lifecycle_status"), M.LIFECYCLE).alias("lifecycle"), "fields")


def reason_details(docs: DataFrame, missing: DataFrame, candidates: DataFrame) -> DataFrame:
    """id, details: one text per set reason, in the order of the flags, with missing names and candidates; null without attention."""
    names = missing.groupBy("id").agg(F.array_join(F.array_sort(F.collect_list("name")), ", ").alias("names"))
    others = candidates.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("candidate")), lambda c: c.cast("string")), ", ").alias("others"))
    rows = docs.select("id", "review_reasons", "review_disposition").join(names, "id", "left").join(others, "id", "left")
    more = {M.MISSING_REQUIRED: F.col("names"), M.DUPLICATE: F.col("others")}
    texts = [F.when(V.has(F.col("review_reasons"), bit), F.concat(F.lit(name), F.coalesce(F.concat(F.lit(": "), more.get(bit, F.lit(None))), F.lit("")))) for bit, name in M.REASONS.items()]
    attention = (F.col("review_reasons") != 0) & (F.col("review_disposition") != M.REJECTED)
    return rows.select("id", F.when(attention, F.array_join(F.array_compact(F.array(*texts)), "; ")).alias("details"))


#: An element of a JSON array of single values.
_ITEM = r'"(?:[^"\\]++|\\.)*+"|[^\s,\[\]"]+'


def project_fields(fields: Column) -> Column:
    """A field map as tools show it: no nulls, texts in field tags with '<' escaped, alone and in arrays; no arrays without values, null if nothing is left."""
    tag = lambda t: F.concat(F.lit('"<field>'), F.replace(F.regexp_replace(t, r'^"|"$', ""), F.lit("<"), F.lit("&lt;")), F.lit('</field>"'))
    single = lambda v: F.when(v.startswith('"'), tag(v)).otherwise(v)
    items = lambda v: F.transform(F.filter(F.regexp_extract_all(v, F.lit(_ITEM), F.lit(0)), lambda t: t != "null"), single)
    several = lambda v: X.once(items(v), lambda found: F.when(F.size(found) > 0, F.concat(F.lit("["), F.array_join(found, ","), F.lit("]"))))
    shown = F.transform_values(fields, lambda k, v: F.when(v.startswith("["), several(v)).when(v != "null", single(v)))
    return X.once(F.map_filter(shown, lambda k, v: v.isNotNull()), lambda m: F.when(F.size(m) > 0, m))


# -- export ----------------------------------------------------------------------------------------------------------------------


def export_columns(definitions: DataFrame, type_id: int) -> list:
    """Live definitions of a type in display order; an error if there are more than an export may have."""
    from vellumflow.operators.search import QueryError

    rows = definitions.where((F.col("document_type_id") == type_id) & ~F.col("is_deleted")).orderBy("display_order", "name").limit(M.EXPORT_COLUMNS + 1).collect()
    if len(rows) > M.EXPORT_COLUMNS:
        raise QueryError("TooManyColumns", str(M.EXPORT_COLUMNS))
    return rows


def export_table(docs: DataFrame, fields: DataFrame, definitions: DataFrame, type_id: int, rows: int | None = M.EXPORT_ROWS) -> DataFrame:
    """Four system columns, then one text column per live definition, several values joined by '; '. More rows than allowed are an error; rows=None allows any number."""
    from vellumflow.operators.search import at_most

    columns = export_columns(definitions, type_id)
    docs = docs.where(F.col("document_type_id") == type_id)
    if rows is not None:
        docs = at_most(docs, rows, "TooManyRows")
    wanted = fields.where(F.col("field_definition_id").isin([c.id for c in columns])).withColumn("cell", V.cell_text()).where("cell IS NOT NULL")
    cells = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("order_no", "cell"))), lambda v: v["cell"]), "; ")
    # the list of values is known, so the pivot needs no pass to find it
    wide = wanted.groupBy("document_id").pivot("field_definition_id", [c.id for c in columns]).agg(cells)
    wide = wide.select(F.col("document_id").alias("id"), *[F.when(F.col(str(c.id)) != "", F.col(str(c.id))).alias(c.name) for c in columns])
    system = docs.select("id", "creation_time", V.name_of(F.col("lifecycle_status"), M.LIFECYCLE).alias("LifecycleStatus"), V.name_of(F.col("review_disposition"), M.DISPOSITION).alias("ReviewStatus"), V.flag_names(F.col("review_reasons")).alias("ReviewReasons"), F.col("title").alias("Title"))
    return system.join(wide, "id", "left")


#: White space of Unicode, that of (?U)\\s.
WHITE = "".join(c for c in map(chr, range(0x3001)) if c.isspace() and not "\x1c" <= c <= "\x1f")


def csv_cell(value: Column) -> Column:
    """A cell of the CSV export: formulas made harmless by an apostrophe, quoted where it must be, null as empty."""
    text = F.coalesce(value, F.lit(""))
    first = F.substr(text, F.lit(1), F.lit(1))
    inner = F.substr(F.regexp_replace(text, r"(?U)^\s+", ""), F.lit(1), F.lit(1))
    risky = first.isin("=", "+", "-", "@", "\t", "\r") | inner.isin("=", "+", "-", "@", "\t", "\r")
    safe = F.when(risky, F.concat(F.lit("'"), text)).otherwise(text)
    return F.when(safe.rlike('[,"\\n\\r]'), F.concat(F.lit('"'), F.replace(safe, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(safe)


def csv_lines(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One text per row, for write.text(): the header is csv_header()."""
    return rows.select(F.concat_ws(",", *[csv_cell(F.col(c).cast("string")) for c in columns]).alias("value"))


def csv_header(columns: list[str]) -> str:
    """Byte order mark and the header line."""
    def cell(name: str) -> str:
        name = "'" + name if name[:1] in tuple("=+-@\t\r") or name.lstrip(WHITE)[:1] in tuple("=+-@") else name
        return '"' + name.replace('"', '""') + '"' if any(c in name for c in ',"\n\r') else name

    return "﻿" + ",".join(cell(c) for c in columns)


def write_csv(rows: DataFrame, columns: list[str], path: str, order: list[str] | None = None) -> None:
    """Part files of one CSV export: the header file first, then the rows in order."""
    spark = rows.sparkSession
    lines = csv_lines(rows.orderBy(*order) if order else rows, columns)
    spark.createDataFrame([(csv_header(columns),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/header")
    lines.write.mode("overwrite").text(f"{path}/rows")


def resource_text(doc: dict[str, Column], body: Column, most: int = M.RESOURCE_CHARS) -> Column:
    """A document as a resource of a tool: a header of its metadata, then the body, cut, inside a boundary that it cannot leave.

    doc has id, type, lifecycle, language, created, cabinet, is_container and origin; of these type, language, cabinet and origin may
    be null and then have no line. A null body is empty. Cut bodies are announced in the header.
    """
    text = F.coalesce(body, F.lit(""))
    line = lambda name, value: F.coalesce(F.concat(F.lit(f"{name}: "), F.nullif(value.cast("string"), F.lit("")), F.lit("\n")), F.lit(""))
    when = lambda condition, *lines: F.when(condition, F.concat(*lines)).otherwise("")
    container, total = F.coalesce(doc["is_container"], F.lit(False)), F.char_length(text)
    return F.concat(
        F.lit("<!-- extract document metadata\n"),
        line("id", doc["id"]),
        line("type", doc["type"]),
        line("lifecycle", doc["lifecycle"]),
        line("language", doc["language"]),
        line("createdAt", F.concat(F.date_format(doc["created"], "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("0"))),
        line("cabinetId", doc["cabinet"]),
        line("isContainer", container),
        line("originDocumentId", doc["origin"]),
        when(container, F.lit(M.CONTAINER_NOTICE)),
        when(total > most, F.lit("markdownTruncated: true\nmarkdownTotalChars: "), total.cast("string"), F.lit("\n" + M.TRUNCATED_NOTICE)),
        F.lit(M.UNTRUSTED_NOTICE + "-->\n\n"),
        X.boundary(X.cut(text, most)),
    )


def pack_json(types: DataFrame, definitions: DataFrame) -> DataFrame:
    """type_code, pack: each type with its live fields as JSON, types by priority and code, fields by order and name."""
    live = definitions.where(~F.col("is_deleted"))
    field = F.struct("display_order", "name", "data_type", "is_required", "allow_multiple", "is_unique_key")
    grouped = live.groupBy(F.col("document_type_id").alias("id")).agg(F.array_sort(F.collect_list(field)).alias("fields"))
    return types.join(grouped, "id", "left").orderBy("priority", "type_code").select("type_code", F.to_json(F.struct(F.lit(1).alias("version"), "type_code", "display_name", "priority", "fields")).alias("pack"))


def import_actions(existing: DataFrame, incoming: DataFrame, key: str, update: bool) -> DataFrame:
    """key, action: Created, Updated or Skipped for each incoming row, by natural key; updates only if asked for."""
    have = existing.select(F.col(key).alias("_have")).distinct()
    found = incoming.join(have, F.col(key) == F.col("_have"), "left")
    return found.select(key, F.when(F.col("_have").isNull(), "Created").when(F.lit(update), "Updated").otherwise("Skipped").alias("action"))


# -- recycle bin -----------------------------------------------------------------------------------------------------------------


def restore_conflicts(docs: DataFrame) -> DataFrame:
    """id, conflict: for deleted documents, whether a live one of the same tenant has the same content, which forbids to restore it."""
    same = ["content_hash", "_tenant"]
    rows = docs.select("id", "is_deleted", "content_hash", F.coalesce("tenant_id", F.lit(-1)).alias("_tenant"))
    live = rows.where("NOT is_deleted AND content_hash IS NOT NULL").select(*same).distinct().withColumn("_live", F.lit(True))
    return rows.where("is_deleted").join(live, same, "left").select("id", F.coalesce("_live", F.lit(False)).alias("conflict"))


def hard_delete(docs: DataFrame, ids: DataFrame, id_col: str = "id") -> tuple[DataFrame, DataFrame]:
    """(documents that stay, contents to remove): deleted documents leave for good, and a content goes once no document has it any more.

    Only documents in the recycle bin are removed; other ids are left alone.
    """
    gone = docs.where("is_deleted").join(ids.select(F.col(id_col).alias("_gone")), F.col("id") == F.col("_gone"), "left_semi")
    stay = docs.join(gone.select(F.col("id").alias("_gone")), F.col("id") == F.col("_gone"), "left_anti")
    contents = gone.select("content_hash").where("content_hash IS NOT NULL").distinct()
    return stay, contents.join(stay.select(F.col("content_hash").alias("_used")), F.col("content_hash") == F.col("_used"), "left_anti")
