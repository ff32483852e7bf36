"""The document tables of the engine, derived from the given tables.

orders and customer give documents and their typed fields, events give pipeline runs and staged events, documents and
labels give classifications, conversations give bundles. VIEWS says the same as DuckDB text, for the oracles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

TYPES = ((1, "order.general", "General order", 0.7, 10), (2, "invoice.sales", "Sales invoice", 0.7, 20), (3, "contract.frame", "Frame contract", 0.7, 20))
#: n, name, data type, required, multiple, unique key, display order, deleted
FIELDS = (
    (1, "amount", "Number", True, False, False, 0, False),
    (2, "priority", "Text", False, False, False, 1, False),
    (3, "signed_on", "Date", False, False, False, 2, False),
    (4, "received_at", "DateTime", False, False, False, 3, False),
    (5, "urgent", "Boolean", False, False, True, 3, False),
    (6, "customer", "Text", True, False, True, 4, False),
    (7, "note", "LongText", False, False, False, 5, False),
    (8, "parts", "Text", False, True, False, 6, False),
    (9, "legacy", "Text", False, False, False, 7, True),
)

REQUIRED = tuple(f[0] for f in FIELDS if f[3])


def numbers_of(names) -> tuple[int, ...]:
    """Numbers of the fields with these names, so that a search reads no table that it does not ask about; of all fields if there are no names."""
    names = {n.strip().lower() for n in names if n}
    return tuple(f[0] for f in FIELDS if not names or f[1] in names)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    return orders.join(customer.select("c_custkey", "c_nationkey", "c_name"), F.col("o_custkey") == F.col("c_custkey"))


_CREATED = "o_orderdate + make_dt_interval(0, cast(o_orderkey % 24 as int), 0, 0)"
_TYPE = "case when o_orderkey % 20 = 7 then null else 1 + o_orderkey % 3 end"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, of every tenant, deleted ones too: scope() narrows them."""
    return _orders(spark, sf_dir).selectExpr(
        "o_orderkey AS id",
        "cast(nullif(c_nationkey % 3, 0) as bigint) AS tenant_id",
        "nullif(o_custkey % 5, 0) AS cabinet_id",
        f"{_TYPE} AS document_type_id",
        "cast(case when o_orderkey % 50 = 3 then 99 when o_orderkey % 50 = 4 then 10 when o_orderstatus = 'F' then 30 when o_orderstatus = 'O' then 20 else 25 end as bigint) AS lifecycle_status",
        "case when o_orderkey % 4 = 0 then (o_orderkey div 4) % 64 else 0 end AS review_reasons",
        "cast(case when o_orderkey % 13 = 0 then 30 when o_orderkey % 11 = 0 then 20 else 0 end as bigint) AS review_disposition",
        "o_orderkey % 17 = 0 AS is_deleted",
        "o_orderkey % 23 = 0 AS is_container",
        "case when o_orderkey % 10 = 1 and o_orderkey > 10 then o_orderkey - 1 end AS origin_document_id",
        f"{_CREATED} AS creation_time",
        "concat('Order ', o_orderkey) AS title",
        "case when o_orderkey % 10 = 1 and o_orderkey > 10 then null else cast(round(o_totalprice * 100) as bigint) end AS file_size",
        "sha2(concat('blob#', o_orderkey % 700), 256) AS content_hash",
    )


def fixed(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small table of given rows, whose size the planner knows: a join by one of its few keys is a broadcast, where a hash of the key would bring all rows into as many tasks."""
    fields = StructType.fromDDL(schema).fields
    built = [F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(row, fields, strict=True)]) for row in rows]
    return spark.range(0, 1, 1, 1).select(F.inline(F.array(*built)))


def document_types(spark: SparkSession) -> DataFrame:
    return fixed(spark, list(TYPES), "id long, type_code string, display_name string, threshold double, priority long")


def field_definitions(spark: SparkSession) -> DataFrame:
    rows = [(t[0] * 100 + f[0], t[0], *f[1:]) for t in TYPES for f in FIELDS]
    return fixed(spark, rows, "id long, document_type_id long, name string, data_type string, is_required boolean, allow_multiple boolean, is_unique_key boolean, display_order long, is_deleted boolean")


def extracted_fields(spark: SparkSession, sf_dir: str, numbers: tuple[int, ...] = tuple(f[0] for f in FIELDS)) -> DataFrame:
    """One row per value, one typed column per data type, of the fields with these numbers. Single values come from one scan, by exploding an array.

    Tables that none of the fields needs are not read.
    """

    def value(n: int, when: Column | None = None, **typed: Column) -> Column:
        kinds = {"text": "string", "long_text": "string", "number": "decimal(38,6)", "boolean": "boolean", "date": "date", "datetime": "timestamp_ntz"}
        row = F.struct(F.lit(n).alias("n"), *[typed.get(k, F.lit(None)).cast(t).alias(k) for k, t in kinds.items()])
        return row if when is None else F.when(when, row)

    key = F.col("o_orderkey")
    single = {
        1: value(1, number=F.col("o_totalprice").cast("decimal(38,6)")),
        2: value(2, text=F.col("o_orderpriority")),
        3: value(3, date=F.to_date("o_orderdate")),
        4: value(4, datetime=F.expr(_CREATED)),
        5: value(5, boolean=F.col("o_orderpriority").startswith("1-")),
        6: value(6, when=key % 9 != 0, text=F.col("c_name")),
        7: value(7, long_text=F.concat(F.lit("note for "), key)),
        9: value(9, when=key % 2 == 0, text=F.concat(F.lit("L"), key)),
    }
    rows = _orders(spark, sf_dir).withColumn("type", F.expr(_TYPE)).where("type IS NOT NULL")
    wanted = [s for n, s in single.items() if n in numbers]
    if not wanted:
        rows, wanted = rows.where("false"), [single[1]]
    ones = rows.withColumn("v", F.explode(F.array_compact(F.array(*wanted)))).select(key.alias("document_id"), (F.col("type") * 100 + F.col("v.n")).alias("field_definition_id"), F.lit(0).cast("long").alias("order_no"), *[F.col(f"v.{k}").alias(f"{k}_value") for k in ("text", "long_text", "number", "boolean", "date", "datetime")])
    if 8 not in numbers:
        return ones
    lines, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    along = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    parts = lines.withColumn("order_no", (F.row_number().over(along) - 1).cast("long")).join(part.select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey"))
    parts = parts.withColumn("type", F.expr(_TYPE.replace("o_orderkey", "l_orderkey"))).where("type IS NOT NULL").join(table(spark, sf_dir, "orders").select("o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"), "left_semi")
    many = parts.select(F.col("l_orderkey").alias("document_id"), (F.col("type") * 100 + 8).alias("field_definition_id"), "order_no", F.col("p_name").alias("text_value"))
    return ones.unionByName(many, allowMissingColumns=True)


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """document_id, pipeline, status, attempt, ts, event_id: every event is an attempt of one of three pipelines."""
    events = table(spark, sf_dir, "events")
    pipeline = F.element_at(F.array(*map(F.lit, ("text-extraction", "classification", "field-extraction"))), (F.col("event_id") % 3 + 1).cast("int"))
    status = F.when(F.col("event_type") == "error", 90).when(F.col("event_type") == "signup", 20).otherwise(30).cast("long")
    rows = events.select(F.col("user_id").alias("document_id"), pipeline.alias("pipeline"), status.alias("status"), "ts", "event_id")
    attempt = F.row_number().over(Window.partitionBy("document_id", "pipeline").orderBy("ts", "event_id")).cast("long")
    return rows.withColumn("attempt", attempt)


def staged_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with every seventh one delivered twice."""
    rows = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("document_id"), "event_type", F.col("ts").alias("event_time"))
    return rows.withColumn("times", F.explode(F.sequence(F.lit(1), F.when(F.col("event_id") % 7 == 0, 2).otherwise(1)))).drop("times")


def classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text, type_id, confidence: a decision for every document, by its labels."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    joined = docs.select("doc_id", "text").join(labels, "doc_id", "left")
    return joined.select("doc_id", "text", (1 + F.col("doc_id") % 3).alias("type_id"), F.coalesce(F.lit(0.5) + F.lit(0.4) * F.col("quality") - F.lit(0.3) * F.col("toxic"), F.lit(0.0)).alias("confidence"))


def bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, markdown, markers: array of (marker, is_sub_document), is_container: conversations as bundles to be sliced."""
    turns = table(spark, sf_dir, "conversations")
    marker = F.concat(F.lit("## Turn "), F.col("turn"))
    parts = F.array_sort(F.collect_list(F.struct("turn", marker.alias("marker"), (F.col("role") != "system").alias("is_sub_document"), F.concat(marker, F.lit("\n"), F.col("text")).alias("piece"))))
    grouped = turns.groupBy("conv_id").agg(parts.alias("parts"))
    return grouped.select("conv_id", F.array_join(F.transform("parts", lambda p: p["piece"]), "\n").alias("markdown"), F.transform("parts", lambda p: F.struct(p["marker"].alias("marker"), p["is_sub_document"].alias("is_sub_document"))).alias("markers"), (F.col("conv_id") % 2 == 0).alias("is_container"))


_FIELD_ROWS = ", ".join(f"({n}, '{name}', '{kind}', {req}, {multi}, {key}, {order}, {gone})" for n, name, kind, req, multi, key, order, gone in FIELDS).lower().replace("'number'", "'Number'").replace("'text'", "'Text'").replace("'date'", "'Date'").replace("'datetime'", "'DateTime'").replace("'boolean'", "'Boolean'").replace("'longtext'", "'LongText'")
_T = "CASE WHEN o_orderkey % 20 = 7 THEN NULL ELSE 1 + o_orderkey % 3 END"

#: DuckDB texts of the derived tables, by name; oracle() puts those in front that a query names.
VIEWS = {
    "d_base": f"SELECT *, {_T} AS type_id, o_orderdate + to_hours(CAST(o_orderkey % 24 AS INTEGER)) AS created FROM orders JOIN customer ON o_custkey = c_custkey",
    "d_documents": """SELECT o_orderkey AS id, CAST(nullif(c_nationkey % 3, 0) AS BIGINT) AS tenant_id, nullif(o_custkey % 5, 0) AS cabinet_id, type_id AS document_type_id,
        CAST(CASE WHEN o_orderkey % 50 = 3 THEN 99 WHEN o_orderkey % 50 = 4 THEN 10 WHEN o_orderstatus = 'F' THEN 30 WHEN o_orderstatus = 'O' THEN 20 ELSE 25 END AS BIGINT) AS lifecycle_status,
        CASE WHEN o_orderkey % 4 = 0 THEN (o_orderkey // 4) % 64 ELSE 0 END AS review_reasons,
        CAST(CASE WHEN o_orderkey % 13 = 0 THEN 30 WHEN o_orderkey % 11 = 0 THEN 20 ELSE 0 END AS BIGINT) AS review_disposition,
        o_orderkey % 17 = 0 AS is_deleted, o_orderkey % 23 = 0 AS is_container,
        CASE WHEN o_orderkey % 10 = 1 AND o_orderkey > 10 THEN o_orderkey - 1 END AS origin_document_id, created AS creation_time, 'Order ' || o_orderkey AS title,
        CASE WHEN o_orderkey % 10 = 1 AND o_orderkey > 10 THEN NULL ELSE CAST(round(o_totalprice * 100) AS BIGINT) END AS file_size,
        sha256('blob#' || (o_orderkey % 700)) AS content_hash FROM d_base""",
    "d_document_types": "SELECT CAST(id AS BIGINT) AS id, type_code, display_name, threshold, CAST(priority AS BIGINT) AS priority FROM (VALUES " + ", ".join(str(t) for t in TYPES) + ") v(id, type_code, display_name, threshold, priority)",
    "d_field_definitions": f"""SELECT CAST(t.id * 100 + f.n AS BIGINT) AS id, t.id AS document_type_id, f.name, f.data_type, f.is_required, f.allow_multiple, f.is_unique_key, CAST(f.display_order AS BIGINT) AS display_order, f.is_deleted
        FROM d_document_types t CROSS JOIN (VALUES {_FIELD_ROWS}) f(n, name, data_type, is_required, allow_multiple, is_unique_key, display_order, is_deleted)""",
    "d_lines": "SELECT l_orderkey, p_name, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 AS order_no FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_orderkey IN (SELECT o_orderkey FROM orders)",
    "d_extracted_fields": """SELECT o_orderkey AS document_id, type_id * 100 + n AS field_definition_id, CAST(order_no AS BIGINT) AS order_no, text_value, long_text_value, number_value, boolean_value, date_value, datetime_value FROM (
        SELECT o_orderkey, type_id, 1 AS n, 0 AS order_no, CAST(NULL AS VARCHAR) AS text_value, CAST(NULL AS VARCHAR) AS long_text_value, CAST(o_totalprice AS DECIMAL(38,6)) AS number_value, CAST(NULL AS BOOLEAN) AS boolean_value, CAST(NULL AS DATE) AS date_value, CAST(NULL AS TIMESTAMP) AS datetime_value FROM d_base
        UNION ALL SELECT o_orderkey, type_id, 2, 0, o_orderpriority, NULL, NULL, NULL, NULL, NULL FROM d_base
        UNION ALL SELECT o_orderkey, type_id, 3, 0, NULL, NULL, NULL, NULL, CAST(o_orderdate AS DATE), NULL FROM d_base
        UNION ALL SELECT o_orderkey, type_id, 4, 0, NULL, NULL, NULL, NULL, NULL, created FROM d_base
        UNION ALL SELECT o_orderkey, type_id, 5, 0, NULL, NULL, NULL, o_orderpriority LIKE '1-%', NULL, NULL FROM d_base
        UNION ALL SELECT o_orderkey, type_id, 6, 0, c_name, NULL, NULL, NULL, NULL, NULL FROM d_base WHERE o_orderkey % 9 <> 0
        UNION ALL SELECT o_orderkey, type_id, 7, 0, NULL, 'note for ' || o_orderkey, NULL, NULL, NULL, NULL FROM d_base
        UNION ALL SELECT l_orderkey, CASE WHEN l_orderkey % 20 = 7 THEN NULL ELSE 1 + l_orderkey % 3 END, 8, order_no, p_name, NULL, NULL, NULL, NULL, NULL FROM d_lines
        UNION ALL SELECT o_orderkey, type_id, 9, 0, 'L' || o_orderkey, NULL, NULL, NULL, NULL, NULL FROM d_base WHERE o_orderkey % 2 = 0
        ) v WHERE type_id IS NOT NULL""",
    "d_runs": """SELECT user_id AS document_id, ['text-extraction', 'classification', 'field-extraction'][CAST(event_id % 3 AS INTEGER) + 1] AS pipeline,
        CAST(CASE event_type WHEN 'error' THEN 90 WHEN 'signup' THEN 20 ELSE 30 END AS BIGINT) AS status, ts, event_id,
        row_number() OVER (PARTITION BY user_id, event_id % 3 ORDER BY ts, event_id) AS attempt FROM events""",
    "d_staged_events": "SELECT event_id, user_id AS document_id, event_type, ts AS event_time FROM events UNION ALL SELECT event_id, user_id, event_type, ts FROM events WHERE event_id % 7 = 0",
    "d_classification": "SELECT d.doc_id, d.text, 1 + d.doc_id % 3 AS type_id, coalesce(CAST(0.5 AS DOUBLE) + CAST(0.4 AS DOUBLE) * quality - CAST(0.3 AS DOUBLE) * toxic, 0) AS confidence FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id",
    "d_bundles": """SELECT conv_id, string_agg('## Turn ' || turn || chr(10) || text, chr(10) ORDER BY turn) AS markdown, conv_id % 2 = 0 AS is_container FROM conversations GROUP BY conv_id""",
}


_BOX = {
    "d_boxes": "SELECT l_suppkey AS page, l_orderkey * 10 + l_linenumber AS id, CAST(max((l_partkey * 7) % 500) AS DOUBLE) AS x0, CAST(max((l_partkey * 7) % 500) + max(l_quantity) + 4 AS DOUBLE) AS x1, CAST(max((l_orderkey * 13) % 700) AS DOUBLE) AS y0, CAST(max((l_orderkey * 13) % 700) + max(l_linenumber) + 6 AS DOUBLE) AS y1, CAST(max(l_linenumber) AS BIGINT) AS kind FROM lineitem GROUP BY l_suppkey, l_orderkey * 10 + l_linenumber",
    "d_cells": "SELECT CAST(floor(l_orderkey / 8) AS BIGINT) AS page, l_orderkey % 8 AS line, CAST((l_partkey % 4) * 100 + l_orderkey % 30 AS DOUBLE) AS x0, CAST((l_partkey % 4) * 100 + l_orderkey % 30 + 10 + l_quantity / 2 + CASE WHEN l_partkey % 10 = 0 THEN 100 ELSE 0 END AS DOUBLE) AS x1, CAST(10 AS DOUBLE) AS gutter FROM lineitem",
    "d_drawn": """SELECT CAST(floor(o_orderkey / 12) AS BIGINT) AS page, o_orderkey AS id,
        CAST(CASE WHEN j < 5 THEN 50 WHEN j < 9 THEN 50 + (j - 5) * 60 + jit WHEN j = 10 THEN 350 WHEN j = 11 AND o_custkey % 2 = 1 THEN 310 ELSE 300 END AS DOUBLE) AS x0,
        CAST(CASE WHEN j < 5 THEN 250 WHEN j < 9 THEN 51 + (j - 5) * 60 + jit WHEN j = 10 THEN 350 WHEN j = 11 AND o_custkey % 2 = 1 THEN 315 ELSE 400 END AS DOUBLE) AS x1,
        CAST(CASE WHEN j < 4 THEN 100 + j * 30 + jit WHEN j = 4 THEN 191 WHEN j < 9 THEN 95 WHEN j = 11 THEN 130 ELSE 100 END AS DOUBLE) AS y0,
        CAST(CASE WHEN j < 4 THEN 101 + j * 30 + jit WHEN j = 4 THEN 191 WHEN j < 9 THEN 225 WHEN j = 11 THEN 130 ELSE 160 END AS DOUBLE) AS y1
        FROM (SELECT o_orderkey, o_custkey, o_orderkey % 12 AS j, o_custkey % 3 AS jit FROM orders) o""",
    "d_textlines": """SELECT CAST(floor(k / 4) AS BIGINT) AS page, CAST((k % 4) * 8 + n AS BIGINT) AS line, CASE WHEN p % 6 = 0 THEN '第' || p || '条' ELSE 'Part ' || p || CASE WHEN p % 7 = 0 THEN ' *' ELSE '' END END AS text,
        CAST(50 AS DOUBLE) AS left, CAST(CASE WHEN p % 4 = 0 THEN 300 + q ELSE 480 + p % 11 END AS DOUBLE) AS right,
        CAST(1000 - (k % 4) * 106 - n * 12.5 - (p % 2) * 0.25 - 9 - (s % 3) * 0.5 AS DOUBLE) AS bottom, CAST(1000 - (k % 4) * 106 - n * 12.5 - (p % 2) * 0.25 AS DOUBLE) AS top,
        CAST(CASE WHEN p % 9 = 0 THEN 11 + (s % 8) * 1.5 ELSE 10 + (k % 3) * 0.25 END AS DOUBLE) AS size, s % 2 = 0 AS bold
        FROM (SELECT l_orderkey AS k, l_linenumber AS n, max(l_partkey) AS p, max(l_suppkey) AS s, max(l_quantity) AS q FROM lineitem GROUP BY l_orderkey, l_linenumber) t""",
    "d_points": "SELECT CAST(floor(l_orderkey / 12) AS BIGINT) AS page, (l_partkey * 7) % 420 + CAST(0.5 AS DOUBLE) AS x, (l_suppkey * 11) % 250 + CAST(0.25 AS DOUBLE) AS y FROM lineitem",
    "d_groups": """SELECT p_partkey AS id, CASE WHEN p_partkey % 160 = 144 THEN p_partkey + 15 WHEN p_partkey % 16 = 0 THEN NULL ELSE p_partkey - 1 END AS parent,
        (p_partkey * 37) % 900 AS offset_x, CAST(p_size * 10 AS BIGINT) AS offset_y, p_partkey % 50 AS child_offset_x, CAST(p_size AS BIGINT) AS child_offset_y, 1000 + p_partkey % 700 AS extent_x, CAST(900 AS BIGINT) AS extent_y,
        CASE WHEN p_partkey % 7 = 0 THEN 0 WHEN p_partkey % 7 = 1 THEN NULL ELSE 800 + p_size END AS child_extent_x, 1000 + p_partkey % 13 AS child_extent_y FROM part""",
}
VIEWS |= _BOX


def drawn(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The tables of page geometry, whose SQL both engines read: boxes (d_boxes), table cells (d_cells), drawn boxes (d_drawn), points (d_points), lines of text (d_textlines), shape groups (d_groups)."""
    text = _BOX[name]
    for t in ("lineitem", "orders", "part"):
        text = text.replace(f"FROM {t}", f"FROM {{{t}}}")
    used = {t: table(spark, sf_dir, t) for t in ("lineitem", "orders", "part") if f"{{{t}}}" in text}
    return spark.sql(text, **used)


def oracle(sql: str) -> str:
    """The SQL behind a WITH of the derived tables that it needs."""
    needed = set()

    def add(text: str) -> None:
        for name in VIEWS:
            if name in text and name not in needed:
                needed.add(name)
                add(VIEWS[name])

    add(sql)
    body = sql.strip()
    more, start = "", "WITH "
    if body[:15].upper() == "WITH RECURSIVE ":
        start, body = "WITH RECURSIVE ", "WITH " + body[15:]
    if body[:5].upper() == "WITH ":
        at = body.index("\n)\nSELECT") if "\n)\nSELECT" in body else -1
        if at > 0:
            more, body = ", " + body[5:at] + "\n)", body[at + 3 :]
    return start + ", ".join(f"{n} AS ({VIEWS[n]})" for n in VIEWS if n in needed) + more + "\n" + body if needed else sql.strip()
