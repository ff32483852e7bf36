"""Changes as registered queries: each makes a versioned table in the shared folder, changes it and reads it again."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from vellumflow.operators import changes as C
from vellumflow.plans.registry import query
from vellumflow.sources import blobs
from vellumflow.sources import derived as D
from vellumflow.sources.derived import oracle
from vellumflow.sources.versions import VersionedTable
from vellumflow.streaming.events import shared_folder


def _table(spark, rows, keys, buckets=8):
    made = VersionedTable(spark, f"{shared_folder(spark)}/versions-{uuid.uuid4().hex}", keys, buckets)
    made.create(rows)
    return made


_DOCS = "SELECT id, tenant_id, content_hash, is_deleted FROM d_documents"


@query("k7_recycle_and_restore", oracle(f"""WITH docs AS MATERIALIZED (
  SELECT id, tenant_id, content_hash, is_deleted OR id % 5 = 0 AS is_deleted FROM d_documents
), back AS (
  SELECT id, row_number() OVER (PARTITION BY content_hash, tenant_id ORDER BY id) AS twin FROM docs d WHERE is_deleted AND id % 2 = 0 AND NOT EXISTS (SELECT 1 FROM docs o WHERE NOT o.is_deleted AND o.content_hash = d.content_hash AND o.tenant_id IS NOT DISTINCT FROM d.tenant_id)
)
SELECT id, tenant_id, content_hash, is_deleted AND id NOT IN (SELECT id FROM back WHERE twin = 1) AS is_deleted FROM docs"""))
def k7_restore(spark, sf):
    """Every fifth document goes to the recycle bin, then all with even ids are asked back."""
    table = _table(spark, D.documents(spark, sf).select("id", "tenant_id", "content_hash", "is_deleted"), ["id"])
    table.upsert(C.recycle(table.read(), table.read().where("id % 5 = 0")))
    rows, _ = C.restore(table.read(), table.read().where("id % 2 = 0"))
    table.upsert(rows)
    return table.read()


def _config(spark):
    return C.configuration(D.document_types(spark), D.field_definitions(spark))


_CONFIG = """config AS (
  SELECT type_code, '' AS name, display_name, priority, CAST(NULL AS VARCHAR) AS data_type, CAST(NULL AS BOOLEAN) AS is_required, CAST(NULL AS BOOLEAN) AS allow_multiple, CAST(NULL AS BOOLEAN) AS is_unique_key, CAST(NULL AS BIGINT) AS display_order, CAST(NULL AS VARCHAR) AS prompt, false AS is_deleted FROM d_document_types
  UNION ALL SELECT t.type_code, f.name, NULL, NULL, f.data_type, f.is_required, f.allow_multiple, f.is_unique_key, f.display_order, NULL, f.is_deleted FROM d_field_definitions f JOIN d_document_types t ON t.id = f.document_type_id
)"""


def _packs(spark, sf):
    """A type for each kind of part, with a field for each of its brands."""
    part = D.table(spark, sf, "part")
    types = part.select(F.concat(F.lit("part."), F.lower(F.split("p_type", " ")[0])).alias("type_code"), F.lit("").alias("name"), F.initcap(F.split("p_type", " ")[0]).alias("display_name"), F.lit(5).cast("long").alias("priority")).distinct()
    fields = part.select(F.concat(F.lit("part."), F.lower(F.split("p_type", " ")[0])).alias("type_code"), F.translate(F.lower("p_brand"), "#", "-").alias("name"), F.lit("Text").alias("data_type"), F.lit("The brand").alias("prompt")).distinct()
    old = spark.createDataFrame([("order.general", "", "Order", 1), ("order.general", "amount", None, None), ("order.general", "legacy", None, None)], "type_code string, name string, display_name string, priority long").withColumn("data_type", F.when(F.col("name") != "", "Number"))
    rows = types.unionByName(fields, allowMissingColumns=True).unionByName(old, allowMissingColumns=True)
    flags = {c: F.when(F.col("name") != "", F.lit(False)) for c in ("is_required", "allow_multiple", "is_unique_key")}
    return rows.withColumns(flags | {"display_order": F.when(F.col("name") != "", F.lit(0)).cast("long"), "version": F.lit(1)})


_PACKED = """packs AS (
  SELECT DISTINCT 'part.' || lower(split_part(p_type, ' ', 1)) AS type_code, '' AS name, upper(p_type[1]) || lower(split_part(p_type, ' ', 1)[2:]) AS display_name, 5 AS priority, NULL AS data_type, NULL AS prompt FROM part
  UNION ALL SELECT DISTINCT 'part.' || lower(split_part(p_type, ' ', 1)), replace(lower(p_brand), '#', '-'), NULL, NULL, 'Text', 'The brand' FROM part
  UNION ALL SELECT * FROM (VALUES ('order.general', '', 'Order', 1, NULL, NULL), ('order.general', 'amount', NULL, NULL, 'Number', NULL), ('order.general', 'legacy', NULL, NULL, 'Number', NULL)) v
)"""


@query("s21_pack_upsert", oracle(f"""WITH {_CONFIG}, {_PACKED}
, kept AS (
  SELECT c.*, CAST(NULL AS VARCHAR) AS action FROM config c WHERE NOT EXISTS (SELECT 1 FROM packs p WHERE p.type_code = c.type_code AND p.name = c.name)
)
SELECT * FROM kept UNION ALL
SELECT p.type_code, p.name, p.display_name, CAST(p.priority AS BIGINT), p.data_type, CASE WHEN p.name <> '' THEN false END, CASE WHEN p.name <> '' THEN false END, CASE WHEN p.name <> '' THEN false END, CASE WHEN p.name <> '' THEN 0 END, p.prompt, false,
  CASE WHEN EXISTS (SELECT 1 FROM config c WHERE NOT c.is_deleted AND c.type_code = p.type_code AND c.name = p.name) THEN 'Updated' ELSE 'Created' END FROM packs p"""))
def s21_upsert(spark, sf):
    """The configuration after packs came in, with what became of each of their rows."""
    table = _table(spark, _config(spark), C.KEY)
    used = D.extracted_fields(spark, sf, (1,)).select(F.lit("order.general").alias("type_code"), F.lit("amount").alias("name")).distinct()
    rows, actions, refusals = C.import_packs(table.read(), _packs(spark, sf), used, update=True)
    C.apply(table, rows, refusals)
    return table.read().join(actions, C.KEY, "left")


@query("s21_pack_refusals", oracle("""SELECT type_code, name, CASE WHEN n % 3 = 0 THEN 'UnsupportedVersion' WHEN n % 3 = 1 THEN 'DataTypeChangeNotAllowed' ELSE 'MultiValueChangeNotAllowed' END AS code FROM (
  SELECT DISTINCT t.type_code, f.name, CASE WHEN f.allow_multiple THEN 2 WHEN f.id % 2 = 0 THEN 0 ELSE 1 END AS n FROM d_field_definitions f JOIN d_document_types t ON t.id = f.document_type_id JOIN d_extracted_fields e ON e.field_definition_id = f.id WHERE NOT f.is_deleted) x"""))
def s21_refusals(spark, sf):
    """Packs of another version, with other data types and with single values for fields that have several: refused where documents have values."""
    config = _config(spark)
    defs = D.field_definitions(spark).join(D.document_types(spark).select(F.col("id").alias("document_type_id"), "type_code"), "document_type_id")
    used = D.extracted_fields(spark, sf).select(F.col("field_definition_id").alias("id")).distinct().join(defs, "id").where("NOT is_deleted").select("id", *C.KEY)
    fields = config.where("name <> ''").join(used, C.KEY)
    packs = fields.withColumn("version", F.when(~F.col("allow_multiple") & (F.col("id") % 2 == 0), 2).otherwise(1)).withColumn("data_type", F.when(~F.col("allow_multiple") & (F.col("id") % 2 == 1), "Other").otherwise(F.col("data_type"))).withColumn("allow_multiple", F.lit(False))
    return C.import_packs(config, packs.drop("id", "is_deleted"), used, update=True)[2]


@query("g16_delete_and_restore", oracle(f"""WITH {_CONFIG}
, gone AS (
  SELECT type_code FROM d_document_types t WHERE NOT EXISTS (SELECT 1 FROM d_documents d WHERE d.document_type_id = t.id AND d.id % 3 > 0)
)
SELECT c.type_code, c.name, CASE WHEN g.type_code IS NOT NULL THEN c.type_code = 'order.general' OR true ELSE c.is_deleted END AS binned, CASE WHEN g.type_code IS NOT NULL THEN false ELSE c.is_deleted END AS is_deleted, t.refused
FROM config c LEFT JOIN gone g ON g.type_code = c.type_code JOIN (SELECT type_code, type_code NOT IN (SELECT type_code FROM gone) AS refused FROM d_document_types) t ON t.type_code = c.type_code"""))
def g16_delete(spark, sf):
    """All types are to go; those that a document has stay. Then all are asked back."""
    table = _table(spark, _config(spark), C.KEY)
    names = D.document_types(spark).select(F.col("id").alias("document_type_id"), "type_code")
    used = D.documents(spark, sf).where("id % 3 > 0").select("document_type_id").distinct().join(names, "document_type_id")
    rows, refusals = C.delete_types(table.read(), names, used)
    table.upsert(rows)
    binned = table.read().select(*C.KEY, F.col("is_deleted").alias("binned"))
    table.upsert(C.restore_types(table.read(), names))
    refused = names.select("type_code").join(refusals.select("type_code", F.lit(True).alias("refused")), "type_code", "left").fillna(False)
    return table.read().select(*C.KEY, "is_deleted").join(binned, C.KEY).join(refused, "type_code")


@query("s8_blob_round_trip", "SELECT 'page/' || page_id || '.html' AS name, strlen(html) AS size_bytes, sha256(html) AS sha256 FROM pages WHERE page_id % 7 > 0")
def s8_blobs(spark, sf):
    """All pages go into a blob store, every seventh is deleted, the others are read again."""
    path = f"{shared_folder(spark)}/blobs-{uuid.uuid4().hex}"
    pages = D.table(spark, sf, "pages").select("page_id", F.concat(F.lit("page/"), "page_id", F.lit(".html")).alias("name"), F.encode("html", "UTF-8").alias("content"))
    blobs.store(pages.repartition(8), path)
    blobs.delete(pages.where("page_id % 7 = 0"), path)
    return blobs.load(spark, path).select("name", F.octet_length("content").cast("long").alias("size_bytes"), F.sha2("content", 256).alias("sha256"))
