"""Changes of the configuration and of documents, as rows to put into a versioned table, with what is refused.

The configuration is one table, so that a change of types and fields is one version: type_code and name are its key, a type has
an empty name. A refused change has rows in its refusals; whoever applies it looks there first: see apply().
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellumflow.functions import model as M
from vellumflow.operators.assemble import restore_conflicts
from vellumflow.sources.versions import VersionedTable

PACK_VERSION = 1
KEY = ["type_code", "name"]
COLUMNS = [*KEY, "display_name", "priority", "data_type", "is_required", "allow_multiple", "is_unique_key", "display_order", "prompt", "is_deleted"]


class Refused(Exception):
    """A change that breaks a rule; nothing was written."""


def configuration(types: DataFrame, definitions: DataFrame) -> DataFrame:
    """The configuration table of types and field definitions; prompts are null where there are none."""
    own = types.select("type_code", F.lit("").alias("name"), "display_name", F.col("priority").cast("long").alias("priority"), F.lit(False).alias("is_deleted"))
    codes = types.select(F.col("id").alias("document_type_id"), "type_code")
    fields = definitions.join(codes, "document_type_id").select("type_code", "name", "data_type", "is_required", "allow_multiple", "is_unique_key", F.col("display_order").cast("long").alias("display_order"), "is_deleted")
    both = own.unionByName(fields, allowMissingColumns=True)
    return both.withColumn("prompt", F.lit(None).cast("string")).select(*COLUMNS)


def import_packs(config: DataFrame, packs: DataFrame, used: DataFrame, update: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows to put, actions, refusals) of configuration packs.

    packs: COLUMNS without is_deleted, and version; a type's row has an empty name. used: type_code, name of fields that have values. actions: type_code, name,
    action (Created, Updated, Skipped). What is new is created, what is there is updated only if asked for; a deleted row
    counts as not there. refusals: type_code, name, code: a version other than PACK_VERSION, another data type or a single value
    for a field with values, prompts of a type beyond PROMPT_BUDGET characters together. Of rows that repeat a key, the one
    with the smallest content counts.
    """
    content = F.struct(*(c for c in packs.columns if c not in KEY))
    one = packs.groupBy(*KEY).agg(F.min(content).alias("p")).select(*KEY, "p.*")
    have = config.where("NOT is_deleted").select(*KEY, F.col("data_type").alias("old_type"), F.col("allow_multiple").alias("old_multiple"), F.col("prompt").alias("old_prompt"), F.lit(True).alias("there"))
    met = one.join(have, KEY, "left").join(used.select(*KEY).distinct().withColumn("in_use", F.lit(True)), KEY, "left")
    action = F.when(F.col("there").isNull(), "Created").when(F.lit(update), "Updated").otherwise("Skipped")
    met = met.withColumn("action", action)
    changed = F.col("in_use") & (F.col("action") == "Updated") & (F.col("name") != "")
    code = (
        F.when(~F.col("version").eqNullSafe(F.lit(PACK_VERSION)), "UnsupportedVersion")
        .when(changed & ~F.col("data_type").eqNullSafe(F.col("old_type")), "DataTypeChangeNotAllowed")
        .when(changed & F.col("old_multiple") & ~F.coalesce("allow_multiple", F.lit(False)), "MultiValueChangeNotAllowed")
    )
    refused = met.select(*KEY, code.alias("code")).where("code IS NOT NULL")
    after = have.select(*KEY, "old_prompt").join(met.select(*KEY, "prompt", "action"), KEY, "full_outer").where("name <> ''")
    prompt = F.when(F.col("action").isNull() | (F.col("action") == "Skipped"), F.col("old_prompt")).otherwise(F.col("prompt"))
    long = after.groupBy("type_code").agg(F.sum(F.coalesce(F.char_length(prompt), F.lit(0))).alias("n")).where(F.col("n") > M.PROMPT_BUDGET)
    long = long.join(one.select("type_code").distinct(), "type_code", "left_semi").select("type_code", F.lit("").alias("name"), F.lit("SchemaPromptTooLong").alias("code"))
    rows = met.where("action <> 'Skipped'").withColumn("is_deleted", F.lit(False)).select(*COLUMNS)
    return rows, met.select(*KEY, "action"), refused.unionByName(long)


def delete_types(config: DataFrame, codes: DataFrame, used_codes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows to put, refusals): types (type_code) go to the recycle bin with their fields; a type that any document has, a deleted one too, is refused."""
    wanted = codes.select("type_code").distinct()
    in_use = wanted.join(used_codes.select("type_code"), "type_code", "left_semi")
    rows = config.where("NOT is_deleted").join(wanted, "type_code", "left_semi").join(in_use, "type_code", "left_anti")
    return rows.withColumn("is_deleted", F.lit(True)).select(*COLUMNS), in_use.select("type_code", F.lit("").alias("name"), F.lit("InUse").alias("code"))


def restore_types(config: DataFrame, codes: DataFrame) -> DataFrame:
    """Rows to put: deleted types come back with their deleted fields."""
    wanted = config.where("is_deleted AND name = ''").join(codes.select("type_code").distinct(), "type_code", "left_semi").select("type_code")
    return config.where("is_deleted").join(wanted, "type_code", "left_semi").withColumn("is_deleted", F.lit(False)).select(*COLUMNS)


def recycle(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows to put: live documents with these ids go to the recycle bin."""
    return docs.where("NOT is_deleted").join(ids.select("id").distinct(), "id", "left_semi").withColumn("is_deleted", F.lit(True)).select(*docs.columns)


def restore(docs: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows to put, refusals: id, code): deleted documents come back unless a live one of their tenant has their content, or one of these with a smaller id."""
    wanted = docs.where("is_deleted").join(ids.select("id").distinct(), "id", "left_semi")
    conflicts = restore_conflicts(docs).where("conflict").select("id")
    free = wanted.join(conflicts, "id", "left_anti")
    twin = F.row_number().over(Window.partitionBy("content_hash", "tenant_id").orderBy("id"))
    ranked = free.withColumn("twin", F.when(F.col("content_hash").isNull(), 1).otherwise(twin))
    rows = ranked.where("twin = 1").drop("twin").withColumn("is_deleted", F.lit(False)).select(*docs.columns)
    refused = wanted.select("id").join(rows.select("id"), "id", "left_anti")
    return rows, refused.withColumn("code", F.lit("ContentExists"))


def apply(table: VersionedTable, rows: DataFrame, refusals: DataFrame | None = None) -> DataFrame:
    """Put rows into a table if nothing is refused; Refused, with some of the reasons, otherwise. Returns what upsert() does."""
    if refusals is not None:
        reasons = refusals.limit(10).collect()
        if reasons:
            raise Refused("; ".join(" ".join(str(v) for v in r if v != "") for r in reasons))
    return table.upsert(rows)
