"""Structured document search: scoping, metadata and typed field predicates, ordering and paging.

All rules that refuse a query are checked on the driver, before a plan is built. Field predicates on one type are answered
in one pass over the field rows, however many there are.
"""

from __future__ import annotations

import datetime as dt
import math
import re
from dataclasses import dataclass
from decimal import Decimal, InvalidOperation
from functools import reduce

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellumflow.functions import model as M


class QueryError(ValueError):
    """A query that is refused; code says why."""

    def __init__(self, code: str, message: str = ""):
        super().__init__(f"{code}: {message}" if message else code)
        self.code = code


@dataclass(frozen=True)
class FieldFilter:
    """A condition on a field by name: value (equality) wins over min and max (an inclusive range, either side open)."""

    name: str
    value: str | None = None
    min: str | None = None
    max: str | None = None


@dataclass(frozen=True)
class FieldQuery:
    """A resolved condition: definition, data type, and the texts of the filter."""

    definition_id: int
    data_type: str
    value: str | None = None
    min: str | None = None
    max: str | None = None


# -- scans ---------------------------------------------------------------------------------------------------------------


def scope(df: DataFrame, tenant: int | None = None, include_deleted: bool = False) -> DataFrame:
    """Rows of one tenant; None is the host layer, a tenant of its own. Deleted rows only if asked for."""
    rows = df.where(F.col("tenant_id").eqNullSafe(F.lit(tenant).cast("long"))) if "tenant_id" in df.columns else df
    return rows if include_deleted or "is_deleted" not in df.columns else rows.where(~F.col("is_deleted"))


def recycle_bin(df: DataFrame, tenant: int | None = None) -> DataFrame:
    return scope(df, tenant, include_deleted=True).where("is_deleted")


def with_children(docs: DataFrame, fields: DataFrame) -> DataFrame:
    """Each document with its field rows, in order, as one array; the children are gathered before the join."""
    row = F.struct("field_definition_id", "order_no", "text_value", "number_value", "boolean_value", "date_value", "datetime_value", "long_text_value")
    return docs.join(fields.groupBy(F.col("document_id").alias("id")).agg(F.array_sort(F.collect_list(row)).alias("fields")), "id", "left")


def by_content_hash(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """Incoming rows whose content is stored already, in the recycle bin too."""
    return incoming.join(stored.select("content_hash").distinct(), "content_hash", "left_semi")


def by_natural_key(dim: DataFrame, column: str, key: str, ignore_case: bool = False) -> DataFrame:
    """Lookup by code or name; binary by default, or without case as some databases collate."""
    return dim.where(F.collate(F.col(column), "UTF8_LCASE") == F.collate(F.lit(key), "UTF8_LCASE") if ignore_case else F.col(column) == key)


# -- metadata predicates ---------------------------------------------------------------------------------------------------


def requires_attention() -> Column:
    return (F.col("review_reasons") != 0) & (F.col("review_disposition") != M.REJECTED)


def filter_metadata(
    df: DataFrame, lifecycle: int | None = None, type_id: int | None = None, cabinet: int | None = None, origin: int | None = None, disposition: int | None = None, has_review_reasons: bool | None = None, created_from: dt.date | None = None, created_to: dt.date | None = None
) -> DataFrame:
    """Optional conditions, all of which must hold. has_review_reasons filters only if true. Creation days are inclusive."""
    equal = {"lifecycle_status": lifecycle, "document_type_id": type_id, "cabinet_id": cabinet, "origin_document_id": origin, "review_disposition": disposition}
    for column, value in equal.items():
        if value is not None:
            df = df.where(F.col(column) == value)
    if has_review_reasons:
        df = df.where(requires_attention())
    if created_from is not None:
        df = df.where(F.col("creation_time") >= F.lit(dt.datetime.combine(created_from, dt.time())).cast("timestamp_ntz"))
    if created_to is not None:
        df = df.where(F.col("creation_time") < F.lit(dt.datetime.combine(created_to + dt.timedelta(days=1), dt.time())).cast("timestamp_ntz"))
    return df


# -- typed field predicates --------------------------------------------------------------------------------------------------

_NUMBER = re.compile(r"\s*([+-]?)\s*(\d[\d,]*(?:\.\d*)?|\.\d+)\s*([+-]?)\s*$")
_OFFSET = re.compile(r"(Z|[+-]\d\d:?\d\d)\s*$", re.I)


def parse_number(text: str) -> Decimal:
    m = _NUMBER.match(text)
    if not m or (m[1] and m[3]):
        raise QueryError("InvalidValue", f"{text!r} is no number")
    try:
        return Decimal((m[1] or m[3]) + m[2].replace(",", ""))
    except InvalidOperation as e:
        raise QueryError("InvalidValue", text) from e


def parse_moment(text: str) -> dt.datetime:
    if _OFFSET.search(text.strip()) and re.search(r"\d[T ]\d", text.strip()):
        raise QueryError("InvalidValue", f"{text!r} has an offset")
    try:
        return dt.datetime.fromisoformat(text.strip())
    except ValueError as e:
        raise QueryError("InvalidValue", f"{text!r} is no date and time") from e


def parse_date(text: str) -> dt.date:
    return parse_moment(text).date()


def parse_boolean(text: str) -> bool:
    if text.strip().lower() not in ("true", "false"):
        raise QueryError("InvalidValue", f"{text!r} is neither true nor false")
    return text.strip().lower() == "true"


def _range(column: str, kind: str, parse, q: FieldQuery) -> Column:
    low, high = (q.value, q.value) if q.value is not None else (q.min, q.max)
    at = lambda text: F.lit(parse(text)).cast(kind)
    if q.value is not None:
        return F.col(column) == at(q.value)
    return reduce(Column.__and__, [c for c in (F.col(column) >= at(low) if low is not None else None, F.col(column) <= at(high) if high is not None else None) if c is not None])


def predicate(q: FieldQuery) -> Column:
    """Condition on one field row; raises QueryError for what is refused."""
    if q.data_type == "LongText":
        raise QueryError("NotQueryable", "long text is stored, not searched")
    if q.value is None and q.min is None and q.max is None:
        raise QueryError("MissingValue")
    if q.data_type in ("Text", "Boolean") and q.value is None:
        raise QueryError("RangeNotSupported", q.data_type)
    value = {
        "Text": lambda: F.col("text_value") == q.value,
        "Boolean": lambda: F.col("boolean_value") == F.lit(parse_boolean(q.value)),
        "Number": lambda: _range("number_value", "decimal(38,6)", parse_number, q),
        "Date": lambda: _range("date_value", "date", parse_date, q),
        "DateTime": lambda: _range("datetime_value", "timestamp_ntz", parse_moment, q),
    }.get(q.data_type)
    if value is None:
        raise QueryError("NotQueryable", q.data_type)
    return (F.col("field_definition_id") == q.definition_id) & value()


def resolve(filters: list[FieldFilter], definitions: DataFrame, type_id: int) -> list[FieldQuery]:
    """Names to live definitions of the type; an unknown name is an error. Definitions of one type are few and collected."""
    live = {r.name: r for r in definitions.where((F.col("document_type_id") == type_id) & ~F.col("is_deleted")).collect()}
    for f in filters:
        if f.name not in live:
            raise QueryError("UnknownField", f.name)
    return [FieldQuery(live[f.name].id, live[f.name].data_type, f.value, f.min, f.max) for f in filters]


def matching_ids(fields: DataFrame, queries: list[FieldQuery]) -> DataFrame:
    """Documents for which every condition holds for some field row. No condition matches no document.

    One scan, one exchange: only rows that meet a condition are grouped, and a document needs all conditions among them.
    """
    conditions = [predicate(q) for q in queries]
    ids = fields.select(F.col("document_id").alias("id")) if not conditions else None
    if ids is not None:
        return ids.limit(0)
    hits = fields.where(reduce(Column.__or__, conditions))
    if len(conditions) == 1:
        return hits.select(F.col("document_id").alias("id")).distinct()
    every = reduce(Column.__and__, [F.col(f"c{k}") for k in range(len(conditions))])
    return hits.groupBy(F.col("document_id").alias("id")).agg(*[F.bool_or(c).alias(f"c{k}") for k, c in enumerate(conditions)]).where(every).select("id")


def search(docs: DataFrame, fields: DataFrame, definitions: DataFrame, types: DataFrame, type_code: str | None = None, filters: list[FieldFilter] | None = None, tenant: int | None = None, **metadata) -> DataFrame:
    """Documents of a tenant that meet all conditions. Field conditions need a type; an unknown type is an error with them, else empty."""
    rows = scope(docs, tenant)
    if filters is not None and type_code is None:
        raise QueryError("TypeRequired")
    if type_code is not None:
        found = types.where(F.col("type_code") == type_code).select("id").first()
        if found is None:
            if filters:
                raise QueryError("UnknownType", type_code)
            return rows.limit(0)
        metadata["type_id"] = found.id
    rows = filter_metadata(rows, **metadata)
    if filters is not None:
        rows = rows.join(matching_ids(fields, resolve(filters, definitions, metadata["type_id"])), "id", "left_semi")
    return rows


def document_probes(docs: DataFrame) -> DataFrame:
    """id, has_children (deleted ones count), has_live_copy: whether a live document of the same origin has the same content."""
    children = docs.select(F.col("origin_document_id").alias("id")).where("id IS NOT NULL").distinct().withColumn("_child", F.lit(True))
    same = ["origin_document_id", "content_hash"]
    copies = docs.where("NOT is_deleted AND origin_document_id IS NOT NULL").groupBy(*same).agg(F.count(F.lit(1)).alias("_live"))
    rows = docs.select("id", "is_deleted", *same).join(children, "id", "left").join(copies, same, "left")
    others = F.coalesce("_live", F.lit(0)) - F.when(F.col("is_deleted") | F.col("origin_document_id").isNull(), 0).otherwise(1)
    return rows.select("id", F.coalesce("_child", F.lit(False)).alias("has_children"), (others > 0).alias("has_live_copy"))


def search_scope(type_code: str | None, origin: str | None, cabinet: str | None, limit: int | None, lifecycle: str | None = None) -> dict:
    """The guarded search of the tools: needs a type, an origin or a cabinet; clamps the limit; a bad cabinet is an error, a bad origin or lifecycle counts as not given."""
    if not any((type_code, origin, cabinet)):
        raise QueryError("ScopeRequired")
    if cabinet and not cabinet.isdigit():
        raise QueryError("InvalidCabinet", cabinet)
    names = {v.lower(): k for k, v in M.LIFECYCLE.items()}
    return {"type_code": type_code or None, "origin": int(origin) if origin and origin.isdigit() else None, "cabinet": int(cabinet) if cabinet else None, "limit": min(max(limit or M.SEARCH_ROWS, 1), M.SEARCH_ROWS), "lifecycle": names.get((lifecycle or "").strip().lower())}


def compose_filters(rows: list[dict], types: dict[str, str]) -> list[FieldFilter]:
    """Filters from form rows: trimmed, incomplete rows dropped, ranges only for types that have them."""
    out = []
    for row in rows:
        name, value, low, high = ((row.get(k) or "").strip() for k in ("name", "value", "min", "max"))
        ranged = types.get(name) in ("Number", "Date", "DateTime")
        if name and value:
            out.append(FieldFilter(name, value=value))
        elif name and ranged and (low or high):
            out.append(FieldFilter(name, min=low or None, max=high or None))
    return out


# -- reprocessing scopes -------------------------------------------------------------------------------------------------------


def reprocess_scope(kind: str, current_type: int | None = None) -> dict:
    """Parameters of a reprocessing scope by name."""
    if kind == "OnlyCurrentType":
        if current_type is None:
            raise QueryError("TypeRequired")
        return {"type_id": current_type}
    if kind == "AllDocuments":
        return {}
    if kind == "PendingReviewQueue":
        return {"reasons": M.UNRESOLVED, "not_confirmed": True}
    raise QueryError("UnknownScope", kind)


def to_reprocess(df: DataFrame, type_id: int | None = None, reasons: int | None = None, not_confirmed: bool = False, markdown: str = "title") -> DataFrame:
    """Documents with a text, of a type, with any of some reasons, not confirmed, as far as asked for."""
    df = df.where(F.col(markdown).isNotNull() & (F.col(markdown) != ""))
    if type_id is not None:
        df = df.where(F.col("document_type_id") == type_id)
    if reasons is not None:
        df = df.where(F.col("review_reasons").bitwiseAND(F.lit(reasons)) != 0)
    return df.where(F.col("review_disposition") != M.CONFIRMED) if not_confirmed else df


# -- order and pages -------------------------------------------------------------------------------------------------------------


def ascending(sorting: str | None) -> bool:
    return (sorting or "").strip().lower() in ("creationtime", "creationtime asc")


def in_order(df: DataFrame, sorting: str | None = None) -> DataFrame:
    """By creation time and id, both downwards unless the sorting asks for creation time upwards."""
    return df.orderBy("creation_time", "id") if ascending(sorting) else df.orderBy(F.desc("creation_time"), F.desc("id"))


def page(df: DataFrame, skip: int, take: int, sorting: str | None = None) -> DataFrame:
    return in_order(df, sorting).offset(skip).limit(take)


def after(df: DataFrame, cursor: int | None, take: int) -> DataFrame:
    """The next ids behind a cursor."""
    ids = df.select("id")
    return (ids if cursor is None else ids.where(F.col("id") > cursor)).orderBy("id").limit(take)


def batches(df: DataFrame, size: int) -> DataFrame:
    """id, batch: all ids in order, dealt into batches of a size from 0 on. What after() gives page by page, in one scan. Null ids are in none.

    Ids are numbered within ranges between quantiles, behind the counts of the ranges before: one row per range is gathered.
    """
    ids = df.select("id").where("id IS NOT NULL")
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    marks = sorted(set(ids.approxQuantile("id", [k / ranges for k in range(1, ranges)], 0.25 / ranges))) if ranges > 1 else []
    # any marks number rightly, they only make ranges alike; two at least, as the class asks for three splits
    splits = [-math.inf, *(marks or [0.0]), math.inf]
    dealt = Bucketizer(splits=splits, inputCol="_at", outputCol="_range").transform(ids.withColumn("_at", F.col("id").cast("double"))).drop("_at")
    before = F.sum("_size").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    sizes = dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("_size")).select(F.col("_range").alias("_of"), F.coalesce(before, F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy("id")) - 1
    placed = dealt.withColumn("_place", place).join(F.broadcast(sizes), F.col("_range") == F.col("_of"))
    return placed.select("id", F.expr(f"(_before + _place) div {size:d}").alias("batch"))


def at_most(df: DataFrame, bound: int, code: str = "TooManyRows") -> DataFrame:
    """The frame, or an error if it has more rows than the bound: never a part of it."""
    if df.limit(bound + 1).count() > bound:
        raise QueryError(code, str(bound))
    return df
