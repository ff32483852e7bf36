"""Columns for typed values, flags and review reasons."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from vellumflow.functions import model as M


def plain_number(number: Column) -> Column:
    """A decimal without trailing zeros behind the point."""
    text = number.cast("decimal(38,6)").cast("string")
    return F.when(number == 0, F.lit("0")).otherwise(F.regexp_replace(F.regexp_replace(text, r"(\.\d*?)0+$", "$1"), r"\.$", ""))


def full_number(number: Column) -> Column:
    """A decimal with all its digits, without trailing zeros behind the point."""
    text = number.cast("string")
    return F.when(number == 0, F.lit("0")).when(F.contains(text, F.lit(".")), F.regexp_replace(text, r"\.?0+$", "")).otherwise(text)


def cell_text(text: str = "text_value", long_text: str = "long_text_value", number: str = "number_value", boolean: str = "boolean_value", date: str = "date_value", moment: str = "datetime_value") -> Column:
    """The typed value of a field row as text; the column that is set decides."""
    return F.coalesce(F.col(text), F.col(long_text), plain_number(F.col(number)), F.when(F.col(boolean), "true").when(~F.col(boolean), "false"), F.date_format(date, "yyyy-MM-dd"), F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss"))


def json_text(data_type: Column) -> Column:
    """The typed value as JSON: numbers and booleans bare, others quoted and escaped."""
    bare = data_type.isin("Number", "Boolean")
    quoted = F.regexp_replace(F.to_json(F.struct(cell_text().alias("v"))), r'^\{"v":(.*)\}$', "$1")
    return F.when(bare, cell_text()).otherwise(quoted)


def has(flags: Column, mask: int) -> Column:
    return flags.bitwiseAND(F.lit(mask)) != 0


def with_flag(flags: Column, mask: int) -> Column:
    return flags.bitwiseOR(F.lit(mask).cast("long"))


def without_flag(flags: Column, mask: int) -> Column:
    return flags.bitwiseAND(F.lit(~mask).cast("long"))


def blocking(flags: Column) -> Column:
    return has(flags, M.BLOCKING)


def flag_names(flags: Column) -> Column:
    """Names of the set flags, ascending, as one text; null for none."""
    names = F.array_compact(F.array(*[F.when(has(flags, bit), F.lit(name)) for bit, name in M.REASONS.items()]))
    return F.when(flags != 0, F.array_join(names, ", "))


def name_of(code: Column, names: dict[int, str]) -> Column:
    return reduce(lambda c, kv: c.when(code == kv[0], F.lit(kv[1])), list(names.items())[1:], F.when(code == next(iter(names)), F.lit(next(iter(names.values())))))


def normal_confidence(value: Column) -> Column:
    """Confidence from 0 to 1; 1 to 100 counts as percent; null for anything else."""
    ok = value.isNotNull() & ~F.isnan(value)
    return F.when(ok & value.between(0, 1), value).when(ok & (value > 1) & (value <= 100), value / 100)
