"""Declared field types: which text values fit them, and the values as Spark types."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LINK = r"^\[\[[^\[\]]+\]\]\z"

SPARK_TYPES = {
    "string": "string", "integer": "bigint", "number": "double", "boolean": "boolean", "date": "date", "datetime": "timestamp_ntz", "link": "string", "list[string]": "array<string>", "list[link]": "array<string>",
}


def blank(value: Column) -> Column:
    return F.coalesce(F.trim(value) == "", F.lit(True))


def _day(v: Column) -> Column:
    return v.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}\z") & (F.substring(v, 1, 4) != "0000") & v.try_cast("date").isNotNull()


def _list(v: Column, fits) -> Column:
    items = F.try_parse_json(v).try_cast("array<variant>")
    return v.startswith("[") & v.endswith("]") & F.coalesce(F.forall(items, lambda x: F.coalesce((F.schema_of_variant(x) == "STRING") & fits(x.try_cast("string")), F.lit(False))), F.lit(False))


def fits(value: Column, kind: Column) -> Column:
    """Whether a value that isn't blank is of the declared type; outer spaces don't matter. An unknown type takes anything."""
    v = F.trim(value)
    day = F.substring(v, 1, 10)
    return (
        F.when(kind == "integer", v.rlike(r"^[+-]?[0-9]+\z") & v.try_cast("bigint").isNotNull())
        .when(kind == "number", v.rlike(r"^[+-]?[0-9]+(\.[0-9]+)?(e[+-]?[0-9]+)?\z"))
        .when(kind == "boolean", F.lower(v).isin("true", "false", "yes", "no", "on", "off"))
        .when(kind == "date", _day(v))
        .when(kind == "datetime", v.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ]([01][0-9]|2[0-3]):[0-5][0-9](:[0-5][0-9])?\z") & _day(day))
        .when(kind == "link", v.rlike(LINK))
        .when(kind == "list[string]", _list(v, lambda x: x.isNotNull()))
        .when(kind == "list[link]", _list(v, lambda x: F.trim(x).rlike(LINK)))
        .otherwise(F.lit(True))
    )


def typed(value: Column, kind: str) -> Column:
    """The value as a Spark type; null where it is blank or doesn't fit."""
    v = F.trim(value)
    if kind in ("integer", "number", "date"):
        out = v.try_cast(SPARK_TYPES[kind])
    elif kind == "boolean":
        out = F.lower(v).isin("true", "yes", "on")
    elif kind == "datetime":
        out = F.replace(v, F.lit("T"), F.lit(" ")).try_cast("timestamp_ntz")
    elif kind.startswith("list["):
        out = F.from_json(v, "array<string>")
    elif kind == "link":
        out = v
    else:
        out = value
    return F.when(~blank(value) & fits(value, F.lit(kind)), out)
