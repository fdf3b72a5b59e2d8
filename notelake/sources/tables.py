"""Cells of existing tables: typed columns or JSON objects as long, kind-tagged rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ITEM = "struct<kind:string,text:string>"
_KINDS = {"string": "str", "bigint": "int", "int": "int", "smallint": "int", "tinyint": "int", "double": "float", "float": "float", "boolean": "bool", "date": "date", "timestamp": "datetime", "timestamp_ntz": "datetime"}


def _cell(pos: int, name: str, data_type: str) -> Column:
    c = F.col(f"`{name}`")
    if data_type.startswith("array<"):
        item = _KINDS.get(data_type[6:-1], "float" if data_type[6:].startswith("decimal") else "str")
        items = F.transform(c, lambda x: F.struct(F.when(x.isNull(), "null").otherwise(item).alias("kind"), x.cast("string").alias("text")))
        kind, text = "list", F.to_json(c)
    else:
        kind, items, text = _KINDS.get(data_type, "float" if data_type.startswith("decimal") else "map"), F.lit(None).cast(f"array<{ITEM}>"), c.cast("string") if not data_type.startswith(("struct", "map")) else F.to_json(c)
    return F.struct(F.lit(name).alias("field"), F.lit(pos).alias("pos"), F.when(c.isNull(), "null").otherwise(kind).alias("kind"), text.alias("text"), items.alias("items"))


def cells_of(table: DataFrame, type_name: str, record: str = "_record") -> DataFrame:
    """(type, record, field, pos, kind, text, items) of each column of each row; every row has every field."""
    fields = [(n, t) for n, t in table.dtypes if n != record]
    each = F.explode(F.array(*[_cell(i, n, t) for i, (n, t) in enumerate(fields)])).alias("c")
    return table.select(F.lit(type_name).alias("type"), F.col(f"`{record}`").alias("record"), each).select("type", "record", "c.*")


def cells_of_json(table: DataFrame, type_name: str, record: str, json: str) -> DataFrame:
    """The same for a column of JSON objects as dynamic front matter; text that is no object has no cells. Positions are those of the sorted keys."""
    entries = F.map_entries(F.try_parse_json(f"`{json}`").try_cast("map<string,variant>"))
    each = table.select(F.lit(type_name).alias("type"), F.col(f"`{record}`").cast("string").alias("record"), F.posexplode(entries).alias("pos", "e"))
    v = F.col("e.value")

    def kind_of(x: Column) -> Column:
        s = F.schema_of_variant(x)
        return (
            F.when(x.isNull() | (s == "VOID"), "null").when(s == "BOOLEAN", "bool").when(s == "BIGINT", "int").when(s.startswith("DECIMAL") | s.isin("DOUBLE", "FLOAT"), "float")
            .when(s == "STRING", "str").when(s.startswith("ARRAY"), "list").otherwise("map")
        )

    items = F.transform(v.try_cast("array<variant>"), lambda x: F.struct(kind_of(x).alias("kind"), x.try_cast("string").alias("text")))
    text = F.coalesce(v.try_cast("string"), F.to_json(v))
    return each.select("type", "record", F.col("e.key").alias("field"), "pos", kind_of(v).alias("kind"), text.alias("text"), F.when(kind_of(v) == "list", items).alias("items"))
