"""Field types and link targets from cells: one aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import FieldType
from . import links


def _items(test) -> Column:
    return F.coalesce(F.transform(F.filter("items", lambda i: i["text"].isNotNull() & (i["text"] != "")), test), F.array())


def infer(cells: DataFrame) -> DataFrame:
    """(type, field, pos, field_type, link_target). Empty values (null, "", []) don't count; a field without others is unknown.

    pos is the least position the field has in a record. link_target is the folder of all links, if they have just one.
    """
    kind, text = F.col("kind"), F.col("text")
    empty = (kind == "null") | ((kind == "str") & (text == "")) | ((kind == "list") & (F.size("items") == 0))
    link_item = lambda i: (i["kind"] == "str") & links.is_link(i["text"])
    own = cells.where("field is not null").select(
        "type", "field", "pos", F.when(~empty, kind).alias("k"), ((kind == "str") & links.is_link(text)).alias("link"), F.size(_items(lambda i: i)).alias("n"),
        F.size(F.filter(_items(link_item), lambda x: x)).alias("n_link"), F.size(F.filter(_items(lambda i: i["kind"] == "int"), lambda x: x)).alias("n_int"),
        F.size(F.filter(_items(lambda i: i["kind"].isin("int", "float")), lambda x: x)).alias("n_num"),
        F.when(empty, F.array().cast("array<string>")).when(kind == "str", F.array(links.link_folder(text))).otherwise(F.filter(_items(lambda i: F.when(link_item(i), F.coalesce(links.link_folder(i["text"]), F.lit("")))), lambda x: x.isNotNull())).alias("folders"),
    )
    every = lambda *k: F.bool_and(F.col("k").isin(*k))
    total, of_links = F.sum(F.when(F.col("k") == "list", F.col("n"))), F.sum(F.when(F.col("k") == "list", F.col("n_link")))
    listed = (
        F.when(total == 0, "list[string]").when(total == of_links, "list[link]").when(of_links > 0, "list[mixed]")
        .when(total == F.sum(F.when(F.col("k") == "list", F.col("n_int"))), "list[integer]").when(total == F.sum(F.when(F.col("k") == "list", F.col("n_num"))), "list[number]").otherwise("list[string]")
    )
    field_type = (
        F.when(F.count("k") == 0, "unknown").when(every("bool"), "boolean").when(every("int"), "integer").when(every("int", "float"), "number").when(every("datetime"), "datetime").when(every("date"), "date")
        .when(every("list"), listed).when(every("str"), F.when(F.bool_and(F.when(F.col("k").isNotNull(), F.col("link"))), "link").otherwise("string")).otherwise("unknown")
    )
    few = F.when(F.size("folders") == 0, F.lit(None)).otherwise(F.array_min(F.transform("folders", lambda x: F.coalesce(x, F.lit("")))))
    most = F.when(F.size("folders") == 0, F.lit(None)).otherwise(F.array_max(F.transform("folders", lambda x: F.coalesce(x, F.lit("")))))
    out = own.withColumn("lo", few).withColumn("hi", most).groupBy("type", "field").agg(F.min("pos").alias("pos"), field_type.alias("field_type"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    target = F.when(F.col("field_type").isin("link", "list[link]", "list[mixed]") & (F.col("lo") == F.col("hi")) & (F.col("lo") != ""), F.col("lo"))
    return out.select("type", "field", "pos", "field_type", target.alias("link_target"))


def of_values(spark: SparkSession, values: list) -> tuple[FieldType, str | None]:
    """The field type and link target of Python values, by the same aggregation."""
    from ..sources.markdown import kind_of, text_of

    rows = [("t", str(i), "f", 0, kind_of(v), text_of(v), [{"kind": kind_of(x), "text": text_of(x)} for x in _flat(v)] if isinstance(v, list) else None) for i, v in enumerate(values)]
    cells = spark.createDataFrame(rows, "type string, record string, field string, pos int, kind string, text string, items array<struct<kind:string,text:string>>")
    r = infer(cells).first()
    return (FieldType(r["field_type"]), r["link_target"]) if r else (FieldType.UNKNOWN, None)


def _flat(value: list) -> list:
    return [y for x in value for y in (x if isinstance(x, list) else [x])]
