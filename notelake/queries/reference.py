"""Queries of the catalogue's operators over the driver's tables, and the SQL that they are held against.

A table is a type, its key a record, a foreign key a link; every query runs over whole tables.
"""

from __future__ import annotations

import datetime
import uuid
from collections.abc import Callable
from types import SimpleNamespace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..collection import Collection
from ..functions import infer as inference
from ..functions import links
from ..model import FieldSchema, FieldType, Schema, TypeSchema
from ..operators import graph as graphs
from ..operators import lint, relations, views, write
from ..session import shared_dir, table
from ..sources.tables import cells_of, cells_of_json

NOW = datetime.datetime(1998, 8, 2, 12, 0, 0)

KEYS = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey", "events": "event_id", "documents": "doc_id", "embeddings": "vec_id"}
LINKS = {"nation.n_regionkey": "region", "customer.c_nationkey": "nation", "supplier.s_nationkey": "nation", "orders.o_custkey": "customer", "lineitem.l_orderkey": "orders", "lineitem.l_partkey": "part", "lineitem.l_suppkey": "supplier"}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def lake(spark: SparkSession, d: str, *names: str, pairs=(), **own: tuple[DataFrame, str]) -> Collection:
    tables = {n: (table(spark, d, n), KEYS[n]) for n in names if n != "lineitem"}
    if "lineitem" in names:
        tables["lineitem"] = (table(spark, d, "lineitem").withColumn("line", F.concat_ws("-", "l_orderkey", "l_linenumber")), "line")
    return Collection.from_tables(tables | own, LINKS | {"customer.orders": "orders"}, pairs=pairs, now=NOW)


def computed(c: Collection, type_name: str, formulas: dict[str, str]) -> DataFrame:
    """The record and the formulas' results."""
    c.add_formulas(type_name, formulas)
    if c.faults:
        raise ValueError(str(c.faults))
    return c.tables[type_name].select("_record", *formulas)


def with_orders(spark: SparkSession, d: str, status: str | None = None) -> DataFrame:
    """customer with the keys of its orders (of a status) as a list, by text."""
    orders = table(spark, d, "orders")
    if status:
        orders = orders.where(F.col("o_orderstatus") == status)
    listed = orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.array_sort(F.collect_list(F.col("o_orderkey").cast("string"))).alias("orders"))
    return table(spark, d, "customer").join(listed, "c_custkey", "left")


# -- tables and views --------------------------------------------------------------------------------------------


@query("SELECT c_custkey::VARCHAR AS _record, c_name, c_nationkey::VARCHAR AS c_nationkey, c_acctbal, c_acctbal / 1000 AS thousands FROM customer WHERE c_acctbal > 0")
def view_project_filter_sort(spark, d):
    """PRJ-2, FLT-2, SRT-1, EXP-13, EXP-16, PRJ-4."""
    c = lake(spark, d, "nation", "customer").add_formulas("customer", {"thousands": "c_acctbal / 1000"})
    view = {"name": "rich", "order": ["file.name", "c_name", "c_nationkey", "c_acctbal", "formula.thousands"], "filters": "c_acctbal > 0", "sort": [{"property": "c_acctbal", "direction": "DESC"}]}
    return views.Table(c, "customer", view).df()


@query("SELECT o_orderkey::VARCHAR AS _record, o_orderpriority, o_orderstatus, o_orderkey, o_totalprice, o_orderdate, o_custkey::VARCHAR AS o_custkey FROM orders")
def full_column_order(spark, d):
    """PRJ-1, SNK-1."""
    return lake(spark, d, "customer", "orders").dfs["orders"].df()


@query("SELECT s_suppkey::VARCHAR AS _record, s_name, s_acctbal FROM supplier WHERE (s_acctbal < 0 OR s_acctbal > 5000) AND NOT s_name LIKE '%9%'")
def view_nested_filters(spark, d):
    """FLT-1, FLT-3: and, or, not, nested."""
    c = lake(spark, d, "nation", "supplier")
    filters = {"and": [{"or": ["s_acctbal < 0", "s_acctbal > 5000"]}, {"not": ["s_name.contains('9')"]}]}
    return views.Table(c, "supplier", {"name": "v", "order": ["file.name", "s_name", "s_acctbal"], "filters": filters}).df()


@query("SELECT p_partkey::VARCHAR AS _record, p_brand, p_size FROM part")
def view_group_sort(spark, d):
    """AGG-14, SRT-1: a group orders, it doesn't aggregate."""
    c = lake(spark, d, "part")
    return views.Table(c, "part", {"name": "v", "order": ["file.name", "p_size"], "groupBy": {"property": "p_brand", "direction": "DESC"}, "sort": [{"property": "p_size"}]}).df()


@query("SELECT o_orderkey::VARCHAR AS _record, '[[customer/' || o_custkey || ']]' AS raw, 'customer' AS folder, o_custkey::VARCHAR AS name FROM orders")
def link_render(spark, d):
    """HLP-4, PRJ-4."""
    t = lake(spark, d, "customer", "orders").tables["orders"]
    return t.select("_record", F.col("o_custkey").alias("raw"), links.link_folder(F.col("o_custkey")).alias("folder"), links.link_name(F.col("o_custkey")).alias("name"))


@query(
    """SELECT link_id, target IS NOT NULL AND regexp_matches(trim(target, ' '), '^\\[\\[([^\\]|]+?)(\\|[^\\]]+)?\\]\\]$') AS is_link,
    trim(string_split(nullif(regexp_extract(trim(target, ' '), '^\\[\\[([^\\]|]+?)(\\|[^\\]]+)?\\]\\]$', 1), ''), '/')[-1], ' ') AS name,
    trim(string_split(nullif(regexp_extract(trim(target, ' '), '^\\[\\[([^\\]|]+?)(\\|[^\\]]+)?\\]\\]$', 1), ''), '/')[-2], ' ') AS folder FROM record_links"""
)
def link_parse(spark, d):
    """HLP-4 over raw link text."""
    t = F.col("target")
    return table(spark, d, "record_links").select("link_id", links.is_link(t).alias("is_link"), links.link_name(t).alias("name"), links.link_folder(t).alias("folder"))


@query("SELECT doc_id::VARCHAR AS _record, CASE WHEN source IS NULL THEN 'None' ELSE source END || ', ' || coalesce(lang, 'None') AS both_ FROM documents")
def csv_flatten(spark, d):
    """SNK-6, SNK-5: lists joined, null items as None."""
    t = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("_record"), F.array("source", "lang").alias("both_"))
    return views.flatten_lists(t)


@query("SELECT o_orderkey::VARCHAR AS record, o_orderkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders")
def sql_table(spark, d):
    """SNK-9, SNK-10: a type's table without its edge fields."""
    return lake(spark, d, "customer", "orders").db.table("orders")


# -- inference and schema ------------------------------------------------------------------------------------------


@query(
    """SELECT 'events' AS type, key AS field, CASE WHEN bool_and(t IN ('UBIGINT', 'BIGINT')) THEN 'integer' WHEN bool_and(t IN ('UBIGINT', 'BIGINT', 'DOUBLE')) THEN 'number' WHEN bool_and(t = 'VARCHAR') THEN 'string'
    WHEN bool_and(t = 'BOOLEAN') THEN 'boolean' ELSE 'unknown' END AS field_type FROM (SELECT unnest(json_keys(props::JSON)) AS key, json_type(json_extract(props::JSON, '$.' || unnest(json_keys(props::JSON)))) AS t FROM events) GROUP BY key"""
)
def infer_props_types(spark, d):
    """AGG-1 over dynamic front matter."""
    return inference.infer(cells_of_json(table(spark, d, "events"), "events", "event_id", "props")).select("type", "field", "field_type")


@query(
    """SELECT * FROM (SELECT 'customer' AS type, 'c_custkey' AS field, 'integer' AS field_type, NULL AS link_target UNION ALL SELECT 'customer', 'c_name', 'string', NULL UNION ALL SELECT 'customer', 'c_nationkey', 'link', 'nation'
    UNION ALL SELECT 'customer', 'c_acctbal', 'number', NULL UNION ALL SELECT 'customer', 'c_mktsegment', 'string', NULL UNION ALL SELECT 'customer', 'orders', 'list[link]', 'orders') WHERE EXISTS (SELECT 1 FROM customer JOIN orders ON c_custkey = o_custkey)"""
)
def infer_link_target(spark, d):
    """AGG-2, §1.3."""
    c = lake(spark, d, "nation", customer=(with_orders(spark, d), "c_custkey"))
    return inference.infer(cells_of(c.tables["customer"], "customer")).select("type", "field", "field_type", "link_target")


@query(
    """SELECT 'nation' AS type, 'removed' AS change, 'n_regionkey' AS field UNION ALL SELECT 'nation', 'added', 'n_comment' UNION ALL SELECT 'nation', 'changed', 'n_nationkey' UNION ALL SELECT 'part', 'added_type', NULL UNION ALL SELECT 'region', 'removed_type', NULL"""
)
def schema_diff(spark, d):
    """SET-4, SET-5."""
    old = lake(spark, d, "region", "nation").schema
    fields = [FieldSchema("n_nationkey", FieldType.STRING), FieldSchema("n_name", FieldType.STRING), FieldSchema("n_comment", FieldType.STRING)]
    new = Schema({"nation": TypeSchema("nation", fields), "part": TypeSchema("part")})
    diff = old.diff(new)
    rows = [(t, "added_type", None) for t in diff["added_types"]] + [(t, "removed_type", None) for t in diff["removed_types"]]
    rows += [(t, kind, f) for t, x in diff["types"].items() for kind in ("added", "removed", "changed") for f in x[kind]]
    return spark.createDataFrame(rows, "type string, change string, field string")


@query("""SELECT vault_id, field_name, CASE WHEN count(DISTINCT kind) <= 1 THEN NULL WHEN bool_or(kind = 'str') THEN 'str' WHEN bool_or(kind = 'float') THEN 'float' ELSE 'int' END AS target
    FROM (SELECT vault_id, field_name, CASE WHEN regexp_full_match(cell_value, '-?[0-9]+') THEN 'int' WHEN regexp_full_match(cell_value, '-?[0-9]+[.][0-9]+') THEN 'float' ELSE 'str' END AS kind FROM cells WHERE cell_value IS NOT NULL) GROUP BY ALL""")
def coerce_mixed(spark, d):
    """HLP-1, AGG-12."""
    v = F.col("cell_value")
    kind = F.when(v.rlike(r"^-?[0-9]+\z"), "int").when(v.rlike(r"^-?[0-9]+\.[0-9]+\z"), "float").otherwise("str")
    kinds = table(spark, d, "cells").where(v.isNotNull()).groupBy("vault_id", "field_name").agg(F.collect_set(kind).alias("kinds"))
    return kinds.select("vault_id", "field_name", views.coercion_target(F.col("kinds")).alias("target"))


# -- links as relations --------------------------------------------------------------------------------------------


@query("SELECT DISTINCT o_orderkey::VARCHAR AS source, o_custkey::VARCHAR AS target FROM orders")
def edge_table_scalar(spark, d):
    """SNK-9, AGG-10."""
    return lake(spark, d, "customer", "orders").db.edges("orders", "o_custkey")


@query("SELECT DISTINCT o_custkey::VARCHAR AS source, o_orderkey::VARCHAR AS target FROM orders")
def edge_table_list(spark, d):
    """SNK-9, AGG-10 for a list of links."""
    return lake(spark, d, "orders", customer=(with_orders(spark, d), "c_custkey")).db.edges("customer", "orders")


@query("SELECT r_name, count(*) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def edge_join_back(spark, d):
    """JOI-11: SQL over the views of a collection."""
    c = lake(spark, d, "region", "nation", "customer")
    return c.db.sql("SELECT r.r_name, count(*) AS customers FROM customer__c_nationkey a JOIN nation__n_regionkey b ON a.target = b.source JOIN region r ON r.record = b.target GROUP BY r.r_name")


def solvent(spark, d):
    """orders, and only those customers as parents whose balance isn't negative."""
    return lake(spark, d, "orders", customer=(table(spark, d, "customer").where("c_acctbal >= 0"), "c_custkey"))


@query("SELECT o_orderkey::VARCHAR AS _record, CASE WHEN c_custkey IS NOT NULL THEN '[[customer/' || o_custkey || ']]' END AS o_custkey FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_acctbal >= 0")
def dangling_drop(spark, d):
    """JOI-1 on a scalar."""
    return solvent(spark, d).settle("drop").tables["orders"].select("_record", "o_custkey")


@query("SELECT c_custkey::VARCHAR AS _record, (SELECT string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey::VARCHAR) FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 1000) AS orders FROM customer")
def dangling_drop_list(spark, d):
    """JOI-1 on lists, in order; a list that loses all its links stays, empty."""
    c = lake(spark, d, customer=(with_orders(spark, d), "c_custkey"), orders=(table(spark, d, "orders").where("o_totalprice > 1000"), "o_orderkey")).settle("drop")
    return c.tables["customer"].select("_record", F.nullif(F.array_join(F.transform("orders", links.link_name), ","), F.lit("")).alias("orders"))


@query("SELECT c_custkey::VARCHAR AS _record, c_acctbal FROM customer WHERE c_acctbal >= 0 UNION ALL SELECT DISTINCT o_custkey::VARCHAR, NULL FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_acctbal < 0")
def dangling_stub(spark, d):
    """JOI-2."""
    return solvent(spark, d).settle("stub").tables["customer"].select("_record", "c_acctbal")


@query("SELECT c_custkey::VARCHAR AS _record, (SELECT string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderstatus <> 'F', o_orderkey::VARCHAR) FROM orders WHERE o_custkey = c_custkey) AS orders FROM customer")
def pair_outer_union(spark, d):
    """JOI-3, JOI-4, SET-1, SET-3: links that are there keep their order, missing ones follow sorted."""
    c = lake(spark, d, "orders", customer=(with_orders(spark, d, "F"), "c_custkey"), pairs=[("customer.orders", "orders.o_custkey")]).settle("keep")
    return c.tables["customer"].select("_record", F.nullif(F.array_join(F.transform("orders", links.link_name), ","), F.lit("")).alias("orders"))


@query("SELECT 0 AS side, o_custkey::VARCHAR AS record, o_orderkey::VARCHAR AS missing FROM orders WHERE o_orderstatus <> 'F'")
def pair_missing_backlinks(spark, d):
    """R-5, JOI-8, SET-2."""
    c = lake(spark, d, "orders", customer=(with_orders(spark, d, "F"), "c_custkey"))
    return relations.missing_backlinks(c.tables, c.schema, ("customer.orders", "orders.o_custkey"))


@query("SELECT c_custkey::VARCHAR AS _record, count(o_orderkey) AS n, string_agg('[[orders/' || o_orderkey || ']]', ',' ORDER BY o_orderkey::VARCHAR) AS by_ FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
def backlinks(spark, d):
    """JOI-6, FIL-11."""
    c = lake(spark, d, "orders", customer=(table(spark, d, "customer").drop("c_nationkey"), "c_custkey"))
    return computed(c, "customer", {"n": "file.backlinks.length", "by_": "if(file.backlinks, file.backlinks.join(','), missing)"}).select("_record", "n", "by_")


@query("SELECT c_custkey::VARCHAR AS _record, n_name AS nation, 'nation' AS folder, n_regionkey AS region FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def as_file_lookup(spark, d):
    """JOI-5, LNK-1: navigation by link is a join."""
    out = computed(lake(spark, d, "nation", "customer"), "customer", {"nation": "c_nationkey.asFile().properties.n_name", "folder": "c_nationkey.asFile().folder", "region": "number(c_nationkey.asFile().n_regionkey.split('/')[1].replace(']]'))"})
    return out.withColumn("region", F.col("region").cast("int"))


@query("SELECT o_orderkey::VARCHAR AS _record, coalesce(c_nationkey = 7, false) AS hit FROM orders LEFT JOIN customer ON c_custkey = o_custkey")
def links_to(spark, d):
    """LNK-2, FIL-15."""
    return computed(lake(spark, d, "customer", "orders"), "orders", {"hit": "o_custkey.linksTo('nation/7]')"})


@query("""SELECT n_nationkey::VARCHAR AS _record, coalesce((SELECT string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_nationkey = n_nationkey AND false), '') AS none_,
    coalesce((SELECT string_agg(DISTINCT c_mktsegment, ',' ORDER BY c_mktsegment) FROM customer WHERE c_nationkey = n_nationkey), '') AS segments FROM nation""")
def backlink_chain(spark, d):
    """JOI-6 with JOI-5: backlinks.map(asFile).filter(inFolder).map(properties).unique()."""
    chain = "file.backlinks.map(value.asFile()).filter(value.inFolder('data/{}')).map(value.properties.c_mktsegment).unique().sort().join(',')"
    return computed(lake(spark, d, "nation", "customer"), "nation", {"segments": chain.format("customer"), "none_": chain.format("orders")})


@query("SELECT l_orderkey || '-' || l_linenumber AS _record, 3 AS n, 'orders' AS first, true AS has_part, false AS has_x, 'data/lineitem/' || l_orderkey || '-' || l_linenumber || '.md' AS path, true AS inside, '[[' || l_orderkey || '-' || l_linenumber || '|x]]' AS link FROM lineitem")
def file_members(spark, d):
    """FIL-1..FIL-4, FIL-10, FIL-13..FIL-16."""
    out = {"n": "file.links.length", "first": "file.links[0].split('/')[0].replace('[[')", "has_part": "file.hasLink('part/')", "has_x": "file.hasProperty('nope')", "path": "file.path", "inside": "file.inFolder('lineitem')", "link": "file.asLink('x')"}
    return computed(lake(spark, d, "orders", "part", "supplier", "lineitem"), "lineitem", out)


# -- expressions -------------------------------------------------------------------------------------------------


@query(
    """SELECT l_orderkey || '-' || l_linenumber AS _record, l_extendedprice * (1 - l_discount) AS net, l_extendedprice / nullif(l_discount, 0) AS ratio, l_linenumber - 4 - (-3) * floor((l_linenumber - 4) / (-3)) AS modulo,
    l_quantity - 7.5 * floor(l_quantity / 7.5) AS float_mod, NULL::VARCHAR AS mixed, l_returnflag || '/' || l_linestatus AS joined_, -l_tax AS neg FROM lineitem"""
)
def arith_null_safe(spark, d):
    """EXP-10..EXP-15."""
    out = {"net": "l_extendedprice * (1 - l_discount)", "ratio": "l_extendedprice / l_discount", "modulo": "(l_linenumber - 4) % -3", "float_mod": "l_quantity % 7.5", "mixed": "l_returnflag + 1", "joined_": "l_returnflag + '/' + l_linestatus", "neg": "-l_tax"}
    return computed(lake(spark, d, "orders", "part", "supplier", "lineitem"), "lineitem", out)


@query(
    """SELECT doc_id::VARCHAR AS _record, lang IS NOT DISTINCT FROM source AS same, lang IS DISTINCT FROM 'de' AS other, coalesce(lang < 'en', false) AS less, false AS mixed, coalesce(n_chars >= 100, false) AS long_, lang IS NULL AS none_ FROM documents"""
)
def compare_two_valued(spark, d):
    """EXP-16."""
    out = {"same": "lang == source", "other": "lang != 'de'", "less": "lang < 'en'", "mixed": "lang < 1", "long_": "n_chars >= 100", "none_": "lang == missing"}
    return computed(lake(spark, d, "documents"), "documents", out)


@query(
    """SELECT doc_id::VARCHAR AS _record, coalesce(nullif(lang, ''), source, 'x') AS first_, CASE WHEN coalesce(text, '') <> '' THEN lang ELSE text END AS both_, NOT (coalesce(text, '') <> '') AS no_text, CASE WHEN coalesce(n_chars, 0) <> 0 THEN 'some' ELSE 'none' END AS size FROM documents"""
)
def logic_truthy(spark, d):
    """EXP-17..EXP-19, EXP-26."""
    return computed(lake(spark, d, "documents"), "documents", {"first_": "lang || source || 'x'", "both_": "text && lang", "no_text": "!text", "size": "if(n_chars, 'some', 'none')"})


@query(
    """SELECT vec_id::VARCHAR AS _record, len(list_filter(e, lambda x: x > 0)) AS positive, list_reduce(list_transform(e, lambda x: x * 2), lambda a, x: a + x, 0.0::DOUBLE) AS total, list_sum(list_transform(list_filter(list_transform(e, lambda x, i: {'x': x, 'i': i}), lambda s: (s.i - 1) % 2 = 0), lambda s: 1)) AS even
    FROM (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings)"""
)
def list_filter_map_reduce(spark, d):
    """EXP-20..EXP-22, AGG-13."""
    out = computed(lake(spark, d, "embeddings"), "embeddings", {"positive": "embedding.filter(value > 0).length", "total": "embedding.map(value * 2).reduce(acc + value, 0.0)", "even": "embedding.filter(index % 2 == 0).length"})
    return out


@query("SELECT vec_id::VARCHAR AS _record, embedding[1]::DOUBLE AS first_, embedding[-1]::DOUBLE AS last_, NULL::DOUBLE AS none_, len(embedding[2:4]) AS cut, embedding[-2]::DOUBLE AS tail, len(embedding) * 2 AS twice FROM embeddings")
def list_index_slice(spark, d):
    """EXP-9, STR-4, EXP-10 on lists."""
    out = {"first_": "embedding[0]", "last_": "embedding[-1]", "none_": "embedding[100000]", "cut": "embedding.slice(1, 4).length", "tail": "embedding.slice(-2)[0]", "twice": "(embedding + embedding).length"}
    return computed(lake(spark, d, "embeddings"), "embeddings", out)


@query(
    """SELECT p_partkey::VARCHAR AS _record, array_to_string(list_sort(list_distinct(w)), '-') AS words, len(w) AS n, w[1] AS first_, array_to_string(list_transform(w, lambda x: x || '!'), ' ') AS loud, list_contains(w, 'STEEL') AS steel FROM (SELECT p_partkey, string_split(p_type, ' ') AS w FROM part)"""
)
def list_unique_sort_join(spark, d):
    """LST-1..LST-5, SET-6, SRT-4, STR-3, STR-1."""
    out = {"words": "p_type.split(' ').unique().sort().join('-')", "n": "p_type.split(' ').length", "first_": "p_type.split(' ')[0]", "loud": "p_type.split(' ').map(value + '!').join(' ')", "steel": "p_type.split(' ').contains('STEEL')"}
    return computed(lake(spark, d, "part"), "part", out)


@query(
    """SELECT p_partkey::VARCHAR AS _record, contains(p_name, 'a') AS has_a, replace(p_name, 'e', '3') AS leet, regexp_replace(p_name, '([aeiou])', '<\\1>', 'g') AS marked, lower(p_type) AS low, upper(p_name) AS up, p_name[1:3] AS head, p_name[-3:] AS tail,
    starts_with(p_brand, 'Brand#1') AS one, ends_with(p_brand, '5') AS five, length(p_name) AS n, regexp_matches(p_brand, '#[12]') AS low_brand, repeat(p_name[1:1], 3) AS thrice FROM part"""
)
def str_methods(spark, d):
    """STR-1..STR-9, RGX-1, EXP-8, EXP-12, EXP-23."""
    out = {
        "has_a": "p_name.contains('a')", "leet": "p_name.replace('e', '3')", "marked": "p_name.replace(/([aeiou])/, '<\\1>')", "low": "p_type.lower()", "up": "p_name.upper()", "head": "p_name.slice(0, 3)", "tail": "p_name.slice(-3)",
        "one": "p_brand.startsWith('Brand#1')", "five": "p_brand.endsWith('5')", "n": "p_name.length", "low_brand": "/#[12]/.matches(p_brand)", "thrice": "p_name[0] * 3",
    }
    return computed(lake(spark, d, "part"), "part", out)


@query("SELECT l_orderkey || '-' || l_linenumber AS _record, printf('%.1f', l_extendedprice)::DOUBLE AS one, round_even(l_extendedprice, 0)::BIGINT AS whole, ceil(l_extendedprice)::BIGINT AS up, floor(-l_extendedprice)::BIGINT AS down, abs(-l_discount) AS size, printf('%.2f', l_extendedprice / 7) AS fixed FROM lineitem")
def num_methods(spark, d):
    """NUM-1..NUM-5."""
    out = {"one": "l_extendedprice.round(1)", "whole": "l_extendedprice.round()", "up": "l_extendedprice.ceil()", "down": "(-l_extendedprice).floor()", "size": "(-l_discount).abs()", "fixed": "(l_extendedprice / 7).toFixed(2)"}
    return computed(lake(spark, d, "orders", "part", "supplier", "lineitem"), "lineitem", out)


@query(
    """SELECT o_orderkey::VARCHAR AS _record, year(o_orderdate)::BIGINT AS y, month(o_orderdate)::BIGINT AS m, day(o_orderdate)::BIGINT AS dd, (o_orderdate + INTERVAL 45 DAY)::TIMESTAMP AS later, (o_orderdate - INTERVAL 90 MINUTE)::TIMESTAMP AS before,
    epoch_us(TIMESTAMP '1998-08-02 12:00:00' - o_orderdate) / 1000.0 AS age, o_orderdate::DATE AS day_, (o_orderdate::DATE + INTERVAL 1 DAY)::DATE AS next_ FROM orders"""
)
def date_parts_shift_diff(spark, d):
    """EXP-8, EXP-10, EXP-11, HLP-5, DAT-3, GLB-1."""
    out = {"y": "o_orderdate.year", "m": "o_orderdate.month", "dd": "o_orderdate.day", "later": "o_orderdate + '1M 15d'", "before": "o_orderdate - '1h 30m'", "age": "now() - o_orderdate", "day_": "o_orderdate.date()", "next_": "o_orderdate.date() + '30h'"}
    return computed(lake(spark, d, "customer", "orders"), "orders", out)


@query("SELECT o_orderkey::VARCHAR AS _record, strftime(o_orderdate, '%d.%m.%Y') AS german, strftime(o_orderdate, '%A, %B %y') AS long_, strftime(o_orderdate, '%H:%M:%S') AS clock, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS plain FROM orders")
def date_format_moment(spark, d):
    """DAT-1, DAT-4, ANY-3."""
    return computed(lake(spark, d, "customer", "orders"), "orders", {"german": "o_orderdate.format('DD.MM.YYYY')", "long_": "o_orderdate.format('dddd, MMMM YY')", "clock": "o_orderdate.time()", "plain": "o_orderdate.toString()"})


@query(
    """WITH s AS (SELECT event_id, floor(epoch_us(TIMESTAMP '1998-08-02 12:00:00' - ts) / 1000000) AS x FROM events), u AS (SELECT *, abs(x) AS a, CASE WHEN abs(x) >= 86400 THEN 86400 WHEN abs(x) >= 3600 THEN 3600 ELSE 60 END AS unit FROM s),
    p AS (SELECT *, floor(a / unit)::BIGINT AS n, CASE unit WHEN 86400 THEN ' day' WHEN 3600 THEN ' hour' ELSE ' minute' END AS w FROM u)
    SELECT event_id::VARCHAR AS _record, CASE WHEN a < 60 THEN 'just now' WHEN x >= 0 THEN n || w || CASE WHEN n = 1 THEN '' ELSE 's' END || ' ago' ELSE 'in ' || n || w || CASE WHEN n = 1 THEN '' ELSE 's' END END AS said FROM p"""
)
def date_relative(spark, d):
    """DAT-2."""
    return computed(lake(spark, d, "events"), "events", {"said": "ts.relative()"})


@query("SELECT p_partkey::VARCHAR AS _record, p_size::BIGINT AS days, p_size * 3600 % 86400 AS seconds, 5400 AS fixed FROM part")
def duration_parse(spark, d):
    """GLB-8 on columns and literals."""
    return computed(lake(spark, d, "part"), "part", {"days": "duration(p_size.toString() + ' days').days", "seconds": "duration(p_size.toString() + 'h').seconds", "fixed": "duration('1h 30m').seconds"})


@query("SELECT cell_id::VARCHAR AS _record, CASE WHEN regexp_full_match(trim(cell_value, ' '), '[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?') THEN TRY_CAST(trim(cell_value, ' ') AS DOUBLE) END AS n, 0 + (load_no > 2)::BIGINT AS b FROM cells")
def number_cast(spark, d):
    """GLB-4."""
    cells = table(spark, d, "cells").select("cell_id", "cell_value", "load_no")
    return computed(Collection.from_tables({"cells": (cells, "cell_id")}, now=NOW), "cells", {"n": "number(cell_value)", "b": "number(load_no > 2)"})


@query("SELECT l_orderkey || '-' || l_linenumber AS _record, greatest(l_quantity, l_linenumber, 10) AS most, least(l_quantity, l_tax) AS least_, l_linenumber AS only_, NULL::VARCHAR AS none_ FROM lineitem")
def minmax_globals(spark, d):
    """GLB-9."""
    return computed(lake(spark, d, "orders", "part", "supplier", "lineitem"), "lineitem", {"most": "max(l_quantity, l_linenumber, 10)", "least_": "min(l_quantity, l_tax)", "only_": "max(missing, l_linenumber)", "none_": "min()"})


@query("SELECT cell_id::VARCHAR AS _record, CASE WHEN regexp_full_match(cell_value, '[0-9]{8}') THEN TRY_CAST(cell_value[1:4] || '-' || cell_value[5:6] || '-' || cell_value[7:8] AS DATE) WHEN regexp_full_match(cell_value, '[0-9]{4}-[0-9]{2}-[0-9]{2}.*') THEN TRY_CAST(cell_value[1:10] AS DATE) END AS day FROM cells")
def date_cast(spark, d):
    """GLB-3."""
    cells = table(spark, d, "cells").select("cell_id", "cell_value")
    return computed(Collection.from_tables({"cells": (cells, "cell_id")}, now=NOW), "cells", {"day": "date(cell_value)"})


@query("SELECT l_orderkey || '-' || l_linenumber AS _record, l_extendedprice * (1 - l_discount) AS net, l_extendedprice * (1 - l_discount) * (1 + l_tax) AS gross, CASE WHEN l_extendedprice * (1 - l_discount) * (1 + l_tax) > 1000 THEN 'big' ELSE 'small' END AS size FROM lineitem")
def formula_chain_topo(spark, d):
    """SRT-3, EXP-27, FIL-18: formulas in any order, each after those it reads."""
    c = lake(spark, d, "orders", "part", "supplier", "lineitem")
    return computed(c, "lineitem", {"size": "if(formula.gross > 1000, 'big', 'small')", "gross": "formula.net * (1 + note.l_tax)", "net": "note['l_extendedprice'] * (1 - l_discount)"}).select("_record", "net", "gross", "size")


@query("SELECT n_nationkey::VARCHAR AS _record, true AS text_, false AS int_, n_name || '|' || n_nationkey AS shown, true AS full_, 'a,b' AS keys, 3 AS sum_, '[[region/1|x]]' AS made, 1 AS one FROM nation")
def any_object_methods(spark, d):
    """ANY-1..ANY-3, OBJ-1..OBJ-3, GLB-5, GLB-7, EXP-5, EXP-6, EXP-25."""
    out = {"text_": "n_name.isType('string')", "int_": "n_name.isType('int')", "shown": "n_name.toString() + '|' + n_nationkey.toString()", "full_": "!n_name.isEmpty()", "keys": "{a: 1, b: 2}.keys().join(',')", "sum_": "{a: 1, b: 2}.values().reduce(acc + value, 0)", "made": "link('region/1', 'x')", "one": "list(image('x'), 1).filter(value).length"}
    return computed(lake(spark, d, "region", "nation"), "nation", out)


@query(
    """SELECT p_partkey::VARCHAR AS _record, array_to_string(list_transform(string_split(p_type, ' '), lambda w: upper(w[1:1]) || lower(w[2:])), ' ') AS title, p_name AS trimmed, p_name <> '' AS truthy, p_size <> 0 AS sized, 3 AS flat, DATE '1998-08-02' AS today,
    '.md' AS ext, 'part' AS folder, true AS yes, false AS no, p_partkey::VARCHAR AS named, 0 AS tags, false AS tagged, p_partkey::VARCHAR AS file FROM part"""
)
def more_methods(spark, d):
    """STR-6, STR-7, ANY-1, LST-4, GLB-2, GLB-6, FIL-1, FIL-4, FIL-7, FIL-9, FIL-12, EXP-3."""
    out = {"title": "p_type.title()", "trimmed": "('  ' + p_name + ' ').trim()", "truthy": "p_name.isTruthy()", "sized": "p_size.isTruthy()", "flat": "[[1, 2], [3]].flat().length", "today": "today()", "ext": "file.ext", "folder": "file.path.split('/')[1]", "yes": "true", "no": "!true", "named": "file.basename", "tags": "file.tags.length", "tagged": "file.hasTag('x')", "file": "file.name"}
    return computed(lake(spark, d, "part"), "part", out)


@query("SELECT o_orderkey::VARCHAR AS _record, c_name AS customer FROM orders LEFT JOIN customer ON c_custkey = o_custkey")
def file_of_link(spark, d):
    """GLB-6, FIL-8: the file that a link names."""
    return computed(lake(spark, d, "customer", "orders"), "orders", {"customer": "file(o_custkey).properties.c_name"})


@query("""SELECT p_partkey::VARCHAR AS _record, p_brand, p_size, row_number() OVER (ORDER BY p_brand DESC, p_size, p_partkey::VARCHAR) AS place FROM part""")
def view_order(spark, d):
    """AGG-14, SRT-1: the order of a view's rows, by the group, then the sort, then the record."""
    c = lake(spark, d, "part")
    view = {"name": "v", "order": ["file.name", "p_size"], "groupBy": {"property": "p_brand", "direction": "DESC"}, "sort": [{"property": "p_size"}, {"property": "file.name"}]}
    rows = views.Table(c, "part", view).df()
    placed = rows.rdd.zipWithIndex().map(lambda x: (*x[0], x[1] + 1))  # the order that the rows come out in
    return spark.createDataFrame(placed, T.StructType([*rows.schema.fields, T.StructField("place", T.LongType())])).select("_record", "p_brand", "p_size", "place")


# -- lint ----------------------------------------------------------------------------------------------------------


@query("""SELECT 'documents' AS type_name, field AS field_name, 'Field ''' || field || ''' present in ' || printf('%.1f', round_even(n / t * 100, 1)) || '% of records (' || n || '/' || t || ')' AS message FROM (
    SELECT 'text' AS field, count(text) AS n, count(*) AS t FROM documents UNION ALL SELECT 'lang', count(lang), count(*) FROM documents UNION ALL SELECT 'source', count(source), count(*) FROM documents UNION ALL SELECT 'type_name', count(type_name), count(*) FROM documents) WHERE n < t""")
def lint_r1(spark, d):
    """R-1, AGG-4: counts only, so that no list grows with the table."""
    c = lake(spark, d, "documents")
    return lint.homogeneity(c, 0.0, details=False)[0].select("type_name", "field_name", "message")


@query("""SELECT type_name, field_name, 'a field with values of several kinds, ''' || field_name || ''': ' || string_agg(k, ', ' ORDER BY k) AS message, '{' || string_agg('"' || k || '":' || n, ',' ORDER BY k) || '}' AS details
    FROM (SELECT type_name, field_name, CASE WHEN regexp_full_match(cell_value, '-?[0-9]+') THEN 'int' WHEN lower(cell_value) IN ('true', 'false') THEN 'bool' ELSE 'str' END AS k, count(*) AS n FROM cells WHERE cell_value IS NOT NULL AND type_name IS NOT NULL GROUP BY ALL)
    WHERE (type_name, field_name) NOT IN (SELECT (type_name, field_name) FROM schema_fields WHERE field_type IN ('link', 'list[link]')) GROUP BY type_name, field_name HAVING count(*) > 1""")
def lint_r2(spark, d):
    """R-2, AGG-5, through the rule: counts only."""
    v = F.col("cell_value")
    kind = F.when(v.isNull(), "null").when(v.rlike(r"^-?[0-9]+\z"), "int").when(F.lower(v).isin("true", "false"), "bool").otherwise("str")
    own = table(spark, d, "cells").where("type_name is not null").select(F.col("type_name").alias("type"), F.col("record_id").cast("string").alias("record"), F.col("field_name").alias("field"), kind.alias("kind"))
    schema = Schema({})
    for r in table(spark, d, "schema_fields").collect():
        kinds = {"link": FieldType.LINK, "list[link]": FieldType.LIST_LINKS}
        schema.types.setdefault(r["type_name"], TypeSchema(r["type_name"])).fields.append(FieldSchema(r["field_name"], kinds.get(r["field_type"], FieldType.STRING)))
    return lint.drift(SimpleNamespace(spark=spark, cells=own, schema=schema), details=False)[0].select("type_name", "field_name", "message", "details")


RAW_LINKS = """WITH p AS (SELECT type_name, field_name, string_split(nullif(regexp_extract(trim(target, ' '), '^\\[\\[([^\\]|]+?)(\\|[^\\]]+)?\\]\\]$', 1), ''), '/') AS s FROM record_links), e AS (SELECT type_name, field_name, trim(s[-2], ' ') AS folder, trim(s[-1], ' ') AS name FROM p WHERE s[-2] IS NOT NULL)"""


def edge_rule(spark, d, rule: int) -> DataFrame:
    """R-3, R-4 or R-6 over record_links, with the types and names of records."""
    t = F.col("target")
    edges = table(spark, d, "record_links").select(F.col("type_name").alias("type"), F.col("field_name").alias("field"), F.col("link_id").cast("string").alias("src"), links.link_folder(t).alias("folder"), links.link_name(t).alias("name"), t.alias("raw")).where("folder is not null")
    records = table(spark, d, "records").select(F.col("type_name").alias("folder"), "name").distinct()
    return lint.edge_rules(edges, records.select("folder").distinct(), records, details=False)[rule]


@query(RAW_LINKS + """ SELECT type_name, field_name, 'a field with links to several folders, ''' || field_name || ''': ' || string_agg(folder, ', ' ORDER BY folder) AS message FROM (SELECT DISTINCT type_name, field_name, folder FROM e) GROUP BY type_name, field_name HAVING count(*) > 1""")
def lint_r3(spark, d):
    """R-3, AGG-6, through the rule: folders of the links of a field."""
    return edge_rule(spark, d, 0).select("type_name", "field_name", "message")


@query(RAW_LINKS + """ SELECT type_name, 'R-4' AS rule, '{"links":' || count(*) || '}' AS details FROM e WHERE folder NOT IN (SELECT DISTINCT type_name FROM records) GROUP BY ALL""")
def lint_r4(spark, d):
    """R-4, AGG-7, JOI-7, through the rule: links to folders that are no type."""
    return edge_rule(spark, d, 1).select("type_name", "rule", "details")


@query("SELECT 'customer' AS type_name, 'orders' AS field_name, 'customer.orders: ' || count(*) || ' backlinks missing across ' || count(DISTINCT o_custkey) || ' records' AS message FROM orders WHERE o_orderstatus <> 'F' HAVING count(*) > 0")
def lint_r5(spark, d):
    """R-5, AGG-8."""
    c = lake(spark, d, "orders", customer=(with_orders(spark, d, "F"), "c_custkey"), pairs=[("customer.orders", "orders.o_custkey")])
    return lint.pair_rules(c)[0].select("type_name", "field_name", "message")


@query(RAW_LINKS + """ SELECT type_name, 'R-6' AS rule, '{"links":' || count(*) || '}' AS details FROM e WHERE folder IN (SELECT DISTINCT type_name FROM records) AND NOT EXISTS (SELECT 1 FROM records r WHERE r.type_name = e.folder AND r.name = e.name) GROUP BY ALL""")
def lint_r6(spark, d):
    """R-6, AGG-7, JOI-7, through the rule: links to a known folder without the record."""
    return edge_rule(spark, d, 2).select("type_name", "rule", "details")


@query("SELECT DISTINCT type_name, 'a name that some systems can''t store: ' || name AS message FROM records WHERE regexp_matches(name, '[<>:\"/\\\\|?*]') OR nfc_normalize(name) <> name")
def lint_s5(spark, d):
    """S-5, through the rule."""
    names = table(spark, d, "records").select("type_name", F.col("name").alias("_record")).where("_record is not null").distinct()
    types = [r[0] for r in names.select("type_name").where("type_name is not null").distinct().collect()]
    return lint.portable_names(SimpleNamespace(tables={t: names.where(F.col("type_name") == t).select("_record") for t in types})).select("type_name", "message")


@query("SELECT rule, count(*) AS violations FROM lint_violations GROUP BY rule")
def lint_counts(spark, d):
    """AGG-9."""
    return lint.counts(table(spark, d, "lint_violations"))


# -- graph -----------------------------------------------------------------------------------------------------------


@query("SELECT c_custkey || '|customer' AS id, 'customer' AS type, c_custkey::VARCHAR AS name FROM customer UNION ALL SELECT n_nationkey || '|nation', 'nation', n_nationkey::VARCHAR FROM nation UNION ALL SELECT DISTINCT n_regionkey || '|region', NULL, n_regionkey::VARCHAR FROM nation")
def graph_nodes(spark, d):
    """GRA-1, GRA-2b: regions aren't loaded and come out as implicit nodes."""
    return lake(spark, d, "nation", "customer").graph.nodes().select("id", "type", "name")


@query("SELECT o_orderkey || '|orders' AS source, o_custkey || '|customer' AS target, 'o_custkey' AS field FROM orders UNION ALL SELECT c_custkey || '|customer', c_nationkey || '|nation', 'c_nationkey' FROM customer UNION ALL SELECT n_nationkey || '|nation', n_regionkey || '|region', 'n_regionkey' FROM nation")
def graph_edges(spark, d):
    """GRA-2, SNK-11."""
    return lake(spark, d, "region", "nation", "customer", "orders").graph.edges()


@query("SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b FROM (SELECT o_orderkey || '|orders' AS a, o_custkey || '|customer' AS b FROM orders)")
def graph_undirected(spark, d):
    """GRA-3: customer.orders and orders.o_custkey are reciprocal."""
    c = lake(spark, d, "orders", customer=(with_orders(spark, d).drop("c_nationkey"), "c_custkey"))
    return c.graph.undirected()


@query(
    """SELECT o_orderkey || '|orders' AS id, 0 AS steps FROM orders WHERE o_orderpriority = '1-URGENT' UNION ALL SELECT DISTINCT o_custkey || '|customer', 1 FROM orders WHERE o_orderpriority = '1-URGENT'
    UNION ALL SELECT DISTINCT c_nationkey || '|nation', 2 FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderpriority = '1-URGENT'
    UNION ALL SELECT DISTINCT n_regionkey || '|region', 3 FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey WHERE o_orderpriority = '1-URGENT'"""
)
def graph_reach(spark, d):
    """GRA-9: reachability by frontier joins."""
    seeds = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.concat("o_orderkey", F.lit("|orders")).alias("id"))
    return lake(spark, d, "region", "nation", "customer", "orders").graph.reach(seeds, 10)


UMLAUTS = "replace(replace(replace(replace(replace(replace(replace(name, 'ä', 'ae'), 'ö', 'oe'), 'ü', 'ue'), 'Ä', 'Ae'), 'Ö', 'Oe'), 'Ü', 'Ue'), 'ß', 'ss')"


@query(f"SELECT DISTINCT record_id, regexp_replace(regexp_replace({UMLAUTS}, '[^\\x00-\\x7F]', '', 'g'), '[^A-Za-z0-9_]', '_', 'g') AS slug FROM records")
def slug_names(spark, d):
    """GRA-5."""
    return table(spark, d, "records").select("record_id", graphs.ascii_slug(F.col("name")).alias("slug")).distinct()


RDF_SQL = """WITH t AS (
    SELECT 'http://collection/nation/' || n_nationkey AS s, 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type' AS p, 'http://collection/nation' AS o, 'uri' AS o_kind, NULL AS datatype FROM nation
    UNION ALL SELECT 'http://collection/nation/' || n_nationkey, 'http://www.w3.org/2000/01/rdf-schema#label', n_nationkey::VARCHAR, 'literal', 'http://www.w3.org/2001/XMLSchema#string' FROM nation
    UNION ALL SELECT 'http://collection/nation/' || n_nationkey, 'http://collection/n_nationkey', n_nationkey::VARCHAR, 'literal', 'http://www.w3.org/2001/XMLSchema#integer' FROM nation
    UNION ALL SELECT 'http://collection/nation/' || n_nationkey, 'http://collection/n_name', n_name, 'literal', 'http://www.w3.org/2001/XMLSchema#string' FROM nation
    UNION ALL SELECT 'http://collection/nation/' || n_nationkey, 'http://collection/n_regionkey', 'http://collection/region/' || n_regionkey, 'uri', NULL FROM nation)
    SELECT * FROM t"""


@query(RDF_SQL)
def rdf_triples(spark, d):
    """GRA-8, SNK-13: what the data says; the schema's own triples are left out."""
    t = lake(spark, d, "nation").graph.triples()
    return t.where(F.col("s").startswith("http://collection/nation/"))


@query()
def rdf_triples_nt(spark, d):
    """SNK-13 as N-Triples, with classes and properties."""
    return lake(spark, d, "region", "nation", "supplier").graph.ntriples()


@query("SELECT c_custkey::VARCHAR AS source, c_nationkey::VARCHAR AS target FROM customer JOIN nation ON c_nationkey = n_nationkey")
def graph_relation_table(spark, d):
    """SNK-12, JOI-9, GRA-6: edges with both ends only."""
    return lake(spark, d, "nation", "customer").graph.cypher_tables()[1]["c_nationkey"]


# -- writing ---------------------------------------------------------------------------------------------------------


@query(
    """SELECT record_id, CASE WHEN s = '' THEN '_' ELSE s END AS filename FROM (SELECT DISTINCT record_id, regexp_replace(regexp_replace(nfc_normalize(name), '[\\[\\]:\\\\/^|#]', '_', 'g'), '^[. ]+|[. ]+$', '', 'g') AS s FROM records WHERE name IS NOT NULL)"""
)
def sanitize_names(spark, d):
    """WRT-4."""
    return table(spark, d, "records").where("name is not null").select("record_id", write.sanitized(F.col("name")).alias("filename")).distinct()


@query(
    """WITH n AS (SELECT p_partkey AS idx, p_brand AS name, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS r FROM part) SELECT idx, name, CASE WHEN r = 1 THEN name ELSE name || '_' || r END AS filename FROM n"""
)
def suffix_names(spark, d):
    """WRT-3."""
    names = table(spark, d, "part").select(F.col("p_partkey").alias("idx"), F.col("p_brand").alias("name"))
    return write.suffixed(names, spark.createDataFrame([], "name string"))


@query("SELECT c_custkey::VARCHAR AS _record, coalesce(n, 0) AS orders FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey")
def add_column_default(spark, d):
    """WRT-6, JOI-10: a mapping joined by record, with a default."""
    c = lake(spark, d, "nation", "customer")
    mapping = table(spark, d, "orders").groupBy(F.col("o_custkey").cast("string").alias("_record")).agg(F.count("*").alias("n"))
    return c.tables["customer"].join(mapping, "_record", "left").select("_record", F.coalesce("n", F.lit(0)).alias("orders"))


@query("SELECT n_nationkey::VARCHAR AS _record, n_name, n_nationkey, n_name || ' in ' || n_regionkey AS label, r_name, '[[region/' || n_regionkey || ']]' AS raw FROM nation JOIN region ON n_regionkey = r_regionkey")
def markdown_round_trip(spark, d):
    """SRC-1..SRC-5, WRT-9, EXP-27: tables written as notes, loaded again, their types inferred and their links followed."""
    root = shared_dir(spark).removeprefix("file:") + f"/notes-{uuid.uuid4().hex}"
    nation = table(spark, d, "nation").select(F.lit("nation").alias("t"), F.col("n_nationkey").alias("k"), F.to_json(F.struct("n_nationkey", "n_name", F.concat(F.lit("[[region/"), "n_regionkey", F.lit("]]")).alias("n_regionkey"))).alias("j"))
    region = table(spark, d, "region").select(F.lit("region").alias("t"), F.col("r_regionkey").alias("k"), F.to_json(F.struct("r_regionkey", "r_name")).alias("j"))
    files = nation.unionByName(region).select(F.concat(F.lit(f"{root}/data/"), "t", F.lit("/"), F.col("k").cast("string"), F.lit(".md")).alias("path"), F.concat(F.lit("---\n"), "j", F.lit("\n---\n\nA note.\n")).alias("content"))
    files.mapInPandas(write.save_files, "path string").count()
    c = Collection.from_folder(spark, root, now=NOW)
    raw = c.tables["nation"].select("_record", F.col("n_regionkey").alias("raw"))
    c.add_formulas("nation", {"label": "n_name + ' in ' + n_regionkey.asFile().name", "r_name": "n_regionkey.asFile().properties.r_name"})
    return c.dfs["nation"].df().select("_record", "n_name", "n_nationkey", "label", "r_name").join(raw, "_record")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)

