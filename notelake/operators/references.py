"""References to records that don't exist: a linear merge of references and parent validity intervals.

References and the beginnings and ends of parents are brought together by key (vault_id, type, name) and sorted by
time; one pass over each key keeps the number of parents alive. Keys that very many references use are found by counting
and salted: their references are dealt out, their parents repeated. References that name no key have no parent and take no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written

KEY = ["vault_id", "type", "name"]
LINK = r"^\[\[([^\]|]+)(?:\|[^\]|]*)?\]\]\z"

#: References of one key that go to one task, about.
PER_TASK = 500_000

FIRST, LAST = "timestamp_ntz '0001-01-01 00:00:00'", "timestamp_ntz '9999-12-31 00:00:00'"


def link_path(target: Column) -> Column:
    """The path of a value that is a link, else null."""
    v = F.trim(target)
    return F.when(v.rlike(LINK), F.regexp_extract(v, LINK, 1))


def references(links: DataFrame, schema_fields: DataFrame) -> DataFrame:
    """The links among record_links: link_id, type_name, linked_at and the KEY they refer to. Values that are no link are left out."""
    rows = [tuple(r) for r in schema_fields.where("type_name is not null and field_name is not null").groupBy("type_name", "field_name").agg(F.max("link_target")).collect()]  # the declaration is small
    targets = links.sparkSession.createDataFrame(rows, "type_name string, field_name string, default_type string")
    parts = F.split("path", "/")
    named = links.select("link_id", "vault_id", "type_name", "field_name", "linked_at", link_path(F.col("target")).alias("path")).where("path is not null").join(F.broadcast(targets), ["type_name", "field_name"], "left")
    return named.select("link_id", "type_name", "linked_at", "vault_id", F.when(F.size(parts) > 1, F.element_at(parts, -2)).otherwise(F.col("default_type")).alias("type"), F.element_at(parts, -1).alias("name"))


def hot_keys(refs: DataFrame, per_task: int) -> DataFrame:
    """KEY and tasks, the number of parts of each key with more than per_task references. A written table of at most a row for every per_task references."""
    counts = refs.groupBy(*KEY).count().where(F.col("count") > per_task)
    return written(counts.select(*KEY, F.ceil(F.col("count") / max(per_task, 1)).alias("tasks")), "hot")


def orphans(links: DataFrame, records: DataFrame, schema_fields: DataFrame, per_task: int = PER_TASK) -> DataFrame:
    """(link_id, type_name, linked_at, reason) of each link without a record of its type and name existing at linked_at.

    A record exists from created_at until before deleted_at; one deleted before it was created never exists. reason:
    missing if no record has the key at any time, late if one is created after linked_at, otherwise deleted. A null
    linked_at counts as after everything, a null created_at as before everything. Keys with a null part have no
    record. Repeated rows count once.
    """
    each = references(links, schema_fields)
    whole = " AND ".join(f"{k} IS NOT NULL" for k in KEY)
    refs, keyless = each.where(whole), each.where(f"NOT ({whole})")
    hot = hot_keys(refs, per_task)
    time = lambda c, default: F.coalesce(F.col(c).cast("timestamp_ntz"), F.expr(default))
    parents = records.where("vault_id is not null and type_name is not null and name is not null").select("vault_id", F.col("type_name").alias("type"), "name", time("created_at", FIRST).alias("begin"), F.col("deleted_at").cast("timestamp_ntz").alias("end"))
    if hot.isEmpty():
        refs, parents = refs.withColumn("salt", F.lit(0).cast("long")), parents.withColumn("salt", F.lit(0).cast("long"))
    else:
        refs = refs.join(hot, KEY, "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("link_id"), "tasks"), F.lit(0))).drop("tasks")
        parents = parents.join(hot, KEY, "left").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("tasks", F.lit(1)) - 1))).drop("tasks")
    lives = F.coalesce(F.col("end") > F.col("begin"), F.lit(True))
    begins = F.struct(F.col("begin").alias("at"), F.when(lives, 1).otherwise(0).alias("step"), F.col("begin").alias("born"))
    ends = F.when(lives & F.col("end").isNotNull(), F.struct(F.col("end").alias("at"), F.lit(-1).alias("step"), F.lit(None).cast("timestamp_ntz").alias("born")))
    marks = parents.select(*KEY, "salt", F.explode(F.array_compact(F.array(begins, ends))).alias("e")).select(*KEY, "salt", "e.*")
    asked = refs.select(*KEY, "salt", time("linked_at", LAST).alias("at"), F.lit(0).alias("step"), F.lit(None).cast("timestamp_ntz").alias("born"), "link_id", "type_name", "linked_at", F.lit(1).alias("asks"))
    both = asked.unionByName(marks.withColumn("asks", F.lit(0)), allowMissingColumns=True)
    sweep = Window.partitionBy(*KEY, "salt").orderBy("at", "asks")
    alive = F.sum("step").over(sweep.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    newest = F.max("born").over(sweep.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    merged = both.withColumn("alive", alive).withColumn("newest", newest).where("asks = 1 and alive = 0")
    reason = F.when(F.col("newest").isNull(), "missing").when(F.col("newest") > F.col("at"), "late").otherwise("deleted")
    found = merged.select("link_id", "type_name", "linked_at", reason.alias("reason"))
    return found.unionByName(keyless.select("link_id", "type_name", "linked_at", F.lit("missing").alias("reason"))).distinct()


def orphan_report(found: DataFrame) -> DataFrame:
    """Orphans counted for each type of the source and month of linked_at."""
    return found.groupBy("type_name", F.date_format("linked_at", "yyyy-MM").alias("month"), "reason").agg(F.count("*").alias("links"))
