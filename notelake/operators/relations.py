"""Links as relations: edges, dangling references, relationship pairs, backlinks and files by link."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import links
from ..model import EDGE_TYPES, LINK_LIST_TYPES, LINK_TYPES, FieldSchema, FieldType, Schema, TypeSchema
from ..session import written

EDGES = "src_type string, src string, field string, pos int, folder string, name string, raw string"


def _as_array(f: FieldSchema) -> Column:
    """A field's texts as a list; a field of another type has none."""
    c = F.col(f"`{f.name}`")
    return c if f.spark == "array<string>" else F.array(c) if f.spark == "string" else F.array().cast("array<string>")


def edges(tables: dict[str, DataFrame], schema: Schema, kinds=LINK_TYPES, declared_only: bool = False) -> DataFrame:
    """(src_type, src, field, pos, folder, name, raw): each link of each link field. Text that is no link is no edge."""
    parts = []
    for name, ts in schema.types.items():
        own = [f for f in ts.links(kinds) if not (declared_only and f.type == FieldType.FORMULA)]
        if own:
            tagged = F.array(*[F.struct(F.lit(f.name).alias("field"), _as_array(f).alias("v")) for f in own])
            fields = tables[name].select(F.lit(name).alias("src_type"), F.col("_record").alias("src"), F.explode(tagged).alias("f"))
            parts.append(fields.select("src_type", "src", "f.field", F.posexplode("f.v").alias("pos", "raw")))
    if not parts:
        return SparkSession.active().createDataFrame([], EDGES)
    return reduce(DataFrame.unionByName, parts).where(links.is_link(F.col("raw"))).select("src_type", "src", "field", "pos", links.link_folder(F.col("raw")).alias("folder"), links.link_name(F.col("raw")).alias("name"), "raw")


def edge_table(table: DataFrame, f: FieldSchema) -> DataFrame:
    """(source, target), distinct: the edge table of one LINK or list[link] field, by record names."""
    each = table.select(F.col("_record").alias("source"), F.explode(_as_array(f)).alias("raw"))
    return each.select("source", links.link_name(F.col("raw")).alias("target")).where("target is not null").distinct()


def records(tables: dict[str, DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [t.select(F.lit(n).alias("folder"), F.col("_record").alias("name")) for n, t in tables.items()])


def dangling(tables: dict[str, DataFrame], schema: Schema) -> DataFrame:
    """Edges of declared link fields whose folder-qualified target doesn't exist. One-part links never dangle."""
    return edges(tables, schema, declared_only=True).where("folder is not null").join(records(tables), ["folder", "name"], "left_anti")


def _absent_from(gone: Column):
    return lambda x: ~F.coalesce(F.array_contains(gone, x), F.lit(False))


def linked_to(target: str):
    return lambda x: links.as_link(F.lit(target), x.cast("string"))


def drop_dangling(tables: dict[str, DataFrame], schema: Schema) -> dict[str, DataFrame]:
    """Tables without dangling links: a list loses them and keeps its order, a scalar becomes null."""
    bad = written(dangling(tables, schema), "dangling")  # read once for each type
    out = {}
    for name, ts in schema.types.items():
        own = [f for f in ts.links() if f.type != FieldType.FORMULA]
        if not own:
            out[name] = tables[name]
            continue
        hits = bad.where(F.col("src_type") == name).groupBy(F.col("src").alias("_record")).agg(*[F.collect_set(F.when(F.col("field") == f.name, F.col("raw"))).alias(f"__{i}") for i, f in enumerate(own)])
        joined = tables[name].join(hits, "_record", "left")
        fixed = {}
        for i, f in enumerate(own):
            gone = F.coalesce(F.col(f"__{i}"), F.array().cast("array<string>"))
            c = F.col(f"`{f.name}`")
            stays = _absent_from(gone)
            fixed[f.name] = F.filter(c, stays) if f.effective_type in LINK_LIST_TYPES else F.when(stays(c), c)
        out[name] = joined.withColumns(fixed).select(*[F.col(f"`{c}`") for c in tables[name].columns])
    return out


def stub_dangling(tables: dict[str, DataFrame], schema: Schema) -> tuple[dict[str, DataFrame], Schema]:
    """Tables with an empty record for each dangling target; an unknown folder becomes a type without fields. Links stay."""
    missing = dangling(tables, schema).select("folder", "name").distinct()
    folders = [r[0] for r in missing.select("folder").distinct().collect()]  # types, not records
    out, types = dict(tables), dict(schema.types)
    for folder in sorted(folders):
        stubs = missing.where(F.col("folder") == folder).select(F.col("name").alias("_record"))
        if folder in out:
            out[folder] = out[folder].unionByName(stubs, allowMissingColumns=True)
        else:
            out[folder] = stubs
            types[folder] = TypeSchema(folder)
    return out, Schema(types)


class PairError(ValueError):
    pass


def split_pair(side: str, schema: Schema) -> tuple[str, str]:
    """Type and field of Type.field; the field may be missing, the type not."""
    type_name, dot, field = side.partition(".")
    if not dot or type_name not in schema.types:
        raise PairError(f"{side!r} doesn't name a field of a known type")
    return type_name, field


def pair_edges(tables: dict[str, DataFrame], schema: Schema, pair: tuple[str, str]) -> tuple[DataFrame, DataFrame]:
    """The edges (a, b) that either side of a pair asserts, by record names."""
    (ta, fa), (tb, fb) = (split_pair(s, schema) for s in pair)
    empty = SparkSession.active().createDataFrame([], "source string, target string")
    one = edge_table(tables[ta], schema.types[ta][fa]) if fa in schema.types[ta] else empty
    two = edge_table(tables[tb], schema.types[tb][fb]) if fb in schema.types[tb] else empty
    return one.toDF("a", "b"), two.toDF("b", "a").select("a", "b")


def resolve_pair(tables: dict[str, DataFrame], schema: Schema, pair: tuple[str, str], expand_to_lists: bool = True, source: dict[str, DataFrame] | None = None, asserted: Schema | None = None) -> None:
    """Make both sides of a pair assert what either does, in tables and schema.

    Links that are there keep their order, missing ones follow sorted. A scalar that needs several becomes a list, or
    PairError if expand_to_lists is off. Text that is no link goes; a one-part link comes back with its folder.
    """
    one, two = pair_edges(source or tables, asserted or schema, pair)
    both = written(one.union(two).distinct(), "pair")
    for side, key, other in ((0, "a", "b"), (1, "b", "a")):
        type_name, field = split_pair(pair[side], schema)
        target = split_pair(pair[1 - side], schema)[0]
        ts, table = schema.types[type_name], tables[type_name]
        known = ts[field] if field in ts else None
        if known is None:
            table = table.withColumn(field, F.lit(None).cast("array<string>"))
        need = both.groupBy(F.col(key).alias("_record")).agg(F.sort_array(F.collect_set(other)).alias("__need"))
        joined = table.join(need, "_record", "left")
        c = F.col(f"`{field}`")
        old = F.coalesce(c if known is None else _as_array(known), F.array().cast("array<string>"))
        kept = F.filter(old, lambda x: links.link_folder(x).isNotNull())
        missing = F.array_except(F.coalesce(F.col("__need"), F.array().cast("array<string>")), F.transform(kept, links.link_name))
        merged = F.concat(kept, F.transform(missing, linked_to(target)))
        scalar = known is not None and known.effective_type == FieldType.LINK
        if scalar:  # made once, for the question and for the result
            joined, merged = written(joined.withColumn("__merged", merged).drop("__need"), "side"), F.col("__merged")
        many = scalar and not joined.where(F.size(merged) > 1).isEmpty()
        if many and not expand_to_lists:
            raise PairError(f"{pair[side]} would need several links in a scalar field")
        value = F.try_element_at(merged, F.lit(1)) if scalar and not many else merged
        tables[type_name] = joined.withColumn(field, value).select(*[F.col(f"`{x}`") for x in table.columns])
        ts.put(FieldSchema(field, FieldType.LINK if scalar and not many else FieldType.LIST_LINKS, (known and known.link_target) or target))


def missing_backlinks(tables: dict[str, DataFrame], schema: Schema, pair: tuple[str, str]) -> DataFrame:
    """(side, record, missing): links that one side of a pair asserts and the other lacks, on the side where they lack."""
    one, two = pair_edges(tables, schema, pair)
    first = two.join(one, ["a", "b"], "left_anti").select(F.lit(0).alias("side"), F.col("a").alias("record"), F.col("b").alias("missing"))
    return first.unionByName(one.join(two, ["a", "b"], "left_anti").select(F.lit(1).alias("side"), F.col("b").alias("record"), F.col("a").alias("missing")))


def text_links(table: DataFrame, ts: TypeSchema) -> DataFrame:
    """(src, raw): links in any text or list of text of a record, whatever the field's type."""
    own = [F.array(F.col(f"`{f.name}`")) if f.spark == "string" else F.col(f"`{f.name}`") for f in ts.fields if f.spark in ("string", "array<string>") and f.name in table.columns]
    if not own:
        return SparkSession.active().createDataFrame([], "src string, raw string")
    return table.select(F.col("_record").alias("src"), F.explode(F.concat(*[F.coalesce(c, F.array().cast("array<string>")) for c in own])).alias("raw")).where(links.is_link(F.col("raw")))


def backlinks(tables: dict[str, DataFrame], schema: Schema) -> DataFrame:
    """(name, backlinks): by the record name linked to, links to the records that link there, by type and record.

    Names alone count, whatever the folder; a record's link to its own name is left out where the array is used.
    """
    parts = [text_links(tables[n], ts).select(F.lit(n).alias("src_type"), "src", links.link_name(F.col("raw")).alias("name")) for n, ts in schema.types.items()]
    each = reduce(DataFrame.unionByName, parts).distinct()
    return each.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("src_type", "src"))).alias("by"))


def with_backlinks(table: DataFrame, type_name: str, index: DataFrame, column: str = "__backlinks") -> DataFrame:
    own = F.filter(F.coalesce("by", F.array().cast("array<struct<src_type:string,src:string>>")), lambda x: ~((x["src"] == F.col("_record")) & (x["src_type"] == F.lit(type_name))))
    joined = table.join(index.withColumnRenamed("name", "_record"), "_record", "left")
    return joined.withColumn(column, F.transform(own, lambda x: links.as_link(x["src_type"], x["src"]))).drop("by")


def file_table(tables: dict[str, DataFrame], schema: Schema, files: dict[str, DataFrame], properties: dict[str, str]) -> DataFrame:
    """(folder, name, rank, file): each record as the struct that an expression sees; properties: the fields it needs and their Spark types."""
    parts = []
    for rank, (name, ts) in enumerate(schema.types.items()):
        table = tables[name]
        lists = [_as_array(f) for f in ts.fields if f.type in EDGE_TYPES and f.name in table.columns]
        own_links = F.concat(*[F.coalesce(F.filter(c, lambda x: x.isNotNull()), F.array().cast("array<string>")) for c in lists]) if lists else F.array().cast("array<string>")
        tags = F.col("tags").cast("array<string>") if "tags" in table.columns and dict(table.dtypes)["tags"].startswith("array") else F.array(F.col("tags").cast("string")) if "tags" in table.columns else F.array().cast("array<string>")
        props = [(F.col(f"`{p}`") if p in table.columns else F.lit(None)).cast(t).alias(p) for p, t in properties.items()]
        meta = files[name].select("_record", *[c for c in ("path", "parent", "size", "ctime", "mtime") if c in files[name].columns]) if name in files else None
        path, parent = F.concat(F.lit(f"data/{name}/"), F.col("_record"), F.lit(".md")), F.lit(f"data/{name}")
        size, ctime, mtime = F.lit(None).cast("bigint"), F.lit(None).cast("timestamp_ntz"), F.lit(None).cast("timestamp_ntz")
        if meta is not None:
            table = table.join(meta.toDF("_record", *[f"__{c}" for c in meta.columns[1:]]), "_record", "left")
            path, parent, size, ctime, mtime = (F.col(f"__{c}") for c in ("path", "parent", "size", "ctime", "mtime"))
        struct = F.struct(
            F.col("_record").alias("name"), F.lit(name).alias("folder"), path.alias("path"), parent.alias("parent"), F.lit(".md").alias("ext"), size.alias("size"), ctime.alias("ctime"), mtime.alias("mtime"),
            own_links.alias("links"), tags.alias("tags"), (F.struct(*props) if props else F.struct(F.lit(None).cast("string").alias("_"))).alias("properties"),
        )
        parts.append(table.select(F.lit(name).alias("folder"), F.col("_record").alias("name"), F.lit(rank).alias("rank"), struct.alias("file")))
    return reduce(DataFrame.unionByName, parts)


def resolved(wanted: DataFrame, known: DataFrame) -> DataFrame:
    """(_record, __files): a map from each link text of a record to the file it names. wanted: (_record, raw).

    A link without folder takes the first type, in order, that has the name.
    """
    each = wanted.distinct().withColumn("folder", links.link_folder(F.col("raw"))).withColumn("name", links.link_name(F.col("raw")))
    full = each.where("folder is not null").join(known, ["folder", "name"]).select("_record", "raw", "file")
    first = Window.partitionBy("name").orderBy("rank")
    bare = each.where("folder is null").drop("folder").join(known.withColumn("n", F.row_number().over(first)).where("n = 1"), "name").select("_record", "raw", "file")
    return full.unionByName(bare).groupBy("_record").agg(F.map_from_entries(F.collect_list(F.struct("raw", "file"))).alias("__files"))
