"""A collection: typed tables of linked records, from a folder of notes or from existing DataFrames."""

from __future__ import annotations

import datetime
import logging
from dataclasses import replace
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.infer import infer
from .model import LIST_TYPES, SCHEMA_ROWS, FieldSchema, FieldType, Schema, TypeSchema, from_spark
from .operators import relations
from .plans import formulas
from .session import written
from .sources import markdown

log = logging.getLogger(__name__)

DANGLING = ("drop", "stub", "keep", "error")


class DanglingError(ValueError):
    pass


def cell_value(f: FieldSchema) -> Column:
    """A field's typed value from its cell's kind, text and items; null where it doesn't fit. UNKNOWN is text as Python shows it."""
    kind, text = F.col("kind"), F.col("text")
    python = F.when(kind == "bool", F.initcap(text)).when(kind != "null", text)
    if f.type in LIST_TYPES:
        item = {FieldType.LIST_INTEGERS: "bigint", FieldType.LIST_NUMBERS: "double"}.get(f.type, "string")
        return F.when(kind == "list", F.transform("items", lambda i: i["text"].try_cast(item))).when((kind != "null") & (text != ""), F.array(text.try_cast(item)))
    if f.type in (FieldType.STRING, FieldType.UNKNOWN):
        return python
    if f.type == FieldType.LINK:
        return F.when(kind == "str", text)
    return F.when(kind != "null", text.try_cast(f.spark))


class Collection:
    """Tables by type, with ``_record`` as key and links as [[Type/record]] text, and the schema that describes them.

    files: by type, what is known of each record's file (path, size, times, present keys); empty for plain tables.
    """

    def __init__(self, spark: SparkSession, schema: Schema, tables: dict[str, DataFrame], *, files: dict[str, DataFrame] | None = None, cells: DataFrame | None = None, entries: DataFrame | None = None, layout: markdown.Layout | None = None, bases: dict[str, dict] | None = None, pairs=(), now: datetime.datetime | None = None) -> None:
        self.spark, self.schema, self.tables = spark, schema, tables
        self.files, self.cells, self.entries, self.layout, self.bases = files or {}, cells, entries, layout, bases or {}
        self.pairs = [tuple(p) for p in pairs]
        self.now = now or formulas.Clock().now
        self.faults: dict[tuple[str, str], str] = {}
        self.raw_tables = dict(tables)
        self.raw_schema = schema
        self.violations: DataFrame | None = None
        self.fingerprint: str | None = None
        self._options: dict = {}

    # -- construction ------------------------------------------------------------------------------------------

    @classmethod
    def from_tables(cls, tables: dict[str, tuple[DataFrame, str]], links_to: dict[str, str] | None = None, *, formulas_of: dict[str, dict[str, str]] | None = None, pairs=(), now: datetime.datetime | None = None) -> Collection:
        """A collection over existing DataFrames.

        tables: by type, a DataFrame and its key column. links_to: {"Type.field": target type} for columns that hold
        keys of another type (or lists of them). Timestamps become local date-times, keys text.
        """
        spark = next(iter(tables.values()))[0].sparkSession
        schema, out = Schema(), {}
        for name, (df, key) in tables.items():
            ts, cols = TypeSchema(name), [F.col(f"`{key}`").cast("string").alias("_record")]
            for field in df.schema.fields:
                kind, target, c = from_spark(field.dataType), (links_to or {}).get(f"{name}.{field.name}"), F.col(f"`{field.name}`")
                if target:
                    listed = kind in LIST_TYPES
                    kind = FieldType.LIST_LINKS if listed else FieldType.LINK
                    link = relations.linked_to(target)
                    c = F.transform(c, link) if listed else link(c)
                f = FieldSchema(field.name, kind, target)
                ts.fields.append(f)
                cols.append((F.to_json(c) if kind == FieldType.UNKNOWN and field.dataType.typeName() in ("struct", "map") else c.cast(f.spark)).alias(field.name))
            schema.types[name], out[name] = ts, df.select(*cols)
        made = cls(spark, schema, out, pairs=pairs, now=now)
        for name, own in (formulas_of or {}).items():
            made.add_formulas(name, own)
        made.raw_tables = dict(made.tables)
        return made

    @classmethod
    def from_folder(
        cls, spark: SparkSession, root: str, *, data: str = "data", bases: str = "bases", pairs=(), ignore_empty: bool = False, dangling: str = "drop", untranslatable: str = "drop",
        base_filters: bool = False, expand_to_lists: bool = True, types: list[str] | None = None, now: datetime.datetime | None = None,
    ) -> Collection:
        """Load a folder: one scan, inference, formulas, base filters (if asked), lint, dangling links, pairs.

        dangling: drop such links, stub their targets, keep them, or error. untranslatable: drop (null) or error.
        types: only these; their files alone are read.
        """
        if dangling not in DANGLING or untranslatable not in ("drop", "error"):
            raise ValueError(f"dangling is one of {DANGLING}, untranslatable drop or error")
        layout = markdown.list_folder(root, data, bases)
        entries = written(markdown.entries(spark, layout, types), "entries")
        nested = entries.where("kind = 'nested'").count()
        if nested:
            log.warning("%d notes are nested and are no records", nested)
        cells = written(markdown.scan(spark, entries), "cells", by="type")
        schema = Schema({t: TypeSchema(t) for t in layout.types if types is None or t in types})
        for r in sorted(infer(cells).collect(), key=lambda r: (r["pos"], r["field"])):  # as many rows as there are fields
            schema.types[r["type"]].fields.append(FieldSchema(r["field"], FieldType(r["field_type"]), r["link_target"]))
        if ignore_empty:
            schema.types = {n: t for n, t in schema.types.items() if t.fields}
        tables, files = {}, {}
        for name, ts in schema.types.items():
            own = cells.where(F.col("type") == name)
            columns = [F.max(F.when(F.col("field") == f.name, F.struct(cell_value(f).alias("v"))))["v"].alias(f.name) for f in ts.fields]
            tables[name] = own.groupBy(F.col("record").alias("_record")).agg(*columns) if columns else own.select(F.col("record").alias("_record")).distinct()
            parent = F.regexp_replace("path", "/[^/]*$", "")
            present = own.where("field is not null").groupBy(F.col("record").alias("_record")).agg(F.collect_set("field").alias("present"))
            files[name] = own.where("field is null").select(F.col("record").alias("_record"), "path", parent.alias("parent"), "size", "ctime", "mtime").join(present, "_record", "left")
        read = {n: markdown.read_base(p) for n, p in (layout.base_files or {}).items()}
        made = cls(spark, schema, tables, files=files, cells=cells, entries=entries, layout=layout, bases=read, pairs=pairs, now=now)
        made._options = dict(root=root, data=data, bases=bases, pairs=pairs, ignore_empty=ignore_empty, dangling=dangling, untranslatable=untranslatable, base_filters=base_filters, expand_to_lists=expand_to_lists, types=types)
        for name in schema.types:
            base = read.get(name)
            if base:
                ts = schema.types[name]
                ts.base_filter, ts.display = base["filters"], base["display"]
                display = {f: base["display"].get(f"formula.{f}", f) for f in base["formulas"]}
                made.add_formulas(name, base["formulas"], {k: v for k, v in display.items() if k != v}, untranslatable)
                if base_filters and base["filters"] is not None:
                    made.tables[name] = made._keep(name, base["filters"])
        made.raw_tables, made.raw_schema = dict(made.tables), Schema({n: replace(t, fields=list(t.fields)) for n, t in schema.types.items()})
        made.fingerprint = markdown.fingerprint(spark, root, data, bases)
        from .operators.lint import lint

        made.violations = lint(made)
        made.settle(dangling, expand_to_lists)
        return made

    def settle(self, dangling: str = "drop", expand_to_lists: bool = True) -> Collection:
        """Treat dangling links, then make relationship pairs agree; all pairs see the links as they were before any."""
        if dangling == "error":
            bad = relations.dangling(self.tables, self.schema)
            if not bad.isEmpty():
                raise DanglingError(f"links to records that don't exist, as {bad.first()['raw']}")
        elif dangling == "drop":
            self.tables = relations.drop_dangling(self.tables, self.schema)
        elif dangling == "stub":
            self.tables, self.schema = relations.stub_dangling(self.tables, self.schema)
        before, then = dict(self.tables), Schema({n: replace(t, fields=list(t.fields)) for n, t in self.schema.types.items()})
        for pair in self.pairs:
            relations.resolve_pair(self.tables, self.schema, pair, expand_to_lists, before, then)
        return self

    # -- expressions -------------------------------------------------------------------------------------------

    def context(self, type_name: str, texts: list[str]) -> formulas.RowContext:
        root = f"{self.layout.root}/" if self.layout else ""
        return formulas.RowContext(type_name, self.tables, self.schema, self.files, texts, self.now, root, (type_name, self.layout.bases if self.layout else "bases"))

    def add_formulas(self, type_name: str, own: dict[str, str], display: dict[str, str] | None = None, untranslatable: str = "drop") -> Collection:
        """Evaluate formulas of a type as further columns."""
        columns = self.tables[type_name].columns
        table, faults = formulas.evaluate(self.context(type_name, list(own.values())), self.schema.types[type_name], own, display, untranslatable)
        shown = [(display or {}).get(n, n) for n in own]
        self.tables[type_name] = table.select(*[F.col(f"`{c}`") for c in columns if c not in shown], *[F.col(f"`{c}`") for c in dict.fromkeys(shown)])
        self.faults |= {(type_name, n): why for n, why in faults.items()}
        return self

    def _keep(self, type_name: str, filters: object) -> DataFrame:
        text = formulas.predicate_text(filters)
        columns = self.tables[type_name].columns
        return formulas.keep(self.context(type_name, [text] if text else []), filters).select(*[F.col(f"`{c}`") for c in columns])

    # -- faces -------------------------------------------------------------------------------------------------

    @cached_property
    def dfs(self):
        from .operators.views import Tables

        return Tables(self)

    @cached_property
    def db(self):
        from .operators.sql import Sql

        return Sql(self)

    @cached_property
    def graph(self):
        from .operators.graph import Graph

        return Graph(self)

    @cached_property
    def expand(self):
        from .operators.write import Writer

        return Writer(self)

    def schema_df(self) -> DataFrame:
        return self.spark.createDataFrame(self.schema.rows(), SCHEMA_ROWS)

    def lint(self, homogeneity_threshold: float = 0.0) -> DataFrame:
        from .operators.lint import lint

        return lint(self, homogeneity_threshold)

    # -- freshness ---------------------------------------------------------------------------------------------

    @property
    def is_stale(self) -> bool:
        o = self._options
        return bool(o) and markdown.fingerprint(self.spark, o["root"], o["data"], o["bases"]) != self.fingerprint

    def reload(self) -> Collection:
        """Load the folder again, in place; faces that were handed out keep the old state."""
        o = dict(self._options)
        new = Collection.from_folder(self.spark, o.pop("root"), **o)
        for face in ("dfs", "db", "graph", "expand"):
            self.__dict__.pop(face, None)
        self.__dict__.update(new.__dict__)
        return self


