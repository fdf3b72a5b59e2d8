"""Formulas of a type: order by reference, what they need joined, evaluation as column expressions."""

from __future__ import annotations

import datetime
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import FieldSchema, FieldType, Schema, TypeSchema
from ..operators import relations
from . import expr
from .expr.compiler import BOOL, DATE, DATETIME, FLOAT, INT, STR, Value, spark_type
from .expr.syntax import Node, walk

_LIST = lambda t: Value(None, "list", t)

#: The expression type of each field type, and the reverse.
VALUES = {
    FieldType.INTEGER: INT, FieldType.NUMBER: FLOAT, FieldType.BOOLEAN: BOOL, FieldType.DATE: DATE, FieldType.DATETIME: DATETIME, FieldType.LIST_STRINGS: _LIST(STR), FieldType.LIST_INTEGERS: _LIST(INT),
    FieldType.LIST_NUMBERS: _LIST(FLOAT), FieldType.LIST_LINKS: _LIST(STR), FieldType.LIST_MIXED: _LIST(STR),
}
_KINDS = {"int": FieldType.INTEGER, "float": FieldType.NUMBER, "bool": FieldType.BOOLEAN, "str": FieldType.STRING, "date": FieldType.DATE, "datetime": FieldType.DATETIME}


def output_type(v: Value) -> FieldType:
    if v.kind == "list":
        return {"int": FieldType.LIST_INTEGERS, "float": FieldType.LIST_NUMBERS}.get(v.item.kind, FieldType.LIST_STRINGS)
    return _KINDS.get(v.kind, FieldType.UNKNOWN)


def order(formulas: dict[str, str], aliases: dict[str, str] | None = None) -> tuple[list[str], set[str]]:
    """Formula names so that each comes after those it reads, and those in or behind a cycle.

    aliases: another name that a formula may be called by, the display name.
    """
    real = {**{n: n for n in formulas}, **{a: n for n, a in (aliases or {}).items()}}
    needs: dict[str, set[str]] = {}
    for name, text in formulas.items():
        try:
            bare, note, formula = expr.references(expr.parse(text))
        except expr.SyntaxFault:
            bare, note, formula = set(), set(), set()
        # A stored field of the same name is what a bare or note reference to itself means.
        needs[name] = {real[r] for r in formula if r in real} | {real[r] for r in (bare | note) if r in real and real[r] != name}
    done: list[str] = []
    while ready := [n for n in formulas if n not in done and needs[n] <= set(done)]:
        done += ready
    return done, set(formulas) - set(done)


@dataclass
class Clock:
    now: datetime.datetime = field(default_factory=lambda: datetime.datetime.now(datetime.UTC).replace(tzinfo=None, microsecond=0))


def _uses(trees: list[Node], *names: str) -> bool:
    return any(n.kind in ("method", "call", "dot") and n.value in names for t in trees for n in walk(t))


def _trees(texts: list[str]) -> list[Node]:
    out = []
    for t in texts:
        try:
            out.append(expr.parse(t))
        except expr.SyntaxFault:
            pass
    return out


class RowContext:
    """A type's table with what its expressions need joined: backlinks and the files that its links name."""

    def __init__(self, type_name: str, tables: dict[str, DataFrame], schema: Schema, files: dict[str, DataFrame], texts: list[str], now: datetime.datetime, root: str = "", base: tuple[str, str] | None = None) -> None:
        self.type_name, self.now = type_name, now
        self.this = {"name": Value(F.lit(base[0]), "str"), "folder": Value(F.lit(base[1]), "str")} if base else {}
        ts, table = schema.types[type_name], tables[type_name]
        trees = _trees(texts)
        self.columns = table.columns
        self.resolve = None
        meta = {"name": STR.of(F.col("_record")), "folder": STR.of(F.lit(type_name)), "ext": STR.of(F.lit(".md"))}
        if type_name in files:
            table = table.join(files[type_name].select("_record", *[F.col(c).alias(f"__{c}") for c in ("path", "parent", "size", "ctime", "mtime", "present")]), "_record", "left")
            meta |= {"path": STR.of(F.col("__path")), "parent": STR.of(F.col("__parent")), "size": INT.of(F.col("__size")), "ctime": DATETIME.of(F.col("__ctime")), "mtime": DATETIME.of(F.col("__mtime")), "present": _LIST(STR).of(F.col("__present"))}
        else:
            meta |= {"path": STR.of(F.concat(F.lit(f"data/{type_name}/"), F.col("_record"), F.lit(".md"))), "parent": STR.of(F.lit(f"{root}data/{type_name}"))}
        own = [relations._as_array(f) for f in ts.fields if f.type in relations.EDGE_TYPES]
        empty = F.array().cast("array<string>")
        meta["links"] = _LIST(STR).of(F.concat(*[F.coalesce(F.filter(c, lambda x: x.isNotNull()), empty) for c in own]) if own else empty)
        own_tags = F.col("tags") if "tags" in ts else F.lit(None).cast("string")  # a single one is a list of it
        own_tags = own_tags.cast("array<string>") if "tags" in ts and ts["tags"].spark.startswith("array") else F.when(own_tags.isNotNull(), F.array(own_tags.cast("string")))
        meta["tags"] = _LIST(STR).of(F.coalesce(own_tags, empty))
        if _uses(trees, "backlinks"):
            table = relations.with_backlinks(table, type_name, relations.backlinks(tables, schema))
            meta["backlinks"] = _LIST(STR).of(F.col("__backlinks"))
        if _uses(trees, "asFile", "linksTo") or any(n.kind == "call" and n.value == "file" for t in trees for n in walk(t)):
            dots = {n.value for t in trees for n in walk(t) if n.kind == "dot"} | {n.items[1].value for t in trees for n in walk(t) if n.kind == "index" and n.items[1].kind == "string"}
            props: dict[str, Value] = {}
            for other in schema.types.values():
                for f in other.fields:
                    if f.name in dots and f.type != FieldType.FORMULA:
                        v = VALUES.get(f.effective_type, STR)
                        props[f.name] = v if props.get(f.name, v) == v else STR
            known = relations.file_table(tables, schema, files, {p: spark_type(v) for p, v in props.items()})
            wanted = relations.text_links(tables[type_name], ts).withColumnRenamed("src", "_record")
            if "backlinks" in meta:
                wanted = wanted.unionByName(table.select("_record", F.explode("__backlinks").alias("raw")))
            literals = {n.value for t in trees for n in walk(t) if n.kind == "string" and str(n.value).startswith("[[")}
            if literals:
                wanted = wanted.unionByName(tables[type_name].select("_record", F.explode(F.array(*map(F.lit, sorted(literals)))).alias("raw")))
            table = table.join(relations.resolved(wanted, known), "_record", "left")
            kinds = {"name": STR, "folder": STR, "path": STR, "parent": STR, "ext": STR, "size": INT, "ctime": DATETIME, "mtime": DATETIME, "links": _LIST(STR), "tags": _LIST(STR), "properties": Value(None, "props", fields=props)}
            self.resolve = lambda link: Value(F.try_element_at(F.col("__files"), link), "file", fields=kinds)
        self.table, self.meta = table, meta
        self.fields = {f.name: VALUES.get(f.effective_type, STR).of(F.col(f"`{f.name}`")) for f in ts.fields if f.name in table.columns}

    def env(self) -> expr.Env:
        return expr.Env(self.fields, self.meta, self.this, self.now, self.resolve)

    def translate(self, text: str) -> Value:
        return expr.translate(text, self.env())


def evaluate(context: RowContext, ts: TypeSchema, formulas: dict[str, str], display: dict[str, str] | None = None, untranslatable: str = "drop") -> tuple[DataFrame, dict[str, str]]:
    """The table with a column for each formula, and why some are null: {name: rule F-1 or F-3 and the reason}.

    A formula is called by its display name if it has one. untranslatable="error" raises instead of giving null.
    """
    display = display or {}
    ordered, cyclic = order(formulas, display)
    table, faults = context.table, {n: "F-3: circular reference" for n in cyclic}
    for name in [*ordered, *sorted(cyclic)]:
        shown = display.get(name, name)
        value = None
        if name not in cyclic:
            try:
                value = context.translate(formulas[name])
            except expr.Untranslatable as e:
                if untranslatable == "error":
                    raise
                faults[name] = f"F-1: {e}"
        kind = output_type(value) if value is not None else FieldType.UNKNOWN
        col = F.lit(None).cast("string") if value is None else value.col.cast(spark_type(value)) if kind != FieldType.UNKNOWN else expr.compiler.text(value)
        table = table.withColumn(shown, col)
        typed = VALUES.get(kind, STR).of(F.col(f"`{shown}`"))
        context.fields[name] = context.fields[shown] = typed
        ts.put(FieldSchema(shown, FieldType.FORMULA, None, formulas[name], kind))
    context.table = table
    return table, faults


def predicate_text(filters: object) -> str | None:
    """One expression for a filter: text as it is, a list or {and: [...]} all of, {or: [...]} any of, {not: [...]} none of; groups nest. Nothing to test is None."""
    if filters is None or filters == "":
        return None
    if isinstance(filters, str):
        return filters
    if isinstance(filters, list):
        filters = {"and": filters}
    parts = []
    for key, op, sign in (("and", " && ", ""), ("or", " || ", ""), ("not", " || ", "!")):
        if key in filters:
            inner = filters[key]
            texts = [t for t in map(predicate_text, inner if isinstance(inner, list) else [inner]) if t]
            if texts:
                parts.append(sign + "(" + op.join(f"({t})" for t in texts) + ")")
    return " && ".join(parts) or None


def keep(context: RowContext, filters: object) -> DataFrame:
    """The rows for which a filter is true. A filter that can't be translated raises."""
    text = predicate_text(filters)
    return context.table if text is None else context.table.where(expr.truthy(context.translate(text)))
