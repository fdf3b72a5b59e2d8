"""Lint rules: each a query, all united into one table of violations."""

from __future__ import annotations

import json
import re
import unicodedata
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import LINK_TYPES, FieldType
from ..plans import expr
from ..plans.expr.syntax import walk
from ..plans.formulas import order
from . import relations

VIOLATIONS = "severity string, message string, rule string, type_name string, field_name string, details string"

#: Fixed value: characters that some file system doesn't take in a name.
INVALID = r'[<>:"/\\|?*]'

RULES = {
    "S-1": "a type without base file",
    "S-2": "no folder of base files",
    "S-3": "a base file without type",
    "S-4": "something in a type's folder that is no record",
    "S-5": "a name that some systems can't store",
    "R-1": "a field that only some records have",
    "R-2": "a field with values of several kinds",
    "R-3": "a field with links to several folders",
    "R-4": "links to a folder that is no type",
    "R-5": "links of a pair that the other side lacks",
    "R-6": "links to records that don't exist",
    "F-1": "a formula that can't be translated",
    "F-2": "a formula that reads an unknown field",
    "F-3": "a formula in a circle",
    "F-4": "a formula with results of several types",
}


def violation(rule: str, severity: str, type_name: str | None, field: str | None = None, message: str | None = None, details: object = None) -> tuple:
    return severity, message or RULES[rule], rule, type_name, field, None if details is None else json.dumps(details, ensure_ascii=False)


def _shape(df: DataFrame, rule: str, severity: str, message: Column, details: Column | None) -> DataFrame:
    none = F.lit(None).cast("string")
    field = F.col("field") if "field" in df.columns else none
    return df.select(F.lit(severity).alias("severity"), message.alias("message"), F.lit(rule).alias("rule"), F.col("type").alias("type_name"), field.alias("field_name"), (none if details is None else details).alias("details"))


def structure(owner) -> list[tuple]:
    """S-1 to S-3 and S-5 of types, from the types and base files."""
    layout, out = owner.layout, []
    if layout is None:
        return out
    types = set(owner.schema.types)
    if layout.base_files is None:
        out.append(violation("S-2", "warning", None))
    else:
        out += [violation("S-1", "error", t) for t in sorted(types - set(layout.base_files))]
        out += [violation("S-3", "warning", t) for t in sorted(set(layout.base_files) - set(layout.types))]
    out += [violation("S-5", "warning", t, None, f"{RULES['S-5']}: {t}", {"name": t}) for t in layout.types if re.search(INVALID, t) or unicodedata.normalize("NFC", t) != t]
    return out


def strange_entries(owner) -> list[DataFrame]:
    """S-4: folders and other files among a type's notes."""
    if owner.entries is None:
        return []
    odd = owner.entries.where("kind = 'odd'")
    return [_shape(odd, "S-4", "warning", F.concat(F.lit(RULES["S-4"] + ": "), "name"), F.to_json(F.struct(F.col("name").alias("entry"))))]


def portable_names(owner) -> DataFrame:
    """S-5: record names that aren't portable or not composed."""
    from ..functions.python_text import nfc

    names = relations.records(owner.tables).select(F.col("folder").alias("type"), "name")
    # Only names beyond ASCII can be decomposed: the others don't leave the JVM.
    plain = names.where(F.col("name").rlike(INVALID))
    other = names.where(~F.col("name").rlike(INVALID) & F.col("name").rlike(r"[^\x00-\x7F]")).where(nfc(F.col("name")) != F.col("name"))
    bad = plain.unionByName(other)
    return _shape(bad, "S-5", "warning", F.concat(F.lit(RULES["S-5"] + ": "), "name"), F.to_json(F.struct("name")))


def _present(owner, name: str) -> DataFrame:
    """(_record, present): the keys that each record has, with or without a value; of a plain table the columns with one."""
    if name in owner.files:
        return owner.files[name].select("_record", "present")
    own = [f.name for f in owner.schema.types[name].fields if f.type != FieldType.FORMULA]
    return owner.tables[name].select("_record", F.array_compact(F.array(*[F.when(F.col(f"`{c}`").isNotNull(), c) for c in own])).alias("present"))


def homogeneity(owner, threshold: float = 0.0, details: bool = True) -> list[DataFrame]:
    """R-1: of fields that more than threshold of the records lack or have. details lists the records of either side; without it only counts are kept."""
    out = []
    for name, ts in owner.schema.types.items():
        own = [f.name for f in ts.fields if f.type != FieldType.FORMULA]
        if not own:
            continue
        has = lambda c: F.coalesce(F.array_contains("present", c), F.lit(False))
        each = F.array(*[F.struct(F.lit(c).alias("field"), has(c).alias("has")) for c in own])
        long = _present(owner, name).select("_record", F.explode(each).alias("x")).select("_record", "x.*")
        lists = [F.sort_array(F.collect_list(F.when(F.col("has"), F.col("_record")))).alias("present"), F.sort_array(F.collect_list(F.when(~F.col("has"), F.col("_record")))).alias("missing")] if details else []
        counts = long.groupBy("field").agg(F.count("*").alias("total"), F.sum(F.col("has").cast("int")).alias("n"), *lists).withColumn("type", F.lit(name))
        share = F.col("n") / F.col("total")
        bad = counts.where(F.least(share, 1 - share) > threshold)
        said = F.concat(F.lit("Field '"), "field", F.lit("' present in "), F.bround(share * 100, 1).cast("string"), F.lit("% of records ("), F.col("n").cast("string"), F.lit("/"), F.col("total").cast("string"), F.lit(")"))
        out.append(_shape(bad, "R-1", "warning", said, F.to_json(F.struct("present", "missing")) if details else None))
    return out


def drift(owner, details: bool = True) -> list[DataFrame]:
    """R-2: kinds of values beside each other in fields that hold no links; dates count as text. Typed tables have none. details lists the records of each kind; without it only counts are kept."""
    if owner.cells is None:
        return []
    skip = [(n, f.name) for n, ts in owner.schema.types.items() for f in ts.fields if f.effective_type in LINK_TYPES or f.type == FieldType.FORMULA]
    cells = owner.cells.where("field is not null and kind <> 'null'")
    if skip:
        cells = cells.join(F.broadcast(owner.spark.createDataFrame(skip, "type string, field string")), ["type", "field"], "left_anti")
    python = F.when(F.col("kind").isin("date", "datetime"), "str").when(F.col("kind") == "map", "dict").otherwise(F.col("kind"))
    kinds = cells.groupBy("type", "field", python.alias("k")).agg(_held("record", details).alias("records"))
    bad = kinds.groupBy("type", "field").agg(F.sort_array(F.collect_list(F.struct("k", "records"))).alias("by")).where(F.size("by") > 1)
    said = F.concat(F.lit(RULES["R-2"] + ", '"), "field", F.lit("': "), F.array_join(F.transform("by", lambda x: x["k"]), ", "))
    return [_shape(bad, "R-2", "warning", said, F.to_json(F.map_from_entries("by")))]


def _held(column: str, details: bool) -> Column:
    return F.sort_array(F.collect_list(column)) if details else F.count(column)


def link_rules(owner, details: bool = True) -> list[DataFrame]:
    """R-3, R-4 and R-6 over the edges as loaded."""
    e = relations.edges(owner.raw_tables, owner.raw_schema).where("folder is not null").select(F.col("src_type").alias("type"), "src", "field", "folder", "name", "raw")
    known = owner.spark.createDataFrame([(n,) for n in owner.raw_schema.types], "folder string")
    on_disk = relations.records(owner.tables if owner.layout is None else {n: f.select("_record") for n, f in owner.files.items()})
    return edge_rules(e, known, on_disk, details)


def edge_rules(e: DataFrame, known: DataFrame, on_disk: DataFrame, details: bool = True) -> list[DataFrame]:
    """R-3, R-4 and R-6 over edges (type, src, field, folder, name, raw), the known types (folder) and their records (folder, name). details lists records and links; without it only counts are kept."""
    folders = e.groupBy("type", "field", "folder").agg(_held("src", details).alias("records"))
    several = folders.groupBy("type", "field").agg(F.sort_array(F.collect_list(F.struct("folder", "records"))).alias("by")).where(F.size("by") > 1)
    said = F.concat(F.lit(RULES["R-3"] + ", '"), "field", F.lit("': "), F.array_join(F.transform("by", lambda x: x["folder"]), ", "))
    r3 = _shape(several, "R-3", "warning", said, F.to_json(F.map_from_entries("by")))
    types = F.broadcast(known)  # a row for each type
    strange = e.join(types, "folder", "left_anti")
    orphaned = e.join(types, "folder", "left_semi").join(on_disk, ["folder", "name"], "left_anti")
    out = [r3]
    for rule, bad in (("R-4", strange), ("R-6", orphaned)):
        if details:
            fields = bad.groupBy("type", "src", "field").agg(F.collect_list("raw").alias("links"))
            rows = fields.groupBy("type", "src").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("field", "links")))).alias("fields"))
            found = rows.groupBy("type").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("src", "fields")))).alias("d"))
        else:
            found = bad.groupBy("type").agg(F.to_json(F.struct(F.count("*").alias("links"))).alias("d"))
        out.append(_shape(found, rule, "warning", F.lit(RULES[rule]), F.col("d")))
    return out


def pair_rules(owner) -> list[DataFrame]:
    out = []
    for pair in owner.pairs:
        sides = [relations.split_pair(s, owner.schema) for s in pair]
        lacking = relations.missing_backlinks(owner.tables, owner.schema, pair).groupBy("side", "record").agg(F.sort_array(F.collect_list("missing")).alias("missing"))
        total = lacking.groupBy("side").agg(F.sum(F.size("missing")).alias("n"), F.count("*").alias("records"), F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct("record", "missing"))))).alias("d"))
        pick = lambda i, sides=sides: F.when(F.col("side") == 0, sides[0][i]).otherwise(sides[1][i])
        named = total.withColumn("type", pick(0)).withColumn("field", pick(1))
        said = F.concat("type", F.lit("."), "field", F.lit(": "), F.col("n").cast("string"), F.lit(" backlinks missing across "), F.col("records").cast("string"), F.lit(" records"))
        out.append(_shape(named, "R-5", "suggestion", said, F.col("d")))
    return out


def formula_rules(owner) -> list[tuple]:
    """F-1 to F-3, from the formulas' texts."""
    out = []
    for name, ts in owner.schema.types.items():
        own = {f.name: f.formula for f in ts.fields if f.type == FieldType.FORMULA and f.formula}
        stored = {f.name for f in ts.fields}
        _, cyclic = order(own)
        for field, text in own.items():
            why = owner.faults.get((name, field), "")
            try:
                tree = expr.parse(text)
                unknown = sorted({n.value for n in walk(tree) if n.kind == "dot" and n.items[0].kind == "name" and n.items[0].value == "note"} - stored)
            except expr.SyntaxFault as e:
                unknown, why = [], why or f"F-1: {e}"
            if why.startswith("F-1"):
                out.append(violation("F-1", "warning", name, field, f"{RULES['F-1']}: {text}"))
            out += [violation("F-2", "warning", name, field, f"{RULES['F-2']}: {u}") for u in unknown]
            if field in cyclic:
                out.append(violation("F-3", "error", name, field))
    return out


def output_rule(owner) -> list[DataFrame]:
    """F-4: formulas without one type that have values."""
    out = []
    for name, ts in owner.schema.types.items():
        own = [f.name for f in ts.fields if f.type == FieldType.FORMULA and f.effective_type == FieldType.UNKNOWN and f.name in owner.tables[name].columns]
        for field in own:
            some = owner.tables[name].where(F.col(f"`{field}`").isNotNull()).limit(1).select(F.lit(name).alias("type"), F.lit(field).alias("field"))
            out.append(_shape(some, "F-4", "warning", F.lit(RULES["F-4"]), None))
    return out


def lint(owner, homogeneity_threshold: float = 0.0, details: bool = True) -> DataFrame:
    """All violations of a collection (VIOLATIONS). details=False keeps counts instead of the lists of records of R-1 to R-4 and R-6, which grow with a type."""
    spark: SparkSession = owner.spark
    known = spark.createDataFrame([*structure(owner), *formula_rules(owner)], VIOLATIONS)
    parts = [known, *strange_entries(owner), portable_names(owner), *homogeneity(owner, homogeneity_threshold, details), *drift(owner, details), *link_rules(owner, details), *output_rule(owner), *pair_rules(owner)]
    return reduce(DataFrame.unionByName, parts)


def counts(violations: DataFrame) -> DataFrame:
    return violations.groupBy("rule").agg(F.count("*").alias("violations"))
