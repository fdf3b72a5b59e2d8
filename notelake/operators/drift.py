"""Schemas that drift between files: similarity flooding over schema graphs.

Each file's schema is a small graph: the file, its fields, their types and the parts of their names (which carry the
nesting, ``a.b``). For a file and the one before it, pairs of nodes that are reached over edges of one kind form the
pairwise connectivity graph; match scores, seeded with spelling and with values that agree under the same record
name, flow along it until they settle. Consistent correspondences are selected from the scores. A rename is a
correspondence that the values bear out; what they refute is known to the next flood, which goes over the rest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship, written

#: The share of common records that must agree for a rename, as a fraction.
AGREE, OF = 9, 10

#: How little the scores still move when a flood has settled.
SETTLED = 1e-4

#: A pair is selected if its score is at least this share of the best scores of both its fields.
NEAR_BEST = 0.9

FILE = ["vault_id", "type_name", "file_no", "file_id"]

#: What a value of a kind adds to the mask of its field.
KINDS = {"boolean": 1, "integer": 2, "number": 4, "list": 8, "link": 16, "string": 32, "object": 64}


def _objects(raw: DataFrame) -> DataFrame:
    """raw with m, the entries of the JSON object in fields; other rows have none and are left out."""
    return raw.where("fields is not null").withColumn("m", F.try_parse_json("fields").try_cast("map<string,variant>")).where("m is not null")


def _kind(text: Column) -> Column:
    """The kind of a value, told by its canonical JSON; null where it is empty."""
    first = F.substring(text, 1, 1)
    return (
        F.when(text.isNull() | text.isin("null", '""', "[]"), None)
        .when(first == '"', F.when(text.startswith('"[[') & text.endswith(']]"') & (F.char_length(text) >= 6), "link").otherwise("string"))
        .when(first.isin("t", "f"), "boolean")
        .when(first == "[", "list")
        .when(first == "{", "object")
        .otherwise(F.when(text.rlike(r"^-?[0-9]+\z"), "integer").otherwise("number"))
    )


def cells(raw: DataFrame) -> DataFrame:
    """(raw_id, FILE, name, field_name, kind, value) for each key of each row's JSON object; value is canonical JSON, null where it is empty.

    Rows repeated under another raw_id are taken once, with the lowest. A text that is no JSON object has no fields.
    """
    once = raw.where("fields is not null").groupBy(*FILE, "name", "fields").agg(F.min("raw_id").alias("raw_id"))
    each = _objects(once).select("raw_id", *FILE, "name", F.explode("m").alias("field_name", "x")).withColumn("value", F.to_json("x")).withColumn("kind", _kind(F.col("value")))
    return each.select("raw_id", *FILE, "name", "field_name", "kind", F.when(F.col("kind").isNotNull(), F.col("value")).alias("value"))


def mask(kind: Column) -> Column:
    """An aggregate: the kinds of all values together, 0 for none."""
    return F.bit_or(F.coalesce(*[F.when(kind == k, F.lit(bit)) for k, bit in KINDS.items()], F.lit(0)))


def field_type(kinds: Column) -> Column:
    """The one type of all non-empty values, from their mask()."""
    return F.when(kinds == 1, "boolean").when(kinds == 2, "integer").when(kinds.isin(4, 6), "number").when(kinds == 8, "list").when(kinds == 16, "link").when(kinds.isin(32, 48), "string").otherwise("unknown")


def schemas(raw: DataFrame) -> DataFrame:
    """FILE and its fields, an array of (field_name, type) by name; as long as a schema is wide. Read from raw in one pass, summed up before the shuffle."""
    each = _objects(raw).select(*FILE, F.explode("m").alias("field_name", "x")).select(*FILE, "field_name", _kind(F.to_json("x")).alias("kind"))
    fields = each.groupBy(*FILE, "field_name").agg(field_type(mask(F.col("kind"))).alias("type"))
    return fields.groupBy(*FILE).agg(F.sort_array(F.collect_list(F.struct("field_name", "type"))).alias("fields"))


def transitions(files: DataFrame) -> DataFrame:
    """Each file beside the file with file_no one lower: earlier and later fields, gone and fresh names."""
    before = files.select("vault_id", "type_name", (F.col("file_no") + 1).alias("file_no"), F.col("file_id").alias("earlier_id"), F.col("fields").alias("earlier"))
    both = files.withColumnRenamed("fields", "later").join(before, ["vault_id", "type_name", "file_no"])
    names = lambda c: F.transform(c, lambda f: f["field_name"])
    return both.withColumn("gone", F.array_except(names("earlier"), names("later"))).withColumn("fresh", F.array_except(names("later"), names("earlier")))


def evidence(raw: DataFrame, moves: DataFrame) -> DataFrame:
    """(file_id, old, new, agree, both): for pairs of a gone and a fresh field that agree in some record name; both: the names with a value on each side.

    Only files that lose one field and gain another are read for it, and of them only those fields.
    """
    sides = moves.where((F.size("gone") > 0) & (F.size("fresh") > 0)).select(
        "file_id", F.inline(F.array(F.struct(F.col("earlier_id").alias("source"), F.lit("old").alias("side"), F.col("gone").alias("names")), F.struct(F.col("file_id").alias("source"), F.lit("new").alias("side"), F.col("fresh").alias("names"))))
    )
    rows = _objects(raw.where("name is not null")).select(F.col("file_id").alias("source"), "name", "m")
    each = rows.join(sides, "source").select("file_id", "side", "name", "m", F.explode("names").alias("field_name")).select("file_id", "side", "name", "field_name", F.to_json(F.try_element_at("m", "field_name")).alias("value"))
    held = written(each.where(_kind(F.col("value")).isNotNull()), "evidence")
    old = held.where("side = 'old'").select("file_id", F.col("field_name").alias("old"), "name", "value").distinct()
    new = held.where("side = 'new'").select("file_id", F.col("field_name").alias("new"), "name", "value").distinct()
    agree = old.join(new, ["file_id", "name", "value"]).groupBy("file_id", "old", "new").agg(F.count_distinct("name").alias("agree"))
    a = old.select("file_id", "old", "name").distinct()
    b = new.select("file_id", "new", "name").distinct()
    return agree.join(a, ["file_id", "old"]).join(b, ["file_id", "new", "name"]).groupBy("file_id", "old", "new", "agree").agg(F.count("*").alias("both"))


def _trigrams(name: str) -> set[str]:
    padded = f"  {name.lower()} "
    return {padded[i : i + 3] for i in range(len(padded) - 2)}


def _spelling(a: str, b: str) -> float:
    x, y = _trigrams(a), _trigrams(b)
    return 2 * len(x & y) / (len(x) + len(y))


def flood(earlier: list[tuple[str, str]], later: list[tuple[str, str]], seeds: dict[tuple[str, str], float]) -> np.ndarray:
    """Scores of all pairs of fields, settled, between 0 and 1.

    Each round adds the same positive scores and norms, so that rounds draw nearer to each other and the flood always settles.
    """
    n, m = len(earlier), len(later)
    types = sorted({t for _, t in earlier} | {t for _, t in later})
    start = np.array([[0.75 * max(_spelling(a, b), seeds.get((a, b), 0.0)) + 0.25 * _spelling(a, b) for b, _ in later] for a, _ in earlier]).reshape(n, m)
    of_a = np.array([[t == u for u in types] for _, t in earlier], dtype=float).reshape(n, -1)
    of_b = np.array([[t == u for u in types] for _, t in later], dtype=float).reshape(m, -1)
    kin = np.eye(len(types))
    for a, b in (("integer", "number"), ("link", "string")):
        if a in types and b in types:
            kin[types.index(a), types.index(b)] = kin[types.index(b), types.index(a)] = 0.5
    # Outgoing edges of one kind share a weight of 1: type to its pairs of fields, file to all of them, parent to children.
    share = of_a.T @ np.ones((n, m)) @ of_b
    share[share == 0] = 1
    top = [a.rpartition(".")[0] for a, _ in earlier], [b.rpartition(".")[0] for b, _ in later]
    place_a, place_b = {a: i for i, (a, _) in enumerate(earlier)}, {b: j for j, (b, _) in enumerate(later)}
    nested = [(place_a.get(p), place_b.get(q), i, j) for i, p in enumerate(top[0]) if p for j, q in enumerate(top[1]) if q]
    nested = [x for x in nested if x[0] is not None and x[1] is not None]
    fields, kinds, root = start.copy(), kin.copy(), 1.0
    moved = 1.0
    while moved >= SETTLED:
        f = start + fields + of_a @ ((kin + kinds) / share) @ of_b.T + (1 + root) / (n * m)
        for p, q, i, j in nested:
            f[i, j] += fields[p, q]
            f[p, q] += fields[i, j]
        k = kin + kinds + of_a.T @ (start + fields) @ of_b / max(n, m)
        r = 1 + root + (start + fields).sum() / (n * m)
        top_score = max(f.max(), k.max(), r)
        f, k, r = f / top_score, k / top_score, r / top_score
        moved = np.sqrt(((f - fields) ** 2).sum() + ((k - kinds) ** 2).sum() + (r - root) ** 2)
        fields, kinds, root = f, k, r
    return fields / fields.max()


def select(earlier: list[tuple[str, str]], later: list[tuple[str, str]], seeds: dict[tuple[str, str], tuple[int, int]]) -> list[tuple[str, str, float, int, bool]]:
    """The correspondences (old, new, score, flood, holds) of the fields that only one side has.

    A flood is seeded with spelling and with the share of names whose values agree (seeds: agree, both). The pairs whose
    score is near the best of both fields are selected, and the rule holds them or not. Held and refuted pairs then
    are known, as scores of 1 and 0, and the next flood goes over the rest, until it selects nothing more that any value
    supports. Every supported pair is thus selected by some flood: flood tells by which, 1 for most.
    """
    same = {a for a, _ in earlier} & {b for b, _ in later}
    shares, known, out, n = {p: agree / both for p, (agree, both) in seeds.items()}, set(), [], 0
    place = {(a, b): (i, j) for i, (a, _) in enumerate(earlier) if a not in same for j, (b, _) in enumerate(later) if b not in same}
    while True:
        n += 1
        scores = flood(earlier, later, shares)
        left = {p: float(scores[at]) for p, at in place.items() if p not in known}
        best: dict[tuple[int, str], float] = {}
        for (a, b), score in left.items():
            best[0, a], best[1, b] = max(best.get((0, a), 0.0), score), max(best.get((1, b), 0.0), score)
        picked = sorted(p for p, score in left.items() if score >= NEAR_BEST * max(best[0, p[0]], best[1, p[1]]))
        for p in picked:
            agree, both = seeds.get(p, (0, 1))
            holds = agree * OF >= both * AGREE
            known.add(p)
            shares[p] = float(holds)
            out.append((*p, left[p], n, holds))
        if not any(p in seeds for p in left if p not in known):
            return out


def _matched(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for row in batch.itertuples(index=False):
            pairs = [[(f["field_name"], f["type"]) for f in side] for side in (row.earlier, row.later)]
            seeds = {(s["old"], s["new"]): (s["agree"], s["both"]) for s in row.seeds} if row.seeds is not None else {}
            out += [(row.file_id, *found) for found in select(*pairs, seeds)]
        yield pd.DataFrame(out, columns=["file_id", "old", "new", "score", "flood", "holds"])


def correspondences(moves: DataFrame, seeds: DataFrame) -> DataFrame:
    """(file_id, old, new, score, flood, holds) of gone and fresh fields, as select() finds them, a file at a time."""
    ship(moves.sparkSession)
    listed = seeds.groupBy("file_id").agg(F.collect_list(F.struct("old", "new", "agree", "both")).alias("seeds"))  # at most a schema's width squared
    graph = moves.where((F.size("gone") > 0) & (F.size("fresh") > 0)).select("file_id", "earlier", "later").join(listed, "file_id", "left")
    tasks = 2 * int(moves.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # the bytes are few, the floods are the work; another number than the join's, else Spark merges the two
    return graph.repartition(tasks, "file_id").mapInPandas(_matched, "file_id long, old string, new string, score double, flood int, holds boolean")


def drift(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The changes of each file (file_id, change_kind, field_name, old_name, old_type, new_type, score) and the transitions they are found in."""
    moves = written(transitions(written(schemas(raw), "schemas")), "moves")  # a transition reads the schemas twice
    matched = correspondences(moves, evidence(raw, moves)).where("holds")
    renames = matched.groupBy("file_id").agg(F.collect_list(F.struct("old", "new", "score")).alias("renames"))  # at most a schema's width squared
    both = moves.join(renames, "file_id", "left").withColumns({"was": F.map_from_entries("earlier"), "now": F.map_from_entries("later"), "renames": F.coalesce("renames", F.array().cast("array<struct<old:string,new:string,score:double>>"))})
    was, now, none = F.col("was"), F.col("now"), F.lit(None).cast("string")

    def change(kind: str, name: Column, old: Column, old_type: Column, new_type: Column, score: Column | None = None) -> Column:
        return F.struct(F.lit(kind).alias("change_kind"), name.alias("field_name"), old.alias("old_name"), old_type.alias("old_type"), new_type.alias("new_type"), (F.lit(None).cast("double") if score is None else score).alias("score"))

    left = F.array_except("gone", F.transform("renames", lambda r: r["old"]))
    come = F.array_except("fresh", F.transform("renames", lambda r: r["new"]))
    kept = F.filter(F.map_keys(was), lambda n: now[n].isNotNull() & (now[n] != was[n]))
    said = F.concat(
        F.transform("renames", lambda r: change("renamed", r["new"], r["old"], was[r["old"]], now[r["new"]], r["score"])),
        F.transform(left, lambda n: change("removed", n, none, was[n], none)),
        F.transform(come, lambda n: change("added", n, none, none, now[n])),
        F.transform(kept, lambda n: change("retyped", n, none, was[n], now[n])),
    )
    return both.select("file_id", F.explode(said).alias("c")).select("file_id", "c.*"), moves


def changes(raw: DataFrame) -> DataFrame:
    """(file_id, change_kind, field_name): added, removed, renamed (by its new name) and retyped fields against the file before.

    Spelling counts exactly. Values are compared as JSON. A row with null or malformed fields has none; a null name
    takes part in types, not in renames. A field that is renamed to two, or two to one, comes out for each new name once.
    """
    return drift(raw)[0].select("file_id", "change_kind", "field_name").distinct()


def one_to_one(renames: list[tuple[float, str, str]]) -> dict[str, str]:
    """New names by old ones, of (score, old, new): the higher score first, then by name, each name once."""
    moved: dict[str, str] = {}
    taken: set[str] = set()
    for _, old, new in sorted((-score, old, new) for score, old, new in renames):
        if old not in moved and new not in taken:
            moved[old] = new
            taken.add(new)
    return moved


def _chains(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The last name of each field of each file, along the renames of its collection and type: files come latest first, and only the names of the one after are kept."""
    at, after, own = None, ({}, {}), ({}, {})  # final names and renames of the file number after, and of this one
    for batch in batches:
        out = []
        for row in batch.itertuples(index=False):
            here = (row.vault_id, row.type_name, row.file_no)
            if here != at:
                follows = at is not None and at[:2] == here[:2] and at[2] - here[2] == 1
                at, after, own = here, own if follows else ({}, {}), ({}, {})
            for name in row.fields:
                now = after[1].get(name, name)
                own[0][name] = after[0].get(now, now)
                out.append((*here, name, own[0][name]))
            own[1].update(one_to_one([(r["score"], r["old"], r["new"]) for r in (row.renames if row.renames is not None else ())]))
        yield pd.DataFrame(out, columns=["vault_id", "type_name", "file_no", "field_name", "column_name"])


def unified(raw: DataFrame) -> DataFrame:
    """All rows of all files in one schema for each type: (raw_id, vault_id, type_name, file_id, name, column_name, column_type, value, whole, number).

    column_name is the last name a field was given in its collection; of renames that share a field the one with the higher score
    counts, then by name, so that no two fields of a row share a column. column_type the one type that holds all its
    values in the type: integers and numbers are numbers, links and strings strings, any other mix is string. value
    is canonical text (strings without quotes); whole is the value of integer columns (null beyond 64 bits), number that of
    number columns.
    """
    report, moves = drift(raw)
    values = written(cells(raw), "cells")
    renames = report.where("change_kind = 'renamed'").groupBy("file_id").agg(F.collect_list(F.struct("score", F.col("old_name").alias("old"), F.col("field_name").alias("new"))).alias("renames"))  # at most a schema's width squared
    files = values.groupBy(*FILE).agg(F.sort_array(F.collect_set("field_name")).alias("fields")).join(renames, "file_id", "left")
    latest_first = files.repartition("vault_id", "type_name").sortWithinPartitions("vault_id", "type_name", F.desc("file_no"), "file_id")  # schemas, not rows
    named = latest_first.mapInPandas(_chains, "vault_id long, type_name string, file_no int, field_name string, column_name string").distinct()
    placed = values.join(named, ["vault_id", "type_name", "file_no", "field_name"])
    kind = field_type(mask(F.col("kind")))
    types = placed.groupBy("type_name", "column_name").agg(F.when(kind == "unknown", "string").otherwise(kind).alias("column_type"))
    text = F.when(F.col("kind").isin("string", "link"), F.get_json_object(F.concat(F.lit('{"v":'), F.col("value"), F.lit("}")), "$.v")).otherwise(F.col("value"))
    whole, number = F.when(F.col("column_type") == "integer", F.col("value").try_cast("bigint")), F.when(F.col("column_type") == "number", F.col("value").try_cast("double"))
    return placed.join(types, ["type_name", "column_name"]).select("raw_id", "vault_id", "type_name", "file_id", "name", "column_name", "column_type", text.alias("value"), whole.alias("whole"), number.alias("number"))


def _as_type(value: Column, kind: str) -> Column:
    if kind == "array<string>":
        return F.from_json(value, kind)
    return value if kind == "string" else value.try_cast(kind)


def wide(raw: DataFrame, type_name: str) -> tuple[DataFrame, list[tuple[str, str, str]]]:
    """The table of a type, and its columns after the first four as (name there, column_name, Spark type).

    One row for each row of raw, repeated ones once: raw_id, vault_id, file_id, name, then a column for each column_name of
    unified(), by name; null where the row has no value. Booleans, numbers (double) and lists (array<string>, items that are no
    strings as JSON) come as such, integers as bigint, or decimal(38,0) where one is larger, all else as string. A row without
    fields is a row of nulls. A column called like one before it, without regard to case, gets a trailing underscore.
    """
    own = raw.where(F.col("type_name") == type_name)
    keys = ["raw_id", "vault_id", "file_id", "name"]
    values = written(unified(own).select(*keys, "column_name", "column_type", "value"), "unified")
    large = F.bool_or(F.col("value").isNotNull() & F.col("value").try_cast("bigint").isNull())
    found = values.groupBy("column_name", "column_type").agg(large.alias("large")).collect()  # a schema, not rows
    taken, columns = set(keys), []
    for r in sorted(found, key=lambda r: r["column_name"]):
        name = r["column_name"]
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        kinds = {"boolean": "boolean", "integer": "decimal(38,0)" if r["large"] else "bigint", "number": "double", "list": "array<string>"}
        columns.append((name, r["column_name"], kinds.get(r["column_type"], "string")))
    rows = own.groupBy(*FILE, "name", "fields").agg(F.min("raw_id").alias("raw_id")).select(*keys)
    cols = [_as_type(F.max(F.when(F.col("column_name") == c, F.col("value"))), kind).alias(name) for name, c, kind in columns]
    every = rows.unionByName(values.drop("column_type"), allowMissingColumns=True)
    return (every.groupBy(*keys).agg(*cols) if cols else rows), columns


def wide_table(raw: DataFrame, type_name: str) -> DataFrame:
    """The table of wide()."""
    return wide(raw, type_name)[0]


def melted(raw: DataFrame, type_name: str) -> DataFrame:
    """The table of wide() as rows, for comparison: raw_id, vault_id, type_name, column_name, column_type (Spark's), value; lists joined by |."""
    table, columns = wide(raw, type_name)
    text = lambda name, kind: F.array_join(F.col(f"`{name}`"), "|") if kind == "array<string>" else F.col(f"`{name}`").cast("string")
    each = [F.struct(F.lit(c).alias("column_name"), F.lit(kind).alias("column_type"), text(name, kind).alias("value")) for name, c, kind in columns]
    return table.select("raw_id", "vault_id", F.lit(type_name).alias("type_name"), F.inline(F.array(*each))) if each else table.sparkSession.createDataFrame([], "raw_id long, vault_id long, type_name string, column_name string, column_type string, value string")
