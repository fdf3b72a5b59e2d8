"""Writing back: new records, a new column, a new type, as Markdown files.

A batch is checked as a whole before anything is written; files are then written by the executors, each by one task,
under the collection's root, which they must share.
"""

from __future__ import annotations

import os
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import links
from ..model import LIST_TYPES
from ..session import ship, written
from ..sources.markdown import BODY, split_note

#: Fixed value: characters that a note's name can't have.
FORBIDDEN = re.compile(r"[\[\]:\\/^|#]")


class StaleError(RuntimeError):
    pass


@dataclass(frozen=True)
class Receipt:
    """What became of one input row: written, skipped or failed, and what was changed or ignored on the way."""

    filename: str | None
    status: str
    warnings: tuple[str, ...] = ()


def clean_name(name: str) -> str:
    """A name that a note can have: composed, forbidden characters as _, no dots or spaces at its ends, never empty."""
    return FORBIDDEN.sub("_", unicodedata.normalize("NFC", name)).strip(". ") or "_"


def rows_of(data) -> list[dict]:
    """Rows of a list of dicts, dict of lists, pandas or polars frame or series, or Spark DataFrame."""
    if isinstance(data, DataFrame):
        return [r.asDict(recursive=True) for r in data.collect()]  # a batch to be written as files, one each
    if isinstance(data, list):
        return [dict(r) for r in data]
    if isinstance(data, dict):
        lists = {k: list(v) for k, v in data.items()}
        if len({len(v) for v in lists.values()}) > 1:
            raise ValueError("the columns have different lengths")
        return [dict(zip(lists, values)) for values in zip(*lists.values())]
    if isinstance(data, pd.Series):
        return [{data.name: x} for x in data]
    if isinstance(data, pd.DataFrame):
        return data.to_dict("records")
    if hasattr(data, "to_dicts"):
        return data.to_dicts()
    if hasattr(data, "to_list"):
        return [{data.name: x} for x in data.to_list()]
    raise TypeError(f"no rows in {type(data).__name__}")


def column_of(data) -> dict:
    """Values by record: a dict, a pandas series (by index), a two-column DataFrame (record, value); any other series by position."""
    if isinstance(data, dict):
        return dict(data)
    if isinstance(data, pd.Series):
        return dict(zip(data.index, data))
    if isinstance(data, DataFrame):
        return {r[0]: r[1] for r in data.collect()}
    if hasattr(data, "to_list"):
        return dict(enumerate(data.to_list()))
    raise TypeError(f"no column in {type(data).__name__}")


def normal(value: object) -> object:
    """Nothing for None, not-a-number, a missing time or an empty list; an empty text stays."""
    if isinstance(value, (list, tuple)) or hasattr(value, "tolist") and not isinstance(value, (str, bytes)):
        plain = value.tolist() if hasattr(value, "tolist") else list(value)
        return (plain or None) if isinstance(plain, list) else normal(plain)
    if value is None or value is pd.NaT or value is pd.NA or isinstance(value, float) and value != value:
        return None
    if isinstance(value, pd.Timestamp):
        return value.to_pydatetime()
    return value


def front_matter(fields: dict[str, object]) -> str:
    """YAML of fields in their order; a field without value is a bare key."""
    import yaml

    class Dumper(yaml.SafeDumper):
        pass

    Dumper.add_representer(type(None), lambda d, _: d.represent_scalar("tag:yaml.org,2002:null", ""))
    return yaml.dump(fields, Dumper=Dumper, sort_keys=False, allow_unicode=True, width=10**9) if fields else ""


def note(fields: dict[str, object], body: str | None = None) -> str:
    return f"---\n{front_matter(fields)}---\n" + (f"\n{body}\n" if body else "")


def with_property(content: str, name: str, value: object) -> str:
    """A note with a property set; every other byte stays. A new property comes last; one that is there gives way with its continuation lines."""
    lines = content.split("\n")
    new = front_matter({name: value}).rstrip("\n").split("\n")
    if not lines or lines[0].strip() != "---":
        return "\n".join(["---", *new, "---", content])
    end = next((i for i in range(1, len(lines)) if lines[i].strip() == "---"), None)
    if end is None:
        return "\n".join(["---", *new, "---", content])
    key = re.compile(rf"(?:{re.escape(name)}|'{re.escape(name)}'|\"{re.escape(name)}\")\s*:(?:\s|$)")
    for i in range(1, end):
        if key.match(lines[i]):
            stop = i + 1
            while stop < end and (not lines[stop].strip() or lines[stop][0] in " \t#" or lines[stop].startswith("- ") or lines[stop] == "-"):
                stop += 1
            return "\n".join([*lines[:i], *new, *lines[stop:]])
    return "\n".join([*lines[:end], *new, *lines[end:]])


def base_file(type_name: str, columns: list[str], data: str) -> str:
    import yaml

    doc = {"filters": {"and": [f'file.inFolder("{data}/{type_name}")']}, "views": [{"type": "table", "name": type_name, "order": ["file.name", *columns]}]}
    return yaml.safe_dump(doc, sort_keys=False, allow_unicode=True)


def save_files(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Write (path, content) rows as files, each whole or not at all."""
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"]):
            os.makedirs(os.path.dirname(path), exist_ok=True)
            draft = f"{path}.draft{os.getpid()}"
            with open(draft, "w", encoding="utf-8", newline="") as f:
                f.write(content)
            os.replace(draft, path)
        yield batch[["path"]]


class Writer:
    def __init__(self, owner) -> None:
        self.owner = owner

    def _begin(self) -> None:
        if self.owner.layout is None:
            raise ValueError("only a collection from a folder can be written to")
        if self.owner.is_stale:
            raise StaleError("the folder has changed since it was loaded; reload() first")

    def _folder(self, type_name: str) -> str:
        return os.path.join(self.owner.layout.root, self.owner.layout.data, type_name)

    def _write(self, files: dict[str, str]) -> None:
        if files:
            ship(self.owner.spark)
            self.owner.spark.createDataFrame(list(files.items()), "path string, content string").repartition(min(len(files), 64)).mapInPandas(save_files, "path string").count()

    def _prepare(self, rows: list[dict], filename_col: str, taken: set[str], known: set[str] | None, allow_new: bool, on_invalid: str, on_collision: str, on_missing: str):
        """(receipt, fields, body) for each row, in order; rows that fail hold their reason as status."""
        out, used = [], set(taken)
        for row in rows:
            row = {k: normal(v) for k, v in row.items()}
            raw, said = row.pop(filename_col, None), []
            if raw is None or not str(raw).strip():
                out.append((Receipt(None, "skipped" if on_missing == "skip" else "missing filename"), {}, None))
                continue
            name = clean_name(str(raw))
            if name != str(raw):
                if on_invalid == "error":
                    out.append((Receipt(str(raw), "invalid filename"), {}, None))
                    continue
                if on_invalid == "skip":
                    out.append((Receipt(str(raw), "skipped", ("invalid filename",)), {}, None))
                    continue
                said.append("filename_sanitized")
            if name in used:
                if on_collision == "error":
                    out.append((Receipt(name, "name is taken"), {}, None))
                    continue
                if on_collision == "skip":
                    out.append((Receipt(name, "skipped", ("name is taken",)), {}, None))
                    continue
                n = 2
                while f"{name}_{n}" in used:
                    n += 1
                name = f"{name}_{n}"
                said.append("filename_suffixed")
            used.add(name)
            body = row.pop(BODY, None)
            strange = [k for k in row if known is not None and k not in known]
            if strange:
                said.append("new_properties" if allow_new else "dropped_properties")
                if not allow_new:
                    row = {k: v for k, v in row.items() if k not in strange}
            out.append((Receipt(name, "written", tuple(said)), row, body))
        return out

    @staticmethod
    def _refuse(prepared) -> None:
        bad = [f"row {i}: {r.status}" + (f" ({r.filename})" if r.filename else "") for i, (r, _, _) in enumerate(prepared) if r.status not in ("written", "skipped")]
        if bad:
            raise ValueError("nothing was written: " + "; ".join(bad))

    def add_records(self, type_name: str, records, *, filename_col: str, allow_new_properties: bool = True, on_invalid: str = "error", on_collision: str = "error", on_missing_filename: str = "error") -> list[Receipt]:
        """Write a note for each row; receipts in order. on_invalid: error, skip or sanitize; on_collision: error, skip or suffix; on_missing_filename: error or skip.

        With error a single bad row refuses the whole batch. Paired link fields get their links back in the notes they point to.
        """
        self._begin()
        if type_name not in self.owner.schema.types:
            raise KeyError(type_name)
        folder = self._folder(type_name)
        taken = {n.removesuffix(".md") for n in os.listdir(folder) if n.endswith(".md")}
        known = {f.name for f in self.owner.schema.types[type_name].fields}
        prepared = self._prepare(rows_of(records), filename_col, taken, known, allow_new_properties, on_invalid, on_collision, on_missing_filename)
        self._refuse(prepared)
        keys = list(dict.fromkeys(k for r, fields, _ in prepared if r.status == "written" for k in fields))
        files = {f"{folder}/{r.filename}.md": note({k: fields.get(k) for k in keys}, body) for r, fields, body in prepared if r.status == "written"}
        files |= self._reverse(type_name, [(r.filename, fields) for r, fields, _ in prepared if r.status == "written"])
        self._write(files)
        self.owner.reload()
        return [r for r, _, _ in prepared]

    def _reverse(self, type_name: str, new: list[tuple[str, dict]]) -> dict[str, str]:
        """Notes that new records point to by a paired field, with the links back."""
        import yaml

        out: dict[str, str] = {}
        for a, b in self.owner.pairs:
            for own, other in ((a, b), (b, a)):
                own_type, own_field = own.split(".", 1)
                other_type, other_field = other.split(".", 1)
                if own_type != type_name:
                    continue
                for name, fields in new:
                    value = fields.get(own_field)
                    for item in value if isinstance(value, list) else [value]:
                        found = links.parse(item) if isinstance(item, str) else None
                        path = found and f"{self._folder(other_type)}/{found[1]}.md"
                        if not path or not os.path.exists(path):
                            continue
                        if path not in out:
                            with open(path, encoding="utf-8", newline="") as f:
                                out[path] = f.read()
                        there = (yaml.safe_load(split_note(out[path])[0]) or {}).get(other_field)
                        merged = with_links(there, [f"[[{type_name}/{name}]]"])
                        if merged != there:
                            out[path] = with_property(out[path], other_field, merged)
        return out

    def add_table(self, type_name: str, table: DataFrame, *, filename_col: str, allow_new_properties: bool = True, on_invalid: str = "error", on_collision: str = "error", on_missing_filename: str = "error") -> DataFrame:
        """add_records() for a DataFrame of any size: checked, named and written by the executors.

        Gives the receipts (idx, filename, status, warnings) as a table. A taken name's suffix is above those that are in
        use, where add_records() takes the first free one.
        """
        self._begin()
        if type_name not in self.owner.schema.types:
            raise KeyError(type_name)
        rows = written(table.withColumn("__idx", F.monotonically_increasing_id()), "batch")
        raw = F.col(f"`{filename_col}`").cast("string")
        named = rows.select(F.col("__idx").alias("idx"), raw.alias("raw"), sanitized(raw).alias("name"))
        lacks, odd = F.coalesce(F.trim("raw") == "", F.lit(True)), F.col("name") != F.col("raw")
        verdict = F.when(lacks, "skipped" if on_missing_filename == "skip" else "missing filename")
        if on_invalid != "sanitize":
            verdict = F.when(~lacks & odd, "skipped" if on_invalid == "skip" else "invalid filename").otherwise(verdict)
        judged = written(named.withColumn("status", verdict).withColumn("odd", ~lacks & odd), "named")
        taken = self.owner.files[type_name].select(F.col("_record").alias("name"))
        fine = judged.where("status is null").select("idx", "name")
        given = suffixed(fine, taken)
        clash = F.col("filename") != F.col("name")
        said = F.when(clash, {"suffix": "written", "skip": "skipped"}.get(on_collision, "name is taken")).otherwise("written")
        strange = [c for c in table.columns if c not in (filename_col, BODY) and c not in self.owner.schema.types[type_name]]
        notes = F.array_compact(F.array(F.when(F.col("odd"), "filename_sanitized"), F.when(clash & F.lit(on_collision == "suffix"), "filename_suffixed"), F.lit(("new_properties" if allow_new_properties else "dropped_properties") if strange else None)))
        receipts = judged.join(given.select("idx", "filename"), "idx", "left").select("idx", "filename", F.coalesce("status", said).alias("status"), notes.alias("warnings"))
        receipts = written(receipts, "receipts")
        bad = receipts.where("status not in ('written', 'skipped')")
        if not bad.isEmpty():
            raise ValueError(f"nothing was written: {bad.count()} rows, as " + "; ".join(f"{r['status']} ({r['filename']})" for r in bad.take(5)))
        columns = [c for c in table.columns if c != filename_col and (allow_new_properties or c not in strange)]
        new = rows.join(receipts.where("status = 'written'").select(F.col("idx").alias("__idx"), F.col("filename").alias("__file")), "__idx").drop("__idx", filename_col)
        ship(self.owner.spark)
        new.mapInArrow(_noted(self._folder(type_name), columns), "path string").count()
        for a, b in self.owner.pairs:
            for own, other in ((a, b), (b, a)):
                (own_type, field), (other_type, other_field) = own.split(".", 1), other.split(".", 1)
                if own_type != type_name or field not in columns:
                    continue
                kind = dict(table.dtypes)[field]
                each = new.select("__file", F.explode(F.col(f"`{field}`") if kind.startswith("array") else F.array(f"`{field}`")).alias("raw"))
                targets = each.select(links.link_name(F.col("raw").cast("string")).alias("name"), links.as_link(F.lit(type_name), F.col("__file")).alias("link")).where("name is not null")
                known = self.owner.files[other_type].select(F.col("_record").alias("name"), "path")
                back = targets.join(known, "name").groupBy("path").agg(F.collect_set("link").alias("value"))  # a note is rewritten as a whole, by one task
                back.mapInArrow(_patched(other_field, True), "path string").count()
        self.owner.reload()
        return receipts

    def add_column_table(self, type_name: str, table: DataFrame, *, property_name: str, on_existing: str = "error", on_missing: str = "error") -> DataFrame:
        """add_column() for a DataFrame (record, value) of any size; receipts (filename, status) as a table. Of several values of a record the least counts."""
        self._begin()
        record, value = table.columns[:2]
        given = table.groupBy(F.col(f"`{record}`").cast("string").alias("record")).agg(F.min(F.struct(F.col(f"`{value}`").alias("v"))).alias("g"))
        files = self.owner.files[type_name].select(F.col("_record").alias("record"), "path", F.coalesce(F.array_contains("present", property_name), F.lit(False)).alias("there"))
        both = written(files.join(given, "record", "full"), "column")
        faults = F.when(F.col("path").isNull(), "no such record").when(F.col("g").isNull() & F.lit(on_missing == "error"), "no value").when(F.col("g").isNotNull() & F.col("there") & F.lit(on_existing == "error"), "there already")
        bad = both.where(faults.isNotNull())
        if not bad.isEmpty():
            raise ValueError(f"nothing was written: {bad.count()} records, as " + "; ".join(str(r["record"]) for r in bad.take(5)))
        skip = (F.col("there") & (F.col("g").isNull() | F.lit(on_existing == "skip"))) | (F.col("g").isNull() & F.lit(on_missing == "skip"))
        ship(self.owner.spark)
        both.where(~skip).select("path", F.col("g.v").alias("value")).mapInArrow(_patched(property_name, False), "path string").count()
        self.owner.reload()
        return both.select(F.col("record").alias("filename"), F.when(skip, "skipped").otherwise("written").alias("status"))

    def add_column(self, type_name: str, column, *, property_name: str, on_existing: str = "error", on_missing: str = "error") -> list[Receipt]:
        """Set a property in the notes of a type; receipts by record. on_existing: error, skip or overwrite; on_missing (no value for a record): error, skip or default (an empty list for list fields, else a bare key)."""
        self._begin()
        ts = self.owner.schema.types[type_name]
        given = {str(k): normal(v) for k, v in column_of(column).items()}
        present = {r["record"] for r in self.owner.cells.where((F.col("type") == type_name) & (F.col("field") == property_name)).select("record").collect()}
        names = sorted(r["_record"] for r in self.owner.files[type_name].select("_record").collect())
        unknown = sorted(set(given) - set(names))
        lacking = [n for n in names if n not in given]
        there = [n for n in names if n in present and n in given]
        bad = [f"no record {n!r}" for n in unknown] + ([f"no value for {n!r}" for n in lacking] if on_missing == "error" else []) + ([f"{n!r} has {property_name}" for n in there] if on_existing == "error" else [])
        if bad:
            raise ValueError("nothing was written: " + "; ".join(bad))
        default = [] if property_name in ts and ts[property_name].effective_type in LIST_TYPES else None
        files, out = {}, []
        for n in names:
            if n in present and (on_existing == "skip" or n not in given):
                out.append(Receipt(n, "skipped", ("existing",)))
                continue
            if n not in given and on_missing == "skip":
                out.append(Receipt(n, "skipped", ("missing",)))
                continue
            path = f"{self._folder(type_name)}/{n}.md"
            with open(path, encoding="utf-8", newline="") as f:
                files[path] = with_property(f.read(), property_name, given[n] if n in given else default)
            out.append(Receipt(n, "written", () if n in given else ("default",)))
        self._write(files)
        self.owner.reload()
        return out

    def add_type(self, type_name: str, records, *, filename_col: str, on_invalid: str = "error", on_collision: str = "error", on_missing_filename: str = "error") -> list[Receipt]:
        """A new type: its folder, notes and base file. A batch that is refused leaves nothing behind."""
        self._begin()
        folder = self._folder(type_name)
        if type_name in self.owner.schema.types or os.path.exists(folder):
            raise ValueError(f"type {type_name!r} is there already")
        prepared = self._prepare(rows_of(records), filename_col, set(), None, True, on_invalid, on_collision, on_missing_filename)
        self._refuse(prepared)
        keys = list(dict.fromkeys(k for r, fields, _ in prepared if r.status == "written" for k in fields))
        files = {f"{folder}/{r.filename}.md": note({k: fields.get(k) for k in keys}, body) for r, fields, body in prepared if r.status == "written"}
        files[os.path.join(self.owner.layout.root, self.owner.layout.bases, f"{type_name}.base")] = base_file(type_name, keys, self.owner.layout.data)
        os.makedirs(folder, exist_ok=True)
        self._write(files)
        self.owner.reload()
        return [r for r, _, _ in prepared]


def _noted(folder: str, columns: list[str]):
    """Writes rows (__file and columns) as notes of a folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, contents = [], []
            for row in batch.to_pylist():
                fields = {c: normal(row[c]) for c in columns if c != BODY}
                paths.append(f"{folder}/{row['__file']}.md")
                contents.append(note(fields, row.get(BODY) if BODY in columns else None))
            for done in save_files(iter([pd.DataFrame({"path": paths, "content": contents})])):
                yield pa.RecordBatch.from_pandas(done, preserve_index=False)

    return run


def _patched(property_name: str, append: bool):
    """Sets a property of notes (path, value); append: adds to what is there the links to records that it doesn't name yet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import yaml

        for batch in batches:
            paths, contents = [], []
            for row in batch.to_pylist():
                with open(row["path"], encoding="utf-8", newline="") as f:
                    content = f.read()
                value = normal(row["value"])
                if append:
                    there = (yaml.safe_load(split_note(content)[0]) or {}).get(property_name)
                    value = with_links(there, value or [])
                paths.append(row["path"])
                contents.append(with_property(content, property_name, value))
            for done in save_files(iter([pd.DataFrame({"path": paths, "content": contents})])):
                yield pa.RecordBatch.from_pandas(done, preserve_index=False)

    return run


def with_links(there: object, new: list[str]) -> list:
    """What a field holds, as a list, and those of the new links that name other records."""
    out = list(there) if isinstance(there, list) else [] if there is None else [there]
    names = {found[1] for x in out if isinstance(x, str) and (found := links.parse(x))}
    for link in sorted(new):
        if links.parse(link)[1] not in names:
            out.append(link)
            names.add(links.parse(link)[1])
    return out


def sanitized(c):
    """clean_name() as a column, the composed form made only where a name isn't plain ASCII."""
    from ..functions.python_text import nfc

    composed = F.when(c.rlike(r"[^\x00-\x7F]"), nfc(c)).otherwise(c)
    trimmed = F.regexp_replace(F.regexp_replace(composed, r"[\[\]:\\/^|#]", "_"), r"^[. ]+|[. ]+$", "")
    return F.when(trimmed == "", "_").otherwise(trimmed)


def suffixed(names: DataFrame, taken: DataFrame) -> DataFrame:
    """names (idx, name) with a filename that is free: the first of a name keeps it unless taken (name) has it, later ones get _2, _3, ...

    Numbers are given out by idx within a name, above those that other names or taken use already. Any number of
    rows may share a name: only counts are gathered, ranks come from a window over the name.
    """
    used = taken.select("name").unionByName(names.select("name")).distinct()
    stem, n = F.regexp_extract("name", r"^(.*)_([0-9]{1,9})$", 1), F.regexp_extract("name", r"^(.*)_([0-9]{1,9})$", 2)
    numbered = used.where(stem != "").groupBy(stem.alias("name")).agg(F.max(n.try_cast("bigint")).alias("highest"))
    known = names.join(taken.select("name").distinct().withColumn("on_disk", F.lit(1)), "name", "left").join(numbered, "name", "left")
    rank = F.row_number().over(Window.partitionBy("name").orderBy("idx")) + F.coalesce("on_disk", F.lit(0))
    start = F.greatest(F.coalesce("highest", F.lit(1)), F.lit(1))
    return known.withColumn("rank", rank).select("idx", "name", F.when(F.col("rank") == 1, F.col("name")).otherwise(F.concat("name", F.lit("_"), (start + F.col("rank") - 1).cast("string"))).alias("filename"))

