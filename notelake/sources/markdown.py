"""Folders of Markdown notes with YAML front matter, read once into long, kind-tagged cells.

<root>/data/<Type>/*.md are records, <root>/bases/<Type>.base the views and formulas of a type. The driver lists
folders (names only); files are read and parsed on the executors.
"""

from __future__ import annotations

import datetime
import hashlib
import os
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship

#: A row for each file (field is null) and for each key of its front matter, in order; the body is the field full_text.
CELLS = (
    "type string, record string, path string, size long, ctime timestamp_ntz, mtime timestamp_ntz, digest string, "
    "field string, pos int, kind string, text string, items array<struct<kind:string,text:string>>"
)

BODY = "full_text"


def split_note(content: str) -> tuple[str, str]:
    """Front matter and body of a note; a note without a closed --- block is all body."""
    text = content.removeprefix("﻿")
    if text.startswith("---"):
        lines = text.splitlines(keepends=True)
        if lines[0].strip() == "---":
            for i in range(1, len(lines)):
                if lines[i].strip() == "---":
                    return "".join(lines[1:i]), "".join(lines[i + 1 :])
    return "", content


def kind_of(value: object) -> str:
    if value is None:
        return "null"
    for kind, python in (("bool", bool), ("int", int), ("float", float), ("str", str), ("datetime", datetime.datetime), ("date", datetime.date), ("list", list), ("map", dict)):
        if isinstance(value, python):
            return kind
    return "other"


def text_of(value: object) -> str | None:
    if value is None:
        return None
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat(sep=" ")
    return value.isoformat() if isinstance(value, datetime.date) else str(value)


def parse_note(content: str) -> dict[str, object]:
    """The fields of a note, by YAML 1.1. Front matter that is no mapping has no fields; a broken one is the field _unreadable."""
    import yaml

    front, body = split_note(content)
    try:
        fields = yaml.load(front, yaml.CSafeLoader if hasattr(yaml, "CSafeLoader") else yaml.SafeLoader) if front.strip() else {}
    except (yaml.YAMLError, ValueError) as e:
        fields = {"_unreadable": str(e).splitlines()[0]}
    out = {str(k): v for k, v in fields.items()} if isinstance(fields, dict) else {}
    if body.strip():
        out[BODY] = body.strip()
    return out


def note_rows(path: str, type_name: str, content: bytes, stat: os.stat_result | None) -> list[tuple]:
    stamp = lambda t: None if t is None else datetime.datetime.fromtimestamp(t, datetime.UTC).replace(tzinfo=None)
    head = (type_name, os.path.basename(path).removesuffix(".md"), path, len(content), stamp(stat and stat.st_ctime), stamp(stat and stat.st_mtime), hashlib.sha256(content).hexdigest())
    rows = [(*head, None, None, "file", None, None)]
    for pos, (name, value) in enumerate(parse_note(content.decode("utf-8", "replace")).items()):
        items = [{"kind": kind_of(x), "text": text_of(x)} for x in value] if isinstance(value, list) else None
        rows.append((*head, name, pos, kind_of(value), text_of(value), items))
    return rows


COLUMNS = [c.split()[0] for c in CELLS.replace("array<struct<kind:string,text:string>>", "x").split(", ")]


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for path, type_name in zip(batch["path"], batch["type"]):
            with open(path, "rb") as f:
                rows += note_rows(path, type_name, f.read(), os.stat(path))
        yield pd.DataFrame(rows, columns=COLUMNS)


@dataclass
class Layout:
    """What the driver knows of a folder: its types and base files. Files are listed by the executors."""

    root: str
    data: str = "data"
    bases: str = "bases"
    types: list[str] = field(default_factory=list)
    base_files: dict[str, str] | None = None


def list_folder(root: str, data: str = "data", bases: str = "bases") -> Layout:
    """Folders that begin with _ are no types."""
    out = Layout(root, data, bases)
    top = os.path.join(root, data)
    if os.path.isdir(top):
        out.types = sorted(e.name for e in os.scandir(top) if e.is_dir() and not e.name.startswith("_"))
    if os.path.isdir(folder := os.path.join(root, bases)):
        out.base_files = {n.removesuffix(".base"): os.path.join(folder, n) for n in sorted(os.listdir(folder)) if n.endswith(".base")}
    return out


ENTRIES = "type string, path string, name string, kind string"


def _list(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The entries of type folders, a chunk at a time: note, odd (anything else directly inside), nested (notes further down)."""
    columns = [c.split()[0] for c in ENTRIES.split(", ")]
    for batch in batches:
        for folder, type_name in zip(batch["folder"], batch["type"]):
            rows = []
            for at, folders, names in os.walk(folder):
                top = at == folder
                rows += [(type_name, os.path.join(at, n), n, "note" if top else "nested") for n in names if n.endswith(".md")]
                if top:
                    rows += [(type_name, os.path.join(at, n), n, "odd") for n in [*folders, *(n for n in names if not n.endswith(".md"))]]
                while len(rows) >= 10_000:
                    yield pd.DataFrame(rows[:10_000], columns=columns)
                    rows = rows[10_000:]
            yield pd.DataFrame(rows, columns=columns)


def entries(spark: SparkSession, layout: Layout, types: list[str] | None = None, every_folder: bool = False) -> DataFrame:
    """ENTRIES of the types' folders (every_folder: also of those that are no types). Only notes directly inside are records."""
    ship(spark)
    top = os.path.join(layout.root, layout.data)
    names = [t for t in layout.types if types is None or t in types]
    if every_folder and os.path.isdir(top):
        names = sorted(e.name for e in os.scandir(top) if e.is_dir())
    folders = spark.createDataFrame([(os.path.join(top, t), t) for t in names], "folder string, type string")
    return folders.repartition(max(1, len(names))).mapInPandas(_list, ENTRIES)


#: Notes that a task opens, about.
NOTES_A_TASK = 2_000


def scan(spark: SparkSession, files: DataFrame) -> DataFrame:
    """The cells of the notes among entries(); spread over tasks by their number, whatever folder they are in."""
    notes = files.where("kind = 'note'")
    n = notes.count()
    parts = max(1, min(n, max(n // NOTES_A_TASK, spark.sparkContext.defaultParallelism)))
    return notes.select("path", "type").repartition(parts).mapInPandas(_read, CELLS)


def parse_binary(files: DataFrame) -> DataFrame:
    """Cells of files as Spark's binaryFile source gives them, in a batch or a stream."""
    ship(files.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"]):
                clean = path.removeprefix("file:")
                rows += note_rows(clean, os.path.basename(os.path.dirname(clean)), bytes(content), None)
            yield pd.DataFrame(rows, columns=COLUMNS)

    return files.select("path", "content").mapInPandas(run, CELLS)


def fingerprint(spark: SparkSession, root: str, data: str = "data", bases: str = "bases") -> str:
    """Equal when the notes (also nested ones) and base files under root have equal paths and contents."""
    layout = list_folder(root, data, bases)

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sums = []
            for path in batch["path"]:
                with open(path, "rb") as f:
                    sums.append(hashlib.sha256(os.path.relpath(path, root).encode() + b"\0" + f.read()).hexdigest())
            yield pd.DataFrame({"digest": sums})

    notes = entries(spark, layout, every_folder=True).where("kind <> 'odd'").select("path")
    other = spark.createDataFrame([(p,) for p in (layout.base_files or {}).values()], "path string")
    files = notes.unionByName(other).repartition(spark.sparkContext.defaultParallelism).mapInPandas(digest, "digest string")
    # In groups of the first two digits, so that no task holds all digests.
    groups = files.groupBy(F.substring("digest", 1, 2).alias("g")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("digest")), ""), 256).alias("d"))
    return groups.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("g", "d"))), lambda x: x["d"]), ""), 256).alias("d")).first()[0]


def read_base(path: str) -> dict:
    """Display names, formulas, filters and views of a base file. A file that is no mapping is empty; unnamed views are skipped, of two with one name the last counts."""
    import yaml

    with open(path, encoding="utf-8") as f:
        doc = yaml.safe_load(f)
    doc = doc if isinstance(doc, dict) else {}
    shown = {k: v["displayName"] for k, v in (doc.get("properties") or {}).items() if isinstance(v, dict) and v.get("displayName")}
    views = {v["name"]: v for v in doc.get("views") or [] if isinstance(v, dict) and v.get("name")}
    return {"display": shown, "formulas": {str(k): str(v) for k, v in (doc.get("formulas") or {}).items()}, "filters": doc.get("filters"), "views": views}
