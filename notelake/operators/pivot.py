"""Entity-attribute-value rows into wide tables, by log-structured upserts.

A batch of cells becomes a sparse wide delta: one row for each record with a slot for each declared field of its type,
each filled slot holding its version (loaded_at, cell_id) and value. Deltas are runs sorted by record; compaction
merges runs and keeps the latest version of each slot. Taking the latest is associative, so runs merge in any order
and any number of times.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.typed import blank, fits, typed
from ..manifest import Manifest

KEYS = ["vault_id", "type_name", "record_id"]
IDS = ["vault_id", "type_id", "record_id"]


class Slots:
    """The declared fields: the slot, name and type of each (type_name, field). The declaration is a small table and is held on the driver."""

    def __init__(self, schema_fields: DataFrame) -> None:
        self.fields: dict[str, list[tuple[str, str]]] = {}
        rows = schema_fields.where("type_name is not null and field_name is not null").select("type_name", "pos", "field_name", "field_type").distinct().collect()
        for r in sorted(rows, key=lambda r: (r["type_name"], r["pos"] if r["pos"] is not None else 1 << 30, r["field_name"])):
            own = self.fields.setdefault(r["type_name"], [])
            if r["field_name"].strip(" ").lower() not in {n.strip(" ").lower() for n, _ in own}:
                own.append((r["field_name"], r["field_type"] or "string"))
        self.width = max(map(len, self.fields.values()), default=0)

    def table(self, spark: SparkSession) -> DataFrame:
        """(type_name, type_id, key, slot, field_id, field_name, field_type); key: the name without case and outer spaces.

        The ids are for the length of a query: they depend on the declaration. The declaration came from the driver, so
        it may be broadcast; Spark doesn't know its size and would shuffle the other side first.
        """
        rows = [(t, k, n.strip(" ").lower(), i, k * self.width + i, n, kind) for k, (t, own) in enumerate(self.fields.items()) for i, (n, kind) in enumerate(own)]
        return spark.createDataFrame(rows, "type_name string, type_id int, key string, slot int, field_id int, field_name string, field_type string")


def placed(cells: DataFrame, slots: Slots) -> DataFrame:
    """cells with type_id and slot of their field; fields that the type doesn't declare are left out."""
    known = slots.table(cells.sparkSession).select("type_name", "key", "type_id", "slot")
    return cells.select(*KEYS, "load_no", "cell_id", "loaded_at", "cell_value", F.lower(F.trim("field_name")).alias("key")).join(F.broadcast(known), ["type_name", "key"]).drop("key")


def _names(slots: Slots) -> list[str]:
    return [f"s{i}" for i in range(slots.width)]


def deltas(cells: DataFrame, slots: Slots, keys: list[str] = KEYS) -> DataFrame:
    """A sparse wide row for each record and batch (load_no) of placed cells: keys, load_no, s0, s1, ... with (loaded_at, cell_id, load_no, value)."""
    version = F.struct("loaded_at", "cell_id", "load_no", F.col("cell_value").alias("value"))
    filled = [F.max(F.when(F.col("slot") == i, version)).alias(s) for i, s in enumerate(_names(slots))]
    return cells.groupBy(*keys, "load_no").agg(*filled)


def compacted(runs: DataFrame, slots: Slots, keys: list[str] = KEYS) -> DataFrame:
    """One row for each record: in each slot the latest of all runs."""
    return runs.groupBy(*keys).agg(*[F.max(s).alias(s) for s in _names(slots)])


def latest(cells: DataFrame, slots: Slots) -> DataFrame:
    """The compacted table of all batches: IDS, s0, s1, ... Each task makes one sparse delta of its rows before they are shuffled, so that a record with very many versions moves once a task; the shuffle's other side compacts."""
    version = F.struct("loaded_at", "cell_id", "load_no", F.col("cell_value").alias("value"))
    return placed(cells, slots).drop("type_name").groupBy(*IDS).agg(*[F.max(F.when(F.col("slot") == i, version)).alias(s) for i, s in enumerate(_names(slots))])


def counting(wide: DataFrame, slots: Slots) -> DataFrame:
    """The cells that count, one row for each filled slot: vault_id, record_id, field_id, load_no, cell_id, cell_value."""
    each = wide.select(*IDS, F.posexplode(F.array(*_names(slots))).alias("slot", "c")).where("c is not null")
    return each.select("vault_id", "record_id", (F.col("type_id") * slots.width + F.col("slot")).alias("field_id"), "c.load_no", "c.cell_id", F.col("c.value").alias("cell_value"))


def latest_cells(cells: DataFrame, slots: Slots) -> DataFrame:
    """counting(latest(...)) for those who need no wide rows: the latest version of each cell, taken cell by cell, first within each task."""
    field = (F.col("type_id") * slots.width + F.col("slot")).alias("field_id")
    version = F.struct("loaded_at", "cell_id", "load_no", F.col("cell_value").alias("value"))
    cell = placed(cells, slots).groupBy("vault_id", "record_id", field).agg(F.max(version).alias("c"))
    return cell.select("vault_id", "record_id", "field_id", "c.load_no", "c.cell_id", F.col("c.value").alias("cell_value"))


def misfits(cells: DataFrame, schema_fields: DataFrame) -> DataFrame:
    """(record_id, field_name): counting cells whose value isn't of the declared type.

    Of several cells of a record and field the latest loaded_at counts, then the highest cell_id; a null loaded_at is
    the earliest. Blank values fit. Repeated rows count once; undeclared fields and types are left out.
    """
    slots = Slots(schema_fields)
    if not slots.width:
        return cells.select("record_id", "field_name").limit(0)
    own = counting(latest(cells, slots), slots).join(F.broadcast(slots.table(cells.sparkSession)), "field_id")
    return own.where(~blank(F.col("cell_value")) & ~fits(F.col("cell_value"), F.col("field_type"))).select("record_id", "field_name")


def _typed_columns(wide: DataFrame, type_name: str, slots: Slots, extra: list[Column]) -> DataFrame:
    taken: dict[str, int] = {c: 1 for c in ("record_id", "vault_id", "name")}
    cols = []
    for i, (field, kind) in enumerate(slots.fields[type_name]):
        name = field
        while name.lower() in taken:
            name += "_"
        taken[name.lower()] = 1
        cols.append(typed(F.col(f"s{i}.value"), kind).alias(name))
    return wide.select("record_id", "vault_id", *extra, *cols)


def wide_table(cells: DataFrame, schema_fields: DataFrame, records: DataFrame, type_name: str) -> DataFrame:
    """One row for each record of a type: record_id, vault_id, name, then a typed column for each declared field.

    A value that is absent, blank or doesn't fit is null there; misfits() lists those that don't fit. The name comes
    from the record's latest row and is null where records doesn't have it. A field that is called like one of the
    first three columns gets a trailing underscore.
    """
    slots = Slots(schema_fields)
    wide = latest(cells.where(F.col("type_name") == type_name), slots)
    names = records.where(F.col("type_name") == type_name).groupBy("record_id").agg(F.max(F.struct("loaded_at", "name")).alias("r"))
    return _typed_columns(wide.join(names, "record_id", "left"), type_name, slots, [F.col("r.name").alias("name")])


class WideStore:
    """A log-structured wide table in a folder: upsert() appends sorted runs, compact() merges them, read() sees the latest.

    A manifest names the runs that count and is replaced as one file, so a run or compaction that breaks off changes
    nothing; upserting a batch again is harmless, since each cell carries its version.
    """

    def __init__(self, spark: SparkSession, folder: str, schema_fields: DataFrame) -> None:
        self.spark, self.folder, self.slots = spark, folder.rstrip("/"), Slots(schema_fields)
        self.manifest = Manifest(spark, folder)

    def runs(self) -> list[str]:
        return self.manifest.read() or []

    def upsert(self, cells: DataFrame) -> str:
        """Write a batch's delta as a run sorted by record."""
        run, at, before = f"run-{uuid.uuid4().hex}", self.manifest.version(), self.runs()
        compacted(deltas(placed(cells, self.slots), self.slots), self.slots).repartition("record_id").sortWithinPartitions("record_id").write.parquet(f"{self.folder}/{run}")
        self.manifest.publish([*before, run], at)
        return run

    def read(self) -> DataFrame | None:
        """The wide table as of now, or None before the first batch."""
        runs = self.runs()
        return compacted(self.spark.read.parquet(*[f"{self.folder}/{r}" for r in runs]), self.slots) if runs else None

    def compact(self) -> None:
        """Replace all runs by one; the old ones stay for readers that have begun."""
        at = self.manifest.version()
        if len(self.runs()) > 1:
            run = f"run-{uuid.uuid4().hex}"
            self.read().repartition("record_id").sortWithinPartitions("record_id").write.parquet(f"{self.folder}/{run}")
            self.manifest.publish([run], at)
