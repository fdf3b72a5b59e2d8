"""Processing only new or changed records: Merkle trees over key ranges.

A tree covers the records of one collection. Its leaves are ranges of the hashed key space; a leaf's digest is made
from its entries, an inner node's from its children. Two trees are compared from the root: only where digests differ
are the children looked at, and only the entries of differing leaves are compared. All trees of a run are compared at
once, level by level, so that a run costs a few joins however many collections there are.

A leaf's digest is made from an order-free sum over its entries, so that a saved digest is brought up to date by the
entries that came in since, without reading the others again.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..manifest import Manifest
from ..session import written

#: Bits of the hashed key that a level of the tree takes.
BITS = 4

#: Entries that a leaf holds about, at most.
LEAF = 64

DEEPEST = 15


def _range_at(level: int) -> Column:
    """The node of that level that an entry's key falls into."""
    return F.shiftrightunsigned(F.col("place"), 64 - BITS * level) if level else F.lit(0).cast("long")


def _depth(n: Column) -> Column:
    return F.least(F.greatest(F.ceil(F.log2(n / LEAF) / BITS), F.lit(0)), F.lit(DEEPEST)).cast("int")


def with_depth(entries: DataFrame) -> DataFrame:
    """entries (tree, side, key, content) with the place of each key and the depth of its tree, which the larger side sets."""
    sizes = entries.groupBy("tree", "side").count().groupBy("tree").agg(F.max("count").alias("n"))
    return entries.join(sizes.select("tree", _depth(F.col("n")).alias("depth")), "tree").withColumn("place", F.xxhash64("key"))


def _leaf(deepest: int) -> Column:
    return F.coalesce(*[F.when(F.col("depth") == d, _range_at(d)) for d in range(deepest + 1)])


def _hashes() -> tuple[Column, Column]:
    return F.xxhash64("key", "content"), F.xxhash64("content", F.lit("#"), "key")


def leaf_sums(entries: DataFrame, by: list[str]) -> DataFrame:
    """by and the sums of its entries (key, content): one, two, n."""
    one, two = _hashes()
    return entries.groupBy(*by).agg(F.bit_xor(one).alias("one"), F.bit_xor(two).alias("two"), F.count("*").alias("n"))


def digested(sums: DataFrame) -> DataFrame:
    return sums.withColumn("digest", F.xxhash64("one", "two", "n")).drop("one", "two", "n")


def leaves(entries: DataFrame, deepest: int) -> DataFrame:
    """(tree, side, depth, node, digest): an order-free digest over a leaf's entries."""
    return digested(leaf_sums(entries.withColumn("node", _leaf(deepest)), ["tree", "side", "depth", "node"]))


def levels(bottom: DataFrame, deepest: int) -> list[DataFrame]:
    """The nodes of each level, from the root's: (tree, side, node, digest). A parent's digest is made from its children in order."""
    out = [bottom.where(F.col("depth") == deepest).drop("depth")]
    for level in range(deepest - 1, -1, -1):
        up = out[0].groupBy("tree", "side", F.shiftrightunsigned("node", BITS).alias("node") if level else F.lit(0).cast("long").alias("node")).agg(
            F.xxhash64(F.sort_array(F.collect_list(F.struct("node", "digest")))).alias("digest")  # at most 2 ** BITS children
        )
        out.insert(0, up.unionByName(bottom.where(F.col("depth") == level).drop("depth")))
    return out


def differing(bottom: DataFrame, deepest: int) -> DataFrame:
    """(tree, node, depth): the leaves whose digests differ between the sides, found from the root downwards."""
    nodes = [n.withColumn("level", F.lit(level)) for level, n in enumerate(levels(bottom, deepest))]
    forest = written(reduce(DataFrame.unionByName, nodes), "nodes")
    done: list[DataFrame] = []
    for level in range(deepest + 1):
        own = forest.where(F.col("level") == level)
        if done:
            parent = F.shiftrightunsigned("node", BITS) if level > 1 else F.lit(0).cast("long")
            own = own.withColumn("parent", parent).join(done[-1].select("tree", F.col("node").alias("parent")), ["tree", "parent"], "left_semi")
        c = F.max(F.when(F.col("side") == "c", F.col("digest")))
        s = F.max(F.when(F.col("side") == "s", F.col("digest")))
        done.append(own.groupBy("tree", "node").agg(c.alias("c"), s.alias("s")).where(~F.col("c").eqNullSafe(F.col("s"))).select("tree", "node", F.lit(level).alias("depth")))
    return reduce(DataFrame.unionByName, done)


def compared(touched: DataFrame) -> DataFrame:
    """(tree, key, change, content, before) of entries of both sides (tree, side, key, content, and at, if a side may hold a key more than once: the last counts)."""
    version = F.struct("at", "content") if "at" in touched.columns else F.struct("content")
    of = lambda side: F.max(F.when(F.col("side") == side, version))
    both = touched.groupBy("tree", "key").agg(of("c").alias("c"), of("s").alias("s"))
    kind = F.when(F.col("s").isNull(), "added").when(F.col("c").isNull(), "removed").when(~F.col("c.content").eqNullSafe(F.col("s.content")), "changed")
    return both.withColumn("change", kind).where("change is not null").select("tree", "key", "change", F.col("c.content").alias("content"), F.col("s.content").alias("before"))


def changes(current: DataFrame, saved: DataFrame) -> DataFrame:
    """(tree, key, change, content, before): what differs between the entries of trees of the same name.

    current, saved: (tree, key, content), a key at most once in a tree. change: added, changed or removed. A null
    content equals a null content.
    """
    fields = ["tree", "key", "content"]
    sides = current.select(*fields).withColumn("side", F.lit("c")).unionByName(saved.select(*fields).withColumn("side", F.lit("s")))
    entries = written(with_depth(sides), "entries")
    deepest = entries.agg(F.max("depth")).first()[0] or 0
    found = differing(written(leaves(entries, deepest), "leaves"), deepest)
    return compared(entries.withColumn("node", _leaf(deepest)).join(found, ["tree", "depth", "node"], "left_semi"))


def listings(scans: DataFrame, scan_files: DataFrame) -> tuple[DataFrame, int]:
    """What each scan listed (scan_id, next, ok, seq, done, depth, node, key, content), each path once, and the deepest depth.

    In a collection (vault_id) scans follow each other by started_at; next is the next scan that ended well, depth that of
    the trees of the collection, which its largest scan sets. Of several rows of a scan and path the last listed counts;
    rows without path or scan are left out.
    """
    order = Window.partitionBy("vault_id").orderBy("started_at", "scan_id")
    ok = F.coalesce(F.col("status") == "ok", F.lit(False))
    back = Window.partitionBy("vault_id").orderBy(F.desc("seq")).rowsBetween(Window.unboundedPreceding, -1)
    numbered = scans.dropDuplicates(["scan_id"]).withColumn("seq", F.row_number().over(order)).withColumn("next", F.last(F.when(ok, F.col("scan_id")), ignorenulls=True).over(back))
    sizes = scan_files.where("scan_id is not null").groupBy("scan_id").agg(F.count("*").alias("size"))
    largest = F.max(F.coalesce("size", F.lit(0))).over(Window.partitionBy("vault_id"))
    known = written(numbered.join(sizes, "scan_id", "left").withColumn("depth", _depth(F.greatest(largest, F.lit(1)))).select("scan_id", "seq", "next", ok.alias("ok"), "depth"), "scans")
    deepest = known.agg(F.max("depth")).first()[0] or 0
    rows = scan_files.where("path is not null and scan_id is not null").select("scan_id", F.col("path").alias("key"), "content_hash", "done", "listed_at", "row_id")
    version = F.struct("listed_at", "row_id", "content_hash")
    once = rows.groupBy("scan_id", "key").agg(F.max(version).alias("v"), F.max(F.coalesce("done", F.lit(False))).alias("done"))
    placed = once.join(known, "scan_id").withColumn("place", F.xxhash64("key")).withColumn("node", _leaf(deepest))
    return written(placed.select("scan_id", "next", "ok", "seq", "done", "depth", "node", "key", F.col("v.content_hash").alias("content")), "listed"), deepest


def changed_records(scans: DataFrame, scan_files: DataFrame) -> DataFrame:
    """(scan_id, path): of each ok scan the paths that the collection's state doesn't hold with the same content.

    Each ok scan's listing is digested once, and the digests are saved; the state that the next ok scan is held against is
    that saved tree. The done rows of the scans that broke off in between are put into its leaves, the latest of a path
    counting. Two trees are then compared from their roots, and only entries of leaves that differ are looked at.
    """
    listed, deepest = listings(scans, scan_files)
    at_leaf = ["tree", "depth", "node"]
    well = listed.where("ok").select("scan_id", "next", "depth", "node", "key", "content")
    digests = written(leaf_sums(well, ["scan_id", "next", "depth", "node"]), "digests")
    late = listed.where("NOT ok AND done AND next IS NOT NULL").groupBy(F.col("next").alias("tree"), "depth", "node", "key").agg(F.max(F.struct("seq", "content")).alias("x"))
    late = written(late.select(*at_leaf, "key", "x.content"), "late")
    before = well.where("next is not null").select(F.col("next").alias("tree"), "depth", "node", "key", "content").join(late.select(*at_leaf).distinct(), at_leaf, "left_semi")
    # A late row takes the sum of the entry that it replaces out of its leaf and puts its own in.
    one, two = _hashes()
    sides = late.withColumn("side", F.lit("late")).unionByName(before.withColumn("side", F.lit("before"))).withColumns({"one": one, "two": two})
    of = lambda side: F.count(F.when(F.col("side") == side, F.lit(1)))
    moved = sides.groupBy(*at_leaf, "key").agg(F.bit_xor("one").alias("one"), F.bit_xor("two").alias("two"), (1 - of("before")).alias("n"), of("late").alias("late")).where("late > 0")
    saved = digests.where("next is not null").select(F.col("next").alias("tree"), "depth", "node", "one", "two", "n").unionByName(moved.select(*at_leaf, "one", "two", "n"))
    saved = saved.groupBy(*at_leaf).agg(F.bit_xor("one").alias("one"), F.bit_xor("two").alias("two"), F.sum("n").alias("n"))
    now = digests.select(F.col("scan_id").alias("tree"), "depth", "node", "one", "two", "n")
    both = digested(now.withColumn("side", F.lit("c")).unionByName(saved.withColumn("side", F.lit("s"))))
    found = differing(written(both, "leaves"), deepest)
    role = lambda tree, side: F.struct(F.col(tree).alias("tree"), F.lit(side).alias("side"), F.lit(0).alias("at"))
    entries = well.select(F.inline(F.array(role("scan_id", "c"), role("next", "s"))), "depth", "node", "key", "content").where("tree is not null")
    entries = entries.unionByName(late.withColumns({"side": F.lit("s"), "at": F.lit(1)}))
    return compared(entries.join(found, at_leaf, "left_semi")).where("change <> 'removed'").select(F.col("tree").alias("scan_id"), F.col("key").alias("path"))


class MerkleStore:
    """Runs over one growing table: each takes only what was added, changed or removed since the last run that was published.

    The store holds the leaves' digests and, for each leaf, the run that wrote its entries. A run digests the table,
    descends from the roots to the leaves that differ, reads the saved entries of these leaves only, and writes its
    output, the entries of these leaves and the new digests into a folder of its own; one manifest publishes them
    together. A run that breaks off publishes nothing: the next one finds the same changes again. Nothing is skipped
    and nothing repeated.
    """

    LEAVES = "tree string, depth int, node long, digest long, run string"
    ENTRIES = "tree string, node long, key string, content string, run string"

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        self.manifest = Manifest(spark, folder)

    def _read(self, run: str | None, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{run}/{name}") if run else self.spark.createDataFrame([], schema)

    def _entries(self, leaves: DataFrame) -> DataFrame:
        """The saved entries of leaves, from the runs that wrote them."""
        runs = [r[0] for r in leaves.select("run").distinct().collect()]  # folders of this store
        kept = [self._read(r, "entries", self.ENTRIES) for r in runs] or [self._read(None, "", self.ENTRIES)]
        return reduce(DataFrame.unionByName, kept).join(leaves.select("tree", "node", "run"), ["tree", "node", "run"], "left_semi")

    def state(self) -> DataFrame:
        """(tree, key, content) of the last published run."""
        last = self.manifest.read()
        return self._entries(self._read(last and last["run"], "leaves", self.LEAVES)).select("tree", "key", "content")

    def run(self, records: DataFrame, tree: str, key: str, content: str, process=None) -> DataFrame:
        """The changes against the state, published together with the new state.

        Rows without key are left out; of several rows of a key the greatest content counts. process: makes the run's
        output from the changes, before anything is published; what it raises ends the run.
        """
        at, last, run = self.manifest.version(), self.manifest.read(), f"run-{uuid.uuid4().hex}"
        text = lambda c: F.col(c).cast("string")
        saved = self._read(last and last["run"], "leaves", self.LEAVES)
        rows = records.where(F.col(key).isNotNull()).groupBy(F.coalesce(text(tree), F.lit("")).alias("tree"), text(key).alias("key")).agg(F.max(text(content)).alias("content"))
        # A tree keeps its depth until its size has left it behind; then it is built anew.
        known = saved.groupBy("tree").agg(F.max("depth").alias("was"))
        sizes = rows.groupBy("tree").count().join(known, "tree", "left").withColumn("fits", _depth(F.col("count")))
        depths = sizes.withColumn("depth", F.when(F.abs(F.col("was") - F.col("fits")) <= 1, F.col("was")).otherwise(F.col("fits")))
        entries = rows.join(depths.select("tree", "depth", "was"), "tree").withColumn("place", F.xxhash64("key")).withColumn("side", F.lit("c"))
        entries = written(entries, "entries")
        rebuilt = entries.where("was is not null and was <> depth").select("tree").distinct()
        deepest = max(entries.agg(F.max("depth")).first()[0] or 0, saved.agg(F.max("depth")).first()[0] or 0)
        now = written(leaves(entries, deepest), "leaves")
        old = saved.join(rebuilt, "tree", "left_anti").select("tree", F.lit("s").alias("side"), "depth", "node", "digest")
        found = written(differing(now.unionByName(old), deepest), "differing")
        at_leaf = ["tree", "depth", "node"]
        touched = entries.withColumn("node", _leaf(deepest)).join(found, at_leaf, "left_semi")
        replaced = written(saved.join(found, at_leaf, "left_semi").unionByName(saved.join(rebuilt, "tree", "left_semi")), "replaced")
        fields = ["tree", "side", "key", "content"]
        difference = compared(touched.select(*fields).unionByName(self._entries(replaced).withColumn("side", F.lit("s")).select(*fields)))
        (process(difference) if process else difference).write.parquet(f"{self.folder}/{run}/output")
        touched.select("tree", "node", "key", "content", F.lit(run).alias("run")).sortWithinPartitions("tree", "node").write.parquet(f"{self.folder}/{run}/entries")
        kept = saved.join(replaced.select(*at_leaf), at_leaf, "left_anti")
        kept.unionByName(now.join(found, at_leaf, "left_semi").select(*at_leaf, "digest", F.lit(run).alias("run"))).write.parquet(f"{self.folder}/{run}/leaves")
        self.manifest.publish({"run": run}, at)
        return self.spark.read.parquet(f"{self.folder}/{run}/output")
