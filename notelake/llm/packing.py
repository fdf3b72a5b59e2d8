"""Fixed-capacity containers: bulk-synchronous best fit.

Texts of one token count are interchangeable, and so are containers with one gap, so both sides are kept as run-length
classes in a table: sizes with a count and a first rank, gaps with a count and a first container. A superstep

1. range-sorts sizes and gaps together and gives each range to a task;
2. sweeps each range from the largest size down: a size goes to its successor, the least gap that holds it. Sizes that want
   one gap get its containers by rank, the larger first, as far as they reach; the others go on to the next successor;
3. updates the gaps, and hands them with the sizes that found none to the next superstep, which sweeps fewer and wider ranges.

The last superstep sweeps the whole range of a capacity and opens containers for what fits nowhere. A class table has at most as
many sizes as the capacity has tokens, however many documents there are; where it fits one range there is one superstep,
and the result is exactly best fit decreasing. Documents never leave the executors: they are ranked within their class by a
salted range sort and look their container up in the class's segments.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left, insort
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship, written
from .tokens import VOCABULARY, token_count

#: Rows of one size class that one sort group takes at most, about.
RUN_ROWS = 50_000

#: Class rows that a range holds, about, and how many ranges the next superstep makes one of.
RANGE_ROWS, MERGED = 50_000, 8

#: What a class table holds: sizes (value, rank of the first, n), gaps (value, first container, n), and segments: n texts of a size
#: from rank on, per of them to a container, from container first on.
CLASSES = "kind string, container_id int, capacity long, value long, first long, n long, per long, rank long"


class Gaps:
    """Runs of containers by their gap, sorted for successor search; of one gap the first container comes first."""

    def __init__(self) -> None:
        self.order: list[int] = []
        self.runs: dict[int, list[tuple[int, int]]] = {}

    def put(self, gap: int, first: int, n: int) -> None:
        if gap > 0 and n > 0:
            if gap not in self.runs:
                self.runs[gap] = []
                insort(self.order, gap)
            heapq.heappush(self.runs[gap], (first, n))

    def successor(self, size: int) -> tuple[int, int, int] | None:
        """The least gap that holds size, with its first run, taken out."""
        at = bisect_left(self.order, size)
        if at == len(self.order):
            return None
        gap = self.order[at]
        first, n = heapq.heappop(self.runs[gap])
        if not self.runs[gap]:
            del self.runs[gap], self.order[at]
        return gap, first, n


def sweep(capacity: int, sizes: list[tuple[int, int, int]], gaps: Gaps, opened: int | None) -> tuple[list[tuple[int, int, int, int, int]], list[tuple[int, int, int]]]:
    """Segments (size, rank, n, first container, per container) and the sizes (size, rank, n) that fit no gap.

    sizes: (size, first rank, n). opened: number of the next container to be opened for these, None to open none. gaps is updated.
    """
    segments, left = [], []
    for size, rank, n in sorted(sizes, key=lambda s: (-s[0], s[1])):
        while n:
            found = gaps.successor(size)
            if found is None and opened is None:
                left.append((size, rank, n))
                break
            if found is None:
                found = capacity, opened, -(-n // (capacity // size))
                opened += found[2]
            gap, first, bins = found
            per = gap // size
            used = min(bins, -(-n // per))
            placed = min(n, used * per)
            full, rest = divmod(placed, per)
            segments.append((size, rank, placed, first, per))
            gaps.put(gap - per * size, first, full)
            gaps.put(gap - rest * size, first + full, used - full)
            gaps.put(gap, first + used, bins - used)
            rank, n = rank + placed, n - placed
    return segments, left


def _sweeps(opened: dict[int, int] | None):
    """Sweeps the range of a task, a container_id after the other."""

    def swept(container: int, capacity: int, sizes: list, gaps: Gaps) -> pd.DataFrame:
        segments, left = sweep(capacity, sizes, gaps, None if opened is None else opened.get(container, 0))
        rows = [("segment", container, capacity, size, first, n, per, rank) for size, rank, n, first, per in segments]
        if opened is None:
            rows += [("size", container, capacity, size, None, n, None, rank) for size, rank, n in left]
            rows += [("gap", container, capacity, gap, first, n, None, None) for gap, runs in gaps.runs.items() for first, n in runs]
        return pd.DataFrame(rows, columns=["kind", "container_id", "capacity", "value", "first", "n", "per", "rank"]).astype({c: "Int64" for c in ("first", "per", "rank")})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, sizes, gaps = None, [], Gaps()
        for batch in batches:
            for row in batch.itertuples(index=False):
                here = (int(row.container_id), int(row.capacity))
                if here != at:
                    if at:
                        yield swept(*at, sizes, gaps)
                    at, sizes, gaps = here, [], Gaps()
                if row.kind == "size":
                    sizes.append((int(row.value), int(row.rank), int(row.n)))
                else:
                    gaps.put(int(row.value), int(row.first), int(row.n))
        if at:
            yield swept(*at, sizes, gaps)

    return run


def plan(sizes: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """(container_id, size, rank, n, bin, per) of sizes (container_id, capacity, size, n): the n texts of a size from rank on go to the containers from bin on, per to each."""
    spark = sizes.sparkSession
    ship(spark)
    none = F.lit(None).cast("long")
    start = sizes.select(F.lit("size").alias("kind"), "container_id", F.col("capacity").cast("long"), F.col("size").cast("long").alias("value"), none.alias("first"), F.col("n").cast("long"), none.alias("per"), F.lit(0).cast("long").alias("rank"))
    state, segments, opened = written(start, "classes"), [], {}
    ranges = -(-state.count() // range_rows)
    if ranges > 1:  # as many containers as the volume fills are there from the start
        need = F.floor(F.sum(F.col("n") * F.col("value")) / F.first("capacity")).cast("long")
        rows = [("gap", r["container_id"], r["capacity"], r["capacity"], 0, r["need"], None, None) for r in state.groupBy("container_id", "capacity").agg(need.alias("need")).collect()]  # the declared containers
        opened = {r[1]: r[5] for r in rows}
        state = state.unionByName(spark.createDataFrame(rows, CLASSES))
    order = ["container_id", F.desc("value"), "kind"]
    while ranges > 1:
        step = written(state.repartitionByRange(ranges, *order[:2]).sortWithinPartitions(*order).mapInPandas(_sweeps(None), CLASSES), "superstep")
        segments.append(step.where("kind = 'segment'"))
        state, ranges = step.where("kind <> 'segment'"), ranges // MERGED
    every = written(state.repartition("container_id").sortWithinPartitions(*order).mapInPandas(_sweeps(opened), CLASSES), "superstep")
    for segment in segments:
        every = every.unionByName(segment)
    return every.select("container_id", F.col("value").alias("size"), "rank", "n", F.col("first").alias("bin"), "per")


def pack(documents: DataFrame, containers: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, run_rows: int = RUN_ROWS, size: Column | None = None) -> DataFrame:
    """Each text in a container of each capacity: (container_id, capacity, bin, doc_id, part, first_token, tokens).

    Only texts longer than the capacity are cut: whole pieces of the capacity, then the rest as an item. bin
    numbers count from 0 per container_id. A null or empty text has no tokens, takes no room and comes out once
    per container with a null bin. Repeated rows of one id are items each. size: another measure than tokens of vocabulary.
    containers is a small fixed table; null or non-positive capacities are left out. Other columns of either table are not looked at.
    """
    length = token_count(F.col(text_col), vocabulary) if size is None else F.coalesce(size.cast("long"), F.lit(0).cast("long"))
    sizes = written(documents.select(F.col(id_col).alias("doc_id"), length.alias("n")), "sizes")
    kinds = [(r[0], r[1]) for r in containers.select("container_id", "capacity").where("capacity > 0").distinct().collect()]
    kind = "struct<container_id:int,capacity:int>"
    listed = F.from_json(F.lit("[" + ",".join(f'{{"container_id":{i},"capacity":{c}}}' for i, c in kinds) + "]"), f"array<{kind}>")
    each = sizes.select("doc_id", "n", F.explode(listed).alias("k")).select("doc_id", "n", "k.*")
    items = each.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0), F.floor((F.col("n") - 1) / F.col("capacity")))))).select(
        "container_id", "capacity", "doc_id", F.col("part").cast("int"), (F.col("part") * F.col("capacity")).alias("first_token"), F.least(F.col("capacity").cast("long"), F.col("n") - F.col("part") * F.col("capacity")).alias("tokens")
    )
    counts = written(items.where("tokens > 0").groupBy("container_id", "capacity", F.col("tokens").alias("size")).agg(F.count("*").alias("n")), "counts")
    segments = plan(counts).groupBy("container_id", F.col("size").alias("tokens")).agg(F.sort_array(F.collect_list(F.struct("rank", "bin", "per"))).alias("segments"))  # runs of one size
    classes = counts.select("container_id", F.col("size").alias("tokens"), F.ceil(F.col("n") / run_rows).alias("runs")).join(segments, ["container_id", "tokens"])
    classed = items.join(classes, ["container_id", "tokens"], "left").withColumn("run", F.coalesce(F.pmod(F.xxhash64("doc_id", "part"), F.col("runs")), F.lit(0)))
    cells = classed.groupBy("container_id", "tokens", "run").count()
    before = Window.partitionBy("container_id", "tokens").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cells.select("container_id", "tokens", "run", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    within = F.row_number().over(Window.partitionBy("container_id", "tokens", "run").orderBy("doc_id", "part")) - 1
    ranked = classed.withColumn("within", within).join(offsets, ["container_id", "tokens", "run"]).withColumn("rank", F.col("offset") + F.col("within"))
    seg = F.element_at(F.filter("segments", lambda s: s["rank"] <= F.col("rank")), -1)
    return ranked.withColumn("seg", seg).select("container_id", "capacity", (F.col("seg.bin") + F.floor((F.col("rank") - F.col("seg.rank")) / F.col("seg.per"))).alias("bin"), "doc_id", "part", "first_token", "tokens")


def fill(packed: DataFrame) -> DataFrame:
    """Per capacity: containers used, the least number possible by volume, tokens and the share of room that is filled."""
    per = packed.where("bin is not null").groupBy("container_id", "capacity", "bin").agg(F.sum("tokens").alias("t"))
    out = per.groupBy("container_id", "capacity").agg(F.count("*").alias("bins"), F.sum("t").alias("tokens"), F.max("t").alias("fullest"))
    return out.withColumn("least_bins", F.ceil(F.col("tokens") / F.col("capacity"))).withColumn("filled", F.col("tokens") / (F.col("bins") * F.col("capacity")))
