"""Notes and cells as streams: new notes into cells, batches of cells into a wide table, windowed counts of events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.pivot import WideStore
from ..sources.markdown import parse_binary


def note_stream(spark: SparkSession, root: str, data: str = "data") -> DataFrame:
    """Cells of notes as they are added under root."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", "*.md").load(f"{root}/{data}/*/")
    return parse_binary(files)


def into_store(cells: DataFrame, store: WideStore, checkpoint: str, compact_every: int = 20, **trigger) -> StreamingQuery:
    """Upsert each micro-batch of cells into a wide store; a batch that is repeated after a failure changes nothing."""

    def upsert(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            store.upsert(batch)
            if number % compact_every == compact_every - 1:
                store.compact()

    return cells.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def windowed(events: DataFrame, time: str, length: str, lateness: str, keys: list[str], **aggregates) -> DataFrame:
    """Aggregates by time window and keys; rows later than lateness are dropped and state is kept no longer."""
    grouped = events.withWatermark(time, lateness).groupBy(F.window(time, length), *keys)
    return grouped.agg(*[c.alias(n) for n, c in aggregates.items()]).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, *aggregates)


def on_change(spark: SparkSession, root: str, handle: Callable[[DataFrame], None], checkpoint: str, data: str = "data") -> StreamingQuery:
    """Call handle with the cells of each batch of new notes."""
    return note_stream(spark, root, data).writeStream.foreachBatch(lambda df, _: handle(df)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
