"""Structured Streaming ingestion: landing files in micro-batches, de-duplicated across batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from hearthmill.operators.relational import anti_null_safe
from hearthmill.plans.store import TableStore


def landing(spark: SparkSession, path: str, schema: str, kind: str = "parquet", files_per_batch: int = 100, **options: str) -> DataFrame:
    """A folder as a stream: files already taken are known from the checkpoint, never from their content."""
    return spark.readStream.format(kind).schema(schema).option("maxFilesPerTrigger", str(files_per_batch)).options(**options).load(path)


def append_batches(stream: DataFrame, store: TableStore, table: str, keys: list[str], checkpoint: str, after: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Take what is there in micro-batches, then stop: each batch adds its rows of new keys (null equal to null).

    A batch that is run again after a failure adds nothing twice: its keys are in the table by then.
    """

    def take(batch: DataFrame, number: int) -> None:
        rows = batch.dropDuplicates(keys)
        if store.exists(table):
            rows = anti_null_safe(rows, store.read(table), keys)
        store.append(table, rows)
        if after:
            after(batch, number)

    return stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def distinct_within(stream: DataFrame, keys: list[str], event_time: str, delay: str) -> DataFrame:
    """First row of each key among rows whose event times lie within ``delay``; the state is dropped behind the watermark."""
    return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(keys)


def newest_first(stream: DataFrame, mark: str, high_water: object | None) -> DataFrame:
    """Rows past a high-water mark; late ones are dropped. Without a mark all pass."""
    return stream if high_water is None else stream.where(F.col(mark) > F.lit(high_water))


def windowed_counts(stream: DataFrame, event_time: str, keys: list[str], value: str, width: str = "1 hour", slide: str | None = None, delay: str = "2 hours") -> DataFrame:
    """Count and sum for each event-time window and key; windows close behind the watermark (an extra of this engine)."""
    w = F.window(event_time, width, slide) if slide else F.window(event_time, width)
    return stream.withWatermark(event_time, delay).groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select("w.start", "w.end", *keys, "n", "total")
