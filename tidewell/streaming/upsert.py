"""Streaming upsert and streaming daily rollups.

Each micro-batch is written under its own batch id, so a replayed batch replaces
itself, and the cost of a batch follows the batch, not the target. Readers merge
base and changes; ``compact`` folds the changes into a new base when wanted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.casts import column_type, ref
from ..operators.aggregate import Metric, measure
from ..sinks.merge import dedupe_latest, merge
from ..sinks.tables import LoadResult, full_refresh


def _batch_path(root: str, batch_id: int) -> str:
    return f"{root.rstrip('/')}/batch_id={batch_id}"


def _start(stream: DataFrame, root: str) -> None:
    """An empty batch, so that readers find the columns before any data arrives."""
    empty = stream.sparkSession.createDataFrame([], stream.schema)
    empty.write.mode("overwrite").parquet(_batch_path(root, -1))


def stream_changes(stream: DataFrame, keys: list[str], changes: str, checkpoint: str,
                   cursor: str | None = None, wait: bool = True):
    """Land every available micro-batch, one row per key, under its batch id."""
    _start(stream, changes)

    def land(batch: DataFrame, batch_id: int) -> None:
        (dedupe_latest(batch, keys, cursor)
         .write.mode("overwrite").parquet(_batch_path(changes, batch_id)))

    query = (stream.writeStream.foreachBatch(land)
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    if wait:
        query.awaitTermination()
    return query


def read_changes(spark: SparkSession, changes: str) -> DataFrame:
    return spark.read.option("mergeSchema", "true").parquet(changes)


def current_state(base: DataFrame, changes: DataFrame, keys: list[str],
                  cursor: str | None = None) -> DataFrame:
    """Base with all landed changes; the latest change of a key wins.

    Without a cursor the later batch wins.
    """
    rows = changes.drop("batch_id") if cursor else changes
    merged = merge(base, rows, keys, cursor or "batch_id")
    return merged.drop("batch_id")


def compact(base: DataFrame, changes: DataFrame, keys: list[str], table: str, root: str,
            cursor: str | None = None) -> LoadResult:
    return full_refresh(current_state(base, changes, keys, cursor), table, root)


def stream_daily(stream: DataFrame, time_column: str, out: str, checkpoint: str,
                 metric: Metric | None = None, by: list[str] = (), delay: str = "2 days",
                 wait: bool = True):
    """Daily values over arriving rows; days later than ``delay`` are closed.

    Each micro-batch lands the days it changed under its batch id.
    """
    when: Column = ref(stream, time_column)
    if not isinstance(column_type(stream, time_column), T.TimestampType):
        when = when.cast("timestamp")
    timed = stream.withColumn("__at", when).withWatermark("__at", delay)
    value = measure(timed, metric or Metric(None, "COUNT_STAR")).alias("value")
    daily = timed.groupBy(F.window("__at", "1 day").alias("w"), *by).agg(value).select(
        F.to_date("w.start").alias("bucket"), *by, "value")

    _start(daily, out)

    def land(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(_batch_path(out, batch_id))

    query = (daily.writeStream.outputMode("update").foreachBatch(land)
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    if wait:
        query.awaitTermination()
    return query


def daily_state(landed: DataFrame, by: list[str] = ()) -> DataFrame:
    """Newest landed value per day."""
    return landed.groupBy("bucket", *by).agg(F.max_by("value", "batch_id").alias("value"))
