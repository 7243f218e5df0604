"""Watermarks, checkpoints, incremental syncs, streams."""

from pyspark.sql import functions as F

from ..operators.aggregate import Metric
from ..session import fresh_dir
from ..streaming.checkpoint import (STATE_SCHEMA, advance, append_marks, folded, read_marks,
                                    watermark)
from ..streaming.sync import SourceObject, checkpoint_of, incremental_sync, sync_all
from ..streaming.upsert import (current_state, daily_state, read_changes, stream_changes,
                                stream_daily)
from .base import as_of, dated, query, rounded, timed
from .loads import changed_orders, stored_orders, unique


@query("watermark", """
SELECT 'updated_at' AS cursor_field, strftime(max(l_shipdate), '%Y-%m-%dT%H:%M:%SZ') AS
  cursor_value FROM lineitem WHERE l_returnflag <> 'N'""")
def marks(t):
    # synced_at never parses, updated_at sometimes does: the second field is the cursor
    rows = t.lineitem.select(
        F.lit("pending").alias("synced_at"),
        F.when(F.col("l_returnflag") != "N",
               F.date_format("l_shipdate", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .otherwise(F.lit("")).alias("updated_at"),
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("created_at"))
    return watermark(rows)


@query("watermark_epoch", """
SELECT 'created' AS cursor_field,
  CAST(CAST(max(floor(epoch(ts))) AS BIGINT) AS VARCHAR) AS cursor_value FROM events""")
def epoch_marks(t):
    created = F.unix_seconds(F.col("ts").cast("timestamp"))
    return watermark(t.events.select(created.alias("created")), "created")


@query("checkpoint_epoch", """
SELECT event_type AS flow_id, 'created' AS cursor_field,
  CAST(CAST(max(user_id) * 1000000 AS BIGINT) AS VARCHAR) AS cursor_value,
  '2024-01-31 00:00:00' AS watermark_at, 2 * count(*) AS rows_since FROM events GROUP BY 1""")
def epoch_checkpoints(t):
    def marks_of(value):
        return t.events.groupBy(F.col("event_type").alias("flow_id")).agg(
            F.lit("created").alias("cursor_field"),
            (value * 1_000_000).cast("long").cast("string").alias("cursor_value"),
            F.count(F.lit(1)).alias("rows"))

    # smaller numbers second, some of them longer as text order has it: none moves a checkpoint
    empty = t.spark.createDataFrame([], STATE_SCHEMA)
    state = advance(empty, marks_of(F.max("user_id")), as_of())
    return timed(advance(state, marks_of(F.min("user_id")), as_of()), "watermark_at")


_LATEST = """SELECT CAST(o_custkey AS VARCHAR) AS flow_id, 'date' AS cursor_field,
  strftime(max(o_orderdate), '%Y-%m-%d') AS cursor_value, count(*) AS rows FROM orders"""


@query("checkpoint", f"""
WITH a AS ({_LATEST} WHERE o_orderdate < TIMESTAMP '1999-01-01' GROUP BY 1),
  b AS ({_LATEST} WHERE o_orderdate >= TIMESTAMP '1997-01-01' GROUP BY 1)
SELECT coalesce(a.flow_id, b.flow_id) AS flow_id, 'date' AS cursor_field,
  coalesce(greatest(a.cursor_value, b.cursor_value), a.cursor_value, b.cursor_value)
    AS cursor_value,
  '2024-01-31 00:00:00' AS watermark_at, coalesce(a.rows, 0) + coalesce(b.rows, 0) AS rows_since
FROM a FULL JOIN b ON a.flow_id = b.flow_id""")
def checkpoints(t):
    def latest(df):
        return df.groupBy(F.col("o_custkey").cast("string").alias("flow_id")).agg(
            F.lit("date").alias("cursor_field"),
            F.date_format(F.max("o_orderdate"), "yyyy-MM-dd").alias("cursor_value"),
            F.count(F.lit(1)).alias("rows"))

    empty = t.spark.createDataFrame([], STATE_SCHEMA)
    # the newer rows first: the older ones must not move a checkpoint back
    state = advance(empty, latest(changed_orders(t)), as_of())
    return timed(advance(state, latest(stored_orders(t)), as_of()), "watermark_at")


@query("checkpoint_log", f"""
WITH a AS ({_LATEST} WHERE o_orderdate < TIMESTAMP '1999-01-01' GROUP BY 1),
  b AS ({_LATEST} WHERE o_orderdate >= TIMESTAMP '1997-01-01' GROUP BY 1)
SELECT coalesce(a.flow_id, b.flow_id) AS flow_id, 'date' AS cursor_field,
  coalesce(greatest(a.cursor_value, b.cursor_value), a.cursor_value, b.cursor_value)
    AS cursor_value,
  '2024-01-31 00:00:00' AS watermark_at, coalesce(a.rows, 0) + coalesce(b.rows, 0) AS rows_since
FROM a FULL JOIN b ON a.flow_id = b.flow_id""")
def checkpoint_log(t):
    path = fresh_dir(t.spark, "marks")
    for part in (changed_orders(t), stored_orders(t)):      # the newer rows first
        append_marks(part.groupBy(F.col("o_custkey").cast("string").alias("flow_id")).agg(
            F.lit("date").alias("cursor_field"),
            F.date_format(F.max("o_orderdate"), "yyyy-MM-dd").alias("cursor_value"),
            F.count(F.lit(1)).alias("rows")), path, as_of())
    return timed(folded(read_marks(t.spark, path)), "watermark_at")


@query("incremental_sync", """
SELECT count(*) AS rows, round(sum(o_totalprice
    + CASE WHEN o_orderdate >= TIMESTAMP '1998-12-31' THEN 1 ELSE 0 END), 2) AS price,
  strftime(max(o_orderdate), '%Y-%m-%d %H:%M:%S') AS cursor_value,
  count(*) FILTER (o_orderdate < TIMESTAMP '1999-01-01')
    + count(*) FILTER (o_orderdate >= (SELECT max(o_orderdate) FROM orders
      WHERE o_orderdate < TIMESTAMP '1999-01-01'))
    + count(*) FILTER (o_orderdate = (SELECT max(o_orderdate) FROM orders)) AS rows_since
FROM orders""")
def incremental(t):
    root, table, state = fresh_dir(t.spark, "sync"), unique("orders"), unique("state")
    obj = SourceObject("orders", table, ("o_orderkey",), "o_orderdate")
    # first sync: what is there by 1999; second: everything, with later prices raised
    incremental_sync(stored_orders(t), obj, "f1", root, state)
    raised = t.orders.withColumn("o_totalprice", F.col("o_totalprice") + F.when(
        F.col("o_orderdate") >= F.lit("1998-12-31").cast("timestamp_ntz"), 1).otherwise(0))
    incremental_sync(raised, obj, "f1", root, state)
    # third: only the boundary day is read again, which changes nothing
    incremental_sync(raised, obj, "f1", root, state)
    mark = checkpoint_of(t.spark, root, state, "f1")
    return t.spark.table(table).agg(
        F.count(F.lit(1)).alias("rows"), F.round(F.sum("o_totalprice"), 2).alias("price"),
        F.lit(mark["cursor_value"]).alias("cursor_value"),
        F.lit(mark["rows_since"]).cast("bigint").alias("rows_since"))


def _event_stream(t):
    # a pattern, because the stream source takes no path of a single file; it matches that one only
    return t.spark.readStream.schema(t.events.schema).parquet(f"{t.folder}/[e]vents.parquet")


@query("stream_upsert", """
SELECT c_custkey AS user_id, c_name, e.last_type, e.last_value FROM customer LEFT JOIN (
  SELECT user_id, arg_max(event_type, ts) AS last_type, arg_max(value, ts) AS last_value
  FROM events GROUP BY 1) e ON e.user_id = c_custkey""")
def stream_upsert(t):
    root = fresh_dir(t.spark, "stream-upsert")
    stream = _event_stream(t).select("user_id", "ts", F.col("event_type").alias("last_type"),
                                     F.col("value").alias("last_value"))
    stream_changes(stream, ["user_id"], f"{root}/changes", f"{root}/checkpoint", cursor="ts")
    base = t.customer.select(F.col("c_custkey").alias("user_id"), "c_name")
    state = current_state(base, read_changes(t.spark, f"{root}/changes"), ["user_id"], "ts")
    return state.select("user_id", "c_name", "last_type", "last_value")


@query("stream_daily", """
SELECT strftime(CAST(ts AS DATE), '%Y-%m-%d') AS bucket, event_type,
  round(sum(value), 4) AS value FROM events GROUP BY 1, 2""")
def stream_days(t):
    root = fresh_dir(t.spark, "stream-daily")
    stream_daily(_event_stream(t), "ts", f"{root}/days", f"{root}/checkpoint",
                 Metric("value", "SUM"), ["event_type"])
    landed = t.spark.read.parquet(f"{root}/days")
    return rounded(dated(daily_state(landed, ["event_type"]), "bucket"), value=4)


@query("sync_all", """
SELECT flow_id, status, rows FROM (
  SELECT 'all/nation' AS flow_id, 'success' AS status, count(*) AS rows FROM nation
  UNION ALL SELECT 'all/part', 'success', count(*) FROM part
  UNION ALL SELECT 'all/events', 'success', count(*) FROM events)""")
def sync_objects(t):
    root = fresh_dir(t.spark, "sync-all")
    objects = {SourceObject(n, unique(n)): getattr(t, n) for n in ("nation", "part", "events")}
    return sync_all(objects, root).select("flow_id", "status", "rows")
