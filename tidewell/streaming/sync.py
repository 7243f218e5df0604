"""Batch syncs: incremental with a checkpoint, and full refresh of many objects."""

from __future__ import annotations

import time
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import safe_name
from ..sinks.buckets import layout, merge_into
from ..sinks.tables import counted_write, full_refresh
from ..sources.records import sanitize
from ..sources.relational import extract
from .checkpoint import append_marks, folded, read_marks, watermark

RUN_SCHEMA = ("id string, flow_id string, status string, rows bigint, duration_ms bigint, "
              "error string, started_ms bigint")


@dataclass(frozen=True)
class SourceObject:
    """An object of a source: where it lands, its keys and its cursor."""

    name: str
    table: str
    keys: tuple[str, ...] = ()
    cursor: str | None = None


@dataclass(frozen=True)
class SyncResult:
    rows: int
    columns_added: tuple[str, ...] = ()
    target_rows: int | None = None
    rows_written: int = 0


def marks_path(root: str, state_table: str) -> str:
    return f"{root.rstrip('/')}/{safe_name(state_table)}/marks"


def checkpoints(spark: SparkSession, root: str, state_table: str = "sync_state") -> DataFrame:
    """The checkpoints of all flows, as ``STATE_SCHEMA``."""
    return folded(read_marks(spark, marks_path(root, state_table)))


def checkpoint_of(spark: SparkSession, root: str, state_table: str, flow_id: str):
    marks = read_marks(spark, marks_path(root, state_table))
    return folded(marks.where(F.col("flow_id") == flow_id)).first()


def incremental_sync(source: DataFrame, obj: SourceObject, flow_id: str, root: str,
                     state_table: str = "sync_state", buckets: int | None = None) -> SyncResult:
    """Extract from the checkpoint on, merge into the target, then add a mark.

    The boundary is read again (``>=``); keys make that harmless. Only buckets of the target that
    the batch touches are rewritten. The mark is added after the merge is in place, so a crash in
    between repeats the batch and changes nothing. Marks are appended, so flows that end together
    keep both checkpoints.
    """
    if not obj.keys:
        raise ValueError("an incremental sync needs key columns")
    spark = source.sparkSession
    mark = checkpoint_of(spark, root, state_table, flow_id)
    since = mark["cursor_value"] if mark else None
    field = obj.cursor or (mark["cursor_field"] if mark else None)
    wanted = sanitize(extract(source, since, [field] if since and field else None))
    # Stage the batch: the merge and the checkpoint must see the same rows even if
    # the source moves on or a lost executor has to be replaced.
    staging = f"{root.rstrip('/')}/staging/{safe_name(obj.table)}-{uuid.uuid4().hex}"
    count = counted_write(wanted, staging)
    if count == 0:
        return SyncResult(0)
    batch = spark.read.schema(wanted.schema).parquet(staging)
    first = layout(spark, obj.table) is None
    done = merge_into(batch, obj.table, list(obj.keys), root, obj.cursor, buckets)
    marks = watermark(batch, obj.cursor).select(
        F.lit(flow_id).alias("flow_id"), "cursor_field", "cursor_value",
        F.lit(count).cast("long").alias("rows"))
    append_marks(marks, marks_path(root, state_table), F.current_timestamp())
    return SyncResult(count, () if first else done.columns_added, done.target_rows,
                      done.rows_written)


def _run_log(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    raw = spark.createDataFrame(rows, RUN_SCHEMA)
    return raw.withColumn("started_at", F.timestamp_millis("started_ms")).drop("started_ms")


def _attempt(work) -> tuple:
    """Run one sync: (id, status, rows, duration_ms, error, started_ms)."""
    started, clock = int(time.time() * 1000), time.monotonic()
    status, rows, error = "success", None, None
    try:
        rows = work()
    except Exception as e:  # the log records the failure; other syncs go on
        status, error = "failed", str(e)
    took = int((time.monotonic() - clock) * 1000)
    return uuid.uuid4().hex, status, rows, took, error, started


def logged_sync(source: DataFrame, obj: SourceObject, flow_id: str, root: str, runs_path: str,
                state_table: str = "sync_state") -> DataFrame:
    """Incremental sync that appends its outcome to the run log; returns that row."""
    run_id, *outcome = _attempt(
        lambda: incremental_sync(source, obj, flow_id, root, state_table).rows)
    run = _run_log(source.sparkSession, [(run_id, flow_id, *outcome)])
    run.write.mode("append").parquet(runs_path)
    return run


def sync_all(objects: dict[SourceObject, DataFrame], root: str,
             flow_id: str = "all") -> DataFrame:
    """Full refresh of every object; one that fails does not stop the others.

    Returns the run log, one row per object.
    """
    rows = []
    for obj, df in objects.items():
        run_id, *outcome = _attempt(
            lambda o=obj, d=df: full_refresh(sanitize(d), o.table, root).rows_found)
        rows.append((run_id, f"{flow_id}/{obj.name}", *outcome))
    return _run_log(next(iter(objects.values())).sparkSession, rows)
