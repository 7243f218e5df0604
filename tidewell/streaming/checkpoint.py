"""High-water marks, checkpoint tables, and the log of marks that syncs append to."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.casts import (NUMBER_TEXT, column_type, is_numeric, ref, text_to_time,
                               ts)
from ..session import exists

# Cursor columns by preference.
CURSOR_CANDIDATES = ["synced_at", "updated_at", "modified_at", "created_at", "range_end", "date"]


def watermark(df: DataFrame, cursor_col: str | None = None) -> DataFrame:
    """One row: the first candidate with a time in it, and its newest value as text.

    An explicit cursor column replaces the candidates. A column of numbers, such as epoch seconds,
    is compared as numbers. Of texts that mean the same time the smallest is taken. Without any
    time both columns are NULL.
    """
    names = [cursor_col] if cursor_col else [c for c in CURSOR_CANDIDATES if c in df.columns]
    none = F.lit(None).cast("string")
    # One candidate after the other: each pass reads one column, and mostly the
    # first one settles it. That column is read again for the text of the time.
    for name in names:
        if is_numeric(column_type(df, name)):
            order = F.when(~F.isnan(ref(df, name).cast("double")), ref(df, name))
        else:
            order = F.unix_micros(ts(df, name).cast("timestamp"))
        top = df.agg(F.max(order)).first()[0]
        if top is not None:
            return df.where(order == F.lit(top)).agg(
                F.lit(name).alias("cursor_field"),
                F.min(ref(df, name).cast("string")).alias("cursor_value"))
    return df.sparkSession.range(1).select(none.alias("cursor_field"),
                                           none.alias("cursor_value"))


def _exact_number(text: Column) -> Column:
    return F.when(text.rlike(NUMBER_TEXT), F.trim(text).try_cast("decimal(38,9)"))


def advance(state: DataFrame, marks: DataFrame, as_of: Column) -> DataFrame:
    """Checkpoint rows after a sync.

    ``marks`` has one row per flow: flow_id, cursor_field, cursor_value, rows.
    Row totals add up. A checkpoint on the same field never moves back: times are compared as
    times and numbers as numbers, and where the two cannot be compared it stays.
    """
    new = marks.select("flow_id", F.col("cursor_field").alias("nf"),
                       F.col("cursor_value").alias("nv"), F.col("rows").alias("nr"))
    joined = state.join(new, "flow_id", "full_outer")
    same = (F.col("nf") == F.col("cursor_field")) & F.col("cursor_value").isNotNull()
    forward = F.coalesce(*[read(F.col("nv")) >= read(F.col("cursor_value"))
                           for read in (text_to_time, _exact_number)], F.lit(False))
    moved = F.col("nv").isNotNull() & (~F.coalesce(same, F.lit(False)) | forward)
    zero = F.lit(0).cast("long")
    return joined.select(
        "flow_id",
        F.when(moved, F.col("nf")).otherwise(F.col("cursor_field")).alias("cursor_field"),
        F.when(moved, F.col("nv")).otherwise(F.col("cursor_value")).alias("cursor_value"),
        F.when(F.col("nr").isNotNull(), as_of).otherwise(F.col("watermark_at"))
        .cast("timestamp").alias("watermark_at"),
        (F.coalesce("rows_since", zero) + F.coalesce("nr", zero)).alias("rows_since"))


STATE_SCHEMA = ("flow_id string, cursor_field string, cursor_value string, "
                "watermark_at timestamp, rows_since bigint")


def clear(state: DataFrame, flow_id: str) -> DataFrame:
    return state.where(F.col("flow_id") != flow_id)


# -- the log of marks --------------------------------------------------------------

MARKS_SCHEMA = ("flow_id string, cursor_field string, cursor_value string, rows bigint, "
                "watermark_at timestamp, mark string")


def append_marks(marks: DataFrame, path: str, as_of: Column) -> None:
    """Add marks (flow_id, cursor_field, cursor_value, rows) to a log.

    Every append has a folder of its own, so flows that end together do not meet.
    """
    mark = uuid.uuid4().hex
    (marks.select("flow_id", "cursor_field", "cursor_value", F.col("rows").cast("long").alias("rows"),
                  as_of.cast("timestamp").alias("watermark_at"), F.lit(mark).alias("mark"))
     .write.parquet(f"{path.rstrip('/')}/{mark}"))


def read_marks(spark: SparkSession, path: str) -> DataFrame:
    """All marks of a log; none where it was never written."""
    if not exists(spark, path):
        return spark.createDataFrame([], MARKS_SCHEMA)
    return spark.read.schema(MARKS_SCHEMA).option("recursiveFileLookup", "true").parquet(path)


def folded(marks: DataFrame) -> DataFrame:
    """The checkpoint of each flow after all its marks, as ``STATE_SCHEMA``.

    The newest mark with a cursor names the field. Of that field's marks the largest counts, as
    times if the first one is a time, else as numbers; where it is neither, the first one stays.
    Two aggregates: marks combine per flow and field before they are shuffled.
    """
    at = F.struct("watermark_at", "mark")
    value = F.col("cursor_value")
    time, number = text_to_time(value), _exact_number(value)
    has = value.isNotNull() & F.col("cursor_field").isNotNull()

    def largest(order: Column) -> Column:
        return F.max_by(F.when(has & order.isNotNull(), value),
                        F.when(has & order.isNotNull(), order))

    per_field = marks.groupBy("flow_id", "cursor_field").agg(
        F.max(F.when(has, at)).alias("newest"), F.max("watermark_at").alias("watermark_at"),
        F.sum("rows").alias("rows"), F.min_by(value, F.when(has, at)).alias("first"),
        largest(time).alias("by_time"), largest(number).alias("by_number"))
    settled = (F.when(text_to_time(F.col("first")).isNotNull(), F.col("by_time"))
               .when(_exact_number(F.col("first")).isNotNull(), F.col("by_number"))
               .otherwise(F.col("first")))
    now = F.struct("cursor_field", settled.alias("cursor_value"))
    return per_field.groupBy("flow_id").agg(
        F.max_by(F.when(F.col("newest").isNotNull(), now), "newest").alias("now"),
        F.max("watermark_at").alias("watermark_at"),
        F.coalesce(F.sum("rows"), F.lit(0)).cast("long").alias("rows_since")).select(
        "flow_id", "now.cursor_field", "now.cursor_value", "watermark_at", "rows_since")
