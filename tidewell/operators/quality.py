"""Duplicates, freshness and table health."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.casts import like_time, ref, ts
from ..functions.filters import all_of
from ..functions.times import lag_hours
from ..plans.semantic import classify_schema

STALE_HOURS = 30
PROBES = 4                  # tables looked at together


def duplicate_check(df: DataFrame, keys: str | list[str]) -> DataFrame:
    """Groups of rows that share a key, and the rows beyond one per group."""
    names = [keys] if isinstance(keys, str) else list(keys)
    rows = df.where(all_of([ref(df, k).isNotNull() for k in names]))
    repeated = (rows.groupBy(*[ref(df, k) for k in names])
                .agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1))
    return excess(repeated)


def excess(repeated: DataFrame) -> DataFrame:
    """Groups of (n) rows each, and the rows beyond one per group."""
    return repeated.agg(F.count(F.lit(1)).alias("duplicate_groups"),
                        (F.sum("n") - F.count(F.lit(1))).alias("excess_rows"))


def freshness(df: DataFrame, time_column: str, as_of=None) -> DataFrame:
    """Newest time, whole hours since then, and rows."""
    newest = df.agg(F.max(ts(df, time_column)).alias("latest"),
                    F.count(F.lit(1)).alias("total_rows"))
    return aged(newest, like_time(df, time_column, as_of))


def aged(newest: DataFrame, now: Column) -> DataFrame:
    """The newest time (latest, total_rows) with its age."""
    return newest.select(F.col("latest").cast("string").alias("latest"),
                         lag_hours(F.col("latest"), now).alias("lag_hours"), "total_rows")


def health_status(lag: Column, stale_hours: int = STALE_HOURS) -> Column:
    return (F.when(lag.isNull(), F.lit("unknown"))
            .when(lag > stale_hours, F.lit("stale")).otherwise(F.lit("healthy")))


HEALTH = ("table_name string, status string, lag_hours long, latest string, total_rows long, "
          "time_column string, error string")


def _health_row(name: str, table, time_column: str | None, find: bool, as_of,
                stale_hours: int) -> tuple:
    """One table's health; what goes wrong in reading it is part of the row."""
    column = time_column
    try:
        df = table() if callable(table) else table
        if find:
            column = next((m.name for m in classify_schema(df) if m.role == "time"), None)
        if column is None or column not in df.columns:
            return name, "unknown", None, None, None, None, None
        row = freshness(df, column, as_of).select(
            health_status(F.col("lag_hours"), stale_hours).alias("status"), "lag_hours", "latest",
            "total_rows").first()
        return name, *row, column, None
    except Exception as e:  # one broken table must not cost the others
        return name, "unknown", None, None, None, column, f"{type(e).__name__}: {e}"


def table_health(tables: dict, time_columns: dict[str, str | None] | None = None,
                 as_of=None, stale_hours: int = STALE_HOURS) -> DataFrame:
    """Freshness of many tables in one frame; no time column means unknown.

    ``tables`` maps names to frames, or to functions that open one. Each is probed on its own, by its
    schema and one aggregate, and a table that fails has the error in its row. The time column is the
    first that the classifier takes for one, unless ``time_columns`` names it. Probes run at once, a
    few at a time.
    """
    if not tables:
        raise ValueError("no tables")
    work = [(name, table, (time_columns or {}).get(name), time_columns is None or
             name not in time_columns, as_of, stale_hours) for name, table in tables.items()]
    with ThreadPoolExecutor(PROBES) as pool:
        rows = list(pool.map(lambda args: _health_row(*args), work))
    return SparkSession.getActiveSession().createDataFrame(rows, HEALTH)


def stale_count(health: DataFrame) -> DataFrame:
    return health.agg(F.count_if(F.col("status") == "stale").alias("stale_tables"),
                      F.count(F.lit(1)).alias("tables"))
