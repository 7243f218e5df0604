"""Run history rows for export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def run_history(runs: DataFrame, flows: DataFrame, as_of: Column, n_days: int = 30,
                n: int | None = None) -> DataFrame:
    """Runs of the window with source and destination, newest first: all, or the first ``n``."""
    rows = runs.where(F.col("started_at") >= as_of - F.make_dt_interval(F.lit(n_days)))
    named = rows.join(flows.select(F.col("id").alias("flow_id"), F.col("source_id").alias("source"),
                                   F.col("dest_id").alias("destination")), "flow_id")
    ordered = named.orderBy(F.desc("started_at"), "id")
    return (ordered if n is None else ordered.limit(n)).select(
        "id", "source", "destination", "status", "rows", "duration_ms", "trigger_by", "started_at",
        "error")
