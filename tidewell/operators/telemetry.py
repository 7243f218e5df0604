"""Statistics over operational logs: runs, flows, jobs, usage, query cost.

Input columns: runs (id, flow_id, status, rows, duration_ms, started_at),
flows (id, user_id, source_id, status, ...), jobs (status, updated_at),
usage (workspace_id, metric, quantity, created_at), queries (bytes, created_at).
Runs are combined per flow before they meet the flows table: a flow with a large
part of all runs then brings one row to the join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.casts import column_type, is_numeric
from .joins import latest_n_per_key
from .order_stats import log_bin

FAILED = ["failed", "error"]
# Size estimate per synced row and scan price.
BYTES_PER_ROW = 500
USD_PER_TB = 6.25
LOAD_HISTORY = 200


def is_success(status: Column) -> Column:
    return status == "success"


def is_failure(status: Column) -> Column:
    return status.isin(FAILED)


def recent(df: DataFrame, time_column: str, as_of: Column, n_days: int) -> DataFrame:
    """Rows of the last ``n_days``; a column of numbers holds epoch milliseconds."""
    start = as_of - F.make_dt_interval(F.lit(n_days))
    if is_numeric(column_type(df, time_column)):
        start = F.unix_millis(start.cast("timestamp"))
    return df.where(F.col(time_column) >= start)


def due(flows: DataFrame, as_of: Column, limit: int | None = None) -> DataFrame:
    """Flows (id, status, next_run_at) that are due, the longest waiting first; paused ones wait."""
    now = as_of
    if is_numeric(column_type(flows, "next_run_at")):
        now = F.unix_millis(as_of.cast("timestamp"))
    rows = flows.where((F.col("next_run_at") <= now) & (F.col("status") != "paused"))
    rows = rows.orderBy("next_run_at", "id")
    return rows if limit is None else rows.limit(limit)


def _flow_rollup(runs: DataFrame) -> DataFrame:
    ok, bad = is_success(F.col("status")), is_failure(F.col("status"))
    return runs.groupBy("flow_id").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(ok).alias("success"),
        F.count_if(bad).alias("failed"),
        F.sum("rows").alias("rows"),
        F.sum(F.when(ok, F.col("rows"))).alias("success_rows"),
        F.sum("duration_ms").alias("ms"), F.count("duration_ms").alias("timed"),
        F.sum(F.when(ok, F.col("duration_ms"))).alias("success_ms"),
        F.count(F.when(ok, F.col("duration_ms"))).alias("success_timed"),
        F.max("started_at").alias("last_run_at"))


def run_stats(runs: DataFrame, flows: DataFrame | None = None, by: list[str] = (),
              empty_rate: float = 0.0) -> DataFrame:
    """Totals, success rate, mean durations, rows and estimated size."""
    per_flow = _flow_rollup(runs)
    if flows is not None:
        per_flow = per_flow.join(
            flows.select(F.col("id").alias("flow_id"), *by), "flow_id")
    zero = F.lit(0)
    grouped = per_flow.groupBy(*by) if by else per_flow
    out = grouped.agg(
        F.coalesce(F.sum("total"), zero).alias("total_runs"),
        F.coalesce(F.sum("success"), zero).alias("success_runs"),
        F.coalesce(F.sum("failed"), zero).alias("failed_runs"),
        F.coalesce(F.sum("rows"), zero).alias("total_rows"),
        F.try_divide(F.sum("ms"), F.sum("timed")).alias("avg_ms"),
        F.try_divide(F.sum("success_ms"), F.sum("success_timed")).alias("avg_success_ms"))
    rate = F.round(F.try_divide(F.col("success_runs") * 100.0, F.col("total_runs")), 1)
    return (out.withColumn("success_rate", F.coalesce(rate, F.lit(float(empty_rate))))
            .withColumn("data_gb", F.round(F.col("total_rows") * BYTES_PER_ROW / 1e9, 2)))


def error_rates(runs: DataFrame, flows: DataFrame, as_of: Column, n_days: int = 7,
                above: float = 0.1) -> DataFrame:
    """Flows whose share of failed runs in the window is above a bound."""
    per_flow = (recent(runs, "started_at", as_of, n_days).groupBy("flow_id")
                .agg(F.count(F.lit(1)).alias("total"),
                     F.count_if(is_failure(F.col("status"))).alias("errors"))
                .where(F.col("errors") > F.col("total") * above))
    named = per_flow.join(flows.select(F.col("id").alias("flow_id"), "source_id"), "flow_id")
    return named.withColumn("error_pct", F.round(F.col("errors") * 100.0 / F.col("total")))


def value_at(counts: DataFrame, keys: list[str], value: str, place: Column) -> DataFrame:
    """keys, ``at``: per key the value at a 0-based place, from rows (keys, value, n).

    ``place`` is made of ``total``, the number of values. Values are combined to some thousand bins
    per key; only those of the bin that holds the place are put in order.
    """
    own = Window.partitionBy(*keys)
    upto = lambda order: F.sum("n").over(
        own.orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    bins = counts.groupBy(*keys, log_bin(F.col(value)).alias("bin")).agg(F.sum("n").alias("n"))
    hit = (bins.withColumns({"upto": upto("bin"), "total": F.sum("n").over(own)})
           .withColumn("k", place)
           .where((F.col("k") < F.col("upto")) & (F.col("k") >= F.col("upto") - F.col("n")))
           .select(*keys, "bin", (F.col("k") - F.col("upto") + F.col("n")).alias("k")))
    inside = counts.withColumn("bin", log_bin(F.col(value))).join(hit, [*keys, "bin"])
    return (inside.withColumn("upto", upto(value)).where(F.col("upto") > F.col("k"))
            .groupBy(*keys).agg(F.min(value).alias("at")))


def load_durations(runs: DataFrame, flows: DataFrame,
                   newest: int | None = LOAD_HISTORY) -> DataFrame:
    """Count, mean, p95 (``sorted[floor(0.95 n)]``) and last run per flow.

    Looks at the newest ``newest`` timed runs of a flow, or at all of them for None. Equal
    durations are combined before they are shuffled, and no list of them is made.
    """
    kept = runs.where(F.col("duration_ms").isNotNull())
    if newest is not None:
        kept = latest_n_per_key(kept, ["flow_id"], [F.desc("started_at"), F.asc("id")], newest,
                                spread_by=["id"])
    last = F.struct("started_at", (-F.col("id")).alias("id"))
    per_flow = kept.groupBy("flow_id").agg(
        F.count(F.lit(1)).alias("run_count"),
        F.round(F.avg("duration_ms")).cast("long").alias("avg_ms"),
        F.max_by(F.struct("duration_ms", "status", "started_at"), last).alias("__last"))
    counts = kept.groupBy("flow_id", "duration_ms").agg(F.count(F.lit(1)).alias("n"))
    p95 = value_at(counts, ["flow_id"], "duration_ms", F.least(
        F.col("total") - 1, F.floor(F.col("total") * 0.95)))
    stats = per_flow.join(p95, "flow_id").select(
        "flow_id", "run_count", "avg_ms", F.col("at").alias("p95_ms"),
        F.col("__last.duration_ms").alias("last_ms"),
        F.col("__last.status").alias("last_status"),
        F.col("__last.started_at").alias("last_run_at"))
    return stats.join(flows.select(F.col("id").alias("flow_id"), "source_id",
                                   "warehouse_table"), "flow_id")


def flow_summary(flows: DataFrame, runs: DataFrame) -> DataFrame:
    """Per flow: rates, rows, last success and failure, effective status."""
    ok, bad = is_success(F.col("status")), is_failure(F.col("status"))
    # newest first; equal times are told apart by the run id
    newest = F.struct("started_at", "id")
    rolled = runs.groupBy(F.col("flow_id").alias("id_of_flow")).agg(
        F.count(F.lit(1)).alias("total_runs"),
        F.count_if(ok).alias("success_runs"),
        F.count_if(bad).alias("failed_runs"),
        F.sum(F.when(ok, F.col("rows"))).alias("rows_synced"),
        F.avg("duration_ms").alias("avg_ms"),
        F.max(F.when(ok, F.col("started_at"))).alias("last_success"),
        F.max(F.when(bad, F.col("started_at"))).alias("last_failure"),
        F.max_by("status", newest).alias("__last_status"))
    joined = flows.select("id", F.col("status").alias("__status")).join(
        rolled, F.col("id") == F.col("id_of_flow"), "left").drop("id_of_flow")
    finished = F.col("success_runs") + F.col("failed_runs")
    zero = F.lit(0)
    return joined.select(
        F.col("id").alias("flow_id"),
        F.when((F.col("__status") == "active") & is_failure(F.col("__last_status")),
               F.lit("error")).otherwise(F.col("__status")).alias("status"),
        F.coalesce("total_runs", zero).alias("total_runs"),
        F.coalesce(F.round(F.try_divide(F.col("success_runs") * 100.0, finished)),
                   F.lit(100.0)).alias("success_rate"),
        F.coalesce(F.round(F.try_divide(F.col("failed_runs") * 100.0, F.col("total_runs")), 1),
                   F.lit(0.0)).alias("failure_rate"),
        F.coalesce("rows_synced", zero).alias("rows_synced"),
        "avg_ms", "last_success", "last_failure")


def query_cost(queries: DataFrame, as_of: Column, lookback_days: int = 7,
               usd_per_tb: float = USD_PER_TB) -> DataFrame:
    """Scanned bytes, jobs and estimated price per day; jobs without bytes are left out."""
    rows = recent(queries, "created_at", as_of, lookback_days).where(F.col("bytes") > 0)
    return (rows.groupBy(F.to_date("created_at").alias("day"))
            .agg(F.sum("bytes").alias("bytes_processed"), F.count(F.lit(1)).alias("jobs"))
            .withColumn("estimated_usd",
                        F.round(F.col("bytes_processed") / 1e12 * usd_per_tb, 4))
            .orderBy("day"))


def query_cost_total(per_day: DataFrame, usd_per_tb: float = USD_PER_TB) -> DataFrame:
    return per_day.agg(
        F.coalesce(F.sum("bytes_processed"), F.lit(0)).alias("bytes_processed"),
        F.coalesce(F.sum("jobs"), F.lit(0)).alias("jobs")).withColumn(
        "estimated_usd", F.round(F.col("bytes_processed") / 1e12 * usd_per_tb, 2))


def usage_rollup(usage: DataFrame) -> DataFrame:
    """One row per workspace, metric and day. Rolling up a rollup changes nothing."""
    rows = F.col("events") if "events" in usage.columns else F.lit(1)
    day = F.col("day") if "day" in usage.columns else F.to_date("created_at")
    return usage.groupBy("workspace_id", "metric", day.alias("day")).agg(
        F.sum("quantity").alias("quantity"), F.sum(rows).alias("events"))


def sync_snapshots(df: DataFrame, stamp: str, n: int = 30) -> DataFrame:
    return (df.groupBy(F.col(stamp).cast("string").alias("synced_at"))
            .agg(F.count(F.lit(1)).alias("rows_loaded"))
            .orderBy(F.desc("synced_at")).limit(n))


def row_count(df: DataFrame, stamp: str) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("total_rows"),
                  F.max(stamp).cast("string").alias("last_synced_at"),
                  F.count_distinct(stamp).alias("snapshots"))


# Queue states reported one by one.
QUEUE_STATES = ["queued", "running", "success", "failed", "dead"]


def queue_stats(jobs: DataFrame, as_of: Column, n_days: int = 7) -> DataFrame:
    """Jobs per state, those completed in the window, and how many that is per hour."""
    fresh = F.col("updated_at") >= as_of - F.make_dt_interval(F.lit(n_days))
    done = F.count_if((F.col("status") == "success") & fresh)
    return jobs.agg(
        *[F.count_if(F.col("status") == s).alias(s) for s in QUEUE_STATES],
        done.alias("completed"),
        F.round(done / (n_days * 24)).cast("long").alias("throughput_per_hour"))


def user_overview(users: DataFrame, flows: DataFrame, runs: DataFrame,
                  children: dict[str, DataFrame]) -> DataFrame:
    """Per user: flows, active flows, run totals, success rate, and child counts.

    ``children`` maps a result column to a frame with a ``user_id`` column; each
    is grouped once and joined, instead of a query per user.
    """
    per_user_flows = flows.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("flow_count"),
        F.count_if(F.col("status") == "active").alias("active_flow_count"))
    per_user_runs = (_flow_rollup(runs)
                     .join(flows.select(F.col("id").alias("flow_id"), "user_id"), "flow_id")
                     .groupBy("user_id")
                     .agg(F.sum("total").alias("total_runs"),
                          F.sum("success").alias("success_runs"),
                          F.sum("failed").alias("failed_runs"),
                          F.sum("success_rows").alias("total_rows"),
                          F.max("last_run_at").alias("last_run_at")))
    rollups = [per_user_flows, per_user_runs] + [
        child.groupBy("user_id").agg(F.count(F.lit(1)).alias(name))
        for name, child in children.items()]
    out = users.withColumnRenamed("id", "user_id")
    for rollup in rollups:
        out = out.join(rollup, "user_id", "left")
    zero = ["flow_count", "active_flow_count", "total_runs", "success_runs", "failed_runs",
            "total_rows", *children]
    out = out.withColumns({n: F.coalesce(F.col(n), F.lit(0)) for n in zero})
    return out.withColumn("success_rate", F.round(
        F.try_divide(F.col("success_runs") * 100.0, F.col("total_runs"))))


def funnel(overview: DataFrame, joined_at: str | None = None, as_of: Column | None = None,
           connector_column: str = "connector_count") -> DataFrame:
    """Users per onboarding stage, one row per stage."""
    stages = [
        ("registered", F.lit(True)),
        ("created_flow", F.col("flow_count") > 0),
        ("added_connector", F.col(connector_column) > 0),
        ("ran_first_sync", F.col("total_runs") > 0),
        ("succeeded_sync", F.col("success_runs") > 0),
    ]
    if joined_at:
        stages.append(("recent_signups",
                       F.col(joined_at) >= as_of - F.make_dt_interval(F.lit(7))))
    counts = overview.agg(*[F.count_if(cond).alias(f"s{i}")
                            for i, (_, cond) in enumerate(stages)])
    rows = [F.struct(F.lit(i).alias("position"), F.lit(name).alias("stage"),
                     F.col(f"s{i}").alias("users")) for i, (name, _) in enumerate(stages)]
    return counts.select(F.inline(F.array(*rows)))


def counters(parts: dict[str, tuple[DataFrame, Column]]) -> DataFrame:
    """One row of counters. Each is read as a one-row subquery of its table."""
    by_frame: dict[int, tuple[DataFrame, list]] = {}
    for name, (df, expr) in parts.items():
        by_frame.setdefault(id(df), (df, []))[1].append(expr.alias(name))
    frames = [df.agg(*exprs) for df, exprs in by_frame.values()]
    out = frames[0]
    for frame in frames[1:]:
        out = out.withColumns({c: frame.select(c).scalar() for c in frame.columns})
    return out.select(*parts)


# Fixed value: the load message that names the written table.
LOAD_MESSAGE = r"Loaded \d+ rows → (\S+)"


def logged_table(logs: Column) -> Column:
    """Table name out of a run's JSON log (a list of messages): the first one found."""
    entries = F.from_json(logs, "array<struct<message string>>")
    found = F.transform(entries, lambda e: F.regexp_extract(e["message"], LOAD_MESSAGE, 1))
    return F.get(F.filter(found, lambda m: m != ""), F.lit(0))
