"""Operational statistics over run, flow, job, usage and query logs."""

from pyspark.sql import functions as F

from ..functions import text
from ..functions.times import epoch_ms, next_run
from ..operators import telemetry as T
from ..operators.joins import (count_children, distinct_values, latest_n_per_key, only_owned,
                               with_rollups)
from .base import AS_OF, FLOWS_SQL, RUNS_SQL, as_of, dated, query, rounded, time_text, timed

_STATS = """count(*) AS total_runs, count(*) FILTER (r.status = 'success') AS success_runs,
  count(*) FILTER (r.status = 'failed') AS failed_runs, CAST(sum(rows) AS BIGINT) AS total_rows,
  round(avg(duration_ms), 4) AS avg_ms,
  round(avg(duration_ms) FILTER (r.status = 'success'), 4) AS avg_success_ms,
  round(100.0 * count(*) FILTER (r.status = 'success') / count(*), 1) AS success_rate,
  round(CAST(sum(rows) AS BIGINT) * 500 / 1e9, 2) AS data_gb"""


@query("run_stats", f"""
SELECT f.source_id, {_STATS} FROM {RUNS_SQL} r JOIN {FLOWS_SQL} f ON f.id = r.flow_id
GROUP BY 1""")
def run_stats(t):
    return rounded(T.run_stats(t.runs(), t.flows(), ["source_id"]), avg_ms=4, avg_success_ms=4)


@query("run_stats_total", f"""
SELECT {_STATS} FROM {RUNS_SQL} r WHERE started_at >= TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY""")
def run_stats_total(t):
    runs = T.recent(t.runs(), "started_at", as_of(), 30)
    return rounded(T.run_stats(runs), avg_ms=4, avg_success_ms=4)


@query("join_inner", f"""
SELECT r.id, r.flow_id, f.source_id, f.warehouse_table, r.status, r.rows
FROM {RUNS_SQL} r JOIN {FLOWS_SQL} f ON f.id = r.flow_id""")
def join_inner(t):
    flows = t.flows().select(F.col("id").alias("flow_id"), "source_id", "warehouse_table")
    return t.runs().join(flows, "flow_id").select("id", "flow_id", "source_id",
                                                  "warehouse_table", "status", "rows")


@query("join_left", f"""
SELECT c_custkey, coalesce(u.n, 0) AS runs, coalesce(c_mktsegment, 'unnamed') AS name
FROM customer LEFT JOIN (SELECT flow_id, count(*) AS n FROM {RUNS_SQL} GROUP BY 1) u
  ON flow_id = c_custkey""")
def join_left(t):
    counted = t.runs().groupBy(F.col("flow_id").alias("c_custkey")).agg(
        F.count(F.lit(1)).alias("runs"))
    return with_rollups(t.customer, "c_custkey", [counted], ["runs"]).select(
        "c_custkey", "runs", F.coalesce("c_mktsegment", F.lit("unnamed")).alias("name"))


@query("join_left_count", """
SELECT o_orderkey, count(l_orderkey) AS lines FROM orders
LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1""")
def join_left_count(t):
    return count_children(t.orders.select("o_orderkey"), t.lineitem, "o_orderkey", "l_orderkey",
                          "lines")


@query("join_semi", """
SELECT p_partkey, p_name FROM part WHERE p_partkey IN (
  SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity >= 45)""")
def join_semi(t):
    written = t.lineitem.where((F.col("l_returnflag") == "R") & (F.col("l_quantity") >= 45))
    return only_owned(t.part, "p_partkey", written, "l_partkey").select("p_partkey", "p_name")


@query("latest_n_per_key", f"""
SELECT flow_id, id, status, rn FROM (SELECT *, row_number() OVER (
  PARTITION BY flow_id ORDER BY started_at DESC, id) AS rn FROM {RUNS_SQL}) WHERE rn <= 20""")
def latest_per_flow(t):
    return latest_n_per_key(t.runs(), ["flow_id"], [F.desc("started_at"), F.asc("id")], 20,
                            spread_by=["id"]).select("flow_id", "id", "status", "rn")


@query("distinct_values", "SELECT DISTINCT l_returnflag FROM lineitem "
                          "WHERE l_returnflag IS NOT NULL")
def distinct_flags(t):
    return distinct_values(t.lineitem, "l_returnflag")


@query("error_rate", f"""
SELECT flow_id, total, errors, source_id, round(100.0 * errors / total) AS error_pct FROM (
  SELECT flow_id, count(*) AS total, count(*) FILTER (status = 'failed') AS errors
  FROM {RUNS_SQL} WHERE started_at >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY GROUP BY 1)
JOIN {FLOWS_SQL} f ON f.id = flow_id WHERE errors > total * 0.1""")
def error_rate(t):
    return T.error_rates(t.runs(), t.flows(), as_of())


@query("load_durations", f"""
WITH k AS (SELECT *, row_number() OVER (PARTITION BY flow_id ORDER BY started_at DESC, id) AS rn
    FROM {RUNS_SQL}),
  n AS (SELECT *, count(*) OVER (PARTITION BY flow_id) AS c,
    row_number() OVER (PARTITION BY flow_id ORDER BY duration_ms, id) AS pos
    FROM k WHERE rn <= 200)
SELECT flow_id, count(*) AS run_count, CAST(round(avg(duration_ms)) AS BIGINT) AS avg_ms,
  max(duration_ms) FILTER (pos = least(c - 1, CAST(floor(c * 0.95) AS BIGINT)) + 1) AS p95_ms,
  max(duration_ms) FILTER (rn = 1) AS last_ms, max(n.status) FILTER (rn = 1) AS last_status,
  strftime(max(started_at) FILTER (rn = 1), '%Y-%m-%d %H:%M:%S') AS last_run_at,
  any_value(f.source_id) AS source_id, any_value(f.warehouse_table) AS warehouse_table
FROM n JOIN {FLOWS_SQL} f ON f.id = flow_id GROUP BY 1""")
def load_durations(t):
    return timed(T.load_durations(t.runs(), t.flows()), "last_run_at")


# A third of all runs belong to one flow, and every run counts.
_HOT_RUNS_SQL = f"""(SELECT * REPLACE (CASE WHEN status = 'success' AND duration_ms > 50000
  THEN 1 ELSE flow_id END AS flow_id) FROM {RUNS_SQL})"""


@query("load_durations_all", f"""
WITH n AS (SELECT *, count(*) OVER (PARTITION BY flow_id) AS c,
    row_number() OVER (PARTITION BY flow_id ORDER BY duration_ms, id) AS pos,
    row_number() OVER (PARTITION BY flow_id ORDER BY started_at DESC, id) AS rn FROM {_HOT_RUNS_SQL})
SELECT flow_id, count(*) AS run_count, CAST(round(avg(duration_ms)) AS BIGINT) AS avg_ms,
  max(duration_ms) FILTER (pos = least(c - 1, CAST(floor(c * 0.95) AS BIGINT)) + 1) AS p95_ms,
  max(duration_ms) FILTER (rn = 1) AS last_ms, max(n.status) FILTER (rn = 1) AS last_status,
  strftime(max(started_at) FILTER (rn = 1), '%Y-%m-%d %H:%M:%S') AS last_run_at,
  any_value(f.source_id) AS source_id, any_value(f.warehouse_table) AS warehouse_table
FROM n JOIN {FLOWS_SQL} f ON f.id = flow_id GROUP BY 1""")
def load_durations_all(t):
    hot = (F.col("status") == "success") & (F.col("duration_ms") > 50_000)
    runs = t.runs().withColumn("flow_id", F.when(hot, F.lit(1)).otherwise(F.col("flow_id")))
    return timed(T.load_durations(runs, t.flows(), newest=None), "last_run_at")


@query("run_stats_epoch", f"""
SELECT {_STATS}, strftime(max(started_at), '%Y-%m-%d %H:%M:%S') AS last_run_at
FROM {RUNS_SQL} r WHERE started_at >= TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY""")
def run_stats_epoch(t):
    """The same log with times as epoch milliseconds."""
    ms = F.unix_millis(F.col("started_at").cast("timestamp"))
    runs = T.recent(t.runs().withColumn("started_at", ms), "started_at", as_of(), 30)
    last = runs.agg(F.max(epoch_ms(F.col("started_at")))).scalar()
    out = rounded(T.run_stats(runs), avg_ms=4, avg_success_ms=4)
    return timed(out.withColumn("last_run_at", last), "last_run_at")


@query("error_rate_epoch", f"""
SELECT flow_id, total, errors, source_id, round(100.0 * errors / total) AS error_pct FROM (
  SELECT flow_id, count(*) AS total, count(*) FILTER (status = 'failed') AS errors
  FROM {RUNS_SQL} WHERE started_at >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY GROUP BY 1)
JOIN {FLOWS_SQL} f ON f.id = flow_id WHERE errors > total * 0.1""")
def error_rate_epoch(t):
    ms = F.unix_millis(F.col("started_at").cast("timestamp"))
    return T.error_rates(t.runs().withColumn("started_at", ms), t.flows(), as_of())


@query("flow_summary", f"""
SELECT f.id AS flow_id,
  CASE WHEN f.status = 'active' AND s.last_status = 'failed' THEN 'error' ELSE f.status END
    AS status,
  coalesce(total, 0) AS total_runs,
  coalesce(round(100.0 * ok / total), 100.0) AS success_rate,
  coalesce(round(100.0 * bad / total, 1), 0.0) AS failure_rate,
  CAST(coalesce(rows, 0) AS BIGINT) AS rows_synced, round(ms, 4) AS avg_ms,
  strftime(last_ok, '%Y-%m-%d %H:%M:%S') AS last_success,
  strftime(last_bad, '%Y-%m-%d %H:%M:%S') AS last_failure
FROM {FLOWS_SQL} f LEFT JOIN (SELECT flow_id, count(*) AS total,
    count(*) FILTER (status = 'success') AS ok, count(*) FILTER (status = 'failed') AS bad,
    sum(rows) FILTER (status = 'success') AS rows, avg(duration_ms) AS ms,
    max(started_at) FILTER (status = 'success') AS last_ok,
    max(started_at) FILTER (status = 'failed') AS last_bad,
    arg_max(status, (started_at, id)) AS last_status
  FROM {RUNS_SQL} GROUP BY 1) s ON s.flow_id = f.id""")
def flow_summary(t):
    return rounded(timed(T.flow_summary(t.flows(), t.runs()), "last_success", "last_failure"),
                   avg_ms=4)


_QUERIES_SQL = """(SELECT o_orderdate AS created_at,
  CAST(floor(o_totalprice * 1e6) AS BIGINT) AS bytes FROM orders)"""


def _queries(t):
    return t.orders.select(F.col("o_orderdate").alias("created_at"),
                           F.floor(F.col("o_totalprice") * 1e6).alias("bytes"))


@query("query_cost", f"""
SELECT strftime(CAST(created_at AS DATE), '%Y-%m-%d') AS day,
  CAST(sum(bytes) AS BIGINT) AS bytes_processed, count(*) AS jobs,
  round(CAST(sum(bytes) AS BIGINT) / 1e12 * 6.25, 4) AS estimated_usd
FROM {_QUERIES_SQL} WHERE bytes > 0 AND created_at >= TIMESTAMP '2001-08-02' - INTERVAL 365 DAY
GROUP BY 1""")
def query_cost(t):
    return dated(T.query_cost(_queries(t), as_of("2001-08-02 00:00:00"), 365), "day")


@query("query_cost_total", f"""
SELECT CAST(sum(bytes) AS BIGINT) AS bytes_processed, count(*) AS jobs,
  round(CAST(sum(bytes) AS BIGINT) / 1e12 * 6.25, 2) AS estimated_usd
FROM {_QUERIES_SQL} WHERE bytes > 0 AND created_at >= TIMESTAMP '2001-08-02' - INTERVAL 3650 DAY
""")
def query_cost_total(t):
    return T.query_cost_total(T.query_cost(_queries(t), as_of("2001-08-02 00:00:00"), 3650))


@query("usage_rollup", """
SELECT user_id AS workspace_id, event_type AS metric,
  strftime(CAST(ts AS DATE), '%Y-%m-%d') AS day, CAST(sum(floor(value)) AS BIGINT) AS quantity,
  count(*) AS events FROM events GROUP BY 1, 2, 3""")
def usage_rollup(t):
    usage = t.events.select(
        F.col("user_id").alias("workspace_id"), F.col("event_type").alias("metric"),
        F.floor("value").alias("quantity"), F.col("ts").alias("created_at"))
    return dated(T.usage_rollup(usage), "day")


@query("sync_snapshots", """
SELECT strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS synced_at, count(*) AS rows_loaded
FROM orders GROUP BY 1 ORDER BY 1 DESC LIMIT 30""")
def snapshots(t):
    return T.sync_snapshots(t.orders, "o_orderdate")


@query("row_count", """
SELECT count(*) AS total_rows, strftime(max(l_shipdate), '%Y-%m-%d %H:%M:%S') AS last_synced_at,
  count(DISTINCT l_shipdate) AS snapshots FROM lineitem""")
def row_count(t):
    return T.row_count(t.lineitem, "l_shipdate")


_OVERVIEW_SQL = f"""
SELECT u.n_nationkey AS user_id, u.n_regionkey AS workspace_id,
  coalesce(f.n, 0) AS flow_count, coalesce(f.a, 0) AS active_flow_count,
  coalesce(r.total, 0) AS total_runs, coalesce(r.ok, 0) AS success_runs,
  coalesce(r.bad, 0) AS failed_runs, CAST(coalesce(r.rows, 0) AS BIGINT) AS total_rows,
  coalesce(s.n, 0) AS connector_count,
  strftime(r.last_run, '%Y-%m-%d %H:%M:%S') AS last_run_at,
  round(100.0 * r.ok / r.total) AS success_rate
FROM nation u
LEFT JOIN (SELECT user_id, count(*) AS n, count(*) FILTER (status = 'active') AS a
  FROM {FLOWS_SQL} GROUP BY 1) f ON f.user_id = u.n_nationkey
LEFT JOIN (SELECT f.user_id, count(*) AS total, count(*) FILTER (r.status = 'success') AS ok,
    count(*) FILTER (r.status = 'failed') AS bad,
    sum(rows) FILTER (r.status = 'success') AS rows, max(started_at) AS last_run
  FROM {RUNS_SQL} r JOIN {FLOWS_SQL} f ON f.id = r.flow_id GROUP BY 1) r
  ON r.user_id = u.n_nationkey
LEFT JOIN (SELECT s_nationkey AS user_id, count(*) AS n FROM supplier GROUP BY 1) s
  ON s.user_id = u.n_nationkey"""


def _overview(t):
    users = t.nation.select(F.col("n_nationkey").alias("id"),
                            F.col("n_regionkey").alias("workspace_id"))
    connectors = t.supplier.select(F.col("s_nationkey").alias("user_id"))
    return T.user_overview(users, t.flows(), t.runs(), {"connector_count": connectors})


@query("user_overview", _OVERVIEW_SQL)
def user_overview(t):
    return timed(_overview(t), "last_run_at")


@query("funnel", f"""
WITH o AS ({_OVERVIEW_SQL})
SELECT 0 AS position, 'registered' AS stage, count(*) AS users FROM o
UNION ALL SELECT 1, 'created_flow', count(*) FROM o WHERE flow_count > 0
UNION ALL SELECT 2, 'added_connector', count(*) FROM o WHERE connector_count > 0
UNION ALL SELECT 3, 'ran_first_sync', count(*) FROM o WHERE total_runs > 0
UNION ALL SELECT 4, 'succeeded_sync', count(*) FROM o WHERE success_runs > 0""")
def funnel(t):
    return T.funnel(_overview(t))


@query("funnel_signups", f"""
WITH o AS ({_OVERVIEW_SQL})
SELECT 0 AS position, 'registered' AS stage, count(*) AS users FROM o
UNION ALL SELECT 1, 'created_flow', count(*) FROM o WHERE flow_count > 0
UNION ALL SELECT 2, 'added_connector', count(*) FROM o WHERE connector_count > 0
UNION ALL SELECT 3, 'ran_first_sync', count(*) FROM o WHERE total_runs > 0
UNION ALL SELECT 4, 'succeeded_sync', count(*) FROM o WHERE success_runs > 0
UNION ALL SELECT 5, 'recent_signups', count(*) FROM o
  WHERE strptime(last_run_at, '%Y-%m-%d %H:%M:%S') >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY""")
def funnel_signups(t):
    """The last run stands in for the day a user joined."""
    return T.funnel(_overview(t), "last_run_at", as_of())


def _jobs(t):
    kinds = {"view": "queued", "click": "running", "error": "failed", "signup": "dead"}
    status = F.lit("success")
    for event, name in kinds.items():
        status = F.when(F.col("event_type") == event, F.lit(name)).otherwise(status)
    return t.events.select(status.alias("status"), F.col("ts").alias("updated_at"))


@query("queue_stats", f"""
SELECT count(*) FILTER (event_type = 'view') AS queued,
  count(*) FILTER (event_type = 'click') AS running,
  count(*) FILTER (event_type = 'error') AS failed,
  count(*) FILTER (event_type = 'signup') AS dead,
  count(*) FILTER (event_type = 'purchase') AS success,
  count(*) FILTER (event_type = 'purchase' AND ts >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY)
    AS completed,
  CAST(round(count(*) FILTER (event_type = 'purchase'
    AND ts >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY) / 168.0) AS BIGINT) AS throughput_per_hour
FROM events""")
def queue_stats(t):
    return T.queue_stats(_jobs(t), as_of())


@query("platform_counts", """
SELECT (SELECT count(*) FROM customer) AS users, (SELECT count(*) FROM orders) AS flows,
  (SELECT count(*) FILTER (o_orderstatus = 'F') FROM orders) AS active_flows,
  (SELECT count(*) FROM events) AS runs,
  (SELECT CAST(sum(floor(value)) AS BIGINT) FROM events) AS rows""")
def platform_counts(t):
    orders, events = t.orders, t.events
    return T.counters({
        "users": (t.customer, F.count(F.lit(1))),
        "flows": (orders, F.count(F.lit(1))),
        "active_flows": (orders, F.count_if(F.col("o_orderstatus") == "F")),
        "runs": (events, F.count(F.lit(1))),
        "rows": (events, F.sum(F.floor("value")))})


_SCHEDULE_SQL = """(SELECT o_orderkey, o_orderdate, o_orderstatus, CASE o_orderpriority
  WHEN '1-URGENT' THEN 'every_15m' WHEN '2-HIGH' THEN 'every_6h' WHEN '3-MEDIUM' THEN 'daily'
  WHEN '5-LOW' THEN 'weekly' ELSE 'manual' END AS schedule FROM orders)"""
_NEXT_SQL = """o_orderdate + CASE schedule WHEN 'every_15m' THEN INTERVAL 15 MINUTE
  WHEN 'every_6h' THEN INTERVAL 360 MINUTE WHEN 'daily' THEN INTERVAL 1440 MINUTE
  WHEN 'weekly' THEN INTERVAL 10080 MINUTE END"""


def _scheduled(t):
    names = {"1-URGENT": "every_15m", "2-HIGH": "every_6h", "3-MEDIUM": "daily",
             "5-LOW": "weekly"}
    schedule = F.lit("manual")
    for priority, name in names.items():
        schedule = F.when(F.col("o_orderpriority") == priority, F.lit(name)).otherwise(schedule)
    rows = t.orders.select("o_orderkey", "o_orderdate", "o_orderstatus",
                           schedule.alias("schedule"))
    return rows.withColumn("next_run_at", next_run(F.col("schedule"), F.col("o_orderdate")))


@query("next_run", f"""
SELECT o_orderkey, schedule, strftime({_NEXT_SQL}, '%Y-%m-%d %H:%M:%S') AS next_run_at
FROM {_SCHEDULE_SQL}""")
def next_runs(t):
    return timed(_scheduled(t).select("o_orderkey", "schedule", "next_run_at"), "next_run_at")


@query("due_flows", f"""
SELECT o_orderkey, strftime(n, '%Y-%m-%d %H:%M:%S') AS next_run_at FROM (
  SELECT o_orderkey, o_orderstatus, {_NEXT_SQL} AS n FROM {_SCHEDULE_SQL})
WHERE n <= TIMESTAMP '1995-06-01' AND o_orderstatus <> 'P' ORDER BY n, o_orderkey LIMIT 20""")
def due_flows(t):
    flows = _scheduled(t).select(
        F.col("o_orderkey").alias("id"), "next_run_at",
        F.when(F.col("o_orderstatus") == "P", F.lit("paused")).otherwise(F.lit("active"))
        .alias("status"))
    return T.due(flows, as_of("1995-06-01 00:00:00"), 20).select(
        F.col("id").alias("o_orderkey"), time_text("next_run_at").alias("next_run_at"))


@query("log_table_recovery", """
SELECT event_id, regexp_extract('Loaded ' || CAST(floor(value * 10) AS BIGINT) || ' rows → t_'
  || user_id, 'Loaded \\d+ rows → (\\S+)', 1) AS warehouse_table FROM events""")
def log_table_recovery(t):
    message = F.concat(F.lit("Loaded "), F.floor(F.col("value") * 10).cast("string"),
                       F.lit(" rows → t_"), F.col("user_id").cast("string"))
    logs = t.events.select("event_id", F.to_json(F.array(F.struct(message.alias("message"))))
                           .alias("logs"))
    return logs.select("event_id", T.logged_table(F.col("logs")).alias("warehouse_table"))


@query("json_extract", """
SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events""")
def json_extract(t):
    return t.events.select("event_id", F.from_json("props", "k bigint").getField("k").alias("k"))


@query("format_metrics", f"""
SELECT event_id,
  CASE WHEN b < 1024 THEN b || ' B' WHEN b < 1048576
      THEN regexp_replace(printf('%.1f', round(b / 1024.0, 1)), '\\.0$', '') || ' KB'
    ELSE regexp_replace(printf('%.1f', round(b / 1048576.0, 1)), '\\.0$', '') || ' MB' END AS size,
  CASE WHEN b >= 1000000 THEN printf('%.1f', round(b / 1e6, 1)) || 'M'
    WHEN b >= 1000 THEN printf('%.1f', round(b / 1e3, 1)) || 'K' ELSE CAST(b AS VARCHAR) END AS rows,
  CASE WHEN ms < 1000 THEN ms || 'ms' WHEN ms < 60000 THEN printf('%.1f', round(ms / 1000.0, 1)) || 's'
    ELSE (ms // 60000) || 'm ' || ((ms % 60000) // 1000) || 's' END AS took,
  CASE WHEN hours < 24 THEN hours || 'h ago' ELSE (hours // 24) || 'd ago' END AS ago
FROM (SELECT event_id, CAST(floor(value * 20000) AS BIGINT) + 1 AS b,
  CAST(floor(value * 1000) AS BIGINT) AS ms,
  CAST(floor(epoch(TIMESTAMP '2024-02-01' - ts) / 3600) AS BIGINT) AS hours FROM events)""")
def format_metrics(t):
    b = F.floor(F.col("value") * 20000) + 1
    return t.events.select(
        "event_id", text.format_bytes(b).alias("size"), text.format_count(b).alias("rows"),
        text.format_duration(F.floor(F.col("value") * 1000)).alias("took"),
        text.format_ago(F.col("ts"), as_of("2024-02-01 00:00:00")).alias("ago"))
