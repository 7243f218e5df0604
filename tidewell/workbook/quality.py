"""Profiles, duplicates, freshness, order statistics, outliers, insights."""

from pyspark.sql import functions as F

from ..operators.insights import (active_insights, insights, outliers, quintile_trend,
                                  recommendations)
from ..operators.profile import classify_values, column_profile, numeric_stats
from ..operators.quality import duplicate_check, freshness, stale_count, table_health
from ..operators.telemetry import error_rates, queue_stats
from .base import AS_OF, FLOWS_SQL, RUNS_SQL, as_of, query, rounded, timed

PROFILE_COLUMNS = [("event_id", True), ("user_id", True), ("event_type", False),
                   ("value", True), ("props", False)]


def _profile_sql(table, columns):
    parts = []
    for name, numeric in columns:
        numbers = (f"CAST(min({name}) AS DOUBLE) AS min, CAST(max({name}) AS DOUBLE) AS max, "
                   f"round(avg({name}), 4) AS avg, count(*) FILTER ({name} < 0) AS negatives"
                   if numeric else "CAST(NULL AS DOUBLE) AS min, CAST(NULL AS DOUBLE) AS max, "
                   "CAST(NULL AS DOUBLE) AS avg, CAST(NULL AS BIGINT) AS negatives")
        parts.append(f"SELECT '{name}' AS \"column\", count(*) AS total_rows, "
                     f"count(*) - count({name}) AS nulls, count(DISTINCT {name}) AS \"distinct\", "
                     f"{numbers} FROM {table}")
    return " UNION ALL ".join(parts)


@query("column_profile", _profile_sql("events", PROFILE_COLUMNS))
def profile(t):
    return rounded(column_profile(t.events, [c for c, _ in PROFILE_COLUMNS]), avg=4)


LINE_COLUMNS = [("l_orderkey", True), ("l_partkey", True), ("l_suppkey", True),
                ("l_linenumber", True), ("l_quantity", True), ("l_extendedprice", True),
                ("l_discount", True), ("l_tax", True), ("l_returnflag", False),
                ("l_linestatus", False), ("l_shipdate", False)]


@query("column_profile_wide", _profile_sql("lineitem", LINE_COLUMNS))
def profile_wide(t):
    return rounded(column_profile(t.lineitem, [c for c, _ in LINE_COLUMNS]), avg=4)


@query("duplicate_check", """
SELECT count(*) AS duplicate_groups, CAST(sum(n) - count(*) AS BIGINT) AS excess_rows FROM (
  SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem
  WHERE l_orderkey IS NOT NULL AND l_linenumber IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1)
""")
def duplicates(t):
    return duplicate_check(t.lineitem, ["l_orderkey", "l_linenumber"])


@query("duplicate_check_unique", """
SELECT count(*) AS duplicate_groups, CAST(sum(n) - count(*) AS BIGINT) AS excess_rows FROM (
  SELECT event_id, count(*) AS n FROM events GROUP BY 1 HAVING count(*) > 1)""")
def no_duplicates(t):
    return duplicate_check(t.events, "event_id")


@query("duplicate_text", """
SELECT count(*) AS duplicate_groups, CAST(sum(n) - count(*) AS BIGINT) AS excess_rows FROM (
  SELECT text, count(*) AS n FROM documents WHERE text IS NOT NULL
  GROUP BY 1 HAVING count(*) > 1)""")
def duplicate_texts(t):
    return duplicate_check(t.documents, "text")


@query("freshness", f"""
SELECT strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS latest,
  CAST(floor(epoch(TIMESTAMP '{AS_OF}' - max(ts)) / 3600) AS BIGINT) AS lag_hours,
  count(*) AS total_rows FROM events""")
def fresh(t):
    return freshness(t.events, "ts", AS_OF).withColumn(
        "latest", F.substring("latest", 1, 19))


HEALTH_TIMES = {"events": "ts", "orders": "o_orderdate", "lineitem": "l_shipdate",
                "part": None}
_HEALTH_SQL = " UNION ALL ".join(
    f"""SELECT '{name}' AS table_name,
  CASE WHEN lag > 30 THEN 'stale' ELSE 'healthy' END AS status, lag AS lag_hours, latest, n
    AS total_rows, '{col}' AS time_column, CAST(NULL AS VARCHAR) AS error
FROM (SELECT CAST(floor(epoch(TIMESTAMP '{AS_OF}' - max({col})) / 3600) AS BIGINT) AS lag,
  strftime(max({col}), '%Y-%m-%d %H:%M:%S') AS latest, count(*) AS n FROM {name})"""
    if col else f"""SELECT '{name}', 'unknown', CAST(NULL AS BIGINT), CAST(NULL AS VARCHAR),
  CAST(NULL AS BIGINT), CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR)""" for name, col in HEALTH_TIMES.items())


def _health(t):
    tables = {n: t.all[n] for n in HEALTH_TIMES}
    return table_health(tables, HEALTH_TIMES, AS_OF).withColumn(
        "latest", F.substring("latest", 1, 19))


@query("table_health", _HEALTH_SQL)
def health(t):
    return _health(t)


@query("table_health_found", f"""
SELECT table_name, status, lag_hours, total_rows, time_column, error FROM ({_HEALTH_SQL})
UNION ALL SELECT 'unreadable', 'unknown', NULL, NULL, 'ts', 'failed'
UNION ALL SELECT 'missing', 'unknown', NULL, NULL, NULL, 'failed'""")
def health_found(t):
    """Time columns found by the classifier, and two broken tables among good ones."""
    tables = {n: t.all[n] for n in HEALTH_TIMES}
    tables["unreadable"] = t.events.withColumn("ts", F.when(
        F.col("event_id") >= 0, F.raise_error(F.lit("cannot be read"))).cast("timestamp"))
    tables["missing"] = lambda: t.spark.read.parquet(f"{t.folder}/no such table.parquet")
    return table_health(tables, as_of=AS_OF).drop("latest").withColumn(
        "error", F.when(F.col("error").isNotNull(), F.lit("failed")))


@query("stale_tables", f"""SELECT count(*) FILTER (status = 'stale') AS stale_tables,
  count(*) AS tables FROM ({_HEALTH_SQL})""")
def stale(t):
    return stale_count(_health(t))


def _stats_sql(table, columns):
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count(*) AS n, round(avg(v), 6) AS mean,
  round(stddev_pop(v), 4) AS stddev,
  (SELECT CAST(v AS DOUBLE) FROM (SELECT coalesce({c}, 0) AS v,
    row_number() OVER (ORDER BY coalesce({c}, 0)) AS rn, count(*) OVER () AS n FROM {table})
    WHERE rn = n // 2 + 1) AS median,
  CAST(min(v) AS DOUBLE) AS min, CAST(max(v) AS DOUBLE) AS max
FROM (SELECT coalesce({c}, 0) AS v FROM {table})""" for c in columns)


STATS_COLUMNS = ["l_quantity", "l_extendedprice", "l_discount", "l_partkey"]


@query("numeric_stats", _stats_sql("lineitem", STATS_COLUMNS))
def stats(t):
    return rounded(numeric_stats(t.lineitem, STATS_COLUMNS), mean=6, stddev=4)


def _outlier_sql(table, columns):
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", n, round(mean, 6) AS mean, round(sd, 4) AS stddev, o AS
  outliers, CASE WHEN o = 0 THEN 'none' WHEN o > n * 0.1 THEN 'critical' ELSE 'warning' END
  AS severity
FROM (SELECT count(*) AS n, any_value(mean) AS mean, any_value(sd) AS sd,
  count(*) FILTER (abs(v - mean) > 2 * sd) AS o
  FROM (SELECT coalesce(CAST({c} AS DOUBLE), 0) AS v FROM {table}),
    (SELECT avg(coalesce({c}, 0)) AS mean, stddev_pop(coalesce({c}, 0)) AS sd FROM {table}))"""
        for c in columns)


@query("outliers", _outlier_sql("lineitem", ["l_quantity", "l_extendedprice", "l_discount"])
       + " UNION ALL " + _outlier_sql("events", ["value"]))
def outlier_rows(t):
    return rounded(
        outliers(t.lineitem, ["l_quantity", "l_extendedprice", "l_discount"]).unionByName(
            outliers(t.events, ["value"])), mean=6, stddev=4)


def _trend_sql(table, order, tie, columns):
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", CAST(f AS BIGINT) AS rows_per_end,
  round(a, 6) AS first_mean, round(z, 6) AS last_mean,
  round(CASE WHEN a = 0 THEN 0 ELSE 100.0 * (z - a) / abs(a) END, 4) AS trend_pct,
  (SELECT count(*) FROM {table} WHERE {order} IS NULL) AS unordered_rows
FROM (SELECT any_value(n // 5) AS f, avg(v) FILTER (rn <= n // 5) AS a,
  avg(v) FILTER (rn > n - n // 5) AS z
  FROM (SELECT coalesce(CAST({c} AS DOUBLE), 0) AS v, count(*) OVER () AS n,
    row_number() OVER (ORDER BY {order}, {tie}) AS rn FROM {table} WHERE {order} IS NOT NULL))"""
        for c in columns)


@query("quintile_trend", _trend_sql("events", "ts", "event_id", ["value", "user_id"]))
def trend(t):
    return rounded(quintile_trend(t.events, "ts", "event_id", ["value", "user_id"]),
                   first_mean=6, last_mean=6, trend_pct=4)


_PURCHASES = "(SELECT *, CASE WHEN event_type = 'purchase' THEN ts END AS bought FROM events)"


@query("quintile_trend_unordered", _trend_sql(_PURCHASES, "bought", "event_id", ["value"]))
def trend_unordered(t):
    """Rows without an order are counted, and in neither fifth."""
    rows = t.events.withColumn("bought", F.when(F.col("event_type") == "purchase", F.col("ts")))
    return rounded(quintile_trend(rows, "bought", "event_id", ["value"]),
                   first_mean=6, last_mean=6, trend_pct=4)


# Many orders share a day here, so the cut falls inside a group of equal times.
@query("quintile_trend_ties", _trend_sql("orders", "o_orderdate", "o_orderkey",
                                         ["o_totalprice", "o_custkey"]))
def trend_ties(t):
    return rounded(quintile_trend(t.orders, "o_orderdate", "o_orderkey",
                                  ["o_totalprice", "o_custkey"]),
                   first_mean=6, last_mean=6, trend_pct=4)


_INSIGHT_COLUMNS = ["o_totalprice", "o_custkey", "o_orderkey"]


@query("insights", f"""
WITH o AS ({_outlier_sql("orders", _INSIGHT_COLUMNS)}),
  d AS ({_stats_sql("orders", _INSIGHT_COLUMNS)}),
  q AS ({_trend_sql("orders", "o_orderdate", "o_orderkey", _INSIGHT_COLUMNS)})
SELECT *, '2024-02-07 00:00:00' AS expires_at FROM (
  SELECT 'kpi' AS type, CAST(NULL AS VARCHAR) AS "column", 'info' AS severity,
    CAST(count(*) AS DOUBLE) AS value, CAST(NULL AS DOUBLE) AS mean,
    CAST(NULL AS DOUBLE) AS stddev, CAST(NULL AS DOUBLE) AS median, CAST(NULL AS DOUBLE) AS min,
    CAST(NULL AS DOUBLE) AS max, 'orders: ' || format('{{:,}}', count(*)) || ' rows analyzed' AS title
  FROM orders
  UNION ALL SELECT 'anomaly', "column", severity, CAST(outliers AS DOUBLE), d.mean, d.stddev,
    median, min, max, 'Anomaly detected in "' || "column" || '"'
  FROM o JOIN d USING ("column") WHERE outliers > 0
  UNION ALL SELECT 'trend', "column",
    CASE WHEN trend_pct > 0 THEN 'success' ELSE 'warning' END, trend_pct, d.mean, d.stddev,
    median, min, max, CASE WHEN trend_pct > 0 THEN 'Upward' ELSE 'Downward' END
      || ' trend in "' || "column" || '" (' || printf('%.1f', trend_pct) || '%)'
  FROM q JOIN d USING ("column") WHERE abs(trend_pct) > 10)""")
def insight_rows(t):
    return timed(rounded(insights(t.orders, "o_orderdate", "o_orderkey", as_of(),
                                  _INSIGHT_COLUMNS, "orders"), value=4, mean=6, stddev=4),
                 "expires_at")


@query("insights_no_numbers", """
SELECT type, CAST(NULL AS VARCHAR) AS "column", 'info' AS severity, value,
  CAST(NULL AS DOUBLE) AS mean, CAST(NULL AS DOUBLE) AS stddev, CAST(NULL AS DOUBLE) AS median,
  CAST(NULL AS DOUBLE) AS min, CAST(NULL AS DOUBLE) AS max, title,
  '2024-02-07 00:00:00' AS expires_at
FROM (SELECT 'kpi' AS type, CAST(count(*) AS DOUBLE) AS value,
    'texts: ' || format('{:,}', count(*)) || ' rows analyzed' AS title FROM documents
  UNION ALL SELECT 'recommendation', CAST(NULL AS DOUBLE),
    'Add numeric columns to "texts" for deeper analysis')""")
def insights_text(t):
    return timed(insights(t.documents.select("text", "lang", "source"), "text", "lang", as_of(),
                          [], "texts"), "expires_at")


@query("active_insights", f"""
SELECT id, model_id, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at, c_name AS model_name
FROM (SELECT event_id AS id, user_id AS model_id, ts AS created_at,
    event_type = 'error' AS dismissed,
    CASE WHEN event_type = 'view' THEN NULL ELSE ts + INTERVAL 7 DAY END AS expires_at
  FROM events) LEFT JOIN customer ON c_custkey = model_id
WHERE NOT dismissed AND (expires_at IS NULL OR expires_at > TIMESTAMP '{AS_OF}')
ORDER BY 3 DESC, id LIMIT 100""")
def live_insights(t):
    rows = t.events.select(
        F.col("event_id").alias("id"), F.col("user_id").alias("model_id"),
        F.col("ts").alias("created_at"), (F.col("event_type") == "error").alias("dismissed"),
        F.when(F.col("event_type") != "view",
               F.col("ts") + F.make_dt_interval(F.lit(7))).alias("expires_at"))
    models = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return timed(active_insights(rows, as_of(), models).select(
        "id", "model_id", "created_at", "model_name"), "created_at")


@query("recommendations", f"""
WITH dead AS (SELECT count(*) FILTER (event_type = 'error') AS dead FROM events),
  rates AS (SELECT flow_id, count(*) AS total, count(*) FILTER (status = 'failed') AS errors
    FROM {RUNS_SQL} WHERE started_at >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY GROUP BY 1
    HAVING count(*) FILTER (status = 'failed') > count(*) * 0.1),
  health AS ({_HEALTH_SQL})
SELECT 'reliability' AS category, 'critical' AS severity, 'jobs' AS subject,
  CAST(dead AS DOUBLE) AS value FROM dead WHERE dead > 0
UNION ALL SELECT 'reliability', 'warning', CAST(flow_id AS VARCHAR),
  round(100.0 * errors / total) FROM rates JOIN {FLOWS_SQL} f ON f.id = flow_id
UNION ALL SELECT 'quality', 'warning', table_name, CAST(lag_hours AS DOUBLE) FROM (
  SELECT * FROM health WHERE lag_hours > 48 ORDER BY lag_hours DESC, table_name LIMIT 5)""")
def recommend(t):
    jobs = t.events.select(F.when(F.col("event_type") == "error", F.lit("dead"))
                           .otherwise(F.lit("success")).alias("status"),
                           F.col("ts").alias("updated_at"))
    return recommendations(queue_stats(jobs, as_of()), error_rates(t.runs(), t.flows(), as_of()),
                           _health(t))


_SHAPE_COLUMNS = {
    "ordered_on": ("strftime(o_orderdate, '%Y-%m-%d')", "timestamp"),
    "contact": ("'user' || o_custkey || '@example.com'", "email"),
    "link": ("'https://example.com/o/' || o_orderkey", "url"),
    "paid": ("'$' || CAST(o_custkey AS VARCHAR) || '.50'", "currency"),
    "share": ("CAST(o_custkey AS VARCHAR) || '%'", "percentage"),
    "phone": ("'+44 555 ' || lpad(CAST(o_custkey AS VARCHAR), 6, '0')", "phone"),
    "flag": ("CASE WHEN o_orderstatus = 'F' THEN 'yes' ELSE 'No' END", "boolean"),
    "amount": ("CAST(o_totalprice AS VARCHAR)", "number"),
    "priority": ("o_orderpriority", "category"),
    "free_text": ("'order number ' || o_orderkey", None),
    "o_totalprice": ("o_totalprice", "number"),
}


@query("classify_values", " UNION ALL ".join(
    f"""SELECT '{name}' AS "column", count({expr}) AS filled_rows,
  {f"'{cls}'" if cls else 'CAST(NULL AS VARCHAR)'} AS value_class FROM orders"""
    for name, (expr, cls) in _SHAPE_COLUMNS.items()))
def value_classes(t):
    key = F.col("o_custkey").cast("string")
    rows = t.orders.select(
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("ordered_on"),
        F.concat(F.lit("user"), key, F.lit("@example.com")).alias("contact"),
        F.concat(F.lit("https://example.com/o/"), F.col("o_orderkey").cast("string"))
        .alias("link"),
        F.concat(F.lit("$"), key, F.lit(".50")).alias("paid"),
        F.concat(key, F.lit("%")).alias("share"),
        F.concat(F.lit("+44 555 "), F.lpad(key, 6, "0")).alias("phone"),
        F.when(F.col("o_orderstatus") == "F", F.lit("yes")).otherwise(F.lit("No")).alias("flag"),
        F.col("o_totalprice").cast("string").alias("amount"),
        F.col("o_orderpriority").alias("priority"),
        F.concat(F.lit("order number "), F.col("o_orderkey").cast("string")).alias("free_text"),
        "o_totalprice")
    return classify_values(rows)
