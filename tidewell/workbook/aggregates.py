"""Aggregates, series, rankings, comparisons, filters, widgets."""

from pyspark.sql import functions as F

from ..functions.filters import Filter, search, where, widget_where
from ..functions.times import within
from ..operators.aggregate import (Metric, aggregate, comparison, pattern_buckets, ranking,
                                   ratio_ranking, time_series, widget)
from ..operators.joins import latest, latest_snapshot
from .base import AS_OF, dated, query, rounded, timed


@query("agg_sum", """
SELECT dimension, round(v, 2) AS revenue FROM (
  SELECT l_suppkey AS dimension, sum(l_extendedprice) AS v FROM lineitem
  WHERE l_suppkey IS NOT NULL GROUP BY 1 ORDER BY v DESC, 1 LIMIT 100)""")
def agg_sum(t):
    return rounded(aggregate(t.lineitem, [Metric("l_extendedprice", "SUM", "revenue")],
                             "l_suppkey"), revenue=2)


@query("agg_avg", """
SELECT dimension, round(v, 6) AS avg_price FROM (
  SELECT o_orderpriority AS dimension, avg(o_totalprice) AS v FROM orders
  WHERE o_orderpriority IS NOT NULL GROUP BY 1 ORDER BY v DESC, 1 LIMIT 100)""")
def agg_avg(t):
    return rounded(aggregate(t.orders, [Metric("o_totalprice", "AVG", "avg_price")],
                             "o_orderpriority"), avg_price=6)


@query("agg_count", """
SELECT event_type AS dimension, count(value) AS n FROM events
WHERE event_type IS NOT NULL AND value >= 10 GROUP BY 1 ORDER BY n DESC, 1 LIMIT 100""")
def agg_count(t):
    return aggregate(t.events, [Metric("value", "COUNT", "n")], "event_type",
                     filters=[Filter("value", ">=", 10)])


@query("agg_count_distinct", """
SELECT event_type AS dimension, count(DISTINCT user_id) AS users FROM events
WHERE event_type IS NOT NULL GROUP BY 1 ORDER BY users DESC, 1 LIMIT 100""")
def agg_count_distinct(t):
    return aggregate(t.events, [Metric("user_id", "COUNT_DISTINCT", "users")], "event_type")


@query("agg_min_max", """
SELECT l_returnflag AS dimension, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi
FROM lineitem WHERE l_returnflag IS NOT NULL GROUP BY 1 ORDER BY lo, 1 LIMIT 100""")
def agg_min_max(t):
    return aggregate(t.lineitem, [Metric("l_extendedprice", "MIN", "lo"),
                                  Metric("l_extendedprice", "MAX", "hi")],
                     "l_returnflag", order_by="lo", descending=False)


@query("agg_multi", """
SELECT dimension, round(s, 2) AS qty, round(a, 6) AS avg_discount, n, orders FROM (
  SELECT l_linestatus AS dimension, sum(l_quantity) AS s, avg(l_discount) AS a,
    count(*) AS n, count(DISTINCT l_orderkey) AS orders
  FROM lineitem WHERE l_linestatus IS NOT NULL GROUP BY 1)""")
def agg_multi(t):
    return rounded(aggregate(t.lineitem, [
        Metric("l_quantity", "SUM", "qty"), Metric("l_discount", "AVG", "avg_discount"),
        Metric(None, "COUNT_STAR", "n"), Metric("l_orderkey", "COUNT_DISTINCT", "orders")],
        "l_linestatus"), qty=2, avg_discount=6)


@query("agg_scalar", """
SELECT round(sum(l_extendedprice), 2) AS revenue, count(*) AS n FROM lineitem""")
def agg_scalar(t):
    return rounded(aggregate(t.lineitem, [Metric("l_extendedprice", "SUM", "revenue"),
                                          Metric(None, "COUNT_STAR", "n")]), revenue=2)


@query("agg_text_number", """
SELECT dimension, round(v, 2) AS total FROM (
  SELECT event_type AS dimension,
    sum(TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE)) AS v
  FROM events WHERE event_type IS NOT NULL GROUP BY 1)""")
def agg_text_number(t):
    rows = t.events.withColumn("k", F.get_json_object("props", "$.k"))
    return rounded(aggregate(rows, [Metric("k", "SUM", "total")], "event_type"), total=2)


@query("ts_day", """
SELECT strftime(b, '%Y-%m-%d') AS bucket, round(v, 4) AS value FROM (
  SELECT CAST(ts AS DATE) AS b, sum(value) AS v FROM events
  WHERE ts IS NOT NULL GROUP BY 1 ORDER BY 1 LIMIT 180)""")
def ts_day(t):
    return rounded(dated(time_series(t.events, "ts", Metric("value", "SUM")), "bucket"), value=4)


@query("ts_day_all", """
SELECT strftime(CAST(l_shipdate AS DATE), '%Y-%m-%d') AS bucket, count(*) AS value FROM lineitem
GROUP BY 1""")
def ts_day_all(t):
    """Every day, however many there are."""
    return dated(time_series(t.lineitem, "l_shipdate", limit=None), "bucket")


@query("ts_week", """
SELECT strftime(b, '%Y-%m-%d') AS bucket, n AS value FROM (
  SELECT CAST(o_orderdate AS DATE) - CAST(dayofweek(o_orderdate) AS INTEGER) AS b,
    count(*) AS n
  FROM orders WHERE o_orderdate IS NOT NULL GROUP BY 1 ORDER BY 1 LIMIT 5000)""")
def ts_week(t):
    return dated(time_series(t.orders, "o_orderdate", grain="WEEK", limit=5000), "bucket")


@query("ts_month", """
SELECT strftime(b, '%Y-%m-%d') AS bucket, round(v, 2) AS value FROM (
  SELECT date_trunc('month', l_shipdate) AS b, sum(l_extendedprice) AS v FROM lineitem
  WHERE l_shipdate IS NOT NULL GROUP BY 1 ORDER BY 1 LIMIT 180)""")
def ts_month(t):
    return rounded(dated(time_series(t.lineitem, "l_shipdate", Metric("l_extendedprice", "SUM"),
                                     "MONTH"), "bucket"), value=2)


@query("lookback", f"""
SELECT strftime(CAST(ts AS DATE), '%Y-%m-%d') AS day, count(*) AS n FROM events
WHERE ts >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY GROUP BY 1""")
def lookback(t):
    rows = t.events.where(within(t.events, "ts", AS_OF, 7))
    return dated(rows.groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n")),
                 "day")


@query("ranking_count", """
SELECT dimension, value, round(100.0 * value / total, 6) AS share_pct, rank FROM (
  SELECT *, sum(value) OVER () AS total, rank() OVER (ORDER BY value DESC) AS rank FROM (
    SELECT user_id AS dimension, count(*) AS value FROM events
    WHERE user_id IS NOT NULL GROUP BY 1))
ORDER BY value DESC, dimension LIMIT 12""")
def ranking_count(t):
    return rounded(ranking(t.events, "user_id", Metric(None, "COUNT_STAR"), top_n=12),
                   share_pct=6)


@query("ranking_all", """
SELECT dimension, value, round(100.0 * value / sum(value) OVER (), 6) AS share_pct,
  rank() OVER (ORDER BY value DESC) AS rank FROM (
    SELECT user_id AS dimension, count(*) AS value FROM events GROUP BY 1)""")
def ranking_all(t):
    """All members, many of which tie."""
    return rounded(ranking(t.events, "user_id", Metric(None, "COUNT_STAR"), top_n=None),
                   share_pct=6)


@query("ranking_sum", """
SELECT dimension, round(v, 2) AS value, round(100.0 * v / total, 6) AS share_pct, rank FROM (
  SELECT *, sum(v) OVER () AS total, rank() OVER (ORDER BY v DESC) AS rank FROM (
    SELECT l_partkey AS dimension, sum(l_extendedprice) AS v FROM lineitem
    WHERE l_partkey IS NOT NULL GROUP BY 1))
ORDER BY v DESC, dimension LIMIT 10""")
def ranking_sum(t):
    return rounded(ranking(t.lineitem, "l_partkey", Metric("l_extendedprice", "SUM")),
                   value=2, share_pct=6)


@query("ratio_ranking", """
SELECT dimension, round(v, 6) AS value, round(100.0 * v / total, 6) AS share_pct FROM (
  SELECT *, sum(v) OVER () AS total FROM (
    SELECT l_suppkey AS dimension,
      100.0 * sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) / sum(l_quantity) AS v
    FROM lineitem WHERE l_suppkey IS NOT NULL GROUP BY 1 HAVING sum(l_quantity) > 0))
ORDER BY v DESC, dimension LIMIT 10""")
def ratio(t):
    rows = t.lineitem.withColumn(
        "returned", F.when(F.col("l_returnflag") == "R", F.col("l_quantity")).otherwise(0.0))
    return rounded(ratio_ranking(rows, "l_suppkey", "returned", "l_quantity"),
                   value=6, share_pct=6)


@query("comparison", f"""
SELECT round(sum(value) FILTER (ts >= TIMESTAMP '{AS_OF}' - INTERVAL 10 DAY), 4)
    AS current_value,
  round(sum(value) FILTER (ts < TIMESTAMP '{AS_OF}' - INTERVAL 10 DAY
    AND ts >= TIMESTAMP '{AS_OF}' - INTERVAL 20 DAY), 4) AS previous_value FROM events""")
def compare_sum(t):
    return rounded(comparison(t.events, "ts", Metric("value", "SUM"), 10, as_of=AS_OF),
                   current_value=4, previous_value=4)


@query("comparison_distinct", f"""
SELECT count(DISTINCT user_id) FILTER (ts >= TIMESTAMP '{AS_OF}' - INTERVAL 2 DAY)
    AS current_value,
  count(DISTINCT user_id) FILTER (ts < TIMESTAMP '{AS_OF}' - INTERVAL 2 DAY
    AND ts >= TIMESTAMP '{AS_OF}' - INTERVAL 4 DAY) AS previous_value FROM events""")
def compare_distinct(t):
    return comparison(t.events, "ts", Metric("user_id", "COUNT_DISTINCT"), 2, as_of=AS_OF)


@query("comparison_count_star", f"""
SELECT count(*) FILTER (ts >= TIMESTAMP '{AS_OF}' - INTERVAL 15 DAY) AS current_value,
  count(*) FILTER (ts < TIMESTAMP '{AS_OF}' - INTERVAL 15 DAY
    AND ts >= TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY) AS previous_value FROM events""")
def compare_rows(t):
    return comparison(t.events, "ts", Metric(None, "COUNT_STAR"), 15, as_of=AS_OF)


@query("filter_spec", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity FROM lineitem
WHERE l_quantity >= 10 AND l_discount <= 0.05 AND l_returnflag IN ('A', 'R')
  AND CAST(l_quantity AS VARCHAR) LIKE '4%' AND l_linestatus != 'F'
  AND l_shipdate IS NOT NULL""")
def filter_spec(t):
    return where(t.lineitem, [
        Filter("l_quantity", ">=", 10), Filter("l_discount", "<=", 0.05),
        Filter("l_returnflag", "IN", ["A", "R"]), Filter("l_linestatus", "IN", []),
        Filter("l_quantity", "LIKE", "4%"), Filter("l_linestatus", "!=", "F"),
        Filter("l_shipdate", "IS NOT NULL")]).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")


@query("widget_filter", """
SELECT p_partkey, p_name, p_brand, p_size FROM part
WHERE contains(lower(p_name), 'ring') AND p_size > 5 AND p_size <= 40
  AND p_brand <> 'Brand#1' AND p_type IN ('ECONOMY', 'PROMO', 'SMALL')""")
def widget_filter(t):
    return widget_where(t.part, [
        Filter("p_name", "contains", "RING"), Filter("p_size", "gt", 5),
        Filter("p_size", "lte", 40), Filter("p_brand", "neq", "Brand#1"),
        Filter("p_type", "in", ["ECONOMY", "PROMO", "SMALL"]), Filter("p_type", "in", []),
        Filter("no such column", "eq", 1)]).select("p_partkey", "p_name", "p_brand", "p_size")


@query("catalog_search", """
SELECT doc_id, source, n_chars FROM documents
WHERE contains(lower(text), 'the') AND lang = 'en'
ORDER BY n_chars DESC, doc_id LIMIT 200""")
def catalog_search(t):
    return search(t.documents, "The", ["text"], "n_chars", {"lang": "en"}, tie="doc_id").select(
        "doc_id", "source", "n_chars")


@query("widget_agg", """
SELECT p_brand, round(v, 2) AS value FROM (
  SELECT p_brand, sum(p_retailprice) AS v FROM part GROUP BY 1 ORDER BY v DESC, 1 LIMIT 10)""")
def widget_agg(t):
    return rounded(widget(t.part, "p_retailprice", "sum", "p_brand", top_n=10, sort_dir="desc"),
                   value=2)


@query("widget_agg2", """
SELECT l_returnflag, l_linestatus, round(avg(l_extendedprice), 6) AS value FROM lineitem
GROUP BY 1, 2""")
def widget_agg2(t):
    return rounded(widget(t.lineitem, "l_extendedprice", "avg", "l_returnflag", "l_linestatus"),
                   value=6)


@query("widget_top", """
SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders
ORDER BY o_totalprice DESC, o_orderkey LIMIT 10""")
def widget_top(t):
    return widget(t.orders, "o_totalprice", "top", top_n=10, tie=["o_orderkey"],
                  columns=["o_orderkey", "o_totalprice", "o_orderpriority"])


@query("widget_bucket", """
SELECT strftime(date_trunc('quarter', o_orderdate), '%Y-%m-%d') AS o_orderdate,
  count(DISTINCT o_custkey) AS value FROM orders GROUP BY 1""")
def widget_bucket(t):
    return dated(widget(t.orders, "o_custkey", "count_distinct", "o_orderdate",
                        date_bucket="quarter"), "o_orderdate")


@query("widget_bucket_year", """
SELECT strftime(date_trunc('year', l_shipdate), '%Y-%m-%d') AS l_shipdate, l_returnflag,
  max(l_extendedprice) AS value FROM lineitem GROUP BY 1, 2""")
def widget_bucket_year(t):
    return dated(widget(t.lineitem, "l_extendedprice", "max", "l_shipdate", "l_returnflag",
                        date_bucket="year"), "l_shipdate")


@query("widget_scalar", "SELECT count(DISTINCT user_id) AS value FROM events")
def widget_scalar(t):
    return widget(t.events, "user_id", "count_distinct")


@query("pattern_buckets", """
SELECT name, round(sum(l_quantity), 2) AS value FROM (
  SELECT CASE WHEN regexp_extract(p_name, '(?i)\\b(ring|bolt|gear)\\b', 1) = '' THEN 'Other'
    ELSE upper(regexp_extract(p_name, '(?i)\\b(ring|bolt|gear)\\b', 1)) END AS name, l_quantity
  FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity <> 0) GROUP BY 1""")
def name_buckets(t):
    rows = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    return rounded(pattern_buckets(rows, "p_name", "l_quantity", r"(?i)\b(ring|bolt|gear)\b"),
                   value=2)


@query("latest_n", """
SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, event_type FROM events
ORDER BY events.ts DESC, event_id LIMIT 50""")
def latest_rows(t):
    return timed(latest(t.events, "ts", 50, "event_id").select("event_id", "ts", "event_type"),
                 "ts")


@query("latest_snapshot", """
SELECT o_orderkey, o_custkey, o_totalprice FROM orders
WHERE o_orderdate = (SELECT max(o_orderdate) FROM orders)""")
def newest_snapshot(t):
    return latest_snapshot(t.orders, "o_orderdate").select(
        "o_orderkey", "o_custkey", "o_totalprice")
