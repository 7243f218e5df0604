"""Sources: delimited files, records, flattening, sheets, extracts, campaigns.

The files are written from the test tables first and then read back, so each
query covers every row of its table.
"""

from pyspark.sql import functions as F

from ..functions.times import month_first
from ..plans.records import classify_records
from ..session import fresh_dir
from ..sources import delimited as D
from ..sources import flatten as X
from ..sources import outreach as O
from ..sources.records import infer_schema, read_records, sanitize
from ..sources.relational import extract, repeatable_sample, table_preview
from ..sources.sheet import sheet_to_table
from .base import query, rounded


def _orders_file(t):
    """Orders as a semicolon file with a 0/1 column and an empty column."""
    path = fresh_dir(t.spark, "orders-csv")
    t.orders.select(
        F.col("o_orderkey").alias("Order ID"), F.col("o_custkey").alias("customer"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("Ordered On"),
        F.col("o_totalprice").alias("total"),
        F.when(F.col("o_orderstatus") == "F", F.lit("1")).otherwise(F.lit("0")).alias("done"),
        F.concat(F.lit('say "'), F.col("o_orderpriority"), F.lit('"; ok')).alias("note"),
        F.lit("").alias("blank")).write.csv(path, sep=";", header=True, quote='"', escape='"',
                                            emptyValue="")
    return D.read_delimited(t.spark, path)


@query("csv_read", """
SELECT o_orderkey AS order_id, strftime(o_orderdate, '%Y-%m-%d') AS ordered_on,
  o_totalprice AS total, 'say "' || o_orderpriority || '"; ok' AS note FROM orders""")
def csv_read(t):
    return _orders_file(t).select(
        F.col("`Order ID`").cast("bigint").alias("order_id"),
        F.col("`Ordered On`").alias("ordered_on"), F.col("total").cast("double").alias("total"),
        "note")


_TYPES_SQL = """
SELECT position, "column", type, CASE WHEN type = 'string' AND "column" = 'blank' THEN 0 ELSE n END
  AS non_empty, n AS total FROM (VALUES (1, 'Order ID', 'number'), (2, 'customer', 'number'),
  (3, 'Ordered On', 'date'), (4, 'total', 'number'), (5, 'done', 'boolean'),
  (6, 'note', 'string'), (7, 'blank', 'string')) v(position, "column", type),
  (SELECT count(*) AS n FROM orders)"""


@query("csv_types", _TYPES_SQL)
def csv_types(t):
    return D.infer_types(_orders_file(t))


@query("csv_column_stats", f"""
SELECT t.*, CASE "column" WHEN 'Order ID' THEN 'order_id' WHEN 'Ordered On' THEN 'ordered_on'
  ELSE "column" END AS display_name, false AS is_key FROM ({_TYPES_SQL}) t""")
def csv_column_stats(t):
    return D.column_stats(_orders_file(t))


@query("csv_validate", """
SELECT severity, "column", message FROM (VALUES
  ('warning', NULL, 'no key column'), ('warning', 'blank', 'over 90% empty'))
  v(severity, "column", message), (SELECT count(*) AS n FROM orders) WHERE n > 0""")
def csv_validate(t):
    return D.validate(D.column_stats(_orders_file(t)))


@query("csv_map", """
SELECT o_orderkey + 0.0::DOUBLE AS order_number, o_totalprice AS amount,
  o_orderstatus = 'F' AS finished, CAST(NULL AS VARCHAR) AS remark FROM orders""")
def csv_map(t):
    return D.map_columns(_orders_file(t), [
        D.Mapping("Order ID", "order_number", "number"), D.Mapping("total", "amount", "number"),
        D.Mapping("done", "finished", "boolean"), D.Mapping("blank", "remark"),
        D.Mapping("note", "note", include=False)])


def _records(t):
    """Events as newline-delimited records with nested, ISO-time and blank fields."""
    path = fresh_dir(t.spark, "events-ndjson")
    t.events.select(
        "event_id", "value", (F.col("event_type") == "error").alias("is error"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("seen-at"),
        F.when(F.col("event_type") == "view", F.lit("")).otherwise(F.col("event_type"))
        .alias("2kind"),
        F.from_json("props", "k bigint").alias("props"),
        F.array("event_type").alias("tags"),
        F.lit("").alias("nothing")).write.json(path, ignoreNullFields=False)
    return read_records(t.spark, path)


@query("infer_schema", """
SELECT name, type, CASE name WHEN 'nothing' THEN 0 WHEN '_2kind' THEN kinds ELSE n END AS filled
FROM (VALUES ('event_id', 'INT64'), ('value', 'FLOAT64'), ('is_error', 'BOOL'),
  ('seen_at', 'TIMESTAMP'), ('_2kind', 'STRING'), ('props', 'STRING'), ('tags', 'STRING'),
  ('nothing', 'STRING')) v(name, type),
  (SELECT count(*) AS n, count(*) FILTER (event_type <> 'view') AS kinds FROM events)""")
def inferred(t):
    return infer_schema(_records(t)).select("name", "type", "filled")


@query("sanitize_rows", """
SELECT event_id, value, event_type = 'error' AS is_error,
  strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS seen_at,
  CASE WHEN event_type <> 'view' THEN event_type END AS _2kind,
  '{"k":' || json_extract_string(props, '$.k') || '}' AS props,
  '["' || event_type || '"]' AS tags, CAST(NULL AS VARCHAR) AS nothing FROM events""")
def sanitized(t):
    return sanitize(_records(t))


@query("flatten_json_suffix", """
SELECT event_id, '{"k":' || json_extract_string(props, '$.k') || '}' AS props_json,
  '["' || event_type || '"]' AS tags_json FROM events""")
def flatten_suffixed(t):
    return X.flatten_suffixed(_records(t).select("event_id", "props", "tags"))


@query("flatten_payment", """
SELECT o_orderkey AS id, 'cus_' || o_custkey AS customer, o_totalprice AS amount,
  '{"prio":"' || o_orderpriority || '"}' AS metadata_json,
  '[{"sku":' || o_custkey || '}]' AS lines_json, '{"code":"' || o_orderstatus || '"}' AS card,
  'plan_' || o_orderstatus AS plan, 'plan_' || o_orderstatus AS plan_id,
  o_custkey AS plan_amount, 'usd' AS plan_currency, 'month' AS plan_interval FROM orders""")
def flatten_payment(t):
    key = F.col("o_custkey").cast("string")
    plan = F.concat(F.lit("plan_"), "o_orderstatus")
    records = t.orders.select(
        F.col("o_orderkey").alias("id"),
        F.struct(F.concat(F.lit("cus_"), key).alias("id"), F.lit("x").alias("name"))
        .alias("customer"),
        F.col("o_totalprice").alias("amount"),
        F.struct(F.col("o_orderpriority").alias("prio")).alias("metadata"),
        F.struct(F.array(F.struct(F.col("o_custkey").alias("sku"))).alias("data")).alias("lines"),
        F.struct(F.col("o_orderstatus").alias("code")).alias("card"),
        F.struct(plan.alias("id"), F.col("o_custkey").alias("amount"),
                 F.lit("usd").alias("currency"), F.lit("month").alias("interval")).alias("plan"))
    return X.flatten_payment(records)


@query("flatten_crm", """
SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS company, c_acctbal AS annualrevenue,
  CAST(c_nationkey AS BIGINT) AS contact_count, '2024-01-02 00:00:00' AS closedate,
  '{"nation":' || c_nationkey || '}' AS associations_json FROM customer""")
def flatten_crm(t):
    records = t.customer.select(
        F.col("c_custkey").alias("id"),
        F.struct(F.col("c_name").alias("company"),
                 F.col("c_acctbal").cast("string").alias("annualrevenue"),
                 F.col("c_nationkey").cast("string").alias("contact_count"),
                 F.lit("2024-01-02").alias("closedate")).alias("properties"),
        F.struct(F.col("c_nationkey").alias("nation")).alias("associations"))
    return X.flatten_crm(records).withColumn(
        "closedate", F.date_format("closedate", "yyyy-MM-dd HH:mm:ss"))


@query("flatten_engagement", """
SELECT CAST(event_id AS VARCHAR) AS id, event_type AS type,
  epoch_us(ts) // 1000 AS created_at, epoch_us(ts) // 1000 AS updated_at,
  '{"k":' || json_extract_string(props, '$.k') || '}' AS body_json, '{}' AS associations_json
FROM events""")
def flatten_engagement(t):
    at = F.unix_millis(F.col("ts").cast("timestamp"))
    records = t.events.select(
        F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("type"),
                 at.alias("createdAt"), at.alias("lastUpdated")).alias("engagement"),
        F.from_json("props", "k bigint").alias("metadata"))
    return X.flatten_engagement(records)


@query("sheet_to_table", """
SELECT CAST(c_custkey AS VARCHAR) AS customer_id, c_name AS name,
  CASE WHEN c_acctbal >= 0 THEN c_mktsegment END AS segment FROM customer""")
def sheet(t):
    key = F.col("c_custkey").cast("string")
    cells = (F.when(F.col("c_acctbal") >= 0, F.array(key, "c_name", "c_mktsegment"))
             .otherwise(F.array(key, F.col("c_name"))))
    rows = t.customer.select((F.col("c_custkey") + 1).alias("row_idx"), cells.alias("cells"))
    header = t.spark.range(1).select(
        F.col("id").alias("row_idx"),
        F.array(F.lit("Customer ID"), F.lit("Name"), F.lit("segment")).alias("cells"))
    return sheet_to_table(header.unionByName(rows))


@query("extract_full", """
SELECT o_orderkey, o_custkey, o_totalprice FROM orders""")
def extract_full(t):
    return extract(t.orders).select("o_orderkey", "o_custkey", "o_totalprice")


@query("extract_incremental", """
SELECT event_id, user_id, value FROM events WHERE ts >= TIMESTAMP '2024-01-20 12:00:00'""")
def extract_incremental(t):
    return extract(t.events, "2024-01-20 12:00:00", ["ts"]).select("event_id", "user_id", "value")


@query("extract_epoch", """
SELECT event_id, user_id, value FROM events WHERE floor(epoch(ts)) >= 1705752000""")
def extract_epoch(t):
    rows = t.events.withColumn("created", F.unix_seconds(F.col("ts").cast("timestamp")))
    return extract(rows, "1705752000", ["created"]).select("event_id", "user_id", "value")


@query("extract_two_cursors", """
SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem
WHERE coalesce(CASE WHEN l_linestatus = 'F' THEN l_shipdate END, l_shipdate - INTERVAL 30 DAY)
  >= TIMESTAMP '2000-01-01'""")
def extract_two_cursors(t):
    rows = t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey",
        F.when(F.col("l_linestatus") == "F", F.col("l_shipdate")).alias("updated_at"),
        (F.col("l_shipdate") - F.make_dt_interval(F.lit(30))).alias("created_at"))
    return extract(rows, "2000-01-01 00:00:00").drop("updated_at", "created_at")


def dealt_anew(df):
    """The same rows in other partitions, as many as their size asks for."""
    return df.hint("rebalance")


@query("sample", """
SELECT least(count(*), 500) AS rows, least(count(*), 500) AS found, true AS repeats FROM lineitem""")
def sample(t):
    """Rows sampled, how many of them the table has, and whether a second sample is the same."""
    key = ["l_orderkey", "l_linenumber"]
    one, two = (repeatable_sample(df, 500) for df in (t.lineitem, dealt_anew(t.lineitem)))
    same = one.unionByName(two).distinct().agg(F.count(F.lit(1))).scalar()
    found = one.join(t.lineitem.select(*key), key, "left_semi").agg(F.count(F.lit(1))).scalar()
    return one.agg(F.count(F.lit(1)).alias("rows")).withColumns({
        "found": found, "repeats": same == F.col("rows")})


@query("table_preview", """
SELECT event_id, user_id, event_type FROM events ORDER BY ts DESC, event_id LIMIT 200""")
def preview_rows(t):
    return table_preview(t.events, "ts", "event_id", 200).select(
        "event_id", "user_id", "event_type")


_CAMPAIGNS_SQL = """
WITH a AS (SELECT l_partkey, CAST(sum(l_quantity) AS BIGINT) AS contacted,
    CAST(sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) AS BIGINT) AS replied,
    CAST(sum(CASE WHEN l_returnflag = 'A' THEN l_quantity ELSE 0 END) AS BIGINT) AS opened,
    count(*) AS leads FROM lineitem GROUP BY 1)
SELECT CAST(p_partkey AS VARCHAR) AS campaign_id, p_name AS name,
  CASE p_size WHEN 1 THEN 'active' WHEN 2 THEN 'paused' WHEN 3 THEN 'completed'
    WHEN 4 THEN 'stopped' ELSE 'draft' END AS status,
  coalesce(leads, p_size) AS total_leads, coalesce(contacted, 0) AS contacted,
  coalesce(opened, 0) AS opened, coalesce(replied, 0) AS replied, 0 AS bounced,
  CASE WHEN contacted > 0 THEN round(100.0 * opened / contacted, 2) ELSE 0 END AS open_rate,
  CASE WHEN contacted > 0 THEN round(100.0 * replied / contacted, 2) ELSE 0 END AS reply_rate,
  '2024-01-01' AS range_start, '' AS range_end, '2024-01-31T00:00:00Z' AS synced_at
FROM part LEFT JOIN a ON l_partkey = p_partkey"""


@query("engagement_rows", _CAMPAIGNS_SQL)
def engagement(t):
    roster = t.part.select(F.col("p_partkey").alias("campaign_id"), F.col("p_name").alias("name"),
                           F.col("p_size").alias("status"), F.col("p_size").alias("total_leads"))

    def part_of(flag):
        return F.sum(F.when(F.col("l_returnflag") == flag, F.col("l_quantity")).otherwise(0.0))

    analytics = t.lineitem.groupBy(F.col("l_partkey").alias("campaign_id")).agg(
        F.sum("l_quantity").alias("contacted_count"), part_of("R").alias("reply_count"),
        part_of("A").alias("open_count"), F.count(F.lit(1)).alias("leads_count"))
    return O.engagement_rows(roster, analytics, "2024-01-01", "", "2024-01-31 00:00:00")


@query("engagement_fractions", """
SELECT l_suppkey AS campaign_id, round(CASE WHEN s > 0 THEN o / s ELSE 0 END, 8) AS open_rate,
  round(CASE WHEN s > 0 THEN r / s ELSE 0 END, 8) AS reply_rate, 0.0 AS bounce_rate
FROM (SELECT l_suppkey, sum(l_quantity) AS s,
  sum(CASE WHEN l_returnflag = 'A' THEN l_quantity ELSE 0 END) AS o,
  sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) AS r FROM lineitem GROUP BY 1)""")
def fractions(t):
    def part_of(flag):
        return F.sum(F.when(F.col("l_returnflag") == flag, F.col("l_quantity")).otherwise(0.0))

    counters = t.lineitem.groupBy(F.col("l_suppkey").alias("campaign_id")).agg(
        F.sum("l_quantity").alias("emails_sent"), part_of("A").alias("emails_opened"),
        part_of("R").alias("emails_replied"), F.lit(0.0).alias("emails_bounced"))
    return rounded(O.fraction_rates(counters), open_rate=8, reply_rate=8, bounce_rate=8).select(
        "campaign_id", "open_rate", "reply_rate", "bounce_rate")


@query("daily_rollup", """
SELECT user_id AS campaign_id,
  round(sum(CASE WHEN event_type = 'view' THEN 0 ELSE value END), 4) AS contacted,
  round(sum(CASE WHEN event_type = 'click' THEN value WHEN value > 10 THEN value / 2 ELSE 0 END),
    4) AS opened, 0.0 AS replied, CAST(count(*) AS DOUBLE) AS total_leads, 0.0 AS bounced
FROM events GROUP BY 1""")
def daily(t):
    rows = t.events.select(
        F.col("user_id").alias("campaign_id"),
        F.when(F.col("event_type") != "view", F.col("value")).otherwise(-1.0).alias("sent"),
        F.when(F.col("event_type") == "click", F.col("value")).alias("unique_opened"),
        F.when(F.col("value") > 10, F.col("value") / 2).alias("opens"),
        F.lit(0).alias("new_leads_contacted"), F.lit(1).alias("leads"))
    return rounded(O.daily_rollup(rows), contacted=4, opened=4)


@query("date_reorder", """
SELECT o_orderkey, strftime(o_orderdate, '%m-%d-%Y') AS day FROM orders""")
def date_reorder(t):
    return t.orders.select("o_orderkey", month_first(F.date_format("o_orderdate", "yyyy-MM-dd"))
                           .alias("day"))


@query("csv_preview", """
SELECT count(*) AS columns, any_value(r) AS rows, any_value(s) AS samples FROM (
  SELECT unnest(range(7)), least(n, 20) AS r, least(n, 5) AS s
  FROM (SELECT count(*) AS n FROM orders))""")
def csv_preview(t):
    df = _orders_file(t)
    shown = D.preview(df)
    samples = D.sample_values(df)
    return shown.agg(F.lit(len(shown.columns)).cast("bigint").alias("columns"),
                     F.count(F.lit(1)).alias("rows"),
                     F.size(samples.select("note").scalar()).cast("bigint").alias("samples"))


@query("classify_records", """
SELECT name, type, semantic_class, role, CASE name WHEN 'nothing' THEN 0
  WHEN '_2kind' THEN kinds ELSE n END AS filled
FROM (VALUES ('event_id', 'INT64', 'identifier', 'identifier'),
  ('value', 'FLOAT64', 'number', 'metric'), ('is_error', 'BOOL', 'boolean', 'dimension'),
  ('seen_at', 'TIMESTAMP', 'timestamp', 'time'), ('_2kind', 'STRING', 'category', 'dimension'),
  ('props', 'STRING', 'text', 'detail'), ('tags', 'STRING', 'tag', 'dimension'),
  ('nothing', 'STRING', 'text', 'detail')) v(name, type, semantic_class, role),
  (SELECT count(*) AS n, count(*) FILTER (event_type <> 'view') AS kinds FROM events)""")
def record_classes(t):
    return classify_records(_records(t))
