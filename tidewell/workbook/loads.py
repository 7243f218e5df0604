"""Sinks: full refresh, append, upsert, schema evolution, export."""

import uuid

from pyspark.sql import functions as F

from ..operators.export import run_history
from ..session import fresh_dir
from ..sinks.buckets import layout, merge_into
from ..sinks.merge import merge
from ..sinks.tables import append_load, export_csv, full_refresh
from .base import AS_OF, FLOWS_SQL, RUNS_SQL, as_of, query


def unique(name: str) -> str:
    return f"{name}_{uuid.uuid4().hex}"


@query("full_refresh", """
SELECT count(*) AS rows_written, count(*) AS rows_found, round(sum(p_retailprice), 2) AS price,
  max(p_size) AS largest FROM part""")
def refresh(t):
    table, root = unique("parts"), fresh_dir(t.spark, "refresh")
    full_refresh(t.part.select("p_partkey"), table, root)
    # computed from the parts again and swapped in: readers now see the wide version
    done = full_refresh(t.part, table, root)
    return t.spark.table(table).agg(
        F.lit(done.rows_written).cast("bigint").alias("rows_written"),
        F.lit(done.rows_found).cast("bigint").alias("rows_found"),
        F.round(F.sum("p_retailprice"), 2).alias("price"), F.max("p_size").alias("largest"))


@query("append_load", """
SELECT kind, count(*) AS n, count(balance) AS with_balance FROM (
  SELECT 'supplier' AS kind, s_acctbal AS balance FROM supplier
  UNION ALL SELECT 'customer', c_acctbal FROM customer UNION ALL SELECT 'nation', NULL FROM nation)
GROUP BY 1""")
def append(t):
    path = fresh_dir(t.spark, "append")
    append_load(t.supplier.select(F.lit("supplier").alias("kind"),
                                  F.col("s_acctbal").alias("balance")), path)
    append_load(t.nation.select(F.lit("nation").alias("kind")), path)
    rows = append_load(t.customer.select(F.lit("customer").alias("kind"),
                                         F.col("c_acctbal").alias("balance")), path)
    return rows.groupBy("kind").agg(F.count(F.lit(1)).alias("n"),
                                    F.count("balance").alias("with_balance"))


# Stored orders end in 1998; the batch brings everything from 1997 on again.
_STORED, _CHANGED = "1999-01-01", "1997-01-01"


def stored_orders(t):
    return t.orders.where(F.col("o_orderdate") < F.lit(_STORED).cast("timestamp_ntz"))


def changed_orders(t):
    return t.orders.where(F.col("o_orderdate") >= F.lit(_CHANGED).cast("timestamp_ntz"))


@query("merge_upsert", f"""
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice
  + CASE WHEN o_orderdate >= TIMESTAMP '{_CHANGED}' THEN 1 ELSE 0 END AS o_totalprice
FROM orders""")
def upsert(t):
    columns = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"]
    batch = changed_orders(t).withColumn("o_totalprice", F.col("o_totalprice") + 1)
    return merge(stored_orders(t).select(*columns), batch.select(*columns), ["o_orderkey"],
                 staging=fresh_dir(t.spark, "batch"))


@query("merge_evolve", f"""
SELECT o_orderkey, o_custkey,
  CASE WHEN o_orderdate < TIMESTAMP '{_STORED}' THEN o_orderstatus END AS o_orderstatus,
  CASE WHEN o_orderdate >= TIMESTAMP '{_CHANGED}' THEN substr(o_orderpriority, 3) END AS priority
FROM orders""")
def evolve(t):
    target = stored_orders(t).select("o_orderkey", "o_custkey", "o_orderstatus")
    batch = changed_orders(t).select("o_orderkey", "o_custkey",
                                     F.substring("o_orderpriority", 3, 100).alias("priority"))
    return merge(target, batch, ["o_orderkey"], staging=fresh_dir(t.spark, "batch"))


# Every line is in the batch, about four per order: the latest line wins.
@query("merge_duplicates", """
SELECT o_orderkey, o_totalprice, l.shipped, CAST(l.last_line AS BIGINT) AS last_line FROM orders
LEFT JOIN (SELECT l_orderkey, strftime(max(l_shipdate), '%Y-%m-%d') AS shipped,
    count(*) * 0 + 1 AS last_line FROM lineitem GROUP BY 1) l ON l_orderkey = o_orderkey""")
def merge_duplicates(t):
    batch = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), "l_shipdate",
                              F.date_format("l_shipdate", "yyyy-MM-dd").alias("shipped"),
                              F.lit(1).cast("bigint").alias("last_line"))
    out = merge(t.orders.select("o_orderkey", "o_totalprice"), batch, ["o_orderkey"],
                cursor="l_shipdate", staging=fresh_dir(t.spark, "batch"))
    return out.drop("l_shipdate")


@query("merge_buckets", f"""
SELECT count(*) AS rows, round(sum(o_totalprice
    + CASE WHEN o_orderkey IN (SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 3) THEN 1 ELSE 0 END), 2)
    AS price, count(*) FILTER (o_orderdate >= TIMESTAMP '{_STORED}') AS late,
  true AS few_written FROM orders""")
def merge_buckets(t):
    """Three upserts: all stored orders, the later ones, and three rows that touch three buckets at most."""
    root, table = fresh_dir(t.spark, "buckets"), unique("orders")
    merge_into(stored_orders(t), table, ["o_orderkey"], root, buckets=16)
    merge_into(changed_orders(t), table, ["o_orderkey"], root)
    few = t.orders.orderBy("o_orderkey").limit(3)
    done = merge_into(few.withColumn("o_totalprice", F.col("o_totalprice") + 1), table,
                      ["o_orderkey"], root)
    touched = layout(t.spark, table).versions()
    return t.spark.table(table).agg(
        F.count(F.lit(1)).alias("rows"), F.round(F.sum("o_totalprice"), 2).alias("price"),
        F.count_if(F.col("o_orderdate") >= F.lit(_STORED).cast("timestamp_ntz")).alias("late"),
        F.lit(done.buckets_written <= 3 and done.rows_written < done.target_rows / 4
              and len(touched) <= 3).alias("few_written"))


@query("run_export", f"""
SELECT CAST(r.id AS BIGINT) AS id, f.source_id AS source, f.dest_id AS destination,
  r.status, CAST(r.rows AS BIGINT) AS rows, CAST(r.duration_ms AS BIGINT) AS duration_ms,
  r.trigger_by, strftime(r.started_at, '%Y-%m-%dT%H:%M:%S') AS started_at, r.error
FROM {RUNS_SQL} r JOIN {FLOWS_SQL} f ON f.id = r.flow_id
WHERE r.started_at >= TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY""")
def run_export(t):
    path = fresh_dir(t.spark, "export")
    export_csv(run_history(t.runs(), t.flows(), as_of(), 30), path)
    back = t.spark.read.csv(path, header=True, quote='"', escape='"')
    return back.withColumns({c: F.col(c).cast("bigint") for c in ("id", "rows", "duration_ms")})
