"""Registry and helpers shared by the query modules."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = "2024-01-31 00:00:00"   # just after the last event

NAMES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
         "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


class Tables:
    """The test tables of one folder as lazy frames: ``t.events``."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}.parquet"

    def __getattr__(self, name: str) -> DataFrame:
        if name not in NAMES:
            raise AttributeError(name)
        # the schema is known, so no file is opened before the query runs
        df = self.spark.read.schema(SCHEMA[name]).parquet(self.path(name))
        return self.__dict__.setdefault(name, df)

    @cached_property
    def all(self) -> dict[str, DataFrame]:
        return {n: getattr(self, n) for n in NAMES}

    # Stand-ins for operational tables, derived from the given ones.
    def runs(self) -> DataFrame:
        return self.events.select(
            F.col("event_id").alias("id"), F.col("user_id").alias("flow_id"),
            F.when(F.col("event_type") == "error", F.lit("failed"))
            .otherwise(F.lit("success")).alias("status"),
            F.floor(F.col("value") * 10).alias("rows"),
            F.floor(F.col("value") * 1000).alias("duration_ms"),
            F.col("ts").alias("started_at"),
            F.when(F.col("event_type") == "click", F.lit("manual")).otherwise(F.lit("schedule"))
            .alias("trigger_by"),
            F.when(F.col("event_type") == "error", F.concat(F.lit('no "k", '), F.col("props")))
            .alias("error"))

    def flows(self) -> DataFrame:
        return self.customer.select(
            F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("user_id"),
            F.lower("c_mktsegment").alias("source_id"),
            F.when(F.col("c_acctbal") < 0, F.lit("error")).otherwise(F.lit("active"))
            .alias("status"),
            F.concat(F.lit("t_"), F.col("c_nationkey").cast("string")).alias("warehouse_table"),
            F.concat(F.lit("wh_"), (F.col("c_nationkey") % 3).cast("string")).alias("dest_id"))

    def statements(self) -> DataFrame:
        """A query log: the text each user ran, by event type."""
        table = F.concat(F.lit("t_"), F.col("user_id").cast("string"))
        kinds = {
            "view": F.concat(F.lit("SELECT * FROM `proj.sales."), table,
                             F.lit("` v JOIN sales.events e ON e.k = v.k")),
            "click": F.concat(F.lit("-- note\nWITH a AS (SELECT k FROM "), table,
                              F.lit(") SELECT * FROM a, b")),
            "purchase": F.concat(F.lit("INSERT INTO x SELECT * FROM "), table),
            "signup": F.concat(F.lit("/* drop */ select 1 from Orders join "), table),
            "error": F.concat(F.lit("SELECT * FROM "), table, F.lit("; DROP TABLE "), table),
        }
        text = F.lit(None).cast("string")
        for kind, sql in kinds.items():
            text = F.when(F.col("event_type") == kind, sql).otherwise(text)
        return self.events.select(F.col("event_id").alias("id"), text.alias("sql"),
                                  F.col("ts").alias("created_at"), "user_id")


RUNS_SQL = """(SELECT event_id AS id, user_id AS flow_id,
  CASE WHEN event_type = 'error' THEN 'failed' ELSE 'success' END AS status,
  CAST(floor(value * 10) AS BIGINT) AS rows,
  CAST(floor(value * 1000) AS BIGINT) AS duration_ms, ts AS started_at,
  CASE WHEN event_type = 'click' THEN 'manual' ELSE 'schedule' END AS trigger_by,
  CASE WHEN event_type = 'error' THEN 'no "k", ' || props END AS error FROM events)"""

FLOWS_SQL = """(SELECT c_custkey AS id, c_nationkey AS user_id,
  lower(c_mktsegment) AS source_id,
  CASE WHEN c_acctbal < 0 THEN 'error' ELSE 'active' END AS status,
  't_' || c_nationkey AS warehouse_table, 'wh_' || (c_nationkey % 3) AS dest_id FROM customer)"""

STATEMENTS_SQL = r"""(SELECT event_id AS id, ts AS created_at, user_id, CASE event_type
  WHEN 'view' THEN 'SELECT * FROM `proj.sales.t_' || user_id
    || '` v JOIN sales.events e ON e.k = v.k'
  WHEN 'click' THEN '-- note' || chr(10) || 'WITH a AS (SELECT k FROM t_' || user_id
    || ') SELECT * FROM a, b'
  WHEN 'purchase' THEN 'INSERT INTO x SELECT * FROM t_' || user_id
  WHEN 'signup' THEN '/* drop */ select 1 from Orders join t_' || user_id
  WHEN 'error' THEN 'SELECT * FROM t_' || user_id || '; DROP TABLE t_' || user_id
  END AS sql FROM events)"""


@dataclass(frozen=True)
class Entry:
    run: Callable[[Tables], DataFrame]
    sql: str | None


REGISTRY: dict[str, Entry] = {}


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` is the equivalent statement for the check."""
    def keep(fn):
        if name in REGISTRY:
            raise ValueError(f"{name} is registered twice")
        REGISTRY[name] = Entry(fn, sql)
        return fn
    return keep


def rounded(df: DataFrame, **digits: int) -> DataFrame:
    """Sums of doubles differ in their last digits with the order of addition."""
    return df.withColumns({c: F.round(c, d) for c, d in digits.items()})


def day_text(c: Column | str) -> Column:
    return F.date_format(c, "yyyy-MM-dd")


def time_text(c: Column | str) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def dated(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: day_text(c) for c in columns})


def timed(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: time_text(c) for c in columns})


def as_of(moment: str = AS_OF) -> Column:
    return F.lit(moment).cast("timestamp_ntz")


# Columns of the test tables in order: name, stored type, declared type.
SCHEMA = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, "
                "c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, "
            "p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
                "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
                "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, "
              "value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}


def _declared(stored: str) -> str:
    if stored.startswith("array"):
        return "array"
    return {"string": "string", "timestamp_ntz": "timestamp"}.get(stored, "number")


def columns_sql() -> str:
    """The column catalog as SQL: constants for names and types, counts from the data."""
    parts = []
    for table, listing in SCHEMA.items():
        for i, entry in enumerate(listing.split(", ")):
            name, stored = entry.split(" ")
            parts.append(
                f"SELECT '{table}' AS table_name, '{name}' AS column_name, "
                f"'{stored}' AS data_type, '{_declared(stored)}' AS declared_type, "
                f"{i + 1} AS ordinal_position, count(*) AS total_rows, "
                f"count({name}) AS filled_rows FROM {table}")
    return "(" + " UNION ALL ".join(parts) + ")"
