"""Enrichment joins, latest-N picks, snapshots, schema differences."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.casts import ref

SALTS = 32


def latest_n_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int,
                     spread_by: list[str], salts: int = SALTS) -> DataFrame:
    """First ``n`` rows of each key in the given order.

    A key that holds much of the table is first cut down in ``salts`` parts, so
    the last step sees at most ``n * salts`` rows of any key. ``spread_by``
    (columns that vary within a key) decides the part and is repeatable.
    """
    part = F.pmod(F.xxhash64(*[ref(df, c) for c in spread_by]), F.lit(salts))
    coarse = Window.partitionBy(*keys, "__part").orderBy(*order)
    fine = Window.partitionBy(*keys).orderBy(*order)
    trimmed = (df.withColumn("__part", part)
               .withColumn("__rn", F.row_number().over(coarse))
               .where(F.col("__rn") <= n).drop("__part", "__rn"))
    return (trimmed.withColumn("rn", F.row_number().over(fine))
            .where(F.col("rn") <= n))


def latest(df: DataFrame, time_column: str, n: int, tie: str) -> DataFrame:
    """Newest ``n`` rows."""
    return df.orderBy(F.desc(time_column), F.asc(tie)).limit(n)


def latest_snapshot(df: DataFrame, stamp: str) -> DataFrame:
    """Rows that carry the newest stamp of the table."""
    c = ref(df, stamp)
    return df.where(c == df.agg(F.max(c)).scalar())


def count_children(parents: DataFrame, children: DataFrame, parent_key: str,
                   child_key: str, alias: str = "n") -> DataFrame:
    """Parents with their number of children; zero is kept.

    Children are counted before the join, so a parent with very many children
    brings one row to it.
    """
    counted = (children.where(ref(children, child_key).isNotNull())
               .groupBy(ref(children, child_key).alias("__k"))
               .agg(F.count(F.lit(1)).alias(alias)))
    return (parents.join(counted, ref(parents, parent_key) == F.col("__k"), "left")
            .drop("__k").withColumn(alias, F.coalesce(F.col(alias), F.lit(0))))


def with_rollups(parents: DataFrame, key: str, rollups: list[DataFrame],
                 zero: list[str] = ()) -> DataFrame:
    """Left join frames that hold one row per key; listed counts default to 0."""
    out = reduce(lambda left, right: left.join(right, key, "left"), rollups, parents)
    for name in zero:
        out = out.withColumn(name, F.coalesce(F.col(name), F.lit(0)))
    return out


def only_owned(tables: DataFrame, table_key: str, flows: DataFrame,
               flow_table: str) -> DataFrame:
    """Tables that some flow writes; no flows means no tables."""
    owned = flows.where(ref(flows, flow_table).isNotNull()).select(
        ref(flows, flow_table).alias("__t")).distinct()
    return tables.join(owned, ref(tables, table_key) == F.col("__t"), "left_semi")


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(ref(df, column)).where(ref(df, column).isNotNull()).distinct()


def schema_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Added, removed and retyped columns.

    Both frames hold ``table_name, column_name, data_type``.
    """
    keys = ["table_name", "column_name"]
    a = old.select(*keys, F.col("data_type").alias("old_type"))
    b = new.select(*keys, F.col("data_type").alias("new_type"))
    change = (F.when(F.col("old_type").isNull(), F.lit("added"))
              .when(F.col("new_type").isNull(), F.lit("removed"))
              .when(F.col("old_type") != F.col("new_type"), F.lit("changed")))
    return (a.join(b, keys, "full_outer").withColumn("change", change)
            .where(F.col("change").isNotNull()))
