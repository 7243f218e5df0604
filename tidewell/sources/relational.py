"""Relational extracts: full tables and everything since a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.casts import column_type, is_numeric, like_time, limited, ref, row_hash, ts

CURSORS = ["updated_at", "created_at"]


def jdbc_table(spark: SparkSession, url: str, table: str, partition_column: str | None = None,
               partitions: int = 64, **options: str) -> DataFrame:
    """A database table, read in parallel ranges of a numeric or time column.

    The bounds only shape the ranges; rows outside them are read as well.
    """
    reader = spark.read.format("jdbc").option("url", url).options(**options)
    if partition_column is None:
        return reader.option("dbtable", table).load()
    bounds = reader.option(
        "query", f"select min({partition_column}) lo, max({partition_column}) hi from {table}"
    ).load().first()
    if bounds is None or bounds[0] is None:
        return reader.option("dbtable", table).load()
    return (spark.read.format("jdbc").option("url", url).options(**options)
            .option("dbtable", table).option("partitionColumn", partition_column)
            .option("lowerBound", str(bounds[0])).option("upperBound", str(bounds[1]))
            .option("numPartitions", str(partitions)).load())


def extract(df: DataFrame, watermark=None, cursors: list[str] | None = None) -> DataFrame:
    """All rows, or those whose first non-NULL cursor is at or after the watermark.

    One range predicate replaces paging, so rows that share a time stay together. A cursor of
    numbers, such as epoch seconds, is compared with the watermark as a number of its type.
    """
    if watermark is None:
        return df
    names = cursors or [c for c in CURSORS if c in df.columns]
    if not names:
        raise ValueError("an incremental extract needs a cursor column")
    # first non-NULL cursor, spelled as comparisons of bare columns so they push down
    cond, missing = F.lit(False), F.lit(True)
    for name in names:
        kind = column_type(df, name)
        if is_numeric(kind):
            c, least = ref(df, name), F.lit(watermark).cast(kind)
        else:
            c, least = ts(df, name), like_time(df, name, watermark)
        cond = cond | (missing & (c >= least))
        missing = missing & c.isNull()
    return df.where(cond)


def repeatable_sample(df: DataFrame, n: int = 500) -> DataFrame:
    """``n`` rows that are the same on every run."""
    return limited(df.orderBy(row_hash(df)), n)


def table_preview(df: DataFrame, time_col: str, tie: str | None = None, n: int | None = 20) -> DataFrame:
    """Newest rows, all for None; where the table has no such column, the same ones on every run."""
    if time_col not in df.columns:
        return limited(df.orderBy(row_hash(df)), n)
    return limited(df.orderBy(F.desc(time_col), *([F.asc(tie)] if tie else [])), n)
