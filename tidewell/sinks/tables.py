"""Full refresh and append of catalog tables, with a count-back."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.text import safe_name


@dataclass(frozen=True)
class LoadResult:
    table: str
    path: str
    rows_written: int
    rows_found: int
    created: bool


def counted_write(df: DataFrame, path: str, mode: str = "errorifexists",
                  partition_by: str | None = None) -> int:
    seen = Observation()
    writer = df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode(mode)
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    return seen.get["rows"]


def full_refresh(df: DataFrame, table: str, root: str) -> LoadResult:
    """Replace a table: write a new version, count it back, then point the view at it.

    Readers see the old version until the view changes. The new data may be
    computed from the table itself, because nothing is overwritten.
    """
    spark = df.sparkSession
    name = safe_name(table)
    path = f"{root.rstrip('/')}/{name}/{uuid.uuid4().hex}"
    created = not spark.catalog.tableExists(name)
    written = counted_write(df, path)
    found = spark.read.parquet(path).count()
    if found != written:
        raise RuntimeError(f"{name}: wrote {written} rows but {path} holds {found}")
    spark.sql(f"CREATE OR REPLACE VIEW `{name}` AS SELECT * FROM parquet.`{path}`")
    return LoadResult(name, path, written, found, created)


def append_load(df: DataFrame, path: str) -> DataFrame:
    """Append rows to a folder table, creating it on first use; returns all rows.

    Columns that only some loads have are NULL elsewhere.
    """
    df.write.mode("append").parquet(path)
    return df.sparkSession.read.option("mergeSchema", "true").parquet(path)


def current(spark: SparkSession, table: str) -> DataFrame | None:
    name = safe_name(table)
    return spark.table(name) if spark.catalog.tableExists(name) else None


def export_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; fields are quoted when they need it, quotes doubled."""
    (df.write.option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss")
     .csv(path, header=True, quote='"', escape='"', emptyValue="", nullValue="",
                 timestampFormat="yyyy-MM-dd'T'HH:mm:ss"))
