"""Catalogs of tables and columns, and joins over them."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.semantic import classify_catalog, declared_type
from .profile import stack_frames


_COLUMN_ENTRY = ("array<struct<column_name string, data_type string, declared_type string, "
                 "is_nullable boolean, ordinal_position int>>")


def _columns_as_json(df: DataFrame) -> str:
    return json.dumps([
        {"column_name": f.name, "data_type": f.dataType.simpleString(),
         "declared_type": declared_type(f.dataType), "is_nullable": f.nullable,
         "ordinal_position": i + 1} for i, f in enumerate(df.schema.fields)])


def column_catalog(tables: dict[str, DataFrame]) -> DataFrame:
    """One row per column of every table, with total and filled rows from the data.

    Each table is one aggregate row; names and types travel beside it and are
    unfolded once, after the union.
    """
    wide = stack_frames([
        df.agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("total_rows"),
               F.expr(f"array({', '.join(f'count(`{c}`)' for c in df.columns)})").alias("filled"),
               F.lit(_columns_as_json(df)).alias("entries"))
        for name, df in tables.items()])
    rows = wide.select("table_name", "total_rows", "filled",
                       F.inline(F.from_json("entries", _COLUMN_ENTRY)))
    return rows.select(
        "table_name", "column_name", "data_type", "declared_type", "is_nullable",
        "ordinal_position", "total_rows",
        F.element_at("filled", F.col("ordinal_position")).alias("filled_rows"))


def session_tables(spark: SparkSession, database: str | None = None) -> dict[str, DataFrame]:
    """Tables and views the session catalog lists."""
    return {t.name: spark.table(t.name if t.isTemporary or not t.database
                                else f"{t.database}.{t.name}")
            for t in spark.catalog.listTables(database)}


def table_rows(tables: dict[str, DataFrame]) -> DataFrame:
    return stack_frames([df.agg(F.lit(name).alias("table_name"),
                                F.count(F.lit(1)).alias("total_rows"))
                         for name, df in tables.items()])


def table_bytes(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Stored bytes per table; only file lengths are read."""
    frames = [spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
              .agg(F.lit(name).alias("table_name"), F.sum("length").alias("total_bytes"),
                   F.min("modificationTime").alias("created_at"))
              for name, path in paths.items()]
    return stack_frames(frames)


def table_inventory(tables: dict[str, DataFrame], paths: dict[str, str]) -> DataFrame:
    """Rows and bytes of every table, largest first."""
    spark = next(iter(tables.values())).sparkSession
    return (table_rows(tables).join(table_bytes(spark, paths), "table_name", "left")
            .orderBy(F.desc("total_bytes"), "table_name"))


def storage_totals(inventory: DataFrame) -> DataFrame:
    """Bytes, GB (1e9) and counts by partitioning."""
    return inventory.agg(
        F.coalesce(F.sum("total_bytes"), F.lit(0)).alias("total_bytes"),
        F.count_if("is_partitioned").alias("partitioned_count"),
        F.count_if(~F.col("is_partitioned")).alias("unpartitioned_count"),
    ).withColumn("total_gb", F.round(F.col("total_bytes") / 1e9, 2))


def tables_sorted(inventory: DataFrame, key: str, descending: bool = True,
                  search: str = "") -> DataFrame:
    """Tables by name, rows or bytes; an unknown number sorts as 0."""
    rows = inventory if not search else inventory.where(
        F.contains(F.lower("table_name"), F.lit(search.lower())))
    c = F.col(key) if key == "table_name" else F.coalesce(F.col(key), F.lit(0))
    return rows.orderBy(c.desc() if descending else c.asc(), "table_name")


def catalog_tree(columns: DataFrame) -> DataFrame:
    """Tables with their columns as an ordered list (as long as the schema)."""
    entry = F.struct("ordinal_position", "column_name", "data_type")
    return columns.groupBy("table_name").agg(
        F.max("total_rows").alias("total_rows"),
        F.sort_array(F.collect_list(entry)).alias("columns"))


def discover_tables(columns: DataFrame) -> DataFrame:
    """Tables with column counts per role and layout candidates.

    The first time column suits partitioning, the first dimension clustering.
    """
    c = classify_catalog(columns)

    def first(role):
        return F.min_by("column_name", F.when(F.col("role") == role, F.col("ordinal_position")))

    return c.groupBy("table_name").agg(
        F.max("total_rows").alias("total_rows"), F.count(F.lit(1)).alias("columns"),
        F.count_if(F.col("role") == "metric").alias("metrics"),
        F.count_if(F.col("role") == "dimension").alias("dimensions"),
        first("time").alias("partition_candidate"),
        first("dimension").alias("cluster_candidate"))


def partitioned_write(df: DataFrame, path: str, day_of: Column, cluster: str | None = None,
                      partitions: int | None = None) -> None:
    """Write by day, clustered inside each day, so later scans prune."""
    dated = df.withColumn("day", F.to_date(day_of))
    keys = ["day"] + ([cluster] if cluster else [])
    spread = (dated.repartitionByRange(partitions, *keys) if partitions
              else dated.repartitionByRange(*keys))
    spread.sortWithinPartitions(*keys).write.partitionBy("day").parquet(path)
