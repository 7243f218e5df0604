"""Table references in statement text, lineage graphs, and statement checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.casts import ref, row_hash
from ..functions.filters import widget_where
from .ordered import changes
from .profile import stack_frames

# Where a table is named, and what a read-only statement may not hold.
TABLE_REFERENCE = r"(?i)\b(?:FROM|JOIN)\s+`?([a-zA-Z0-9_][a-zA-Z0-9_.\-]*)`?"
READ_ONLY_START = r"(?i)^(select|with)\b"
FORBIDDEN_WORDS = ["insert", "update", "delete", "drop", "create", "alter", "merge", "truncate",
                   "grant", "revoke", "call", "begin", "commit", "export"]
FORBIDDEN = rf"(?i)\b({'|'.join(FORBIDDEN_WORDS)})\b"


def table_refs(sql: Column) -> Column:
    """Distinct lower-case table references of a statement."""
    found = F.regexp_extract_all(sql, F.lit(TABLE_REFERENCE), 1)
    return F.array_distinct(F.transform(found, lambda r: F.lower(r)))


def suffixes(name: Column) -> Column:
    """A dotted name and what is left of it without its first parts."""
    parts = F.split(name, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)),
                       lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def statement_refs(statements: DataFrame, id_col: str = "id", sql_col: str = "sql") -> DataFrame:
    """One row per statement and reference."""
    return statements.select(F.col(id_col).alias("statement_id"),
                             F.explode(table_refs(F.col(sql_col))).alias("ref"))


def statement_edges(statements: DataFrame, tables: DataFrame, kind: str = "query",
                    id_col: str = "id", sql_col: str = "sql") -> DataFrame:
    """Table -> statement edges for the statements that read known tables.

    A reference means a table if it equals its name or is qualified with a
    prefix, so every dotted suffix of a reference is a key of an equi join.
    """
    names = tables.select("table_name", F.lower("table_name").alias("__key")).distinct()
    refs = statement_refs(statements, id_col, sql_col).select(
        "statement_id", F.explode(F.array_distinct(suffixes(F.col("ref")))).alias("__key"))
    return (refs.join(names, "__key")
            .select(F.concat(F.lit("table_"), "table_name").alias("from_node"),
                    F.concat(F.lit(f"{kind}_"), F.col("statement_id").cast("string"))
                    .alias("to_node"),
                    F.lit(kind).alias("label")).distinct())


def flow_edges(flows: DataFrame) -> DataFrame:
    """Source -> flow and flow -> table edges."""
    flow = F.concat(F.lit("flow_"), F.col("id").cast("string"))
    extract = flows.select(F.concat(F.lit("source_"), "source_id").alias("from_node"),
                           flow.alias("to_node"), F.lit("extract").alias("label"))
    load = flows.where(F.col("warehouse_table").isNotNull()).select(
        flow.alias("from_node"), F.concat(F.lit("table_"), "warehouse_table").alias("to_node"),
        F.lit("load").alias("label"))
    return extract.unionByName(load)


def lineage_nodes(flows: DataFrame, edges: DataFrame) -> DataFrame:
    """Distinct nodes: sources, flows, tables, and statements that have an edge."""
    def nodes(df, kind, key, label):
        return df.select(F.concat(F.lit(f"{kind}_"), key.cast("string")).alias("node_id"),
                         F.lit(kind).alias("type"), label.cast("string").alias("label"))

    loaded = flows.where(F.col("warehouse_table").isNotNull())
    read = edges.select(F.col("to_node").alias("node_id"), F.col("label").alias("type"),
                        F.regexp_replace("to_node", "^[a-z]+_", "").alias("label"))
    return stack_frames([
        nodes(flows, "source", F.col("source_id"), F.col("source_id")).distinct(),
        nodes(flows, "flow", F.col("id"), F.col("id")),
        nodes(loaded, "table", F.col("warehouse_table"), F.col("warehouse_table")).distinct(),
        read.distinct()])


def unknown_refs(statements: DataFrame, tables: DataFrame, id_col: str = "id",
                 sql_col: str = "sql", table_col: str = "table_name") -> DataFrame:
    """References that name no known table.

    A reference is known if it equals a full table name or is its dotted suffix,
    so every suffix of every known name is a key of the anti join.
    """
    known = tables.select(F.explode(suffixes(F.lower(F.col(table_col)))).alias("ref")).distinct()
    return statement_refs(statements, id_col, sql_col).join(known, "ref", "left_anti")


def without_comments(sql: Column) -> Column:
    """Statement without comments and outer white space."""
    marked = F.contains(sql, F.lit("--")) | F.contains(sql, F.lit("/*"))
    lines = F.regexp_replace(sql, r"(?m)--.*$", "")
    bare = F.when(marked, F.regexp_replace(lines, r"(?s)/\*.*?\*/", "")).otherwise(sql)
    return F.btrim(bare, F.lit(" \t\n\r\f\x0b"))


def read_only_verdicts(statements: DataFrame, sql_col: str = "sql") -> DataFrame:
    """Add ``verdict``: ``ok``, ``empty``, ``not_select`` or ``forbidden``."""
    # the cleaned text is a column of its own, so it is made once per row
    cleaned = statements.withColumn(
        "__text", without_comments(F.coalesce(F.col(sql_col), F.lit(""))))
    text = F.col("__text")
    verdict = (F.when(text == "", F.lit("empty"))
               .when(~text.rlike(READ_ONLY_START), F.lit("not_select"))
               .when(text.rlike(FORBIDDEN), F.lit("forbidden"))
               .otherwise(F.lit("ok")))
    return cleaned.withColumn("verdict", verdict).drop("__text")


def _require_read_only(spark, sql: str) -> str:
    verdict = read_only_verdicts(spark.range(1).select(F.lit(sql).alias("sql"))).first()["verdict"]
    if verdict != "ok":
        raise ValueError(f"statement refused: {verdict}")
    return sql.strip().rstrip(";")


def run_sql(spark, sql: str, limit: int = 200) -> DataFrame:
    """Run a saved statement, read-only and bounded by a limit on its result."""
    return spark.sql(_require_read_only(spark, sql)).limit(limit)


def model_query(spark, sql: str, filters, cap: int = 5_000,
                order_by: list[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Saved model, filtered outside, and whether the cap cut it.

    The first ``cap`` rows by ``order_by`` stay; ties, and rows without an order, go by a hash of the
    row, so every run keeps the same ones. The second frame is one row (rows_seen, capped) that
    counts ``cap + 1`` rows.
    """
    rows = widget_where(spark.sql(_require_read_only(spark, sql)), filters)
    seen = rows.limit(cap + 1).agg(F.count(F.lit(1)).alias("rows_seen"))
    kept = rows.orderBy(*[ref(rows, c) for c in order_by], row_hash(rows)).limit(cap)
    return kept, seen.withColumn("capped", F.col("rows_seen") > cap)


def model_versions(edits: DataFrame) -> DataFrame:
    """Edit events (model_id, edited_at, edit_id, sql) -> one row per version.

    A new version starts only where the trimmed statement differs from the one
    before it; versions count from 1.
    """
    out = changes(edits, "model_id", ["edited_at", "edit_id"], F.trim("sql"))
    return out.select("model_id", F.col("seq").alias("version"), F.col("value").alias("sql"),
                      "edited_at")
