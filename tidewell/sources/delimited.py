"""Delimited text: reading, type inference, statistics, checks, mapping."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.casts import ref, text_to_number
from ..functions.text import display_name
from ..operators.profile import stack_frames

# Separators by preference, key names, text shapes, limits.
SEPARATORS = [",", "\t", ";", "|"]
KEY_NAMES = ["id", "uuid", "key", "_id", "pk", "sku", "order_id", "user_id", "customer_id",
             "email"]
BOOLEAN_TEXT = r"(?i)^(true|false|yes|no|1|0)$"
NUMBER_TEXT = r"^-?\d+(\.\d+)?([eE][+-]?\d+)?$"
DATE_TEXT = r"^\d{4}-\d{2}-\d{2}|^\d{1,2}/\d{1,2}/\d{2,4}"
MAX_COLUMNS = 500
SAMPLE_VALUES = 5
PREVIEW_ROWS = 20
FILL_WARNING = 0.1


def detect_separator(header: str) -> str:
    """Most frequent separator of a header line; the first listed wins ties."""
    return max(SEPARATORS, key=lambda s: (header.count(s), -SEPARATORS.index(s)))


def read_delimited(spark: SparkSession, path: str, sep: str | None = None) -> DataFrame:
    """All columns as text. Quoted fields may hold separators and doubled quotes.

    Only the header line reaches the driver. Blank lines are dropped. A file
    without data rows is an error.
    """
    if sep is None:
        head = spark.read.text(path).where(F.trim("value") != "").first()
        if head is None:
            raise ValueError(f"{path} is empty")
        sep = detect_separator(head[0])
    df = spark.read.csv(path, sep=sep, header=True, quote='"', escape='"', multiLine=False,
                        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
                        enforceSchema=False)
    if df.isEmpty():
        raise ValueError(f"{path} needs a header row and at least one data row")
    trimmed = [c.strip() for c in df.columns]
    return df.toDF(*trimmed) if len(set(trimmed)) == len(trimmed) else df


def _filled(c: Column) -> Column:
    return F.coalesce(F.trim(c), F.lit("")) != ""


def infer_types(df: DataFrame) -> DataFrame:
    """Type per text column: boolean, then number, then date, else string.

    Every non-blank value must fit, over all rows, in one pass.
    """
    def fits(c, pattern):
        return F.bool_and(F.trim(c).rlike(pattern))

    wide = df.agg(*[
        F.struct(
            F.lit(i + 1).alias("position"), F.lit(name).alias("column"),
            F.when(fits(F.when(_filled(ref(df, name)), ref(df, name)), BOOLEAN_TEXT),
                   F.lit("boolean"))
            .when(fits(F.when(_filled(ref(df, name)), ref(df, name)), NUMBER_TEXT),
                  F.lit("number"))
            .when(fits(F.when(_filled(ref(df, name)), ref(df, name)), DATE_TEXT),
                  F.lit("date"))
            .otherwise(F.lit("string")).alias("type"),
            F.count_if(_filled(ref(df, name))).alias("non_empty"),
            F.count(F.lit(1)).alias("total")).alias(f"c{i}")
        for i, name in enumerate(df.columns)])
    return wide.select(F.inline(F.array(*[F.col(f"c{i}") for i in range(len(df.columns))])))


def is_key_name(name: str) -> bool:
    low = name.lower()
    return any(low == k or low.endswith(f"_{k}") for k in KEY_NAMES)


def column_stats(df: DataFrame) -> DataFrame:
    """Types, filled and total rows, display name and the first key candidate."""
    keys = [n for n in df.columns if is_key_name(n)]
    first_key = keys[0] if keys else None
    shown = {n: display_name(n, i + 1) for i, n in enumerate(df.columns)}
    name = F.col("column")
    pairs = F.create_map(*[F.lit(x) for n in df.columns for x in (n, shown[n])])
    return infer_types(df).select(
        "*", F.element_at(pairs, name).alias("display_name"),
        (name == F.lit(first_key)).alias("is_key") if first_key else F.lit(False).alias("is_key"))


def sample_values(df: DataFrame, n: int = SAMPLE_VALUES) -> DataFrame:
    """First few values per column, in the order of the rows."""
    few = preview(df, n)
    return few.agg(*[F.collect_list(F.coalesce(ref(df, c), F.lit(""))).alias(c)
                     for c in df.columns])


def preview(df: DataFrame, n: int = PREVIEW_ROWS) -> DataFrame:
    """The first rows in the order in which files are read."""
    rows = df.withColumn("__row", F.monotonically_increasing_id())
    return rows.orderBy("__row").limit(n).drop("__row")


def validate(stats: DataFrame, included: list[str] | None = None) -> DataFrame:
    """Errors and warnings as rows (severity, column, message)."""
    none = F.lit(None).cast("string")
    kept = stats if included is None else stats.where(F.col("column").isin(included))
    totals = stats.agg(F.count(F.lit(1)).alias("columns"),
                       F.coalesce(F.max("total"), F.lit(0)).alias("rows"),
                       F.coalesce(F.bool_or("is_key"), F.lit(False)).alias("has_key"))
    chosen = kept.agg(F.count(F.lit(1)).alias("kept"))

    def issue(frame, cond, severity, column, message):
        return frame.where(cond).select(F.lit(severity).alias("severity"), column.alias("column"),
                                        F.lit(message).alias("message"))

    return stack_frames([
        issue(totals, F.col("rows") == 0, "error", none, "no data rows"),
        issue(totals, F.col("columns") == 0, "error", none, "no columns"),
        issue(totals, F.col("columns") > MAX_COLUMNS, "error", none, "too many columns"),
        issue(chosen, F.col("kept") == 0, "error", none, "no column included"),
        issue(totals, ~F.col("has_key"), "warning", none, "no key column"),
        issue(stats, F.col("non_empty") < F.col("total") * FILL_WARNING, "warning",
              F.col("column"), "over 90% empty")])


@dataclass(frozen=True)
class Mapping:
    source: str
    target: str
    type: str = "string"
    include: bool = True


def map_columns(df: DataFrame, mappings: list[Mapping], zero_as_null: bool = False) -> DataFrame:
    """Include, rename and cast text columns; blank text is NULL.

    Zero is kept unless ``zero_as_null`` asks otherwise.
    """
    out = []
    for m in mappings:
        if not m.include:
            continue
        c = F.nullif(ref(df, m.source), F.lit(""))
        if m.type == "number":
            c = text_to_number(c)
            if zero_as_null:
                c = F.nullif(c, F.lit(0.0))
        elif m.type == "boolean":
            c = (F.lower(c) == "true") | (c == "1")
        out.append(c.alias(m.target))
    if not out:
        raise ValueError("at least one column must be included")
    return df.select(*out)
