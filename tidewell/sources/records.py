"""Dynamic records: schema inference, name and value clean-up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.casts import column_type, ref
from ..functions.text import safe_names

# Fixed value: text that counts as a timestamp.
ISO_TIME = r"^\d{4}-\d{2}-\d{2}T[\d:.]+Z?$"

NESTED = (T.StructType, T.ArrayType, T.MapType)


def read_records(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Newline-delimited records; fields missing in some records are NULL there."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.json(path)


def warehouse_type(dtype: T.DataType) -> str:
    if isinstance(dtype, T.BooleanType):
        return "BOOL"
    if isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "INT64"
    if isinstance(dtype, T.NumericType):
        return "FLOAT64"
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return "TIMESTAMP"
    if isinstance(dtype, T.DateType):
        return "DATE"
    return "STRING"


def infer_schema(df: DataFrame) -> DataFrame:
    """Warehouse type per column with filled rows.

    Text is a timestamp only if every non-empty value is ISO text with a ``T``;
    a column without values is text.
    """
    names = safe_names(df.columns)
    rows = []
    for i, (field, name) in enumerate(zip(df.schema.fields, names)):
        c = ref(df, field.name)
        if isinstance(field.dataType, T.StringType):
            text = F.nullif(c, F.lit(""))
            filled = F.count(text)
            kind = F.when(F.bool_and(text.rlike(ISO_TIME)), F.lit("TIMESTAMP")).otherwise(
                F.lit("STRING"))
        else:
            filled = F.count(c)
            kind = F.when(filled > 0, F.lit(warehouse_type(field.dataType))).otherwise(
                F.lit("STRING"))
        rows.append(F.struct(F.lit(i + 1).alias("position"), F.lit(name).alias("name"),
                             kind.alias("type"), filled.alias("filled")).alias(f"f{i}"))
    wide = df.agg(*rows)
    return wide.select(F.inline(F.array(*[F.col(f"f{i}") for i in range(len(rows))])))


def as_text(df: DataFrame, name: str) -> Column:
    """Nested values as JSON text, other values as they print."""
    c = ref(df, name)
    return F.to_json(c) if isinstance(column_type(df, name), NESTED) else c.cast("string")


def sanitize(df: DataFrame, declared: dict[str, str] | None = None) -> DataFrame:
    """Safe names, ``''`` as NULL, nested values as JSON text.

    Columns declared ``STRING`` become text whatever they hold.
    """
    out = []
    for field, name in zip(df.schema.fields, safe_names(df.columns)):
        c = ref(df, field.name)
        if isinstance(field.dataType, NESTED):
            c = F.to_json(c)
        elif isinstance(field.dataType, T.StringType):
            c = F.nullif(c, F.lit(""))
        elif (declared or {}).get(name) == "STRING":
            c = c.cast("string")
        out.append(c.alias(name))
    return df.select(*out)


def typed(df: DataFrame, schema_rows) -> DataFrame:
    """Apply inferred types (rows of ``infer_schema``) to sanitised records."""
    kinds = {r["name"]: r["type"] for r in schema_rows}
    casts = {"TIMESTAMP": "timestamp", "INT64": "bigint", "FLOAT64": "double", "BOOL": "boolean"}
    return df.select(*[
        (ref(df, n).try_cast(casts[kinds[n]]) if kinds.get(n) in casts
         and isinstance(column_type(df, n), T.StringType) else ref(df, n)).alias(n)
        for n in df.columns])
