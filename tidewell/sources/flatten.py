"""Nested source records as flat warehouse rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.casts import column_type, ref, text_to_number, text_to_time
from .records import NESTED

# Names that are handled by name in payment and CRM records.
PAYMENT_JSON = ["metadata", "outcome"]
PAYMENT_LISTS = ["lines", "items"]
PLAN_FIELDS = ["id", "amount", "currency", "interval"]
CRM_INTEGER_NAMES = ["founded_year", "num_employees"]


def flatten_suffixed(df: DataFrame) -> DataFrame:
    """Shop records: a nested value under ``k`` becomes JSON text under ``k_json``."""
    return df.select(*[
        F.to_json(ref(df, f.name)).alias(f"{f.name}_json")
        if isinstance(f.dataType, NESTED) else ref(df, f.name) for f in df.schema.fields])


def _field(dtype: T.DataType, name: str) -> bool:
    return isinstance(dtype, T.StructType) and name in dtype.fieldNames()


def _inner_or_whole(df: DataFrame, name: str, inner: str) -> Column:
    whole = F.to_json(ref(df, name))
    if not _field(column_type(df, name), inner):
        return whole
    part = ref(df, name).getField(inner)
    nested = isinstance(column_type(df, name)[inner].dataType, NESTED)
    return F.coalesce(F.to_json(part) if nested else part.cast("string"), whole)


def flatten_payment(df: DataFrame) -> DataFrame:
    """Payment records: nested objects become their ``id`` (else JSON text), metadata,
    outcome and line lists become ``*_json``, plan fields become ``plan_*``."""
    out = []
    for f in df.schema.fields:
        c = ref(df, f.name)
        if not isinstance(f.dataType, NESTED):
            out.append(c)
        elif f.name in PAYMENT_JSON:
            out.append(F.to_json(c).alias(f"{f.name}_json"))
        elif f.name in PAYMENT_LISTS:
            out.append(_inner_or_whole(df, f.name, "data").alias(f"{f.name}_json"))
        elif isinstance(f.dataType, T.StructType):
            out.append(_inner_or_whole(df, f.name, "id").alias(f.name))
        else:
            out.append(F.to_json(c).alias(f.name))
    if "plan" in df.columns:
        plan = column_type(df, "plan")
        out += [ref(df, "plan").getField(p).alias(f"plan_{p}") for p in PLAN_FIELDS
                if _field(plan, p)]
    return df.select(*out)


def crm_type(name: str) -> str:
    """Type of a CRM property by its name."""
    if name.endswith(("date", "Date")):
        return "timestamp"
    if "count" in name or "num_" in name or name in CRM_INTEGER_NAMES:
        return "integer"
    if name == "amount" or any(p in name for p in ("revenue", "probability", "forecast_amount")):
        return "float"
    return "string"


def _crm_value(c: Column, name: str) -> Column:
    text = F.nullif(c.cast("string"), F.lit(""))
    kind = crm_type(name)
    if kind == "timestamp":
        return text_to_time(text)
    if kind == "integer":
        return text_to_number(text).try_cast("bigint")
    return text_to_number(text) if kind == "float" else text


def flatten_crm(df: DataFrame) -> DataFrame:
    """CRM records: properties become typed columns beside id and associations."""
    properties = column_type(df, "properties")
    out = [ref(df, "id").cast("string").alias("id")]
    out += [_crm_value(F.col("properties").getField(p), p).alias(p)
            for p in properties.fieldNames()]
    associations = (F.to_json("associations") if "associations" in df.columns
                    else F.lit(None).cast("string"))
    return df.select(*out, associations.alias("associations_json"))


def flatten_engagement(df: DataFrame) -> DataFrame:
    """CRM engagement records: the inner record's fields, the rest as JSON text."""
    e = F.col("engagement")

    def text(name):
        if name not in df.columns:
            return F.lit("{}")
        return F.coalesce(F.to_json(name), F.lit("{}"))

    return df.select(
        F.coalesce(e.getField("id").cast("string"), F.lit("")).alias("id"),
        e.getField("type").alias("type"), e.getField("createdAt").alias("created_at"),
        e.getField("lastUpdated").alias("updated_at"), text("metadata").alias("body_json"),
        text("associations").alias("associations_json"))
