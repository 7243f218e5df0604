"""Column classes, roles and concepts, over a schema or a whole catalog of columns."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import label, label_col
from . import vocabulary as V

_NUMBER_TYPES = ["number", "integer", "float"]


def declared_type(dtype: T.DataType) -> str:
    """Declared type in the classifier's vocabulary."""
    if isinstance(dtype, T.NumericType):
        return "number"
    if isinstance(dtype, T.BooleanType):
        return "boolean"
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "timestamp"
    if isinstance(dtype, T.ArrayType):
        return "array"
    if isinstance(dtype, (T.StructType, T.MapType)):
        return "json"
    return "string"


@dataclass(frozen=True)
class ColumnMeaning:
    name: str
    declared: str
    cls: str
    role: str
    label: str
    is_primary_key: bool = False
    is_foreign_key: bool = False


def class_of(name: str, declared: str, value_class: str | None = None) -> str:
    settled = V.DECLARED_CLASSES.get(declared)
    if settled:
        return settled
    for pattern, cls in V.NAME_RULES:
        if re.search(pattern, name, re.IGNORECASE):
            return cls
    if value_class:
        return value_class
    return {"number": "number", "string": "text"}.get(declared, "unknown")


def role_of(cls: str, declared: str) -> str:
    if cls in V.TIME_CLASSES:
        return "time"
    if cls in V.ID_CLASSES:
        return "identifier"
    if cls in V.ALWAYS_METRIC:
        return "metric"
    if cls in V.METRIC_CLASSES and (cls == "number" or declared in _NUMBER_TYPES):
        return "metric"
    if cls in V.METRIC_CLASSES or cls in V.DIMENSION_CLASSES:
        return "dimension"
    return "detail"


def classify_schema(df: DataFrame, overrides: dict[str, str] | None = None,
                    value_classes: dict[str, str] | None = None, primary_keys: list[str] = (),
                    foreign_keys: list[str] = ()) -> list[ColumnMeaning]:
    """Meaning of each column of one table; ``overrides`` sets the class by name.

    A key column is an identifier, whatever its class.
    """
    out = []
    for field in df.schema.fields:
        declared = declared_type(field.dataType)
        cls = (overrides or {}).get(field.name) or class_of(
            field.name, declared, (value_classes or {}).get(field.name))
        primary, foreign = field.name in primary_keys, field.name in foreign_keys
        role = "identifier" if primary or foreign else role_of(cls, declared)
        out.append(ColumnMeaning(field.name, declared, cls, role, label(field.name), primary,
                                 foreign))
    return out


# The same decisions as column expressions, for catalogs of any number of tables.

def class_col(name: str, declared: str, value_class: str | None = None) -> Column:
    """Class from a name column and a declared-type column.

    One expression text: with one call per rule, building the plan would take
    longer than running it.
    """
    cases = [f"WHEN {declared} = '{t}' THEN '{c}'" for t, c in V.DECLARED_CLASSES.items()]
    cases += [f"WHEN {name} RLIKE r'(?i){p}' THEN '{c}'" for p, c in V.NAME_RULES]
    if value_class is not None:
        cases.append(f"WHEN {value_class} IS NOT NULL THEN {value_class}")
    cases += [f"WHEN {declared} = 'number' THEN 'number'", f"WHEN {declared} = 'string' THEN 'text'"]
    return F.expr(f"CASE {' '.join(cases)} ELSE 'unknown' END")


def role_col(cls: Column, declared: Column) -> Column:
    is_number = declared.isin(_NUMBER_TYPES) | (cls == "number")
    return (F.when(cls.isin(V.TIME_CLASSES), F.lit("time"))
            .when(cls.isin(V.ID_CLASSES), F.lit("identifier"))
            .when(cls.isin(V.ALWAYS_METRIC), F.lit("metric"))
            .when(cls.isin(V.METRIC_CLASSES) & is_number, F.lit("metric"))
            .when(cls.isin(V.METRIC_CLASSES + V.DIMENSION_CLASSES), F.lit("dimension"))
            .otherwise(F.lit("detail")))


def classify_catalog(columns: DataFrame, value_class: str | None = None) -> DataFrame:
    """Add class, role, label and flags to a frame with ``column_name, declared_type``.

    Columns ``is_primary_key`` and ``is_foreign_key``, where there are any, make identifiers.
    """
    out = columns.withColumn("semantic_class",
                             class_col("column_name", "declared_type", value_class))
    cls = F.col("semantic_class")
    key = F.lit(False)
    for flag in ("is_primary_key", "is_foreign_key"):
        if flag in columns.columns:
            key = key | F.coalesce(F.col(flag), F.lit(False))
    role = F.when(key, F.lit("identifier")).otherwise(role_col(cls, F.col("declared_type")))
    return out.select(
        "*", role.alias("role"),
        label_col(F.col("column_name")).alias("label"),
        cls.isin(V.MONETARY).alias("is_monetary"), cls.isin(V.RATIO).alias("is_ratio"),
        cls.isin(V.INVERSE).alias("is_inverse"))


def _concept_pairs() -> Column:
    return F.array(*[
        F.struct(F.lit(i).alias("position"), F.lit(concept).alias("concept"),
                 F.array(*[F.lit(c) for c in classes]).alias("classes"))
        for i, (concept, classes) in enumerate(V.CONCEPTS.items())])


def concept_columns(classified: DataFrame) -> DataFrame:
    """One row per column and concept it belongs to."""
    hit = F.filter(_concept_pairs(), lambda p: F.array_contains(p["classes"],
                                                                F.col("semantic_class")))
    return classified.select("*", F.explode(hit).alias("__c")).select(
        "*", F.col("__c.concept").alias("concept"),
        F.col("__c.position").alias("concept_position")).drop("__c")


def detect_concepts(classified: DataFrame) -> DataFrame:
    """Concepts present per table, with column counts and the first column by position."""
    return concept_columns(classified).groupBy("table_name", "concept").agg(
        F.count(F.lit(1)).alias("columns"),
        F.min_by("column_name", "ordinal_position").alias("first_column"))


def find_column(meanings: list[ColumnMeaning], *classes: str) -> ColumnMeaning | None:
    """First column of the first class that any column has."""
    for cls in classes:
        for m in meanings:
            if m.cls == cls:
                return m
    return None


def default_aggregate(m: ColumnMeaning) -> str:
    if m.role == "identifier":
        return "COUNT_DISTINCT"
    if m.cls in V.RATIO or m.cls == "roas":
        return "AVG"
    if m.cls in V.MONETARY or m.role == "metric":
        return "SUM"
    return "COUNT"
