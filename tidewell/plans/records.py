"""Meaning of records that arrive without a schema."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.profile import classify_values
from ..sources.records import infer_schema, sanitize
from .semantic import classify_catalog

# warehouse type -> declared type of the classifier
DECLARED = {"BOOL": "boolean", "INT64": "number", "FLOAT64": "number", "TIMESTAMP": "timestamp",
            "DATE": "timestamp", "STRING": "string"}


def classify_records(df: DataFrame) -> DataFrame:
    """Inferred type, class and role per column; names first, then values."""
    clean = sanitize(df)
    looks = classify_values(clean).select(F.col("column").alias("column_name"), "value_class")
    declared = F.lit(None).cast("string")
    for kind, name in DECLARED.items():
        declared = F.when(F.col("type") == kind, F.lit(name)).otherwise(declared)
    typed = infer_schema(df).select(F.col("name").alias("column_name"), "type", "filled",
                                    declared.alias("declared_type"))
    classified = classify_catalog(typed.join(looks, "column_name", "left"), "value_class")
    return classified.select(F.col("column_name").alias("name"), "type", "semantic_class", "role",
                             "filled")
