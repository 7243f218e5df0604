"""Tolerant reads: a value that does not parse is NULL, never an error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ``try_cast`` alone accepts '1.5d', 'NaN' and a bare year; these guards do not.
NUMBER_TEXT = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
TIME_TEXT = r"^\s*\d{4}-\d{2}-\d{2}"

TIME_TYPES = (T.DateType, T.TimestampType, T.TimestampNTZType)


def column_type(df: DataFrame, name: str) -> T.DataType:
    """Type of a column; an unknown name is an error and never reaches a plan."""
    for field in df.schema.fields:
        if field.name == name:
            return field.dataType
    raise ValueError(f"unknown column {name!r}; have {df.columns}")


def ref(df: DataFrame, name: str) -> Column:
    column_type(df, name)
    return F.col(f"`{name}`")


def text_to_number(c: Column) -> Column:
    return F.when(c.rlike(NUMBER_TEXT), F.trim(c).try_cast("double"))


def text_to_time(c: Column) -> Column:
    return F.when(c.rlike(TIME_TEXT), F.trim(c).try_cast("timestamp"))


def num(df: DataFrame, name: str, exact: bool = False) -> Column:
    """Column as a double (or as stored, with ``exact``)."""
    dtype = column_type(df, name)
    c = ref(df, name)
    if isinstance(dtype, T.NumericType):
        return c if exact else c.cast("double")
    if isinstance(dtype, T.StringType):
        return text_to_number(c)
    if isinstance(dtype, T.BooleanType):
        return c.cast("int").cast("double")
    raise TypeError(f"column {name!r} of type {dtype.simpleString()} is not a number")


def ts(df: DataFrame, name: str) -> Column:
    """Column as a time. Time columns stay as they are so that filters push down."""
    dtype = column_type(df, name)
    c = ref(df, name)
    if isinstance(dtype, TIME_TYPES):
        return c
    if isinstance(dtype, T.StringType):
        return text_to_time(c)
    raise TypeError(f"column {name!r} of type {dtype.simpleString()} is not a time")


def like_time(df: DataFrame, name: str, moment) -> Column:
    """``moment`` in the type of the time column, so no cast lands on the column."""
    c = moment if isinstance(moment, Column) else (
        F.current_timestamp() if moment is None else F.lit(moment).cast("timestamp"))
    dtype = column_type(df, name)
    if isinstance(dtype, T.TimestampNTZType):
        return c.cast("timestamp_ntz")
    return c


def is_numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.NumericType)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_numeric(f.dataType)]


def row_hash(df: DataFrame) -> Column:
    """A hash of all values of a row, which orders rows the same way on every run."""
    return F.xxhash64(*[ref(df, c).cast("string") if isinstance(column_type(df, c), T.MapType)
                        else ref(df, c) for c in df.columns])


def limited(df: DataFrame, n: int | None) -> DataFrame:
    """The first ``n`` rows; all of them for None."""
    if n is None:
        return df
    if isinstance(n, bool) or int(n) < 1:
        raise ValueError(f"a limit of {n!r} rows")
    return df.limit(int(n))
