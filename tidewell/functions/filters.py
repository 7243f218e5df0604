"""Filter lists as one predicate."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .casts import ref


@dataclass(frozen=True)
class Filter:
    column: str
    op: str
    value: Any = None


_COMPARE = {
    "=": lambda c, v: c == v,
    "!=": lambda c, v: c != v,
    ">": lambda c, v: c > v,
    ">=": lambda c, v: c >= v,
    "<": lambda c, v: c < v,
    "<=": lambda c, v: c <= v,
}
_WIDGET_COMPARE = {"eq": "=", "neq": "!=", "gt": ">", "gte": ">=", "lt": "<", "lte": "<="}


def all_of(parts: list[Column]) -> Column | None:
    return reduce(and_, parts) if parts else None


def _term(df: DataFrame, f: Filter) -> Column | None:
    c = ref(df, f.column)
    op = f.op.upper()
    if op == "IS NULL":
        return c.isNull()
    if op == "IS NOT NULL":
        return c.isNotNull()
    if op == "IN":
        values = list(f.value) if isinstance(f.value, (list, tuple)) else [f.value]
        return c.isin(values) if values else None  # an empty list is no filter
    if op == "LIKE":
        return c.cast("string").like(str("" if f.value is None else f.value))
    if op in _COMPARE:
        return _COMPARE[op](c, F.lit(f.value))
    raise ValueError(f"unknown operator {f.op!r}")


def where(df: DataFrame, filters: list[Filter] | tuple[Filter, ...] = ()) -> DataFrame:
    """Rows that meet every filter; an unknown column is an error."""
    cond = all_of([t for f in filters if (t := _term(df, f)) is not None])
    return df if cond is None else df.where(cond)


def widget_where(df: DataFrame, filters: list[Filter]) -> DataFrame:
    """Widget filters; unknown columns and empty lists are skipped."""
    parts = []
    for f in filters:
        if f.column not in df.columns:
            continue
        c = ref(df, f.column)
        if f.op in _WIDGET_COMPARE:
            parts.append(_COMPARE[_WIDGET_COMPARE[f.op]](c, F.lit(f.value)))
        elif f.op == "contains":
            # the value is literal text: % and _ are not wildcards
            parts.append(F.contains(F.lower(c.cast("string")), F.lit(str(f.value).lower())))
        elif f.op == "in" and isinstance(f.value, (list, tuple)) and f.value:
            parts.append(c.isin(list(f.value)))
    cond = all_of(parts)
    return df if cond is None else df.where(cond)


def search(df: DataFrame, text: str, columns: list[str], newest_by: str,
           equals: dict[str, Any] | None = None, n: int = 200,
           tie: str | None = None) -> DataFrame:
    """Case-insensitive substring in any of the columns, newest first."""
    hit = reduce(lambda a, b: a | b,
                 [F.contains(F.lower(ref(df, c)), F.lit(text.lower())) for c in columns])
    out = df.where(hit)
    for name, value in (equals or {}).items():
        out = out.where(ref(df, name) == value)
    order = [F.desc(newest_by)] + ([F.asc(tie)] if tie else [])
    return out.orderBy(*order).limit(n)
