"""Grouped aggregates, time series, rankings, comparisons and widget aggregates."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.casts import like_time, limited, num, ref, row_hash, ts
from ..functions.filters import Filter, where
from ..functions.times import bucket, clamp_days, days, within
from .ordered import sum_above

AGGREGATES = ("SUM", "AVG", "COUNT", "COUNT_DISTINCT", "COUNT_STAR", "MIN", "MAX")


@dataclass(frozen=True)
class Metric:
    """One measure. ``exact`` keeps decimals and integers instead of doubles."""

    column: str | None
    fn: str
    alias: str | None = None
    exact: bool = False

    @property
    def name(self) -> str:
        return self.alias or self.column or "value"


def measure(df: DataFrame, m: Metric, cond: Column | None = None) -> Column:
    """Aggregate expression, optionally over the rows that meet ``cond`` only."""
    fn = m.fn.upper()
    if fn not in AGGREGATES:
        raise ValueError(f"unknown aggregate {m.fn!r}")
    if fn == "COUNT_STAR":
        return F.count(F.lit(1)) if cond is None else F.count_if(cond)
    c = ref(df, m.column) if fn.startswith("COUNT") else num(df, m.column, m.exact)
    if cond is not None:
        c = F.when(cond, c)
    return {
        "SUM": F.sum, "AVG": F.avg, "MIN": F.min, "MAX": F.max,
        "COUNT": F.count, "COUNT_DISTINCT": F.count_distinct,
    }[fn](c)


def aggregate(df: DataFrame, metrics: list[Metric], dimension: str | None = None,
              filters: list[Filter] = (), order_by: str | None = None,
              descending: bool = True, limit: int | None = 100) -> DataFrame:
    """Metrics, optionally by one dimension; rows without the dimension are left out."""
    if not metrics:
        raise ValueError("at least one metric is needed")
    rows = where(df, filters)
    measures = [measure(df, m).alias(m.name) for m in metrics]
    if dimension is None:
        return rows.agg(*measures)
    key = ref(df, dimension)
    order = order_by or metrics[0].name
    grouped = (rows.where(key.isNotNull())
               .groupBy(key.alias("dimension")).agg(*measures))
    first = F.desc(order) if descending else F.asc(order)
    return limited(grouped.orderBy(first, F.asc("dimension")), limit)


def time_series(df: DataFrame, time_column: str, metric: Metric | None = None,
                grain: str = "DAY", filters: list[Filter] = (),
                lookback_days: int | None = None, as_of=None,
                limit: int | None = 180) -> DataFrame:
    """One row per day, week (from Sunday) or month, oldest first; gaps stay gaps.

    The ``limit`` oldest buckets, or all of them for None.
    """
    if grain.upper() not in ("DAY", "WEEK", "MONTH"):
        raise ValueError(f"unknown grain {grain!r}")
    when = ts(df, time_column)
    rows = where(df, filters).where(when.isNotNull())
    if lookback_days and lookback_days > 0:
        rows = rows.where(within(df, time_column, as_of, lookback_days))
    value = measure(df, metric or Metric(None, "COUNT_STAR")).alias("value")
    return (rows.groupBy(bucket(when, grain).alias("bucket")).agg(value)
            .orderBy("bucket").transform(limited, limit))


def _with_share(groups: DataFrame) -> DataFrame:
    # The total is one row read back as a scalar subquery over the same
    # (reused) exchange, so the groups are never gathered into one task.
    total = groups.agg(F.sum("value")).scalar()
    return groups.withColumn("share_pct", F.try_divide(F.col("value"), total) * 100)


def top_shares(groups: DataFrame, top_n: int | None) -> DataFrame:
    """Top groups (dimension, value), all for None, with share of the total of all, and rank."""
    shared = _with_share(groups)
    if top_n is None:
        # members of equal value share a rank, and the number of larger ones gives it
        sizes = groups.groupBy("value").agg(F.count(F.lit(1)).alias("n"))
        ranks = sum_above(sizes, "value", "n").select(
            F.col("value").alias("__value"), (F.col("before") + 1).cast("int").alias("rank"))
        return (shared.join(ranks, F.col("value").eqNullSafe(F.col("__value"))).drop("__value")
                .orderBy(F.desc("value"), F.asc("dimension")))
    top = limited(shared.orderBy(F.desc("value"), F.asc("dimension")), top_n)
    # A row's rank depends on larger rows only, and those are all in the top.
    return top.withColumn("rank", F.rank().over(Window.orderBy(F.desc("value"))))


def ranking(df: DataFrame, dimension: str, metric: Metric, filters: list[Filter] = (),
            top_n: int | None = 10) -> DataFrame:
    """Top members (all for None) with share of the total over all members, and rank."""
    key = ref(df, dimension)
    groups = (where(df, filters).where(key.isNotNull())
              .groupBy(key.alias("dimension"))
              .agg(measure(df, metric).alias("value")))
    return top_shares(groups, top_n)


def top_ratios(sums: DataFrame, top_n: int | None) -> DataFrame:
    """Top members of (dimension, num, den) by ``100 * num / den``, with their share."""
    groups = sums.where(F.col("den") > 0).select(
        "dimension", (F.try_divide(F.col("num"), F.col("den")) * 100).alias("value"))
    return limited(_with_share(groups).orderBy(F.desc("value"), F.asc("dimension")), top_n)


def ratio_ranking(df: DataFrame, dimension: str, numerator: str, denominator: str,
                  top_n: int | None = 10) -> DataFrame:
    """Top members (all for None) by ``100 * sum(numerator) / sum(denominator)``."""
    key = ref(df, dimension)
    return top_ratios(df.where(key.isNotNull()).groupBy(key.alias("dimension")).agg(
        F.sum(num(df, numerator)).alias("num"), F.sum(num(df, denominator)).alias("den")), top_n)


def comparison(df: DataFrame, time_column: str, metric: Metric, window_days: int = 30,
               filters: list[Filter] = (), as_of=None) -> DataFrame:
    """Current window (open above) against the window before it, in one pass."""
    n = clamp_days(window_days)
    when = ts(df, time_column)
    now = like_time(df, time_column, as_of)
    cut, prior = now - days(n), now - days(2 * n)
    # Older rows count in neither window, so the scan may skip them.
    rows = where(df, filters).where(when >= prior)
    if metric.fn.upper() == "COUNT_DISTINCT":
        # one row per value says in which windows it occurs
        flags = rows.groupBy(ref(df, metric.column).alias("v")).agg(
            F.bool_or(when >= cut).alias("now"), F.bool_or(when < cut).alias("before"))
        filled = F.col("v").isNotNull()
        return flags.agg(F.count_if(F.col("now") & filled).alias("current_value"),
                         F.count_if(F.col("before") & filled).alias("previous_value"))
    return rows.agg(
        measure(df, metric, when >= cut).alias("current_value"),
        measure(df, metric, (when < cut) & (when >= prior)).alias("previous_value"))


def widget(df: DataFrame, value_field: str | None = None, fn: str = "first", group_by: str | None = None,
           group_by2: str | None = None, date_bucket: str | None = None,
           top_n: int | None = None, sort_dir: str | None = None,
           columns: list[str] | None = None, tie: list[str] = ()) -> DataFrame:
    """Widget aggregate: collapse to one row, group by one or two fields, ``top`` or ``first``.

    ``top`` sorts the rows themselves by the value field, ``first`` takes some rows, the same ones on
    every run. Groups are sorted by
    value only when ``sort_dir`` or ``top_n`` asks for it.
    """
    descending = (sort_dir or "desc") == "desc"

    def directed(name):
        return F.desc(name) if descending else F.asc(name)

    if fn == "top":
        out = df.orderBy(directed(value_field), *[F.asc(t) for t in tie])
        out = out.limit(top_n) if top_n else out
        return out.select(*columns) if columns else out
    if fn == "first":
        out = df.orderBy(*([F.asc(t) for t in tie] or [row_hash(df)]))
        out = out.limit(top_n) if top_n else out
        return out.select(*columns) if columns else out
    value = measure(df, Metric(value_field, fn.upper())).alias("value")
    keys = []
    for position, name in enumerate(k for k in (group_by, group_by2) if k):
        key = ref(df, name)
        if position == 0 and date_bucket:
            key = bucket(ts(df, name), date_bucket)
        keys.append(key.alias(name))
    if not keys:
        return df.agg(value)
    out = df.groupBy(*keys).agg(value)
    names = [k for k in (group_by, group_by2) if k]
    if sort_dir or top_n:
        out = out.orderBy(directed("value"), *[F.asc(n) for n in names])
    elif date_bucket:
        out = out.orderBy(*names)
    return out.limit(top_n) if top_n else out


# Alternative keys of a counter row, in order of preference, give one number.
def first_positive(*columns: Column) -> Column:
    values = [F.when(c > 0, c) for c in columns]
    return F.coalesce(*values, F.lit(0))


def pattern_buckets(df: DataFrame, name_column: str, value_column: str, pattern: str,
                    other: str = "Other") -> DataFrame:
    """Sum values by the part of a name that matches a pattern; largest first."""
    hit = F.regexp_extract(ref(df, name_column), pattern, 1)
    key = F.when(F.coalesce(hit, F.lit("")) == "", F.lit(other)).otherwise(F.upper(hit))
    value = num(df, value_column)
    return (df.where(value.isNotNull() & (value != 0))
            .groupBy(key.alias("name")).agg(F.sum(value).alias("value"))
            .orderBy(F.desc("value"), "name"))
