"""Outliers, trends, generated insights, recommendations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.casts import numeric_columns, ref
from .order_stats import cuts
from .ordered import sortable
from .profile import number_or_null, numeric_stats, stack_frames

# Thresholds and lifetimes of insights and recommendations.
DEVIATIONS = 2.0
CRITICAL_SHARE = 0.1
TREND_PCT = 10.0
INSIGHT_DAYS = 7
INSIGHT_ROWS = 100
STALE_TABLE_HOURS = 48
STALE_TABLE_ROWS = 5


def _values(df: DataFrame, columns, null_as_zero) -> dict[str, Column]:
    names = columns or numeric_columns(df)
    return {n: number_or_null(df, n, null_as_zero) for n in names}


def outliers(df: DataFrame, columns: list[str] | None = None,
             null_as_zero: bool = True) -> DataFrame:
    """Per numeric column: values beyond two population deviations from the mean.

    Two passes: the first gives one row of means and deviations, read back as a
    scalar subquery; the second counts.
    """
    values = _values(df, columns, null_as_zero)
    stats = df.agg(*[F.struct(F.avg(v).alias("mean"), F.stddev_pop(v).alias("sd"),
                              F.count(v).alias("n")).alias(f"s{i}")
                     for i, v in enumerate(values.values())])
    s = stats.select(F.struct(*stats.columns)).scalar()
    counted = df.agg(*[
        F.count_if(F.abs(v - s[f"s{i}"]["mean"]) > DEVIATIONS * s[f"s{i}"]["sd"]).alias(f"o{i}")
        for i, v in enumerate(values.values())])
    rows = [F.struct(F.lit(name).alias("column"), s[f"s{i}"]["n"].alias("n"),
                     s[f"s{i}"]["mean"].alias("mean"), s[f"s{i}"]["sd"].alias("stddev"),
                     F.col(f"o{i}").alias("outliers"))
            for i, name in enumerate(values)]
    out = counted.select(F.inline(F.array(*rows)))
    return out.withColumn("severity", F.when(F.col("outliers") == 0, F.lit("none"))
                          .when(F.col("outliers") > F.col("n") * CRITICAL_SHARE,
                                F.lit("critical")).otherwise(F.lit("warning")))


def quintile_trend(df: DataFrame, order_col: str, tie_col: str,
                   columns: list[str] | None = None, null_as_zero: bool = True) -> DataFrame:
    """Mean of the first fifth of rows against the last fifth, change in percent.

    Row order is (``order_col``, ``tie_col``), and ``tie_col`` (a number) must
    tell equal times apart. The two cut rows are found exactly; all columns are
    then averaged in one pass. Change is 0 for fewer than five rows or a zero
    base. Rows whose order is NULL or unreadable are in neither fifth;
    ``unordered_rows`` counts them.
    """
    values = _values(df, columns, null_as_zero)
    order, tie = sortable(df, order_col), ref(df, tie_col)
    fifth = lambda n: F.floor(n / F.lit(5)).cast("long")
    at = cuts(df, order, tie, {
        "head": lambda n: F.when(n >= 5, fifth(n) - 1), "tail": lambda n: F.when(n >= 5, n - fifth(n))})
    if at is None:
        head = tail = F.lit(False)
    else:
        head = F.coalesce(at["head"].head(order, tie), F.lit(False))
        tail = F.coalesce(at["tail"].tail(order, tie), F.lit(False))
    zero = F.lit(0.0)
    wide = df.agg(*[
        F.struct(F.lit(name).alias("column"), fifth(F.count(order)).alias("rows_per_end"),
                 F.coalesce(F.avg(F.when(head, v)), zero).alias("first_mean"),
                 F.coalesce(F.avg(F.when(tail, v)), zero).alias("last_mean"),
                 F.count_if(order.isNull()).alias("unordered_rows")).alias(f"t{i}")
        for i, (name, v) in enumerate(values.items())])
    out = wide.select(F.inline(F.array(*[F.col(f"t{i}") for i in range(len(values))])))
    change = F.try_divide((F.col("last_mean") - F.col("first_mean")) * 100.0,
                          F.abs("first_mean"))
    return out.withColumn("trend_pct", F.coalesce(change, zero))


def _titles(name: str) -> Column:
    """How insights about the table ``name`` are called."""
    column, kind = F.concat(F.lit('"'), F.col("column"), F.lit('"')), F.col("type")
    way = F.when(F.col("value") > 0, F.lit("Upward")).otherwise(F.lit("Downward"))
    return (F.when(kind == "kpi", F.concat(F.lit(f"{name}: "), F.format_number("value", 0),
                                           F.lit(" rows analyzed")))
            .when(kind == "anomaly", F.concat(F.lit("Anomaly detected in "), column))
            .when(kind == "trend", F.concat(way, F.lit(" trend in "), column,
                                            F.format_string(" (%.1f%%)", "value")))
            .otherwise(F.lit(f'Add numeric columns to "{name}" for deeper analysis')))


def insights(df: DataFrame, order_col: str, tie_col: str, as_of: Column,
             columns: list[str] | None = None, name: str = "table") -> DataFrame:
    """Insight rows: rows analysed, anomalies, trends, or advice to add numbers.

    Rows about a column carry its mean, deviation, median, minimum and maximum. ``name`` is what
    titles call the table.
    """
    names = columns or numeric_columns(df)
    details = ["mean", "stddev", "median", "min", "max"]
    none = [F.lit(None).cast("double").alias(c) for c in details]
    total = df.agg(F.count(F.lit(1)).alias("n"))
    base = total.where(F.col("n") > 0).select(
        F.lit("kpi").alias("type"), F.lit(None).cast("string").alias("column"),
        F.lit("info").alias("severity"), F.col("n").cast("double").alias("value"), *none)
    frames = [base]
    if names:
        found = outliers(df, names).select("column", "severity", "outliers")
        known = insight_details(df, names).join(found, "column").where(F.col("n") >= 2)
        trend = quintile_trend(df, order_col, tie_col, names).select("column", "trend_pct")
        frames.append(known.where(F.col("outliers") > 0).select(
            F.lit("anomaly").alias("type"), "column", "severity",
            F.col("outliers").cast("double").alias("value"), *details))
        frames.append(known.join(trend, "column").where(F.abs("trend_pct") > TREND_PCT).select(
            F.lit("trend").alias("type"), "column",
            F.when(F.col("trend_pct") > 0, F.lit("success")).otherwise(F.lit("warning"))
            .alias("severity"), F.col("trend_pct").alias("value"), *details))
    else:
        frames.append(base.withColumns({"type": F.lit("recommendation"),
                                        "value": F.lit(None).cast("double")}))
    return stack_frames(frames).withColumns({
        "title": _titles(name), "expires_at": as_of + F.make_dt_interval(F.lit(INSIGHT_DAYS))})


def insight_details(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Mean, median, deviation, minimum and maximum behind the insights."""
    return numeric_stats(df, columns or numeric_columns(df))


def active_insights(rows: DataFrame, as_of: Column, models: DataFrame | None = None,
                    n: int = INSIGHT_ROWS) -> DataFrame:
    """Insights that are neither dismissed nor expired, newest first, with model names."""
    live = rows.where(~F.col("dismissed")
                      & (F.col("expires_at").isNull() | (F.col("expires_at") > as_of)))
    newest = live.orderBy(F.desc("created_at"), "id").limit(n)
    if models is None:
        return newest
    # only the models of these few rows take part in the outer join
    named = models.select(F.col("id").alias("model_id"), F.col("name").alias("model_name")).join(
        newest.select("model_id").distinct(), "model_id", "left_semi")
    return newest.join(named, "model_id", "left")


def recommendations(dead_jobs: DataFrame, error_flows: DataFrame, stale: DataFrame,
                    stale_rows: int | None = STALE_TABLE_ROWS) -> DataFrame:
    """Dead jobs, flows with many errors, stale tables; one healthy row if none.

    ``dead_jobs`` is one row (dead); ``error_flows`` has source_id, total, errors,
    error_pct; ``stale`` has table_name, lag_hours. Of stale tables the ``stale_rows``
    oldest are named, all of them for None.
    """
    jobs = dead_jobs.where(F.col("dead") > 0).select(
        F.lit("reliability").alias("category"), F.lit("critical").alias("severity"),
        F.lit("jobs").alias("subject"), F.col("dead").cast("double").alias("value"))
    flows = error_flows.select(
        F.lit("reliability").alias("category"), F.lit("warning").alias("severity"),
        F.col("flow_id").cast("string").alias("subject"),
        F.col("error_pct").cast("double").alias("value"))
    tables = (stale.where(F.col("lag_hours") > STALE_TABLE_HOURS)
              .orderBy(F.desc("lag_hours"), "table_name"))
    tables = (tables if stale_rows is None else tables.limit(stale_rows)).select(
        F.lit("quality").alias("category"), F.lit("warning").alias("severity"),
        F.col("table_name").alias("subject"), F.col("lag_hours").cast("double").alias("value"))
    issues = stack_frames([jobs, flows, tables])
    healthy = dead_jobs.where(issues.agg(F.count(F.lit(1))).scalar() == 0).select(
        F.lit("reliability").alias("category"), F.lit("success").alias("severity"),
        F.lit("platform").alias("subject"), F.lit(0.0).alias("value"))
    return issues.unionByName(healthy)
