"""Previous-row, running-count and rank logic in tasks of bounded size.

A window over a key puts all rows of that key in one task, and a window without a key puts all rows
there. Here rows are cut into slices of equal size by their order: exact order statistics give the
border rows, so a slice holds its share of rows even where all of them have one key or one time.
Windows run inside a slice, one summary row per slice (and key) carries the state over, and only
those summaries are ordered as a whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.casts import column_type, ref, ts
from .order_stats import Wanted, halved, located

SLICE = 500_000             # rows that a task may put in order
MAX_SLICES = 200            # borders are compared with every row


def sortable(df: DataFrame, name: str) -> Column:
    """A number that orders rows as the column does."""
    dtype = column_type(df, name)
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(ref(df, name).cast("timestamp"))
    if isinstance(dtype, (T.DateType, T.StringType)):
        return F.unix_micros(ts(df, name).cast("timestamp"))
    return ref(df, name)


def slices(df: DataFrame, order: Column, tie: Column | None = None, n: int | None = None) -> Column:
    """Number of the slice that a row is in, of about ``n`` slices of equal size.

    It does not decrease along (order, tie); rows without an order are in the first. Equal rows share
    a slice. By default a slice has ``SLICE`` rows, so a small table is one slice and needs no search.
    """
    if n is None:
        n = min(-(-df.count() // SLICE), MAX_SLICES)
    wanted = {str(i): Wanted(order, lambda total, i=i: F.when(
        total > n, F.floor(total * F.lit(i) / F.lit(n))), tie) for i in range(1, n)}
    borders = {at for at in located(df, wanted).values() if at[0] is not None}
    if not borders:
        return F.lit(0)
    values, lasts = (F.array(*[F.lit(at[i]) for at in sorted(borders)]) for i in (0, 1))

    def after(i: Column) -> Column:
        value = F.get(values, i)
        if tie is None:
            return order >= value
        return (order > value) | ((order == value) & (tie >= F.get(lasts, i)))

    return halved(len(borders), after)


def slices_for(df: DataFrame, key: str) -> int:
    """How many slices rows need so that no task orders more than some ``SLICE`` rows of a key."""
    sizes = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    row = sizes.agg(F.max("n").alias("largest"), F.sum("n").alias("total")).first()
    if row["largest"] is None or row["largest"] <= SLICE:
        return 1
    return min(-(-row["total"] // SLICE), MAX_SLICES)


def changes(df: DataFrame, key: str, order: list[str], value: Column,
            n_slices: int | None = None) -> DataFrame:
    """Rows whose value differs from the row before it in the same key.

    Adds ``value`` and ``seq`` (1, 2, ... per key). ``order`` is one or two columns: a time or a
    number, and a number that tells equal ones apart. Where no key has more rows than a slice, rows are
    put in order by key alone.
    """
    n_slices = slices_for(df, key) if n_slices is None else n_slices
    if n_slices == 1:
        own = Window.partitionBy(key).orderBy(*order)
        rows = df.withColumn("value", value)
        rows = rows.withColumn("__prev", F.lag(F.struct("value")).over(own))
        return (rows.where(F.col("__prev").isNull()
                           | ~F.col("value").eqNullSafe(F.col("__prev.value"))).drop("__prev")
                .withColumn("seq", F.row_number().over(own).cast("long")))
    leading = sortable(df, order[0])
    tie = sortable(df, order[1]) if len(order) > 1 else None
    rows = df.withColumns({"value": value, "__slice": slices(df, leading, tie, n_slices)})
    inside = Window.partitionBy(key, "__slice").orderBy(*order)
    between = Window.partitionBy(key).orderBy("__slice")

    position = F.struct(*order)
    last = rows.groupBy(key, "__slice").agg(
        F.max_by(F.struct("value"), position).alias("__last"))
    carried = last.select(F.col(key).alias("__key"), F.col("__slice").alias("__in"),
                          F.lag("__last").over(between).alias("__before"))
    same = F.col(key).eqNullSafe(F.col("__key")) & (F.col("__slice") == F.col("__in"))
    first = F.row_number().over(inside) == 1
    linked = (rows.join(carried, same).drop("__key", "__in")
              .withColumn("__first", first)
              .withColumn("__prev", F.when(F.col("__first"), F.col("__before"))
                          .otherwise(F.lag(F.struct("value")).over(inside))))
    changed = linked.where(F.col("__prev").isNull()
                           | ~F.col("value").eqNullSafe(F.col("__prev.value"))).drop(
        "__first", "__prev", "__before")

    counts = changed.groupBy(key, "__slice").agg(F.count(F.lit(1)).alias("__n"))
    earlier = Window.partitionBy(key).orderBy("__slice").rowsBetween(
        Window.unboundedPreceding, -1)
    offsets = counts.select(F.col(key).alias("__key"), F.col("__slice").alias("__in"),
                            F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__base"))
    return (changed.join(offsets, same)
            .withColumn("seq", F.col("__base") + F.row_number().over(inside))
            .drop("__slice", "__base", "__key", "__in"))


def sum_above(df: DataFrame, value: str, n: str, n_slices: int | None = None) -> DataFrame:
    """``df`` (one row per value) with ``before``, the sum of ``n`` over larger values."""
    rows = df.withColumn("__slice", slices(df, sortable(df, value), n=n_slices))
    # one row per slice
    totals = rows.groupBy("__slice").agg(F.sum(n).alias("__sum"))
    above = totals.select(F.col("__slice").alias("__in"), F.coalesce(F.sum("__sum").over(
        Window.orderBy(F.desc("__slice")).rowsBetween(Window.unboundedPreceding, -1)),
        F.lit(0)).alias("__above"))
    inside = Window.partitionBy("__slice").orderBy(F.desc(value)).rowsBetween(
        Window.unboundedPreceding, -1)
    return (rows.join(F.broadcast(above), F.col("__slice") == F.col("__in"))
            .withColumn("before", F.col("__above") + F.coalesce(F.sum(n).over(inside), F.lit(0)))
            .drop("__slice", "__in", "__above"))
