"""Column profiles from per-column value counts.

Each column is reduced to (value, count) on its own. The scan of a columnar file
then reads that column only, equal values are combined before the shuffle (so a
hot value costs one row per task), and no row is widened once per column as a
list of exact distinct counts in one aggregate would do.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.casts import column_type, num, numeric_columns, ref
from .order_stats import at_fraction, positions


def stack_frames(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def value_counts(df: DataFrame, name: str) -> DataFrame:
    """Distinct values of a column with their row counts, NULL included."""
    return df.groupBy(ref(df, name).alias("v")).agg(F.count(F.lit(1)).alias("c"))


def _profile_one(df: DataFrame, name: str, numeric: bool, approx: bool) -> DataFrame:
    empty = F.lit(None).cast("double")
    if approx:
        n = num(df, name) if numeric else None
        return df.agg(
            F.lit(name).alias("column"), F.count(F.lit(1)).alias("total_rows"),
            F.count_if(ref(df, name).isNull()).alias("nulls"),
            F.approx_count_distinct(ref(df, name)).alias("distinct"),
            (F.min(n) if numeric else empty).alias("min"),
            (F.max(n) if numeric else empty).alias("max"),
            (F.avg(n) if numeric else empty).alias("avg"),
            (F.count_if(n < 0) if numeric else F.lit(None).cast("long")).alias("negatives"))
    counts = value_counts(df, name)
    v = num(counts, "v") if numeric else None
    weight = F.when(v.isNotNull(), F.col("c")) if numeric else None
    return counts.agg(
        F.lit(name).alias("column"),
        F.coalesce(F.sum("c"), F.lit(0)).alias("total_rows"),
        F.coalesce(F.sum(F.when(F.col("v").isNull(), F.col("c"))), F.lit(0)).alias("nulls"),
        F.count("v").alias("distinct"),
        (F.min(v) if numeric else empty).alias("min"),
        (F.max(v) if numeric else empty).alias("max"),
        (F.try_divide(F.sum(v * F.col("c")), F.sum(weight)) if numeric else empty).alias("avg"),
        (F.coalesce(F.sum(F.when(v < 0, F.col("c"))), F.lit(0)) if numeric
         else F.lit(None).cast("long")).alias("negatives"))


def column_profile(df: DataFrame, columns: list[str] | None = None,
                   numeric: list[str] | None = None, approx: bool = False) -> DataFrame:
    """One row per column: rows, NULLs, distinct values, and number statistics."""
    names = columns or df.columns
    if not names:
        raise ValueError("at least one column is needed")
    numbers = set(numeric_columns(df) if numeric is None else numeric)
    return stack_frames([_profile_one(df, n, n in numbers, approx) for n in names])


def number_or_null(df: DataFrame, name: str, null_as_zero: bool) -> Column:
    """The column as a number: NULL counts as zero if asked for, NaN never counts."""
    value = num(df, name).cast("double")
    value = F.coalesce(value, F.lit(0.0)) if null_as_zero else value
    return F.when(~F.isnan(value), value)


def numeric_stats(df: DataFrame, columns: list[str] | None = None,
                  null_as_zero: bool = True) -> DataFrame:
    """Rows, mean, population deviation, median ``sorted[floor(n/2)]``, min and max.

    One pass computes everything but the medians, which are picked exactly for all columns together
    (in some four passes) and joined in as constants.
    """
    names = columns or numeric_columns(df)
    values = {n: number_or_null(df, n, null_as_zero) for n in names}
    medians = positions(df, {n: at_fraction(v, 0.5) for n, v in values.items()})
    wide = df.agg(*[
        F.struct(
            F.lit(n).alias("column"), F.count(v).alias("n"), F.avg(v).alias("mean"),
            F.stddev_pop(v).alias("stddev"),
            F.lit(medians[n]).cast("double").alias("median"),
            F.min(v).alias("min"), F.max(v).alias("max")).alias(f"s{i}")
        for i, (n, v) in enumerate(values.items())])
    return wide.select(F.inline(F.array(*[F.col(f"s{i}") for i in range(len(names))])))


# Text shapes, tried in this order.
VALUE_SHAPES = [
    ("timestamp", r"^\d{4}-\d{2}-\d{2}(T[\d:.]+Z?)?$"),
    ("email", r"^[^\s@]+@[^\s@]+\.[^\s@]+$"),
    ("url", r"^https?://"),
    ("currency", r"(?i)^[$€£₹]\s?[\d,.]+$|^[\d,.]+\s?(USD|EUR|GBP|INR)$"),
    ("percentage", r"^[\d.]+\s?%$"),
]
PHONE_SHAPE = r"^\+?[\d\s\-()]{7,16}$"
BOOLEAN_WORDS = ["true", "false", "yes", "no"]
NUMBER_SHAPE = r"^\s*([+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?)?\s*$"
CATEGORY_LENGTH = 32
CATEGORY_SHARE = 0.4
MAX_CATEGORIES = 50         # distinct values, beyond which short texts are no categories
HASH_BUCKETS = 4096         # bound what is kept of a column with many values


PROBED = 1000               # rows that may disprove shapes before all rows are read


def _shape_flags(s: Column, left: set[str] | None = None) -> dict[str, Column]:
    """Which shapes all filled values have; of those ``left`` only."""
    trimmed = F.trim(s)
    long_or_plus = F.contains(s, F.lit("+")) | (F.length(s) >= 10)
    flags = {cls: F.bool_and(trimmed.rlike(p)) for cls, p in VALUE_SHAPES} | {
        "phone": F.bool_and(trimmed.rlike(PHONE_SHAPE)),
        "plus": F.bool_or(long_or_plus),
        "boolean": F.bool_and(F.lower(s).isin(BOOLEAN_WORDS)),
        "number": F.bool_and(s.rlike(NUMBER_SHAPE))}
    return {c: f for c, f in flags.items()
            if left is None or c in left or (c == "plus" and "phone" in left)}


def distinct_buckets(value: Column) -> Column:
    """How many of ``HASH_BUCKETS`` hash values occur; a column has as many distinct values, at
    least."""
    return F.size(F.collect_set(F.when(value.isNotNull(), F.pmod(
        F.xxhash64(value), F.lit(HASH_BUCKETS)))))


def distinct_counts(df: DataFrame, values: dict[str, Column]) -> dict[str, int]:
    """Exact distinct counts of the columns that ``distinct_buckets`` leaves, in one pass.

    Equal values meet before the shuffle. Values are compared as text.
    """
    if not values:
        return {}
    rows = df.select(*[v.cast("string").alias(n) for n, v in values.items()])
    counts = (rows.unpivot([], [F.col(f"`{n}`") for n in values], "column", "s")
              .where("s IS NOT NULL").distinct().groupBy("column").agg(F.count(F.lit(1)).alias("n")))
    return {n: 0 for n in values} | {r["column"]: r["n"] for r in counts.collect()}


def classify_values(df: DataFrame, columns: list[str] | None = None,
                    max_categories: int = MAX_CATEGORIES) -> DataFrame:
    """Class of each column by the look of its values; NULL when nothing fits.

    Everything is decided over all rows. Some first rows only disprove shapes, for which one
    counterexample is enough; one aggregate over all rows tests the shapes that are left, and reads
    the longest text and how many of ``HASH_BUCKETS`` hash values occur. More than
    ``max_categories`` of them are more distinct values than that, too; only short texts with fewer
    are counted exactly. They are a category with at most ``max_categories`` distinct values, and at
    most two or 0.4 of the rows.
    """
    names = [n for n in columns or df.columns
             if isinstance(column_type(df, n), T.AtomicType)]
    if not names:
        raise ValueError("at least one column of plain values is needed")
    fractional = (T.FloatType, T.DoubleType, T.DecimalType)
    plain = [n for n in names if isinstance(column_type(df, n), fractional)]
    texts = {n: F.when(ref(df, n).cast("string") != "", ref(df, n).cast("string"))
             for n in names if n not in plain}
    left: dict[str, set[str]] = {}
    if texts:
        probe = df.limit(PROBED).agg(*[F.struct(*[f.alias(c) for c, f in _shape_flags(s).items()])
                                       .alias(f"p{i}") for i, s in enumerate(texts.values())]).first()
        # NULL: no value was filled there, so nothing is disproved
        left = {n: {c for c, held in row.asDict().items() if held is not False}
                for n, row in zip(texts, probe)}
    looks = [F.struct(F.count(ref(df, n)).alias("filled")) for n in plain] + [
        F.struct(F.count(s).alias("filled"), F.max(F.length(s)).alias("longest"),
                 # long texts are no categories, so their hashes are not needed
                 distinct_buckets(F.when(F.length(s) < CATEGORY_LENGTH, F.lower(s))).alias("buckets"),
                 *[f.alias(c) for c, f in _shape_flags(s, left[n]).items()])
        for n, s in texts.items()]
    found = dict(zip(plain + list(texts),
                     (r.asDict() for r in df.agg(*[look.alias(f"c{i}")
                                                   for i, look in enumerate(looks)]).first())))
    shapes = [c for c, _ in VALUE_SHAPES] + ["phone", "boolean", "number"]
    holds = lambda n, c: found[n].get(c) and (c != "phone" or found[n]["plus"])
    classes = {n: "number" for n in plain if found[n]["filled"]}
    classes |= {n: next((c for c in shapes if holds(n, c)), None) for n in texts}
    rest = {n: F.lower(s) for n, s in texts.items()
            if found[n]["filled"] and not classes[n] and found[n]["longest"] < CATEGORY_LENGTH
            and found[n]["buckets"] <= max_categories}
    classes |= {n: "category" for n, k in distinct_counts(df, rest).items()
                if k <= min(max(2, CATEGORY_SHARE * found[n]["filled"]), max_categories)}
    return df.sparkSession.range(1).select(F.inline(F.array(*[
        F.struct(F.lit(n).alias("column"), F.lit(found[n]["filled"]).cast("long").alias("filled_rows"),
                 F.lit(classes.get(n)).cast("string").alias("value_class")) for n in names])))
