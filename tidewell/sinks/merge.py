"""Keyed upsert as joins: no row-level table format is needed.

The batch is usually far smaller than the target. The target is then read once
next to a batch that Catalyst may broadcast (by its measured size), and once
more for its key columns to find which batch rows are new. Neither step needs
the wide target rows to be shuffled.
"""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.casts import column_type, ref


def _null_key(df: DataFrame, keys: list[str]):
    return reduce(or_, [ref(df, k).isNull() for k in keys])


def dedupe_latest(batch: DataFrame, keys: list[str], cursor: str | None = None,
                  fail: bool = False) -> DataFrame:
    """One row per key, the latest by cursor; rows with a NULL key are all kept.

    Equal cursors are settled by a hash of the row, so reruns agree. The
    row-number filter is applied per input partition before the shuffle, so a
    key that fills the batch does not travel as a whole.
    """
    if fail:
        repeated = (batch.where(~_null_key(batch, keys)).groupBy(*keys).count()
                    .where(F.col("count") > 1))
        if not repeated.isEmpty():
            raise ValueError(f"duplicate keys in the batch on {keys}")
        return batch
    order = [F.desc_nulls_last(cursor)] if cursor else []
    order.append(F.xxhash64(*[ref(batch, c) for c in batch.columns]).asc())
    keyed = batch.where(~_null_key(batch, keys))
    ranked = keyed.withColumn("__rn", F.row_number().over(
        Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col("__rn") == 1).drop("__rn").unionByName(
        batch.where(_null_key(batch, keys)))


def merge(target: DataFrame, batch: DataFrame, keys: list[str], cursor: str | None = None,
          fail_on_duplicates: bool = False, deduped: bool = False,
          staging: str | None = None) -> DataFrame:
    """Target after the upsert of a batch.

    ``staging`` is a path to write the batch to, reduced to one row per key: it is then computed once
    and not for updates, matches and inserts anew. ``deduped`` says that it is reduced already.

    Matched rows take the batch's columns, unmatched batch rows are added. Keys
    compare with ``=``, so a NULL key never matches. Columns new in the batch are
    added (NULL in rows it does not touch); columns the batch lacks keep their
    values, or are NULL in added rows.
    """
    if not keys:
        raise ValueError("an upsert needs at least one key column")
    missing = [k for k in keys if k not in batch.columns or k not in target.columns]
    if missing:
        raise ValueError(f"key columns missing: {missing}")
    if not deduped:
        batch = dedupe_latest(batch, keys, cursor, fail_on_duplicates)
    if staging:
        batch.write.parquet(staging)
        batch = batch.sparkSession.read.schema(batch.schema).parquet(staging)
    new = [c for c in batch.columns if c not in target.columns]
    payload = [c for c in batch.columns if c not in keys]

    def landed(name):  # the stored type wins over the batch's type
        c = ref(batch, name)
        return c.cast(column_type(target, name)) if name in target.columns else c

    side = batch.select(
        *[landed(k).alias(f"__k{i}") for i, k in enumerate(keys)],
        F.struct(F.lit(True).alias("__hit"), *[landed(c).alias(c) for c in payload]).alias("__b"))
    on = reduce(and_, [F.col(f"`{k}`") == F.col(f"__k{i}") for i, k in enumerate(keys)])
    hit = F.col("__b").isNotNull()

    def after(name):
        if name in keys or name not in payload:
            return ref(target, name)
        return F.when(hit, F.col("__b").getField(name)).otherwise(ref(target, name)).alias(name)

    def added(name):
        if name in keys:
            return F.col(f"__k{keys.index(name)}").alias(name)
        if name in payload:
            return F.col("__b").getField(name).alias(name)
        return F.lit(None).cast(column_type(target, name)).alias(name)

    keyed = target.where(~_null_key(target, keys))
    updated = keyed.join(side, on, "left").select(
        *[after(c) for c in target.columns], *[F.col("__b").getField(c).alias(c) for c in new])
    unkeyed = target.where(_null_key(target, keys)).select(
        "*", *[F.lit(None).cast(column_type(batch, c)).alias(c) for c in new])
    side_keys = side.select(*[f"__k{i}" for i in range(len(keys))])
    met = keyed.select(*[F.col(f"`{k}`") for k in keys]).join(side_keys, on, "left_semi")
    inserted = side.join(met, on, "left_anti").select(*[added(c) for c in target.columns],
                                                      *[added(c) for c in new])
    return updated.unionByName(unkeyed).unionByName(inserted)


def new_columns(target: DataFrame, batch: DataFrame) -> list[str]:
    return [c for c in batch.columns if c not in target.columns]
