"""Keyed tables in hash buckets, of which an upsert rewrites the touched ones only.

A table is a set of versions, folders partitioned by bucket. Every bucket of keys is live in one
version. An upsert reads the buckets that its batch touches, writes their new rows as a new version,
and then replaces the view over the live buckets. That is one step of the catalog, so a reader sees
either all of an upsert or none, and a crash before it leaves unused files only. Old versions stay
for the caller's retention job.

Which version holds a bucket, and with how many rows, is written beside the data; the view names
that file in its properties. Rows without a key match nothing, so any bucket can hold them: an upsert
deals them by a hash of their values over the buckets that it writes anyway.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.casts import column_type, ref
from ..functions.text import safe_name
from .merge import dedupe_latest, merge, new_columns
from .tables import counted_write, current

BUCKETS = 64                # that a table begins with at most, and
ROWS = 100_000              # rows of each then, at least
BUCKET = "__bucket"
MAX_VERSIONS = 32           # live versions, beyond which the smallest are rewritten too
FULL_BUCKET = 1_000_000     # rows of a bucket on average, beyond which a table gets four times as many
MANIFEST = "tidewell.manifest"


@dataclass(frozen=True)
class Merged:
    """What an upsert wrote and left."""

    batch_rows: int
    rows_written: int
    buckets_written: int
    target_rows: int
    columns_added: tuple[str, ...] = ()


@dataclass
class Layout:
    """Live buckets of a table: bucket to (version folder, rows)."""

    keys: list[str]
    n: int
    schema: T.StructType
    live: dict[int, tuple[str, int]] = field(default_factory=dict)
    columns: dict[str, list[str]] = field(default_factory=dict)     # that a version has

    def versions(self) -> dict[str, list[int]]:
        out: dict[str, list[int]] = {}
        for bucket, (path, _) in self.live.items():
            out.setdefault(path, []).append(bucket)
        return out

    def rows(self, buckets=None) -> int:
        return sum(n for b, (_, n) in self.live.items() if buckets is None or b in buckets)

    def read(self, spark: SparkSession, buckets=None) -> DataFrame:
        """Rows of some buckets (all by default)."""
        out = spark.createDataFrame([], self.schema)
        schema = T.StructType([*self.schema.fields, T.StructField(BUCKET, T.IntegerType())])
        for path, own in self.versions().items():
            wanted = sorted(own if buckets is None else set(own) & set(buckets))
            if wanted:
                out = out.unionByName(spark.read.schema(schema).parquet(path)
                                      .where(F.col(BUCKET).isin(wanted)).drop(BUCKET))
        return out

    def text(self) -> str:
        return json.dumps({"keys": self.keys, "n": self.n, "schema": self.schema.json(),
                           "live": {str(b): v for b, v in self.live.items()},
                           "columns": self.columns})

    @staticmethod
    def of(text: str) -> Layout:
        raw = json.loads(text)
        return Layout(raw["keys"], raw["n"], T.StructType.fromJson(json.loads(raw["schema"])),
                      {int(b): tuple(v) for b, v in raw["live"].items()}, raw["columns"])


def bucket_of(df: DataFrame, keys: list[str], n: int, types: T.StructType,
              unkeyed: list[int] | None = None) -> Column:
    """Bucket of each row, by its keys as the table stores them; one of ``unkeyed`` without keys."""
    parts = [ref(df, k).cast(types[k].dataType) for k in keys]
    null = reduce(or_, [p.isNull() for p in parts])
    own = F.xxhash64(*[ref(df, c) for c in df.columns if not isinstance(
        column_type(df, c), T.MapType)])
    among = sorted(unkeyed or range(n))
    other = F.get(F.lit(among), F.pmod(own, F.lit(len(among))).cast("int"))
    return F.when(null, other).otherwise(F.pmod(F.xxhash64(*parts), F.lit(n))).cast("int")


def layout(spark: SparkSession, table: str) -> Layout | None:
    """How a bucketed table lies on disk; None for any other table."""
    name = safe_name(table)
    if not spark.catalog.tableExists(name):
        return None
    found = {r["key"]: r["value"] for r in spark.sql(f"SHOW TBLPROPERTIES `{name}`").collect()}
    path = found.get(MANIFEST)
    return Layout.of(spark.read.text(path, wholetext=True).first()[0]) if path else None


def publish(spark: SparkSession, table: str, root: str, new: Layout) -> None:
    """Write the layout and point the view at its live buckets."""
    name = safe_name(table)
    path = f"{root.rstrip('/')}/{name}/layouts/{uuid.uuid4().hex}"
    spark.createDataFrame([(new.text(),)], "value string").coalesce(1).write.text(path)
    parts = []
    for version, buckets in sorted(new.versions().items()):
        own = set(new.columns[version])
        chosen = ", ".join(f"`{f.name}`" if f.name in own else
                           f"CAST(NULL AS {f.dataType.simpleString()}) AS `{f.name}`"
                           for f in new.schema.fields)
        parts.append(f"SELECT {chosen} FROM parquet.`{version}` "
                     f"WHERE `{BUCKET}` IN ({', '.join(map(str, sorted(buckets)))})")
    nothing = ", ".join(f"CAST(NULL AS {f.dataType.simpleString()}) AS `{f.name}`"
                        for f in new.schema.fields)
    body = " UNION ALL ".join(parts) or f"SELECT {nothing} WHERE false"
    spark.sql(f"CREATE OR REPLACE VIEW `{name}` TBLPROPERTIES ('{MANIFEST}' = '{path}') AS {body}")


def _folded(now: Layout, touched: set[int]) -> set[int]:
    """``touched`` and the buckets of the smallest versions, so that few versions stay live."""
    left = {v: set(b) - touched for v, b in now.versions().items()}
    left = {v: b for v, b in left.items() if b}
    for version in sorted(left, key=lambda v: now.rows(left[v])):
        if len(left) < MAX_VERSIONS:
            break
        touched = touched | left.pop(version)
    return touched


def _write(spark: SparkSession, rows: DataFrame, new: Layout, path: str,
           touched: set[int]) -> dict[int, int]:
    """Write rows by bucket; rows found in each."""
    bucketed = rows.withColumn(BUCKET, bucket_of(rows, new.keys, new.n, new.schema, list(touched)))
    written = counted_write(bucketed.repartition(len(touched) or new.n, BUCKET), path,
                            partition_by=BUCKET)
    schema = T.StructType([*new.schema.fields, T.StructField(BUCKET, T.IntegerType())])
    found = {r[BUCKET]: r["count"] for r in
             spark.read.schema(schema).parquet(path).groupBy(BUCKET).count().collect()}
    if sum(found.values()) != written:
        raise RuntimeError(f"wrote {written} rows but {path} holds {sum(found.values())}")
    return found


def merge_into(batch: DataFrame, table: str, keys: list[str], root: str,
               cursor: str | None = None, buckets: int | None = None,
               full_bucket: int = FULL_BUCKET) -> Merged:
    """Upsert ``batch`` into a bucketed table, which is made on first use (or from a plain one).

    The batch is reduced to one row per key and written once; the merge reads it from there.
    """
    spark, name = batch.sparkSession, safe_name(table)
    if not keys:
        raise ValueError("an upsert needs at least one key column")
    base = f"{root.rstrip('/')}/{name}"
    staged = f"{base}/staging/{uuid.uuid4().hex}"
    n_batch = counted_write(dedupe_latest(batch, keys, cursor), staged)
    batch = spark.read.schema(batch.schema).parquet(staged)
    now, plain = layout(spark, table), None
    if now is None:
        plain = current(spark, table)
        first = n_batch + (0 if plain is None else plain.count())
        now = Layout(list(keys), buckets or min(BUCKETS, 1 + first // ROWS),
                     (batch if plain is None else plain).schema)
    elif now.keys != list(keys):
        raise ValueError(f"{name} is kept by {now.keys}, not by {list(keys)}")
    if n_batch == 0 and now.live:
        return Merged(0, 0, 0, now.rows())
    if plain is not None:                   # a table of another kind is taken over whole
        touched, target = set(), plain
    else:
        touched = {r[0] for r in batch.select(bucket_of(batch, keys, now.n, now.schema))
                   .distinct().collect()}     # at most one per bucket
        touched = _folded(now, touched)
        target = now.read(spark, touched)
    added = tuple(new_columns(target, batch))
    schema = T.StructType([*now.schema.fields, *[
        T.StructField(c, column_type(batch, c)) for c in added]])
    new = Layout(now.keys, now.n, schema, dict(now.live), dict(now.columns))
    if plain is None and now.rows() + n_batch > full_bucket * now.n:
        new.n, new.live, target, touched = 4 * now.n, {}, now.read(spark), set()
    path = f"{base}/versions/{uuid.uuid4().hex}"
    # already one row per key
    found = _write(spark, merge(target, batch, list(keys), deduped=True), new, path, touched)
    new.live = {b: v for b, v in new.live.items() if b not in touched}
    new.live |= {b: (path, n) for b, n in found.items()}
    new.columns[path] = schema.names
    new.columns = {v: c for v, c in new.columns.items() if v in new.versions()}
    publish(spark, table, root, new)
    return Merged(n_batch, sum(found.values()), len(found), new.rows(), added)
