"""Lines that many documents share, as run-length keep bitmaps; DataFrame functions only.

A line's key is the line without blanks at both ends and with A-Z in lower case. Keys long enough
and found in enough documents keep their lines in one document only, that with the largest doc_id.

Occurrences (two 64-bit hashes of the key, document, position) are range-partitioned by hash and
document, so a hash of any size spreads over as many partitions as it needs. Each document's
occurrences of a hash are combined there. The document that keeps a hash is not streamed from the
ranges: an aggregate takes the largest id and the number of ids per hash, which combine before they
are shuffled. Only decisions travel: texts are touched when bitmaps are applied.

Nulls and edges: a null or empty text is one empty line; a null doc_id never is the largest (if all
holders are null, all keep the line) and does not count as a document; rows of one doc_id count as
one document, whatever their texts, and each is cut by itself; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, partitions, stage

BLANKS = " \t\n\x0b\x0c\r"


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _holders(docs: DataFrame, min_chars: int) -> DataFrame:
    """One row per key hash and doc_id: the lines of its texts there, range-partitioned by hash."""
    line = F.btrim("line", F.lit(BLANKS))
    # the hash of the text tells rows of one doc_id apart
    lines = (docs.select("doc_id", F.xxhash64("text").alias("version"),
                         split_lines(F.col("text")).alias("lines"))
             .select("doc_id", "version", F.size("lines").alias("n_lines"),
                     F.posexplode("lines").alias("pos", "line"))
             .where(F.length(line) >= min_chars)
             .select("doc_id", "version", "n_lines", "pos", ascii_lower(line).alias("key"))
             .select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"),
                     "doc_id", "version", "n_lines", "pos"))
    # written first, so that sampling the ranges does not split every text again
    found = stage(lines, "line-hashes")
    ranged = found.repartitionByRange(partitions(docs.sparkSession), "h1", "h2",
                                      F.col("doc_id").desc_nulls_last())
    return ranged.groupBy("h1", "h2", "doc_id").agg(
        F.collect_set(F.struct("version", "n_lines", "pos")).alias("lines"))


def line_bitmaps(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """doc_id, version, n_lines, n_dropped, keep of the documents that lose lines.

    ``keep`` is the bitmap of kept lines in run-length form: (start, length) of each run of ones.
    """
    holders = stage(_holders(docs, min_chars), "line-holders")
    shared = stage(holders.groupBy("h1", "h2")
                   .agg(F.count("doc_id").alias("docs"), F.max("doc_id").alias("last"))
                   .where((F.col("docs") >= min_docs) & F.col("last").isNotNull())
                   .select("h1", "h2", "last"), "shared-lines")
    lost = (holders.join(shared, ["h1", "h2"])
            .where(F.col("doc_id").isNull() | (F.col("doc_id") < F.col("last")))
            .select("doc_id", F.inline("lines"))
            .groupBy("doc_id", "version", "n_lines")
            .agg(F.array_sort(F.collect_list("pos")).alias("lost")))
    bounds = F.concat(F.array(F.lit(-1)), "lost", F.array("n_lines"))
    runs = F.transform(
        F.sequence(F.lit(0), F.size("lost")),
        lambda i: F.struct((F.get("bounds", i) + 1).alias("start"),
                           (F.get("bounds", i + 1) - F.get("bounds", i) - 1).alias("length")))
    return lost.withColumn("bounds", bounds).select(
        "doc_id", "version", "n_lines", F.size("lost").alias("n_dropped"),
        F.filter(runs, lambda r: r["length"] > 0).alias("keep"))


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """``docs`` with kept lines as ``text``, and the columns n_lines and n_dropped."""
    own = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    # own columns travel in a struct, so that no name can clash
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("row"),
                    F.xxhash64("text").alias("v"))
    b = bitmaps.select(F.col("doc_id").alias("of"), F.col("version").alias("of_v"),
                       F.col("n_dropped").alias("lost"), F.col("keep").alias("runs"))
    lines = split_lines(F.col("row.text"))
    joined = d.join(b, F.col("row.doc_id").eqNullSafe(F.col("of"))
                    & F.col("v").eqNullSafe(F.col("of_v")), "left")
    kept = F.array_join(F.flatten(F.transform(
        "runs", lambda r: F.slice(lines, r["start"] + 1, r["length"]))), "\n")
    text = F.when(F.col("runs").isNull(), F.col("row.text")).otherwise(kept)
    return joined.select(
        *[text.alias("text") if c == "text" else F.col("row")[c].alias(c) for c in own],
        F.size(lines).cast("long").alias("n_lines"),
        F.coalesce("lost", F.lit(0)).cast("long").alias("n_dropped"))


def drop_shared_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    return apply_bitmaps(docs, line_bitmaps(docs, min_chars, min_docs))
