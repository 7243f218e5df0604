"""Near duplicates: MinHash bands, odd sketches, exact confirmation, connected components.

A document is the set of its two-word shingles. Equal sets collapse to one node first, so copies
cost one row each. A node has ``BANDS`` x ``ROWS`` MinHash samples, and bands of ``ROWS`` samples name
its buckets. ``BINS`` further samples, of one permutation, are folded into an odd sketch, a parity
bitmap. The population count of the exclusive-or of two sketches tells how many samples differ,
precisely at high similarities, and drops candidates that cannot be similar enough. The others are
confirmed on full sets.

Nobody emits all pairs of a bucket. First every member meets the smallest member of each of its
buckets only. Components of the confirmed links come next, and then, in buckets that still hold more
than one component, members outside the largest one meet the members of other components: both are
dealt over blocks of bounded size, and each pair of blocks is a group of its own; sketches leave only
pairs that may be similar. After that no bucket holds an unchecked pair of different components. A
pair of similarity 0.8 shares no bucket with a probability of about 1e-7.

Nulls and edges: a null or blank text has no shingles and is linked with nothing; a row without an
id keeps a null component and is kept; rows of one doc_id with different texts share that id and so
their component; repeated rows are copies; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLANK_TABLE, kept, stage

BANDS, ROWS = 40, 5
BINS, SKETCH_BITS = 4096, 4096
SIMILAR = 80                # percent
DEVIATIONS = 5              # that sketches may be off before a pair is dropped, or sure
SMALL = 4_000_000           # ids, 32 MB
WORDS = 100_000             # hashes of short words that a worker keeps
BLOCK = 1024                # members of a bucket in a block, two of which make a group
SAMPLES = BANDS * ROWS
SIGNATURE = ("doc_id long, version long, n_shingles long, node binary, bands array<long>, sketch array<long>")

_seeds = np.random.Generator(np.random.PCG64(20240131))
MULTIPLY = _seeds.integers(1, 1 << 63, SAMPLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SALT = np.uint64(0x5851F42D4C957F2D)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (the finaliser of a splitmix generator)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the two-word shingles of a whole text."""
    words = (text or "").encode().translate(BLANK_TABLE).split()
    if not words:
        return np.zeros(0, np.uint64)
    known = kept("word-hashes", dict)
    hashes = list(map(known.get, words))
    if None in hashes:
        for i, h in enumerate(hashes):
            if h is None:
                hashes[i] = xxhash.xxh3_64_intdigest(words[i])
                if len(known) < WORDS and len(words[i]) <= 64:
                    known[words[i]] = hashes[i]
    h = np.array(hashes, np.uint64)
    if len(h) == 1:
        return mix(h)
    return np.unique(mix(mix(h[:-1]) + h[1:]))


def minhashes(s: np.ndarray) -> np.ndarray:
    """``SAMPLES`` MinHash values of a set, in parts of bounded size."""
    least = np.full(SAMPLES, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(s), 512):
        np.minimum(least, (s[k:k + 512, None] * MULTIPLY).min(0), out=least)
    return least


def band_keys(samples: np.ndarray) -> np.ndarray:
    """One 64-bit bucket per band."""
    key = np.arange(BANDS, dtype=np.uint64) + np.uint64(1)
    for column in mix(samples).reshape(BANDS, ROWS).T:
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + column)
    return key.view(np.int64)


def odd_sketch(s: np.ndarray) -> np.ndarray:
    """Parity of how many samples fall on each bit, as 64-bit words.

    The samples are the smallest values in ``BINS`` bins of one permutation, so that a small set is
    sampled whole and a large one often enough for a precise estimate.
    """
    values = mix(s ^ SALT)
    least = np.full(BINS, np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(least, (values % np.uint64(BINS)).astype(np.int64), values)
    samples = least[least < np.iinfo(np.uint64).max]
    place = (mix(samples) % np.uint64(SKETCH_BITS)).astype(np.int64)
    bits = (np.bincount(place, minlength=SKETCH_BITS) & 1).astype(np.uint8)
    return np.packbits(bits).view(np.int64)


def differing_bits(total, deviations: float, f=np, similarity: float = SIMILAR / 100):
    """Population count to expect of two sets with ``total`` elements together, at a similarity.

    ``deviations`` above or below the mean; ``f`` is numpy, or the functions of Spark columns.
    """
    union = total / (1 + similarity)
    used = BINS * (1 - f.exp(-union / BINS))                 # bins with an element of the union
    unlike = (1 - similarity) * used                         # whose smallest is not common
    drawn = (union - used) / union                           # 0 if every element is a sample
    variance = similarity * unlike * drawn
    # in a bin with different samples the other set toggles a bit, too, if it has any element there
    both = 1 - f.exp(-union / BINS * (1 + similarity) / 2)
    toggles = unlike * (1 + both)
    variance = variance * (1 + both) ** 2 + unlike * both * (1 - both)
    # toggles that meet on one bit cancel each other
    mean = SKETCH_BITS / 2 * (1 - f.exp(-2 * toggles / SKETCH_BITS))
    variance = variance + 2 * toggles ** 2 / SKETCH_BITS
    return mean + deviations * (f.sqrt(variance) + 0.6)


def signatures(docs: DataFrame) -> DataFrame:
    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, nodes, bands, sketches = [], [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                s = shingles(text)
                sizes.append(len(s))
                if not len(s) or doc_id is None:
                    nodes.append(None)
                    bands.append(None)
                    sketches.append(None)
                    continue
                samples = minhashes(s)
                nodes.append(xxhash.xxh3_128_digest(s.tobytes()))
                bands.append(band_keys(samples))
                sketches.append(odd_sketch(s))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()),
                 pa.array(nodes, pa.binary()),
                 pa.array(bands, pa.list_(pa.int64())), pa.array(sketches, pa.list_(pa.int64()))],
                names=["doc_id", "version", "n_shingles", "node", "bands", "sketch"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.xxhash64("text").alias("version"), "text").mapInArrow(signed, SIGNATURE)


def similar_enough(a_size, b_size, a_sketch, b_sketch):
    """Whether two nodes may be similar, by their sizes and the distance of their sketches."""
    differ = F.aggregate(F.zip_with(a_sketch, b_sketch,
                                    lambda x, y: F.bit_count(x.bitwiseXOR(y))),
                         F.lit(0), lambda total, n: total + n)
    return ((100 * F.least(a_size, b_size) >= SIMILAR * F.greatest(a_size, b_size))
            & (differ <= differing_bits(a_size + b_size, DEVIATIONS, F)))


def _texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """doc_id and text of the documents in ``ids`` (staged, distinct), written once.

    Up to ``SMALL`` ids are sent to all tasks, so that texts stay where they are; beyond that both
    sides are shuffled.
    """
    if ids.count() <= SMALL:
        ids = F.broadcast(ids)
    return stage(docs.select("doc_id", "text").join(ids, "doc_id", "left_semi"), "candidate-texts")


def confirm(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    ids = stage(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct(),
                "candidate-ids")
    texts = _texts_of(docs, ids)
    with_texts = (pairs.select("a", "b")
                  .join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("s")), "a")
                  .join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("t")), "b"))

    def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, np.ndarray] = {}
        for batch in batches:
            keep = []
            for s, t in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                x = shingles(s)
                y = known.get(t)
                if y is None:
                    y = shingles(t)
                    if len(known) >= 64:
                        known.clear()
                    known[t] = y
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * common >= SIMILAR * (len(x) + len(y) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return stage(with_texts.select("a", "b", "s", "t").mapInArrow(similar, "a long, b long"),
                 "similar-pairs")


def components(edges: DataFrame) -> DataFrame:
    """id and the smallest id reachable from it, by smallest neighbours and pointer jumping."""
    both = stage(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "links")
    labels = stage(both.groupBy(F.col("a").alias("id"))
                   .agg(F.least(F.col("id"), F.min("b")).alias("label")), "labels")
    while True:
        near = stage(both.join(labels.select(F.col("id").alias("b"), "label"), "b")
                     .groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
                     .join(labels, "id")
                     .select("id", "label", F.least("near", "label").alias("near")), "labels")
        jumped = stage(near.join(near.select(F.col("id").alias("near"),
                                             F.col("near").alias("next")), "near")
                       .select("id", F.col("label").alias("old"),
                               F.least("near", "next").alias("label")), "labels")
        if not jumped.where("old <> label").limit(1).count():
            return labels
        labels = jumped.select("id", "label")


def _met(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) that sizes and sketches do not rule out, staged."""
    def side(name: str) -> DataFrame:
        return nodes.select(F.col("rep").alias(name), F.col("n_shingles").alias(f"{name}_n"),
                            F.col("sketch").alias(f"{name}_sketch"))

    both = pairs.join(side("a"), "a").join(side("b"), "b")
    return stage(both.where(similar_enough(F.col("a_n"), F.col("b_n"), F.col("a_sketch"),
                                           F.col("b_sketch"))).select("a", "b"), "candidates")


def _near(i: int, group: dict[str, np.ndarray], key: tuple) -> np.ndarray:
    """Members of other components that may be similar to member ``i`` of the lower block and meet it
    here first."""
    rep, label, size, own = (group[c] for c in ("rep", "label", "n_shingles", "own"))
    bucket, low, high = (k.as_py() for k in key)
    other = (label != label[i]) & (own == high)
    if low == high:
        other &= rep > rep[i]
    other &= 100 * np.minimum(size, size[i]) >= SIMILAR * np.maximum(size, size[i])
    js = np.flatnonzero(other)
    differ = np.bitwise_count(group["sketch"][js] ^ group["sketch"][i]).sum(1)
    js = js[differ <= differing_bits((size[js] + size[i]).astype(float), DEVIATIONS)]
    # an earlier band with equal keys has brought both together already
    band = int(np.argmax(group["bands"][i] == bucket))
    return js[~(group["bands"][js, :band] == group["bands"][i, :band]).any(1)]


def _columns(group: pa.Table) -> dict[str, np.ndarray]:
    out = {c: group[c].to_numpy(zero_copy_only=False)
           for c in ("rep", "label", "n_shingles", "own")}
    for c in ("bands", "sketch"):
        out[c] = np.array(group[c].to_pylist(), np.int64).reshape(len(group), -1)
    # unsigned, since numpy counts the bits of absolute values
    out["sketch"] = out["sketch"].view(np.uint64)
    return out


MEMBER = ("bucket long, low int, high int, own int, rep long, label long, n_shingles long, "
          "bands array<long>, sketch array<long>")


def _dealt(member: DataFrame) -> DataFrame:
    """bucket, low, high, own, rep, label: the members of mixed buckets in all groups they belong to.

    A group is a pair of blocks (low, high) of a bucket. The first blocks hold members outside the
    largest component and meet all blocks, also themselves; the others hold members of the largest
    one and do not meet each other. So no group has more than two blocks, of about ``BLOCK`` each.
    """
    counts = member.groupBy("bucket", "label").agg(F.count("*").alias("n"))
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    mixed = stage(counts.groupBy("bucket").agg(
        F.count("*").alias("labels"), F.max_by("label", "n").alias("main"),
        blocks(F.sum("n") - F.max("n")).alias("outer"), blocks(F.max("n")).alias("inner"))
        .where("labels > 1").select("bucket", "main", "outer", "inner"), "mixed-buckets")
    outside = F.col("label") != F.col("main")
    own = F.when(outside, F.pmod(F.xxhash64("rep"), F.col("outer"))).otherwise(
        F.col("outer") + F.pmod(F.xxhash64("rep"), F.col("inner"))).cast("int")
    met = F.sequence(F.lit(0), F.when(outside, F.col("outer") + F.col("inner"))
                     .otherwise(F.col("outer")) - 1)
    return (member.join(mixed, "bucket").withColumn("own", own)
            .select("bucket", "rep", "label", "own", F.explode(met).alias("met"))
            .select("bucket", F.least("own", "met").alias("low"),
                    F.greatest("own", "met").alias("high"), "own", "rep", "label"))


def _late_links(members: DataFrame, leaders: DataFrame, labels: DataFrame, nodes: DataFrame,
                docs: DataFrame) -> DataFrame:
    """Links between different components that share a bucket, confirmed on full sets.

    Sketches first pick the members that may have such a link; only these bring their texts. A
    bucket returns a link or none for two components, never its pairs.
    """
    member = (members.join(leaders, "bucket").where("n > 2 AND rep <> leader")
              .join(labels.select(F.col("id").alias("rep"), "label"), "rep", "left")
              .select("bucket", "rep", F.coalesce("label", "rep").alias("label")))
    member = stage(member, "bucket-members")
    dealt = (_dealt(member).join(nodes.select("rep", "n_shingles", "bands", "sketch"), "rep")
             .select([c.split()[0] for c in MEMBER.split(", ")]))

    def pick(key: tuple, rows: pa.Table) -> pa.Table:
        group, chosen = _columns(rows), np.zeros(len(rows), bool)
        for i in np.flatnonzero(group["own"] == key[1].as_py()):
            js = _near(i, group, key)
            chosen[js] = True
            chosen[i] |= bool(len(js))
        return rows.filter(pa.array(chosen))

    picked = stage(dealt.groupBy("bucket", "low", "high").applyInArrow(pick, MEMBER), "picked-members")
    ids = stage(picked.select(F.col("rep").alias("doc_id")).distinct(), "picked-ids")
    texts = _texts_of(docs, ids).withColumnRenamed("doc_id", "rep")

    def meet(key: tuple, rows: pa.Table) -> pa.Table:
        group, sets = _columns(rows), [shingles(t) for t in rows["text"].to_pylist()]
        label, rep, linked, found = group["label"], group["rep"], set(), []
        for i in np.flatnonzero(group["own"] == key[1].as_py()):
            for j in _near(i, group, key).tolist():
                pair = (min(label[i], label[j]), max(label[i], label[j]))
                if pair in linked:
                    continue
                common = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if 100 * common >= SIMILAR * (len(sets[i]) + len(sets[j]) - common):
                    linked.add(pair)
                    found.append((int(rep[i]), int(rep[j])))
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()),
                         "b": pa.array([b for _, b in found], pa.int64())})

    return stage(picked.join(texts, "rep").groupBy("bucket", "low", "high")
                 .applyInArrow(meet, "a long, b long").distinct(), "late-links")


def linked(docs: DataFrame) -> DataFrame:
    """doc_id, version (of the text), n_shingles, component of every row; null without shingles."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = stage(signatures(docs), "signatures")
    nodes = stage(signed.where("node IS NOT NULL").groupBy("node").agg(
        F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"),
        F.first("bands").alias("bands"), F.first("sketch").alias("sketch")), "nodes")
    members = nodes.select("rep", F.explode("bands").alias("bucket"))
    leaders = stage(members.groupBy("bucket").agg(F.min("rep").alias("leader"),
                                                  F.count("*").alias("n")).where("n > 1"),
                    "bucket-leaders")
    first = _met(nodes, members.join(leaders.select("bucket", "leader"), "bucket")
                 .where("rep <> leader").select(F.col("rep").alias("a"), F.col("leader").alias("b"))
                 .distinct())
    edges = confirm(first, docs)
    labels = components(edges)
    late = _late_links(members, leaders, labels, nodes, docs)
    if late.limit(1).count():
        labels = components(edges.union(late))
    found = stage(nodes.select("node", "rep").join(
        labels.select(F.col("id").alias("rep"), "label"), "rep", "left")
        .select("node", F.coalesce("label", "rep").alias("label")), "components")
    return (signed.select("doc_id", "version", "n_shingles", "node").join(found, "node", "left")
            .select("doc_id", "version", "n_shingles", F.col("label").alias("component")))


def link(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document."""
    component = F.coalesce("component", "doc_id")
    return linked(docs).select(
        "doc_id", "n_shingles", component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component: that with the smallest id, and of its rows one.

    Rows are judged by themselves: another text under the id of a copy stays, and of equal rows one
    does. Rows without an id or without words always stay. If any id has several texts, rows go by a
    64-bit hash of id and text in place of the id.
    """
    version = F.xxhash64("text").alias("version")
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), version).where("doc_id IS NOT NULL")
    several = (ids.groupBy("doc_id").agg(F.min("version").alias("a"), F.max("version").alias("b"))
               .where("a <> b").limit(1).count())
    if several:
        key = F.xxhash64("doc_id", "version")
        keyed = docs.where("doc_id IS NOT NULL").select("doc_id", version, "text").select(
            key.alias("doc_id"), "text")
        row = (ids.withColumn("key", key).join(
            linked(keyed).where("component IS NOT NULL")
            .select(F.col("doc_id").alias("key"), "component").distinct(), "key").drop("key"))
    else:
        row = linked(docs).where("component IS NOT NULL")
    row = stage(row.select("doc_id", "version", "component"), "linked-rows")
    first = row.groupBy("component").agg(F.min(F.struct("doc_id", "version")).alias("first"))
    gone = (row.join(first, "component")
            .where(F.struct("doc_id", "version") != F.col("first"))
            .select(F.col("doc_id").alias("_id"), F.col("version").alias("_version")).distinct())
    twice = (row.groupBy("doc_id", "version").count().where("count > 1")
             .select(F.col("doc_id").alias("_id"), F.col("version").alias("_version")))
    same = (F.col("doc_id") == F.col("_id")) & (F.xxhash64("text") == F.col("_version"))
    left = docs.join(gone, same, "left_anti")
    # equal rows are few as a rule; they combine before they are shuffled
    once = left.join(twice, same, "left_semi").dropDuplicates(["doc_id", "text"])
    return left.join(twice, same, "left_anti").unionByName(once)
