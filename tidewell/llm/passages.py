"""Passages that occur earlier too, found by windows of words dealt as super-k-mers.

A window is ``WINDOW`` consecutive words of one document. Its minimiser is the run of ``SHORT`` words
in it with the smallest hash (the leftmost of equals). Consecutive windows with one minimiser form
a super-k-mer: their words travel once, as one packed string, to the bucket of the minimiser, and
equal windows meet there. A bucket sorts its windows by a 64-bit key of their words and compares
neighbours of equal key word by word, so that counts are exact. Of equal windows the one with the
smallest (doc_id, start) is the first; every word that another one covers is removed.

Signatures go first. Equal windows agree in the words around the minimiser, at least on one side of
it in half of the other words. So each super-k-mer first sends 32-bit hashes of both sides to its
bucket, and only those that share one with another super-k-mer there send their words. A text is
shuffled once, for the words it sends and for the cut at the end (the plan reuses the exchange).

Hot runs of words. A first pass counts all runs of ``SHORT`` words: those that hold more than a share
of all become the last choice as minimisers, so windows that merely touch a common passage go by
their other words. Windows within a common passage only are equal to each other, and tasks keep
one of those before they send anything. A run of words in the list has at least its share of all,
so the list that is sent to tasks has at most ``HOT`` entries per bucket (of 8 bytes), and no other
run is more than a fraction of a bucket.

Nulls and edges: a null text has no words; a null doc_id counts as the smallest long; rows with one
doc_id are told apart by a hash of the text, windows at one start of equal rows are both first; texts
below ``WINDOW`` words keep all; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, stage
from .near_dup import mix

WINDOW, SHORT = 20, 4
CHUNK = 1_000_000           # words that a task looks at together
BUCKET = 2_000_000          # words in a bucket, on average
HOT = 36                    # times as many runs of SHORT words as buckets may be hot
NULL_ID = -(1 << 63)
ODD = np.uint64(0x9E3779B97F4A7C15)
RANGES = "doc_id long, version long, start long, length long"
SETTLED = -1                # bucket of ranges that need no further look


def rolling(items: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit key for every ``n`` consecutive 64-bit items."""
    total, out, done, size = len(items) - n + 1, None, 0, 1
    if total <= 0:
        return np.zeros(0, np.uint64)
    power = items
    while True:
        if n & size:
            part = power[done:done + total]
            out = part if out is None else mix(out * ODD + part)
            done += size
        size *= 2
        if size > n:
            return out
        power = mix(power[:-(size // 2)] * ODD + power[size // 2:])


def leftmost_least(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the smallest of every ``width`` consecutive values; of equals, the leftmost."""
    best, place, span = values, np.arange(len(values)), 1
    while span < width:
        step = min(span, width - span)
        right = best[step:] < best[:-step]
        best = np.where(right, best[step:], best[:-step])
        place = np.where(right, place[step:], place[:-step])
        span += step
    return place


def spread(begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """All places of the ranges, one range after the other."""
    ends = np.cumsum(length)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin - ends + length, length)


def repeated(words: np.ndarray, at: np.ndarray, rank: np.ndarray, n: int) -> np.ndarray:
    """Which of the windows that start ``at`` equal one of smaller rank."""
    keys = rolling(mix(words.astype(np.uint64) + np.uint64(1)), n)[at]
    order = np.argsort(keys, kind="stable")
    follows = np.flatnonzero(keys[order[1:]] == keys[order[:-1]]) + 1
    equal = np.ones(len(follows), bool)
    a, b = at[order[follows]], at[order[follows - 1]]
    for k in range(n):
        equal &= words[a + k] == words[b + k]
    if not equal.all():     # two sequences under one key: order these windows by their words
        clash = np.isin(keys, keys[order[follows[~equal]]])
        mixed = np.flatnonzero(clash[order])
        rows = order[mixed]
        order[mixed] = rows[np.lexsort([words[at[rows] + k] for k in reversed(range(n))]
                                       + [keys[rows]])]
        a, b = at[order[1:]], at[order[:-1]]
        same = keys[order[1:]] == keys[order[:-1]]
        for k in range(n):
            same &= words[a + k] == words[b + k]
    else:
        same = np.zeros(max(len(order) - 1, 0), bool)
        same[follows - 1] = True
    group = np.concatenate([[0], np.cumsum(~same)]) if len(order) else order
    least = np.full(group[-1] + 1 if len(group) else 0, np.iinfo(np.int64).max)
    np.minimum.at(least, group, rank[order])
    out = np.zeros(len(at), bool)
    out[order] = rank[order] > least[group]
    return out


def runs_of(places: np.ndarray, *same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end (excluded) of stretches of consecutive places with equal companions."""
    if not len(places):
        return places, places
    new = np.diff(places) != 1
    for s in same:
        new |= s[1:] != s[:-1]
    cut = np.flatnonzero(new) + 1
    return np.concatenate([[0], cut]), np.concatenate([cut, [len(places)]])


class Vocabulary(dict):
    """Numbers of words, in the order of their first use."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


class Chunk:
    """Words of some documents as numbers, one document after the other."""

    def __init__(self):
        self.vocabulary, self.parts, self.docs, self.n = Vocabulary(), [], [], 0

    def add(self, doc_id: int | None, version: int, text: str | None) -> None:
        words = (text or "").encode().split()
        if words:
            self.docs.append((NULL_ID if doc_id is None else doc_id, version, len(words)))
            self.parts.append(np.fromiter(map(self.vocabulary.__getitem__, words), np.int32,
                                          len(words)))
            self.n += len(words)

    def close(self, window: int) -> None:
        """Arrays of all that was added: ``words``, ``doc`` of each, and ``at``, where windows start."""
        empty = np.zeros(0, np.int32)
        self.words = np.concatenate([empty, *self.parts])
        self.parts = []
        self.doc_ids, self.versions, sizes = (
            np.array([d[i] for d in self.docs], np.int64) for i in range(3))
        self.first = np.cumsum(sizes) - sizes            # place of each document's first word
        self.doc = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        self.at = np.flatnonzero(self.doc[:max(len(self.doc) - window + 1, 0)]
                                 == self.doc[window - 1:])

    def start(self, places: np.ndarray) -> np.ndarray:
        """Place of words in their documents."""
        return places - self.first[self.doc[places]]

    def hashes(self) -> np.ndarray:
        """A hash of every word, the same in all tasks."""
        return np.fromiter(map(xxhash.xxh3_64_intdigest, self.vocabulary), np.uint64,
                           len(self.vocabulary))[self.words]


def chunks(batches: Iterator[pa.RecordBatch], window: int, size: int = CHUNK) -> Iterator[Chunk]:
    """Documents in chunks of about ``size`` words."""
    chunk = Chunk()
    for batch in batches:
        for doc in zip(*(c.to_pylist() for c in batch.columns)):
            chunk.add(*doc)
            if chunk.n >= size:
                chunk.close(window)
                yield chunk
                chunk = Chunk()
    if chunk.n:
        chunk.close(window)
        yield chunk


def pack(arrays: list[np.ndarray], names: bytes = b"") -> bytes:
    """Arrays and names as one compressed string."""
    head = ",".join(f"{a.dtype.str}{len(a)}" for a in arrays).encode()
    return zstandard.compress(b"".join([len(head).to_bytes(4, "little"), head,
                                        *(a.tobytes() for a in arrays), names]), 1)


def unpack(data: bytes) -> tuple[list[np.ndarray], list[bytes]]:
    data = zstandard.decompress(data)
    at = 4 + int.from_bytes(data[:4], "little")
    arrays = []
    for kind in data[4:at].decode().split(","):
        arrays.append(np.frombuffer(data, kind[:3], int(kind[3:]), at))
        at += arrays[-1].nbytes
    return arrays, data[at:].split()


def owners(chunk: Chunk, *docs: np.ndarray) -> list[np.ndarray]:
    """ids and versions of the documents used in ``docs``, and ``docs`` as places among them."""
    held = np.zeros(len(chunk.doc_ids), bool)
    for d in docs:
        held[d] = True
    place = np.cumsum(held, dtype=np.int32) - 1
    return [chunk.doc_ids[held], chunk.versions[held], *(place[d].astype("<u4") for d in docs)]


def by_value(values: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each distinct value with its places."""
    order = np.argsort(values, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(values[order])) + 1):
        if len(part):
            yield int(values[part[0]]), part


def blobs(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([k for k, _ in rows], pa.int32()), pa.array([p for _, p in rows], pa.binary())],
        names=["bucket", "packed"])


BLOB = "bucket int, packed binary"


def hot_runs(docs: DataFrame, share: float, window: int, short: int) -> np.ndarray:
    """Keys of runs of ``short`` words that make at least ``share`` of all of them; sorted.

    A run below that share in every chunk is below it in all, so chunks send only what is above.
    """
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, window):
            keys = rolling(chunk.hashes(), short)
            # most runs fall short even together with all that share some bits
            part = (keys >> np.uint64(42)).astype(np.int64)
            least = share * len(keys)
            found, n = np.unique(keys[(np.bincount(part) >= least)[part]], return_counts=True)
            much = n >= least
            found, n = found[much].view(np.int64), n[much]
            yield pa.RecordBatch.from_arrays(
                [pa.array([None, *found.tolist()], pa.int64()),
                 pa.array([len(keys), *n.tolist()], pa.int64())], names=["run", "n"])

    sums = stage(docs.mapInArrow(counted, "run long, n long").groupBy("run")
                 .agg(F.sum("n").alias("n")), "word-runs")
    total = sums.where("run IS NULL").agg(F.sum("n")).first()[0] or 0
    # at most 1 / share rows
    rows = sums.where((F.col("run").isNotNull()) & (F.col("n") >= share * total)).select("run")
    return np.sort(rows.toPandas()["run"].to_numpy(np.int64).view(np.uint64))


def signatures(docs: DataFrame, buckets: int, hot: np.ndarray, window: int = WINDOW,
               short: int = SHORT) -> DataFrame:
    """bucket, packed: extent and side hashes of the super-k-mers of all documents, by minimiser."""
    side = (window - short + 1) // 2

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, window):
            # the first of equal windows travels; what the others cover is settled here
            at = chunk.at
            _, by_id = np.unique(chunk.doc_ids, return_inverse=True)
            rank = by_id[chunk.doc[at]] * (len(chunk.words) + 1) + chunk.start(at)
            late = repeated(chunk.words, at, rank, window)
            a, b = runs_of(at[late], chunk.doc[at[late]])
            gone, gone_length = at[late][a], b - a + window - 1
            at = at[~late]
            hashes = chunk.hashes()
            keys = rolling(hashes, short)
            order = keys >> np.uint64(1)
            if len(hot) and len(keys):
                known = hot[np.minimum(np.searchsorted(hot, keys), len(hot) - 1)] == keys
                order = np.where(known, order | np.uint64(1 << 63), order)
            least = leftmost_least(order, window - short + 1)[at]
            a, b = runs_of(at, chunk.doc[at], least)
            begin, length, middle = at[a], b - a + window - 1, least[a]
            # hashes of the minimiser with ``side`` words before and after it; 0 where none are
            wide = mix(rolling(hashes, short + side))
            left, right = np.zeros((2, len(a)), "<u4")
            far = middle - side >= begin
            left[far] = wide[middle[far] - side] >> np.uint64(32)
            far = middle + short + side <= begin + length
            right[far] = wide[middle[far]] >> np.uint64(32)
            bucket = (mix(keys[middle]) % np.uint64(buckets)).astype(np.int32)
            rows = []
            for k, i in by_value(bucket):
                rows.append((k, pack([
                    *owners(chunk, chunk.doc[begin[i]]), chunk.start(begin[i]), length[i],
                    left[i], right[i]])))
            spread_out = (mix(gone.astype(np.uint64)) % np.uint64(buckets)).astype(np.int32)
            for k, i in by_value(spread_out):
                rows.append((k, pack([*owners(chunk, chunk.doc[gone[i]]), chunk.start(gone[i]),
                                      gone_length[i]])))
            yield blobs(rows)

    return docs.mapInArrow(signed, BLOB)


def twice(values: np.ndarray) -> np.ndarray:
    """Which values other than 0 occur more than once."""
    order = np.argsort(values, kind="stable")
    same = (values[order[1:]] == values[order[:-1]]) & (values[order[1:]] != 0)
    out = np.zeros(len(values), bool)
    out[order[1:][same]] = out[order[:-1][same]] = True
    return out


def candidates(signed: DataFrame) -> DataFrame:
    """doc_id, version, start, length, bucket of super-k-mers that may hold an equal window.

    What was settled before has the bucket ``SETTLED``.
    """
    def shared(part: pa.Table) -> pa.Table:
        bucket, out, sides = part["bucket"][0].as_py(), [], []
        for data in part["packed"]:
            (ids, versions, doc, start, length, *both), _ = unpack(data.as_py())
            out.append([ids[doc], versions[doc], start, length,
                        np.full(len(doc), bucket if both else SETTLED)])
            sides.append(both or [np.full(len(doc), 0, "<u4")] * 2)
        ids, versions, start, length, bucket = (np.concatenate(x) for x in zip(*out))
        left, right = (np.concatenate(x) for x in zip(*sides))
        keep = (bucket == SETTLED) | twice(left) | twice(right)
        return pa.table({"doc_id": ids[keep], "version": versions[keep], "start": start[keep],
                         "length": length[keep].astype(np.int64),
                         "bucket": bucket[keep].astype(np.int32)})

    return signed.groupBy("bucket").applyInArrow(shared, RANGES + ", bucket int")


def super_kmers(asked: DataFrame, window: int = WINDOW) -> DataFrame:
    """bucket, packed: the words of super-k-mers; from (doc_id, version, text, asked).

    ``asked`` lists start, length and bucket of the super-k-mers of a text.
    """
    def strings(chunk: Chunk, wanted: list) -> pa.RecordBatch:
        chunk.close(window)
        doc = np.repeat(np.arange(len(wanted)), [len(w) for w in wanted])
        start, length, bucket = np.array([(r["start"], r["length"], r["bucket"])
                                          for w in wanted for r in w], np.int64).reshape(-1, 3).T
        names, rows = list(chunk.vocabulary), []
        for k, i in by_value(bucket):
            words = chunk.words[spread(chunk.first[doc[i]] + start[i], length[i])]
            used = np.zeros(len(names), bool)
            used[words] = True
            number = np.cumsum(used, dtype=np.int32) - 1
            kind = "<u4" if used.sum() > 1 << 16 else "<u2"
            rows.append((k, pack([*owners(chunk, doc[i]), start[i], length[i],
                                  number[words].astype(kind)],
                                 b" ".join([names[j] for j in np.flatnonzero(used).tolist()]))))
        return blobs(rows)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, wanted = Chunk(), []
        for batch in batches:
            for doc_id, version, text, own in zip(*(c.to_pylist() for c in batch.columns)):
                chunk.add(doc_id, version, text)
                wanted.append(own)
                if chunk.n >= CHUNK:
                    yield strings(chunk, wanted)
                    chunk, wanted = Chunk(), []
        if wanted:
            yield strings(chunk, wanted)

    return asked.select("doc_id", "version", "text", "asked").mapInArrow(packed, BLOB)


def late_ranges(dealt: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, version, start, length: words covered by windows that occur earlier, too."""
    def settle(part: pa.Table) -> pa.Table:
        vocabulary, words, out = Vocabulary(), [], []
        for data in part["packed"]:
            (ids, versions, doc, start, length, codes), names = unpack(data.as_py())
            known = np.fromiter(map(vocabulary.__getitem__, names), np.int32, len(names))
            words.append(known[codes])
            out.append([ids[doc], versions[doc], start, length])
        words = np.concatenate(words)
        ids, versions, start, length = (np.concatenate(x) for x in zip(*out))
        count = length - window + 1
        at = spread(np.cumsum(length) - length, count)
        owner, place = np.repeat(np.arange(len(ids)), count), spread(start, count)
        _, by_id = np.unique(ids, return_inverse=True)
        key = np.lexsort([place, by_id[owner]])
        new = (np.diff(by_id[owner][key]) != 0) | (np.diff(place[key]) != 0)
        rank = np.empty(len(key), np.int64)
        rank[key] = np.concatenate([[0], np.cumsum(new)])
        late = repeated(words, at, rank, window)
        owner, place = owner[late], place[late]
        a, b = runs_of(place, owner)
        return pa.table({"doc_id": ids[owner[a]], "version": versions[owner[a]],
                         "start": place[a], "length": b - a + window - 1})

    return dealt.groupBy("bucket").applyInArrow(settle, RANGES)


def without_repeats(docs: DataFrame, window: int = WINDOW, short: int = SHORT,
                    bucket_words: int = BUCKET, share: float | None = None) -> DataFrame:
    """doc_id, n_words, n_removed, text (kept words, joined by blanks) of every document."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.xxhash64("text").alias("version"), "text")
    # six bytes a word; a word travels about three times
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(partitions(docs.sparkSession), -(-size // (2 * bucket_words)))
    hot = hot_runs(rows, share or 1 / (HOT * buckets), window, short)
    found = stage(candidates(signatures(rows, buckets, hot, window, short)), "super-kmers")

    def per_text(ranges: DataFrame, *more: str) -> DataFrame:
        return (ranges.groupBy("doc_id", "version")
                .agg(F.collect_list(F.struct("start", "length", *more)).alias("ranges"))
                .select(F.col("doc_id").alias("of"), F.col("version").alias("of_version"), "ranges"))

    # the same keys in both joins, so that texts are shuffled once for the two of them
    here = ((F.coalesce("doc_id", F.lit(NULL_ID)) == F.col("of"))
            & (F.col("version") == F.col("of_version")))
    asked = rows.join(per_text(found.where(F.col("bucket") != SETTLED), "bucket"), here)
    late = late_ranges(super_kmers(asked.withColumnRenamed("ranges", "asked"), window), window)
    gone = late.union(found.where(F.col("bucket") == SETTLED).drop("bucket"))
    joined = rows.join(per_text(gone), here, "left")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, texts = [], [], []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                words = (text or "").encode().split()
                n_words.append(len(words))
                if spans:
                    # covered where more ranges have begun than ended
                    depth = np.zeros(len(words) + 1, np.int64)
                    begin = np.array([s["start"] for s in spans])
                    np.add.at(depth, begin, 1)
                    np.add.at(depth, begin + [s["length"] for s in spans], -1)
                    keep = np.flatnonzero(np.cumsum(depth[:-1]) == 0)
                    words = [words[i] for i in keep.tolist()]
                n_removed.append(n_words[-1] - len(words))
                texts.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()),
                 pa.array(texts, pa.string())], names=["doc_id", "n_words", "n_removed", "text"])

    return joined.select("doc_id", "text", "ranges").mapInArrow(
        cut, "doc_id long, n_words long, n_removed long, text string")
