"""Repeated passages against plain Python, and the parts of the method."""

import hashlib
import random

import brute
import numpy as np
import pytest
from conftest import SF, TEXTS

from tidewell.llm import passages
from tidewell.llm.queries import QUERIES

DOC = "doc_id long, text string"


def plain(rows, n=20):
    """(n_words, n_removed, kept text) of every row; rows of one doc_id at one start are equals."""
    first, texts = {}, [(d, brute.BLANKS.findall(t or "")) for d, t in rows]
    for d, w in texts:
        for i in range(len(w) - n + 1):
            key = tuple(w[i:i + n])
            first[key] = min(first.get(key, (d, i)), (d, i))
    out = []
    for d, w in texts:
        gone = {j for i in range(len(w) - n + 1) if first[tuple(w[i:i + n])] < (d, i)
                for j in range(i, i + n)}
        out.append((d, len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return sorted(out)


def found(df):
    return sorted((r["doc_id"], r["n_words"], r["n_removed"], r["text"]) for r in df.collect())


def test_query(spark, odd_docs):
    for path in (SF, odd_docs):
        rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(
            f"{path}/documents.parquet").select("doc_id", "text").collect()]
        out = QUERIES["op12_substring_dedup"](spark, path).collect()
        assert sorted((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in out) == [
            (d, n, gone, hashlib.sha256(t.encode()).hexdigest()) for d, n, gone, t in plain(rows)]
        assert any(r["n_removed"] for r in out)


@pytest.mark.parametrize("seed, share, bucket", [(1, None, 2_000_000), (2, 0.01, 100), (3, 1, 40)])
def test_random_texts(spark, seed, share, bucket):
    """Few words, so that runs of words are frequent; hot runs, many buckets, small chunks."""
    rng = random.Random(seed)
    common = [str(rng.randrange(5)) for _ in range(70)]
    texts = []
    for i in range(60):
        own = [rng.choice("abc") for _ in range(rng.randrange(90))]
        k = rng.randrange(40)
        texts.append((rng.randrange(-3, 50), " \t".join(own[:30] + common[k:k + rng.randrange(45)] + own[30:])))
    docs = spark.createDataFrame(texts, DOC).repartition(5)
    out = passages.without_repeats(docs, bucket_words=bucket, share=share)
    assert found(out) == plain(texts)
    assert sum(r[2] for r in plain(texts))
    assert found(passages.without_repeats(docs, window=5, short=2, bucket_words=bucket)) == plain(texts, 5)


def test_rows_of_one_id(spark):
    """Repeated rows, other texts under the same id, ids that are null, one very long text."""
    a = " ".join(f"w{i}" for i in range(50))
    b = " ".join(f"v{i}" for i in range(10)) + " " + a
    rows = [(1, a), (1, a), (1, b), (2, a), (2, a), (3, None), (3, ""), (4, " ".join([a] * 3000))]
    out = found(passages.without_repeats(spark.createDataFrame(rows, DOC)))
    assert out == plain(rows)
    assert [r[2] for r in out if r[0] == 1] == [0, 0, 50] and [r[2] for r in out if r[0] == 2] == [50, 50]
    null = passages.without_repeats(spark.createDataFrame([(None, a), (0, a), (None, a)], DOC))
    assert sorted((r["doc_id"] is None, r["n_removed"]) for r in null.collect()) == [
        (False, 50), (True, 0), (True, 0)]


def test_empty(spark):
    assert passages.without_repeats(spark.createDataFrame([], DOC)).collect() == []
    out = found(passages.without_repeats(spark.createDataFrame(list(enumerate(TEXTS[:4])), DOC)))
    assert [r[1:3] for r in out] == [(0, 0), (0, 0), (0, 0), (1, 0)]


def test_equal_keys_are_compared_by_words(monkeypatch):
    """Windows of different words that share a 64-bit key are no repeats."""
    words = np.array([1, 2, 3, 1, 2, 4, 1, 2, 3, 5], np.int32)
    at = np.arange(len(words) - 2)
    honest = passages.repeated(words, at, at, 3)
    monkeypatch.setattr(passages, "rolling", lambda items, n: np.zeros(len(items) - n + 1, np.uint64))
    assert passages.repeated(words, at, at, 3).tolist() == honest.tolist()
    assert honest.nonzero()[0].tolist() == [6]


def test_minimisers():
    rng = np.random.default_rng(7)
    values = rng.integers(0, 9, 200).astype(np.uint64)
    for width in (1, 2, 7, 17):
        assert passages.leftmost_least(values, width).tolist() == [
            i + int(values[i:i + width].argmin()) for i in range(len(values) - width + 1)]
    keys = passages.rolling(values, 20)
    equal = {tuple(values[i:i + 20]): k for i, k in enumerate(keys)}
    assert len(set(equal.values())) == len(equal) == len(set(keys.tolist()))


def test_hot_runs_lose_their_buckets(spark):
    """Texts that share a passage, and nothing else, meet in no common bucket beyond their number."""
    shared = " ".join(f"s{i}" for i in range(40))
    rows = [(i, " ".join(f"{i}x{j}" for j in range(40)) + " " + shared + " " +
             " ".join(f"{i}y{j}" for j in range(40))) for i in range(300)]
    docs = spark.createDataFrame(rows, DOC).repartition(6).selectExpr("doc_id", "0L version", "text")
    hot = passages.hot_runs(docs, 0.001, 20, 4)
    assert len(hot) == 37
    sizes = {}
    for r in passages.signatures(docs, 64, hot).collect():
        (_, _, doc, _, _, *sides), _ = passages.unpack(r["packed"])
        sizes[r["bucket"]] = sizes.get(r["bucket"], 0) + len(doc) * bool(sides)
    assert max(sizes.values()) < 3 * sum(sizes.values()) / 64
    out = passages.without_repeats(docs)
    assert sorted(r["n_removed"] for r in out.collect()) == [0] + [40] * 299


def test_only_shared_super_kmers_send_words(spark):
    """Texts without a common window send signatures only; equal windows always share one."""
    rng = random.Random(9)
    own = [(i, " ".join(f"{i}x{j}" for j in range(200))) for i in range(50)]
    docs = lambda rows: (spark.createDataFrame(rows, DOC).repartition(4)            # noqa: E731
                         .selectExpr("doc_id", "xxhash64(text) version", "text"))
    none = np.zeros(0, np.uint64)
    assert passages.candidates(passages.signatures(docs(own), 8, none)).count() == 0
    shared = []
    for i, text in own:     # passages of 20 words, the least that counts, in some place of two texts
        w = text.split()
        k, at = rng.randrange(180), rng.randrange(200)
        shared.append((i, text))
        shared.append((100 + i, " ".join([f"{i}y{j}" for j in range(at)] + w[k:k + 20]
                                         + [f"{i}z{j}" for j in range(50)])))
    asked = passages.candidates(passages.signatures(docs(shared), 8, none)).collect()
    assert len(asked) >= 50
    assert found(passages.without_repeats(docs(shared))) == plain(shared)
