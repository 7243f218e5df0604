"""Toxic passages as maximum-scoring segments of word log-odds.

Learning: in a bounded sample of labelled rows of the training folds, tasks count the documents
that hold each token, a word or a prefix of one. Tokens that lean to toxic documents, and those
that lean to clean ones and are frequent enough to tell, are counted once more over all documents of
the corpus, which gives the Dirichlet prior of their log-odds. Positive log-odds that stay significant
and all negative ones are the model; a word without any costs ``DRIFT``.

Scoring: every occurrence of a word has its score, and a linear scan (Ruzzo and Tompa) finds all
maximal scoring segments of a text. Segment scores of clean texts follow an extreme-value law, whose
parameters come from the scores of all words in clean rows of the sample; a segment is a passage if
its p-value is at most ``ALPHA``. The scores of all passages of a
text, less the logarithm of its search space, give its statistic, and a logistic curve over the
sample makes that a probability.

Nulls and edges: a null or empty text has no segment and gets the score of an empty one; labels
other than 0 and 1 and rows without an id are not learned from; without labels of both kinds all
scores are 0; repeated rows get equal scores; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM_TABLE, fit_logistic, fold, labelled_sample, logistic, stage

SAMPLE = 20_000         # labelled rows to learn from, at most
PREFIXES = (4, 5, 6)    # bytes
PRIOR = 500.0           # documents that the prior is worth
SIGNIFICANT = 4.0       # standard deviations of log-odds, for some 100,000 tokens looked at
EXPECTED = 8            # toxic documents to expect of a token that leans to clean ones, at least
DRIFT = 0.5
ALPHA = 0.05
KEPT = 100_000          # scores of short words that a task remembers


def tokens_of(word: bytes) -> list[bytes]:
    """The word, marked as whole, and its prefixes, longest first."""
    return [b"=" + word] + [word[:n] for n in reversed(PREFIXES) if len(word) > n]


def split(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(ALNUM_TABLE).split()


def document_tokens(text: str | None) -> set[bytes]:
    return {t for w in set(split(text)) for t in tokens_of(w)}


@dataclass
class Model:
    weights: dict[bytes, float]
    rate: float = 1.0                  # lambda and K of the extreme-value law
    space: float = 1.0
    curve: tuple[float, float] = (0.0, -30.0)
    known: dict[bytes, float] = field(default_factory=dict)

    def score(self, word: bytes) -> float:
        got = self.known.get(word)
        if got is None:
            own = [self.weights[t] for t in tokens_of(word) if t in self.weights]
            # the most toxic token, or the longest one if all lean to clean rows
            got = -DRIFT if not own else most if (most := max(own)) > 0 else own[0]
            if len(self.known) < KEPT and len(word) <= 64:
                self.known[word] = got
        return got

    def segments(self, words: list[bytes]) -> list[tuple[float, int, int]]:
        """(score, begin, end) of all maximal scoring segments, in linear time."""
        scores = {w: s for w in set(words) if (s := self.score(w)) != -DRIFT}
        if max(scores.values(), default=0) <= 0:
            return []
        return maximal_segments([(i, scores[w]) for i, w in enumerate(words) if w in scores], DRIFT)

    def statistic(self, segments: list[tuple[float, int, int]], n: int) -> float:
        space = np.log1p(self.space * n)
        values = [self.rate * s - space for s, _, _ in segments]
        least = -np.log(-np.log1p(-ALPHA))          # where the p-value is ALPHA
        passages = [v for v in values if v >= least]
        return float(np.clip(sum(passages) if passages else max(values, default=-space), -30, 60))

    def passages(self, words: list[bytes]) -> list[tuple[int, int]]:
        """(begin, end) in words of every significant segment."""
        least = -np.log(-np.log1p(-ALPHA)) + np.log1p(self.space * len(words))
        return [(b, e) for s, b, e in self.segments(words) if self.rate * s >= least]

    def probability(self, statistic: np.ndarray) -> np.ndarray:
        return logistic(self.curve[0] * statistic + self.curve[1])


def maximal_segments(scored: list[tuple[int, float]], drift: float
                     ) -> list[tuple[float, int, int]]:
    """Maximal segments of scores that are ``-drift`` at all places but those given."""
    # left and right cumulative sum, begin, end, and the nearest segment to the left with a
    # smaller left sum
    stack: list[tuple[float, float, int, int, int]] = []
    total, at = 0.0, 0
    for place, score in scored:
        total -= drift * (place - at)
        at = place + 1
        left, right, begin = total, total + score, place
        total = right
        if score <= 0:
            continue
        j = len(stack) - 1
        while True:
            while j >= 0 and stack[j][0] >= left:
                j = stack[j][4]
            if j < 0 or stack[j][1] >= right:
                stack.append((left, right, begin, at, j))
                break
            left, _, begin, _, before = stack[j]
            del stack[j:]
            j = before
    return [(r - l, b, e) for l, r, b, e, _ in stack]


def _one_of_each(rows: DataFrame) -> DataFrame:
    """Rows (text, y) without most near copies, which would count one finding many times.

    Near copies share the smallest hash of their five-word shingles with a probability of their
    similarity; two hash functions leave few of them.
    """
    def smallest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            least = []
            for text in batch.column(0).to_pylist():
                words = split(text)
                grams = {b" ".join(words[i:i + 5]) for i in range(max(1, len(words) - 4))}
                least.append([min(zlib.crc32(g, seed) for g in grams) for seed in (1, 2)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *(
                    pa.array([m[k] for m in least], pa.int64()) for k in (0, 1))],
                names=["text", "y", "m1", "m2"])

    return (rows.select("text", "y")
            .mapInArrow(smallest, "text string, y int, m1 long, m2 long")
            .dropDuplicates(["m1", "y"]).dropDuplicates(["m2", "y"]).select("text", "y"))


def _count(rows: DataFrame, wanted: frozenset[bytes] | None) -> DataFrame:
    """token, documents with y = 1, documents with y = 0, over all rows (text, y)."""
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = (Counter(), Counter())
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = document_tokens(text)
                counts[y].update(found if wanted is None else found & wanted)
            keys = list(counts[0].keys() | counts[1].keys())
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.binary()), pa.array([counts[1][k] for k in keys], pa.int64()),
                 pa.array([counts[0][k] for k in keys], pa.int64())], names=["token", "y1", "y0"])

    counted_rows = rows.select("text", "y").mapInArrow(counted, "token binary, y1 long, y0 long")
    return counted_rows.groupBy("token").agg(F.sum("y1").alias("y1"), F.sum("y0").alias("y0"))


def _log_odds(y1: np.ndarray, y0: np.ndarray, n1: int, n0: int, prior: np.ndarray
              ) -> tuple[np.ndarray, np.ndarray]:
    """Log-odds ratio with a Dirichlet prior, and its standard deviations from zero."""
    a, b = y1 + prior, y0 + prior
    delta = np.log(a / np.maximum(n1 + PRIOR - a, 1)) - np.log(b / np.maximum(n0 + PRIOR - b, 1))
    return delta, delta / np.sqrt(1 / a + 1 / b)


def _corpus_counts(docs: DataFrame, wanted: frozenset[bytes]) -> dict[bytes, int]:
    """How many of all documents hold each wanted token: sums per task, then over tasks."""
    index = {t: i for i, t in enumerate(sorted(wanted))}

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(len(index), np.int64)
        known: dict[bytes, tuple[int, ...]] = {}
        for batch in batches:
            for text in batch.column(0).to_pylist():
                found = set()
                for w in set(split(text)):
                    own = known.get(w)
                    if own is None:
                        own = tuple(index[t] for t in tokens_of(w) if t in index)
                        if len(known) < KEPT and len(w) <= 64:
                            known[w] = own
                    if own:
                        found.update(own)
                counts[list(found)] += 1
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])],
                                         names=["token", "n"])

    sums = docs.select("text").mapInArrow(counted, "token long, n long").groupBy("token").agg(
        F.sum("n").alias("n"))
    got = {r["token"]: r["n"] for r in sums.collect()}      # at most one row per wanted token
    return {t: got.get(i, 0) for t, i in index.items()}


def _statistics(rows: DataFrame, model: Model
                ) -> tuple[list[tuple[int, int, list[float]]], dict[float, int]]:
    """(label, words, segment scores) of the bounded sample, and how many words of its clean rows
    have each score other than ``-DRIFT``."""
    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, scores, steps = [], [], []
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = split(text)
                sizes.append(len(words))
                scores.append([s for s, _, _ in model.segments(words)])
                counts = Counter() if y else Counter(map(model.score, words))
                steps.append([{"score": s, "n": n} for s, n in counts.items() if s != -DRIFT])
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), pa.array(sizes, pa.int64()),
                 pa.array(scores, pa.list_(pa.float64())),
                 pa.array(steps, pa.list_(pa.struct([("score", pa.float64()),
                                                     ("n", pa.int64())])))],
                names=["y", "n", "scores", "steps"])

    out = stage(rows.select("text", "y").mapInArrow(
        scanned, "y int, n long, scores array<double>, steps array<struct<score: double, n: long>>"),
        "labelled-scores")
    # at most one row per weight
    steps = (out.select(F.explode("steps").alias("s")).groupBy("s.score")
             .agg(F.sum("s.n").alias("n")).collect())
    return ([tuple(r) for r in out.select("y", "n", "scores").toLocalIterator()],
            {r["score"]: r["n"] for r in steps})


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = SAMPLE) -> Model:
    rows = stage(_one_of_each(labelled_sample(docs, labels, label, sample)), "distinct-labelled")
    kinds = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n1, n0 = kinds.get(1, 0), kinds.get(0, 0)
    model = Model({})
    if not (n1 and n0):
        return model
    # more frequent among toxic rows, and in more than one of them; or less frequent among them than
    # among clean rows, which the few tokens tell that are frequent enough
    leaning = _count(rows, None).where(
        ((F.col("y1") >= 2) & (F.col("y1") * n0 > 2 * F.col("y0") * n1))
        | ((F.col("y0") * n1 >= EXPECTED * n0) & (F.col("y0") * n1 > F.col("y1") * n0))).collect()
    wanted = frozenset(bytes(r["token"]) for r in leaning)
    corpus = _corpus_counts(docs, wanted)
    total = docs.count()
    names = [bytes(r["token"]) for r in leaning]
    y1 = np.array([r["y1"] for r in leaning], float)
    y0 = np.array([r["y0"] for r in leaning], float)
    prior = np.maximum(PRIOR * np.array([corpus[t] for t in names], float) / max(total, 1), 1e-2)
    delta, z = _log_odds(y1, y0, n1, n0, prior)
    model.weights = {t: float(d) for t, d, s in zip(names, delta, z)
                     if d < 0 or s >= SIGNIFICANT}
    return calibrate(model, *_statistics(rows, model))


def calibrate(model: Model, rows: list[tuple[int, int, list[float]]], seen: dict[float, int]
              ) -> Model:
    """Extreme-value law from the words ``seen`` in clean rows, logistic curve from all rows."""
    clean = [(n, s) for y, n, s in rows if y == 0]
    words = sum(n for n, _ in clean)
    # half a step of each positive weight smooths what clean rows show
    toxic = [w for w in model.weights.values() if w > 0]
    steps = np.array([*seen, *toxic], float)
    times = np.concatenate([np.array([*seen.values()], float),
                            np.full(len(toxic), 0.5 / max(len(toxic), 1))])
    share = times / max(words, 1)

    def excess(rate: float) -> float:
        return float((share * np.exp(np.minimum(rate * steps, 700))).sum()
                     + (1 - share.sum()) * np.exp(-rate * DRIFT) - 1)

    low, high = 1e-3, 20.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if excess(mid) < 0 else (low, mid)
    model.rate = low
    best = np.array([max(s, default=0.0) for _, s in clean])
    n = np.array([max(n, 1) for n, _ in clean], float)
    model.space = float(len(clean) / max((n * np.exp(-model.rate * best)).sum(), 1e-9))
    x = np.array([model.statistic([(v, 0, 0) for v in s], n) for _, n, s in rows])
    y = np.array([y for y, _, _ in rows], float)
    w = fit_logistic(x[:, None], y)
    model.curve = (float(w[0]), float(w[1]))
    return model


def scan(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, statistic, score and passages (begin and end in words) of every whole text."""
    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            statistics, passages = [], []
            for text in batch.column(1).to_pylist():
                words = split(text)
                statistics.append(model.statistic(model.segments(words), len(words)))
                passages.append([{"start": b, "end": e} for b, e in model.passages(words)])
            values = np.array(statistics, float)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(values), pa.array(model.probability(values)),
                 pa.array(passages, pa.list_(pa.struct([("start", pa.int64()),
                                                        ("end", pa.int64())])))],
                names=["doc_id", "statistic", "score", "passages"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        scanned, "doc_id long, statistic double, score double, "
        "passages array<struct<start: long, end: long>>")


def keep_clean(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """``docs`` without those that score ``threshold`` or more."""
    place = docs.columns.index("text")

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = []
            for text in batch.column(place).to_pylist():
                words = split(text)
                values.append(model.statistic(model.segments(words), len(words)))
            score = model.probability(np.array(values, float))
            yield batch.filter(pa.array(score < threshold))

    return docs.mapInArrow(kept, docs.schema)


def judged(scores: DataFrame, threshold: float) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    return scores.select("doc_id", (fold(F.col("doc_id")) == 2).alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"))
