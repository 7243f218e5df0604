"""Quality by a generalised additive model with pairwise interactions.

Tasks measure each whole text with a few features. A bounded sample of labelled rows of the training
folds is cut into quantile bins per feature, and shallow trees are boosted in turn, feature by
feature, on the residuals of all others: a tree of three leaves over the bins of one feature adds to
that feature's lookup table. Pairs whose residuals gain most from a joint split get tables of their
own, boosted in the same way. A score is the sum of looked-up values under a logistic curve.

Nulls and edges: a null text counts as empty and has its own bin values (all features 0); labels
other than 0 and 1 and rows without an id are not learned from; without labels of both kinds the
score is their share, or 0.5 without any; repeated rows get equal scores; empty tables give no
rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import labelled_sample, logistic

SAMPLE = 20_000         # labelled rows to learn from, at most
BINS, PAIR_BINS, PAIRS = 32, 8, 8
ROUNDS, PAIR_ROUNDS, RATE = 150, 60, 0.1
PART = 1 << 20          # bytes compressed at once
SYMBOLS = b"#*$%&|<>{}[]~^\\_=+@/"
UPPER = bytes(range(65, 91))
DIGITS = b"0123456789"
STOPS = b".!?"

FEATURES = ["log_words", "mean_word", "symbols", "upper", "digits", "stops", "exclaims", "commas",
            "beyond_ascii", "distinct_words", "top_word", "lines_per_word", "repeated_lines",
            "short_lines", "ended_lines", "packed", "capital_words", "long_words"]


def packed_size(data: bytes) -> int:
    """Bytes of all of ``data`` compressed, in parts, so that no compressed copy is held."""
    pack, view = zlib.compressobj(1), memoryview(data)
    return sum(len(pack.compress(view[k:k + PART])) for k in range(0, len(data), PART)) + len(
        pack.flush())


def features(text: str | None) -> list[float]:
    """One value per name in ``FEATURES``; all 0 for a text without words."""
    data = (text or "").encode()
    words = data.split()
    if not words:
        return [0.0] * len(FEATURES)
    n, size = len(words), len(data)
    share = lambda kind: (size - len(data.translate(None, kind))) / size
    counts = Counter(words)
    lines = [x for x in data.split(b"\n") if x.strip()]
    return [
        float(np.log1p(n)), sum(map(len, words)) / n, share(SYMBOLS), share(UPPER), share(DIGITS),
        share(STOPS), share(b"!"), share(b","), share(bytes(range(128, 256))), len(counts) / n,
        counts.most_common(1)[0][1] / n, len(lines) / n, 1 - len(set(lines)) / len(lines),
        sum(len(x.split()) < 4 for x in lines) / len(lines),
        sum(x.rstrip()[-1:] in b".!?:;\"" for x in lines) / len(lines),
        packed_size(data) / size, sum(w[:1].isupper() for w in words) / n,
        sum(len(w) > 20 for w in words) / n]


@dataclass
class Additive:
    edges: list[np.ndarray]
    base: float = 0.0
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for j, table in enumerate(self.tables):
            total += table[np.searchsorted(self.edges[j], x[:, j], "right")]
        for (i, j), table in zip(self.pairs, self.pair_tables):
            total += table[np.searchsorted(self.coarse[i], x[:, i], "right"),
                           np.searchsorted(self.coarse[j], x[:, j], "right")]
        return logistic(total)


def cuts(values: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(values, np.linspace(0, 1, bins + 1)[1:-1]))


def _leaf(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g / (h + 1.0)


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + 1.0)


def _tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Values per bin of the best tree with three leaves, from sums per bin."""
    cg, ch = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])
    n = len(g)
    # leaf [a, b) for all a <= b; the best two cuts in one table
    a, b = np.meshgrid(np.arange(n + 1), np.arange(n + 1), indexing="ij")
    gain = np.where(a <= b, _gain(cg[b] - cg[a], ch[b] - ch[a]), -np.inf)
    both = gain[0, :, None] + gain + gain[:, n][None, :]
    first, second = np.unravel_index(int(np.nanargmax(both)), both.shape)
    out = np.zeros(n)
    for lo, hi in ((0, first), (first, second), (second, n)):
        if hi > lo:
            out[lo:hi] = _leaf(cg[hi] - cg[lo], ch[hi] - ch[lo])
    return out


def _quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and values of the best tree that cuts each axis of a pair table once."""
    cg = np.pad(g.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    ch = np.pad(h.cumsum(0).cumsum(1), ((1, 0), (1, 0)))

    def parts(c: np.ndarray) -> list[np.ndarray]:
        upper, left, total = c[:, -1:], c[-1:, :], c[-1, -1]
        return [c, upper - c, left - c, total - upper - left + c]

    gs, hs = parts(cg), parts(ch)
    gain = sum(_gain(a, b) for a, b in zip(gs, hs))
    i, j = np.unravel_index(int(gain.argmax()), gain.shape)
    v = [_leaf(a[i, j], b[i, j]) for a, b in zip(gs, hs)]
    out = np.empty(g.shape)
    out[:i, :j], out[:i, j:], out[i:, :j], out[i:, j:] = v
    return float(gain[i, j] - _gain(cg[-1, -1], ch[-1, -1])), out


def train(x: np.ndarray, y: np.ndarray) -> Additive:
    model = Additive([cuts(x[:, j], BINS) for j in range(x.shape[1])] if len(x) else [])
    share = y.mean() if len(y) else 0.5
    if not len(y) or not 0 < share < 1:
        model.base = float(60 * (share - 0.5))
        return model
    model.base = float(np.log(share / (1 - share)))
    total = np.full(len(y), model.base)
    binned = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(model.edges)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    for _ in range(ROUNDS):
        for b, table in zip(binned, model.tables):
            p = logistic(total)
            step = RATE * _tree(np.bincount(b, y - p, len(table)),
                                np.bincount(b, p * (1 - p), len(table)))
            table += step
            total += step[b]
    model.coarse = [cuts(x[:, j], PAIR_BINS) for j in range(x.shape[1])]
    small = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(model.coarse)]

    def sums(i: int, j: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        shape = (len(model.coarse[i]) + 1, len(model.coarse[j]) + 1)
        at, p = small[i] * shape[1] + small[j], logistic(total)
        return (at, np.bincount(at, y - p, shape[0] * shape[1]).reshape(shape),
                np.bincount(at, p * (1 - p), shape[0] * shape[1]).reshape(shape))

    gains = {ij: _quadrants(*sums(*ij)[1:])[0] for ij in combinations(range(x.shape[1]), 2)}
    model.pairs = sorted(gains, key=gains.get, reverse=True)[:PAIRS]
    model.pair_tables = [np.zeros((len(model.coarse[i]) + 1, len(model.coarse[j]) + 1))
                         for i, j in model.pairs]
    for _ in range(PAIR_ROUNDS):
        for ij, table in zip(model.pairs, model.pair_tables):
            at, g, h = sums(*ij)
            step = RATE * _quadrants(g, h)[1]
            table += step
            total += step.ravel()[at]
    return model


def measured(rows: DataFrame, carried: str, kind: str) -> DataFrame:
    """The column ``carried`` and the feature values of each text."""
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([features(t) for t in batch.column(1).to_pylist()],
                                           pa.list_(pa.float64()))], names=[carried, "x"])

    return rows.select(F.col(carried).cast(kind).alias(carried), "text").mapInArrow(
        measure, f"{carried} {kind}, x array<double>")


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE
        ) -> Additive:
    """The model from at most ``sample`` labelled rows, whose features alone reach the driver."""
    rows = [(r["y"], r["x"]) for r in
            measured(labelled_sample(docs, labels, label, sample), "y", "int").toLocalIterator()]
    rows.sort()
    return train(np.array([x for _, x in rows], float).reshape(len(rows), len(FEATURES)),
                 np.array([y for y, _ in rows], float))


def scored(docs: DataFrame, model: Additive) -> DataFrame:
    """doc_id and score of every whole text."""
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([features(t) for t in batch.column(1).to_pylist()], float)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(model.score(x.reshape(-1, len(FEATURES))))],
                names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        score, "doc_id long, score double")
