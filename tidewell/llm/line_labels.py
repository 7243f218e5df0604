"""Content and boilerplate lines by a linear-chain conditional random field.

Every line with a word is described by a few yes-or-no features; a chain over the lines of a text
has a weight per feature and label and one per pair of neighbouring labels. The weights are learned
by gradient ascent on the likelihood of a bounded sample of labelled texts of the training folds:
lines of good texts count as content, lines of bad ones and repeats of an earlier line as
boilerplate. Viterbi decoding labels the lines of every text, and a text is kept if content lines
hold at least ``SHARE`` of its word characters.

Nulls and edges: null has no words; a text without words fails the base rule; without labels of
both kinds every line is content; very long texts are decoded whole, in learning they are cut into
chains of ``CHAIN`` lines, which loses one pair of neighbours in ``CHAIN``, and a hash chooses at most
``CHAINS`` of these (the driver learns from them in some 250 MB); repeated rows get equal results; empty tables give no rows; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hash_sample, labelled_sample, stage

SAMPLE = 8_000          # labelled rows to learn from, at most
CHAIN = 32
CHAINS = 20_000         # of CHAIN lines, that are learned from at most
STEPS, RATE, RIDGE = 120, 0.1, 1e-4
SHARE = 0.5
MIN_WORDS, REPEATED_PERCENT, GRAM = 10, 20, 5
SYMBOLS = b"#*$%&|<>"
BLANKS = b" \t\n\x0b\x0c\r"
UPPER, DIGITS = bytes(range(65, 91)), b"0123456789"

FEATURES = ["bias", "words_1_2", "words_3_7", "words_20", "symbols_2", "symbols_10", "bars",
            "upper_30", "upper_70", "digits_10", "digits_40", "ended", "exclaims", "repeat",
            "first", "last", "address", "few_distinct", "long_words", "commas"]


def line_features(line: bytes, seen: set[bytes], first: bool, last: bool) -> list[bool]:
    words = line.split()
    size = sum(map(len, words))
    share = lambda kind: (len(line) - len(line.translate(None, kind))) / size
    symbols, upper, digits = share(SYMBOLS), share(UPPER), share(DIGITS)
    n = len(words)
    return [True, n < 3, 3 <= n < 8, n >= 20, symbols > 0.02, symbols > 0.1,
            line.count(b"|") > n // 4 + 1, upper > 0.3, upper > 0.7, digits > 0.1, digits > 0.4,
            words[-1][-1:] in b".?:;\"", line.count(b"!") > n // 8 + 1, line in seen, first, last,
            b"http" in line or b"www." in line or b"@" in line, len(set(words)) < 0.5 * n,
            size > 15 * n, b"," in line]


def text_lines(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Features and word bytes of the lines with a word."""
    lines = [x for x in (text or "").encode().split(b"\n") if x.split()]
    seen: set[bytes] = set()
    rows = []
    for i, line in enumerate(lines):
        rows.append(line_features(line, seen, i == 0, i == len(lines) - 1))
        seen.add(line)
    return (np.array(rows, bool).reshape(len(rows), len(FEATURES)),
            np.array([len(x.translate(None, BLANKS)) for x in lines], np.int64))


class Chain:
    """Weights of features (by label) and of label pairs; label 1 is content."""

    def __init__(self):
        self.weights = np.zeros((len(FEATURES), 2))
        self.pairs = np.zeros((2, 2))

    def decode(self, x: np.ndarray) -> np.ndarray:
        """The most likely labels of a whole text; content where nothing was learned."""
        emit = (x @ self.weights).tolist()
        (p00, p01), (p10, p11) = self.pairs.tolist()
        back, s0, s1 = [], 0.0, 0.0
        for k, (e0, e1) in enumerate(emit):
            if k:
                a0, a1, b0, b1 = s0 + p00, s1 + p10, s0 + p01, s1 + p11
                back.append((a1 >= a0, b1 >= b0))
                s0, s1 = max(a0, a1), max(b0, b1)
            s0, s1 = s0 + e0, s1 + e1
        label = s1 >= s0
        out = [label]
        for step in reversed(back):
            label = step[label]
            out.append(label)
        return np.array(out[::-1] if emit else [], bool)

    def learn(self, chains: list[tuple[np.ndarray, np.ndarray]]) -> Chain:
        """Gradient ascent on the conditional likelihood, all chains at once."""
        labels = {int(v) for _, y in chains for v in np.unique(y)}
        if labels != {0, 1}:
            return self
        n, t = len(chains), max(len(y) for _, y in chains)
        x = np.zeros((n, t, len(FEATURES)))
        y, there = np.zeros((n, t), int), np.zeros((n, t), bool)
        for i, (a, b) in enumerate(chains):
            x[i, :len(b)], y[i, :len(b)], there[i, :len(b)] = a, b, True
        follows = there[:, 1:].astype(float)
        one_hot = np.eye(2)[y] * there[:, :, None]
        seen = np.einsum("ntf,ntl->fl", x, one_hot)
        seen_pairs = np.einsum("nta,ntb,nt->ab", one_hot[:, :-1], one_hot[:, 1:], follows)
        total = there.sum()
        m = [np.zeros_like(self.weights), np.zeros_like(self.pairs)]
        v = [np.zeros_like(self.weights), np.zeros_like(self.pairs)]
        for step in range(1, STEPS + 1):
            expected, pairs = self._expectations(x, there, follows)
            for k, (w, g) in enumerate(((self.weights, (seen - expected) / total),
                                        (self.pairs, (seen_pairs - pairs) / total))):
                g = g - RIDGE * w
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                w += RATE * m[k] / (1 - 0.9 ** step) / (np.sqrt(v[k] / (1 - 0.999 ** step)) + 1e-8)
        return self

    def _expectations(self, x: np.ndarray, there: np.ndarray, follows: np.ndarray
                      ) -> tuple[np.ndarray, np.ndarray]:
        """Expected feature and pair counts, by the forward-backward recursion."""
        n, t, _ = x.shape
        emit = x @ self.weights
        forward, backward = np.zeros((n, t, 2)), np.zeros((n, t, 2))
        forward[:, 0] = emit[:, 0]
        for k in range(1, t):
            step = np.logaddexp(forward[:, k - 1, :1] + self.pairs[0],
                                forward[:, k - 1, 1:] + self.pairs[1]) + emit[:, k]
            forward[:, k] = np.where(there[:, k, None], step, forward[:, k - 1])
        for k in range(t - 2, -1, -1):
            onward = emit[:, k + 1] + backward[:, k + 1]
            step = np.logaddexp(self.pairs[:, 0] + onward[:, :1], self.pairs[:, 1] + onward[:, 1:])
            backward[:, k] = np.where(there[:, k + 1, None], step, 0)
        z = np.logaddexp(forward[:, -1, 0], forward[:, -1, 1])
        gamma = np.exp(np.minimum(forward + backward - z[:, None, None], 0)) * there[:, :, None]
        pair = np.exp(np.minimum(
            forward[:, :-1, :, None] + self.pairs + (emit + backward)[:, 1:, None, :]
            - z[:, None, None, None], 0))
        return (np.einsum("ntf,ntl->fl", x, gamma), np.einsum("ntab,nt->ab", pair, follows))


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text."""
    data = (text or "").encode()
    words = data.split()
    lines = [x for x in data.split(b"\n") if x.split()]
    blanks = len(data) - len(data.translate(None, BLANKS))
    repeated, n = 0, len(words)
    if n > GRAM:
        h = np.fromiter(map(hash, words), np.int64, n).view(np.uint64)
        grams = h[:n - GRAM + 1].copy()
        for k in range(1, GRAM):
            grams = grams * np.uint64(0x9E3779B97F4A7C15) + h[k:n - GRAM + 1 + k]
            grams ^= grams >> np.uint64(29)
        order = np.argsort(grams, kind="stable")
        same = grams[order][1:] == grams[order][:-1]
        twice = np.zeros(len(grams) + 1, bool)
        twice[order[1:]] |= same
        twice[order[:-1]] |= same
        if same.any():
            cover = np.zeros(n + 1, np.int64)
            np.add.at(cover, np.flatnonzero(twice), 1)
            np.add.at(cover, np.flatnonzero(twice) + GRAM, -1)
            repeated = int((np.cumsum(cover)[:n] > 0).sum())
    return (n, len(text or "") - blanks, len(data) - len(data.translate(None, SYMBOLS)),
            len(lines) - len(set(lines)), repeated)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE,
        chains_at_most: int = CHAINS) -> Chain:
    """The chain from at most ``sample`` labelled rows and ``chains_at_most`` chains of their lines;
    line features alone reach the driver."""
    def chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ys, xs, sizes = [], [], []
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                x, _ = text_lines(text)
                for k in range(0, len(x), CHAIN):
                    ys.append(y)
                    xs.append(np.packbits(x[k:k + CHAIN]).tobytes())
                    sizes.append(len(x[k:k + CHAIN]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ys, pa.int32()), pa.array(sizes, pa.int32()), pa.array(xs, pa.binary())],
                names=["y", "n", "x"])

    rows = labelled_sample(docs, labels, label, sample).select("text", "y").mapInArrow(
        chains, "y int, n int, x binary")
    learned = []
    # equal chains may be apart, so a number tells them apart for the choice
    some = hash_sample(stage(rows, "chains").withColumn("k", F.monotonically_increasing_id()),
                       chains_at_most, "x", "k")
    for y, n, x in sorted((r["y"], r["n"], bytes(r["x"])) for r in some.toLocalIterator()):
        bits = np.unpackbits(np.frombuffer(x, np.uint8), count=n * len(FEATURES))
        a = bits.reshape(n, len(FEATURES)).astype(bool)
        learned.append((a, np.where(a[:, FEATURES.index("repeat")], 0, y)))
    return Chain().learn(learned)


COLUMNS = ("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
           "n_repeat_words long, base_failed boolean, content_share double, kept boolean")


def rate(docs: DataFrame, chain: Chain, share: float = SHARE) -> DataFrame:
    """Base counts, share of content and verdict of every whole text."""
    schema = pa.schema([(c.split()[0], {"long": pa.int64(), "boolean": pa.bool_(),
                                        "double": pa.float64()}[c.split()[1]])
                        for c in COLUMNS.split(", ")])

    def rated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counts = base_counts(text)
                failed = counts[0] < MIN_WORDS or 100 * counts[4] > REPEATED_PERCENT * counts[0]
                x, size = text_lines(text)
                content = float((chain.decode(x) * size).sum() / max(size.sum(), 1))
                rows.append((doc_id, *counts, failed, content, not failed and content >= share))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        rated, COLUMNS)
