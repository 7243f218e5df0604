"""Benchmark passages in training texts, by a generalised suffix automaton over words.

The words of all items form one automaton (several, if the items have more than ``BLOCK_WORDS``
words). Tasks build them, one for each block of items, and write them to the shared folder. Other
tasks load them, once for a batch of texts at most, stream each text through them and follow the
length of the longest match that ends at every word. A window of ``window`` consecutive item words
is hit where that length reaches ``window``; an item with fewer words is hit where its whole length
matches. Stretches without enough consecutive item bigrams cannot hold a window, so the automaton
skips them.

Nulls and edges: null has no words; a null item_id counts as empty text; items without words have
no windows; repeated items and rows give repeated results; empty tables give no rows or no hits;
other columns are ignored by ``scan`` and carried along by ``clean``.
"""

from __future__ import annotations

import pickle
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.session import fresh_dir

from .common import ALNUM_TABLE, filesystem, kept

WINDOW = 10
BLOCK_WORDS = 200_000
HELD = 4                       # automata that a worker keeps
BITS = 22                      # of the bigram filter
WORD = re.compile(rb"[0-9a-zA-Z\x80-\xff]+")     # in UTF-8, as ALNUM_TABLE splits them


class Automaton:
    """Suffix automaton of word sequences, with the items of every window."""

    def __init__(self, window: int):
        self.window, self.vocabulary = window, {}
        self.next, self.link, self.length = [{}], [-1], [0]
        self.sequences: list[tuple[str, list[int]]] = []

    def add(self, item: str, words: list[bytes]) -> None:
        vocabulary = self.vocabulary
        ids = [vocabulary.setdefault(w, len(vocabulary) + 1) for w in words]
        self.sequences.append((item, ids))
        last = 0
        for w in ids:
            last = self._extend(last, w)

    def _clone(self, p: int, q: int, w: int) -> int:
        """A copy of ``q`` that ends right after ``p``, and takes its place there."""
        self.next.append(dict(self.next[q]))
        self.length.append(self.length[p] + 1)
        self.link.append(self.link[q])
        new = len(self.next) - 1
        self.link[q] = new
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = new
            p = self.link[p]
        return new

    def _extend(self, last: int, w: int) -> int:
        q = self.next[last].get(w)
        if q is not None:                 # met before, in this or another item
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, q, w)
        self.next.append({})
        self.length.append(self.length[last] + 1)
        self.link.append(0)
        state, p = len(self.next) - 1, last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = state
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[state] = q if self.length[q] == self.length[p] + 1 else self._clone(p, q, w)
        return state

    def finish(self) -> Automaton:
        """Note the items of every window at the state it ends in, and the known bigrams."""
        self.items: dict[int, set[str]] = {}
        self.short: dict[tuple[int, int], set[str]] = {}
        codes = [np.zeros(0, np.int64)]
        self.shortest = self.window
        for item, ids in self.sequences:
            n = min(self.window, len(ids))
            self.shortest = min(self.shortest, n)
            state = 0
            for i, w in enumerate(ids):
                state = self.next[state][w]
                if i + 1 >= n:
                    u = self._suffix(state, n)
                    if n == self.window:
                        self.items.setdefault(u, set()).add(item)
                    else:
                        self.short.setdefault((u, n), set()).add(item)
            a = np.array(ids, np.int64)
            codes.append(self._code(a[:-1], a[1:]))
        self.short_lengths = sorted({n for _, n in self.short})
        self.bigrams = np.zeros(1 << BITS, bool)
        self.bigrams[np.concatenate(codes)] = True
        self.sequences = []
        return self

    @staticmethod
    def _code(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return ((a * 0x9E3779B1 + b * 0x85EBCA77) >> 7) & ((1 << BITS) - 1)

    def _suffix(self, state: int, n: int) -> int:
        """The state of the last ``n`` words of a match that ends in ``state``."""
        while self.length[self.link[state]] >= n:
            state = self.link[state]
        return state

    def stretches(self, ids: np.ndarray) -> Iterator[tuple[int, int]]:
        """Ranges of words that may hold a window."""
        known = ids > 0
        if self.shortest < 2:
            linked, least = known, 1
        else:
            linked = (known[:-1] & known[1:] & self.bigrams[self._code(ids[:-1], ids[1:])])
            least = self.shortest - 1
        edges = np.flatnonzero(np.diff(np.concatenate([[0], linked.view(np.int8), [0]])))
        begin, end = edges[::2], edges[1::2]
        long = end - begin >= least
        extra = int(self.shortest >= 2)
        return zip(begin[long].tolist(), (end[long] + extra).tolist())

    def hits(self, ids: np.ndarray) -> list[tuple[int, int, set[str]]]:
        """(begin, end, items) of every window in the words ``ids``; 0 is an unknown word."""
        out, window = [], self.window
        follow, link, length = self.next, self.link, self.length
        for begin, end in self.stretches(ids):
            state = matched = 0
            for i, w in enumerate(ids[begin:end].tolist(), begin + 1):
                while state and w not in follow[state]:
                    state = link[state]
                    matched = length[state]
                if w in follow[state]:
                    state = follow[state][w]
                    matched += 1
                for n in self.short_lengths:
                    if n <= matched and (found := self.short.get((self._suffix(state, n), n))):
                        out.append((i - n, i, found))
                if matched >= window:
                    found = self.items.get(self._suffix(state, window))
                    if found:
                        out.append((i - window, i, found))
        return out


def build(benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> list[str]:
    """Automata of all items in the shared folder; their paths.

    Items are dealt to blocks of some ``block_words`` words, and one task per block builds and writes
    an automaton. Only paths come back.
    """
    spark = benchmark.sparkSession
    path = fresh_dir(spark, "automata")
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"),
                             F.coalesce("text", F.lit("")).alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-size // (5 * block_words)) or 1         # some five bytes a word

    def built(part: pa.Table) -> pa.Table:
        fs, base = filesystem(path)
        fs.create_dir(base, recursive=True)
        automaton, some = Automaton(window), False
        for row in part.sort_by([("item", "ascending"), ("text", "ascending")]).to_pylist():
            if words := split(row["text"]):
                automaton.add(row["item"], words)
                some = True
        if not some:
            return pa.table({"name": pa.array([], pa.string())})
        name = uuid.uuid4().hex
        with fs.open_output_stream(f"{base}/{name}") as out:
            out.write(pickle.dumps(automaton.finish()))
        return pa.table({"name": [name]})

    dealt = items.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(blocks)))
    names = dealt.groupBy("block").applyInArrow(built, "name string")
    return [f"{path}/{r['name']}" for r in names.collect()]


def load(path: str) -> Automaton:
    """An automaton, as ``build`` wrote it; a worker keeps ``HELD`` of them."""
    held = kept("automata", dict)
    if path not in held:
        fs, name = filesystem(path)
        with fs.open_input_stream(name) as f:
            automaton = pickle.loads(f.read())
        if len(held) >= HELD:
            held.pop(next(iter(held)))
        held[path] = automaton
    return held[path]


def find(texts: list[list[bytes]], paths: list[str]
         ) -> list[tuple[list[tuple[int, int]], list[str]]]:
    """For each list of words: disjoint spans of hit words, and the items whose windows occur,
    sorted as text. Every automaton is loaded once for all of them."""
    ranges: list[list[tuple[int, int]]] = [[] for _ in texts]
    items: list[set[str]] = [set() for _ in texts]
    for path in paths:
        automaton = load(path)
        get = automaton.vocabulary.get
        for k, words in enumerate(texts):
            ids = np.array([get(w, 0) for w in words], np.int64)
            for begin, end, found in automaton.hits(ids):
                ranges[k].append((begin, end))
                items[k] |= found
    return [(joined(r), sorted(i)) for r, i in zip(ranges, items)]


def joined(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    spans: list[tuple[int, int]] = []
    for begin, end in sorted(ranges):
        if spans and begin <= spans[-1][1]:
            spans[-1] = (spans[-1][0], max(end, spans[-1][1]))
        else:
            spans.append((begin, end))
    return spans


def split(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(ALNUM_TABLE).split()


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the words of ``spans`` and what stands between them."""
    data, out, at = text.encode(), [], 0
    places = [m.span() for m in WORD.finditer(data)]
    for begin, end in spans:
        out.append(data[at:places[begin][0]])
        at = places[end - 1][1]
    return b"".join(out + [data[at:]]).decode()


def scan(docs: DataFrame, paths: list[str]) -> DataFrame:
    """doc_id, n_words, n_hit, spans (of words, end excluded), items, of every document."""
    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_hit, spans, items = [], [], [], []
            texts = [split(t) for t in batch.column(1).to_pylist()]
            for words, (found, names) in zip(texts, find(texts, paths)):
                n_words.append(len(words))
                n_hit.append(sum(e - b for b, e in found))
                spans.append([{"start": b, "end": e} for b, e in found])
                items.append(names)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()),
                 pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                 pa.array(items, pa.list_(pa.string()))],
                names=["doc_id", "n_words", "n_hit", "spans", "items"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        scanned, "doc_id long, n_words long, n_hit long, "
        "spans array<struct<start: long, end: long>>, items array<string>")


def clean(docs: DataFrame, paths: list[str], max_share: float = 0.5) -> DataFrame:
    """``docs`` without hit spans; without documents of which more than ``max_share`` was hit.

    A cut can bring item words together, so a text is scanned again until nothing is hit.
    """
    place = docs.columns.index("text")

    def cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(place).to_pylist()
            total, hit = [len(split(t)) for t in texts], [0] * len(texts)
            left = range(len(texts))
            while left:
                found = find([split(texts[k]) for k in left], paths)
                left = [(k, spans) for k, (spans, _) in zip(left, found) if spans]
                for k, spans in left:
                    hit[k] += sum(e - b for b, e in spans)
                    texts[k] = without(texts[k], spans)
                left = [k for k, _ in left]
            keep = [h <= max_share * n for h, n in zip(hit, total)]
            columns = list(batch.columns)
            columns[place] = pa.array(texts, batch.schema.field(place).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema).filter(pa.array(keep))

    return docs.mapInArrow(cleaned, docs.schema)
