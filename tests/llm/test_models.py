"""Trained models and rule engines against plain re-computations."""

import itertools
import math
import random
import time

import brute
import numpy as np
import pyarrow.fs
import pytest
from conftest import SF

from tidewell.llm import additive, licenses, line_dedup, line_labels, near_dup, toxicity, warc
from tidewell.llm.queries import QUERIES

DOC = "doc_id long, text string"


# -- quality model -----------------------------------------------------------------

def leaf(rows, g, h):
    return sum(g[r] for r in rows) / (sum(h[r] for r in rows) + 1)


def worth(rows, g, h):
    return sum(g[r] for r in rows) ** 2 / (sum(h[r] for r in rows) + 1)


def best_tree(bins, g, h, n):
    """Values of the best three leaves, by trying all pairs of cuts on the rows themselves."""
    def parts(a, b):
        return [[r for r, k in enumerate(bins) if lo <= k < hi] for lo, hi in ((0, a), (a, b), (b, n))]

    a, b = max(itertools.combinations_with_replacement(range(n + 1), 2),
               key=lambda c: sum(worth(p, g, h) for p in parts(*c)))
    return sum(worth(p, g, h) for p in parts(a, b)), {
        k: leaf(p, g, h) for p, (lo, hi) in zip(parts(a, b), ((0, a), (a, b), (b, n))) for k in range(lo, hi)}


def test_trees_are_the_best_ones():
    rng = np.random.default_rng(1)
    for _ in range(20):
        bins, n = rng.integers(0, 6, 40), 6
        g, h = rng.normal(size=40), rng.random(40)
        out = additive._tree(np.bincount(bins, g, n), np.bincount(bins, h, n))
        gain, _ = best_tree(bins, g, h, n)
        own = {v: [r for r in range(40) if out[bins[r]] == v] for v in set(out[bins])}
        assert len(own) <= 3 and math.isclose(sum(worth(p, g, h) for p in own.values()), gain)
        assert all(math.isclose(leaf(p, g, h), v) for v, p in own.items())


def test_quadrants_are_the_best_ones():
    rng = np.random.default_rng(2)
    for _ in range(20):
        a, b = rng.integers(0, 4, 50), rng.integers(0, 5, 50)
        g, h = rng.normal(size=50), rng.random(50)
        at = a * 5 + b
        gain, out = additive._quadrants(np.bincount(at, g, 20).reshape(4, 5),
                                        np.bincount(at, h, 20).reshape(4, 5))

        def total(i, j):
            return sum(worth([r for r in range(50) if (a[r] < i) == p and (b[r] < j) == q], g, h)
                       for p in (True, False) for q in (True, False))

        best = max(total(i, j) for i in range(5) for j in range(6))
        assert math.isclose(gain, best - worth(range(50), g, h), abs_tol=1e-9)
        for v in set(out.ravel().tolist()):
            rows = [r for r in range(50) if out[a[r], b[r]] == v]
            assert not rows or math.isclose(leaf(rows, g, h), v)


def test_training_like_a_plain_loop(monkeypatch):
    """Cyclic boosting of tables row by row, without binned sums."""
    monkeypatch.setattr(additive, "ROUNDS", 4)
    monkeypatch.setattr(additive, "PAIRS", 0)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(120, 3)).round(1)
    y = (x[:, 0] - x[:, 1] + rng.normal(size=120) > 0).astype(float)
    model = additive.train(x, y)
    share = y.mean()
    score = [math.log(share / (1 - share))] * 120
    for _ in range(4):
        for j in range(3):
            edges = model.edges[j]
            bins = [sum(v >= e for e in edges) for v in x[:, j]]
            p = [1 / (1 + math.exp(-s)) for s in score]
            g, h = [a - b for a, b in zip(y, p)], [b * (1 - b) for b in p]
            out = additive._tree(np.array([sum(v for v, k in zip(g, bins) if k == n) for n in range(len(edges) + 1)]),
                                 np.array([sum(v for v, k in zip(h, bins) if k == n) for n in range(len(edges) + 1)]))
            score = [s + additive.RATE * out[k] for s, k in zip(score, bins)]
    assert np.allclose(model.score(x), [1 / (1 + math.exp(-s)) for s in score])


# -- licenses ----------------------------------------------------------------------

def test_license_labels_and_scores_by_all_pairs(spark):
    """Texts made of names, grants, tags and verbs, so that findings overlap and nest."""
    rng = random.Random(4)
    parts = ["licensed under the terms of the", "MIT License", "Apache License", "Version 2.0", "GNU",
             "General Public License", "v3 or later", "LGPL 2.1", "BSD 3-Clause License", "all rights reserved",
             "SPDX-License-Identifier:", "Apache-2.0", "MPL 2.0", "the", "public domain", "dedicated to",
             "copyright 2020", "copyright by", "CC0 1.0 Universal", "Creative Commons Attribution-ShareAlike 4.0",
             "Lesser", "released under", "gpl v2", "AGPL-3.0-only", "European Union Public Licence 1.2",
             "CDDL", "same terms as Perl itself", "zlib license", "EPL 2.0", "eupl 1.1", "free software", ",", "x"]
    rows = [(i, " ".join(rng.choices(parts, k=rng.randrange(14)))) for i in range(400)] + [(1000, None)]
    rules = licenses.rules()
    out = {r["doc_id"]: (r["labels"], r["score"]) for r in
           licenses.scan_digest(spark.createDataFrame(rows, DOC).repartition(8)).collect()}
    seen = set()
    for i, text in rows:
        assert out[i] == brute.license_findings(text, rules, licenses.SCORES, licenses.BASE), text
        seen |= set(out[i][0].split(","))
    assert len(seen) > 20


def test_license_keywords_are_long():
    assert all(len(word) >= 4 for _, _, word, _ in licenses.rules())
    assert sum(word.strip() in ("license", "public license") for _, _, word, _ in licenses.rules()) == 0


# -- line labels -------------------------------------------------------------------

def test_verdicts_like_plain_decoding(spark):
    """Share of content and verdict of every text, by a plain search for the best labels."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    chain = line_labels.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    kept = 0
    for r in line_labels.rate(docs, chain).collect():
        x, size = line_labels.text_lines(texts[r["doc_id"]])
        ways = [(0.0, [])]                  # the best labels so far, by the last one
        for k, row in enumerate(x):
            own = [sum(chain.weights[f, v] for f in np.flatnonzero(row)) for v in (0, 1)]
            if not k:
                ways = [(own[v], [v]) for v in (0, 1)]
                continue
            ways = [max(((s + chain.pairs[y[-1], v] + own[v], y + [v]) for s, y in ways), key=lambda w: w[0])
                    for v in (0, 1)]
        labels = max(ways, key=lambda w: w[0])[1]
        share = sum(n for n, v in zip(size.tolist(), labels) if v) / max(sum(size.tolist()), 1)
        assert math.isclose(r["content_share"], share, abs_tol=1e-9)
        assert r["kept"] == (not r["base_failed"] and share >= line_labels.SHARE)
        kept += r["kept"]
    assert kept


def test_learning_is_bounded(spark, monkeypatch):
    """Texts of very many lines: no more chains are learned from than asked for."""
    text = "\n".join(f"A line of {i} words, and more words to come." for i in range(3000))
    docs = spark.createDataFrame([(i, text if i % 2 else "# | # | #\n" * 900) for i in range(30)], DOC)
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)], "doc_id long, quality int")
    seen, learn = [], line_labels.Chain.learn
    monkeypatch.setattr(line_labels.Chain, "learn", lambda self, chains: (
        seen.append(len(chains)), learn(self, chains))[1])
    chain = line_labels.fit(docs, labels, chains_at_most=200)
    assert 100 < seen[0] <= 200
    out = {r["doc_id"]: r["content_share"] for r in line_labels.rate(docs, chain).collect()}
    assert all((out[i] >= line_labels.SHARE) == bool(i % 2) for i in range(30))


# -- toxicity ----------------------------------------------------------------------

def test_log_odds_with_a_prior():
    y1, y0, prior = np.array([5.0, 0.0, 40.0]), np.array([1.0, 9.0, 4000.0]), np.array([0.5, 0.01, 30.0])
    delta, z = toxicity._log_odds(y1, y0, 100, 5000, prior)
    for k in range(3):
        a, b = y1[k] + prior[k], y0[k] + prior[k]
        d = math.log(a / (100 + toxicity.PRIOR - a)) - math.log(b / (5000 + toxicity.PRIOR - b))
        assert math.isclose(delta[k], d) and math.isclose(z[k], d / math.sqrt(1 / a + 1 / b))


def test_extreme_values_follow_the_law():
    """Best segments of random clean texts exceed a score about as often as the law says."""
    rng = random.Random(6)
    model = toxicity.Model({b"=bad": 1.5, b"=ill": 0.8, b"=kind": -2.0})
    words = lambda n: rng.choices([b"bad", b"ill", b"kind", b"w"], [1, 3, 4, 92], k=n)
    seen, rows = {1.5: 0, 0.8: 0, -2.0: 0}, []
    for _ in range(1500):
        text = words(300)
        for w in text:
            if (s := model.score(w)) in seen:
                seen[s] += 1
        rows.append((0, 300, [s for s, _, _ in model.segments(text)]))
    rows += [(1, 300, [30.0])] * 50
    toxicity.calibrate(model, rows, seen)
    share = {s: n / 450_000 for s, n in seen.items()}
    # the rate is the positive root of this equation
    left = sum(p * math.exp(model.rate * s) for s, p in share.items()) + (1 - sum(share.values())) * math.exp(
        -model.rate * toxicity.DRIFT)
    assert abs(left - 1) < 0.01
    best = [max([s for s, _, _ in model.segments(words(300))], default=0) for _ in range(1500)]
    for level in (2.0, 3.0, 4.0):
        law = 1 - math.exp(-model.space * 300 * math.exp(-model.rate * level))
        assert abs(sum(b >= level for b in best) / 1500 - law) < 0.12
    # the curve separates the two kinds
    x = [model.statistic([(v, 0, 0) for v in s], n) for _, n, s in rows]
    p = model.probability(np.array(x))
    assert p[-1] > 0.9 and np.mean(p[:1500]) < 0.1


# -- archives ----------------------------------------------------------------------

@pytest.mark.parametrize("payload", [b"WARC/1.1 " * 100_000, b"WARC/1.1\r\n" * 100_000,
                                     b"WARC/1.1\r\nName: " * 60_000, b"WARC/1.1\r\n" + b"x" * (64 << 20),
                                     b"WARC/1.1\r\nName: " + b"x" * (64 << 20)],
                         ids=["magics", "versions", "fields", "no colon", "no line end"])
def test_scan_takes_linear_time(tmp_path, payload):
    data = warc.record(1, "u", payload, "0" * 64, None, "d") + warc.record(2, "u", b"y", "0" * 64, None, "d")
    (tmp_path / "a.warc").write_bytes(data)
    begun = time.process_time()
    reader = warc.Reader(pyarrow.fs.LocalFileSystem(), str(tmp_path / "a.warc"), len(data), 0, 4 << 20)
    at, found = reader.data.find(warc.MAGIC), []
    while 0 <= at < min(4 << 20, len(data)):
        if (stop := reader.extent(at)) is not None:
            found.append((at, stop))
            assert stop == reader.header(at)[2]
        at = reader.data.find(warc.MAGIC, at + 1)
    assert found[0][0] == 0 and len(found) <= 2
    assert time.process_time() - begun < 4


def test_archives_of_repeated_rows_and_null_ids(spark, tables):
    """Every row is a record; a null page_id is written as such."""
    big = "b" * 200
    rows = [(1, "u", big), (1, "u", big), (2, "u", big), (None, "u", big), (None, None, None), (3, "u", "s"),
            (3, "u", "s")]
    path = tables(pages=(rows, "page_id long, url string, html string"))
    out = sorted(((r["page_id"] or -1, r["payload_bytes"], r["record_type"], r["refers_to"])
                  for r in QUERIES["op2_warc_records"](spark, path).collect()), key=str)
    assert out == sorted([(1, 200, "response", None)] * 2 + [(2, 200, "revisit", 1), (-1, 200, "revisit", 1),
                         (-1, 0, "response", None)] + [(3, 1, "response", None)] * 2, key=str)


# -- deduplication of rows ---------------------------------------------------------

def test_versions_of_a_document_count_once(spark):
    """Two documents in three versions are two documents; each version is cut by itself."""
    line = "this line is held by several documents"
    rows = [(1, f"{line}\na"), (1, f"{line}\nb"), (2, f"c\n{line}")]
    out = line_dedup.drop_shared_lines(spark.createDataFrame(rows, DOC))
    assert sorted((r["doc_id"], r["n_dropped"]) for r in out.collect()) == [(1, 0), (1, 0), (2, 0)]
    third = line_dedup.drop_shared_lines(spark.createDataFrame(rows + [(3, line), (None, line)], DOC))
    assert sorted((r["doc_id"] or 9, r["text"]) for r in third.collect()) == [
        (1, "a"), (1, "b"), (2, "c"), (3, line), (9, "")]


def test_one_row_of_each_component_stays(spark):
    """Repeated rows, other texts under the id of a copy, rows without an id or without words."""
    a = " ".join(f"w{i}" for i in range(40))
    near = a + " end"
    other = " ".join(f"z{i}" for i in range(40))
    rows = [(1, a), (1, a), (1, a), (2, near), (2, other), (3, a), (None, a), (None, a), (4, None), (5, ""),
            (4, None), (6, other)]
    out = near_dup.keep_one(spark.createDataFrame(rows, DOC).repartition(3))
    got = sorted(((r["doc_id"] or 99, r["text"] or "") for r in out.collect()), key=str)
    firsts = [r for r in got if r[0] not in (99, 4, 5)]
    assert firsts == [(1, a), (2, other)]
    assert [r for r in got if r[0] == 99] == [(99, a)] * 2
    assert [r for r in got if r[0] in (4, 5)] == [(4, ""), (4, ""), (5, "")]
    # the usual case: every id has one text
    usual = [r for r in rows if r != (2, other)]
    out = near_dup.keep_one(spark.createDataFrame(usual, DOC).repartition(3))
    assert sorted(r["doc_id"] for r in out.where("doc_id IS NOT NULL").collect()) == [1, 4, 4, 5, 6]
