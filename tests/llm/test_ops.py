"""Each operator's query against a plain Python version, on given tables and on odd rows."""

import itertools
import random
import re
import zlib

import brute
import numpy as np
import pyarrow.parquet as pq
import pytest
from conftest import SF, TEXTS

from tidewell.llm import (additive, decontaminate, licenses, line_labels, near_dup, packing,
                          token_files, tokens, toxicity, warc)
from tidewell.llm.queries import QUERIES

LARGER = "/root/testdata/sf0.1"        # some thousand labelled rows
RUN = {name.split("_")[0]: f for name, f in QUERIES.items()}


def rows(path, name, *columns):
    t = pq.read_table(f"{path}/{name}.parquet", columns=list(columns))
    return list(zip(*(t.column(c).to_pylist() for c in columns)))


def got(spark, op, path, key="doc_id"):
    out = [r.asDict() for r in RUN[op](spark, path).collect()]
    assert len({r[key] for r in out}) == len(out)
    return {r[key]: r for r in out}


def compare(spark, op, path, expected, columns, key="doc_id"):
    out = got(spark, op, path, key)
    assert set(out) == set(expected)
    for k, r in out.items():
        assert tuple(r[c] for c in columns) == expected[k][:len(columns)], (k, r)
    return out


TOKENS = ["start", "n_tokens", "ids_crc32"]
LINES = ["n_lines", "n_dropped", "kept_sha256"]
LICENSES = ["n_words", "n_base", "first_word", "last_word", "base_labels"]


@pytest.mark.parametrize("op, brute_force, columns", [
    ("op1", brute.token_rows, TOKENS),
    ("op7", brute.line_rows, LINES),
    ("op9", brute.license_rows, LICENSES),
])
def test_documents(spark, odd_docs, op, brute_force, columns):
    for path in (SF, odd_docs):
        compare(spark, op, path, brute_force(rows(path, "documents", "doc_id", "text")), columns)


def test_leaks(spark, odd_docs):
    for path in (SF, odd_docs):
        docs, items = rows(path, "documents", "doc_id", "text"), rows(path, "benchmark", "item_id", "text")
        compare(spark, "op4", path, brute.leak_rows(docs, items),
                ["n_words", "n_hit", "n_items", "items_sha256", "contaminated"])


def test_clean_leaves_no_window(spark, odd_docs):
    docs, items = rows(odd_docs, "documents", "doc_id", "text"), rows(odd_docs, "benchmark", "item_id", "text")
    paths = decontaminate.build(spark.read.parquet(f"{odd_docs}/benchmark.parquet"), block_words=20)
    assert len(paths) > 1
    source = spark.read.parquet(f"{odd_docs}/documents.parquet")
    out = {r["doc_id"]: r["text"] for r in decontaminate.clean(source, paths).collect()}
    before = brute.leak_rows(docs, items)
    after = brute.leak_rows(list(out.items()), items)
    assert not any(r[4] for r in after.values())
    assert all(out[d] == t for d, t in docs if not before[d][4])
    assert 3 not in out and out[4].endswith(" two")      # "one" is an item


def test_pages(spark, odd_docs):
    for path in (SF, odd_docs):
        compare(spark, "op2", path, brute.page_rows(rows(path, "pages", "page_id", "html")),
                ["payload_bytes", "payload_digest", "record_type", "refers_to"], "page_id")


@pytest.mark.parametrize("block, roll", [(64, 1 << 30), (1000, 5000), (1 << 20, 1)])
def test_archive_blocks(spark, odd_docs, tmp_path, block, roll):
    """Records longer than blocks, many blocks in a file, magic inside payloads."""
    pages = spark.read.parquet(f"{odd_docs}/pages.parquet").where("page_id <> 8 OR {} > 64".format(block))
    path = f"{tmp_path}/archives"
    warc.write_archives(pages.coalesce(1), path, roll=roll)
    out = warc.read_archives(spark.read.parquet(f"{path}/files"), path, block=block).collect()
    html = {r["page_id"]: (r["html"] or "").encode() for r in pages.collect()}
    assert sorted(r["page_id"] for r in out) == sorted(html)
    assert all(r["intact"] and bytes(r["payload"]) == html[r["page_id"]]
               for r in out if r["record_type"] == "response")


@pytest.mark.parametrize("op", sorted(RUN))
def test_empty_tables(spark, no_docs, op):
    assert RUN[op](spark, no_docs).collect() == []


def test_packing(spark, odd_docs):
    for path in (SF, odd_docs):
        docs = rows(path, "documents", "doc_id", "text")
        out = [r.asDict() for r in RUN["op10"](spark, path).collect()]
        n = brute.check_packing(docs, out)
        assert n <= 1.01 * sum(r["length"] for r in out) / 1024 + 1


def test_sequences_hold_the_ids_of_their_pieces(spark, odd_docs):
    import public_tokenizers
    docs = spark.read.parquet(f"{odd_docs}/documents.parquet")
    cut = packing.pieces(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=2, group=40).cache()
    assert cut.select("group").distinct().count() > 1
    pieces = {(r["doc_id"], r["piece"]): bytes(r["ids"]) for r in cut.collect()}
    seen = []
    for r in packing.sequences(cut).collect():
        assert r["length"] == len(r["ids"]) // 2 <= packing.WINDOW
        assert bytes(r["ids"]) == b"".join(pieces[p["doc_id"], p["piece"]] for p in r["pieces"])
        seen += [(p["doc_id"], p["piece"]) for p in r["pieces"]]
    assert sorted(seen) == sorted(pieces)


def test_equal_rows_are_dealt_over_all_groups(spark):
    import public_tokenizers
    docs = spark.range(4000).selectExpr("cast(null as long) doc_id", "cast(null as string) text")
    cut = packing.pieces(docs.repartition(3), public_tokenizers.path("byte_bpe_50k.json"), end_id=2,
                         group=500)
    sizes = [r["count"] for r in cut.groupBy("group").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 2 * min(sizes)


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoder_equals_the_tokenizer(name):
    """Random texts of letters, marks and white space of every kind, met twice."""
    import public_tokenizers
    rng = random.Random(name)
    alphabet = "abcXYZ  ' ,.\n\t0123éÉüßñÿÀ÷×µºªÞþ—…İΣςσ\u0301Å\x01<|>\x0b\xa0sStTdDmMlL漢字\U0001f600"
    texts = ["".join(rng.choices(alphabet, k=rng.randrange(60))) for _ in range(3000)]
    texts += ["".join(rng.choices("abc \n", k=30)) for _ in range(1000)]
    texts += [None, "", "I'll DON'T we've", "Áb É", "x\x01y", "a  \nb", "a \n b", "x\n \ny", " a ", "a\n "]
    e = tokens.Encoder(public_tokenizers.path(name))
    whole = brute.tokenizer(name)
    expected = [whole.encode(t or "", add_special_tokens=False).ids for t in texts]
    for _ in range(2):
        assert [np.frombuffer(i, e.kind).tolist() for i in e.encode(texts)] == expected


def test_encoder_keeps_little(monkeypatch):
    """Long pieces are never kept, and short ones up to a number of bytes; another operator's
    things take the place of an encoder."""
    import public_tokenizers
    path = public_tokenizers.path("byte_bpe_50k.json")
    e = tokens.encoder(path)
    rng = random.Random(2)
    han = lambda n: "".join(chr(rng.randrange(0x4E00, 0x9FA5)) for _ in range(n))
    list(e.encode([han(3000) for _ in range(50)]))
    assert not e.known and tokens.encoder(path) is e
    monkeypatch.setattr(tokens, "KEPT_BYTES", 50_000)
    list(e.encode([" ".join(han(5) for _ in range(300)) for _ in range(20)]))
    assert 0 < e.size < 50_000 + tokens.ENTRY * 2
    near_dup.shingles("two words")
    assert tokens.encoder(path) is not e


def test_close_frames_are_read_at_once():
    offset, length = np.array([40, 50, 60, 20_000, 20_010, 5]), np.array([10, 10, 5, 10, 30, 3])
    assert list(token_files.spans(offset, length)) == [
        (40, 25, [0, 1, 2]), (20_000, 40, [3, 4]), (5, 3, [5])]
    assert list(token_files.spans(offset[:3], length[:3], most=20)) == [(40, 20, [0, 1]), (60, 5, [2])]


def test_license_labels(spark, odd_docs):
    out = got(spark, "op9", odd_docs)
    assert out[TEXTS.index(next(t for t in TEXTS if t and "SPDX" in t))]["labels"] == \
        "apache-2.0,proprietary,unlicense"
    # the name inside the grant is suppressed, the base label stays
    assert out[13]["labels"] == "apache,apache-2.0" and out[13]["base_labels"] == "apache"
    assert out[0]["score"] == 0 and 0 < out[11]["score"] <= 1


def matches_of(parsed):
    """All texts that a parsed expression without unbounded repeats matches."""
    out = [""]
    for kind, value in parsed:
        kind = str(kind)
        if kind == "LITERAL":
            some = [chr(value)]
        elif kind == "IN":
            some = [chr(c) for k, v in value
                    for c in ([v] if str(k) == "LITERAL" else range(v[0], v[1] + 1))]
        elif kind == "SUBPATTERN":
            some = matches_of(value[3])
        elif kind == "BRANCH":
            some = [x for branch in value[1] for x in matches_of(branch)]
        elif kind == "MAX_REPEAT":
            some = ["".join(c) for n in range(value[0], value[1] + 1)
                    for c in itertools.product(matches_of(value[2]), repeat=n)]
        else:
            assert kind == "ASSERT_NOT", kind       # a rule starts after a blank
            some = [""]
        out = [a + b for a in out for b in some]
    return out


def test_license_gate_loses_nothing():
    for label, _, word, text in licenses.rules():
        for match in matches_of(re._parser.parse(text)):
            assert word in match and any(g in match for g in licenses.GATE), (label, match)


def test_license_statements_behind_the_gate(spark, tables):
    texts = {"Permission is hereby granted, free of charge, to any person": "mit",
             "Redistribution and use in source and binary forms": "bsd",
             "Permission to use, copy, modify and/or distribute this software": "isc",
             "this program is free software; you can redistribute it": "gpl",
             "proprietary and confidential": "proprietary", "CC0 1.0 Universal": "cc0-1.0",
             "Creative Commons Attribution 4.0 International": "cc-by", "BSD 3-Clause": "bsd-3",
             "new BSD": "bsd-3", "MPL 2.0": "mpl-2.0", "EPL 2.0": "epl-2.0",
             "EUPL 1.2": "eupl-1.2", "CDDL": "cddl-1.0", "CeCILL-B": "cecill-b",
             "released under the terms of Expat": "mit", "an example of nothing": ""}
    path = tables(documents=(list(enumerate(texts)), "doc_id long, text string"))
    out = got(spark, "op9", path)
    assert [out[i]["labels"] for i in range(len(texts))] == list(texts.values())


RULES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def test_quality_rules(spark, odd_docs):
    for path in (SF, odd_docs):
        out = compare(spark, "op6", path, brute.rule_rows(rows(path, "documents", "doc_id", "text")),
                      RULES)
        assert not any(r["kept"] and r["base_failed"] for r in out.values())


@pytest.mark.parametrize("op, label, least", [("op5", "toxic", 0.9), ("op8", "quality", 0.98)])
def test_held_out_accuracy(spark, op, label, least):
    out = got(spark, op, LARGER)
    known = dict(rows(LARGER, "labels", "doc_id", label))
    assert all(r["held_out"] == (zlib.crc32(str(d).encode()) % 4 == 2) for d, r in out.items())
    assert all(0 <= r["score"] <= 1 for r in out.values())
    held = [d for d, r in out.items() if r["held_out"] and d in known]
    assert sum(out[d]["predicted"] == known[d] for d in held) >= least * len(held)


@pytest.mark.parametrize("op", ["op5", "op6", "op8"])
def test_odd_texts_are_scored(spark, odd_docs, op):
    out = got(spark, op, odd_docs)
    assert set(out) == set(range(len(TEXTS)))
    assert all(r["score"] is not None and 0 <= r["score"] <= 1 for r in out.values()
               if "score" in r)


def test_packed_measures_whole_texts():
    """Beyond the first MiB, too."""
    rng = random.Random(6)
    head = " ".join(str(rng.random()) for _ in range(70_000))
    assert len(head) > 1 << 20
    packed = lambda text: additive.features(text)[additive.FEATURES.index("packed")]
    for text in (head, head + " junk" * 400_000, "short text", " junk" * 400_000 + head):
        assert packed(text) == len(zlib.compress(text.encode(), 1)) / len(text)
    assert packed(head + " junk" * 400_000) < 0.6 * packed(head)


def test_lines_decode_like_all_paths():
    """Viterbi against every labelling of short chains."""
    rng = np.random.default_rng(5)
    for _ in range(30):
        chain = line_labels.Chain()
        chain.weights, chain.pairs = rng.normal(size=chain.weights.shape), rng.normal(size=(2, 2))
        x = rng.random((6, len(line_labels.FEATURES))) < 0.4
        emit = x @ chain.weights
        value = lambda y: (sum(emit[i, v] for i, v in enumerate(y))          # noqa: E731
                           + sum(chain.pairs[a, b] for a, b in zip(y, y[1:])))
        best = max(itertools.product((0, 1), repeat=6), key=value)
        assert tuple(chain.decode(x).astype(int)) == best


def test_segments_like_recursion():
    """Linear scan against repeated search for the best range."""
    def slow(scores, begin, end):
        best = max(((sum(scores[i:j]), i - j, i, j) for i in range(begin, end)
                    for j in range(i + 1, end + 1)), default=(0,))
        if best[0] <= 1e-9:
            return []
        _, _, i, j = min(((-sum(scores[a:b]), -(b - a), a, b) for a in range(begin, end)
                          for b in range(a + 1, end + 1)
                          if sum(scores[a:b]) > best[0] - 1e-9), key=lambda r: (r[1], r[2]))
        return slow(scores, begin, i) + [(i, j)] + slow(scores, j, end)

    rng = random.Random(3)
    for _ in range(200):
        scores = [rng.choice([-0.5, -0.5, rng.uniform(0.1, 3)]) for _ in range(14)]
        positive = [(i, s) for i, s in enumerate(scores) if s > 0]
        assert [(b, e) for _, b, e in toxicity.maximal_segments(positive, 0.5)] == \
            slow(scores, 0, len(scores))


def test_segments_score_every_occurrence():
    """Scattered first uses do not hide a later passage, nor does a first passage a second one."""
    model = toxicity.Model({b"=bad": 2.0, b"=vile": 2.0, b"=foul": 2.0, b"=kind": -3.0},
                           rate=1.0, space=0.01)
    gap, dense = [b"w"] * 50, [b"bad", b"vile", b"foul", b"bad", b"vile", b"foul"]
    words = [b"bad", *gap, b"vile", *gap, b"foul", *gap, *dense, *gap, *dense]
    assert model.passages(words) == [(153, 159), (209, 215)]
    assert model.passages(gap + [b"bad"] * 6 + gap) == [(50, 56)]
    # words that lean to clean rows cost what their log-odds say
    assert model.segments([b"bad", b"kind", b"bad"]) == [(2.0, 0, 1), (2.0, 2, 3)]
    assert model.segments([b"bad", b"w", b"bad"]) == [(3.5, 0, 3)]
    # a small cost between two scores joins them
    assert toxicity.maximal_segments([(0, 2.0), (2, -0.1), (3, 1.5)], 0.5) == [(2.9, 0, 4)]


def test_toxicity_learns_words_of_clean_rows(spark, tables):
    rng = random.Random(4)
    plain = [f"w{i}" for i in range(60)]
    docs = [(i, " ".join(rng.choices(plain, k=40) + (["slur", "slur"] if i % 2 else ["gentle"])))
            for i in range(400)]
    path = tables(documents=(docs, "doc_id long, text string"),
                  labels=([(i, 1, i % 2) for i, _ in docs],
                          "doc_id long, quality long, toxic long"))
    read = lambda name: spark.read.parquet(f"{path}/{name}.parquet")
    model = toxicity.fit(read("documents"), read("labels"))
    assert model.score(b"slur") > 0 and model.score(b"gentle") < -toxicity.DRIFT
    assert model.score(b"unseen") == -toxicity.DRIFT


def test_near_duplicates(spark, odd_docs):
    for path in (SF, odd_docs):
        compare(spark, "op3", path, brute.near_rows(rows(path, "documents", "doc_id", "text")),
                ["n_shingles", "component_id", "kept"])


def test_chains_of_near_copies(spark, tables):
    """A long chain of texts, each similar to its neighbours only, beside a group of many copies."""
    chain = [(i, " ".join(f"w{k}" for k in range(3 * i, 3 * i + 60))) for i in range(40)]
    base = [f"b{k}" for k in range(80)]
    group = [(1000 + i, " ".join(base[:i % 80] + [f"x{i}"] + base[i % 80 + 1:])) for i in range(150)]
    path = tables(documents=([(i, t) for i, t in chain + group + [(5000, group[3][1])]],
                             "doc_id long, text string"))
    docs = rows(path, "documents", "doc_id", "text")
    expected = brute.near_rows(docs)
    assert expected[39][1] == 0 and expected[1149][1] == 1000
    compare(spark, "op3", path, expected, ["n_shingles", "component_id", "kept"])


def test_bucket_members_meet_in_bounded_groups(spark, monkeypatch):
    """All pairs across components meet once, those inside the largest one never."""
    monkeypatch.setattr(near_dup, "BLOCK", 32)
    label = {i: -1 if i < 150 else i // 2 * 2 if i < 200 else i for i in range(400)}
    member = spark.createDataFrame([(7, i, x) for i, x in label.items()] + [(8, 1, 1), (8, 2, 1)],
                                   "bucket long, rep long, label long")
    groups = {}
    for r in near_dup._dealt(member).collect():
        assert r["bucket"] == 7 and r["own"] in (r["low"], r["high"])
        groups.setdefault((r["low"], r["high"]), []).append((r["rep"], r["own"]))
    assert max(map(len, groups.values())) <= 4 * 32 < 400 - 150
    met = [frozenset((a, b)) for (low, high), g in groups.items() for a, x in g for b, y in g
           if x == low and y == high and (a < b or low < high)]
    met = [m for m in met if len({label[i] for i in m}) == 2]
    assert len(met) == len(set(met))
    assert set(met) == {frozenset(p) for p in itertools.combinations(label, 2)
                        if label[p[0]] != label[p[1]]}


def test_near_duplicates_of_a_template(spark, tables, monkeypatch):
    """Many texts that share a template but are not similar enough, over many small blocks."""
    monkeypatch.setattr(near_dup, "BLOCK", 16)
    template = [f"t{k}" for k in range(70)]
    docs = [(i, " ".join(template + [f"o{i // 2 if i < 40 else i}_{k}" for k in range(14)]
                         + [f"e{i}"] * (i < 40))) for i in range(200)]
    path = tables(documents=(docs, "doc_id long, text string"))
    expected = brute.near_rows(docs)
    assert len({r[1] for r in expected.values()}) > 100
    compare(spark, "op3", path, expected, ["n_shingles", "component_id", "kept"])


def test_repeated_rows_and_null_ids(spark, tables):
    rows_ = [(1, "same words here in a row"), (1, "same words here in a row"), (None, "x"),
             (None, None), (2, "same words here in a row")]
    path = tables(documents=(rows_, "doc_id long, text string"),
                  labels=([], "doc_id long, quality long, toxic long"),
                  benchmark=([], "item_id long, text string"))
    for op in ("op1", "op3", "op4", "op5", "op6", "op7", "op8", "op9", "op10"):
        out = RUN[op](spark, path).collect()
        assert sorted((r["doc_id"] is None, r["doc_id"]) for r in out if r["doc_id"]) == [
            (False, 1), (False, 1), (False, 2)] and len(out) == 5, op


def test_odd_sketch_tells_similarity():
    """Counts stay in five deviations of the expected, from small sets to large ones."""
    rng = np.random.default_rng(2)
    for n in (5, 60, 300, 2000, 20000):
        for similarity in (0.7, 0.8, 0.95):
            common = int(round(2 * n * similarity / (1 + similarity)))
            for _ in range(20):
                values = rng.integers(1, 1 << 63, 2 * n, dtype=np.uint64)
                a, b = values[:n], np.concatenate([values[:common], values[n:2 * n - common]])
                x, y = near_dup.odd_sketch(a), near_dup.odd_sketch(b)
                differ = int(np.bitwise_count((x ^ y).view(np.uint64)).sum())
                true = common / (2 * n - common)
                assert near_dup.differing_bits(2.0 * n, -5, similarity=true) <= differ \
                    <= near_dup.differing_bits(2.0 * n, 5, similarity=true)
