"""Each stage against plain Python, on its own input."""

import brute
import corpus_pipeline
import pyarrow.parquet as pq
import pytest
from conftest import SF

from tidewell.llm import toxicity
from tidewell.llm.common import stage


def plain(df):
    return sorted((r["doc_id"], r["text"]) for r in df.collect())


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def work(name):
    return dict(corpus_pipeline.STAGES)[name]


def test_toxic_documents_go(spark, documents):
    kept = {d for d, _ in plain(work("toxicity")(spark, documents, SF))}
    model = toxicity.fit(documents, spark.read.parquet(f"{SF}/labels.parquet"))
    scores = {r["doc_id"]: r["score"] for r in toxicity.scan(documents, model).collect()}
    assert kept == {d for d, s in scores.items() if s < 0.3}


def test_shared_lines_go(spark, documents):
    out = plain(work("line_dedup")(spark, documents, SF))
    expected = brute.line_rows(plain(documents))
    assert {d: brute.hashlib.sha256((t or "").encode()).hexdigest() for d, t in out} == {
        d: r[2] for d, r in expected.items()}


def test_one_near_duplicate_stays(spark, documents):
    out = plain(work("near_duplicates")(spark, documents, SF))
    expected = brute.near_rows(plain(documents))
    assert out == [x for x in plain(documents) if expected[x[0]][2]]


def test_no_benchmark_window_stays(spark, documents):
    items = pq.read_table(f"{SF}/benchmark.parquet").to_pylist()
    items = [(r["item_id"], r["text"]) for r in items]
    before = brute.leak_rows(plain(documents), items)
    out = plain(work("decontamination")(spark, documents, SF))
    assert any(r[4] for r in before.values())
    assert not any(r[4] for r in brute.leak_rows(out, items).values())
    clean = [x for x in plain(documents) if not before[x[0]][4]]
    assert [x for x in out if not before[x[0]][4]] == clean


def test_run(spark, documents):
    docs = documents
    for name, function in corpus_pipeline.STAGES[:-1]:
        docs = stage(function(spark, docs, SF), "test")
        assert docs.columns == corpus_pipeline.COLUMNS
    out = [r.asDict() for r in corpus_pipeline.run(spark, SF).collect()]
    brute.check_packing(plain(docs), out)


def test_empty(spark, no_docs):
    assert corpus_pipeline.run(spark, no_docs).collect() == []


def test_odd_rows(spark, odd_docs, odd_texts):
    """Every stage takes odd rows; without labels nothing counts as toxic."""
    docs = spark.read.parquet(f"{odd_docs}/documents.parquet")
    for name, function in corpus_pipeline.STAGES[1:]:
        docs = stage(function(spark, docs, odd_docs), "test")
    kept = {r["doc_id"] for r in docs.collect()}
    assert kept <= {d for d, _ in odd_texts} and 14 in kept and 15 not in kept
    assert toxicity.keep_clean(spark.read.parquet(f"{odd_docs}/documents.parquet"),
                               toxicity.Model({})).count() == len(odd_texts)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_repeated_rows_null_ids_and_clashing_columns(spark, tables, name):
    """Each stage by itself on rows that repeat, rows without an id, ties, and columns it uses itself."""
    clean = " ".join(f"word{i} and more" for i in range(60))
    rows = [(1, clean, "x"), (1, clean, "x"), (2, f"{clean} again", "x"), (None, "a text of no document", "x"),
            (None, "a text of no document", "x"), (3, None, "x"), (4, "", "x"), (5, "kept " * 3, "x")]
    columns = ("doc_id long, text string, version string, lang string, source string, n_chars long, label string, "
               "component string, group string")
    path = tables(documents=([(d, t, v, None, None, None, v, v, v) for d, t, v in rows], columns),
                  benchmark=([("a", "nothing of this occurs anywhere")], "item_id string, text string"),
                  labels=([(1, 1, 0), (1, 1, 0), (None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int"))
    docs = spark.read.parquet(f"{path}/documents.parquet")
    out = [r.asDict() for r in work(name)(spark, docs, path).collect()]
    if name == "packing":
        assert len(out) == len(rows) and sum(r["length"] for r in out) > len(rows)
        return
    assert all(set(r) == set(corpus_pipeline.COLUMNS) for r in out)
    got = sorted(((r["doc_id"] or 99, r["text"] or "") for r in out), key=str)
    every = sorted(((d or 99, t or "") for d, t, _ in rows), key=str)
    if name == "near_duplicates":       # one of the rows 1 and 2 stays, everything else does
        every = [r for r in every if r[0] not in (1, 2)]
        assert [r for r in got if r[0] in (1, 2)] == [(1, clean)]
        got = [r for r in got if r[0] != 1]
    assert got == every
