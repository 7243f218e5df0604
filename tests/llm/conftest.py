import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

LONG = "\n".join(f"Line {i % 37} of a very long text, word{i} follows word{i * 7 % 101}."
                 for i in range(6000))
SHARED = "This very line stands in many of the documents."
PAGE = "<html>WARC/1.0\r\nContent-Length: 5\r\n\r\nabcde\r\n\r\nWARC/1.0\r\nnothing</html>" * 3

# null, empty, blank, tied, repeated, odd white space, long
TEXTS = [None, "", " \t\n ", "one", "One two", "one two", SHARED, "  " + SHARED.upper() + "\t\nend",
         SHARED + "\nsecond\n" + SHARED, "a  b\n\n c d \n e f <|endoftext|>  g\r\n",
         "Café İstanbul ΣΣ naïve é \U0001f600",
         "it's under the MIT License, or the Apache License; GNU General Public License too "
         "mit license", "SPDX-License-Identifier: Apache-2.0. All rights reserved. Unlicense",
         "licensed under the terms of the Apache License, Version 2.0", LONG, LONG + " end"]


@pytest.fixture(scope="session")
def odd_texts():
    return list(enumerate(TEXTS))


@pytest.fixture
def tables(spark, tmp_path):
    """Writes tables to a folder of their own and returns it."""
    def write(**frames):
        for name, (rows, schema) in frames.items():
            spark.createDataFrame(rows, schema).repartition(3).write.parquet(
                f"{tmp_path}/{name}.parquet")
        return str(tmp_path)
    return write


# more columns than an operator knows, with names that operators use themselves
DOCS = ("doc_id long, text string, lang string, source string, n_chars long, n_words string, "
        "version string, label string, ids string, start string, `words` string, component_id string")


@pytest.fixture
def odd_docs(tables, odd_texts):
    rows = [(i, t, None, None, None, "x", "x", "x", "x", "x", "x", "x") for i, t in odd_texts]
    items = [("a", "Under the terms of the Apache License"), ("b", None), ("c", ""),
             ("d", "word1 follows word7. Line 2 of a very long text, word2 follows word14 and on"),
             ("e", "one"), ("f", "Line 3 of a very long text, word3 follows word21.")]
    labels = [(i, i % 2, (i + 1) % 2) for i in range(13)] + [(None, 1, 1), (3, None, None)]
    pages = [(0, "u", None), (1, "u", ""), (2, None, "short"), (3, "u", "short"), (9, "u", PAGE),
             (4, "u", PAGE), (7, "u", PAGE), (5, "u", "x" * 100), (6, "u", "x" * 100),
             (8, "u", LONG), (10, "u", "é" * 50)]
    return tables(documents=(rows, DOCS), benchmark=(items, "item_id string, text string"),
                  labels=(labels, "doc_id long, quality long, toxic long"),
                  pages=(pages, "page_id long, url string, html string"))


@pytest.fixture
def no_docs(tables):
    return tables(documents=([], DOCS), benchmark=([], "item_id string, text string"),
                  labels=([], "doc_id long, quality long, toxic long"),
                  pages=([], "page_id long, url string, html string"),
                  embeddings=([], "vec_id long, embedding array<float>, label int"))
