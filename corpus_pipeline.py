"""Clean a corpus for training: each stage works on all that the stage before it kept.

``run`` writes what a stage returns as Parquet in the shared folder and reads it for the next one.

Nulls and edges. A stage takes the columns of documents, whatever others there are, and all but the
last return these, ``n_chars`` as the text then has it; other columns are dropped. A null or empty
text is never toxic by a word, is one empty line, has no shingles and no benchmark words, and packs
as its end id. Rows without an id are kept by every stage; they are judged and packed like others,
except that they are near duplicates of nothing and keep their lines where all holders lack an id.
Repeated rows get equal results: they all go or stay as toxic or contaminated, lose the same lines
(as one document), and are packed as often as they occur, but of near duplicates one row stays, so
of equal rows with words and an id one is left. Ties go to the smaller id, for lines to the larger.
Empty tables give no rows. Without labels of both kinds nothing is toxic.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm import decontaminate, line_dedup, near_dup, packing, toxicity
from tidewell.llm.common import importable, stage

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _documents(docs: DataFrame) -> DataFrame:
    """The columns of documents, with n_chars as the text has them now."""
    return docs.select("doc_id", "text", "lang", "source",
                       F.length("text").cast("long").alias("n_chars"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is below 0.3, by a model of their labelled ones."""
    importable(spark)
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels"))
    return toxicity.keep_clean(docs.select(*COLUMNS), model)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that a later document holds too."""
    return _documents(line_dedup.drop_shared_lines(docs.select(*COLUMNS)))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    importable(spark)
    return near_dup.keep_one(docs.select(*COLUMNS))


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages; mostly contaminated ones go."""
    paths = decontaminate.build(_table(spark, sf_dir, "benchmark"))
    return _documents(decontaminate.clean(docs.select(*COLUMNS), paths))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of 1024 tokens."""
    importable(spark)
    rows = packing.pieces(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return packing.places(stage(packing.sequences(rows), "sequences"))


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_lines),
          ("near_duplicates", drop_near_duplicates), ("decontamination", drop_benchmark),
          ("packing", pack)]

# learned scores and token ids are beyond SQL; tests compare with plain Python instead
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for name, work in STAGES[:-1]:
        docs = stage(work(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
