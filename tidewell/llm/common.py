"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import os
import re
from pathlib import Path

import numpy as np
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.session import fresh_dir

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Runs of ASCII letters, digits and anything beyond ASCII; all else separates words.
ALNUM_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# As bytes: separators become blanks and A-Z becomes a-z, so that split() gives the words.
ALNUM_TABLE = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32
    for c in range(256))
# Words between blanks: only A-Z changes; bytes.split() already splits at 09-0D and 20.
BLANK_TABLE = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def stage(df: DataFrame, label: str) -> DataFrame:
    """``df`` written below the shared folder and read back, so its lineage ends there."""
    spark = df.sparkSession
    path = fresh_dir(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def importable(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it, and bound their memory.

    Enough for local runs and clusters that share or install the code; others pass ``--py-files``.
    Texts are long, so a worker gets at most a thousand at once, and no more than 4 MB unless a
    single row is longer.
    """
    batch, limit = "spark.sql.execution.arrow.maxRecordsPerBatch", 4 << 20
    if int(spark.conf.get(batch)) > 1000:
        spark.conf.set(batch, "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(limit))
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    known = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in known:
        env["PYTHONPATH"] = os.pathsep.join([root, *known])


_KEPT: dict = {}


def kept(key, make):
    """What a Python worker keeps from task to task: one thing only, made when its key is new."""
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = make()
    return _KEPT[key]


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def filesystem(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a path or address, and the path in it."""
    if re.match(r"\w+:", path):
        return pyarrow.fs.FileSystem.from_uri(path)
    return pyarrow.fs.LocalFileSystem(), path


def ascii_lower(text: Column) -> Column:
    """A-Z as a-z, all else as it is: the plain ``lower`` where the text is pure ASCII."""
    return (F.when(F.octet_length(text) == F.length(text), F.lower(text))
            .otherwise(F.translate(text, UPPER, LOWER)))


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4; rows with remainder 2 are held out of learning."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4


def hash_sample(rows: DataFrame, n: int, *key: str) -> DataFrame:
    """All rows if they are at most ``n``, else about ``n`` and never more, chosen by a hash."""
    total = rows.count()
    if total <= n:
        return rows
    # three deviations below n, so that the limit hardly ever has to choose
    share = max(n - 3 * n ** 0.5, 1) / total
    return rows.where(F.pmod(F.xxhash64(*key), F.lit(1 << 40)) < int(share * (1 << 40))).limit(n)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int) -> DataFrame:
    """(text, y) of at most ``rows`` labelled rows of the training folds, staged.

    Rows without a label, an id or a document are left out; a repeated row counts as it occurs.
    """
    known = (labels.select("doc_id", F.col(label).cast("int").alias("y"))
             .where(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull()
                    & (fold(F.col("doc_id")) != 2)))
    chosen = hash_sample(known, rows, "doc_id")
    # one side is at most `rows` small rows
    return stage(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
                 .select("text", "y"), "labelled")


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Weights of a logistic regression on the columns of ``x`` and a constant, by Newton steps."""
    a = np.column_stack([x, np.ones(len(y))])
    w = np.zeros(a.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        hessian = (a * (p * (1 - p))[:, None]).T @ a + ridge * np.eye(len(w))
        step = np.linalg.solve(hessian, a.T @ (y - p) - ridge * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def logistic(t: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(t, -30, 30)))
