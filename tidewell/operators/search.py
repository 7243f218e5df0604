"""Ranking of named things against questions.

A token matches a name when it is part of it. Tokens hold letters and digits
only, so each match lies inside one such run of the name; parts of the runs
become keys and the match is an equi join of distinct tokens on them.

Questions and names are never paired up. Names that match the same tokens with the same weights get
equal scores from every question, and questions that use the same tokens equally often rank names
equally. So both are collapsed to their sets of matched tokens, sets are scored once per pair that
shares a token, and of the names of a set, which tie, the first ``n`` are enough. A word that all
names hold costs as much as there are different sets, not names times questions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens
from .joins import latest_n_per_key

# Weights and result sizes.
TABLE_WEIGHT, COLUMN_WEIGHT, MODEL_WEIGHT = 3, 1, 2
MAX_TABLES, MAX_MODELS = 8, 4
MIN_TOKEN = 3
LONG_RUN = 48


def _runs(name: Column) -> Column:
    return F.filter(F.regexp_extract_all(F.lower(name), F.lit("([a-z0-9]+)"), 1),
                    lambda r: F.length(r) >= MIN_TOKEN)


def _parts(run: Column) -> Column:
    """All substrings of at least three characters of a run."""
    return F.array_distinct(F.flatten(F.transform(
        F.sequence(F.lit(1), F.length(run) - MIN_TOKEN + 1),
        lambda start: F.transform(
            F.sequence(F.lit(MIN_TOKEN), F.length(run) - start + 1),
            lambda size: run.substr(start, size)))))


def _grams(run: Column) -> Column:
    """All three-character pieces of a run."""
    return F.array_distinct(F.transform(
        F.sequence(F.lit(1), F.length(run) - MIN_TOKEN + 1),
        lambda start: run.substr(start, F.lit(MIN_TOKEN))))


def match_names(vocabulary: DataFrame, names: DataFrame) -> DataFrame:
    """Distinct tokens against (entity, text, weight): token, entity, best weight.

    Runs of usual length are met by all their parts. A longer run is met by its
    three-character pieces and then checked, so its index stays linear in size.
    """
    runs = names.select("entity", "weight", F.explode(_runs(F.col("text"))).alias("run")).groupBy(
        "entity", "run").agg(F.max("weight").alias("weight"))
    usual = F.length("run") <= LONG_RUN
    short = (runs.where(usual).select("entity", "weight", F.explode(_parts(F.col("run")))
                                      .alias("token")).join(vocabulary, "token"))
    pieces = runs.where(~usual).select("entity", "weight", "run",
                                       F.explode(_grams(F.col("run"))).alias("piece"))
    long = (vocabulary.withColumn("piece", F.substring("token", 1, MIN_TOKEN))
            .join(pieces, "piece").where(F.contains("run", "token")))
    return (short.select("token", "entity", "weight")
            .unionByName(long.select("token", "entity", "weight"))
            .groupBy("token", "entity").agg(F.max("weight").alias("weight")))


def table_names(columns: DataFrame) -> DataFrame:
    """Searchable names of a column catalog: table names weigh more than columns."""
    tables = columns.select(F.col("table_name").alias("entity"), F.col("table_name").alias("text"),
                            F.lit(TABLE_WEIGHT).alias("weight")).distinct()
    cols = columns.select(F.col("table_name").alias("entity"), F.col("column_name").alias("text"),
                          F.lit(COLUMN_WEIGHT).alias("weight"))
    return tables.unionByName(cols)


def model_names(models: DataFrame) -> DataFrame:
    """Searchable text of models (name, description)."""
    both = F.concat_ws(" ", "name", "description")
    return models.select(F.col("name").alias("entity"), both.alias("text"),
                         F.lit(MODEL_WEIGHT).alias("weight"))


def _token_set(value: str) -> list[Column]:
    """What a name or question matches, and a name for it: equal for equal sets only."""
    pairs = F.sort_array(F.collect_list(F.struct("token", value)))
    return [pairs.alias("tokens"), F.sha2(F.to_json(pairs), 256).alias("set")]


def search(questions: DataFrame, names: DataFrame, n: int, id_col: str = "question_id",
           text_col: str = "text", fallback: bool = False) -> DataFrame:
    """Best ``n`` entities per question with their score.

    Each use of a token counts. With ``fallback``, a question that matches
    nothing gets the first ``n`` entities by name with score 0.
    """
    used = (questions.select(F.col(id_col).alias("question_id"),
                             F.explode(tokens(F.col(text_col))).alias("token"))
            .groupBy("question_id", "token").agg(F.count(F.lit(1)).alias("uses")))
    index = match_names(used.select("token").distinct(), names)
    # tokens that match no name do not tell questions apart
    known = used.join(index.select("token").distinct(), "token", "left_semi")
    asking = known.groupBy("question_id").agg(*_token_set("uses"))
    asked = asking.groupBy("set").agg(F.first("tokens").alias("tokens")).select(
        F.col("set").alias("asked"), F.inline("tokens").alias("token", "uses"))
    named = index.groupBy("entity").agg(*_token_set("weight"))
    matched = named.groupBy("set").agg(F.first("tokens").alias("tokens")).select(
        F.col("set").alias("matched"), F.inline("tokens").alias("token", "weight"))
    scored = (asked.join(matched, "token").groupBy("asked", "matched")
              .agg(F.sum(F.col("uses") * F.col("weight")).alias("score")))
    firsts = latest_n_per_key(named.select(F.col("set").alias("matched"), "entity"), ["matched"],
                              [F.asc("entity")], n, spread_by=["entity"]).drop("rn")
    best = Window.partitionBy("asked").orderBy(F.desc("score"), "entity")
    ranked = (scored.join(firsts, "matched").withColumn("position", F.row_number().over(best))
              .where(F.col("position") <= n).select("asked", "entity", "score", "position"))
    top = (asking.select("question_id", F.col("set").alias("asked")).join(ranked, "asked")
           .select("question_id", "entity", "score", "position"))
    if not fallback:
        return top
    first = (names.select("entity").distinct().orderBy("entity").limit(n)
             .agg(F.sort_array(F.collect_list("entity"))).scalar())
    silent = questions.select(F.col(id_col).alias("question_id")).join(
        asking.select("question_id"), "question_id", "left_anti")
    filler = silent.select("question_id", F.posexplode(first).alias("p", "entity")).select(
        "question_id", "entity", F.lit(0).cast("long").alias("score"),
        (F.col("p") + 1).alias("position"))
    return top.unionByName(filler)
