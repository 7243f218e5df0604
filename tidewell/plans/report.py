"""The set of questions a table's columns suggest, each as a lazy DataFrame."""

from __future__ import annotations

import re

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.casts import like_time, num, ref, ts
from ..functions.times import bucket, days, within
from ..operators.aggregate import (Metric, aggregate, comparison, measure, ranking, ratio_ranking,
                                   time_series, top_ratios, top_shares)
from ..operators.quality import aged, duplicate_check, excess, freshness
from .semantic import ColumnMeaning, classify_schema, default_aggregate

# Name shapes that steer the choice of questions.
RATIO_NAME = r"^(name|campaign_name|title|label)$"
RATIO_NAME_LOOSE = r"name|title|label"
REPLIED = r"^(replied|replies|reply_count)$"
CONTACTED = r"^(contacted|contact_count|sent)$"
OPENED = r"^(opened|opens|open_count)$"
ROW_KEY_STRICT = r"^(id|uuid|guid|_id|campaign_id|lead_id|email_id)$"
ROW_KEY_LOOSE = r"^(id|uuid|guid)$|_id$|_uuid$"
SERIES_DAYS = 90
SERIES_LIMIT = 180
TOP_MEMBERS = 12
TOP_RATIOS = 10


def _matches(pattern: str, m: ColumnMeaning) -> bool:
    return re.search(pattern, m.name, re.IGNORECASE) is not None


def _first(meanings, pattern):
    return next((m for m in meanings if _matches(pattern, m)), None)


class _Questions(dict):
    """Questions by key. One that cannot be built becomes an error entry."""

    def __init__(self):
        super().__init__()
        self.errors: dict[str, str] = {}

    def ask(self, key, build):
        try:
            self[key] = build()
        except Exception as e:  # one bad question must not cost the others
            self.errors[key] = str(e)


@dataclass(frozen=True)
class Question:
    """What is asked of which columns."""

    key: str
    kind: str
    column: str
    metric: Metric | None = None
    base: str | None = None         # denominator of a ratio
    days: int = 0

    def frame(self, df: DataFrame, as_of) -> DataFrame:
        """The answer from the table itself."""
        match self.kind:
            case "timeseries":
                return time_series(df, self.column, self.metric, "DAY", lookback_days=SERIES_DAYS,
                                   as_of=as_of)
            case "comparison":
                return comparison(df, self.column, self.metric, self.days, as_of=as_of)
            case "freshness":
                return freshness(df, self.column, as_of)
            case "ranking":
                return ranking(df, self.column, Metric(None, "COUNT_STAR"), top_n=TOP_MEMBERS)
            case "ratio":
                return ratio_ranking(df, self.column, self.metric.column, self.base, TOP_RATIOS)
            case "distribution":
                return aggregate(df, [Metric(self.column, "COUNT", "value")], self.column,
                                 limit=TOP_MEMBERS)
        return duplicate_check(df, self.column)


def _ratios(name_dims, metrics) -> list[Question]:
    name = _first(name_dims, RATIO_NAME) or _first(name_dims, RATIO_NAME_LOOSE)
    base = _first(metrics, CONTACTED)
    if name is None or base is None:
        return []
    parts = [(key, _first(metrics, pattern))
             for key, pattern in (("reply_rate", REPLIED), ("open_rate", OPENED))]
    return [Question(f"computed_rate:{key}:{name.name}", "ratio", name.name,
                     Metric(part.name, "SUM"), base.name) for key, part in parts if part]


def questions(meanings: list[ColumnMeaning], variant: str = "planner", max_charts: int = 12,
              window_days: int = 30) -> list[Question]:
    """What to ask of a table with these columns.

    ``planner`` ranks every usable dimension, compares the first metric over 30
    days and adds the split by status; ``route`` compares four metrics over
    ``window_days`` (1..365) and ranks three dimensions.
    """
    planner = variant == "planner"
    by_role = {role: [m for m in meanings if m.role == role]
               for role in ("time", "metric", "dimension", "identifier")}
    metrics, dims = by_role["metric"], by_role["dimension"]
    out: list[Question] = []
    if by_role["time"]:
        time = by_role["time"][0].name
        first = Metric(metrics[0].name, default_aggregate(metrics[0])) if metrics else None
        out.append(Question("timeseries", "timeseries", time, first))
        if planner and first:
            out.append(Question("comparison", "comparison", time, first, days=30))
        out.append(Question("freshness", "freshness", time))
        if not planner:
            if not 1 <= int(window_days) <= 365:
                raise ValueError(f"a window of {window_days!r} days")
            out += [Question(f"comparison:{m.name}", "comparison", time,
                             Metric(m.name, default_aggregate(m)), days=int(window_days))
                    for m in metrics[:4]]
    skip = ROW_KEY_STRICT if planner else ROW_KEY_LOOSE
    rankable = [d for d in dims if not _matches(skip, d)]
    out += [Question(f"ranking:{d.name}", "ranking", d.name)
            for d in rankable[:max(0, max_charts - len(out)) if planner else 3]]
    ratios = _ratios(dims if planner else rankable, metrics)
    out += ratios[:max(0, max_charts - len(out))] if planner else ratios
    if planner:
        status = next((m for m in meanings if m.cls == "status"), None)
        if status:
            out.append(Question(f"distribution:{status.name}", "distribution", status.name))
    # the primary key is the best candidate, then any identifier
    keys = [m for m in meanings if m.is_primary_key] + by_role["identifier"]
    if keys:
        out.append(Question("duplicates", "duplicates", keys[0].name))
    return out


def table_report(df: DataFrame, as_of=None, variant: str = "planner", max_charts: int = 12,
                 window_days: int = 30, overrides: dict[str, str] | None = None,
                 primary_keys: list[str] = (), staging: str | None = None) -> _Questions:
    """Answers for one table by question, as lazy frames.

    With ``staging``, a path, the table is read once: one grouped scan finds what all questions need
    and is written there, and the frames read it (see ``one_scan``).
    """
    asked = questions(classify_schema(df, overrides, primary_keys=primary_keys), variant,
                      max_charts, window_days)
    out = _Questions()
    if staging:
        return one_scan(df, asked, as_of, staging)
    for q in asked:
        out.ask(q.key, lambda q=q: q.frame(df, as_of))
    return out


def one_scan(df: DataFrame, asked: list[Question], as_of, staging: str) -> _Questions:
    """Answers to all questions from one scan with grouping sets, one set per grouped question.

    A set holds a row per member, which the frames split by grouping id; of the set that looks for
    duplicates only the repeated members are written.
    """
    grouped = [q for q in asked if q.kind in ("timeseries", "ranking", "ratio", "distribution",
                                              "duplicates")]
    keys, values = {}, [F.count(F.lit(1)).alias("n")]
    for i, q in enumerate(grouped):
        keys[f"k{i}"] = ref(df, q.column)
        if q.kind == "timeseries":
            when = ts(df, q.column)
            keys[f"k{i}"] = F.when(within(df, q.column, as_of, SERIES_DAYS), bucket(when, "day"))
    for i, q in enumerate(asked):
        if q.kind == "timeseries":
            values.append(measure(df, q.metric or Metric(None, "COUNT_STAR")).alias(f"v{i}"))
        elif q.kind == "ratio":
            values += [F.sum(num(df, q.metric.column)).alias(f"v{i}"),
                       F.sum(num(df, q.base)).alias(f"w{i}")]
        elif q.kind == "freshness":
            values.append(F.max(ts(df, q.column)).alias(f"v{i}"))
        elif q.kind == "comparison":
            when, now = ts(df, q.column), like_time(df, q.column, as_of)
            cut, prior = now - days(q.days), now - days(2 * q.days)
            values += [measure(df, q.metric, when >= cut).alias(f"v{i}"),
                       measure(df, q.metric, (when < cut) & (when >= prior)).alias(f"w{i}")]
    wide = df.select("*", *[c.alias(k) for k, c in keys.items()])
    rolled = wide.groupingSets([[F.col(k)] for k in keys] + [[]], *[F.col(k) for k in keys]).agg(
        F.grouping_id().alias("set"), *values)
    # bit i from the left is 0 where key i groups
    set_of = lambda i: (1 << len(keys)) - 1 - (1 << (len(keys) - 1 - i))
    kept = F.col("set") == (1 << len(keys)) - 1
    for i, q in enumerate(grouped):
        own = (F.col("set") == set_of(i)) & F.col(f"k{i}").isNotNull()
        kept = kept | (own & (F.col("n") > 1) if q.kind == "duplicates" else own)
    rolled.where(kept).write.parquet(staging)
    rows = df.sparkSession.read.parquet(staging)
    total = rows.where(F.col("set") == (1 << len(keys)) - 1)

    def answer(i: int, q: Question) -> DataFrame:
        v, w = F.col(f"v{i}"), F.col(f"w{i}")
        if q.kind == "comparison":
            return total.select(v.alias("current_value"), w.alias("previous_value"))
        if q.kind == "freshness":
            return aged(total.select(v.alias("latest"), F.col("n").alias("total_rows")),
                        like_time(df, q.column, as_of))
        k = grouped.index(q)
        own, key = rows.where(F.col("set") == set_of(k)), F.col(f"k{k}")
        if q.kind == "timeseries":
            return own.select(key.alias("bucket"), v.alias("value")).orderBy("bucket").limit(
                SERIES_LIMIT)
        if q.kind == "ratio":
            return top_ratios(own.select(key.alias("dimension"), v.alias("num"), w.alias("den")),
                              TOP_RATIOS)
        if q.kind == "duplicates":
            return excess(own)
        members = own.select(key.alias("dimension"), F.col("n").alias("value"))
        if q.kind == "ranking":
            return top_shares(members, TOP_MEMBERS)
        return members.orderBy(F.desc("value"), F.asc("dimension")).limit(TOP_MEMBERS)

    out = _Questions()
    for i, q in enumerate(asked):
        out.ask(q.key, lambda i=i, q=q: answer(i, q))
    return out
