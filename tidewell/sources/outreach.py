"""Outreach campaigns: roster joined to engagement counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.aggregate import first_positive

# Status codes, and the counter names sources use, best first.
STATUS_CODES = {0: "draft", 1: "active", 2: "paused", 3: "completed", 4: "stopped"}
DAILY_KEYS = {
    "contacted": ["sent", "emails_sent", "sent_count", "contacted"],
    "opened": ["unique_opened", "opened", "opens", "leads_who_read"],
    "replied": ["replies", "unique_replies", "replied", "leads_who_replied"],
    "total_leads": ["new_leads_contacted", "total_leads", "leads"],
    "bounced": ["bounced", "bounces"],
}
ANALYTICS_KEYS = {
    "contacted": ["contacted_count"],
    "opened": ["open_count_unique", "open_count"],
    "replied": ["reply_count_unique", "reply_count"],
    "total_leads": ["leads_count", "total_leads", "lead_count"],
    "bounced": ["bounced_count"],
}


def status_name(c: Column, dtype: T.DataType) -> Column:
    """Numeric codes by the list (unknown is draft), text in lower case."""
    if isinstance(dtype, T.NumericType):
        out = F.lit("draft")
        for code, name in STATUS_CODES.items():
            out = F.when(c == code, F.lit(name)).otherwise(out)
        return out
    return F.lower(F.coalesce(c, F.lit("draft")))


def _rate(part: Column, base: Column) -> Column:
    return F.when(base > 0, F.round(part * 100.0 / base, 2)).otherwise(F.lit(0.0))


def engagement_rows(roster: DataFrame, analytics: DataFrame, range_start: str = "",
                    range_end: str = "", synced_at=None) -> DataFrame:
    """One row per campaign of the roster with counters, rates and stamps.

    The roster has campaign_id, name, status and maybe lead counts; analytics
    has one row per campaign_id and any of the known counter names.
    """
    known = {k for names in ANALYTICS_KEYS.values() for k in names}
    counters = analytics.select(
        F.col("campaign_id").alias("__id"),
        *[F.col(c).alias(f"__a_{c}") for c in analytics.columns if c in known])
    joined = roster.join(counters, roster["campaign_id"] == F.col("__id"), "left")

    def counter(name):
        options = [F.col(f"__a_{k}") for k in ANALYTICS_KEYS[name] if k in analytics.columns]
        options += [F.col(k) for k in ANALYTICS_KEYS[name]
                    if name == "total_leads" and k in roster.columns]
        return F.coalesce(*[o.cast("long") for o in options], F.lit(0).cast("long"))

    numbers = {n: counter(n) for n in ("total_leads", "contacted", "opened", "replied", "bounced")}
    stamp = F.current_timestamp() if synced_at is None else F.lit(synced_at).cast("timestamp")
    return joined.select(
        F.col("campaign_id").cast("string").alias("campaign_id"),
        F.coalesce("name", F.lit("")).alias("name"),
        status_name(F.col("status"), roster.schema["status"].dataType).alias("status"),
        *[c.alias(n) for n, c in numbers.items()]).select(
        "*", _rate(F.col("opened"), F.col("contacted")).alias("open_rate"),
        _rate(F.col("replied"), F.col("contacted")).alias("reply_rate"),
        F.lit(range_start).alias("range_start"), F.lit(range_end).alias("range_end"),
        F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("synced_at"))


def fraction_rates(counters: DataFrame) -> DataFrame:
    """Rates as fractions of sent mails, 0 when nothing was sent."""
    def fraction(c):
        return F.when(F.col("emails_sent") > 0, F.col(c) / F.col("emails_sent")).otherwise(
            F.lit(0.0))

    return counters.select("*", fraction("emails_opened").alias("open_rate"),
                           fraction("emails_replied").alias("reply_rate"),
                           fraction("emails_bounced").alias("bounce_rate"))


def daily_rollup(daily: DataFrame) -> DataFrame:
    """Daily counter rows as one row per campaign.

    Each row gives, per counter, the first positive value among its known names.
    """
    def total(name):
        options = [F.col(k) for k in DAILY_KEYS[name] if k in daily.columns]
        return F.sum(first_positive(*options)) if options else F.lit(0)

    return daily.groupBy("campaign_id").agg(
        *[total(name).cast("double").alias(name) for name in DAILY_KEYS])
