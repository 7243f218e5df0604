"""Tolerant casts, buckets, filters, labels, formats."""

import datetime as dt

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewell.functions import casts, text, times
from tidewell.functions.filters import Filter, search, where, widget_where


def test_numbers_from_text(frame):
    values = ["1.5", " 12 ", "-3", ".5", "5.", "1e3", "1.5d", "NaN", "2024-01-01", "", "x", None]
    df = frame([(v,) for v in values], "v string")
    got = [r[0] for r in df.select(casts.num(df, "v")).collect()]
    assert got == [1.5, 12.0, -3.0, 0.5, 5.0, 1000.0, None, None, None, None, None, None]


def test_times_from_text(frame):
    values = ["2024-01-02", "2024-01-02T03:04:05Z", "2024-01-02 03:04:05", "2024", "01/02/2024",
              "2024-13-45", "", None]
    df = frame([(v,) for v in values], "v string")
    got = [r[0] for r in df.select(casts.ts(df, "v").cast("string")).collect()]
    assert got == ["2024-01-02 00:00:00", "2024-01-02 03:04:05", "2024-01-02 03:04:05",
                   None, None, None, None, None]


def test_wrong_kinds_are_errors(frame):
    df = frame([(dt.datetime(2024, 1, 1), 1)], "t timestamp, n int")
    with pytest.raises(TypeError):
        casts.num(df, "t")
    with pytest.raises(TypeError):
        casts.ts(df, "n")
    with pytest.raises(ValueError):
        casts.num(df, "no_such")


def test_week_starts_on_sunday(frame):
    # 2024-01-07 is a Sunday, 2024-01-08 a Monday, 2024-01-06 a Saturday
    df = frame([("2024-01-06",), ("2024-01-07",), ("2024-01-08",)], "d string")
    got = [str(r[0]) for r in df.select(times.bucket(F.to_date("d"), "week")).collect()]
    assert got == ["2023-12-31", "2024-01-07", "2024-01-07"]


@pytest.mark.parametrize("grain,expected", [("day", "2024-08-17"), ("month", "2024-08-01"),
                                            ("quarter", "2024-07-01"), ("year", "2024-01-01")])
def test_other_buckets(frame, grain, expected):
    df = frame([("2024-08-17",)], "d string")
    assert str(df.select(times.bucket(F.to_date("d"), grain)).first()[0]) == expected


def test_lag_hours_truncates(frame):
    df = frame([("2024-01-01 00:00:01",)], "t string").select(F.to_timestamp("t").alias("t"))
    got = df.select(times.lag_hours(F.col("t"), F.lit("2024-01-01 03:00:00").cast("timestamp")))
    assert got.first()[0] == 2


def test_next_run(frame):
    names = ["every_15m", "every_15min", "every_hour", "daily", "every_week", "manual", "never"]
    df = frame([(n,) for n in names], "s string")
    start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    got = [str(r[0]) for r in df.select(times.next_run(F.col("s"), start)).collect()]
    assert got == ["2024-01-01 00:15:00", "2024-01-01 00:15:00", "2024-01-01 01:00:00",
                   "2024-01-02 00:00:00", "2024-01-08 00:00:00", "None", "None"]


def test_month_first(frame):
    df = frame([("2024-01-31",), ("31.01.2024",)], "d string")
    assert [r[0] for r in df.select(times.month_first(F.col("d"))).collect()] == [
        "01-31-2024", "31.01.2024"]


def test_lookback_is_clamped():
    assert times.clamp_days(10 ** 6) == 3650 and times.clamp_days(0) == 1


def test_filters(frame):
    df = frame([(1, "ab"), (2, "Ab"), (3, None)], "n int, s string")

    def ids(*filters):
        return sorted(r["n"] for r in where(df, filters).collect())

    assert ids(Filter("n", "IN", [])) == [1, 2, 3]       # an empty list is no filter
    assert ids(Filter("n", "IN", 2)) == [2]              # a scalar is a list of one
    assert ids(Filter("s", "LIKE", "a%")) == [1]         # case counts
    assert ids(Filter("n", "LIKE", "3")) == [3]
    assert ids(Filter("s", "IS NULL")) == [3]
    assert ids(Filter("s", "!=", "ab")) == [2]
    assert ids(Filter("n", ">", 1), Filter("n", "<=", 2)) == [2]
    with pytest.raises(ValueError):
        where(df, [Filter("x; drop", "=", 1)])
    with pytest.raises(ValueError):
        where(df, [Filter("n", "~", 1)])


def test_widget_filters(frame):
    df = frame([(1, "50% off"), (2, "500 off")], "n int, s string")

    def ids(*filters):
        return sorted(r["n"] for r in widget_where(df, list(filters)).collect())

    assert ids(Filter("s", "contains", "50% OFF")) == [1]  # % is a plain character
    assert ids(Filter("s", "in", [])) == [1, 2]
    assert ids(Filter("unsafe name", "eq", 1)) == [1, 2]
    assert ids(Filter("n", "gte", 2)) == [2]


def test_search(frame):
    df = frame([(1, "Sales", "x", "a"), (2, "other", "SALES", "a"), (3, "sales", "", "b")],
               "id int, name string, note string, kind string")
    got = search(df, "sales", ["name", "note"], "id", {"kind": "a"}).collect()
    assert [r["id"] for r in got] == [2, 1]


@pytest.mark.parametrize("name,label", [
    ("total_price", "Total Price"), ("unitCost", "Unit Cost"), ("a-b__c", "A B C"),
    ("_id", "Id"), ("2nd_item", "2nd Item")])
def test_labels(frame, name, label):
    assert text.label(name) == label
    df = frame([(name,)], "n string")
    assert df.select(text.label_col(F.col("n"))).first()[0] == label


def test_safe_names():
    assert text.safe_names(["a-b", "a_b", "1x", "", "ok"]) == ["a_b", "a_b_2", "_1x", "field",
                                                               "ok"]


@given(st.lists(st.text(max_size=140), max_size=8))
def test_safe_names_are_stable(names):
    once = text.safe_names(names)
    assert text.safe_names(once) == once
    assert len({n.lower() for n in once}) == len(once)
    assert all(len(n) <= 128 for n in once)


def test_slug_and_display_name():
    assert text.slug("kpi", "Order ID!") == "kpi:order-id"
    assert text.display_name("Order ID", 1) == "order_id"
    assert text.display_name("###", 3) == "column_3"


def test_tokens(frame):
    df = frame([("Show the TOP customers, by region-2 at sales sales",)], "q string")
    assert df.select(text.tokens(F.col("q"))).first()[0] == ["customers", "region", "sales",
                                                             "sales"]


def test_formats(frame):
    df = frame([(0,), (1,), (1023,), (1024,), (1536,), (1048576,), (5 * 1024 ** 3,)], "n bigint")
    got = [r[0] for r in df.select(text.format_bytes(F.col("n"))).collect()]
    assert got == ["0 B", "1 B", "1023 B", "1 KB", "1.5 KB", "1 MB", "5 GB"]
    df = frame([(999,), (1000,), (2_500_000,)], "n bigint")
    assert [r[0] for r in df.select(text.format_count(F.col("n"))).collect()] == [
        "999", "1.0K", "2.5M"]
    df = frame([(999,), (1000,), (200_000,)], "n bigint")
    assert [r[0] for r in df.select(text.format_duration(F.col("n"))).collect()] == [
        "999ms", "1.0s", "3m 20s"]
    df = frame([(59,), (61,), (7300,)], "n bigint")
    assert [r[0] for r in df.select(text.format_seconds(F.col("n"))).collect()] == [
        "59s", "1m 1s", "2h 1m"]


def test_relative_times(frame):
    now = F.lit("2024-01-10 00:00:00").cast("timestamp_ntz")
    df = frame([("2024-01-09 23:59:30",), ("2024-01-09 23:55:00",), ("2024-01-09 20:00:00",),
                ("2024-01-07 00:00:00",), ("2024-01-10 02:00:00",)], "t string")
    at = F.col("t").cast("timestamp_ntz")
    ago = [r[0] for r in df.select(text.format_ago(at, now)).collect()]
    assert ago[:4] == ["just now", "5m ago", "4h ago", "3d ago"]
    until = [r[0] for r in df.select(text.format_until(at, now)).collect()]
    assert until[0] == "now" and until[4] == "in 2h"


def test_formats_round_ties_up(spark):
    row = spark.range(1).select(F.lit(1280).cast("long").alias("n")).select(
        text.format_bytes(F.col("n")).alias("b"), text.format_count(F.lit(1250)).alias("c")).first()
    assert (row["b"], row["c"]) == ("1.3 KB", "1.3K")
