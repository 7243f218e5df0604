"""Aggregates, rankings, profiles, order statistics, joins, telemetry."""

import math
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tidewell.operators import telemetry as T
from tidewell.operators.aggregate import (Metric, aggregate, comparison, pattern_buckets, ranking,
                                          ratio_ranking, time_series, widget)
from tidewell.operators.insights import (active_insights, insights, outliers, quintile_trend,
                                         recommendations)
from tidewell.operators.joins import (count_children, latest_n_per_key, latest_snapshot,
                                      only_owned, schema_diff)
from tidewell.operators.order_stats import at_fraction, at_place, cuts, positions
from tidewell.operators.ordered import changes, slices, sortable
from tidewell.operators.profile import classify_values, column_profile, numeric_stats
from tidewell.operators.quality import duplicate_check, freshness, table_health


def rows(df, *names):
    return [tuple(r[n] for n in names) if len(names) > 1 else r[names[0]] for r in df.collect()]


def stamp(text):
    return F.lit(text).cast("timestamp")


def test_aggregate_needs_a_metric_and_drops_null_groups(frame):
    df = frame([("a", "1"), ("a", "x"), (None, "9"), ("b", "4")], "k string, v string")
    with pytest.raises(ValueError):
        aggregate(df, [])
    out = aggregate(df, [Metric("v", "SUM", "total")], "k")
    assert rows(out, "dimension", "total") == [("b", 4.0), ("a", 1.0)]


def test_exact_sum_keeps_decimals(frame):
    df = frame([("0.10",), ("0.20",)], "t string").select(F.col("t").cast("decimal(10,2)")
                                                         .alias("d"))
    exact = aggregate(df, [Metric("d", "SUM", "s", exact=True)]).first()[0]
    assert str(exact) == "0.30"


def test_time_series_keeps_the_oldest_buckets(frame):
    df = frame([("2024-01-03",), ("2024-01-01",), ("2024-01-02",), ("bad",)], "d string")
    out = time_series(df, "d", limit=2)
    assert [str(r["bucket"]) for r in out.collect()] == ["2024-01-01", "2024-01-02"]


def test_ranking_ties_and_shares(frame):
    df = frame([("a", 5.0), ("b", 5.0), ("c", 2.0), (None, 88.0)], "k string, v double")
    out = ranking(df, "k", Metric("v", "SUM"))
    assert rows(out, "dimension", "rank") == [("a", 1), ("b", 1), ("c", 3)]
    assert math.isclose(sum(rows(out, "share_pct")), 100.0)
    # the total covers members beyond the limit
    top = ranking(df, "k", Metric("v", "SUM"), top_n=1).collect()
    assert math.isclose(top[0]["share_pct"], 500 / 12)


def test_ranking_of_zero_total(frame):
    df = frame([("a", 0.0), ("b", 0.0)], "k string, v double")
    assert rows(ranking(df, "k", Metric("v", "SUM")), "share_pct") == [None, None]


def test_ratio_ranking_skips_zero_denominators(frame):
    df = frame([("a", 1, 4), ("b", 1, 0), (None, 9, 9)], "k string, n int, d int")
    assert rows(ratio_ranking(df, "k", "n", "d"), "dimension", "value", "share_pct") == [
        ("a", 25.0, 100.0)]


def test_comparison_has_no_upper_bound(frame):
    df = frame([("2024-01-05", 1.0), ("2024-02-05", 2.0), ("2023-12-25", 4.0),
                ("2023-01-01", 8.0)], "d string, v double")
    out = comparison(df, "d", Metric("v", "SUM"), 10, as_of="2024-01-10 00:00:00").first()
    assert (out["current_value"], out["previous_value"]) == (3.0, 4.0)


def test_widget_forms(frame):
    df = frame([("a", "x", 1.0), ("a", "y", 2.0), ("b", "x", 5.0)], "k string, j string, v double")
    assert rows(widget(df, "v", "sum", "k", top_n=1), "k", "value") == [("b", 5.0)]
    assert rows(widget(df, "v", "sum", "k", sort_dir="asc"), "value") == [3.0, 5.0]
    assert len(widget(df, "v", "max", "k", "j").collect()) == 3
    assert widget(df, "v", "avg").first()["value"] == pytest.approx(8 / 3)
    assert rows(widget(df, "v", "top", top_n=2, columns=["v"]), "v") == [5.0, 2.0]


def test_pattern_buckets(frame):
    df = frame([("(WB 12) a", 3), ("wb b", 4), ("zzz", 5), ("WB", 0), (None, 1)],
               "name string, n int")
    out = pattern_buckets(df, "name", "n", r"(?i)\b(wb|ibk)\b")
    assert rows(out, "name", "value") == [("WB", 7.0), ("Other", 6.0)]


def test_profile_of_nulls_and_empty(frame):
    df = frame([(None, "a"), (None, "a"), (None, None)], "n double, s string")
    got = {r["column"]: r.asDict() for r in column_profile(df).collect()}
    assert got["n"]["nulls"] == 3 and got["n"]["distinct"] == 0 and got["n"]["avg"] is None
    assert got["s"] == {"column": "s", "total_rows": 3, "nulls": 1, "distinct": 1, "min": None,
                        "max": None, "avg": None, "negatives": None}
    empty = column_profile(df.limit(0)).collect()
    assert [r["total_rows"] for r in empty] == [0, 0]


def test_profile_approximate(frame):
    df = frame([(float(i % 7),) for i in range(100)], "n double")
    exact, rough = column_profile(df).first(), column_profile(df, approx=True).first()
    assert exact["distinct"] == 7 and abs(rough["distinct"] - 7) <= 1
    assert exact["avg"] == pytest.approx(rough["avg"])


@pytest.mark.parametrize("seed,size", [(1, 1), (2, 2), (3, 5), (4, 997), (5, 5000)])
def test_order_statistics_are_exact(frame, seed, size):
    rng = random.Random(seed)
    values = [rng.choice([7.0, rng.gauss(0, 50), float(rng.randint(0, 9))]) for _ in range(size)]
    df = frame([(v,) for v in values], "v double").repartition(4)
    wanted = {str(p): at_fraction(F.col("v"), p) for p in (0.0, 0.25, 0.5, 0.95, 1.0)}
    got = positions(df, wanted)
    ordered = sorted(values)
    for p in (0.0, 0.25, 0.5, 0.95, 1.0):
        assert got[str(p)] == ordered[min(size - 1, math.floor(p * size))]


def test_order_statistics_of_odd_numbers(frame):
    """Huge and tiny numbers, infinities, NaN (the largest), both zeros, large integers, decimals."""
    values = [float("-inf"), -1e308, -3.0, -5e-324, -0.0, 0.0, 5e-324, 1e-300, 1.0, 1.0 + 2 ** -52,
              2.5, 1e308, 1.7976931348623157e308, float("inf"), float("nan")]
    df = frame([(v,) for v in values], "v double").repartition(3)
    for k, v in enumerate(values):
        got = positions(df, {"k": at_place(F.col("v"), k)})["k"]
        assert got == v or (math.isnan(v) and math.isnan(got))
    longs = [-(1 << 62), -1, 0, 1 << 53, (1 << 53) + 1, (1 << 53) + 2, (1 << 62) + 1]
    df = frame([(v, Decimal(v) / 1000) for v in longs], "v long, d decimal(38,3)")
    for k, v in enumerate(longs):
        assert positions(df, {"v": at_place(F.col("v"), k), "d": at_place(F.col("d"), k)}) == {
            "v": v, "d": Decimal(v) / 1000}
    assert positions(df, {"v": at_place(F.col("v"), 7)}) == {"v": None}


def test_order_statistics_need_few_jobs(spark, frame):
    """As many for fifty columns as for five."""
    rng = random.Random(1)
    df = frame([tuple(rng.gauss(0, 10 ** (i % 7)) for i in range(50)) for _ in range(300)],
               ", ".join(f"c{i} double" for i in range(50))).repartition(4).cache()
    df.count()
    tracker, taken = spark.sparkContext.statusTracker(), {}
    for n in (5, 50):
        spark.sparkContext.setJobGroup(f"stats{n}", "")
        got = {r["column"]: r["median"] for r in numeric_stats(df, df.columns[:n]).collect()}
        taken[n] = len(tracker.getJobIdsForGroup(f"stats{n}"))
        spark.sparkContext.setJobGroup("rest", "")
        for c in df.columns[:n]:
            assert got[c] == sorted(r[0] for r in df.select(c).collect())[150]
    # a pass may take a job per shuffle it plans anew
    print(taken)
    assert max(taken.values()) <= 8


def test_cuts_inside_ties(frame):
    rng = random.Random(2)
    data = [(rng.choice([1.0, 1.0, 2.0, 3.5]), i) for i in range(-40, 60)]
    df = frame(data + [(None, 5)], "o double, t long").repartition(3)
    for k in (0, 17, 50, 98, 99):
        at = cuts(df, F.col("o"), F.col("t"), {"k": lambda n, k=k: F.lit(k)})["k"]
        assert (at.order, at.tie) == sorted(data)[k]
    assert cuts(df, F.col("o"), F.col("t"), {"k": lambda n: n}) is None


def test_order_statistics_of_a_sparse_column(frame):
    df = frame([(float(i), 5.0 if i == 77 else None) for i in range(500)], "v double, s double")
    got = positions(df, {"v": at_fraction(F.col("v"), 0.5), "s": at_fraction(F.col("s"), 0.5),
                         "n": at_fraction(F.lit(None).cast("double"), 0.5)})
    assert got == {"v": 250.0, "s": 5.0, "n": None}


def test_order_statistics_of_a_dominant_value(frame):
    df = frame([(1.0,)] * 400 + [(float(v),) for v in range(2, 202)], "v double")
    got = positions(df, {"m": at_fraction(F.col("v"), 0.5), "p": at_fraction(F.col("v"), 0.95)})
    assert got == {"m": 1.0, "p": 172.0}


def test_numeric_stats(frame):
    df = frame([(1.0,), (2.0,), (None,), (9.0,)], "v double")
    as_zero, as_null = numeric_stats(df).first(), numeric_stats(df, null_as_zero=False).first()
    assert (as_zero["n"], as_zero["median"], as_zero["mean"]) == (4, 2.0, 3.0)
    assert (as_null["n"], as_null["median"], as_null["mean"]) == (3, 2.0, 4.0)


def test_duplicates(frame):
    df = frame([(1, 1), (1, 1), (1, 1), (None, 1), (None, 1), (2, 2)], "a int, b int")
    one = duplicate_check(df, ["a", "b"]).first()
    assert (one["duplicate_groups"], one["excess_rows"]) == (1, 2)
    none = duplicate_check(df.where("a = 2"), "a").first()
    assert (none["duplicate_groups"], none["excess_rows"]) == (0, None)


def test_one_broken_table_stays_alone(spark, frame):
    fresh = frame([("2024-01-02 12:30:00", 1)], "updated_at string, id int")
    bad = fresh.withColumn("updated_at", F.raise_error(F.lit("broken")).cast("string"))
    out = {r["table_name"]: r for r in table_health(
        {"good": fresh, "bad": bad, "gone": lambda: spark.table("no_such_table"),
         "timeless": fresh.select("id")}, as_of="2024-01-03 00:00:00").collect()}
    assert out["good"]["status"] == "healthy" and out["good"]["time_column"] == "updated_at"
    assert out["good"]["total_rows"] == 1 and out["good"]["error"] is None
    assert out["bad"]["status"] == "unknown" and "broken" in out["bad"]["error"]
    assert out["gone"]["status"] == "unknown" and "no_such_table" in out["gone"]["error"]
    assert out["timeless"]["status"] == "unknown" and out["timeless"]["error"] is None


def test_freshness_and_health(frame):
    now = "2024-01-03 00:00:00"
    fresh = frame([("2024-01-02 12:30:00",)], "updated_at string")
    old = frame([("2023-01-01",)], "updated_at string")
    assert freshness(fresh, "updated_at", now).first()["lag_hours"] == 11
    health = table_health({"fresh": fresh, "old": old, "none": old, "empty": old.limit(0)},
                          {"fresh": "updated_at", "old": "updated_at", "none": None,
                           "empty": "updated_at"}, now)
    assert dict(rows(health, "table_name", "status")) == {
        "fresh": "healthy", "old": "stale", "none": "unknown", "empty": "unknown"}


def test_latest_n_of_a_hot_key(frame):
    data = [("hot", i % 50, i) for i in range(3000)] + [("cold", 1, 9000), ("cold", 2, 9001)]
    df = frame(data, "k string, at int, id int")
    got = latest_n_per_key(df, ["k"], [F.desc("at"), F.asc("id")], 5, ["id"], salts=4)
    expected = sorted((d for d in data if d[0] == "hot"), key=lambda d: (-d[1], d[2]))[:5]
    hot = sorted(r for r in rows(got, "rn", "id", "k") if r[2] == "hot")
    assert [(r[0], r[1]) for r in hot] == [(i + 1, d[2]) for i, d in enumerate(expected)]
    assert sorted(i for _, i, k in rows(got, "rn", "id", "k") if k == "cold") == [9000, 9001]


def test_changes_match_a_plain_scan(frame):
    rng = random.Random(3)
    data = [(rng.randint(0, 2), f"2024-01-{rng.randint(1, 9):02d}", i, rng.choice("ab"))
            for i in range(400)]
    df = frame(data, "k int, d string, id int, v string")
    out = changes(df, "k", ["d", "id"], F.col("v"), n_slices=7)
    expected = set()
    for k in range(3):
        previous, seq = None, 0
        for _, _, i, v in sorted((r for r in data if r[0] == k), key=lambda r: (r[1], r[2])):
            if v != previous:
                seq += 1
                expected.add((k, seq, i, v))
            previous = v
    assert set(rows(out, "k", "seq", "id", "value")) == expected


def test_changes_of_one_key_at_one_time(frame):
    """Slices are equal even where all rows share the key and the time; null keys count as a key."""
    data = [(k, "2024-01-01", i, "ab"[(i * i) % 7 % 2]) for i in range(300) for k in (1, None)]
    df = frame(data, "k int, d string, id int, v string").repartition(3)
    out = changes(df, "k", ["d", "id"], F.col("v"), n_slices=8)
    values = ["ab"[(i * i) % 7 % 2] for i in range(300)]
    expected = [i for i in range(300) if not i or values[i] != values[i - 1]]
    for k in (1, None):
        got = sorted((r["seq"], r["id"]) for r in out.collect() if r["k"] == k)
        assert got == list(enumerate(expected, 1))
    number = slices(df.where("k = 1"), sortable(df, "d"), F.col("id"), 8)
    sizes = [r["count"] for r in df.where("k = 1").groupBy(number.alias("s")).count().collect()]
    assert len(sizes) == 8 and max(sizes) <= 39


def test_changes_of_many_short_histories(frame):
    """No key fills a slice, so its rows meet by key alone, without a search for borders or a join."""
    data = [(k, i * 7 % 20 or None, i, "ab"[i * i % 7 % 2]) for k in (1, 2, None) for i in range(60)]
    df = frame(data, "k int, at int, id int, v string").repartition(3)
    out, sliced = (changes(df, "k", ["at", "id"], F.col("v"), n) for n in (None, 5))
    assert out.schema == sliced.schema
    assert sorted(map(str, out.collect())) == sorted(map(str, sliced.collect()))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "__slice" not in plan


def test_slices_only_for_keys_that_need_them(frame, monkeypatch):
    from tidewell.operators import ordered
    df = frame([(i % 10, i, "ab"[i % 3 % 2]) for i in range(400)], "k int, id int, v string")
    monkeypatch.setattr(ordered, "SLICE", 40)
    assert ordered.slices_for(df, "k") == 1 and ordered.slices_for(df.limit(0), "k") == 1
    monkeypatch.setattr(ordered, "SLICE", 39)
    assert ordered.slices_for(df, "k") == 11


@pytest.mark.parametrize("tied", [True, False])
def test_many_places_of_one_column(frame, monkeypatch, tied):
    """A pass counts a row once, however many places are sought in its column."""
    from tidewell.operators import order_stats as S
    rng = random.Random(8)
    data = [(rng.choice([None, 5, 5, -3, rng.randint(-10**6, 10**6), 10**12 + i]), i) for i in range(900)]
    df = frame(data, "v long, t long")
    order, tie = F.col("v"), F.col("t") if tied else None
    counted, inline = [], F.inline
    monkeypatch.setattr(S.F, "inline", lambda c: counted.append(c) or inline(c))
    monkeypatch.setattr(S, "BINS", 64)
    known = sorted(d for d in data if d[0] is not None)
    wanted = {str(k): S.Wanted(order, lambda n, k=k: F.lit(k), tie) for k in range(0, len(known) + 9, 9)}
    got = S.located(df, wanted)
    for k, (value, at) in ((int(k), found) for k, found in got.items()):
        if k >= len(known):
            assert value is None
        else:
            assert value == known[k][0] and (not tied or at == known[k][1])
    cells = df.select(F.col("v").alias("v0"), F.lit(None).cast("long").alias("t0"), F.lit(0).alias("at0"))
    monkeypatch.undo()
    assert cells.select(F.inline(counted[0])).count() == len(data)


def test_slices_without_a_tie(frame):
    df = frame([(i * i % 1009 / 8 if i % 50 else None,) for i in range(1000)], "v double")
    number = slices(df, F.col("v"), n=9)
    found = df.withColumn("s", number).groupBy("s").agg(
        F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).orderBy("s").collect()
    assert [r["s"] for r in found] == list(range(9)) and max(r["n"] for r in found) <= 140
    assert all(a["high"] < b["low"] for a, b in zip(found, found[1:]))
    assert df.where("v is null").select(number.alias("s")).distinct().collect() == [(0,)]


def test_all_members_are_ranked(frame):
    rng = random.Random(4)
    values = {i: rng.choice([None, 1, 2, 2.5, 7]) for i in range(200)}
    df = frame([(k, float(v) if v else None) for k, v in values.items()], "k int, v double")
    out = {r["dimension"]: r["rank"] for r in ranking(df, "k", Metric("v", "SUM"), top_n=None).collect()}
    known = sorted((v for v in values.values() if v), reverse=True)
    assert len(out) == 200
    assert all(out[k] == (known.index(v) + 1 if v else len(known) + 1) for k, v in values.items())


def test_limits_are_kept_or_refused(frame):
    df = frame([(f"2020-01-01 00:00:{i % 60:02d}", i, i % 700) for i in range(20_000)],
               "t string, v int, k int")
    days = df.withColumn("t", F.date_add(F.lit("2020-01-01").cast("date"), F.col("k")))
    assert time_series(days, "t", limit=None).count() == 700
    assert time_series(days, "t").count() == 180
    assert aggregate(df, [Metric("v", "SUM")], "v", limit=15_000).count() == 15_000
    for bad in (0, -1, True):
        with pytest.raises(ValueError):
            aggregate(df, [Metric("v", "SUM")], "k", limit=bad)


def test_distinct_windows_need_no_expand(frame):
    df = frame([("2024-01-05", "a"), ("2024-01-05", "b"), ("2024-01-04", None), ("2023-12-29", "a"),
                ("2023-12-01", "z")], "t string, v string")
    out = comparison(df, "t", Metric("v", "COUNT_DISTINCT"), 7, as_of="2024-01-06 00:00:00")
    assert out.first().asDict() == {"current_value": 2, "previous_value": 1}
    assert "Expand" not in out._jdf.queryExecution().executedPlan().toString()


def test_joins(frame):
    parents = frame([(1,), (2,)], "id int")
    children = frame([(1,), (1,), (None,)], "pid int")
    assert rows(count_children(parents, children, "id", "pid").orderBy("id"), "id", "n") == [
        (1, 2), (2, 0)]
    assert only_owned(parents, "id", children.limit(0), "pid").count() == 0
    snaps = frame([("a", 1), ("b", 2), ("c", 2)], "k string, at int")
    assert sorted(rows(latest_snapshot(snaps, "at"), "k")) == ["b", "c"]


def test_schema_diff(frame):
    schema = "table_name string, column_name string, data_type string"
    old = frame([("t", "a", "int"), ("t", "b", "int"), ("t", "c", "int")], schema)
    new = frame([("t", "a", "int"), ("t", "b", "string"), ("t", "d", "int")], schema)
    assert sorted(rows(schema_diff(old, new), "column_name", "change")) == [
        ("b", "changed"), ("c", "removed"), ("d", "added")]


# -- telemetry ---------------------------------------------------------------

RUNS = "id int, flow_id int, status string, rows bigint, duration_ms bigint, started_at timestamp"


@pytest.fixture
def runs(frame):
    raw = frame([(1, 1, "success", 10, 100, "2024-01-01 00:00:00"),
                 (2, 1, "failed", None, 300, "2024-01-02 00:00:00"),
                 (3, 2, "success", 5, None, "2024-01-01 12:00:00")],
                "id int, flow_id int, status string, rows bigint, duration_ms bigint, t string")
    return raw.withColumn("started_at", F.to_timestamp("t")).drop("t")


@pytest.fixture
def flows(frame):
    return frame([(1, 1, "shop", "active", "t1"), (2, 1, "crm", "active", None),
                  (3, 2, "crm", "paused", None)],
                 "id int, user_id int, source_id string, status string, warehouse_table string")


def test_run_stats(runs, flows):
    out = T.run_stats(runs).first()
    assert (out["total_runs"], out["success_rate"], out["avg_ms"], out["avg_success_ms"]) == (
        3, 66.7, 200.0, 100.0)
    empty = T.run_stats(runs.limit(0), empty_rate=100.0).first()
    assert (empty["total_runs"], empty["total_rows"], empty["success_rate"]) == (0, 0, 100.0)
    by_source = dict(rows(T.run_stats(runs, flows, ["source_id"]), "source_id", "total_runs"))
    assert by_source == {"shop": 2, "crm": 1}


def test_error_rates(runs, flows):
    out = T.error_rates(runs, flows, stamp("2024-01-05 00:00:00"))
    assert rows(out, "flow_id", "error_pct") == [(1, 50.0)]


def test_load_durations_of_all_runs(frame, flows):
    """Every run of a flow counts, equal durations and a hot flow included."""
    rng = random.Random(5)
    data = [(i, rng.choice([1, 1, 1, 2]), "success", 1, int(10 ** rng.uniform(0, 7)) // 3 * 3, i)
            for i in range(1, 3000)]
    raw = frame(data, "id int, flow_id int, status string, rows bigint, duration_ms bigint, s int")
    runs = raw.withColumn("started_at", F.timestamp_seconds("s")).drop("s")
    for r in T.load_durations(runs, flows, newest=None).collect():
        own = sorted(d[4] for d in data if d[1] == r["flow_id"])
        assert r["run_count"] == len(own) and r["p95_ms"] == own[math.floor(0.95 * len(own))]


def test_load_durations_pick(frame, flows):
    data = [(i, 1, "success", 1, i * 10, i) for i in range(1, 301)]
    raw = frame(data, "id int, flow_id int, status string, rows bigint, duration_ms bigint, s int")
    runs = raw.withColumn("started_at", F.timestamp_seconds("s")).drop("s")
    out = T.load_durations(runs, flows).first()
    newest = sorted(d[4] for d in data[100:])  # the newest 200
    assert out["run_count"] == 200 and out["p95_ms"] == newest[math.floor(0.95 * 200)]
    assert out["last_ms"] == 3000


def test_flow_summary(runs, flows):
    got = {r["flow_id"]: r for r in T.flow_summary(flows, runs).collect()}
    assert got[1]["status"] == "error" and got[1]["success_rate"] == 50.0
    assert got[2]["status"] == "active" and got[2]["rows_synced"] == 5
    assert got[3]["total_runs"] == 0 and got[3]["success_rate"] == 100.0


def test_usage_rollup_keeps_totals_and_repeats(frame):
    raw = frame([(1, "m", 2, "2024-01-01 01:00:00"), (1, "m", 3, "2024-01-01 23:00:00"),
                 (1, "m", 4, "2024-01-02 00:00:00")],
                "workspace_id int, metric string, quantity bigint, t string")
    usage = raw.withColumn("created_at", F.to_timestamp("t")).drop("t")
    once = T.usage_rollup(usage)
    assert sorted(rows(once, "quantity", "events")) == [(4, 1), (5, 2)]
    assert sorted(map(str, T.usage_rollup(once).collect())) == sorted(map(str, once.collect()))


def test_overview_and_funnel(frame, runs, flows):
    users = frame([(1, "2024-01-04"), (2, "2023-01-01"), (3, "2023-01-01")],
                  "id int, joined string").withColumn("joined", F.to_timestamp("joined"))
    overview = T.user_overview(users, flows, runs, {"connector_count": frame(
        [(1,), (1,)], "user_id int")})
    one = overview.where("user_id = 1").first()
    assert (one["flow_count"], one["total_runs"], one["success_rate"], one["connector_count"]) == (
        2, 3, 67.0, 2)
    assert overview.where("user_id = 3").first()["success_rate"] is None
    stages = dict(rows(T.funnel(overview, "joined", stamp("2024-01-05 00:00:00")), "stage",
                       "users"))
    assert stages == {"registered": 3, "created_flow": 2, "added_connector": 1,
                      "ran_first_sync": 1, "succeeded_sync": 1, "recent_signups": 1}


def test_logged_table(frame):
    logs = '[{"message":"start"},{"message":"Loaded 12 rows → shop_orders"}]'
    df = frame([(logs,), ("[]",), ("not json",), (None,)], "logs string")
    assert [r[0] for r in df.select(T.logged_table(F.col("logs"))).collect()] == [
        "shop_orders", None, None, None]


# -- insights ----------------------------------------------------------------

def test_trend_needs_five_rows_and_a_base(frame):
    few = frame([(1, 1.0), (2, 9.0)], "i int, v double")
    assert quintile_trend(few, "i", "i", ["v"]).first()["trend_pct"] == 0.0
    zero = frame([(i, 0.0 if i == 0 else 5.0) for i in range(5)], "i int, v double")
    assert quintile_trend(zero, "i", "i", ["v"]).first()["trend_pct"] == 0.0
    up = frame([(i, 1.0 + i) for i in range(10)], "i int, v double")
    out = quintile_trend(up, "i", "i", ["v"]).first()
    assert (out["first_mean"], out["last_mean"], out["rows_per_end"]) == (1.5, 9.5, 2)


def test_outlier_severity(frame):
    mild = frame([(1.0,)] * 99 + [(100.0,)], "v double")
    assert rows(outliers(mild), "outliers", "severity") == [(1, "warning")]
    flat = frame([(1.0,)] * 5, "v double")
    assert rows(outliers(flat), "outliers", "severity") == [(0, "none")]


def test_insights_of_an_empty_table(frame):
    df = frame([], "i int, s string")
    assert insights(df.select("s"), "s", "s", stamp("2024-01-01 00:00:00"), []).count() == 0


def test_active_insights(frame):
    raw = frame([(1, False, None, 1), (2, True, None, 2), (3, False, "2023-01-01", 3),
                 (4, False, "2025-01-01", 4)], "id int, dismissed boolean, e string, c int")
    df = raw.withColumns({"expires_at": F.to_timestamp("e"), "created_at": F.col("c"),
                          "model_id": F.col("id")})
    models = frame([(4, "m4")], "id int, name string")
    out = active_insights(df, stamp("2024-01-01 00:00:00"), models)
    assert sorted(rows(out, "id", "model_name"), key=str) == [(1, None), (4, "m4")]


def test_recommendations_fall_back_to_healthy(frame):
    none = frame([], "flow_id int, error_pct double")
    stale = frame([("t", 10)], "table_name string, lag_hours bigint")
    healthy = recommendations(frame([(0,)], "dead bigint"), none, stale)
    assert rows(healthy, "severity", "subject") == [("success", "platform")]
    busy = recommendations(frame([(2,)], "dead bigint"), none,
                           frame([("t", 100)], "table_name string, lag_hours bigint"))
    assert sorted(rows(busy, "severity")) == ["critical", "warning"]


@pytest.mark.parametrize("values,expected", [
    (["2024-01-01", "2024-02-01T10:00:00Z"], "timestamp"), (["a@b.co", "c@d.org"], "email"),
    (["https://x.y", "http://z"], "url"), (["$1,200.50", "€ 3"], "currency"),
    (["12 USD", "3.5eur"], "currency"), (["5%", "7.5 %"], "percentage"),
    (["+44 20 7946", "0207946123456"], "phone"), (["yes", "No"], "boolean"),
    (["1", "2.5", "1e3"], "number"), (["red", "red", "Red", "blue"], "category"),
    ([f"word {i}" for i in range(9)], None), (["", None], None)])
def test_value_classes(frame, values, expected):
    df = frame([(v,) for v in values], "v string")
    assert classify_values(df).first()["value_class"] == expected


def test_categories_over_all_rows(spark):
    rows = spark.range(50_000).select(
        F.concat(F.lit("code "), F.pmod("id", F.lit(40)).cast("string")).alias("code"),
        F.concat(F.lit("a remark of thirty letters "), F.pmod("id", F.lit(100)) + 100)
        .alias("remark"),
        F.when(F.col("id") == 49_999, F.repeat(F.lit("long "), F.lit(9))).otherwise(F.lit("x"))
        .alias("rare"),
        F.col("id").cast("string").substr(1, 0).alias("empty"))
    got = {r["column"]: r["value_class"] for r in classify_values(rows).collect()}
    assert got == {"code": "category", "remark": None, "rare": None, "empty": None}
    more = classify_values(rows, ["remark"], max_categories=100).first()
    assert (more["value_class"], more["filled_rows"]) == ("category", 50_000)


def test_due_flows_oldest_first(frame):
    flows = frame([(1, "active", 30), (2, "paused", 10), (3, "active", 20), (4, None, 5),
                   (5, "active", None), (6, "active", 99), (7, "active", 20)],
                  "id int, status string, next_run_at bigint")
    now = F.timestamp_millis(F.lit(50))
    assert rows(T.due(flows, now), "id") == [3, 7, 1]
    assert rows(T.due(flows, now, 1), "id") == [3]


def test_one_bad_value_among_many(frame):
    df = frame([(f"2024-01-{d:02d}",) for d in range(1, 29)] * 30 + [("soon",)], "v string")
    assert classify_values(df).first()["value_class"] != "timestamp"
