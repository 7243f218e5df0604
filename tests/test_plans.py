"""Classification, reports, widgets, charts, lineage, search."""

from pathlib import Path
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from tidewell.operators import lineage as L
from tidewell.operators.catalog import (column_catalog, discover_tables, partitioned_write,
                                        session_tables, table_bytes)
from tidewell.operators.search import model_names, search, table_names
from tidewell.plans import semantic, vocabulary
from tidewell.plans.autoreport import auto_report, kpi_values, propose, span_bucket
from tidewell.plans.charts import chart_fit, chart_suggestions
from tidewell.plans.report import table_report
from tidewell.workbook.meaning import auto_kpis, auto_table

CASES = [
    ("roas", "number", "roas", "metric"), ("ad_spend", "number", "spend", "metric"),
    ("order_id", "number", "order", "detail"), ("l_orderkey", "number", "order", "detail"),
    ("c_custkey", "number", "number", "metric"), ("user_id", "number", "user", "dimension"),
    ("event_id", "number", "identifier", "identifier"), ("carrier", "string", "subscription",
                                                         "dimension"),
    ("total_price", "string", "amount", "metric"), ("status", "string", "status", "dimension"),
    ("created_at", "string", "timestamp", "time"), ("created_at", "timestamp", "timestamp",
                                                    "time"),
    ("clicks", "number", "click", "metric"), ("clicks", "string", "click", "dimension"),
    ("session_length", "number", "session", "metric"), ("is_open", "boolean", "boolean",
                                                        "dimension"),
    ("payload", "json", "json", "detail"), ("tags", "array", "array", "detail"),
    ("first_name", "string", "name", "dimension"), ("zzz", "string", "text", "detail"),
    ("zzz", "number", "number", "metric"), ("zzz", "bytes", "unknown", "detail"),
    ("state", "string", "region", "dimension"), ("bounce_rate", "number", "percentage", "metric"),
    ("key", "string", "identifier", "identifier"), ("currency", "string", "currency",
                                                    "dimension"),
    ("utm_source", "string", "utm", "dimension"), ("lat", "number", "latitude", "detail"),
    ("email", "string", "email", "detail"), ("duration_ms", "number", "percentage", "metric"),  # "ratio" is inside "duration"
    ("elapsed", "number", "duration", "metric"),
]


@pytest.mark.parametrize("name,declared,cls,role", CASES)
def test_class_and_role(name, declared, cls, role):
    assert semantic.class_of(name, declared) == cls
    assert semantic.role_of(cls, declared) == role


def test_columns_agree_with_the_schema_classifier(frame):
    names = [(n, d) for n, d, _, _ in CASES]
    df = frame(names, "column_name string, declared_type string")
    got = semantic.classify_catalog(df).collect()
    for row in got:
        cls = semantic.class_of(row["column_name"], row["declared_type"])
        assert row["semantic_class"] == cls
        assert row["role"] == semantic.role_of(cls, row["declared_type"])


def test_vocabulary_is_complete():
    assert len(vocabulary.NAME_RULES) == 68 and len(vocabulary.CONCEPTS) == 21


def test_overrides_and_default_aggregates(frame):
    df = frame([(1, 2.0, "x")], "c_custkey int, rate double, kind string")
    plain = {m.name: m for m in semantic.classify_schema(df)}
    fixed = {m.name: m for m in semantic.classify_schema(df, {"c_custkey": "identifier"})}
    assert plain["c_custkey"].role == "metric" and fixed["c_custkey"].role == "identifier"
    assert semantic.default_aggregate(fixed["c_custkey"]) == "COUNT_DISTINCT"
    assert semantic.default_aggregate(plain["kind"]) == "COUNT"
    assert semantic.find_column(list(plain.values()), "tag", "category").name == "kind"
    ratio = semantic.ColumnMeaning("x_pct", "number", "percentage", "metric", "X Pct")
    assert semantic.default_aggregate(ratio) == "AVG"


def test_concepts(frame):
    df = frame([("t", "revenue", "number", 1), ("t", "country", "string", 2),
                ("t", "tax", "number", 3)],
               "table_name string, column_name string, declared_type string, "
               "ordinal_position int")
    found = semantic.detect_concepts(semantic.classify_catalog(df))
    assert {r["concept"]: r["first_column"] for r in found.collect()} == {
        "revenue": "revenue", "location": "country", "invoices": "tax"}


def test_report_keys(frame):
    df = frame([("2024-01-01", "n", 5, 1, "open", 1, "id1", "c1")],
               "created_at string, name string, contacted int, replied int, status string, "
               "opened int, id string, campaign_id string")
    planner = table_report(df, "2024-01-02 00:00:00")
    assert {"timeseries", "comparison", "freshness", "ranking:name", "ranking:status",
            "distribution:status", "duplicates"} <= set(planner)
    assert not planner.errors
    route = table_report(df, "2024-01-02 00:00:00", "route")
    assert "ranking:name" in route and "distribution:status" not in route
    assert any(k.startswith("comparison:") for k in route)
    for part in planner.values():
        part.collect()


def test_report_isolates_failures(frame):
    df = frame([("2024-01-01", 1)], "created_at string, revenue int").withColumn(
        "revenue", F.to_timestamp("created_at"))
    # revenue is now a time by type; forcing a money class makes its sum impossible
    report = table_report(df, "2024-01-02 00:00:00", overrides={"revenue": "revenue"})
    assert "timeseries" in report.errors and "freshness" in report


def test_report_without_time_or_metric(frame):
    report = table_report(frame([("a",)], "category string"))
    assert set(report) == {"ranking:category"}


@pytest.mark.parametrize("days,bucket", [(None, "month"), (0, "day"), (60, "day"), (61, "week"),
                                         (120, "week"), (900, "month"), (901, "quarter")])
def test_span_buckets(days, bucket):
    assert span_bucket(days) == bucket


def test_proposals_respect_member_limits(frame):
    data = [(f"c{i % 3}", "only", f"r{i}", float(i)) for i in range(300)]
    df = frame(data, "category string, status string, region string, revenue double")
    keys = {w.key for w in propose(df)}
    assert "bar:category:revenue" in keys          # 3 members
    assert "bar:status:revenue" not in keys        # 1 member
    assert "bar:region:revenue" not in keys        # 300 members
    assert "table:top10" in keys and not any(k.startswith("trend") for k in keys)


def test_proposal_titles(frame):
    df = frame([("a", 1.0), ("b", 2.0)], "category string, total_revenue double")
    titles = {w.key: w.title for w in propose(df)}
    assert titles["kpi:sum:total-revenue"] == "Total Revenue"
    assert titles["bar:category:total-revenue"] == "Total Revenue by Category"


def catalog(frame, **tables):
    rows = [(t, n, d, i) for t, cols in tables.items() for i, (n, d) in enumerate(cols)]
    return frame(rows, "table_name string, column_name string, declared_type string, "
                       "ordinal_position int")


def test_charts(frame):
    columns = catalog(
        frame, single=[("v", "number")], series=[("at", "timestamp"), ("v", "number")],
        places=[("lat", "string"), ("lng", "string"), ("v", "string")],
        shares=[("kind", "string"), ("v", "number")], blank=[("x", "json")])
    got = {}
    for r in chart_suggestions(columns).orderBy("table_name", "position").collect():
        got.setdefault(r["table_name"], []).append((r["chart"], r["score"]))
    assert got["single"] == [("kpi_card", 95), ("number_card", 88), ("gauge", 72), ("table", 40)]
    assert got["series"] == [("line", 92), ("area", 80), ("waterfall", 58), ("table", 40)]
    assert got["places"][0] == ("geo_map", 88)
    assert got["shares"] == [("bar", 90), ("bar_horizontal", 78), ("pie", 68), ("donut", 65),
                             ("funnel", 60), ("waterfall", 58)]
    assert got["blank"] == [("table", 40)]
    fit = {r["table_name"]: (r["score"], r["suitable"]) for r in
           chart_fit(columns, "line").collect()}
    assert fit["series"] == (92, True) and fit["single"] == (20, False)


def test_catalog_of_tables(spark, frame, root):
    a = frame([(1, None), (2, "x")], "id int, note string")
    a.write.parquet(f"{root}/a")
    a.createOrReplaceTempView("catalog_a")
    assert "catalog_a" in session_tables(spark)
    got = {r["column_name"]: (r["total_rows"], r["filled_rows"])
           for r in column_catalog({"a": a}).collect()}
    assert got == {"id": (2, 2), "note": (2, 1)}
    files = [f for f in Path(f"{root}/a").rglob("*.parquet")]
    assert table_bytes(spark, {"a": f"{root}/a"}).first()["total_bytes"] == sum(
        f.stat().st_size for f in files)
    found = discover_tables(column_catalog({"a": frame([("2024-01-01", "x")],
                                                       "updated_at string, status string")}))
    assert (found.first()["partition_candidate"], found.first()["cluster_candidate"]) == (
        "updated_at", "status")


def test_partitioned_write_prunes(spark, frame, root):
    df = frame([(f"2024-01-0{d}", f"k{k}", k) for d in (1, 2) for k in range(20)],
               "at string, k string, n int")
    partitioned_write(df, f"{root}/t", F.to_date("at"), "k", 2)
    back = spark.read.parquet(f"{root}/t")
    assert back.where("day = '2024-01-01'").count() == 20
    assert len(back.where("day = '2024-01-01'").inputFiles()) >= 1


STATEMENTS = [
    (1, "select 1", "ok"), (2, " WITH a AS (SELECT 1) SELECT * FROM a", "ok"),
    (3, "DELETE FROM t", "not_select"), (4, "select * from t; drop table t", "forbidden"),
    (5, "-- only a note", "empty"), (6, "/* drop */ select 1", "ok"),
    (7, "select 'updated_at'", "ok"), (8, "", "empty"), (9, None, "empty"),
    (10, "-- x\nselect 1\n/* a\nb */", "ok"), (11, "selection", "not_select"),
    (12, "select 1 -- insert", "ok")]


def test_statement_verdicts(frame):
    df = frame([(i, s) for i, s, _ in STATEMENTS], "id int, sql string")
    got = {r["id"]: r["verdict"] for r in L.read_only_verdicts(df).collect()}
    assert got == {i: v for i, _, v in STATEMENTS}


def test_table_refs(frame):
    df = frame([("SELECT * FROM `p.d.Orders` o JOIN d.items i, (SELECT * from orders) JOIN x",)],
               "s string")
    assert df.select(L.table_refs(F.col("s"))).first()[0] == [
        "p.d.orders", "d.items", "orders", "x"]


def test_lineage(frame):
    statements = frame([(1, "select * from wh.sales.Orders"), (2, "select * from reorders"),
                        (3, "select 1"), (4, "select * from orders join a.orders")],
                       "id int, sql string")
    tables = frame([("orders",), ("items",)], "table_name string")
    edges = sorted((r["from_node"], r["to_node"])
                   for r in L.statement_edges(statements, tables).collect())
    assert edges == [("table_orders", "query_1"), ("table_orders", "query_4")]
    known = frame([("wh.sales.orders",)], "table_name string")
    assert sorted(r["ref"] for r in L.unknown_refs(statements, known).collect()) == [
        "a.orders", "reorders"]


def test_run_sql_refuses_and_limits(spark):
    with pytest.raises(ValueError):
        L.run_sql(spark, "drop table x")
    inner = "select * from (select id from range(10) limit 5);"
    assert L.run_sql(spark, inner, 3).count() == 3


def test_model_cap(spark):
    rows, seen = L.model_query(spark, "select id from range(10)", [], cap=10)
    assert rows.count() == 10 and seen.first()["capped"] is False
    _, seen = L.model_query(spark, "select id from range(11)", [], cap=10)
    assert seen.first()["capped"] is True


def test_model_versions(frame):
    df = frame([("m", "2024-01-01", 1, "a "), ("m", "2024-01-01", 2, " a"),
                ("m", "2024-01-03", 3, "b"), ("m", "2024-01-05", 4, "a"), ("n", "2024-01-01", 5,
                                                                          "a")],
               "model_id string, edited_at string, edit_id int, sql string")
    got = sorted((r["model_id"], r["version"], r["sql"]) for r in L.model_versions(df).collect())
    assert got == [("m", 1, "a"), ("m", 2, "b"), ("m", 3, "a"), ("n", 1, "a")]


def brute_search(questions, names, n):
    from tidewell.functions.text import STOP_WORDS
    import re
    out = {}
    for qid, text in questions:
        words = [w for w in re.findall("[a-z0-9]+", text.lower())
                 if len(w) > 2 and w not in STOP_WORDS]
        scores = {}
        for entity in {e for e, _, _ in names}:
            for w in words:
                hits = [wt for e, t, wt in names if e == entity and w in t.lower()]
                scores[entity] = scores.get(entity, 0) + max(hits, default=0)
        best = sorted(((-s, e) for e, s in scores.items() if s > 0))[:n]
        out[qid] = [(e, -s) for s, e in best]
    return out


def test_search_matches_brute_force(frame):
    long = "warehouse" * 12 + "stock"
    columns = [("orders", "order_id"), ("orders", "customer_name"), ("customers", "name"),
               ("stock_levels", "qty"), (long, "x1y2z3")]
    questions = [(1, "show me orders per customer customer"), (2, "stock and stocks"),
                 (3, "nothing else"), (4, "housewarehouse y2z"), (5, "the")]
    cols = frame(columns, "table_name string, column_name string")
    qs = frame(questions, "question_id int, text string")
    names = [(t, t, 3) for t, _ in columns] + [(t, c, 1) for t, c in columns]
    expected = brute_search(questions, names, 8)
    got = {}
    result = search(qs, table_names(cols), 8, fallback=True)
    for r in result.orderBy("question_id", "position").collect():
        got.setdefault(r["question_id"], []).append((r["entity"], r["score"]))
    everything = sorted({t for t, _ in columns})
    for qid, _ in questions:
        assert got[qid] == (expected[qid] or [(e, 0) for e in everything])


def test_model_search_has_no_fallback(frame):
    models = frame([("Sales", "by region"), ("Stock", None)], "name string, description string")
    qs = frame([(1, "region sales"), (2, "zzz")], "question_id int, text string")
    got = search(qs, model_names(models), 4).collect()
    assert [(r["question_id"], r["entity"], r["score"]) for r in got] == [(1, "Sales", 4)]


def test_hot_word_is_scored_per_set(frame):
    """A word that all names and questions hold: results as by brute force, pairs never multiply."""
    names = [(f"orders_{i:04d}", "orders total") for i in range(600)] + [("refunds_of_orders", "x")]
    columns = frame(names, "table_name string, column_name string")
    questions = frame([(i, "show all orders" + (" refunds" if i % 50 == 0 else "")) for i in range(400)],
                      "question_id int, text string")
    found = search(questions, table_names(columns), 3)
    out = {}
    for r in found.collect():
        out.setdefault(r["question_id"], []).append((r["position"], r["entity"], r["score"]))
    plain = [(1, "orders_0000", 3), (2, "orders_0001", 3), (3, "orders_0002", 3)]
    for i in range(400):
        assert sorted(out[i])[0][1] == ("refunds_of_orders" if i % 50 == 0 else "orders_0000")
        assert i % 50 == 0 or sorted(out[i]) == plain
    assert found.count() == 1200


def test_key_flags_make_identifiers(frame):
    df = frame([(1, 2.0, "a")], "ref_no int, price double, name string")
    plain = {m.name: m.role for m in semantic.classify_schema(df)}
    flagged = {m.name: m for m in semantic.classify_schema(df, primary_keys=["price"],
                                                           foreign_keys=["name"])}
    assert plain["price"] == "metric" and flagged["price"].role == "identifier"
    assert flagged["price"].is_primary_key and not flagged["price"].is_foreign_key
    assert flagged["name"].role == "identifier" and flagged["name"].is_foreign_key
    catalog = frame([("t", "price", "number", True, None), ("t", "name", "string", None, True),
                     ("t", "fee", "number", False, False)],
                    "table_name string, column_name string, declared_type string, "
                    "is_primary_key boolean, is_foreign_key boolean")
    roles = {r["column_name"]: r["role"] for r in semantic.classify_catalog(catalog).collect()}
    assert roles == {"price": "identifier", "name": "identifier", "fee": "metric"}


@pytest.mark.parametrize("variant", ["planner", "route"])
def test_one_scan_answers_like_many(spark, frame, root, variant):
    """Every question of a report from one grouped scan equals the question asked alone."""
    rows = [(f"2024-01-{1 + i % 28:02d}", ["open", "done", None][i % 3], f"c{i % 7}", i % 11, i % 5,
             float(i % 13), i // 2) for i in range(200)]
    df = frame(rows, "updated_at string, status string, name string, contacted int, replied int, "
                     "amount double, order_id int")
    more = dict(as_of="2024-01-31 00:00:00", variant=variant, primary_keys=["order_id"])
    alone, together = table_report(df, **more), table_report(df, staging=f"{root}/report", **more)
    assert set(alone) == set(together) and not together.errors and len(alone) >= 6
    for key, answer in alone.items():
        assert together[key].columns == answer.columns, key
        assert [tuple(r) for r in together[key].collect()] == [tuple(r) for r in answer.collect()], key


def test_member_limits_are_exact(frame):
    """199 and 200 members make a dimension, 201 and more do not."""
    for n in (199, 200, 201, 5000):
        df = frame([(f"m{i % n}", float(i)) for i in range(max(n, 400))], "category string, amount double")
        keys = {w.key for w in propose(df)}
        assert ("bar:category:amount" in keys) == (n <= 200), n


def sales_tables(spark):
    """Four lines of an order each, of three customers and two parts."""
    lines = spark.range(400).selectExpr(
        "id div 4 l_orderkey", "id % 2 l_partkey", "1L l_suppkey", "cast(id % 4 as int) l_linenumber",
        "cast(id % 7 as double) l_quantity", "if(id % 10 = 3, null, cast(id as double)) l_extendedprice",
        "0.5D l_discount", "'O' l_linestatus", "timestamp_ntz'2024-01-01' + id * interval '1' day l_shipdate")
    one = spark.range(1)
    return SimpleNamespace(
        spark=spark, lineitem=lines,
        orders=spark.range(100).selectExpr("id o_orderkey", "if(id % 5 = 0, null, id % 3) o_custkey"),
        part=spark.range(2).selectExpr("id p_partkey", "concat('t', id) p_type"),
        supplier=one.selectExpr("1L s_suppkey", "cast(id as int) s_nationkey"),
        nation=one.selectExpr("cast(id as int) n_nationkey", "'n' n_name"))


def test_cards_are_computed_in_one_pass(spark):
    """No job looks at the model first, and its tables are joined once for all cards."""
    spark.sparkContext.setJobGroup("cards", "")
    try:
        out = auto_kpis(sales_tables(spark))
        assert not spark.sparkContext.statusTracker().getJobIdsForGroup("cards")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join Inner") == 4
    revenue = [i * 0.5 for i in range(400) if i % 10 != 3]
    assert {r["widget"]: r["value"] for r in out.collect()} == {
        "kpi:sum:revenue": sum(revenue), "kpi:sum:quantity": float(sum(i % 7 for i in range(400))),
        "kpi:avg:revenue": round(sum(revenue) / len(revenue), 2), "kpi:orders:order-id": 400.0,
        "kpi:customers:customer-id": 3.0}


def test_model_is_joined_once_for_a_widget(spark):
    """Proposals and frame read what one run of the joins has written."""
    out = auto_table(sales_tables(spark))
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert [(r["line"], r["revenue"]) for r in out.collect()] == [
        (i % 4, i / 2) for i in range(399, 387, -1) if i % 10 != 3][:10]


def test_staged_report_is_the_same(frame, root):
    df = frame([(f"c{i % 3}", float(i * i % 17), f"2024-01-{i % 28 + 1:02d}") for i in range(60)],
               "category string, revenue double, created_at string")
    alone, together = auto_report(df), auto_report(df, staging=f"{root}/model")
    assert list(alone) == list(together) and len(alone) > 6
    for key in set(alone) - {"table:top10", "table:all"}:
        assert sorted(alone[key].collect()) == sorted(together[key].collect()), key
    assert together["table:all"].count() == 60


def test_card_values_of_odd_tables(frame):
    none = frame([("a",)], "category string")
    assert kpi_values(none).collect() == []
    empty = kpi_values(frame([], "amount double, order_id int, user_id int"))
    assert all(r["value"] in (None, 0.0) for r in empty.collect()) and empty.count() == 4


def test_proposals_without_numbers(frame):
    rows = frame([(f"n{i}",) for i in range(30)], "name string").repartition(3)
    top = next(w for w in propose(rows) if w.key == "table:top10")
    assert top.recommended and top.frame(rows).count() == 10
    assert sorted(top.frame(rows).collect()) == sorted(top.frame(rows.repartition(5)).collect())


def test_chart_colours_and_sizes(frame):
    columns = frame([("t", n, d, i) for i, (n, d) in enumerate([
        ("a", "number"), ("b", "number"), ("c", "number"), ("kind", "string")])],
        "table_name string, column_name string, declared_type string, ordinal_position int")
    out = {r["chart"]: r for r in chart_suggestions(columns, 20).collect()}
    assert (out["bubble"]["size_field"], out["bubble"]["color_field"]) == ("c", "kind")
    assert out["bar"]["color_field"] is None and out["bar_stacked"]["color_field"] == "kind"
    assert all(r["reason"] for r in out.values())


def test_value_shapes_disproved_late(frame):
    """A counterexample beyond the first rows counts as much as one among them."""
    from tidewell.operators.profile import PROBED, classify_values
    n = PROBED * 3
    df = frame([(f"u{i}@x.org", f"u{i}@x.org" if i < n - 1 else "no mail at all, but a text")
                for i in range(n)], "good string, late string").coalesce(1)
    out = {r["column"]: r["value_class"] for r in classify_values(df).collect()}
    assert out == {"good": "email", "late": None}
