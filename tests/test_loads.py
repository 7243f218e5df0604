"""Sources, sinks, checkpoints, syncs and streams."""

import uuid
from types import SimpleNamespace

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewell.operators.aggregate import Metric, time_series
from tidewell.sinks import buckets
from tidewell.sinks.buckets import layout, merge_into
from tidewell.sinks.merge import dedupe_latest, merge
from tidewell.sinks.tables import append_load, current, export_csv, full_refresh
from tidewell.sources import delimited as D
from tidewell.sources import flatten as X
from tidewell.sources import outreach as O
from tidewell.sources.records import infer_schema, read_records, sanitize, typed
from tidewell.sources.relational import extract, repeatable_sample, table_preview
from tidewell.sources.sheet import sheet_to_table
from tidewell.streaming.checkpoint import (STATE_SCHEMA, advance, append_marks, clear, folded,
                                           read_marks, watermark)
from tidewell.streaming.sync import (SourceObject, checkpoint_of, checkpoints, incremental_sync,
                                     logged_sync, sync_all)
from tidewell.streaming.upsert import (compact, current_state, daily_state, read_changes,
                                       stream_changes, stream_daily)
from tidewell.workbook.sourcing import dealt_anew, sample


def text_file(spark, root, content, name="f.csv"):
    path = f"{root}/{name}"
    with open(path, "w") as f:
        f.write(content)
    return path


def fresh(name):
    return f"{name}_{uuid.uuid4().hex}"


def rows(df, *names):
    out = [tuple(r[n] for n in names) for r in df.collect()]
    return sorted(out, key=str)


# -- delimited files -----------------------------------------------------------

@pytest.mark.parametrize("header,sep", [("a,b;c,d", ","), ("a;b;c", ";"), ("a\tb", "\t"),
                                        ("a|b|c", "|"), ("alone", ","), ("a,b;c", ",")])
def test_separators(header, sep):
    assert D.detect_separator(header) == sep


def test_read_delimited(spark, root):
    path = text_file(spark, root, 'id;note\n\n1;"a ""b""; c"\n   \n2;\n')
    df = D.read_delimited(spark, path)
    assert rows(df, "id", "note") == [("1", 'a "b"; c'), ("2", None)]
    with pytest.raises(ValueError):
        D.read_delimited(spark, text_file(spark, root, "id;note\n", "h.csv"))


def test_type_order(frame):
    df = frame([("1", "1", "2024-01-01", "01/02/24", "", "1e5", "x"),
                ("0", "2", "2024-01-02 x", "1/2/2024", " ", "-3.5", "1")],
               "flag string, n string, d string, us string, blank string, e string, s string")
    got = {r["column"]: (r["type"], r["non_empty"]) for r in D.infer_types(df).collect()}
    assert got == {"flag": ("boolean", 2), "n": ("number", 2), "d": ("date", 2),
                   "us": ("date", 2), "blank": ("string", 0), "e": ("number", 2),
                   "s": ("string", 2)}


def test_stats_and_validation(frame):
    df = frame([("1", "2", None)] * 11 + [("1", "2", "x")], "shop_id string, id string, n string")
    stats = D.column_stats(df)
    assert rows(stats, "column", "is_key") == [("id", False), ("n", False), ("shop_id", True)]
    assert rows(D.validate(stats), "severity", "column") == [("warning", "n")]
    keyless = D.column_stats(df.select("n"))
    messages = [m for _, m in rows(D.validate(keyless, included=[]), "severity", "message")]
    assert sorted(messages) == ["no column included", "no key column", "over 90% empty"]


def test_mapping_keeps_zero(frame):
    df = frame([("0", "TRUE", ""), ("x", "0", "a"), ("2", "1", "b")],
               "n string, b string, s string")
    maps = [D.Mapping("n", "num", "number"), D.Mapping("b", "flag", "boolean"),
            D.Mapping("s", "text")]
    assert [tuple(r) for r in D.map_columns(df, maps).collect()] == [
        (0.0, True, None), (None, False, "a"), (2.0, True, "b")]
    assert D.map_columns(df, maps, zero_as_null=True).first()["num"] is None
    with pytest.raises(ValueError):
        D.map_columns(df, [])


# -- records ---------------------------------------------------------------------

def test_record_schema(spark, root):
    path = text_file(spark, root, "\n".join([
        '{"a": 1, "b": 1.5, "c": true, "d": "2024-01-01T00:00:00Z", "e": ""}',
        '{"a": null, "b": 2, "d": "", "f": {"x": 1}, "g-h": [1], "g_h": "z", "1k": "2024-01-01"}',
    ]), "r.json")
    df = read_records(spark, path)
    inferred = infer_schema(df).collect()
    assert {r["name"]: r["type"] for r in inferred} == {
        "_1k": "STRING", "a": "INT64", "b": "FLOAT64", "c": "BOOL", "d": "TIMESTAMP",
        "e": "STRING", "f": "STRING", "g_h": "STRING", "g_h_2": "STRING"}
    clean = sanitize(df)
    got = {tuple(r) for r in clean.select("e", "f", "g_h", "g_h_2").collect()}
    assert got == {(None, None, None, None), (None, '{"x":1}', "[1]", "z")}
    assert dict(typed(clean, inferred).dtypes)["d"] == "timestamp"
    assert dict(sanitize(df, {"a": "STRING"}).dtypes)["a"] == "string"


def test_flatten(frame):
    df = frame([((1, "x"), [1, 2], 7, (5, "pro", "usd", "month"), [("a",)])],
               "customer struct<id:int,n:string>, tags array<int>, n int, "
               "plan struct<amount:int,id:string,currency:string,interval:string>, "
               "items array<struct<k:string>>")
    shop = X.flatten_suffixed(df)
    assert shop.columns == ["customer_json", "tags_json", "n", "plan_json", "items_json"]
    pay = X.flatten_payment(df).first().asDict()
    assert pay["customer"] == "1" and pay["tags"] == "[1,2]" and pay["plan_id"] == "pro"
    assert pay["plan_amount"] == 5 and pay["items_json"] == '[{"k":"a"}]'


@pytest.mark.parametrize("name,kind", [
    ("closedate", "timestamp"), ("num_contacts", "integer"), ("founded_year", "integer"),
    ("amount", "float"), ("annualrevenue", "float"), ("dealname", "string")])
def test_crm_types(name, kind):
    assert X.crm_type(name) == kind


def test_sheet(frame):
    df = frame([(0, ["A b", "", "A b"]), (1, ["1"]), (2, ["2", "x", "y", "extra"])],
               "row_idx int, cells array<string>")
    out = sheet_to_table(df)
    assert out.columns == ["a_b", "column", "a_b_2"]
    assert rows(out, "a_b", "column", "a_b_2") == [("1", None, None), ("2", "x", "y")]


def test_extract(frame):
    df = frame([(1, "2024-01-01", "2023-01-01"), (2, None, "2024-01-01"), (3, None, "2023-12-31"),
                (4, "2023-12-31", "2024-02-01")], "id int, updated_at string, created_at string")
    assert rows(extract(df, "2024-01-01 00:00:00"), "id") == [(1,), (2,)]
    assert extract(df).count() == 4
    with pytest.raises(ValueError):
        extract(df.select("id"), "2024-01-01")


def test_sample_and_preview(frame):
    df = frame([(i,) for i in range(50)], "id int")
    assert repeatable_sample(df, 9).collect() == repeatable_sample(df.repartition(3), 9).collect()
    assert table_preview(df, "synced_at", n=5).count() == 5
    assert [r["id"] for r in table_preview(df, "id", n=2).collect()] == [49, 48]


def test_second_sample_is_read_in_parts_of_bounded_size(spark):
    """More rows are dealt to more partitions, none of which grows with the table."""
    sizes = {f"spark.sql.adaptive.{k}": "64k" for k in (
        "advisoryPartitionSizeInBytes", "coalescePartitions.minPartitionSize")}
    before = {k: spark.conf.get(k) for k in sizes}
    try:
        for k, v in sizes.items():
            spark.conf.set(k, v)
        for n in (100_000, 400_000):
            df = spark.range(0, n, 1, 40).select("id", F.xxhash64("id").alias("v"))
            dealt = dealt_anew(df).groupBy(F.spark_partition_id()).agg(
                F.count(F.lit(1)).alias("n"), F.min("v")).collect()
            assert sum(r["n"] for r in dealt) == n
            assert max(r["n"] for r in dealt) <= 25_000
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    df = spark.range(500).selectExpr("id l_orderkey", "1 l_linenumber")
    assert sample(SimpleNamespace(lineitem=df)).first().asDict() == {"rows": 500, "found": 500, "repeats": True}


def test_campaign_rows(frame):
    roster = frame([("a", "A", 1, 3), ("b", None, 9, None)],
                   "campaign_id string, name string, status int, leads_count int")
    analytics = frame([("a", 10, 5, None, 2)],
                      "campaign_id string, contacted_count int, open_count int, "
                      "open_count_unique int, reply_count int")
    got = {r["campaign_id"]: r for r in
           O.engagement_rows(roster, analytics, synced_at="2024-01-01 00:00:00").collect()}
    assert (got["a"]["status"], got["a"]["opened"], got["a"]["open_rate"]) == ("active", 5, 50.0)
    assert (got["b"]["status"], got["b"]["name"], got["b"]["reply_rate"]) == ("draft", "", 0.0)
    assert got["a"]["total_leads"] == 3 and got["b"]["total_leads"] == 0


def test_text_status(frame):
    df = frame([("PAUSED",), (None,)], "status string")
    out = df.select(O.status_name(F.col("status"), df.schema["status"].dataType)).collect()
    assert [r[0] for r in out] == ["paused", "draft"]


# -- sinks -----------------------------------------------------------------------

def test_full_refresh_replaces_and_may_read_itself(spark, frame, root):
    name = fresh("t")
    first = full_refresh(frame([(1,), (2,)], "id int"), name, root)
    assert first.created and first.rows_found == 2
    again = full_refresh(current(spark, name).withColumn("x", F.lit(1)), name, root)
    assert not again.created and current(spark, name).columns == ["id", "x"]
    assert current(spark, fresh("missing")) is None


def test_append_adds_columns(frame, root):
    path = f"{root}/app"
    append_load(frame([(1,)], "id int"), path)
    assert rows(append_load(frame([(2, "x")], "id int, s string"), path), "id", "s") == [
        (1, None), (2, "x")]


def test_export_quotes(spark, frame, root):
    df = frame([(1, 'a "q", b'), (2, None)], "id int, s string")
    export_csv(df, f"{root}/csv")
    back = spark.read.csv(f"{root}/csv", header=True, quote='"', escape='"')
    assert rows(back, "id", "s") == [("1", 'a "q", b'), ("2", None)]


TARGET = "id int, v string, kept string"


def test_merge_rules(frame):
    target = frame([(1, "a", "k1"), (2, "b", "k2"), (None, "n", "k3")], TARGET)
    batch = frame([(2, "B", 9), (3, "C", 8), (None, "N", 7)], "id int, v string, extra int")
    out = merge(target, batch, ["id"])
    assert out.columns == ["id", "v", "kept", "extra"]
    assert rows(out, "id", "v", "kept", "extra") == sorted([
        (1, "a", "k1", None), (2, "B", "k2", 9), (3, "C", None, 8),
        (None, "n", "k3", None), (None, "N", None, 7)], key=str)  # NULL keys never match


def test_merge_writes_nulls_of_the_batch(frame):
    out = merge(frame([(1, "a", "k")], TARGET), frame([(1, None)], "id int, v string"), ["id"])
    assert rows(out, "id", "v", "kept") == [(1, None, "k")]


def test_merge_of_key_only_and_empty_tables(frame):
    keys = frame([(1,), (2,)], "id int")
    assert rows(merge(keys, frame([(2,), (3,)], "id int"), ["id"]), "id") == [(1,), (2,), (3,)]
    assert merge(keys.limit(0), keys, ["id"]).count() == 2
    assert merge(keys, keys.limit(0), ["id"]).count() == 2
    with pytest.raises(ValueError):
        merge(keys, keys, [])
    with pytest.raises(ValueError):
        merge(keys, keys, ["nope"])


def test_merge_duplicates(frame):
    target = frame([(1, "a", "k")], TARGET)
    batch = frame([(1, "old", 1), (1, "new", 2), (5, "x", None), (5, "y", 1)],
                  "id int, v string, at int")
    assert rows(merge(target, batch, ["id"], "at"), "id", "v", "at") == [
        (1, "new", 2), (5, "y", 1)]
    with pytest.raises(ValueError):
        merge(target, batch, ["id"], fail_on_duplicates=True)


def test_merge_on_two_keys_keeps_stored_types(frame):
    target = frame([(1, "x", 1.0)], "a int, b string, v double")
    out = merge(target, frame([(1, "x", 2), (1, "y", 3)], "a bigint, b string, v int"),
                ["a", "b"])
    assert dict(out.dtypes) == {"a": "int", "b": "string", "v": "double"}
    assert rows(out, "a", "b", "v") == [(1, "x", 2.0), (1, "y", 3.0)]


keyed = st.lists(st.tuples(st.one_of(st.none(), st.integers(0, 5)), st.integers(0, 9)),
                 max_size=8)


@settings(max_examples=12, deadline=None,
          suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(target=keyed, batch=keyed)
def test_merge_twice_is_merge_once(frame, target, batch):
    # NULL keys always insert, so only keyed rows can be repeated without effect
    schema = "id int, v int"
    t = frame([r for r in {r[0]: r for r in target if r[0] is not None}.values()], schema)
    b = frame([r for r in batch if r[0] is not None], schema)
    once = merge(t, b, ["id"], "v")
    expected = {r[0]: r[1] for r in target if r[0] is not None}
    for k, v in sorted((r for r in batch if r[0] is not None), key=lambda r: r[1]):
        expected[k] = v
    merged = dict(rows(once, "id", "v"))
    stored = {k for k, _ in target}
    assert set(merged) == set(expected)
    assert all(merged[k] == expected[k] for k in merged if k in {b[0] for b in batch})
    assert all(k in stored or k in {b[0] for b in batch} for k in merged)
    assert rows(merge(once, b, ["id"], "v"), "id", "v") == rows(once, "id", "v")


def test_dedupe_is_repeatable(frame):
    df = frame([(1, i % 3, str(i)) for i in range(60)], "id int, at int, v string")
    a = dedupe_latest(df, ["id"], "at").collect()
    assert a == dedupe_latest(df.repartition(5), ["id"], "at").collect() and len(a) == 1


# -- checkpoints and syncs ---------------------------------------------------------

def test_watermarks(frame):
    df = frame([("2024-01-01", "x", "2024-05-01"), ("2024-02-01T00:00:00Z", None, None),
                ("2024-02-01", "", None)], "updated_at string, synced_at string, at string")
    assert watermark(df).first().asDict() == {"cursor_field": "updated_at",
                                              "cursor_value": "2024-02-01"}
    assert watermark(df, "at").first()["cursor_value"] == "2024-05-01"
    assert watermark(df.select("synced_at")).first()["cursor_field"] is None
    assert watermark(df.select(F.col("at").alias("other"))).first()["cursor_field"] is None


def test_checkpoints_never_move_back(spark, frame):
    now = F.lit("2024-06-01 00:00:00").cast("timestamp")
    marks = "flow_id string, cursor_field string, cursor_value string, rows bigint"
    state = advance(spark.createDataFrame([], STATE_SCHEMA),
                    frame([("a", "at", "2024-02-01", 5)], marks), now)
    back = advance(state, frame([("a", "at", "2024-01-01", 2), ("b", None, None, 1)], marks), now)
    assert rows(back, "flow_id", "cursor_value", "rows_since") == [
        ("a", "2024-02-01", 7), ("b", None, 1)]
    assert rows(clear(back, "a"), "flow_id") == [("b",)]


def test_incremental_sync(spark, frame, root):
    obj = SourceObject("orders", fresh("orders"), ("id",), "updated_at")
    state, schema = fresh("state"), "id int, v string, updated_at string"
    with pytest.raises(ValueError):
        incremental_sync(frame([], schema), SourceObject("x", "x"), "f", root, state)
    first = frame([(1, "a", "2024-01-01"), (2, "b", "2024-01-02")], schema)
    assert incremental_sync(first, obj, "f", root, state).rows == 2
    # row 2 is on the boundary and read again; row 3 is new and brings a column
    later = frame([(1, "ignored", "2023-12-31", "-"), (2, "b2", "2024-01-02", "x"),
                   (3, "c", "2024-01-05", "y")], schema + ", extra string")
    second = incremental_sync(later, obj, "f", root, state)
    assert second.rows == 2 and second.columns_added == ("extra",) and second.target_rows == 3
    assert rows(current(spark, obj.table), "id", "v", "extra") == [
        (1, "a", None), (2, "b2", "x"), (3, "c", "y")]
    before = rows(current(spark, obj.table), "id", "v", "extra")
    assert incremental_sync(later, obj, "f", root, state).rows == 1  # the boundary row
    assert rows(current(spark, obj.table), "id", "v", "extra") == before
    nothing = later.where("id = 99")
    assert incremental_sync(nothing, obj, "f", root, state).rows == 0
    mark = checkpoint_of(spark, root, state, "f")
    assert (mark["cursor_value"], mark["rows_since"]) == ("2024-01-05", 5)


def test_bucketed_upserts_write_what_they_touch(spark, frame, root):
    """Against plain merges: evolution, null keys, doubles, a batch of one row, an empty one."""
    table, keys = fresh("wide"), ["id"]
    plain = frame([(i, f"v{i}") for i in range(500)] + [(None, "free")], "id long, v string")
    assert merge_into(plain, table, keys, root, buckets=16).target_rows == 501
    batches = [frame([(3, "x"), (700, "new"), (None, "free")], "id int, v string"),
               frame([(3, 1.5)], "id long, more double"),
               frame([(701, "a", 1), (701, "b", 2), (4, "c", 1)], "id long, v string, at int")]
    for k, batch in enumerate(batches):
        cursor = "at" if k == 2 else None
        plain = merge(plain, batch, keys, cursor)
        done = merge_into(batch, table, keys, root, cursor)
        assert done.buckets_written <= 3 and done.rows_written < 200
        now = current(spark, table)
        assert now.columns == plain.columns
        assert sorted(map(str, now.collect())) == sorted(map(str, plain.collect()))
    lay = layout(spark, table)
    assert lay.rows() == plain.count() == 504 and len(lay.live) == 16
    before = sorted(lay.live.items())
    assert merge_into(batches[0].limit(0), table, keys, root).rows_written == 0
    assert sorted(layout(spark, table).live.items()) == before
    with pytest.raises(ValueError):
        merge_into(batches[0], table, ["v"], root)
    with pytest.raises(ValueError):
        merge_into(batches[0], table, [], root)


def test_bucketed_tables_grow_and_fold(spark, frame, root, monkeypatch):
    """Full buckets are split fourfold; small versions are rewritten when there are many."""
    table = fresh("grow")
    rows_of = lambda a, b: frame([(i, i * 7) for i in range(a, b)], "id long, v long")
    merge_into(rows_of(0, 40), table, ["id"], root, buckets=4, full_bucket=20)
    merge_into(rows_of(30, 100), table, ["id"], root, full_bucket=20)
    assert layout(spark, table).n == 16
    monkeypatch.setattr(buckets, "MAX_VERSIONS", 3)
    for i in range(8):
        merge_into(rows_of(i, i + 1), table, ["id"], root)
        assert len(layout(spark, table).versions()) <= 3
    assert sorted(map(tuple, current(spark, table).collect())) == [(i, i * 7) for i in range(100)]
    empty = fresh("empty")
    merge_into(rows_of(0, 0), empty, ["id"], root)
    assert current(spark, empty).count() == 0
    merge_into(rows_of(0, 3), empty, ["id"], root)
    assert current(spark, empty).count() == 3


def test_plain_table_becomes_bucketed(spark, frame, root):
    table = fresh("plain")
    full_refresh(frame([(1, "a"), (2, "b")], "id int, v string"), table, root)
    assert merge_into(frame([(2, "c"), (3, "d")], "id int, v string"), table, ["id"], root).target_rows == 3
    assert rows(current(spark, table), "id", "v") == [(1, "a"), (2, "c"), (3, "d")]


def test_interleaved_syncs_keep_both_checkpoints(spark, frame, root):
    """Marks are only added: what two flows write at the same time stays, in any order."""
    now = lambda s: F.lit(f"2024-06-01 00:00:{s:02d}").cast("timestamp")
    marks, path = "flow_id string, cursor_field string, cursor_value string, rows bigint", f"{root}/marks"
    assert folded(read_marks(spark, path)).count() == 0
    a, b = read_marks(spark, path), read_marks(spark, path)     # both read before either writes
    append_marks(frame([("a", "at", "2024-02-01", 5)], marks), path, now(1))
    append_marks(frame([("b", "at", "9", 3)], marks), path, now(1))
    append_marks(frame([("a", "at", "2024-01-01", 2), ("b", "at", "10", 1)], marks), path, now(2))
    append_marks(frame([("a", None, None, 4), ("c", "at", "word", 1)], marks), path, now(3))
    append_marks(frame([("c", "at", "2024-01-01", 1), ("d", "x", "7", 1)], marks), path, now(4))
    append_marks(frame([("d", "y", "2", 1)], marks), path, now(5))
    assert rows(folded(read_marks(spark, path)), "flow_id", "cursor_field", "cursor_value", "rows_since") == [
        ("a", "at", "2024-02-01", 11), ("b", "at", "10", 4), ("c", "at", "word", 2), ("d", "y", "2", 2)]
    obj = lambda n: SourceObject(n, fresh(n), ("id",), "updated_at")
    data = frame([(1, "2024-01-01")], "id int, updated_at string")
    for flow in ("one", "two", "one"):
        incremental_sync(data, obj(flow), flow, root)
    assert rows(checkpoints(spark, root), "flow_id", "rows_since") == [("one", 2), ("two", 1)]


def test_sync_log_records_failures(spark, frame, root):
    good = frame([(1, "2024-01-01")], "id int, updated_at string")
    bad = good.withColumn("id", F.raise_error(F.lit("source broke")).cast("int"))
    log = sync_all({SourceObject("good", fresh("good")): good,
                    SourceObject("bad", fresh("bad")): bad}, root)
    assert rows(log, "flow_id", "status", "rows") == [
        ("all/bad", "failed", None), ("all/good", "success", 1)]
    obj, runs = SourceObject("o", fresh("o"), ("id",), "updated_at"), f"{root}/runs"
    logged_sync(good, obj, "f1", root, runs, fresh("state"))
    logged_sync(good, SourceObject("o", fresh("o")), "f2", root, runs, fresh("state"))
    assert rows(spark.read.parquet(runs), "flow_id", "status", "rows") == [
        ("f1", "success", 1), ("f2", "failed", None)]


# -- streams -----------------------------------------------------------------------

EVENTS = "id int, at timestamp, v double"


def land(frame, root, name, data):
    df = frame([(i, t, v) for i, t, v in data], "id int, t string, v double").select(
        "id", F.to_timestamp("t").alias("at"), "v")
    df.coalesce(1).write.parquet(f"{root}/in/{name}")
    return df


def event_stream(spark, root):
    return (spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1)
            .option("recursiveFileLookup", "true").parquet(f"{root}/in"))


def test_stream_upsert_over_many_batches(spark, frame, root):
    base = frame([(1, "one"), (4, "four")], "id int, name string")
    a = land(frame, root, "a", [(1, "2024-01-01", 1.0), (2, "2024-01-02", 2.0)])
    b = land(frame, root, "b", [(1, "2024-01-03", 3.0), (2, "2024-01-01", 9.0)])
    paths = (f"{root}/changes", f"{root}/ck")
    stream_changes(event_stream(spark, root), ["id"], *paths, cursor="at")
    state = current_state(base, read_changes(spark, paths[0]), ["id"], "at")
    assert rows(state, "id", "name", "v") == [(1, "one", 3.0), (2, None, 2.0), (4, "four", None)]
    batch = merge(base, a.unionByName(b), ["id"], "at")
    assert rows(batch, "id", "name", "v") == rows(state, "id", "name", "v")
    # later files continue from the stream's checkpoint
    land(frame, root, "c", [(4, "2024-01-04", 4.0)])
    stream_changes(event_stream(spark, root), ["id"], *paths, cursor="at")
    load = compact(base, read_changes(spark, paths[0]), ["id"], fresh("users"), root, "at")
    assert load.rows_found == 3
    assert rows(current(spark, load.table), "id", "v") == [(1, 3.0), (2, 2.0), (4, 4.0)]


def test_replayed_batch_changes_nothing(spark, frame, root):
    land(frame, root, "a", [(1, "2024-01-01", 1.0)])
    changes = f"{root}/changes"
    stream_changes(event_stream(spark, root), ["id"], changes, f"{root}/ck1", cursor="at")
    once = rows(read_changes(spark, changes), "id", "v", "batch_id")
    stream_changes(event_stream(spark, root), ["id"], changes, f"{root}/ck2", cursor="at")
    assert rows(read_changes(spark, changes), "id", "v", "batch_id") == once


def test_stream_daily_equals_batch(spark, frame, root):
    a = land(frame, root, "a", [(1, "2024-01-01 01:00:00", 1.0), (2, "2024-01-02 02:00:00", 2.0)])
    b = land(frame, root, "b", [(3, "2024-01-01 23:00:00", 4.0), (4, "2024-01-03 00:00:00", 8.0)])
    stream_daily(event_stream(spark, root), "at", f"{root}/days", f"{root}/ck",
                 Metric("v", "SUM"))
    state = daily_state(spark.read.parquet(f"{root}/days"))
    expected = time_series(a.unionByName(b), "at", Metric("v", "SUM"))
    assert rows(state, "bucket", "value") == rows(expected, "bucket", "value")


def test_numeric_cursors_are_compared_as_numbers(spark, frame):
    df = frame([(1, 999999999), (2, 1700000500), (3, None)], "id int, created bigint")
    assert watermark(df, "created").first()["cursor_value"] == "1700000500"
    assert [r["id"] for r in extract(df, "1700000500", ["created"]).collect()] == [2]
    assert sorted(r["id"] for r in extract(df, 999999999, ["created"]).collect()) == [1, 2]
    marks = "flow_id string, cursor_field string, cursor_value string, rows bigint"
    now = F.lit("2024-01-01").cast("timestamp")
    state = spark.createDataFrame([], STATE_SCHEMA)
    for value, expected in [("999999999", "999999999"), ("1700000500", "1700000500"),
                            ("1600000000", "1700000500"), ("soon", "1700000500")]:
        state = advance(state, frame([("a", "created", value, 1)], marks), now)
        assert state.first()["cursor_value"] == expected
    moved = advance(state, frame([("a", "seen", "soon", 1)], marks), now).first()
    assert (moved["cursor_field"], moved["cursor_value"], moved["rows_since"]) == ("seen", "soon", 5)
