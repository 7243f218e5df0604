"""Catalogs, classification, lineage, search, chart suggestions, versions."""

from pyspark.sql import functions as F

from ..operators import catalog as C
from ..operators import lineage as L
from ..operators import search as S
from ..operators.joins import schema_diff
from ..operators.telemetry import BYTES_PER_ROW
from ..plans import charts, semantic
from ..plans import vocabulary as V
from .base import FLOWS_SQL, NAMES, STATEMENTS_SQL, columns_sql, query, timed

COLUMNS_SQL = columns_sql()


def _columns(t):
    return C.column_catalog(t.all)


def _in(values):
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def _quoted(pattern):
    return "'" + pattern.replace("'", "''") + "'"


CLASS_SQL = ("CASE " + " ".join(f"WHEN declared_type = '{d}' THEN '{c}'"
                                for d, c in V.DECLARED_CLASSES.items())
             + " " + " ".join(f"WHEN regexp_matches(column_name, {_quoted(p)}, 'i') THEN '{c}'"
                              for p, c in V.NAME_RULES)
             + " WHEN declared_type = 'number' THEN 'number' WHEN declared_type = 'string' "
               "THEN 'text' ELSE 'unknown' END")
ROLE_SQL = f"""CASE WHEN semantic_class IN {_in(V.TIME_CLASSES)} THEN 'time'
  WHEN semantic_class IN {_in(V.ID_CLASSES)} THEN 'identifier'
  WHEN semantic_class IN {_in(V.ALWAYS_METRIC)} THEN 'metric'
  WHEN semantic_class IN {_in(V.METRIC_CLASSES)}
    AND (declared_type = 'number' OR semantic_class = 'number') THEN 'metric'
  WHEN semantic_class IN {_in(V.METRIC_CLASSES + V.DIMENSION_CLASSES)} THEN 'dimension'
  ELSE 'detail' END"""
CLASSIFIED_SQL = f"""(SELECT *, {ROLE_SQL} AS role FROM (
  SELECT *, {CLASS_SQL} AS semantic_class FROM {COLUMNS_SQL}))"""


# Names, types and order as the database itself reads them from the files.
@query("schema_columns", f"""
SELECT i.table_name, i.column_name, i.is_nullable = 'YES' AS is_nullable,
  CASE i.data_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double'
    WHEN 'VARCHAR' THEN 'string' WHEN 'TIMESTAMP' THEN 'timestamp_ntz'
    WHEN 'FLOAT[]' THEN 'array<float>' ELSE i.data_type END AS data_type,
  CASE WHEN i.data_type IN ('BIGINT', 'INTEGER', 'DOUBLE') THEN 'number'
    WHEN i.data_type = 'VARCHAR' THEN 'string' WHEN i.data_type = 'TIMESTAMP' THEN 'timestamp'
    WHEN i.data_type LIKE '%[]' THEN 'array' END AS declared_type,
  i.ordinal_position, c.total_rows, c.filled_rows
FROM information_schema.columns i LEFT JOIN {COLUMNS_SQL} c
  ON c.table_name = i.table_name AND c.column_name = i.column_name
WHERE i.table_name IN {_in(NAMES)}""")
def schema_columns(t):
    return C.column_catalog({n: t.spark.read.parquet(t.path(n)) for n in NAMES})


@query("classify_columns", f"""
SELECT table_name, column_name, ordinal_position, filled_rows, semantic_class, role,
  list_aggregate(list_transform(string_split(regexp_replace(column_name, '[_-]+', ' ', 'g'), ' '),
    lambda w: upper(w[1:1]) || w[2:]), 'string_agg', ' ') AS label,
  semantic_class IN {_in(V.MONETARY)} AS is_monetary,
  semantic_class IN {_in(V.RATIO)} AS is_ratio,
  semantic_class IN {_in(V.INVERSE)} AS is_inverse FROM {CLASSIFIED_SQL}""")
def classify_columns(t):
    return semantic.classify_catalog(_columns(t)).select(
        "table_name", "column_name", "ordinal_position", "filled_rows", "semantic_class", "role",
        "label", "is_monetary", "is_ratio", "is_inverse")


@query("detect_concepts", f"""
SELECT table_name, concept, count(*) AS columns,
  arg_min(column_name, ordinal_position) AS first_column, sum(filled_rows)::BIGINT AS filled_rows
FROM {CLASSIFIED_SQL} JOIN (VALUES {", ".join(f"('{c}', '{k}')" for c, ks in V.CONCEPTS.items()
                                             for k in ks)}) m(concept, cls)
  ON cls = semantic_class GROUP BY 1, 2""")
def detect_concepts(t):
    classified = semantic.classify_catalog(_columns(t))
    filled = semantic.concept_columns(classified).groupBy("table_name", "concept").agg(
        F.sum("filled_rows").alias("filled_rows"))
    return semantic.detect_concepts(classified).join(filled, ["table_name", "concept"])


_ROWS_SQL = "(" + " UNION ALL ".join(
    f"SELECT '{n}' AS table_name, count(*) AS total_rows FROM {n}" for n in NAMES) + ")"


@query("table_inventory", f"SELECT * FROM {_ROWS_SQL}")
def table_inventory(t):
    return C.table_inventory(t.all, {n: t.path(n) for n in NAMES}).select(
        "table_name", "total_rows")


@query("table_bytes")
def table_bytes(t):
    return C.table_inventory(t.all, {n: t.path(n) for n in NAMES}).select(
        "table_name", "total_rows", "total_bytes")


def _estimated(t):
    """Inventory with sizes estimated from rows; tables with a time column count as
    partitioned."""
    times = C.discover_tables(_columns(t)).select(
        "table_name", F.col("partition_candidate").isNotNull().alias("is_partitioned"))
    return (C.table_rows(t.all).join(times, "table_name")
            .withColumn("total_bytes", F.col("total_rows") * BYTES_PER_ROW))


_ESTIMATED_SQL = f"""(SELECT r.*, table_name IN ('orders', 'lineitem', 'events')
  AS is_partitioned, total_rows * 500 AS total_bytes FROM {_ROWS_SQL} r)"""


@query("storage_totals", f"""
SELECT CAST(sum(total_bytes) AS BIGINT) AS total_bytes,
  count(*) FILTER (is_partitioned) AS partitioned_count,
  count(*) FILTER (NOT is_partitioned) AS unpartitioned_count,
  round(CAST(sum(total_bytes) AS BIGINT) / 1e9, 2) AS total_gb FROM {_ESTIMATED_SQL}""")
def storage_totals(t):
    return C.storage_totals(_estimated(t))


@query("tables_sorted", f"""
SELECT table_name, total_rows, total_bytes FROM {_ESTIMATED_SQL}
WHERE contains(table_name, 'e') ORDER BY total_bytes DESC, table_name""")
def tables_sorted(t):
    return C.tables_sorted(_estimated(t), "total_bytes", search="E").select(
        "table_name", "total_rows", "total_bytes")


@query("catalog_tree", f"""
SELECT table_name, max(total_rows) AS total_rows,
  string_agg(column_name || ' ' || data_type, ', ' ORDER BY ordinal_position) AS columns
FROM {COLUMNS_SQL} GROUP BY 1""")
def catalog_tree(t):
    return C.catalog_tree(_columns(t)).withColumn("columns", F.array_join(F.transform(
        "columns", lambda c: F.concat_ws(" ", c["column_name"], c["data_type"])), ", "))


@query("discover_tables", f"""
SELECT table_name, max(total_rows) AS total_rows, count(*) AS columns,
  count(*) FILTER (role = 'metric') AS metrics,
  count(*) FILTER (role = 'dimension') AS dimensions,
  arg_min(column_name, ordinal_position) FILTER (role = 'time') AS partition_candidate,
  arg_min(column_name, ordinal_position) FILTER (role = 'dimension') AS cluster_candidate
FROM {CLASSIFIED_SQL} GROUP BY 1""")
def discover_tables(t):
    return C.discover_tables(_columns(t))


@query("schema_diff", """
SELECT 'orders' AS table_name, column_name, old_type, new_type, change, n AS rows
FROM (VALUES ('o_orderpriority', 'string', NULL, 'removed'), ('o_year', NULL, 'int', 'added'),
  ('o_totalprice', 'double', 'string', 'changed')) v(column_name, old_type, new_type, change),
  (SELECT count(*) AS n FROM orders)""")
def diff(t):
    old, now = t.orders, t.orders.drop("o_orderpriority").withColumns(
        {"o_year": F.year("o_orderdate"), "o_totalprice": F.col("o_totalprice").cast("string")})
    before, after = C.column_catalog({"orders": old}), C.column_catalog({"orders": now})
    rows = after.agg(F.max("total_rows")).scalar()
    return schema_diff(before, after).withColumn("rows", rows)


_REFS_SQL = r"""(SELECT DISTINCT s.id, lower(r.ref) AS ref FROM """ + STATEMENTS_SQL + r""" s,
  unnest(regexp_extract_all(s.sql, '(?i)\b(?:FROM|JOIN)\s+`?([a-zA-Z0-9_][a-zA-Z0-9_.\-]*)`?',
    1)) r(ref))"""
_TABLES_SQL = f"(SELECT DISTINCT warehouse_table FROM {FLOWS_SQL})"
_QUERY_EDGES_SQL = f"""(SELECT DISTINCT 'table_' || warehouse_table AS from_node,
  'query_' || id AS to_node, 'query' AS label FROM {_REFS_SQL} r JOIN {_TABLES_SQL} t
  ON string_split(ref, '.')[-1] = warehouse_table)"""


def _query_edges(t):
    tables = t.flows().select(F.col("warehouse_table").alias("table_name"))
    return L.statement_edges(t.statements(), tables)


@query("lineage_edges", f"""
SELECT 'source_' || source_id AS from_node, 'flow_' || id AS to_node, 'extract' AS label
FROM {FLOWS_SQL}
UNION ALL SELECT 'flow_' || id, 'table_' || warehouse_table, 'load' FROM {FLOWS_SQL}
UNION ALL SELECT * FROM {_QUERY_EDGES_SQL}""")
def lineage_edges(t):
    return L.flow_edges(t.flows()).unionByName(_query_edges(t))


@query("lineage_nodes", f"""
SELECT DISTINCT 'source_' || source_id AS node_id, 'source' AS type, source_id AS label
FROM {FLOWS_SQL}
UNION ALL SELECT 'flow_' || id, 'flow', CAST(id AS VARCHAR) FROM {FLOWS_SQL}
UNION ALL SELECT DISTINCT 'table_' || warehouse_table, 'table', warehouse_table FROM {FLOWS_SQL}
UNION ALL SELECT DISTINCT to_node, 'query', to_node[7:] FROM {_QUERY_EDGES_SQL}""")
def lineage_nodes(t):
    return L.lineage_nodes(t.flows(), _query_edges(t))


@query("query_audit", f"""
SELECT id, CASE WHEN text = '' THEN 'empty'
  WHEN NOT regexp_matches(text, '(?i)^(select|with)\\b') THEN 'not_select'
  WHEN regexp_matches(text, '(?i)\\b(insert|update|delete|drop|create|alter|merge|truncate|grant|revoke|call|begin|commit|export)\\b')
    THEN 'forbidden' ELSE 'ok' END AS verdict
FROM (SELECT id, trim(regexp_replace(regexp_replace(sql, '(?m)--.*$', '', 'g'),
  '(?s)/\\*.*?\\*/', '', 'g'), ' ' || chr(10)) AS text FROM {STATEMENTS_SQL})""")
def query_audit(t):
    return L.read_only_verdicts(t.statements()).select("id", "verdict")


@query("query_audit_documents", """
SELECT doc_id, CASE WHEN text = '' THEN 'empty'
  WHEN NOT regexp_matches(text, '(?i)^(select|with)\\b') THEN 'not_select'
  WHEN regexp_matches(text, '(?i)\\b(insert|update|delete|drop|create|alter|merge|truncate|grant|revoke|call|begin|commit|export)\\b')
    THEN 'forbidden' ELSE 'ok' END AS verdict
FROM (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '(?m)--.*$', '', 'g'),
  '(?s)/\\*.*?\\*/', '', 'g'), '^\\s+|\\s+$', '', 'g') AS text FROM documents)""")
def query_audit_documents(t):
    return L.read_only_verdicts(t.documents, "text").select("doc_id", "verdict")


@query("unknown_refs", f"""
SELECT id AS statement_id, ref FROM {_REFS_SQL} r WHERE NOT EXISTS (
  SELECT 1 FROM {_TABLES_SQL} t WHERE r.ref IN ('wh.sales.' || warehouse_table,
    'sales.' || warehouse_table, warehouse_table))""")
def unknown_refs(t):
    known = t.flows().select(F.concat(F.lit("wh.sales."), "warehouse_table").alias("table_name"))
    return L.unknown_refs(t.statements(), known).select("statement_id", "ref")


def _search_sql(names_sql, n, fallback):
    top = f"""top AS (SELECT * FROM (SELECT *, row_number() OVER (
    PARTITION BY question_id ORDER BY score DESC, entity) AS position FROM scored)
    WHERE position <= {n})"""
    filler = f"""UNION ALL SELECT q.question_id, e.entity, 0, e.p FROM questions q, (
    SELECT entity, row_number() OVER (ORDER BY entity) AS p
    FROM (SELECT DISTINCT entity FROM names)) e
  WHERE e.p <= {n} AND q.question_id NOT IN (SELECT question_id FROM scored)"""
    stop = _in(S.tokens.__globals__["STOP_WORDS"])
    return f"""
WITH questions AS (SELECT conv_id * 1000000 + turn AS question_id, text FROM conversations
    WHERE role = 'user'),
  words AS (SELECT question_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS token
    FROM questions),
  used AS (SELECT question_id, token, count(*) AS uses FROM words
    WHERE length(token) > 2 AND token NOT IN {stop} GROUP BY 1, 2),
  names AS ({names_sql}),
  index AS (SELECT token, entity, max(weight) AS weight
    FROM (SELECT DISTINCT token FROM used), names WHERE contains(lower(name), token)
    GROUP BY 1, 2),
  scored AS (SELECT question_id, entity, CAST(sum(uses * weight) AS BIGINT) AS score
    FROM used JOIN index USING (token) GROUP BY 1, 2),
  {top}
SELECT * FROM top {filler if fallback else ''}"""


def _questions(t):
    return t.conversations.where(F.col("role") == "user").select(
        (F.col("conv_id") * 1000000 + F.col("turn")).alias("question_id"), "text")


# Searched names: the distinct part names and brands, as tables and their columns.
@query("table_search", _search_sql(
    "SELECT p_name AS entity, p_name AS name, 3 AS weight FROM part "
    "UNION SELECT p_name, p_type, 1 FROM part", 8, True))
def table_search(t):
    columns = t.part.select(F.col("p_name").alias("table_name"),
                            F.col("p_type").alias("column_name")).distinct()
    return S.search(_questions(t), S.table_names(columns), S.MAX_TABLES, fallback=True)


@query("model_search", _search_sql(
    "SELECT p_brand AS entity, p_brand || ' ' || p_name AS name, 2 AS weight FROM part", 4, False))
def model_search(t):
    models = t.part.select(F.col("p_brand").alias("name"), F.col("p_name").alias("description"))
    return S.search(_questions(t), S.model_names(models.distinct()), S.MAX_MODELS)


@query("model_versions", """
SELECT model_id, row_number() OVER (PARTITION BY model_id ORDER BY edited_at, edit_id) AS version,
  sql, strftime(edited_at, '%Y-%m-%d %H:%M:%S') AS edited_at FROM (
  SELECT *, lag(sql) OVER (PARTITION BY model_id ORDER BY edited_at, edit_id) AS prev FROM (
    SELECT o_custkey AS model_id, o_orderdate AS edited_at, o_orderkey AS edit_id,
      o_orderstatus AS sql FROM orders))
WHERE prev IS NULL OR prev <> sql""")
def model_versions(t):
    edits = t.orders.select(
        F.col("o_custkey").alias("model_id"), F.col("o_orderdate").alias("edited_at"),
        F.col("o_orderkey").alias("edit_id"),
        F.concat(F.lit(" "), "o_orderstatus", F.lit("  ")).alias("sql"))
    return timed(L.model_versions(edits), "edited_at")


# All edits in one history on one day: slices of equal size keep it in many tasks.
@query("model_versions_hot", """
SELECT region, version, event_type, event_id FROM (
  SELECT 0 AS region, row_number() OVER (ORDER BY s, event_id) AS version, event_type, event_id
  FROM (SELECT *, lag(event_type) OVER (ORDER BY s, event_id) AS prev
    FROM (SELECT *, floor(epoch(ts)) AS s FROM events))
  WHERE prev IS NULL OR prev <> event_type)""")
def model_versions_hot(t):
    # microseconds since the first day, as many as there were seconds
    day = F.lit("2024-01-01").cast("timestamp_ntz")
    squeezed = F.timestamp_micros(F.unix_micros(day.cast("timestamp"))
                                  + (F.unix_seconds(F.col("ts").cast("timestamp"))
                                     - F.unix_seconds(day.cast("timestamp"))))
    edits = t.events.select(F.lit(0).alias("model_id"), squeezed.alias("edited_at"),
                            F.col("event_id").alias("edit_id"), F.col("event_type").alias("sql"))
    versions = L.changes(edits, "model_id", ["edited_at", "edit_id"], F.col("sql"))
    return versions.select(F.col("model_id").alias("region"), F.col("seq").alias("version"),
                           F.col("value").alias("event_type"),
                           F.col("edit_id").alias("event_id"))


def _kind_sql():
    return f"""CASE WHEN declared_type = 'number' THEN 'num'
  WHEN declared_type = 'timestamp' THEN 'time'
  WHEN regexp_matches(column_name, {_quoted(charts.GEO_NAMES)}) THEN 'geo'
  WHEN declared_type IN ('boolean', 'string') THEN 'cat' ELSE 'other' END"""


def _chart_sql():
    def nth(kind, i):
        return (f"list(column_name ORDER BY ordinal_position) FILTER (k = '{kind}')[{i}]")

    rules = " UNION ALL ".join(
        f"SELECT table_name, total_rows, {i} AS rule, '{chart}' AS chart, {score} AS score, "
        f"CAST({charts.X_AXIS.get(chart, 'cat_field')} AS VARCHAR) AS x_field, "
        f"CAST({charts.Y_AXIS.get(chart, 'num_1')} AS VARCHAR) AS y_field, "
        f"CAST({charts.COLOUR.get(chart, 'null')} AS VARCHAR) AS color_field, "
        f"CAST({charts.SIZE.get(chart, 'null')} AS VARCHAR) AS size_field, "
        f"'{charts.REASON[chart]}' AS reason FROM facts WHERE {cond}"
        for i, (chart, score, cond) in enumerate(charts.CHART_RULES))
    lists = ", ".join(
        f"list(column_name ORDER BY ordinal_position) FILTER (k = '{k}') AS l_{k}, "
        f"count(*) FILTER (k = '{k}') AS {k}" for k in ("num", "cat", "time", "geo"))

    def preferred(kind, pattern):
        return (f"coalesce(list_filter(l_{kind}, lambda n: regexp_matches(n, "
                f"{_quoted(pattern)}))[1], l_{kind}[1])")

    return f"""
WITH kinds AS (SELECT *, {_kind_sql()} AS k FROM {COLUMNS_SQL}),
  listed AS (SELECT table_name, max(total_rows) AS total_rows, count(*) AS total, {lists}
    FROM kinds GROUP BY 1),
  facts AS (SELECT *, l_num[1] AS num_1, l_num[2] AS num_2, l_num[3] AS num_3, l_cat[1] AS cat_1,
    l_cat[2] AS cat_2, {preferred('cat', charts.LABEL_NAMES)} AS cat_field,
    {preferred('time', charts.DATE_NAMES)} AS time_field,
    l_geo[1] AS geo_x, l_num[1] AS geo_y FROM listed),
  rules AS ({rules})
SELECT table_name, total_rows, position, chart, score, x_field, y_field, color_field, size_field,
  reason FROM (
  SELECT *, row_number() OVER (PARTITION BY table_name ORDER BY score DESC, rule) AS position
  FROM rules) WHERE position <= 6"""


@query("chart_suggestions", _chart_sql())
def chart_suggestions(t):
    columns = _columns(t)
    rows = columns.groupBy("table_name").agg(F.max("total_rows").alias("total_rows"))
    return charts.chart_suggestions(columns).join(rows, "table_name")


@query("chart_fit", f"""
WITH c AS ({_chart_sql()})
SELECT t.table_name, coalesce(c.score, 20) AS score, coalesce(c.score, 20) >= 50 AS suitable,
  t.total_rows FROM (SELECT table_name, max(total_rows) AS total_rows FROM {COLUMNS_SQL}
  GROUP BY 1) t LEFT JOIN c ON c.table_name = t.table_name AND c.chart = 'bar'""")
def chart_fit(t):
    columns = _columns(t)
    rows = columns.groupBy("table_name").agg(F.max("total_rows").alias("total_rows"))
    return charts.chart_fit(columns, "bar").join(rows, "table_name")
