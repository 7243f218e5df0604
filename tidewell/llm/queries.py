"""Registered queries: one per operator, over the whole tables, with SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.session import fresh_dir

from . import (additive, clusters, decontaminate, licenses, line_dedup, line_labels, near_dup,
               packing, passages, token_files, toxicity, warc, whitening)
from .common import importable, stage


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def op1_token_files(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    path = fresh_dir(spark, "tokens")
    token_files.write_tokens(_table(spark, folder, "documents"), path,
                             public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return token_files.read_tokens(token_files.index(spark, path), path).select(
        "doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op2_warc_records(spark: SparkSession, folder: str) -> DataFrame:
    path = fresh_dir(spark, "archives")
    warc.write_archives(_table(spark, folder, "pages"), path)
    files = spark.read.parquet(f"{path}/files")
    return warc.read_archives(files, path, payloads=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP2_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS payload_bytes, sha256(b) AS payload_digest FROM p),
r AS (SELECT *, CASE WHEN payload_bytes >= 100
        THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to FROM r
"""


def op3_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return near_dup.link(_table(spark, folder, "documents"))


def op4_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    paths = decontaminate.build(_table(spark, folder, "benchmark"))
    found = decontaminate.scan(_table(spark, folder, "documents"), paths)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
                        (F.col("n_hit") > 0).alias("contaminated"))


OP4_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9\x{80}-\x{10FFFF}]+') AS w
  FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9\x{80}-\x{10FFFF}]+') AS w
  FROM benchmark),
g AS (SELECT DISTINCT item, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS k
  FROM (SELECT item, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM g),
h AS (SELECT doc_id, i, n, item FROM (
    SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS k
    FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes
          WHERE len(w) >= n)) JOIN g USING (n, k)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
  FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
"""


def op5_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    model = toxicity.fit(docs, _table(spark, folder, "labels"))
    return toxicity.judged(toxicity.scan(docs, model), 0.3)


def op6_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    chain = line_labels.fit(docs, _table(spark, folder, "labels"))
    return line_labels.rate(docs, chain)


def op7_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return line_dedup.drop_shared_lines(_table(spark, folder, "documents")).select(
        "doc_id", "n_lines", "n_dropped",
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


OP7_SQL = r"""
WITH lines AS (
  SELECT doc_id, i, line,
    translate(trim(line, E' \t\n\x0b\f\r'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
              'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS i
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents))),
shared AS (SELECT k, max(doc_id) AS last FROM lines WHERE length(k) >= 20
           GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
marked AS (SELECT doc_id, i, line, coalesce(doc_id < last, false) AS lost
           FROM lines LEFT JOIN shared USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (lost) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT lost), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


def op8_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    model = additive.fit(docs, _table(spark, folder, "labels"))
    return toxicity.judged(additive.scored(docs, model), 0.7)


def op9_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan_digest(_table(spark, folder, "documents"))


def op10_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    rows = packing.pieces(_table(spark, folder, "documents"),
                          public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return packing.places(stage(packing.sequences(rows), "sequences"))


def op11_embedding_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whitened(_table(spark, folder, "embeddings"))


def op12_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return passages.without_repeats(_table(spark, folder, "documents")).select(
        "doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


OP12_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS k
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)),
late AS (SELECT doc_id, i FROM (
    SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS nth FROM g)
  WHERE nth > 1),
gone AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(i, i + 20)) AS p FROM late)),
parts AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d),
marked AS (SELECT doc_id, p, word, gone.p IS NOT NULL AS lost
  FROM parts LEFT JOIN gone USING (doc_id, p)),
sums AS (SELECT doc_id, count(*) FILTER (lost) AS n_removed,
    string_agg(word, ' ' ORDER BY p) FILTER (NOT lost) AS kept FROM marked GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed,
  sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN sums USING (doc_id)
"""


def op13_centroid_clustering(spark: SparkSession, folder: str) -> DataFrame:
    return clusters.with_inertia(*clusters.clustered(_table(spark, folder, "embeddings")))


def _op13_sql(k: int = clusters.CENTROIDS, rounds: int = clusters.ROUNDS) -> str:
    """Rounds spelled out: distances, nearest centroids, and means rounded down."""
    ctes = [f"""kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id,
  list_transform(embedding, lambda e: CAST(floor(CAST(e AS DOUBLE) * {clusters.SCALE}) AS BIGINT)) AS x
  FROM embeddings WHERE len(embedding) = {clusters.DIMENSION}
    AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = {clusters.DIMENSION})""",
            f"""v AS MATERIALIZED (SELECT r, unnest(x) AS x, generate_subscripts(x, 1) AS p FROM kept)""",
            f"""c0 AS MATERIALIZED (SELECT c, unnest(x) AS x, generate_subscripts(x, 1) AS p FROM (
  SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id), x) - 1 AS c, x FROM kept)
  WHERE c < {k})"""]
    for i in range(rounds + 1):
        ctes.append(f"""a{i} AS MATERIALIZED (SELECT r, c, distance FROM (
  SELECT r, c, distance, row_number() OVER (PARTITION BY r ORDER BY distance, c) AS nth FROM (
    SELECT r, c, CAST(sum((v.x - m.x) * (v.x - m.x)) AS BIGINT) AS distance
    FROM v JOIN c{i} m USING (p) GROUP BY r, c)) WHERE nth = 1)""")
        if i < rounds:
            ctes.append(f"""c{i + 1} AS MATERIALIZED (SELECT c, p,
    CASE WHEN n IS NULL THEN m.x ELSE (s - ((s % n) + n) % n) // n END AS x
  FROM c{i} m LEFT JOIN (SELECT c, p, CAST(sum(x) AS BIGINT) AS s, count(*) AS n
    FROM a{i} JOIN v USING (r) GROUP BY c, p) USING (c, p))""")
    ctes.append(f"""h AS (SELECT c, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY p)) AS sha
  FROM c{rounds} GROUP BY c)""")
    return "WITH " + ",\n".join(ctes) + f"""
SELECT vec_id, CAST(c AS INTEGER) AS cluster, distance,
  CAST(sum(distance) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
  CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha AS centroid_sha256
FROM a{rounds} JOIN kept USING (r) JOIN h USING (c)"""


QUERIES = {f.__name__: f for f in (
    op1_token_files, op2_warc_records, op3_near_duplicates, op4_decontaminate, op5_toxicity,
    op6_quality_rules, op7_line_dedup, op8_quality_classifier, op9_license_scan, op10_best_fit_packing,
    op11_embedding_whitening, op12_substring_dedup, op13_centroid_clustering)}
SQL = {"op2_warc_records": OP2_SQL, "op4_decontaminate": OP4_SQL, "op7_line_dedup": OP7_SQL,
       "op12_substring_dedup": OP12_SQL, "op13_centroid_clustering": _op13_sql()}
