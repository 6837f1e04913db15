"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import (ball_tree, centroids, decontam, hnsw, mixing, packing, pii, quality, sharding, simhash, token_count, toxicity,
               warc)
from .common import read, text_bytes


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, read(spark, sf_dir, "labels")))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).drop("spans")


def op3_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.search(read(spark, sf_dir, "embeddings"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents"), targets_first=True)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    counted = token_count.count_tokens(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 1024)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = warc.archive_path(spark)
    warc.write_archive(read(spark, sf_dir, "pages"), path)
    return warc.read_archive(spark, path, payloads=False).select(
        F.col("page_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        F.col("refers_to").cast("long").alias("refers_to"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(read(spark, sf_dir, "documents")).drop("keeper")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, read(spark, sf_dir, "labels")))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find_pii(read(spark, sf_dir, "documents")))


def op10_histogram_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    crc = F.crc32(text_bytes("text"))
    # taken before the exchange, so that no text is exchanged
    out = sharding.histogram_shards(docs, "doc_id", "text", extra={"text_crc32": crc}, keep=["doc_id"])
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    return packing.pack(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(read(spark, sf_dir, "embeddings"))


def op13_ball_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ball_tree.rank(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (
    op1_quality_rules, op2_decontaminate, op3_hnsw, op4_mixing, op5_token_counts, op6_warc, op7_simhash, op8_toxicity, op9_pii,
    op10_histogram_shards, op11_packing, op12_centroids, op13_ball_tree)}

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"



def _pii_sql() -> str:
    """Matches and what stands between them give the positions, kind by kind."""
    patterns = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "true"),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "len(list_filter(string_split(t, '.'), lambda x: CAST(x AS DOUBLE) > 255)) = 0"),
        "card": (r"[0-9]([\x20-]?[0-9])+", """len(regexp_replace(t, '[^0-9]', '', 'g')) BETWEEN 13 AND 19 AND list_sum(list_transform(
            string_split(reverse(regexp_replace(t, '[^0-9]', '', 'g')), ''),
            lambda c, k: CASE WHEN k % 2 = 1 THEN CAST(c AS INT) WHEN c >= '5' THEN 2 * CAST(c AS INT) - 9 ELSE 2 * CAST(c AS INT) END)) % 10 = 0"""),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "len(regexp_replace(t, '[^0-9]', '', 'g')) BETWEEN 9 AND 15"),
        "iban": (r"\b[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}\b", """list_reduce(list_transform(string_split('0' || substr(t, 5) || substr(t, 1, 4), ''),
            lambda c: CASE WHEN c <= '9' THEN CAST(c AS INT) ELSE ascii(c) - 55 END),
            lambda a, x: (CASE WHEN x < 10 THEN a * 10 + x ELSE a * 100 + x END) % 97) = 1"""),
    }
    parts, ctes = [], []
    for n, (kind, (pattern, ok)) in enumerate(patterns.items()):
        ctes.append(f"""{kind}_m AS (SELECT r, text, regexp_extract_all(text, '{pattern}') AS m, regexp_split_to_array(text, '{pattern}') AS p FROM d),
{kind}_s AS (SELECT r, text, m[i] AS t, CAST(list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS a
  FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM {kind}_m)),
{kind}_v AS (SELECT r, {n} AS o, '{kind}' AS kind, a, a + length(t) AS b,
  {pii.SCORE[kind]} + CASE WHEN regexp_matches(substr(text, greatest(a - {pii.NEAR - 1}, 1), least(a, {pii.NEAR})) || ' ' || substr(text, a + length(t) + 1, {pii.NEAR}),
    '(?i)(^|[^\\p{{L}}])({pii.CONTEXT[kind]})') THEN 0.1 ELSE 0 END AS score FROM {kind}_s WHERE {ok})""")
        parts.append(f"SELECT * FROM {kind}_v")
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
{", ".join(ctes)},
v AS ({" UNION ALL ".join(parts)}),
g AS (SELECT r, count(*) FILTER (WHERE kind = 'email') AS n_email, count(*) FILTER (WHERE kind = 'ip') AS n_ip,
        count(*) FILTER (WHERE kind = 'card') AS n_card, count(*) FILTER (WHERE kind = 'phone') AS n_phone,
        string_agg(kind || ':' || a || ':' || b, ',' ORDER BY o, a) FILTER (WHERE o < 4) AS base,
        string_agg(kind || ':' || a || ':' || b, ',' ORDER BY o, a) AS spans, max(score) AS score FROM v GROUP BY r)
SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, round(coalesce(CAST(score AS DOUBLE), 0), 2) AS max_score
FROM d LEFT JOIN g USING (r)
"""


def _clusters_sql(rounds: int = 10) -> str:
    """One pair of tables per round: assignments (a) and centroids (c)."""
    near = """a{n} AS MATERIALIZED (SELECT r, min_by(k, (far, k)) AS k, min(far) AS far FROM (
  SELECT r, k, sum((x - y) * (x - y)) AS far FROM v JOIN c{n} USING (d) GROUP BY r, k) GROUP BY r)"""
    moved = """c{m} AS MATERIALIZED (SELECT k, d, coalesce(y1, y) AS y FROM c{n} LEFT JOIN (
  SELECT k, d, (s - ((s % n + n) % n)) // n AS y1 FROM (SELECT k, d, sum(x) AS s, count(*) AS n FROM a{n} JOIN v USING (r) GROUP BY k, d)) USING (k, d))"""
    steps = []
    for n in range(rounds):
        steps += [near.format(n=n), moved.format(n=n, m=n + 1)]
    return f"""
WITH kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, embedding AS e FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
v AS MATERIALIZED (SELECT r, unnest(range(64)) AS d, CAST(floor(1024 * CAST(unnest(e) AS DOUBLE)) AS HUGEINT) AS x FROM kept),
s AS MATERIALIZED (SELECT r, row_number() OVER (ORDER BY sha256('3:' || vec_id) NULLS LAST, list_transform(e, lambda x: floor(1024 * CAST(x AS DOUBLE)))) - 1 AS k FROM kept),
c0 AS MATERIALIZED (SELECT k, d, x AS y FROM s JOIN v USING (r) WHERE k < 8),
{", ".join(steps)},
{near.format(n=rounds)},
sha AS (SELECT k, sha256(string_agg(CAST(y AS VARCHAR), ',' ORDER BY d)) AS centroid_sha256 FROM c{rounds} GROUP BY k)
SELECT vec_id, CAST(k AS INT) AS cluster, CAST(far AS BIGINT) AS distance, CAST(sum(far) OVER (PARTITION BY k) AS BIGINT) AS cluster_inertia,
       CAST(sum(far) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM a{rounds} JOIN kept USING (r) JOIN sha USING (k)
"""


_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

SQL = {
    "op2_decontaminate": f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, unnest(CASE WHEN len(w) BETWEEN 1 AND 9 THEN [array_to_string(w, ' ')]
         ELSE list_transform(range(1, len(w) - 8), lambda i: array_to_string(w[i:i + 9], ' ')) END) AS win FROM b),
lens AS (SELECT DISTINCT len(string_split(win, ' ')) AS n FROM bw),
dw AS (SELECT r, n, unnest(range(1, len(w) - n + 2)) AS i, w FROM d, lens WHERE len(w) >= n),
hit AS (SELECT r, i, n, item_id FROM (SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS win FROM dw) JOIN bw USING (win)),
words AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hit) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids
          FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS s FROM hit WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)
""",
    "op6_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, h, octet_length(encode(h)) AS payload_bytes,
        array_to_string(list_transform(string_split(sha1(h), ''), lambda c: substr(
          '0000000100100011010001010110011110001001101010111100110111101111', 4 * strpos('0123456789abcdef', c) - 3, 4)), '') AS bits,
        row_number() OVER (PARTITION BY h ORDER BY page_id DESC) AS place, max(page_id) OVER (PARTITION BY h) AS winner FROM p)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + 16 * CAST(substr(bits, 5 * i + 1, 1) AS INT) + 8 * CAST(substr(bits, 5 * i + 2, 1) AS INT) + 4 * CAST(substr(bits, 5 * i + 3, 1) AS INT)
      + 2 * CAST(substr(bits, 5 * i + 4, 1) AS INT) + CAST(substr(bits, 5 * i + 5, 1) AS INT), 1)), '') AS payload_digest,
  CASE WHEN place = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN place > 1 THEN winner END AS refers_to
FROM d
""",
    "op9_pii": _pii_sql(),
    "op12_centroids": _clusters_sql(),
    "op13_ball_tree": f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS w FROM documents),
st AS (SELECT count(*) AS docs, sum(len(w)) AS total FROM d WHERE len(w) > 0),
i AS (SELECT row_number() OVER () AS i, item_id, w FROM (SELECT DISTINCT item_id, text, {_TERMS} AS w FROM benchmark)),
q AS (SELECT i, t, count(*) AS times FROM (SELECT i, unnest(w) AS t FROM i) GROUP BY i, t),
tf AS (SELECT r, n, t, count(*) AS tf FROM (SELECT r, len(w) AS n, unnest(w) AS t FROM d) WHERE t IN (SELECT t FROM q) GROUP BY r, n, t),
df AS (SELECT t, CAST(floor(1000 * ln((2 * any_value(docs) + 2) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS weight FROM tf, st GROUP BY t),
x AS (SELECT r, t, weight * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // total))) AS x FROM tf JOIN df USING (t), st),
s AS (SELECT i, r, sum(times * x) AS score FROM q JOIN x USING (t) GROUP BY i, r HAVING sum(times * x) > 0),
top AS (SELECT i, r, score, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s JOIN d USING (r))
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, CAST(score AS BIGINT) AS score
FROM top JOIN i USING (i) JOIN d USING (r) WHERE rank <= 20
""",
}
