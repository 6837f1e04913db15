"""Registered similarity-search queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ticketflow.functions import text
from ticketflow.operators import lifecycle as L
from ticketflow.operators import lsh, near
from ticketflow.operators import search as K
from ticketflow.plans.registry import register, round_doubles
from ticketflow.sources import adapters as A
from ticketflow.streaming import jobs
from ticketflow.streaming.text_index import TextIndex

_COS = """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, label FROM vectors),
n AS (SELECT vec_id, e, label, sqrt(list_dot_product(e, e)) AS norm FROM v),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e) / (q.norm * c.norm) AS similarity
      FROM n q, n c WHERE q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND q.norm > 0 AND c.norm > 0 {extra})
SELECT query_id, vec_id, round(similarity, 6) AS similarity, CAST(rank AS INTEGER) AS rank,
       CAST(floor(similarity * 100 + 0.5) AS BIGINT) AS similarity_pct FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(similarity, 9) DESC, vec_id) AS rank FROM s)
WHERE rank <= 5"""


def _asked(v):
    """The query set: every vector whose id is divisible by 50."""
    return v.where(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("query_id"), "embedding")


@register("similar_vectors", _COS.format(extra=""), ("vectors",))
def q_similar_vectors(spark, d):
    """K1 + E15: exact cosine top-5 neighbours, over all embeddings, of every one whose
    id is divisible by 50 (itself excluded)."""
    v = A.vectors(spark, d)
    top = K.similar_vectors(_asked(v), v, k=5, exclude_self=True)
    return round_doubles(top.withColumn("similarity_pct", text.similarity_pct("similarity")))


@register("similar_vectors_label3", _COS.format(extra="AND c.label = 3"), ("vectors",))
def q_similar_vectors_label3(spark, d):
    """K1 + K4: the corpus restricted by an attribute (label = 3) before ranking."""
    v = A.vectors(spark, d)
    top = K.similar_vectors(_asked(v), v.where(F.col("label") == 3), k=5, exclude_self=True)
    return round_doubles(top.withColumn("similarity_pct", text.similarity_pct("similarity")))


_WORDS = "list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda t: t <> '')"
_FLAT = "regexp_replace(lower(coalesce(text, '')), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')"
_CHARS = f"string_split({_FLAT}, '')"
_BIGRAMS = f"CASE WHEN length({_FLAT}) < 2 THEN [{_FLAT}] ELSE list_transform(list_zip({_CHARS}[1:-2], {_CHARS}[2:]), lambda p: p[1] || p[2]) END"


@register("similar_vectors_hashed", _COS.format(extra=""), ("vectors",))
def q_similar_vectors_hashed(spark, d):
    """K1 by random projection hashing; on vectors without near neighbours, as these, the exact search answers."""
    v = A.vectors(spark, d)
    top = lsh.similar_vectors(_asked(v), v, k=5, exclude_self=True)
    return round_doubles(top.withColumn("similarity_pct", text.similarity_pct("similarity")))


def _bm25_sql(b: float, k: int = 5, tok: str = _WORDS, docs: str = "documents", queries: str = "benchmark", digits: int = 6) -> str:
    """``docs`` (doc_id, text) and ``queries`` (item_id, text) are tables or subqueries."""
    return f"""
WITH docs AS (SELECT doc_id, {tok} AS toks FROM {docs}),
st AS (SELECT count(*) AS n, avg(len(toks)) AS avgdl FROM docs),
qt AS (SELECT query_id, term, count(*) AS qtf FROM (
         SELECT item_id AS query_id, unnest({tok}) AS term FROM {queries}) GROUP BY 1, 2),
tf AS (SELECT doc_id, dl, term, count(*) AS tf FROM (
         SELECT doc_id, len(toks) AS dl, unnest(toks) AS term FROM docs)
       WHERE term IN (SELECT term FROM qt) GROUP BY 1, 2, 3),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
sc AS (
  SELECT qt.query_id, tf.doc_id,
         sum(qtf * ln((st.n - df.df + 0.5) / (df.df + 0.5) + 1)
             * (tf.tf * 2.2 / (tf.tf + 1.2 * (1 - {b} + {b} * tf.dl / st.avgdl)))) AS score
  FROM qt JOIN tf ON qt.term = tf.term JOIN df ON qt.term = df.term, st
  GROUP BY 1, 2)
SELECT query_id, doc_id, round(score, {digits}) AS score, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM sc)
WHERE rank <= {k}"""


@register("bm25_search", _bm25_sql(0.75))
def q_bm25_search(spark, d):
    """K2 (re-aimed): exact BM25 top-5 documents for every benchmark question."""
    docs = A.read(spark, d, "documents").select("doc_id", "text")
    qs = A.search_queries(spark, d)
    return round_doubles(K.bm25_topk(qs, docs, k=5))


@register("bm25_search_no_length_norm", _bm25_sql(0.0))
def q_bm25_search_no_length_norm(spark, d):
    """K2 with b = 0 (no document-length normalization)."""
    docs = A.read(spark, d, "documents").select("doc_id", "text")
    return round_doubles(K.bm25_topk(A.search_queries(spark, d), docs, k=5, b=0.0))


@register("rrf_fusion", """
WITH a AS (""" + _bm25_sql(0.75, 10) + """),
v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM vectors),
n AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS norm FROM v),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS doc_id, list_dot_product(q.e, c.e) / (q.norm * c.norm) AS similarity
      FROM n q JOIN benchmark ON item_id = q.vec_id, n c WHERE q.norm > 0 AND c.norm > 0),
b AS (SELECT * FROM (SELECT query_id, doc_id,
        row_number() OVER (PARTITION BY query_id ORDER BY round(similarity, 9) DESC, doc_id) AS rank FROM s) WHERE rank <= 10),
u AS (SELECT query_id, doc_id, 1.0 / (60 + rank) AS r FROM a UNION ALL SELECT query_id, doc_id, 1.0 / (60 + rank) FROM b),
f AS (SELECT query_id, doc_id, sum(r) AS rrf_score FROM u GROUP BY 1, 2)
SELECT query_id, doc_id, round(rrf_score, 6) AS rrf_score, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(rrf_score, 9) DESC, doc_id) AS rank FROM f)
WHERE rank <= 5""", ("vectors",))
def q_rrf_fusion(spark, d):
    """K3: reciprocal-rank fusion of the text ranking (K2) and the vector ranking (K1),
    top 10 each, into a top 5. Vector and document of one id are the same item."""
    qs = A.search_queries(spark, d)
    v = A.vectors(spark, d)
    texts = K.bm25_topk(qs, A.read(spark, d, "documents").select("doc_id", "text"), k=10)
    asked = v.join(qs.select(F.col("query_id").alias("vec_id")), "vec_id", "left_semi")
    vectors = K.similar_vectors(asked.select(F.col("vec_id").alias("query_id"), "embedding"),
                                v.withColumnRenamed("vec_id", "doc_id"), k=10, item_id="doc_id")
    return round_doubles(K.reciprocal_rank_fusion([texts, vectors], k=5))


@register("near_duplicates", """
WITH n AS (SELECT doc_id, regexp_replace(lower(trim(coalesce(text, ''))), '\\s+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS group_id, count(*) OVER (PARTITION BY t) AS group_size FROM n""")
def q_near_duplicates(spark, d):
    """K5 (exact part): documents grouped by normalized text; group id = smallest member."""
    return K.near_duplicate_groups(A.read(spark, d, "documents"))


@register("match_asset", """
WITH a AS (
  SELECT assignee, location, asset_id, asset_type,
         row_number() OVER (PARTITION BY assignee, location ORDER BY asset_id) AS asset_rank
  FROM assets WHERE status = 'ACTIVE' AND assignee IS NOT NULL)
SELECT t.ticket_id, a.asset_id, a.asset_type, CAST(a.asset_rank AS INTEGER) AS asset_rank
FROM tickets t JOIN a ON t.reporter_name = a.assignee AND t.location = a.location
WHERE a.asset_rank <= 5""", ("tickets", "assets"))
def q_match_asset(spark, d):
    """J7 the reporter's ACTIVE assets at the ticket's location, first 5 by asset id."""
    return K.match_asset(A.tickets(spark, d), A.assets(spark, d), k=5)


@register("corpus_upsert", """
WITH cur AS (SELECT id, category, created_at AS updated_at FROM knowledge),
ch AS (
  SELECT id, upper(category) AS category, created_at + INTERVAL 1 DAY AS updated_at FROM knowledge WHERE helpful = 1
  UNION ALL
  SELECT id, 'REVIEW', created_at + INTERVAL 2 DAY FROM knowledge WHERE not_helpful = 1
  UNION ALL
  SELECT id, 'STALE', created_at - INTERVAL 1 DAY FROM knowledge),
everything AS (SELECT *, 0 AS n FROM cur UNION ALL SELECT *, 1 FROM ch)
SELECT id, category, updated_at FROM (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC, n DESC) AS place FROM everything) WHERE place = 1""", ("knowledge",))
def q_corpus_upsert(spark, d):
    """S10 batch refresh: latest change per article replaces the stored row."""
    k = A.knowledge(spark, d)
    cur = k.select("id", "category", F.col("created_at").alias("updated_at"))
    ch = k.where(F.col("helpful") == 1).select(
        "id", F.upper("category").alias("category"),
        F.timestamp_add("DAY", F.lit(1), F.col("created_at")).alias("updated_at")).unionByName(
        k.where(F.col("not_helpful") == 1).select(
            "id", F.lit("REVIEW").alias("category"),
            F.timestamp_add("DAY", F.lit(2), F.col("created_at")).alias("updated_at"))).unionByName(
        k.select("id", F.lit("STALE").alias("category"),  # older than what is stored: must not win
                 F.timestamp_add("DAY", F.lit(-1), F.col("created_at")).alias("updated_at")))
    return K.upsert_corpus(cur, ch)


_SIMILAR = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[ \t\n\x0B\f\r]+'), lambda w: w <> '') AS w FROM documents),
m AS (SELECT doc_id, w, min(doc_id) OVER (PARTITION BY w) AS class_id FROM d),
c AS (SELECT class_id, w FROM m WHERE doc_id = class_id AND len(w) > 0),
sh AS (SELECT DISTINCT class_id, array_to_string(w[i:i + 4], ' ') AS s
       FROM (SELECT class_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM c)),
n AS (SELECT class_id, count(*) AS n FROM sh GROUP BY 1),
p AS (SELECT x.class_id AS a, y.class_id AS b, count(*) AS k FROM sh x JOIN sh y USING (s) WHERE x.class_id < y.class_id GROUP BY 1, 2),
pairs AS (SELECT a, b, k / CAST(na.n + nb.n - k AS DOUBLE) AS similarity FROM p JOIN n na ON na.class_id = a JOIN n nb ON nb.class_id = b
          WHERE k / CAST(na.n + nb.n - k AS DOUBLE) >= 0.8)"""


@register("similar_text_pairs", _SIMILAR + " SELECT a, b, round(similarity, 6) AS similarity FROM pairs")
def q_similar_text_pairs(spark, d):
    """K5 pairs of texts (one of each class of equal ones) of Jaccard 0.8 or more on five-word shingles."""
    return round_doubles(near.similar_texts(A.read(spark, d, "documents"))[0])


@register("similar_text_groups", _SIMILAR + """,
ab AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
reach AS (SELECT a AS node, a AS root FROM ab UNION SELECT b, root FROM reach JOIN ab ON a = node),
least AS (SELECT node, min(root) AS root FROM reach GROUP BY node)
SELECT doc_id, class_id, coalesce(root, class_id) AS group_id FROM m LEFT JOIN least ON node = class_id""")
def q_similar_text_groups(spark, d):
    """K5 membership: class of equal texts and group of similar ones, for every document."""
    return near.similar_texts(A.read(spark, d, "documents"))[1]


_LAST_TEXT = """(SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN lang || ' ' || source || ' ' || text WHEN doc_id % 5 = 0 THEN reverse(text) ELSE text END AS text
  FROM documents WHERE doc_id % 11 <> 0)"""


@register("bm25_bigrams", _bm25_sql(0.75, tok=_BIGRAMS, digits=4))
def q_bm25_bigrams(spark, d):
    """K2 over character bigrams, as for text written without spaces: top 5 of every benchmark question."""
    docs = A.read(spark, d, "documents").select("doc_id", "text")
    return round_doubles(K.bm25_topk(A.search_queries(spark, d), docs, k=5, ngram=2), 4)


@register("index_refresh_search", _bm25_sql(0.75, docs=_LAST_TEXT, digits=4))
def q_index_refresh_search(spark, d):
    """S10 + K2: an index over all documents, three batches of changes (new texts, others, some gone; one
    batch is replayed), then the top 5 of every benchmark question: those of an index built anew."""
    t = A.read(spark, d, "documents")
    index = TextIndex(spark, jobs.scratch(spark, "index"), buckets=4)
    k = F.col("doc_id")
    index.update(t.select("doc_id", "text"), 0)
    index.update(t.where(k % 5 == 0).select("doc_id", F.reverse("text").alias("text")), 1)
    changed = t.where(k % 7 == 0).select("doc_id", F.concat_ws(" ", "lang", "source", "text").alias("text"))
    index.update(changed, 2)
    index.update(changed, 2)
    index.update(t.where(k % 11 == 0).select("doc_id", F.lit(None).cast("string").alias("text")), 3)
    return round_doubles(index.topk(A.search_queries(spark, d), k=5), 4)


_ASSET_TEXT = """'アセットID: ' || asset_id || ' ' || 'タイプ: ' || asset_type || ' ' || 'デバイス名: ' || coalesce(name, '') || ' ' || 'メーカー: ' || coalesce(notes, '') || ' ' ||
       'モデル: ' || '' || ' ' || '担当者: ' || coalesce(assignee, '未割当') || ' ' || '部署: ' || '不明' || ' ' || '場所: ' || coalesce(location, '不明') || ' ' || '備考: ' || ''"""
_OWNED = """
SELECT t.ticket_id, a.asset_id, a.asset_type, CAST(a.asset_rank AS INTEGER) AS asset_rank
FROM tickets t JOIN (SELECT assignee, {by} AS place, asset_id, asset_type, row_number() OVER (PARTITION BY assignee, {by} ORDER BY asset_id) AS asset_rank
  FROM {assets} WHERE status = 'ACTIVE' AND assignee IS NOT NULL) a ON t.reporter_name = a.assignee AND t.{by} = a.place
WHERE a.asset_rank <= 5"""


@register("find_asset", f"""
WITH owned AS ({_OWNED.format(by="location", assets="assets")}),
asked AS (SELECT ticket_id, reporter_name || ' ' || location AS text FROM tickets WHERE ticket_id NOT IN (SELECT ticket_id FROM owned)),
found AS ({_bm25_sql(0.75, docs=f"(SELECT asset_id AS doc_id, {_ASSET_TEXT} AS text FROM assets WHERE status = 'ACTIVE')",
                     queries="(SELECT DISTINCT text AS item_id, text FROM asked WHERE text IS NOT NULL)")})
SELECT *, 'owner' AS found_by FROM owned
UNION ALL SELECT ticket_id, asset_id, asset_type, rank, 'text' FROM asked JOIN found ON query_id = text JOIN assets ON doc_id = asset_id""", ("tickets", "assets"))
def q_find_asset(spark, d):
    """J7 with its fallback: the reporter's ACTIVE assets at the location, else the 5 whose text fits best."""
    a = A.assets(spark, d)
    labelled = a.select("asset_id", "asset_type", "status", "assignee", "location", "name", "notes").select(
        "*", F.col("name").alias("asset_name"), F.col("notes").alias("manufacturer"), F.lit(None).cast("string").alias("model"),
        F.col("assignee").alias("assigned_to"), F.lit(None).cast("string").alias("department")).withColumn("notes", F.lit(None).cast("string"))
    assets = labelled.withColumn("asset_text", text.asset_search_text())
    return K.find_asset(A.tickets(spark, d), assets, F.concat("reporter_name", F.lit(" "), "location"))


@register("match_asset_department", _OWNED.format(
    by="department", assets="(SELECT a.*, department FROM assets a LEFT JOIN employees ON assignee = employee_name)"), ("tickets", "assets", "employees"))
def q_match_asset_department(spark, d):
    """J7 by department: the reporter's ACTIVE assets of the ticket's department; an asset is of its assignee's."""
    own = A.employees(spark, d).select(F.col("employee_name").alias("assignee"), "department")
    return K.match_asset(A.tickets(spark, d), A.assets(spark, d).join(own, "assignee", "left"), by="department")


_GATE = """
WITH r AS (SELECT conv_id, turn, conv_id * 7 + turn AS k FROM conversations WHERE role = 'assistant'),
x AS (SELECT conv_id, turn, k % 4 <> 0 AS can_resolve, (k % 11) / 10.0 AS confidence, CASE WHEN k % 3 <> 0 THEN k % 300 END AS kb_id FROM r)
SELECT conv_id, turn, CASE WHEN can_resolve AND confidence >= coalesce(threshold, 0.6) AND NOT coalesce(requires_escalation, false) THEN 'answer' ELSE 'escalate' END AS decision
FROM x LEFT JOIN (SELECT id, CASE WHEN id % 4 <> 0 THEN 0.4 + (id % 5) / 10.0 END AS threshold, not_helpful = 1 AS requires_escalation FROM knowledge) ON kb_id = id"""


@register("article_confidence_gate", _GATE, ("knowledge",))
def q_article_confidence_gate(spark, d):
    """F10 with the matched article's own threshold and requires_escalation."""
    k = F.col("conv_id") * 7 + F.col("turn")
    responses = A.read(spark, d, "conversations").where("role = 'assistant'").select(
        "conv_id", "turn", (k % 4 != 0).alias("can_resolve"), ((k % 11) / F.lit(10.0)).alias("confidence"), F.when(k % 3 != 0, k % 300).alias("matched_kb_id"))
    i = F.col("id")
    articles = A.knowledge(spark, d).select(i.alias("kb_id"), F.when(i % 4 != 0, F.lit(0.4) + (i % 5) / F.lit(10.0)).alias("confidence_threshold"),
                                            (F.col("not_helpful") == 1).alias("requires_escalation"))
    return L.gate_by_article(responses, articles).select("conv_id", "turn", "decision")
