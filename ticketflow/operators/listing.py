"""Filtered, searched, ordered and paged listings.

Predicates are plain column expressions, so Catalyst pushes equality and
``isin`` filters into the Parquet scan (``PushedFilters``) and prunes
columns. Top-k listings are ``orderBy().limit()``, planned as
``TakeOrderedAndProject`` (a per-partition heap, then a merge of k rows per
partition), never a full sort. Deep pages use a keyset predicate instead of
a growing OFFSET.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketflow.functions.timeutil import col_of
from ticketflow.operators.search import char_ngrams
from ticketflow.session import cut_lineage

ACTIVE = ("OPEN", "IN_PROGRESS", "HUMAN_REQUESTED")


def filter_equal(df: DataFrame, sentinel: str | None = None, **equals) -> DataFrame:
    """AND of ``col == value`` for each given value; None or '' means no
    filter, and so does ``sentinel`` (e.g. 'all') where the route has one."""
    preds = [F.col(c) == F.lit(v) for c, v in equals.items()
             if v not in (None, "") and (sentinel is None or v != sentinel)]
    return df.where(reduce(lambda a, b: a & b, preds)) if preds else df


def like_escape(q: str) -> str:
    return q.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")


def search_any(df: DataFrame, q: str | None, columns: list[str], escape: bool = False) -> DataFrame:
    """case-insensitive substring over any of ``columns`` (ILIKE '%q%').

    As in the reference, '%' and '_' in q act as wildcards unless
    ``escape=True``. Empty q means no filter. NULL columns never match.
    """
    if not q:
        return df
    pattern = "%" + (like_escape(q) if escape else q) + "%"
    pred = reduce(lambda a, b: a | b, [F.coalesce(F.col(c).ilike(pattern), F.lit(False)) for c in columns])
    return df.where(pred)


def search_many(df: DataFrame, terms: DataFrame, columns: list[str], id_col: str, term_id: str = "term_id", term: str = "term",
                scan_at_once: int = 200) -> DataFrame:
    """F2 for a batch of search terms: (term_id, id) of every record that
    ``search_any`` finds for the term.

    A term of three characters or more without wildcards needs all its trigrams
    in a value; the rarest of them, by the records that have it, names the
    candidates, which are checked exactly. Other terms are scanned for, at most
    ``scan_at_once`` of them in one pass over the records. Null and empty terms
    find nothing. Ids of records and of terms are unique.
    """
    asked = cut_lineage(terms.select(F.col(term_id).alias("term_id"), F.lower(term).alias("term")).where(F.length("term") > 0))
    plain = (F.length("term") >= 3) & ~F.col("term").rlike(r"[%_\\]")

    def trigrams(value: Column) -> Column:
        return F.when(F.length(value) >= 3, F.array_distinct(char_ngrams(value, 3))).otherwise(F.array().cast("array<string>"))

    values = df.select(F.col(id_col).alias("id"), F.array(*[F.lower(F.coalesce(c, F.lit(""))) for c in columns]).alias("values"))
    grams = cut_lineage(asked.where(plain).select("term_id", "term", F.explode(trigrams(F.col("term"))).alias("gram")))
    every = values.select("id", F.explode(F.array_distinct(F.flatten(F.transform("values", trigrams)))).alias("gram"))
    postings = cut_lineage(every.join(grams.select("gram").distinct(), "gram", "left_semi"))
    counts = postings.groupBy("gram").agg(F.count("*").alias("n"))
    rarest = (grams.join(counts, "gram", "left").groupBy("term_id", "term").agg(F.count("*").alias("need"), F.count("n").alias("have"), F.min_by("gram", "n").alias("gram"))
              .where(F.col("need") == F.col("have")).select("term_id", "term", "gram"))
    candidates = rarest.join(postings, "gram").select("term_id", "term", "id")
    out = candidates.join(values, "id").where(F.exists("values", lambda v: v.contains(F.col("term")))).select("term_id", "id")
    others = asked.where(~plain)
    passes = -(-others.count() // scan_at_once)
    for part in range(passes):
        some = others.where(F.pmod(F.xxhash64("term_id"), F.lit(passes)) == part).collect()
        if some:
            listed = F.array(*[F.struct(F.lit(r["term_id"]).alias("term_id"), F.lit(r["term"]).alias("term")) for r in some])
            found = "inline(filter(listed, t -> exists(values, v -> v LIKE concat('%', t.term, '%'))))"
            out = out.unionByName(values.withColumn("listed", listed).select("id", F.expr(found)).select("term_id", "id"))
    return out.select(F.col("term_id").alias(term_id), F.col("id").alias(id_col))


def filter_thread(df: DataFrame, thread_ts: str | None = None, ticket_id: str | None = None) -> DataFrame:
    """thread equality wins; else ``thread_ts LIKE '%ticket_id%'`` (wildcards kept)."""
    if thread_ts:
        return df.where(F.col("thread_ts") == F.lit(thread_ts))
    if ticket_id:
        return df.where(F.col("thread_ts").like("%" + ticket_id + "%"))
    return df


def client_search(df: DataFrame, q: str, title: str = "title", description: str = "description") -> DataFrame:
    """lower-case contains on title, or on a non-null description."""
    ql = F.lower(F.lit(q))
    t = F.coalesce(F.lower(F.col(title)).contains(ql), F.lit(False))
    d = F.coalesce(F.lower(F.col(description)).contains(ql), F.lit(False))
    return df.where(t | d)


def active_tickets(df: DataFrame) -> DataFrame:
    """status in OPEN, IN_PROGRESS, HUMAN_REQUESTED."""
    return df.where(F.col("status").isin(*ACTIVE))


def point_lookup(df: DataFrame, ids, key: str = "ticket_id") -> DataFrame:
    """F8: rows by id; a list/value filters in the scan, a DataFrame semi-joins."""
    if isinstance(ids, DataFrame):
        return df.join(ids.select(key).distinct(), key, "left_semi")
    vals = ids if isinstance(ids, (list, tuple, set)) else [ids]
    return df.where(F.col(key).isin(*vals))


def _order(cols) -> list[Column]:
    out = []
    for c in cols:
        if isinstance(c, Column):
            out.append(c)
        elif c.startswith("-"):
            out.append(F.col(c[1:]).desc())
        else:
            out.append(F.col(c).asc())
    return out


def paginate(df: DataFrame, page: int = 1, limit: int = 20,
             order=("-created_at", "-ticket_id")) -> tuple[DataFrame, DataFrame]:
    """O1: one page (newest first, ticket id as tie-breaker) and the page meta
    (total, page, limit, total_pages = ceil(total/limit)).

    Both come from the same filtered input; the meta is a global count
    (partial counts, one row per partition shuffled).
    """
    page = max(int(page or 1), 1)
    limit = int(limit or 20)
    rows = df.orderBy(*_order(order)).offset((page - 1) * limit).limit(limit)
    meta = df.agg(F.count(F.lit(1)).alias("total")).select(
        "total", F.lit(page).alias("page"), F.lit(limit).alias("limit"),
        F.ceil(F.col("total") / F.lit(limit)).cast("long").alias("total_pages"))
    return rows, meta


def page_after(df: DataFrame, after_created, after_id: str, limit: int = 20) -> DataFrame:
    """O1 deep pages: keyset predicate (created_at, ticket_id) < last seen, newest first."""
    c = F.col("created_at")
    last = F.lit(after_created).cast(df.schema["created_at"].dataType)
    pred = (c < last) | ((c == last) & (F.col("ticket_id") < F.lit(after_id)))
    return df.where(pred).orderBy(F.col("created_at").desc(), F.col("ticket_id").desc()).limit(limit)


def ordered_list(df: DataFrame, *order) -> DataFrame:
    """O2: assets by asset_id, settings by key, catalog by id, FAQ by category+subcategory."""
    return df.orderBy(*_order(order))


def log_order(logs: DataFrame, log_type: str | None = None, thread_ts: str | None = None,
              ticket_id: str | None = None, limit: int = 100) -> DataFrame:
    """O3: log listing: ascending inside a thread (or ticket match), else newest
    first; LIMIT 100 either way; id breaks ties."""
    out = filter_thread(filter_equal(logs, log_type=log_type), thread_ts, ticket_id)
    asc = bool(thread_ts or ticket_id)
    o = [F.col("created_at").asc(), F.col("id").asc()] if asc else [F.col("created_at").desc(), F.col("id").desc()]
    return out.orderBy(*o).limit(limit)


def audit_page(history: DataFrame, action: str | None = None, author: str | None = None,
               limit: int = 100) -> DataFrame:
    """History newest first, filters with sentinel 'all', LIMIT n (default 100)."""
    out = filter_equal(history, sentinel="all", action=action, author=author)
    return out.orderBy(F.col("created_at").desc(), F.col("id").desc()).limit(limit)


LATEST_COLUMNS = ["ticket_id", "reporter_name", "issue_type", "urgency", "status", "summary", "created_at"]


def latest_tickets(tickets: DataFrame, n: int = 20) -> DataFrame:
    """The latest n tickets, 7 columns."""
    return tickets.select(*LATEST_COLUMNS).orderBy(F.col("created_at").desc(), F.col("ticket_id").desc()).limit(n)


def distinct_authors(history: DataFrame) -> DataFrame:
    """Sorted distinct authors (partial distinct per partition, then merged)."""
    return history.select("author").distinct().orderBy("author")


QUEUE_TABLES = {"helpdesk": "it", "hr": "hr", "finance": "finance"}


def all_tickets(helpdesk: DataFrame, hr: DataFrame | None = None, finance: DataFrame | None = None) -> DataFrame:
    """The three queue tables as one, with a ``queue`` column.

    Columns are matched by name (missing ones become NULL); the finance
    insert's ``request_type`` is read as ``issue_type``.
    """
    parts = []
    for name, df in (("it", helpdesk), ("hr", hr), ("finance", finance)):
        if df is None:
            continue
        if "request_type" in df.columns:
            if "issue_type" in df.columns:
                df = df.withColumn("issue_type", F.coalesce("issue_type", "request_type")).drop("request_type")
            else:
                df = df.withColumnRenamed("request_type", "issue_type")
        parts.append(df.withColumn("queue", F.lit(name)))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
