"""Benchmark decontamination with a generalised suffix automaton.

The automaton holds every run of words of the test items. A document's words
are streamed through it; at each word it gives the longest run of benchmark
words that ends there. A word is hit when it lies inside a window: ``window``
consecutive words of an item, or the whole of a shorter item.
"""

from __future__ import annotations

import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ticketflow.functions.skew import running_sum_within
from ticketflow.session import cut_lineage
from .common import fresh, prepare, text_bytes, with_row_id

WINDOW = 10
# Words of test items in one automaton; more make further blocks, each of which
# all documents meet before the next.
BLOCK_WORDS = 100_000

_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def words_of(data: bytes) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the ASCII lower-cased text, as UTF-8."""
    return data.translate(_TABLE).split()


class Automaton:
    """Generalised suffix automaton over (item key, words) pairs."""

    def __init__(self, items: list[tuple], window: int):
        self.window = window
        self.next: list[dict] = [{}]
        self.link = [-1]
        self.len = [0]
        self.short: dict[int, set] = {}  # state of a whole item of fewer words
        self.items: dict[int, set] = {}  # state of a window -> its items
        for _, ws in items:
            last = 0
            for w in ws:
                last = self._extend(last, w)
        self._report(items)

    def _clone(self, p: int, q: int, w: bytes) -> int:
        c = len(self.next)
        self.next.append(dict(self.next[q]))
        self.link.append(self.link[q])
        self.len.append(self.len[p] + 1)
        self.link[q] = c
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = c
            p = self.link[p]
        return c

    def _extend(self, last: int, w: bytes) -> int:
        q = self.next[last].get(w)
        if q is not None:
            return q if self.len[q] == self.len[last] + 1 else self._clone(last, q, w)
        cur = len(self.next)
        self.next.append({})
        self.len.append(self.len[last] + 1)
        self.link.append(0)
        p = last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = cur
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[cur] = q if self.len[q] == self.len[p] + 1 else self._clone(p, q, w)
        return cur

    def _report(self, items: list[tuple]) -> None:
        for key, ws in items:
            if len(ws) < self.window:
                s = 0
                for w in ws:
                    s = self.next[s][w]
                if s:
                    self.short.setdefault(s, set()).add(key)
                continue
            for _, s, n in self._walk(ws):
                if n >= self.window:
                    self.items.setdefault(self._at(s, self.window), set()).add(key)
        # least match length at which a state has something to report
        never = 1 << 60
        self.least = [never] * len(self.next)
        for s in sorted(range(1, len(self.next)), key=self.len.__getitem__):
            own = min(self.window if self.len[s] >= self.window else never, self.len[s] if s in self.short else never)
            self.least[s] = min(own, self.least[self.link[s]])

    def _at(self, s: int, n: int) -> int:
        """The suffix-link ancestor of s that holds its suffix of n words."""
        while self.len[self.link[s]] >= n:
            s = self.link[s]
        return s

    def _walk(self, ws: list[bytes]):
        """(position, state, longest match length) after each word."""
        nxt, link, length = self.next, self.link, self.len
        s = n = 0
        for pos, w in enumerate(ws):
            t = nxt[s].get(w)
            if t is not None:
                s, n = t, n + 1
            else:
                s = link[s]
                while s >= 0:
                    t = nxt[s].get(w)
                    if t is not None:
                        break
                    s = link[s]
                if s < 0:
                    s = n = 0
                else:
                    n = length[s] + 1
                    s = t
            yield pos, s, n

    def hits(self, ws: list[bytes]) -> list[tuple[int, int, set]]:
        """(first, end, items) of the windows in a document, by end."""
        out = []
        nxt, link, length, least = self.next, self.link, self.len, self.least
        s = n = 0
        root = nxt[0].get
        for pos, w in enumerate(ws):  # the loop of _walk, kept flat: it runs once per word of the corpus
            t = nxt[s].get(w) if s else root(w)
            if t is not None:
                s = t
                n += 1
            elif s:
                s = link[s]
                while s >= 0:
                    t = nxt[s].get(w)
                    if t is not None:
                        break
                    s = link[s]
                if s < 0:
                    s = n = 0
                    continue
                n = length[s] + 1
                s = t
            else:
                continue
            if n >= least[s]:
                found, far, a = set(), 0, s
                if n >= self.window:
                    a = self._at(s, self.window)
                    found |= self.items.get(a, set())
                    far = self.window
                a = s
                while a > 0:
                    if a in self.short and n >= length[a]:
                        found |= self.short[a]
                        far = max(far, length[a])
                    a = link[a]
                out.append((pos - far + 1, pos + 1, found))
        return out


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _pieces(benchmark: DataFrame, id_col: str, text_col: str, window: int, block_words: int) -> DataFrame:
    """(i, words, n, block): the items' words, as pieces of at most ``block_words``
    words, and the block of each. Longer items are cut into pieces that share
    ``window - 1`` words, so no window is lost. A piece begins in the block that
    the words before it fill, so a block holds that number and one piece at most."""
    step = max(block_words, 2 * window)

    def cut(batches):
        for pdf in batches:
            for i, data in zip(pdf["i"], pdf["data"]):
                ws = words_of(bytes(data))
                for k in range(0, max(1, len(ws) - window + 1), step - window + 1):
                    if ws[k:k + step]:
                        yield pd.DataFrame([(i, ws[k:k + step], len(ws[k:k + step]))], columns=["i", "words", "n"])

    pieces = (benchmark.select(F.col(id_col).cast("string").alias("i"), text_bytes(text_col).alias("data"))
              .mapInPandas(cut, "i string, words array<binary>, n long"))
    pieces = cut_lineage(pieces.withColumn("no", F.monotonically_increasing_id()))
    if (pieces.agg(F.sum("n")).first()[0] or 0) <= block_words:
        return pieces.withColumn("block", F.lit(0).cast("long"))
    upto = running_sum_within(pieces.select("no", "n"), [], ["no"], "n", "upto")
    place = upto.select("no", ((F.col("upto") - F.col("n")) / F.lit(block_words)).cast("long").alias("block"))
    return cut_lineage(pieces.join(place, "no"))


class Benchmark:
    """Test items in blocks of bounded size. The driver and a task hold one block
    at a time: documents meet the blocks one after the other."""

    def __init__(self, benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text",
                 window: int = WINDOW, block_words: int = BLOCK_WORDS):
        self.spark, self.window = benchmark.sparkSession, window
        prepare(self.spark)
        self.pieces = _pieces(benchmark, id_col, text_col, window, block_words)
        self.blocks = 1 + (self.pieces.agg(F.max("block")).first()[0] or 0)

    def block(self, no: int):
        """One block as a broadcast list of (item id as text, words)."""
        rows = self.pieces.where(F.col("block") == no).select("i", "words").collect()
        return self.spark.sparkContext.broadcast([(r["i"], [bytes(w) for w in r["words"]]) for r in rows])


_BUILT: dict = {}  # in a Python worker: the automaton of the block used last


def _automaton(block, window: int) -> Automaton:
    key = (block._path if hasattr(block, "_path") else id(block), window)
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = Automaton(block.value, window)
    return _BUILT[key]


def scan(datas: list[bytes], block, window: int) -> list[tuple[int, list[tuple[int, int]], list]]:
    """(words, hit word spans, item ids) of each text against one block."""
    a, out = _automaton(block, window), []
    for data in datas:
        ws, spans, items = words_of(data), [], set()
        for first, end, found in a.hits(ws):
            spans.append((first, end))
            items |= found
        out.append((len(ws), merged(spans), sorted(x for x in items if x is not None)))
    return out


_SPANS = "array<struct<first:long,end:long>>"


def contamination_column(data: Column, block, window: int) -> Column:
    """struct(n_words, spans of hit words, items as sorted text) of a binary column."""
    @F.pandas_udf(f"n_words long, spans {_SPANS}, items array<string>")
    def of(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(scan(list(s), block, window), columns=["n_words", "spans", "items"])
    return of(data)


def _hits(texts: DataFrame, bench: Benchmark) -> DataFrame:
    """(rid, spans, items) of the texts (rid, data) that any block hits. Each
    block's hits are stored; of a text with several they are put together."""
    c, parts = F.col("_c"), []
    for no in range(bench.blocks):
        own = texts.select("rid", contamination_column(F.col("data"), bench.block(no), bench.window).alias("_c"))
        parts.append(cut_lineage(own.where(F.size(c["spans"]) > 0).select("rid", c["spans"].alias("spans"), c["items"].alias("items"))))

    @F.pandas_udf(_SPANS)
    def union(s: pd.Series) -> pd.Series:
        return pd.Series([merged([(x["first"], x["end"]) for x in spans]) for spans in s])

    return (reduce(DataFrame.unionAll, parts).groupBy("rid")
            .agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
            .select("rid", union("spans").alias("spans"), "items"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per document: id, n_words, n_hit (words inside a window), n_items,
    items_sha256 (of the item ids, sorted as text and comma-joined),
    contaminated, spans (hit word ranges).

    Null and empty texts have no words. Items without words have no windows.
    Items whose id is null make hits but are not counted or listed; items that
    share an id count once. An empty benchmark hits nothing, an empty table
    gives no rows, and repeated rows give a row each.
    """
    bench = Benchmark(benchmark, window=window, block_words=block_words)
    own = docs.select(F.col(id_col).alias("id"), text_bytes(text_col).alias("data"))
    if bench.blocks == 1:
        c = F.col("_c")
        found = own.select("id", contamination_column(F.col("data"), bench.block(0), window).alias("_c")).select(
            "id", c["n_words"].alias("n_words"), c["spans"].alias("spans"), c["items"].alias("items"))
    else:
        @F.pandas_udf("long")
        def words(s: pd.Series) -> pd.Series:
            return pd.Series([len(words_of(bytes(x))) for x in s], dtype="int64")

        named = with_row_id(own, "rid")
        none = F.array().cast(_SPANS), F.array().cast("array<string>")
        found = named.select("rid", "id", words("data").alias("n_words")).join(_hits(named.select("rid", "data"), bench), "rid", "left").select(
            "id", "n_words", F.coalesce("spans", none[0]).alias("spans"), F.coalesce("items", none[1]).alias("items"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["first"])
    return found.select(F.col("id").alias(id_col), "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"),
                        (F.size("spans") > 0).alias("contaminated"), "spans")


def _cut(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the given word ranges and what stands between their words."""
    at = [m.span() for m in _WORD.finditer(data)]
    out, pos = [], 0
    for first, end in spans:
        out.append(data[pos:at[first][0]])
        pos = at[end - 1][1]
    return b"".join(out) + data[pos:]


def clean(datas: list[bytes], block, window: int) -> list[tuple[bytes, int, int]]:
    """(text without hit spans, words, words hit) of each text. Where a cut
    brings a new window together, it is cut too."""
    out = []
    for data, (n, spans, _) in zip(datas, scan(datas, block, window)):
        hit = sum(b - a for a, b in spans)
        while spans:
            data = _cut(data, spans)
            spans = scan([data], block, window)[0][1]
        out.append((data, n, hit))
    return out


def _clean_by_blocks(texts: DataFrame, bench: Benchmark) -> DataFrame:
    """(rid, data, n, hit) of the texts (rid, data) that any block hits, as
    ``clean`` gives them: rounds over the texts that the round before has cut."""
    @F.pandas_udf("data binary, n long, hit long")
    def cut(s: pd.Series, spans: pd.Series) -> pd.DataFrame:
        own = [[(x["first"], x["end"]) for x in sp] for sp in spans]
        return pd.DataFrame([(_cut(bytes(x), sp), len(words_of(bytes(x))), sum(b - a for a, b in sp)) for x, sp in zip(s, own)], columns=["data", "n", "hit"])

    out, todo = None, texts
    while True:
        now = cut_lineage(todo.join(_hits(todo, bench), "rid").select("rid", cut("data", "spans").alias("c")).select("rid", "c.*"))
        if not now.head(1):
            return now if out is None else out
        if out is None:
            out = now
        else:  # a later round's text, with the counts of the first
            later = now.select("rid", F.col("data").alias("_later"))
            out = cut_lineage(out.join(later, "rid", "left").select("rid", F.coalesce("_later", "data").alias("data"), "n", "hit"))
        todo = now.select("rid", "data")


def remove_benchmark(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", chars_col: str = "n_chars",
                     max_coverage: float = 0.5, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` without benchmark passages: hit spans are cut out of the text,
    documents with more than ``max_coverage`` of their words hit go. Untouched
    texts stay as they are; ``chars_col``, if there, follows the text."""
    bench = Benchmark(benchmark, window=window, block_words=block_words)
    name = fresh(docs, "_clean")
    c = F.col(name)
    if bench.blocks == 1:
        block = bench.block(0)

        @F.pandas_udf("data binary, n long, hit long")
        def of(s: pd.Series) -> pd.DataFrame:
            return pd.DataFrame(clean(list(s), block, window), columns=["data", "n", "hit"])

        # nondeterministic, else the filter below would run it a second time
        cleaned = docs.withColumn(name, of.asNondeterministic()(text_bytes(text_col)))
    else:
        rid = fresh(docs, "_rid")
        named = with_row_id(docs, rid)
        cut = _clean_by_blocks(named.select(F.col(rid).alias("rid"), text_bytes(text_col).alias("data")), bench)
        cleaned = named.join(cut.select(F.col("rid").alias(rid), F.struct("data", "n", "hit").alias(name)), rid, "left")
    hit = F.coalesce(c["hit"], F.lit(0))
    new = {text_col: F.when(hit > 0, c["data"].cast("string")).otherwise(F.col(text_col))}
    if chars_col in docs.columns:
        new[chars_col] = F.when(hit > 0, F.length(c["data"].cast("string")).cast("long")).otherwise(F.col(chars_col))
    return (cleaned.where(hit <= F.lit(max_coverage) * F.greatest(F.coalesce(c["n"], F.lit(1)), F.lit(1)))
            .select(*[new[x].cast(docs.schema[x].dataType).alias(x) if x in new else F.col(f"`{x}`") for x in docs.columns]))
