"""Exact token counts, with huge documents encoded in overlapping chunks.

A document longer than one chunk is cut into chunks that overlap. Two
neighbours are spliced at a character position in their overlap where both
start a new pre-token. That position is a proven boundary: the pre-tokenizer
scans from left to right and looks at nothing before its position and at most
``margin`` characters ahead, so from a common start on, both chunks and the
whole text are split alike; and merges never cross a pre-token. The left
chunk's boundaries count only up to ``margin`` characters before its end. Where
two neighbours share no boundary, the document goes round again with wider
overlaps, in the end as one chunk.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from ticketflow.session import cut_lineage
from .common import prepare, with_row_id
from .encoding import encoder

CHUNK = 32_768  # characters a chunk advances by
OVERLAP = 256
WIDEN = 8

def vocabulary(spark: SparkSession, path: str):
    """The tokenizer file as a broadcast (a vocabulary of fixed size)."""
    prepare(spark)
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def seam_margin(tokenizer) -> int:
    """Characters that must follow a boundary inside the left chunk: the longest
    added token, which may start there, and the lookahead of white space."""
    return 2 + max((len(t.content) for t in tokenizer.get_added_tokens_decoder().values()), default=0)


def chunk_spans(n: int, chunk: int, overlap: int) -> list[tuple[int, int]]:
    """(start, end) of the chunks of a text of n characters."""
    out, start = [], 0
    while start + chunk + overlap < n:
        out.append((start, start + chunk + overlap))
        start += chunk
    return out + [(start, n)]


def boundaries(encoding) -> list[tuple[int, int]]:
    """(character, tokens before it) of each pre-token start of an encoding."""
    out, last = [], None
    for k, (word, (start, _)) in enumerate(zip(encoding.word_ids, encoding.offsets)):
        if word != last:
            out.append((start, k))
            last = word
    return out


def encode_chunk(tokenizer, text: str, start: int, chunk: int, overlap: int, margin: int, last: bool):
    """(tokens, head, tail): the boundaries, as (position in the document,
    tokens of this chunk before it), in the overlaps with both neighbours."""
    e = tokenizer.encode(text, add_special_tokens=False)
    at = boundaries(e)
    head = [(start + p, k) for p, k in at if p <= overlap - margin] if start else []
    tail = [] if last else [(start + p, k) for p, k in at if chunk <= p <= chunk + overlap - margin]
    return len(e.ids), head, tail


_SEAMS = "array<struct<pos:long,before:long>>"


def _encode_huge(docs: DataFrame, file, chunk: int, overlap: int) -> DataFrame:
    """(rid, no, tokens, head, tail) per chunk of the documents (rid, text)."""
    def cut(batches):
        for pdf in batches:
            for rid, text in zip(pdf["rid"], pdf["text"]):
                spans = chunk_spans(len(text), chunk, overlap)
                for k in range(0, len(spans), 64):  # a document's chunks leave in batches of bounded size
                    yield pd.DataFrame([(rid["file"], rid["row"], no, a, no + 1 == len(spans), text[a:b])
                                        for no, (a, b) in enumerate(spans[k:k + 64], k)],
                                       columns=["file", "row", "no", "start", "last", "piece"])

    @F.pandas_udf(f"tokens long, head {_SEAMS}, tail {_SEAMS}")
    def encode(start: pd.Series, last: pd.Series, piece: pd.Series) -> pd.DataFrame:
        t = encoder(file).tokenizer
        margin = seam_margin(t)
        return pd.DataFrame([encode_chunk(t, p, s, chunk, overlap, margin, z) for s, z, p in zip(start, last, piece)],
                            columns=["tokens", "head", "tail"])

    pieces = docs.mapInPandas(cut, "file long, row long, no long, start long, last boolean, piece string")
    return (pieces.repartition("file", "row", "no")  # a huge document's chunks spread over the cluster
            .select("file", "row", "no", encode("start", "last", "piece").alias("e")).select("file", "row", "no", "e.*"))


def _splice(chunks: DataFrame) -> DataFrame:
    """(file, row, n_tokens) per document; null where some seam has no common boundary."""
    right = chunks.select("file", "row", (F.col("no") - 1).alias("no"), F.col("head").alias("next_head"))
    pos = lambda c: F.transform(c, lambda x: x["pos"])
    seam = F.array_min(F.array_intersect(pos("tail"), pos("next_head")))
    before = lambda c: F.get(F.filter(c, lambda x: x["pos"] == F.col("seam")), F.lit(0))["before"]
    return (chunks.join(right, ["file", "row", "no"], "left").withColumn("seam", seam)
            # tokens of this chunk before the seam to its right, less those of the next chunk before it
            .withColumn("own", F.when(F.col("next_head").isNull(), F.col("tokens")).otherwise(before("tail") - before("next_head")))
            .groupBy("file", "row").agg(F.when(F.count("*") == F.count("own"), F.sum("own")).alias("n_tokens")))


def count_tokens(docs: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text",
                 chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """One row per document: id, n_bytes, n_tokens as the tokenizer gives them
    for the whole text (no begin, end or added special tokens; special strings
    in a text handled as its default).

    Null and empty texts have 0 bytes and 0 tokens. Repeated rows each give a
    row. An empty table gives no rows; other columns are not read. The file must
    hold a byte-level pre-tokenizer without normalizer, which is checked.
    """
    spark = docs.sparkSession
    file = vocabulary(spark, vocab_path)
    encoder(file)  # raises for other kinds of tokenizers, for which splicing isn't proven
    text = F.coalesce(F.col(text_col), F.lit(""))
    # the operator's own names from the start, so that no column name of the caller's matters
    named = with_row_id(docs.select(F.col(id_col).alias("id"), text.alias("text")), "rid")

    @F.pandas_udf("long")
    def whole(s: pd.Series) -> pd.Series:
        return pd.Series([encoder(file).count(x) for x in s], dtype="int64")

    n_bytes = F.octet_length("text").cast("long").alias("n_bytes")
    huge = F.length("text") > chunk + overlap
    out = named.where(~huge).select("id", n_bytes, whole("text").alias("n_tokens"))
    left = named.where(huge)
    ids = cut_lineage(left.select("id", F.col("rid.file").alias("file"), F.col("rid.row").alias("row"), n_bytes))
    todo = left.select("rid", "text")
    while True:
        done = cut_lineage(_splice(cut_lineage(_encode_huge(todo, file, chunk, overlap))))
        out = out.union(ids.join(done.where("n_tokens is not null"), ["file", "row"]).select("id", "n_bytes", "n_tokens"))
        failed = done.where("n_tokens is null").select(F.struct("file", "row").alias("rid"))
        if not failed.head(1):
            return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens")
        overlap *= WIDEN
        todo = left.join(failed, "rid", "left_semi").select("rid", "text")
