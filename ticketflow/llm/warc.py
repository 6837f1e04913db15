"""WARC archives: writing with segmentation and chunked framing, reading back
with segment reassembly.

An archive file, gzipped as a whole, is a run of records, each a header block, a blank line, the
content, and two line ends. Content above ``segment`` bytes is split: the first
record carries WARC-Segment-Number 1, continuation records carry the first
one's id as WARC-Segment-Origin-ID and their number, and the last one the
WARC-Segment-Total-Length. HTTP bodies use chunked transfer framing.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ticketflow.session import checkpoint_dir, cut_lineage
from .common import prepare, text_bytes, with_row_id

SEGMENT = 16_384       # content bytes of a record
FRAME = 4_096          # bytes of a transfer chunk
RECORDS_PER_FILE = 2048  # bounds an archive file, which is read as a whole
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def chunked(payload: bytes, frame: int = FRAME) -> bytes:
    """Chunked transfer framing of a payload."""
    out = [b"%x\r\n%b\r\n" % (len(payload[k:k + frame]), payload[k:k + frame]) for k in range(0, len(payload), frame)]
    return b"".join(out) + b"0\r\n\r\n"


def dechunked(body: bytes) -> bytes:
    """The payload of a chunked body; raises ValueError on broken framing."""
    out, pos = [], 0
    while True:
        end = body.index(b"\r\n", pos)
        n = int(body[pos:end].split(b";")[0], 16)
        pos = end + 2
        if n == 0:
            return b"".join(out)
        if body[pos + n:pos + n + 2] != b"\r\n":
            raise ValueError("a transfer chunk does not end with a line end")
        out.append(body[pos:pos + n])
        pos += n + 2


def record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    """One record without the two line ends that close it."""
    head = "".join(f"{k}: {v}\r\n" for k, v in fields)
    return b"WARC/1.1\r\n" + head.encode() + b"Content-Length: %d\r\n\r\n" % len(block) + block


def _http(payload: bytes | None) -> bytes:
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    return head + b"\r\n" if payload is None else head + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(payload)


def page_records(rid: str, url: str, payload: bytes, digest: str, refers: str | None, segment: int) -> list[bytes]:
    """The record, or the segments, of one page. ``rid`` and ``refers`` are record ids."""
    fields = [("WARC-Type", "revisit" if refers else "response"), ("WARC-Record-ID", f"<{rid}>"),
              ("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)),
              ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response")]
    if refers:
        return [record(fields + [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", f"<{refers}>")], _http(None))]
    block = _http(payload)
    if len(block) <= segment:
        return [record(fields, block)]
    parts = [block[k:k + segment] for k in range(0, len(block), segment)]
    out = [record(fields + [("WARC-Segment-Number", "1")], parts[0])]
    for no, part in enumerate(parts[1:], 2):
        own = [("WARC-Type", "continuation"), ("WARC-Record-ID", f"<{rid}:{no}>"), ("WARC-Date", "1970-01-01T00:00:00Z"),
               ("WARC-Segment-Number", str(no)), ("WARC-Segment-Origin-ID", f"<{rid}>")]
        if no == len(parts):
            own.append(("WARC-Segment-Total-Length", str(len(block))))
        out.append(record(own, part))
    return out


def parse(data: bytes):
    """(fields with lower-case names, content) of each record of an archive file, gzipped or not."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    pos = 0
    while pos < len(data):
        end = data.index(b"\r\n\r\n", pos)
        lines = data[pos:end].decode("utf-8").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record starts at byte {pos}")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        start = end + 4
        n = int(fields["content-length"])
        if data[start + n:start + n + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {pos} does not end where its length says")
        yield fields, data[start:start + n]
        pos = start + n + 4


def decode_http(block: bytes) -> bytes:
    """The payload of an HTTP response message."""
    head, _, body = block.partition(b"\r\n\r\n")
    return dechunked(body) if re.search(rb"(?im)^transfer-encoding:\s*chunked\s*$", head.replace(b"\r", b"")) else body


def _digest(data: Column | str) -> Column:
    @F.pandas_udf(T.StringType())
    def of(s: pd.Series) -> pd.Series:
        return s.map(lambda x: sha1_base32(bytes(x)))
    return of(data)


def _record_id(page_id: Column, rid: Column) -> Column:
    """Record ids name the page and the row it came from: repeated page ids differ."""
    return F.concat(F.lit("urn:page:"), F.coalesce(page_id.cast("string"), F.lit("null")), F.lit(":"),
                    F.hex(rid["file"]), F.lit("-"), rid["row"].cast("string"))


def write_archive(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                  segment: int = SEGMENT, min_revisit: int = 0, broadcast_rows: int = 200_000) -> None:
    """Write one record, or a run of segments, per page into archive files.

    Of pages with equal payloads of at least ``min_revisit`` bytes, that with
    the largest id (of repeated ids, the last row; null ids come first) is the
    response and the others revisit it. Null payloads are empty, null urls too.

    The digests that occur more than once, counted first, are broadcast up to
    ``broadcast_rows`` of them; beyond that the join shuffles, and adaptive
    execution splits a digest that very many pages share.
    """
    prepare(pages.sparkSession)
    named = with_row_id(pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")), "rid")
    data = text_bytes("html")
    who = F.struct(F.col("page_id").alias("id"), F.col("rid"))
    winners = cut_lineage(named.select(_digest(data).alias("digest"), F.octet_length(data).alias("n"), who.alias("who"))
                          .where(F.col("n") >= min_revisit).groupBy("digest").agg(F.max("who").alias("win"), F.count("*").alias("n"))
                          .where("n > 1").select("digest", "win"))
    small = winners.count() <= broadcast_rows
    rows = (named.select("page_id", "rid", "url", data.alias("payload")).withColumn("digest", _digest("payload"))
            .join(F.broadcast(winners) if small else winners, "digest", "left"))
    revisit = (F.octet_length("payload") >= min_revisit) & F.col("win").isNotNull() & (F.col("win.rid") != F.col("rid"))
    rows = rows.select(_record_id(F.col("page_id"), F.col("rid")).alias("rid"), F.coalesce("url", F.lit("")).alias("url"), "payload", "digest",
                       F.when(revisit, _record_id(F.col("win.id"), F.col("win.rid"))).alias("refers"))

    def records(batches):
        for pdf in batches:
            yield pd.DataFrame({"value": [r for x in pdf.itertuples(index=False)
                                          for r in page_records(x.rid, x.url, bytes(x.payload), x.digest, x.refers, segment)]})

    (rows.mapInPandas(records, "value binary")
     .select(F.col("value").cast("string").alias("value"))  # the bytes as they are; the writer adds the closing line ends
     .write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", RECORDS_PER_FILE)
     .option("compression", "gzip").text(path))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the archive files under ``path``."""
    prepare(spark)

    def split(batches):
        for pdf in batches:
            for content in pdf["content"]:
                rows = [(f["warc-type"], f["warc-record-id"].strip("<>"), f.get("warc-payload-digest", "").partition(":")[2] or None,
                         f.get("warc-refers-to", "").strip("<>") or None, int(f.get("warc-segment-number", 0)),
                         f.get("warc-segment-origin-id", "").strip("<>") or None, int(f.get("warc-segment-total-length", -1)), block)
                        for f, block in parse(bytes(content))]
                for k in range(0, len(rows), 256):
                    yield pd.DataFrame(rows[k:k + 256], columns=["type", "record_id", "digest", "refers_to", "segment", "origin", "total", "block"])

    return (spark.read.format("binaryFile").load(path).select("content")
            .mapInPandas(split, "type string, record_id string, digest string, refers_to string, segment int, origin string, total long, block binary"))


def reassemble(records: DataFrame) -> DataFrame:
    """One row per response or revisit: type, record_id, digest, refers_to and
    the whole block. Segments are grouped by their origin's id and ordered by
    number; a segment that occurs twice counts once. The block is null where a
    number is missing or the total length does not agree."""
    alone = records.where("segment = 0").select("type", "record_id", "digest", "refers_to", "block")
    first = F.col("segment") == 1
    seg = (records.where("segment > 0").withColumn("record_id", F.coalesce("origin", "record_id"))
           .groupBy("record_id", "segment").agg(*[F.first(c).alias(c) for c in ("type", "digest", "refers_to", "total", "block")])
           .groupBy("record_id").agg(
               F.max(F.when(first, F.col("type"))).alias("type"), F.max(F.when(first, F.col("digest"))).alias("digest"),
               F.max(F.when(first, F.col("refers_to"))).alias("refers_to"), F.max("total").alias("total"),
               F.max("segment").alias("last"), F.count("*").alias("n"), F.sum(F.octet_length("block")).alias("bytes"),
               F.array_sort(F.collect_list(F.struct("segment", "block"))).alias("parts")))
    whole = (F.col("last") == F.col("n")) & (F.col("total") == F.col("bytes"))
    # one join of all parts: in proportion to the page, however many segments it has
    joined = F.unhex(F.array_join(F.transform("parts", lambda p: F.hex(p["block"])), ""))
    return alone.union(seg.select("type", "record_id", "digest", "refers_to", F.when(whole, joined).alias("block")))


def read_archive(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """One row per page of an archive: page_id (text), record_type,
    payload_bytes, payload_digest, refers_to (page id, text), complete (segments
    whole and the digest confirmed) and, with ``payloads``, payload (null for
    revisits). A revisit takes its payload's size from the record it refers to.

    The archive is read, reassembled and decoded once for the facts of its
    records, which are checkpointed, and once more where payloads are asked for.
    """
    @F.pandas_udf("payload binary, n long, sha1 string")
    def decode(block: pd.Series) -> pd.DataFrame:
        got = [None if b is None else decode_http(bytes(b)) for b in block]
        return pd.DataFrame({"payload": got if payloads else None, "n": pd.array([None if p is None else len(p) for p in got], dtype="Int64"),
                             "sha1": [None if p is None else sha1_base32(p) for p in got]})

    decoded = reassemble(read_records(spark, path)).withColumn("d", decode("block"))
    is_response = F.col("type") == "response"
    facts = cut_lineage(decoded.select(
        "type", "record_id", "digest", "refers_to", F.when(is_response, F.col("d.n")).alias("payload_bytes"),
        F.when(is_response, F.coalesce(F.col("d.sha1") == F.col("digest"), F.lit(False))).alias("complete")))
    responses, revisits = facts.where(is_response), facts.where(F.col("type") == "revisit")
    sizes = responses.select(F.col("record_id").alias("refers_to"), "payload_bytes", "complete")
    revisits = (revisits.drop("payload_bytes", "complete").join(sizes, "refers_to", "left")
                .withColumn("complete", F.coalesce("complete", F.lit(False))).select(*facts.columns))
    page = lambda c: F.nullif(F.regexp_extract(c, r"^urn:page:(.*):[0-9A-F]+-[0-9]+$", 1), F.lit("null"))
    out = [page(F.col("record_id")).alias("page_id"), F.col("type").alias("record_type"), "payload_bytes",
           F.col("digest").alias("payload_digest"), page(F.col("refers_to")).alias("refers_to"), "complete"]
    if not payloads:
        return responses.union(revisits).select(*out)
    whole = decoded.where(is_response).select(*[c for c in facts.columns if c not in ("payload_bytes", "complete")], F.col("d.n").alias("payload_bytes"),
                                              F.coalesce(F.col("d.sha1") == F.col("digest"), F.lit(False)).alias("complete"), F.col("d.payload").alias("payload"))
    return whole.union(revisits.withColumn("payload", F.lit(None).cast("binary"))).select(*out, "payload")


def archive_path(spark: SparkSession) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
