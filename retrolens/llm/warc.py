"""WARC archives: writing captures, reading records, assembling transactions.

Each page becomes three records: a request, a response (or a revisit of a
response with the same payload) and metadata. Request and metadata name the
response by WARC-Concurrent-To. Reading joins the three through those
identifiers, wherever the records lie, and emits one nested row per capture.

Archives are written by Spark's own text writer: a record is UTF-8 text that
ends in two CRLFs, which is the line separator given. So files go to any store
that Spark writes, are committed whole, and a lost executor's task is repeated.
Reading takes the archives as binary files and parses records by their
Content-Length. Pages are written by classes of size, each with as many records
to a file as keep it below ``FILE_BYTES`` (or at one capture, if that is larger).
A file is one compressed stream, since Spark's writers don't compress by record.

Of records with equal payloads of at least ``min_revisit_bytes`` bytes, that
with the largest page_id is the response and the others revisit it; smaller
payloads are all responses. A revisit's declared digest and length are compared
with the response that it refers to: ``consistent``.

Defined results: null html is an empty payload, null url an empty target; rows
with equal page_id and html give one capture each, also if the urls are equal:
record ids follow from id, url, payload and the number of the copy; with equal
largest ids all are responses, and revisits refer to the one of the smallest url;
a null page_id, or one that is no integer, is never the response of another; an
empty table gives empty archives and an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, few, look_up, row_id

#: Bytes of a file before compression, about, and of the smallest class of records.
FILE_BYTES, LEAST_CLASS = 64 << 20, 16 << 10
#: The times of synthetic captures and the hexadecimal digits of base32's letters.
CAPTURED_AT = "2020-01-01T00:00:00Z"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
END = "\r\n\r\n"

RECORD = "record_id string, kind string, concurrent_to string, target string, refers_to string, payload_bytes long, payload_digest string, declared_digest string, page_id long, block string"


def base32_sha1(payload: Column) -> Column:
    """The bare upper-case base32 SHA-1 of a string's UTF-8 bytes (32 letters:
    160 bits in groups of five, eight groups to ten hexadecimal digits)."""
    digest = F.sha1(payload.cast("binary"))
    letters = []
    for block in range(4):
        number = F.conv(F.substring(digest, block * 10 + 1, 10), 16, 10).cast("long")
        for i in range(8):
            code = F.shiftright(number, 35 - 5 * i).bitwiseAND(F.lit(31)).cast("int")
            letters.append(F.substring(F.lit(BASE32), code + 1, F.lit(1)))
    return F.concat(*letters)


def _uid(row: Column, kind: str) -> Column:
    """A record id that follows from the row, so that a repeated task writes the same."""
    h = F.md5(F.concat_ws("|", F.lit(kind), row))
    return F.concat(F.lit("<urn:uuid:"), F.substring(h, 1, 8), *[x for a, n in ((9, 4), (13, 4), (17, 4), (21, 12)) for x in (F.lit("-"), F.substring(h, a, n))], F.lit(">"))


def _record(kind: str, headers: list[tuple[str, Column]], block: Column) -> Column:
    """A record's text without the END that the writer sets."""
    lines = [F.lit(f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Date: {CAPTURED_AT}\r\n")]
    for name, value in headers:
        lines += [F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))).otherwise(F.lit(""))]
    return F.concat(*lines, F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit(END), block)


def _rows(pages: DataFrame, key: str, url: str, html: str) -> DataFrame:
    rows = pages.select(row_id(key).alias("page_id"), F.coalesce(url, F.lit("")).alias("url"), F.coalesce(html, F.lit("")).alias("html"))
    return rows.withColumn("mark", F.xxhash64("html")).withColumn("size", F.octet_length("html").cast("long"))


def _decisions(rows: DataFrame, min_revisit_bytes: int) -> tuple[DataFrame, DataFrame]:
    """(page_id, mark, digest, size, last_id, last_url) for each id and payload,
    payloads hashed once; and the (page_id, url, mark) of which there are copies."""
    held = cut(rows.groupBy("page_id", "url", "mark", "size", base32_sha1(F.col("html")).alias("digest")).agg(F.count(F.lit(1)).alias("copies")))
    # the largest id and its smallest url
    large = held.where((F.col("size") >= min_revisit_bytes) & F.col("page_id").isNotNull())
    last = large.groupBy("digest").agg(F.min(F.struct((-F.col("page_id")).alias("id"), "url")).alias("l"))
    many = held.groupBy("digest").agg(F.count(F.lit(1)).alias("n"))
    last = cut(many.join(last, "digest", "left").select("digest", "n", (-F.col("l.id")).alias("last_id"), F.col("l.url").alias("last_url")))
    known = held.select("page_id", "mark", "size", "digest").distinct()
    revisit = (F.col("size") >= min_revisit_bytes) & (F.col("page_id") < F.col("last_id"))
    decided = look_up(known, last, ["digest"], "n", held.count()).select("page_id", "mark", "digest", "size", *[F.when(revisit, F.col(c)).alias(c) for c in ("last_id", "last_url")])
    return cut(decided), cut(held.where("copies > 1").select("page_id", "url", "mark", "copies"))


def _decided(rows: DataFrame, decisions: DataFrame, repeated: DataFrame) -> DataFrame:
    """``rows`` with their decisions and a number ``copy`` among equal rows."""
    at = decisions.select(F.col("page_id").alias("_page"), F.col("mark").alias("_mark"), "digest", "last_id", "last_url")
    on = F.col("page_id").eqNullSafe(F.col("_page")) & (F.col("mark") == F.col("_mark"))
    if repeated.isEmpty():
        rows = rows.withColumn("copy", F.lit(1))
    else:
        twin = few(repeated.select(F.col("page_id").alias("_p"), F.col("url").alias("_u"), F.col("mark").alias("_m")))
        same = F.col("page_id").eqNullSafe(F.col("_p")) & (F.col("url") == F.col("_u")) & (F.col("mark") == F.col("_m"))
        # equal rows become one with partial aggregates, however many, and then as many again
        one = rows.join(twin, same, "left_semi").groupBy("page_id", "url", "mark", "size").agg(F.first("html").alias("html"), F.count(F.lit(1)).alias("copies"))
        again = one.select("page_id", "url", "html", "mark", "size", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
        rows = rows.join(twin, same, "left_anti").withColumn("copy", F.lit(1)).unionByName(again)
    return rows.join(at, on).drop("_page", "_mark", "mark")


def captures(pages: DataFrame, min_revisit_bytes: int = 0, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """A row per page with the decision: response or revisit, and of which page."""
    rows = _rows(pages, key, url, html)
    return _decided(rows, *_decisions(rows, min_revisit_bytes))


def records(decided: DataFrame) -> DataFrame:
    """(value): the text of every record, three for each capture."""
    named = lambda page, url, copy: F.concat_ws("|", F.coalesce(page.cast("string"), F.lit("-")), F.col("digest"), copy.cast("string"), url)
    row = named(F.col("page_id"), F.col("url"), F.col("copy"))
    target = F.regexp_replace("url", r"[\r\n]", "")
    target = F.when(target != "", target)
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit(END))
    page = F.col("page_id").cast("string")
    common = [("WARC-Target-URI", target), ("X-Page-Id", page)]
    own, digest = _uid(row, "response"), F.concat(F.lit("sha1:"), F.col("digest"))
    first = F.when(F.col("last_id").isNull(), _record("response", [("WARC-Record-ID", own), *common, ("WARC-Payload-Digest", digest), ("Content-Type", F.lit("application/http; msgtype=response"))], F.concat(http, F.col("html")))).otherwise(
        _record(
            "revisit",
            [
                ("WARC-Record-ID", own),
                *common,
                ("WARC-Payload-Digest", digest),
                ("WARC-Refers-To", _uid(named(F.col("last_id"), F.col("last_url"), F.lit(1)), "response")),
                ("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
                ("Content-Type", F.lit("application/http; msgtype=response")),
            ],
            http,
        )
    )
    ask = F.concat(F.lit("GET / HTTP/1.1\r\nUser-Agent: retrolens"), F.lit(END))
    request = _record("request", [("WARC-Record-ID", _uid(row, "request")), *common, ("WARC-Concurrent-To", own), ("Content-Type", F.lit("application/http; msgtype=request"))], ask)
    about = F.concat(F.lit("payload-bytes: "), F.col("size").cast("string"), F.lit("\r\n"))
    metadata = _record("metadata", [("WARC-Record-ID", _uid(row, "metadata")), *common, ("WARC-Concurrent-To", own), ("Content-Type", F.lit("application/warc-fields"))], about)
    return decided.select(F.explode(F.array(request, first, metadata)).alias("value"))


def write_archives(pages: DataFrame, place: str, min_revisit_bytes: int = 0, key: str = "page_id", url: str = "url", html: str = "html") -> str:
    """Write the archives of all pages into a folder of the shared store."""
    rows = _rows(pages, key, url, html)
    decisions, repeated = _decisions(rows, min_revisit_bytes)
    bound = F.greatest(F.lit(0), F.ceil(F.log2((F.col("size") + 1) / LEAST_CLASS) / 2)).cast("int")  # up to LEAST_CLASS * 4 ** bound bytes
    classes = sorted(r[0] for r in decisions.select(bound.alias("c")).distinct().collect())  # 16 at most
    for c in classes or [0]:
        a_file = max(3, 3 * (FILE_BYTES // (LEAST_CLASS * 4**c + 2048)))  # three records a capture
        text = records(_decided(rows.where(bound == c), decisions.where(bound == c).drop("size"), repeated))
        text.write.mode("append").option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", a_file).text(place)
    return place


def parse_records(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record, lengths as the headers say."""
    while True:
        line = stream.readline()
        while line in (b"\r\n", b"\n"):
            line = stream.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no record begins with {line[:40]!r}")
        headers = {}
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            name, _, value = line.decode("utf-8", "replace").partition(":")
            headers[name.strip().lower()] = value.strip()
        size = int(headers["content-length"])
        block = stream.read(size)
        if len(block) != size:
            raise ValueError(f"a record of {size} bytes ends after {len(block)}")
        yield headers, block


def _describe(headers: dict[str, str], block: bytes, with_block: bool) -> tuple:
    kind, size, digest = headers["warc-type"], None, None
    if kind in ("response", "revisit"):
        head, _, payload = block.partition(b"\r\n\r\n")
        if kind == "response":
            size, digest = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
        else:  # the payload lies with the response; this record declares its length and digest
            fields = dict(x.lower().split(b":", 1) for x in head.split(b"\r\n")[1:])
            size, digest = int(fields[b"content-length"]), headers["warc-payload-digest"].removeprefix("sha1:")
    page = headers.get("x-page-id")
    declared = headers.get("warc-payload-digest", "").removeprefix("sha1:") or None
    text = block.decode("utf-8", "replace") if with_block else None
    return headers["warc-record-id"], kind, headers.get("warc-concurrent-to"), headers.get("warc-target-uri"), headers.get("warc-refers-to"), size, digest, declared, int(page) if page else None, text


def _parser(with_block: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    kinds = [pa.string()] * 5 + [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
    names = [x.split()[0] for x in RECORD.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                raw = io.BytesIO(memoryview(content.as_buffer()))
                packed = raw.getbuffer()[:2] == b"\x1f\x8b"
                stream = io.BufferedReader(gzip.GzipFile(fileobj=raw)) if packed else raw
                rows: list[tuple] = []
                for headers, block in parse_records(stream):
                    rows.append(_describe(headers, block, with_block))
                    if len(rows) == 500:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return run


def read_records(spark: SparkSession, place: str, with_block: bool = True) -> DataFrame:
    """One row per record of the archives in a folder."""
    files = spark.read.format("binaryFile").load(place).where("length > 0").select("content")
    return files.mapInArrow(_parser(with_block), RECORD)


def assemble(found: DataFrame) -> DataFrame:
    """One nested row per capture: its response or revisit, with the request
    and the metadata that are concurrent to it (null where missing; with several,
    the one of the smallest record id)."""
    fields = lambda kind: F.struct("record_id", "kind", "target", "refers_to", "payload_bytes", "payload_digest", "declared_digest", "block").alias(kind)
    main = found.where(F.col("kind").isin("response", "revisit")).select("record_id", "page_id", fields("response"))
    sides = found.where(F.col("kind").isin("request", "metadata") & F.col("concurrent_to").isNotNull())
    pick = lambda kind: F.min(F.when(F.col("kind") == kind, F.struct("record_id", "target", "block"))).alias(kind)
    sides = sides.groupBy("concurrent_to").agg(pick("request"), pick("metadata"))
    return main.join(sides, main["record_id"] == sides["concurrent_to"], "left").select("page_id", "response", "request", "metadata")


def capture_table(spark: SparkSession, place: str, with_block: bool = True) -> DataFrame:
    """The captures of the archives in a folder, revisits with the page they refer
    to; consistent: whether the declared digest is that of the payload (of a
    revisit: digest and length are those of the response), null if none is
    declared."""
    found = cut(read_records(spark, place, with_block))
    asked = found.where("kind = 'revisit' AND refers_to IS NOT NULL").select("record_id", F.col("refers_to").alias("_rid"), F.col("payload_digest").alias("d"), F.col("payload_bytes").alias("b"))
    counted = asked.groupBy("_rid").agg(F.count(F.lit(1)).alias("n"))
    first = found.where("kind = 'response'").groupBy(F.col("record_id").alias("_rid")).agg(F.max("page_id").alias("refers_to_page"), F.max("payload_digest").alias("d_first"), F.max("payload_bytes").alias("b_first"))
    told = look_up(asked, cut(counted.join(first, "_rid")), ["_rid"], "n", found.count())
    told = told.select(F.col("record_id").alias("_own"), "refers_to_page", (F.col("d").eqNullSafe(F.col("d_first")) & F.col("b").eqNullSafe(F.col("b_first"))).alias("_same"))
    whole = assemble(found)
    whole = whole.join(told, whole["response.record_id"] == told["_own"], "left")
    own = F.col("response.payload_digest") == F.col("response.declared_digest")
    return whole.withColumn("consistent", F.when(F.col("response.kind") == "revisit", F.coalesce("_same", F.lit(False))).otherwise(own)).drop("_own", "_same")


def new_folder(shared: str) -> str:
    return f"{shared}/warc-{uuid.uuid4().hex}"


def oracle_sql() -> str:
    """The captures of all pages, for DuckDB."""
    number = lambda block: f"('0x' || substr(h, {block * 10 + 1}, 10))::BIGINT"
    letters = [f"substr('{BASE32}', CAST((({number(block)} >> {35 - 5 * i}) & 31) + 1 AS BIGINT), 1)" for block in range(4) for i in range(8)]
    return f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
l AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS last_id FROM p)
SELECT page_id, strlen(html) AS payload_bytes, {' || '.join(letters)} AS payload_digest,
  CASE WHEN page_id < last_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id < last_id THEN last_id END AS refers_to
FROM l"""
