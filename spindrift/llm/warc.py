"""WARC archives with revisit resolution.

Headers (page id and payload digest, without payloads) are shuffled by digest; of the records with one digest that of
the largest page id is the response, the others become revisit records with fresh headers that name it. Archives are
WARC/1.1 files written by Spark's text writer: a record ends with CRLF CRLF, which is the line separator. They are
read back as streams of such lines, put together again record by record by Content-Length, so that a task holds one
record however large its file is; then each revisit is joined to its response.

A file is one gzip stream: it is read from its beginning, records in it cannot be sought.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.llm.common import forget, shared_dir, shipped, spread_join, written

#: Record ids and the revisit profile as the format asks for them.
ID = "<urn:page:{}>"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Records in a file at most: a file is read by one task.
FILE_RECORDS = 2_000
END = "\r\n\r\n"
_B32 = ("0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def sha1_base32(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: eight groups of 20 bits."""
    h = F.sha1(payload)
    groups = [F.lpad(F.conv(F.substring(h, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.upper(F.concat(*groups)), *_B32)


def headers(pages: DataFrame) -> DataFrame:
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    return pages.select(F.col("page_id").cast("long").alias("page_id"), sha1_base32(payload).alias("digest"), F.octet_length(payload).cast("long").alias("bytes"))


def originals(heads: DataFrame, least: int = 0) -> DataFrame:
    """(page_id, digest, rows, refers_to) of the records that revisit another: equal payloads of at least `least` bytes.

    The largest page id of each digest is combined before the shuffle. `rows` that repeat a page_id with one payload share
    their fate.
    """
    long_enough = heads.where(F.col("bytes") >= least).where("page_id is not null")
    first = long_enough.groupBy("digest", "bytes").agg(F.max("page_id").alias("refers_to"), F.min("page_id").alias("low"), F.count("*").alias("n")).where("low < refers_to").drop("low")
    found = spread_join(long_enough, first, ["digest", "bytes"], "n", heads.count()).where("page_id < refers_to")
    return found.groupBy("page_id", "digest", "refers_to").agg(F.count("*").alias("rows"))


def records(pages: DataFrame, refers: DataFrame, total: int) -> DataFrame:
    """(record): the text of one WARC record for each of `total` pages, without the CRLF CRLF that ends it."""
    html = F.coalesce(F.col("html"), F.lit(""))
    line = lambda name, v: F.concat(F.lit(f"{name}: "), v, F.lit("\r\n"))
    ident = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    uri = F.regexp_replace(F.col("url"), r"[\x00-\x20\x7f<>]", "_")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(html).cast("string"), F.lit(END))
    revisit = F.col("refers_to").isNotNull()
    block = F.when(revisit, http).otherwise(F.concat(http, html))
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", ident(F.col("page_id"))),
        F.lit("WARC-Date: 2024-01-01T00:00:00Z\r\n"),
        F.coalesce(line("WARC-Target-URI", uri), F.lit("")),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(revisit, F.concat(line("WARC-Refers-To", ident(F.col("refers_to"))), line("WARC-Profile", F.lit(PROFILE)))).otherwise(""),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"),
    )
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", sha1_base32(html.cast("binary")).alias("digest"))
    joined = spread_join(own, refers, ["page_id", "digest"], "rows", total, "left")
    return joined.select(F.concat(head, block).alias("record"))


def write(recs: DataFrame, path: str) -> None:
    recs.write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", FILE_RECORDS).text(path)


class Parser:
    """Cuts a stream of bytes into records; holds no more than the record that it is in."""

    def __init__(self):
        self.held, self.head, self.start, self.need = bytearray(), None, 0, 4

    def feed(self, part: bytes):
        """(headers, block) of each record that `part` completes; raises ValueError where the stream is not WARC."""
        self.held += part
        while len(self.held) >= self.need:
            if self.head is None:
                split = self.held.find(b"\r\n\r\n", max(0, self.need - 4))
                if not b"WARC/".startswith(self.held[:5]):
                    raise ValueError("no WARC record")
                if split < 0:
                    self.need = len(self.held) + 1
                    return
                self.head = dict(x.split(": ", 1) for x in self.held[:split].decode("utf-8").split("\r\n")[1:])
                self.start = split + 4
                self.need = self.start + int(self.head["Content-Length"]) + 4
            else:
                if self.held[self.need - 4 : self.need] != b"\r\n\r\n":
                    raise ValueError("a record is cut off or longer than it says")
                yield self.head, bytes(self.held[self.start : self.need - 4])
                del self.held[: self.need]
                self.head, self.need = None, 4


def parse(parts, end: bytes = b""):
    """The records of one archive, given in parts; what `end` completes belongs to them."""
    own = Parser()
    for part in parts:
        yield from own.feed(part)
    if own.held and end:
        yield from own.feed(end)
    if own.held:
        raise ValueError("the last record is cut off")


READ = "page_id long, record_type string, url string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def read(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """The records of the archives under `path`; digests are taken of the payloads that are there and compared."""
    names = [c.split()[0] for c in READ.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
    end = END.encode()

    def number(urn):
        inner = urn[len("<urn:page:") : -1] if urn else ""
        return int(inner) if inner else None

    def row(head, block):
        kind, digest, payload = head["WARC-Type"], head["WARC-Payload-Digest"].removeprefix("sha1:"), None
        if kind == "response":
            payload = block[block.index(b"\r\n\r\n") + 4 :]
            if base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                raise ValueError(f"payload of {head['WARC-Record-ID']} does not match its digest")
        return number(head["WARC-Record-ID"]), kind, head.get("WARC-Target-URI"), None if payload is None else len(payload), digest, number(head.get("WARC-Refers-To")), payload if payloads else None

    def lines(batches):
        for b in batches:
            yield from zip(b.column(0).to_pylist(), b.column(1), strict=True)

    def files(batches):
        """The bytes of each file in turn. The reader cuts at every CRLF CRLF, so all but the first line are led by one."""
        for _, of_file in groupby(lines(batches), key=lambda x: x[0]):
            yield from parse((end * (i > 0) + line.as_py() for i, (_, line) in enumerate(of_file)), end)

    def run(batches):
        out, size = [], 0
        for head, block in files(batches):
            out.append(row(head, block))
            size += len(block) * payloads
            if len(out) == 500 or size > 1 << 24:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
                out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    found = spark.read.option("lineSep", END).option("pathGlobFilter", "*.gz").text(path)
    return shipped(found).select(F.xxhash64("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("line")).mapInArrow(run, READ)


def resolved(recs: DataFrame) -> DataFrame:
    """Archive records, each revisit with the payload size of the response that it names; one without is an error."""
    base = recs.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    responses, revisits = base.where("record_type = 'response'"), base.where("record_type = 'revisit'").drop("payload_bytes")
    keys = ["refers_to", "payload_digest"]
    stored = responses.where("page_id is not null").groupBy(F.col("page_id").alias("refers_to"), "payload_digest").agg(F.max("payload_bytes").alias("_bytes"))
    targets = revisits.groupBy(*keys).agg(F.count("*").alias("_n")).join(stored, keys, "left")
    missing = F.raise_error(F.concat(F.lit("the archives lack the response of page "), F.col("refers_to").cast("string")))
    named = spread_join(revisits, targets, keys, "_n", recs.count(), "left").withColumn("payload_bytes", F.coalesce("_bytes", missing.cast("long")))
    return responses.unionByName(named.select(*responses.columns))


def archive(pages: DataFrame, path: str, least: int = 0) -> None:
    """Write `pages` (page_id, url, html) as deduplicated archives under `path`."""
    heads = written(headers(pages), "headers")
    write(records(pages, originals(heads, least), heads.count()), path)
    forget(heads)


def op9(pages: DataFrame, least: int = 0) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every row of pages, read back from archives.

    A null html is an empty payload; a null url leaves the target out. Rows without a page_id are responses. Rows that
    repeat a page_id give a record each. An empty table gives an empty result.
    """
    spark = pages.sparkSession
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    archive(pages, path, least)
    recs = written(read(spark, path).drop("payload"), "records")
    return resolved(recs)


ORACLE = r"""
with p as (
  select page_id, coalesce(html, '') as payload, sha1(coalesce(html, '')) as h,
         strlen(coalesce(html, '')) as payload_bytes
  from pages
), n as (
  select page_id, payload_bytes, max(page_id) over (partition by payload) as top,
         (select string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + cast((cast('0x' || substr(h, 5 * i + 1, 5) as integer) >> (15 - 5 * j)) & 31 as integer), 1), '' order by i, j)
          from range(8) a(i), range(4) b(j)) as payload_digest
  from p
)
select page_id, cast(payload_bytes as bigint) as payload_bytes, payload_digest,
       case when page_id = top then 'response' else 'revisit' end as record_type,
       case when page_id = top then null else top end as refers_to
from n
"""
