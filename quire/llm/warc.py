"""WARC archives with revisit records.

Headers (id, payload digest, length) are shuffled by digest, without payloads. Of each
digest, the row with the largest id is the response; the others become revisit records,
which carry fresh headers and no payload and name the response. A file begins with a
warcinfo record; each record is a gzip member of its own, so that readers can seek.

Archives are written by Spark's own committer, so that a lost executor's half-written file
never counts and any file system Spark writes to will do; when all are written they get
names that end in .warc.gz. They are read back as streams of lines, put together again by
Content-Length, so that payloads may hold any text and no task holds a whole file.

Reading resolves revisits: headers of the two kinds meet by digest and id, and a revisit
gets its length from the response that it names.

Defined results: a null html is an empty payload; a null url gives a record without a
target URI; payloads below ``least`` bytes are all responses; rows that share both the
largest id and the payload are responses each, under one record id; a null id sorts lowest
and is written as ``null``; a very long payload is one record, held whole by one task;
extra columns are ignored; an empty table gives files without pages.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import map_batches, new_path, table, written

END = b"\r\n\r\n"
#: Payload bytes of a file: the least, and the most. Between them it grows with the input.
FILE_BYTES, MOST_FILE_BYTES, FILES = 24 << 20, 1 << 30, 4096
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: A gzip member of nothing.
EMPTY = zlib.compress(b"", wbits=31)


def payload_digest(html: Column) -> Column:
    """Base32 SHA-1 of the UTF-8 bytes, bare: 20 bits of the hexadecimal digest at a time."""
    parts = [F.lpad(F.conv(F.substring(F.sha1(html.cast("binary")), 5 * k + 1, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def headers(pages: DataFrame, page_id: str = "page_id", html: str = "html") -> DataFrame:
    """page_id, payload_digest and payload_bytes of each page."""
    body = F.coalesce(F.col(html), F.lit(""))
    return pages.select(F.col(page_id).alias("page_id"), payload_digest(body).alias("payload_digest"), F.octet_length(body).cast("long").alias("payload_bytes"))


def responses(found: DataFrame, least: int = 0) -> DataFrame:
    """page_id, payload_digest and response (the id that holds the payload), distinct.

    Only digests that come again are looked up, from a table of pre-aggregated maxima that
    is written first: both sides of the join are then shuffles of their own, and Spark can
    split the task of a digest with very many rows.
    """
    found = found.where(F.col("payload_bytes") >= least).select("page_id", "payload_digest").distinct()
    shared, _ = written(found.groupBy(F.col("payload_digest").alias("d")).agg(F.max("page_id").alias("last"), F.count("*").alias("rows")).where("rows > 1").select("d", "last"), "responses")
    joined = found.join(shared, F.col("payload_digest") == F.col("d"), "left")
    return joined.select("page_id", "payload_digest", F.when(F.col("d").isNull(), F.col("page_id")).otherwise(F.col("last")).alias("response"))


def _lines(*fields: tuple[str, object]):
    """Header lines; a null value leaves its line out."""
    return F.concat_ws("\r\n", *[F.concat(F.lit(f"{name}: "), value) for name, value in fields])


def _urn(page: Column, digest: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("null")), F.lit(":"), digest, F.lit(">"))


def records(pages: DataFrame, files: int, least: int = 0, page_id: str = "page_id", url: str = "url", html: str = "html", date: str | None = None) -> DataFrame:
    """head and block of a WARC response or revisit record for each page.

    Payloads are shuffled once, by id and digest into as many partitions as files, so
    that rows of one payload spread. ``date``: of the records, the present by default.
    """
    date = date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    body = F.coalesce(F.col(html), F.lit(""))
    key = ("p", "payload_digest")
    rows = pages.select(F.coalesce(F.col(page_id).cast("string"), F.lit("null")).alias("p"), F.col(page_id).alias("page_id"), F.col(url).alias("url"), body.alias("html"), payload_digest(body).alias("payload_digest"), F.octet_length(body).cast("long").alias("payload_bytes"))
    known = responses(headers(pages, page_id, html), least).select(F.coalesce(F.col("page_id").cast("string"), F.lit("null")).alias("p"), "payload_digest", "response")
    joined = rows.repartition(files, *key).join(known.repartition(files, *key), list(key), "left")
    revisit = F.col("response").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("response"))
    clean_url = F.regexp_replace("url", r"[\r\n]+", "%0A")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes").cast("string"), F.lit("\r\n\r\n"))
    block = F.concat(http, F.when(revisit, "").otherwise(F.col("html")))
    head = _lines(
        ("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        ("WARC-Record-ID", _urn(F.col("page_id"), F.col("payload_digest"))),
        ("WARC-Date", F.lit(date)),
        ("WARC-Target-URI", clean_url),
        ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        ("WARC-Profile", F.when(revisit, F.lit(PROFILE))),
        ("WARC-Refers-To", F.when(revisit, _urn(F.col("response"), F.col("payload_digest")))),
        ("WARC-Refers-To-Date", F.when(revisit, F.lit(date))),
        ("Content-Type", F.lit("application/http; msgtype=response")),
        ("Content-Length", F.octet_length(block).cast("string")),
    )
    return joined.select(F.concat(F.lit("WARC/1.1\r\n"), head, F.lit("\r\n\r\n")).alias("head"), block.alias("block"))


def member(record: bytes) -> bytes:
    """A record as a gzip member, without the last byte, a zero that the writer puts after each row.

    That byte is the highest one of the length; from 16 MB on it may be another, and an
    empty member follows.
    """
    packed = zlib.compress(record, 6, wbits=31)
    return (packed if packed[-1] == 0 else packed + EMPTY)[:-1]


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    about = b"software: quire\r\nformat: WARC File Format 1.1\r\n"
    stamp = datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ").encode()
    name = hashlib.sha1(struct.pack("d", datetime.now(timezone.utc).timestamp()) + str(id(batches)).encode()).hexdigest().encode()
    info = b"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:sha1:" + name + b">\r\nWARC-Date: " + stamp + b"\r\nContent-Type: application/warc-fields\r\nContent-Length: " + str(len(about)).encode() + END + about + END
    yield pa.RecordBatch.from_arrays([pa.array([member(info)], pa.binary())], names=["value"])
    for batch in batches:
        heads, blocks = (c.cast(pa.binary()) for c in batch.columns)
        yield pa.RecordBatch.from_arrays([pa.array([member(h.as_py() + b.as_py() + END) for h, b in zip(heads, blocks, strict=True)], pa.binary())], names=["value"])


def write_archives(pages: DataFrame, path: str, least: int = 0, file_bytes: int | None = None, **names: str) -> None:
    """Writes WARC files of about ``file_bytes`` payload bytes each, by default by the input's size."""
    spark = pages.sparkSession
    total = pages.agg(F.coalesce(F.sum(F.octet_length(F.col(names.get("html", "html")))), F.lit(0)), F.count("*")).first()
    file_bytes = file_bytes or min(MOST_FILE_BYTES, max(FILE_BYTES, total[0] // FILES))
    files = max(1, -(-total[0] // file_bytes), min(FILES, -(-total[1] // 100_000)))
    packed = map_batches(records(pages, files, least, **names), _members, "value binary")
    # The text writer puts a value's bytes as they are, and the separator after each.
    packed.select(F.col("value").cast("string").alias("value")).write.option("lineSep", "\0").text(path)
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for k, part in enumerate(system.globStatus(jvm.org.apache.hadoop.fs.Path(f"{path}/part-*"))):  # as many as files
        if not system.rename(part.getPath(), jvm.org.apache.hadoop.fs.Path(folder, f"quire-{k:06d}.warc.gz")):
            raise OSError(f"cannot rename {part.getPath()}")


class Parser:
    """Records of a stream that comes in pieces: header fields and block."""

    def __init__(self) -> None:
        self.held = bytearray()

    def feed(self, data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
        self.held += data
        at = 0
        while (stop := self.held.find(END, at)) >= 0:
            first, *lines = self.held[at:stop].decode().split("\r\n")
            if not first.startswith("WARC/"):
                raise ValueError("what stands after a record is none")
            fields = dict(x.split(": ", 1) for x in lines)
            body = stop + len(END)
            end = body + int(fields["Content-Length"])
            if len(self.held) < end + len(END):
                break
            if self.held[end : end + len(END)] != END:
                raise ValueError("a record does not end where its length says")
            yield fields, bytes(self.held[body:end])
            at = end + len(END)
        del self.held[:at]


def _id(urn: str | None) -> int | None:
    got = urn.removeprefix("<urn:page:").partition(":")[0] if urn else "null"
    return None if got == "null" else int(got)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """page_id, record_type, refers_to, payload_digest, held_bytes, url of each page's record.

    Digests of responses are taken anew from the payload and must match the header.
    """
    columns = {"page_id": pa.int64(), "record_type": pa.string(), "refers_to": pa.int64(), "payload_digest": pa.string(), "held_bytes": pa.int64(), "url": pa.string()}

    def rows(found: Iterator[tuple[dict[str, str], bytes]]) -> Iterator[tuple]:
        for fields, body in found:
            if fields["WARC-Type"] == "warcinfo":
                continue
            digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
            payload = body[body.index(END) + len(END) :]
            if fields["WARC-Type"] == "response" and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                raise ValueError(f"the payload of {fields['WARC-Record-ID']} does not match its digest")
            yield _id(fields["WARC-Record-ID"]), fields["WARC-Type"], _id(fields.get("WARC-Refers-To")), digest, len(payload), fields.get("WARC-Target-URI")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = Parser()
        for batch in batches:
            made = list(rows(parser.feed(b"".join(x + b"\n" for x in batch.column(0).cast(pa.binary()).to_pylist()))))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in made], t) for k, t in enumerate(columns.values())], names=list(columns))
        if parser.held.strip(b"\r\n"):
            raise ValueError("an archive is cut off")

    # A compressed file is read by one task, in order; where one file follows another in a
    # task, records still end where they should.
    lines = spark.read.option("lineSep", "\n").option("pathGlobFilter", "*.warc.gz").text(path)
    return map_batches(lines, read, "page_id long, record_type string, refers_to long, payload_digest string, held_bytes long, url string")


def resolved(archive: DataFrame) -> DataFrame:
    """Each record with its full payload's length: a revisit takes its response's.

    The archive's headers and the responses are written first: payloads are parsed once, and
    the join can split the task of a response that very many records name.
    """
    archive, _ = written(archive, "headers")
    originals, _ = written(archive.where("record_type = 'response'").select(F.col("payload_digest").alias("d"), F.col("page_id").alias("p"), F.col("held_bytes").alias("full")).distinct(), "originals")
    revisits = archive.where("record_type = 'revisit'").join(originals, (F.col("payload_digest") == F.col("d")) & (F.col("refers_to") == F.col("p")), "left")
    columns = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    return revisits.withColumn("payload_bytes", F.col("full")).select(*columns).unionByName(archive.where("record_type = 'response'").withColumn("payload_bytes", F.col("held_bytes")).select(*columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), path)
    return resolved(read_archives(spark, path))


ORACLE = """
WITH p AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages
), d AS (
  SELECT page_id, payload_bytes, list_aggregate(list_transform(range(8), lambda k:
    list_aggregate(list_transform([15, 10, 5, 0], lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      CAST((CAST('0x' || substr(h, CAST(5 * k + 1 AS BIGINT), 5) AS BIGINT) >> s) & 31 AS BIGINT) + 1, 1)), 'string_agg', '')), 'string_agg', '') AS payload_digest
  FROM p
), m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS last FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = last THEN NULL ELSE last END AS refers_to
FROM m
"""
