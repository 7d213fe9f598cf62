"""WARC archives: write records with segmentation and chunked framing, read them back.

Writing: payloads are named by their base32 SHA-1; of equal payloads of at
least ``min_bytes`` bytes the smallest id is a response record and the others
are revisit records that refer to it. Response blocks are HTTP messages in
chunked transfer framing; blocks over ``segment_bytes`` are cut into a response
record and continuation records. Archives are gzip files written by Spark's
text sink (record separator CRLF CRLF) in the shared folder.

Reading: Spark's text source streams each archive (gzip is not split) and a
parser walks the records by Content-Length, so pieces cut at the separator
inside a block are put together again. Whole records are finished in place;
segments are grouped by origin identifier, ordered by segment number, checked
against the total length, and then de-chunked.

Defined cases: a null payload is empty; a null url is an empty target; rows
that repeat an id are written each as its own record, and those with the
smallest id of their payload are all responses; rows with a null id are
responses and are never referred to.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checkwise.llm.common import shared_dir, ship, stored

CRLF = b"\r\n"
END = b"\r\n\r\n"
SEGMENT_BYTES = 16 << 10
CHUNK_BYTES = 4 << 10
RECORD_SCHEMA = ("record_id string, type string, page_id long, url string, payload_digest string, refers_to long, "
                 "origin string, segment int, total long, payload_bytes long, block binary")


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """Chunked transfer framing."""
    out = []
    for i in range(0, len(payload), size):
        part = payload[i:i + size]
        out += [b"%x\r\n" % len(part), part, CRLF]
    return b"".join([*out, b"0\r\n\r\n"])


def dechunked(body: bytes) -> bytes:
    """The payload of a chunked body; raises ValueError where the framing is broken."""
    out, at = [], 0
    while True:
        line = body.index(CRLF, at)
        size = int(body[at:line].split(b";")[0], 16)
        at = line + 2
        if not size:
            return b"".join(out)
        if body[at + size:at + size + 2] != CRLF:
            raise ValueError("chunk without its end")
        out.append(body[at:at + size])
        at += size + 2


def payload_of(block: bytes) -> bytes:
    """Payload of an HTTP response block."""
    head, _, body = block.partition(END)
    return dechunked(body) if b"transfer-encoding: chunked" in head.lower() else body


def _header(kind: str, rid: str, length: int, **fields) -> bytes:
    lines = [f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:uuid:{rid}>\r\nWARC-Date: 1970-01-01T00:00:00Z"]
    lines += [f"{k.replace('_', '-')}: {v}" for k, v in fields.items() if v is not None]
    return ("\r\n".join([*lines, f"Content-Length: {length}"])).encode() + END


def _plain(url: str | None) -> str:
    return (url or "").replace("\r", "%0D").replace("\n", "%0A")


def records_of(place: str, page_id, url, payload: bytes, refers_to, segment_bytes: int) -> Iterator[bytes]:
    """The record of one page without its closing CRLF CRLF, and its continuation records.

    ``place`` tells rows apart that are equal in every column (the task and the row's number in it)."""
    common = {"WARC_Target_URI": _plain(url), "X_Page_ID": page_id,
              "WARC_Payload_Digest": "sha1:" + base32_sha1(payload)}
    rid = str(uuid.uuid5(uuid.NAMESPACE_URL, f"{page_id}/{place}/{common['WARC_Payload_Digest']}"))
    if refers_to is not None:
        head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html" + END
        yield _header("revisit", rid, len(head), **common, X_Refers_To_Page=refers_to, X_Payload_Length=len(payload),
                      WARC_Profile="http://netpreserve.org/warc/1.1/revisit/identical-payload-digest") + head
        return
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nTransfer-Encoding: chunked" + END + chunked(payload)
    if len(block) <= segment_bytes:
        yield _header("response", rid, len(block), **common) + block
        return
    parts = [block[i:i + segment_bytes] for i in range(0, len(block), segment_bytes)]
    yield _header("response", rid, len(parts[0]), **common, WARC_Segment_Number=1) + parts[0]
    for n, part in enumerate(parts[1:], 2):
        total = len(block) if n == len(parts) else None
        own = str(uuid.uuid5(uuid.UUID(rid), str(n)))
        yield _header("continuation", own, len(part), WARC_Target_URI=common["WARC_Target_URI"],
                      WARC_Segment_Number=n, WARC_Segment_Origin_ID=f"<urn:uuid:{rid}>",
                      WARC_Segment_Total_Length=total) + part


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url",
                   payload_col: str = "html", min_bytes: int = 0, segment_bytes: int = SEGMENT_BYTES) -> None:
    """Write every row of ``pages`` to gzip archives in the folder ``path``."""
    ship(pages.sparkSession)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"),
                        F.coalesce(F.col(payload_col).cast("binary"), F.lit("").cast("binary")).alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    # only payloads that occur twice need a reference: the least id per digest is combined map-side
    first = (rows.filter(F.octet_length("payload") >= min_bytes).groupBy("digest")
             .agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1").select("digest", "first"))
    # stored, so that both sides of the join are plain shuffles and a very common payload's rows can be split over tasks
    joined = (rows.join(stored(first, "digests"), "digest", "left")
              .select("page_id", "url", "payload", F.when(F.col("page_id") > F.col("first"), F.col("first")).alias("ref")))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, task = 0, TaskContext.get().partitionId()
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                out = []
                part = batch.slice(lo, 256)
                for page_id, url, payload, ref in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    out.extend(records_of(f"{task}.{number}", page_id, url, payload, ref, segment_bytes))
                    number += 1
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])

    (joined.mapInArrow(make, "record binary").select(F.col("record").cast("string").alias("value"))
     .write.option("lineSep", END.decode()).option("compression", "gzip").text(path))


class Stream:
    """Records from the pieces of an archive, as the text source hands them over."""

    def __init__(self):
        self.held = bytearray()

    def feed(self, piece: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
        self.held += piece
        self.held += END
        at = 0
        while True:
            while self.held[at:at + 2] == CRLF:
                at += 2  # record ends, and the separator that follows a file's last piece
            end = self.held.find(END, at)
            if end < 0:
                break
            lines = self.held[at:end].decode().split("\r\n")
            if not lines[0].startswith("WARC/"):
                raise ValueError(f"no record at {lines[0][:40]!r}")
            fields = dict(line.split(": ", 1) for line in lines[1:])
            stop = end + 4 + int(fields["Content-Length"])
            if len(self.held) < stop + 4:
                break
            if self.held[stop:stop + 4] != END:
                raise ValueError("record without its end")
            yield fields, bytes(self.held[end + 4:stop])
            at = stop + 4
        del self.held[:at]


def _number(fields: dict[str, str], name: str):
    return int(fields[name]) if fields.get(name, "None") != "None" else None


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """One row per record (RECORD_SCHEMA) of the archives in a folder."""
    ship(spark)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = Stream()
        names = [c.split()[0] for c in RECORD_SCHEMA.split(", ")]
        kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int32(),
                 pa.int64(), pa.int64(), pa.binary()]

        def batch_of(rows):
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        rows, size = [], 0
        for batch in batches:
            for piece in batch.column(0):
                for f, block in stream.feed(piece.as_py()):
                    rows.append((f["WARC-Record-ID"], f["WARC-Type"], _number(f, "X-Page-ID"), f.get("WARC-Target-URI"),
                                 f.get("WARC-Payload-Digest", "").removeprefix("sha1:"), _number(f, "X-Refers-To-Page"),
                                 f.get("WARC-Segment-Origin-ID"), _number(f, "WARC-Segment-Number"),
                                 _number(f, "WARC-Segment-Total-Length"), _number(f, "X-Payload-Length"), block))
                    size += len(block)
                    if size > 4 << 20:
                        yield batch_of(rows)
                        rows, size = [], 0
        if stream.held.strip(b"\r\n"):
            raise ValueError("the archive ends inside a record")
        if rows:
            yield batch_of(rows)

    lines = spark.read.option("lineSep", END.decode()).text(path)
    return lines.select(F.col("value").cast("binary").alias("value")).mapInArrow(parse, RECORD_SCHEMA)


PAGE_SCHEMA = ("page_id long, url string, payload_bytes long, payload_digest string, record_type string, "
               "refers_to long, payload binary")


def read_pages(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """One row per archived page (PAGE_SCHEMA): segments joined and checked, chunks decoded.

    Revisits have a null payload, and the length and digest of the one they refer to.
    ``payloads=False`` leaves the payload column null.
    """
    records = read_records(spark, path)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, body = [], []
            for kind, known, digest, block in zip(*(batch.column(i).to_pylist() for i in (4, 6, 3, 7)), strict=True):
                if kind == "revisit":
                    length.append(known)
                    body.append(None)
                    continue
                payload = payload_of(block)
                if base32_sha1(payload) != digest:
                    raise ValueError("payload does not match its digest")
                length.append(len(payload))
                body.append(payload if payloads else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(length, pa.int64()), batch.column(3), batch.column(4),
                 batch.column(5), pa.array(body, pa.binary())], [c.split()[0] for c in PAGE_SCHEMA.split(", ")])

    # one record's segments are a bounded group: a page, cut into segments
    segmented = records.filter(F.col("segment").isNotNull()).withColumn("key", F.coalesce("origin", "record_id"))
    part = F.struct("segment", "total", "block")
    joined = (segmented.groupBy("key")
              .agg(F.max_by("page_id", F.col("type") == "response").alias("page_id"), F.max("url").alias("url"),
                   F.max_by("payload_digest", F.col("type") == "response").alias("payload_digest"),
                   F.array_sort(F.collect_list(part)).alias("parts"))
              .withColumn("block", F.reduce("parts", F.lit("").cast("binary"), lambda a, p: F.concat(a, p["block"])))
              .withColumn("block", F.when(
                  (F.octet_length("block") == F.element_at("parts", -1)["total"])
                  & (F.element_at("parts", -1)["segment"] == F.size("parts")), F.col("block"))
                  .otherwise(F.raise_error(F.concat(F.lit("segments are missing for "), F.col("key")))))
              .select("page_id", "url", F.lit(None).cast("long").alias("z"), "payload_digest",
                      F.lit("response").alias("type"), F.lit(None).cast("long").alias("refers_to"),
                      F.lit(None).cast("long").alias("payload_bytes"), "block"))
    whole = records.filter(F.col("segment").isNull()).select(
        "page_id", "url", F.lit(None).cast("long").alias("z"), "payload_digest", "type", "refers_to", "payload_bytes", "block")
    return whole.unionByName(joined).mapInArrow(finish, PAGE_SCHEMA)


def archived(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
             payloads: bool = False, **how) -> DataFrame:
    """Write ``pages`` to new archives in the shared folder and read them back."""
    spark = pages.sparkSession
    path = shared_dir(spark, "warc")
    write_archives(pages, path, id_col, url_col, payload_col, **how)
    return read_pages(spark, path, payloads)
