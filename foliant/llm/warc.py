"""WARC archives of pages with a Zstandard dictionary each, written and read through Spark.

A partition's records become archives of about ARCHIVE_BYTES: a leading skippable frame (magic
0x184D2A5D) that holds the dictionary, built from the first records, then one Zstandard frame for
each record. An archive is a row of a text table with one row a file, so the files are written by
Spark's own committer to any file system it knows, and a lost executor leaves no half archives. The
line separator of the table is an empty skippable frame, which every Zstandard reader passes over:
the whole file is a valid stream.

Records of equal payloads: from MIN_REVISIT bytes on, the least page_id is the response and the
others are revisits that refer to it and hold no payload.

Cases: a null html is an empty payload; a null url an empty target. Control characters in urls are
percent-encoded. Extra columns are not read. Too few records for training give a dictionary of
their raw bytes. An empty table gives no archives and no rows. Rows that repeat are records each;
those with the least page_id of a payload are all responses. A null page_id is kept; it is never
the least one, and where all of a payload's are null all are responses. A record larger than an
archive makes a larger archive.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir

MIN_REVISIT = 100
DICTIONARY_MAGIC, EMPTY_FRAME = 0x184D2A5D, "P*M\x18\x00\x00\x00\x00"
#: Size of the dictionary, bytes of records that it is built from, compression level.
DICTIONARY_BYTES, TRAINING_BYTES, LEVEL = 64 << 10, 4 << 20, 6
#: Compressed bytes after which an archive ends.
ARCHIVE_BYTES = 32 << 20
#: All records carry this date unless another one is given: equal input gives equal archives.
DATE = "2024-01-01T00:00:00Z"


def plan_records(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, payload_digest, refers_to (null for responses)."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    table = pages.select(F.col("page_id").cast("long"), "url", payload.alias("payload"), F.sha2(payload, 256).alias("payload_digest"))
    long = table.where(F.octet_length("payload") >= MIN_REVISIT).select("page_id", "payload_digest")
    first = long.groupBy("payload_digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n")
    revisits = long.join(first, "payload_digest").where(~F.col("page_id").eqNullSafe(F.col("refers_to")) & F.col("refers_to").isNotNull()).distinct()
    revisits = revisits.select(F.col("page_id").alias("id"), F.col("payload_digest").alias("digest"), "refers_to")
    same = F.col("page_id").eqNullSafe(F.col("id")) & (F.col("payload_digest") == F.col("digest"))
    return table.join(revisits, same, "left").drop("id", "digest")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str = DATE) -> bytes:
    """One WARC 1.1 record."""
    target = "".join(f"%{ord(c):02X}" if ord(c) < 33 or ord(c) == 127 else c for c in url or "")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'null' if page_id is None else page_id}>",
        f"WARC-Target-URI: {target}", f"WARC-Date: {date}", f"WARC-Payload-Digest: sha256:{digest}",
    ]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def _dictionary(samples: list[bytes]):
    import zstandard

    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples)
    except zstandard.ZstdError:  # too few or too small
        return zstandard.ZstdCompressionDict(b"".join(samples)[-DICTIONARY_BYTES:], dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def archives(records: Iterator[bytes], size: int = ARCHIVE_BYTES) -> Iterator[bytes]:
    """Archives of the records: the dictionary's frame, then each record's; a new one after size bytes."""
    done: list[bytes] = []
    held: list[bytes] = []
    compress, written, waiting = None, 0, 0
    for one in records:
        if compress is None:
            held.append(one)
            waiting += len(one)
            if waiting < min(TRAINING_BYTES, size):
                continue
            head, compress = _start(held)
            done = [head, *map(compress, held)]
            held, waiting, written = [], 0, sum(map(len, done))
        else:
            done.append(compress(one))
            written += len(done[-1])
        if written >= size:
            yield b"".join(done)
            done, compress = [], None
    if held:
        head, compress = _start(held)
        done = [head, *map(compress, held)]
    if done:
        yield b"".join(done)


def _start(held: list[bytes]):
    import zstandard

    dictionary = _dictionary(held)
    data = zstandard.ZstdCompressor(level=LEVEL).compress(dictionary.as_bytes())
    return struct.pack("<II", DICTIONARY_MAGIC, len(data)) + data, zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary, write_checksum=True).compress


def records_of(archive: memoryview) -> Iterator[bytes]:
    """The records of an archive, one frame at a time."""
    import zstandard

    reader, at = zstandard.ZstdDecompressor(), 0
    while at < len(archive):
        magic = struct.unpack_from("<I", archive, at)[0]
        if magic & 0xFFFFFFF0 == 0x184D2A50:
            size = struct.unpack_from("<I", archive, at + 4)[0]
            if magic == DICTIONARY_MAGIC and at == 0:
                data = zstandard.ZstdDecompressor().decompress(archive[8 : 8 + size])
                reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data))
            at += 8 + size
            continue
        frame, parts, step = reader.decompressobj(), [], 1 << 14
        while not frame.eof:
            if at >= len(archive):
                raise EOFError("the archive ends within a record")
            parts.append(frame.decompress(archive[at : at + step]))
            at += min(step, len(archive) - at)
        at -= len(frame.unused_data)
        yield b"".join(parts)


def write_archives(pages: DataFrame, path: str, date: str = DATE, size: int = ARCHIVE_BYTES) -> None:
    """Write the pages' records to archives in a folder, each of about size bytes at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(*batch.columns))
        for archive in archives((record(*(x.as_py() for x in row), date=date) for row in rows), size):
            yield pa.RecordBatch.from_arrays([pa.array([archive], pa.binary())], names=["archive"])

    planned = plan_records(pages).select("page_id", "url", "payload", "payload_digest", "refers_to")
    # Bytes stay as they are: the cast only renames their type, and the writer copies them.
    rows = planned.mapInArrow(run, "archive binary").select(F.col("archive").cast("string"))
    rows.write.option("lineSep", EMPTY_FRAME).option("maxRecordsPerFile", 1).text(path)


_FIELDS = (
    ("page_id", "bigint", pa.int64()), ("url", "string", pa.string()), ("record_type", "string", pa.string()), ("payload_bytes", "bigint", pa.int64()),
    ("payload_digest", "string", pa.string()), ("refers_to", "bigint", pa.int64()), ("payload", "binary", pa.binary()),
)


def read_archives(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """page_id, url, record_type, payload_bytes, payload_digest, refers_to, and payload if asked for, of all archives' records.

    A response's digest and size are taken from its payload; a revisit's from its header.
    """
    fields = _FIELDS if payload else _FIELDS[:-1]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, _, t) in zip(zip(*rows), fields)], names=[n for n, _, _ in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive in batch.column(0):
                rows, size = [], 0
                for one in records_of(memoryview(archive.as_buffer())):
                    rows.append(_parsed(one)[: len(fields)])
                    size += len(one) if payload else 256
                    if size > 1 << 22:
                        yield batch_of(rows)
                        rows, size = [], 0
                if rows:
                    yield batch_of(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(path).select("content")
    return files.mapInArrow(run, ", ".join(f"{n} {t}" for n, t, _ in fields))


def _parsed(one: bytes) -> tuple:
    import hashlib

    head, _, block = one.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head.decode().split("\r\n")[1:])
    http, _, body = block[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    name = fields["WARC-Record-ID"][10:-1]
    page = None if name == "null" else int(name)
    if fields["WARC-Type"] == "revisit":
        size = int(next(x for x in http.decode().split("\r\n") if x.startswith("Content-Length"))[16:])
        return page, fields["WARC-Target-URI"], "revisit", size, fields["WARC-Payload-Digest"][7:], int(fields["WARC-Refers-To"][10:-1]), None
    return page, fields["WARC-Target-URI"], "response", len(body), hashlib.sha256(body).hexdigest(), None, body


def round_trip(pages: DataFrame, payload: bool = True) -> DataFrame:
    """Write all pages to fresh archives in the shared folder and read them back."""
    spark = pages.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/foliant/warc-{uuid.uuid4().hex}"
    write_archives(pages, path)
    return read_archives(spark, path, payload)


#: The same in DuckDB over the pages view.
ORACLE = f"""
WITH payload AS (
  SELECT page_id, encode(coalesce(html, '')) AS data FROM pages),
digest AS (
  SELECT page_id, octet_length(data) AS payload_bytes, sha256(data) AS payload_digest FROM payload),
first AS (
  SELECT *, CASE WHEN payload_bytes >= {MIN_REVISIT} THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM digest)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
       CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to
FROM first
"""
