"""WARC archives as chunked record tables.

Writing: every page becomes a WARC/1.1 record. A payload beyond `chunk_bytes`
becomes record-identifier and chunk-number rows, which are WARC segments (one
`response` and its `continuation` records), so neither side ever holds a whole
oversized record. Pages of equal payload keep one `response`, the others
`revisit` it. The files are written and read with Spark's own writers and
readers (text with CRLF CRLF between records, gzip), so they live wherever
Spark can write, and a lost executor's part is simply written again.

Reading: each file is inflated piece by piece and parsed by Content-Length;
the SHA-1 of a payload is updated incrementally as its bytes pass. Segments
may end up in different files: their rows are brought together by record and
chunk number and digested in order, one chunk in memory at a time.

Defined results: a null payload is empty; a row without a key is a response of
its own; equal rows with equal keys are all responses (none refers to itself);
an empty table gives empty archives. Other columns are not archived.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import shared_path, small_batches

CRLF = b"\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PIECE = 1 << 16


def _digest(sha1) -> str:
    return base64.b32encode(sha1.digest()).decode()


def _record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    head = CRLF.join([b"WARC/1.1", *(f"{k}: {v}".encode() for k, v in fields if v is not None), b"Content-Length: %d" % len(block)])
    return head + CRLF + CRLF + block


def _cuts(payload: memoryview, chunk: int) -> Iterator[memoryview]:
    """Pieces of at most `chunk` bytes that end between code points."""
    at, n = 0, len(payload)
    while at < n:
        end = min(n, at + chunk)
        while end < n and payload[end] & 0xC0 == 0x80:
            end -= 1
        yield payload[at:end]
        at = end


def _named(key: object) -> str:
    """A key within a record's URN: percent-encoded, also the marks of a URN's parts; null is empty, the empty string a lone %."""
    return "" if key is None else quote(str(key), safe="").replace(".", "%2E") or "%"


def _key(name: str) -> str | None:
    return None if name == "" else "" if name == "%" else unquote(name)


def _segments(key: object, mark: str, url: str | None, payload: memoryview, refers: object, chunk: int, date: str) -> Iterator[bytes]:
    name = _named(key)
    uri = None if url is None else re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
    sha1 = hashlib.sha1()
    pieces = list(_cuts(payload, chunk)) or [payload]
    for piece in pieces:
        sha1.update(piece)
    common = [("WARC-Date", date), ("WARC-Target-URI", uri)]
    whole = [("WARC-Payload-Digest", f"sha1:{_digest(sha1)}"), ("X-Payload-Length", len(payload))]
    if refers is not None:
        yield _record([("WARC-Type", "revisit"), ("WARC-Record-ID", f"<urn:x-page:{name}>"), *common, ("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:x-page:{_named(refers)}>"), *whole], b"")
        return
    if len(pieces) > 1:  # equal keys may occur; the place of writing tells their segments apart
        name = f"{name}:{mark}"
    for i, piece in enumerate(pieces):
        block = (HTTP if i == 0 else b"") + bytes(piece)
        kind = [("WARC-Type", "response" if i == 0 else "continuation"), ("WARC-Record-ID", f"<urn:x-page:{name}>" if i == 0 else f"<urn:x-page:{name}.{i + 1}>")]
        many = [("WARC-Segment-Number", i + 1)] if len(pieces) > 1 else []
        if i:
            many.append(("WARC-Segment-Origin-ID", f"<urn:x-page:{name}>"))
        if i and i == len(pieces) - 1:
            many.append(("WARC-Segment-Total-Length", len(payload) + len(HTTP)))
        kind += [("Content-Type", "application/http; msgtype=response")] if i == 0 else []
        yield _record([*kind, *common, *(whole if i == 0 else []), *many, ("WARC-Block-Digest", f"sha1:{_digest(hashlib.sha1(block))}")], block)


def write_archive(pages: DataFrame, path: str, *, key: str = "page_id", url: str = "url", payload: str = "html", revisit_from: int = 0, chunk_bytes: int = 1 << 16, records_per_file: int = 2048, date: str = "2000-01-01T00:00:00Z") -> None:
    """Write `pages` as WARC files below `path`; payloads under `revisit_from` bytes are never revisits."""
    small_batches(pages.sparkSession)
    rows = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), F.coalesce(F.col(payload), F.lit("")).alias("payload"))
    rows = rows.withColumn("sha", F.sha1(F.encode("payload", "utf-8")))
    ids = rows.where(F.col("key").isNotNull() & (F.octet_length("payload") >= revisit_from)).select("key", "sha")
    # only payloads that repeat take part; the largest key of a payload is the response
    first = ids.groupBy("sha").agg(F.max("key").alias("refers"), F.count("*").alias("n")).where("n > 1").drop("n")
    revisits = ids.join(first, "sha").where(F.col("key") != F.col("refers")).distinct()
    planned = rows.join(revisits, ["key", "sha"], "left").select("key", "url", "payload", "refers")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, row = TaskContext.get().partitionId(), 0
        for batch in batches:
            out, size = [], 0
            for k, u, p, r in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3).to_pylist()):
                row += 1
                for record in _segments(k, f"{part}-{row}", u, memoryview(p.as_buffer()), r, chunk_bytes, date):
                    out.append(record)
                    size += len(record)
                    if size > 1 << 22:
                        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()).cast(pa.string())], ["value"])
                        out, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()).cast(pa.string())], ["value"])

    planned.mapInArrow(write, "value string").write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path)


def _parse(pieces: Iterator[bytes]) -> Iterator[dict]:
    """Records of a stream of bytes: headers, and the payload's length and digest.

    The payload of a record that is not segmented is digested as it passes;
    that of a segment (bounded by the writer's chunk size) is returned.
    """
    held = bytearray()
    ended = False

    def more() -> bool:
        nonlocal ended
        piece = next(pieces, None)
        if piece is None:
            ended = True
            return False
        held.extend(piece)
        return True

    while True:
        while (at := held.find(b"\r\n\r\n")) < 0 and more():
            pass
        if at < 0:
            return
        lines = bytes(held[:at]).decode().split("\r\n")
        del held[: at + 4]
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at {lines[0][:60]!r}")
        head = {k.strip().lower(): v.strip() for k, v in (x.split(":", 1) for x in lines[1:])}
        left, sha1, size, kept = int(head["content-length"]), hashlib.sha1(), 0, []
        segmented = "warc-segment-number" in head
        if head["warc-type"] == "response":
            while held.find(b"\r\n\r\n") < 0 and more():
                pass
            skip = held.find(b"\r\n\r\n") + 4
            del held[:skip]
            left -= skip
        while left:
            if not held and not more():
                raise ValueError("a record ends early")
            part = bytes(held[:left])
            del held[: len(part)]
            left -= len(part)
            size += len(part)
            sha1.update(part)
            if segmented:
                kept.append(part)
        while len(held) < 4 and more():
            pass
        del held[:4]
        yield {"head": head, "size": size, "digest": _digest(sha1), "data": b"".join(kept) if segmented else None}


def _inflated(content: bytes) -> Iterator[bytes]:
    if content[:2] != b"\x1f\x8b":
        for i in range(0, len(content), PIECE):
            yield content[i : i + PIECE]
        return
    while content:
        z = zlib.decompressobj(31)
        data = z.decompress(content, PIECE)
        while data or not z.eof:
            if data:
                yield data
            if z.eof:
                break
            if not data and not z.unconsumed_tail:
                raise ValueError("a gzip member ends early")
            data = z.decompress(z.unconsumed_tail, PIECE)
        content = z.unused_data


_ID = re.compile(r"<urn:x-page:([^:>]*)(:[^.>]*)?(?:\.\d+)?>")
CHUNKS = T.StructType([T.StructField("key", T.StringType()), T.StructField("record", T.StringType()), T.StructField("chunk", T.IntegerType()), T.StructField("record_type", T.StringType()), T.StructField("refers_to", T.StringType()), T.StructField("payload_bytes", T.LongType()), T.StructField("payload_digest", T.StringType()), T.StructField("data", T.BinaryType())])


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """The chunk table of an archive: one row per record, or per segment of an oversized one (then with its bytes)."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("key", pa.string()), ("record", pa.string()), ("chunk", pa.int32()), ("record_type", pa.string()), ("refers_to", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("data", pa.binary())])
        for batch in batches:
            for content in batch.column("content"):
                rows, size = [], 0
                for r in _parse(_inflated(content.as_py())):
                    h = r["head"]
                    name = _ID.fullmatch(h.get("warc-segment-origin-id", h["warc-record-id"]))
                    back = h.get("warc-refers-to")
                    revisit = h["warc-type"] == "revisit"
                    rows.append({"key": _key(name[1]), "record": name[0], "chunk": int(h.get("warc-segment-number", 0)), "record_type": h["warc-type"], "refers_to": back and _key(_ID.fullmatch(back)[1]), "payload_bytes": int(h["x-payload-length"]) if revisit else r["size"], "payload_digest": h["warc-payload-digest"].removeprefix("sha1:") if revisit else r["digest"], "data": r["data"]})
                    size += len(r["data"] or b"")
                    if len(rows) >= 4096 or size > 1 << 22:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(parse, CHUNKS)


def read_archive(spark: SparkSession, path: str, key_type: str = "long") -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record below `path`."""
    chunks = read_chunks(spark, path)
    plain = chunks.where("chunk = 0").drop("record", "chunk", "data")
    parts = chunks.where("chunk > 0").select("record", "chunk", "data", "key").repartition("record").sortWithinPartitions("record", "chunk")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own, sha1, size = None, None, None, 0

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"key": pa.array([own], pa.string()), "record_type": ["response"], "refers_to": pa.array([None], pa.string()), "payload_bytes": pa.array([size], pa.int64()), "payload_digest": [_digest(sha1)]})

        for batch in batches:
            for record, data, key in zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3).to_pylist()):
                if record != now:
                    if sha1 is not None:
                        yield done()
                    now, own, sha1, size = record, key, hashlib.sha1(), 0
                part = data.as_buffer()
                sha1.update(part)
                size += len(part)
        if sha1 is not None:
            yield done()

    joined = parts.mapInArrow(digest, plain.schema)
    return plain.unionByName(joined).select(F.col("key").cast(key_type).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(key_type).alias("refers_to"))


def op4_warc(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    path = shared_path(spark, "warc")
    write_archive(pages, path)
    return read_archive(spark, path)


OP4_SQL = """
WITH hashed AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages),
digits AS (
  SELECT page_id, payload_bytes, hex,
    list_aggregate(list_transform(range(0, 8), lambda i: list_aggregate(list_transform(range(0, 4), lambda j:
      substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((('0x' || substr(hex, CAST(1 + 5 * i AS INT), 5))::BIGINT >> CAST(15 - 5 * j AS BIGINT)) & 31 AS INT), 1)), 'string_agg', '')), 'string_agg', '') AS payload_digest,
    max(page_id) OVER (PARTITION BY hex) AS response
  FROM hashed)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN page_id = response THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = response THEN NULL ELSE response END AS refers_to
FROM digits
"""
