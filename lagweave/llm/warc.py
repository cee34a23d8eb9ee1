"""WARC archives with Zstandard-compressed records and a dictionary of their own.

An archive starts with a skippable frame (magic 5D 2A 4D 18) that holds the dictionary; every record follows as one
frame. The dictionary is trained on a bounded sample of the records to be archived, heads included. Archives are
written by Spark's text sink, so any file system that Spark writes serves and lost tasks are simply run again: a row
is one frame, and the line separator is an empty skippable frame, which readers of such files pass over.

Records: of rows with equal payloads of at least LEAST bytes, those with the smallest key are responses, and the
others revisits that refer to it and carry no payload; smaller payloads are always responses.

Edge cases: a null payload is empty. Rows with a null key are written without one; null is no smallest key unless all
keys of a payload are null, which then are all responses. Rows that repeat the smallest key are all responses. An
empty table gives no archive and reads back as no rows. Control characters in an address are percent-encoded. Extra
columns of any name are ignored.
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.checkpoints import shared_folder
from .common import discard, hashed_sample, pieces, salted_join, stored

LEAST = 100
#: Bytes of the dictionary; records that it is trained on, and code points of a payload that training sees at most.
DICTIONARY, SAMPLE, RECORD_BYTES = 32_768, 400, 65_536
LEVEL = 3
_MAGIC, _EMPTY = 0x184D2A5D, "P*M\x18\x00\x00\x00\x00"
_STEP = 1 << 14
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_CONTROL = re.compile(r"[\x00-\x20\x7f]")
_SCHEMA = "page_id {}, payload_bytes long, payload_digest string, record_type string, refers_to {}, record_id string, target_uri string, payload string"


def _record_id(key, digest: str) -> str:
    return f"<urn:uuid:{uuid.UUID(hashlib.md5(f'{key}:{digest}'.encode()).hexdigest())}>"


def _record(key, url: str | None, payload: bytes, digest: str, refers_to) -> bytes:
    revisit = refers_to is not None
    block = _HTTP if revisit else _HTTP + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_record_id(key, digest)}", "WARC-Date: 1970-01-01T00:00:00Z"]
    head += [f"WARC-Target-URI: {_CONTROL.sub(lambda m: f'%{ord(m[0]):02X}', url)}"] if url is not None else []
    head += [f"X-Page-Key: {key}"] if key is not None else []
    head += [f"X-Payload-Length: {len(payload)}", f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_record_id(refers_to, digest)}", f"X-Refers-To-Key: {refers_to}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def dictionary(pages: DataFrame) -> bytes:
    """A dictionary trained on SAMPLE records of pages(key, url, payload, digest), each up to RECORD_BYTES, in hash order.

    If they are too few to train on, their plain bytes are the dictionary, as Zstandard allows.
    """
    head = pages.select("key", "url", F.expr(f"left(payload, {RECORD_BYTES})").alias("payload"), "digest").withColumn("order", F.xxhash64("key", "digest"))
    rows = sorted(hashed_sample(head, "order", SAMPLE).collect(), key=lambda r: (r["order"], r["url"] or "", r["payload"]))
    records = [_record(r["key"], r["url"], r["payload"].encode(), r["digest"], None) for r in rows]
    if not records:
        return b""
    try:
        return zstandard.train_dictionary(DICTIONARY, records, threads=1).as_bytes()
    except zstandard.ZstdError:
        return b"".join(records)[-DICTIONARY:]


def _compress(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    raw = shared.value
    book = zstandard.ZstdCompressionDict(raw) if raw else None
    if book:
        book.precompute_compress(level=LEVEL)
    packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=book, write_content_size=True) if book else zstandard.ZstdCompressor(level=LEVEL)
    lead = [struct.pack("<II", _MAGIC, len(raw)) + raw] if raw else []
    for batch in pieces(batches):
        rows = zip(*(c.to_pylist() for c in batch.columns), strict=True)
        frames = [packer.compress(_record(key, url, text.encode(), digest, to)) for key, url, text, digest, to in rows]
        yield pa.RecordBatch.from_arrays([pa.array(lead + frames, pa.binary())], ["frame"])
        lead = lead and []


def write(pages: DataFrame, path: str) -> None:
    """Archives pages(key, url, payload) below path, one file per task."""
    pages = pages.select("key", F.col("url").cast("string").alias("url"), F.coalesce(F.col("payload").cast("string"), F.lit("")).alias("payload"))
    pages = pages.withColumn("digest", F.sha2("payload", 256))
    book = pages.sparkSession.sparkContext.broadcast(dictionary(pages))
    large = pages.where(F.octet_length("payload") >= LEAST).select("key", "digest")
    firsts = stored(large.groupBy("digest").agg(F.min("key").alias("first"), F.count("*").alias("n")).where("n > 1 AND first IS NOT NULL"))
    # a small payload's digest can't equal a large one's, so no length is asked for here
    joined = salted_join(pages, firsts, ["digest"], F.xxhash64("key", "url"), how="left")
    refers = F.when(~F.col("key").eqNullSafe(F.col("first")), F.col("first"))
    frames = joined.select("key", "url", "payload", "digest", refers.alias("to")).mapInArrow(lambda it: _compress(it, book), "frame binary")
    frames.select(F.col("frame").cast("string").alias("value")).write.option("lineSep", _EMPTY).option("maxRecordsPerFile", 0).text(path)
    discard(firsts)
    book.destroy()


def frames_of(archive: bytes) -> Iterator[bytes]:
    """The records of an archive, decompressed one by one with the dictionary that it leads with."""
    view, at, unpacker = memoryview(archive), 0, zstandard.ZstdDecompressor()
    while at < len(view):
        magic = struct.unpack_from("<I", view, at)[0]
        if magic & 0xFFFFFFF0 == 0x184D2A50:
            size = struct.unpack_from("<I", view, at + 4)[0]
            if magic == _MAGIC:
                unpacker = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(bytes(view[at + 8 : at + 8 + size])))
            at += 8 + size
            continue
        frame, parts = unpacker.decompressobj(), []
        while not frame.eof:
            if at >= len(view):
                raise ValueError("an archive ends within a record")
            piece = view[at : at + _STEP]
            parts.append(frame.decompress(piece))
            at += len(piece)
        at -= len(frame.unused_data)
        yield b"".join(parts)


def parse(record: bytes) -> tuple[dict[str, str], bytes]:
    """Headers by lower-case name, and the payload after the HTTP head."""
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    fields = {k.lower(): v for k, v in fields.items()}
    return fields, rest[: int(fields["content-length"])].partition(b"\r\n\r\n")[2]


def _read(batches: Iterator[pa.RecordBatch], number: bool, payloads: bool) -> Iterator[pa.RecordBatch]:
    key = (lambda x: None if x is None else int(x)) if number else (lambda x: x)
    kind = pa.int64() if number else pa.string()
    types = [kind, pa.int64(), pa.string(), pa.string(), kind, pa.string(), pa.string(), pa.string()]
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id", "target_uri", "payload"]

    def rows(archive: bytes) -> Iterator[tuple]:
        for record in frames_of(archive):
            fields, payload = parse(record)
            length, digest = int(fields["x-payload-length"]), fields["warc-payload-digest"].removeprefix("sha256:")
            if fields["warc-type"] == "response":
                length, found = len(payload), hashlib.sha256(payload).hexdigest()
                if found != digest:
                    raise ValueError(f"the payload of {fields['warc-record-id']} doesn't have its digest")
            text = payload.decode() if payloads and fields["warc-type"] == "response" else None
            yield key(fields.get("x-page-key")), length, digest, fields["warc-type"], key(fields.get("x-refers-to-key")), fields["warc-record-id"], fields.get("warc-target-uri"), text

    for batch in batches:
        for archive in batch.column("content"):
            some: list[tuple] = []
            for row in rows(archive.as_py()):
                some.append(row)
                if len(some) == 1000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some, strict=True), types, strict=True)], names)
                    some = []
            if some:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some, strict=True), types, strict=True)], names)


def read(spark: SparkSession, path: str, key: str = "bigint", payloads: bool = True) -> DataFrame:
    """A row per record of the archives below path; responses are checked against their digests. key: bigint or string."""
    files = spark.read.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").load(path).select("content")
    return files.mapInArrow(lambda it: _read(it, key == "bigint", payloads), _SCHEMA.format(key, key))


def archive(pages: DataFrame, payloads: bool = False) -> DataFrame:
    """Writes pages(page_id, url, html) to a new folder in the shared place and reads the records back."""
    kind = pages.schema["page_id"].dataType.simpleString()
    integral = kind in ("bigint", "int", "smallint", "tinyint")
    key = F.col("page_id").cast("bigint" if integral else "string")
    path = shared_folder(pages.sparkSession)
    write(pages.select(key.alias("key"), "url", F.col("html").alias("payload")), path)
    return read(pages.sparkSession, path, "bigint" if integral else "string", payloads)
