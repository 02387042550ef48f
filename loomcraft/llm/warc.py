"""WARC archives compressed with a dictionary of their own, and back.

A file starts with a skippable frame (0x184D2A5D) that holds a Zstandard dictionary, built from the first
``SAMPLE_BYTES`` bytes of the file's own records. Every record follows as a frame of its own, compressed with that
dictionary, so that single records can be read, and a file needs nothing but itself.

Of pages with equal payloads the one with the largest id is the response, the others revisit it; payloads
shorter than ``min_bytes`` are always responses. Equality goes by SHA-256. Tasks name their files at random and Spark
commits the names of the attempts that count.

Null html is an empty payload; a null url is left out, marks in urls that would break a header are escaped. A null
id is smaller than any other; among null ids only, and among rows that share the largest id, all are responses. An empty
table gives no file and no row. Other columns are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, functions as F

from ..session import fresh_path, written
from .columns import text_of

DICTIONARY_FRAME = 0x184D2A5D
DICTIONARY_BYTES = 64 << 10
SAMPLE_BYTES = 2 << 20
FILE_BYTES = 64 << 20
DATE = "2000-01-01T00:00:00Z"
_NAMES = uuid.UUID(int=0)
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _record_id(page: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMES, f'page {page}')}>"


def _record(page: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    fields = {
        "WARC-Type": "response" if refers_to is None else "revisit", "WARC-Record-ID": _record_id(page), "WARC-Date": DATE,
        "WARC-Target-URI": re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else None,
        "WARC-Payload-Digest": f"sha1:{digest}",
        "WARC-Refers-To": _record_id(refers_to) if refers_to is not None else None,
        "WARC-Profile": _PROFILE if refers_to is not None else None,
        "X-Page-ID": page, "X-Refers-To-Page-ID": refers_to, "X-Payload-Length": len(payload),
        "Content-Type": "application/http; msgtype=response", "Content-Length": len(block),
    }
    lines = "".join(f"{k}: {v}\r\n" for k, v in fields.items() if v is not None)
    return f"WARC/1.1\r\n{lines}\r\n".encode() + block + b"\r\n\r\n"


def build_dictionary(records: list[bytes]) -> bytes:
    """A trained dictionary; of too few records to train on, the records themselves are one."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, records, d=8, k=256).as_bytes()
    except zstandard.ZstdError:
        return b"".join(records)[:DICTIONARY_BYTES]


def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary))


def read_records(file) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of each record of an open file."""
    frame = file.read(8)
    if int.from_bytes(frame[:4], "little") != DICTIONARY_FRAME:
        raise ValueError("no dictionary frame")
    dictionary = file.read(int.from_bytes(frame[4:], "little"))
    open_frames = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary))
    stream = io.BufferedReader(open_frames.stream_reader(file, read_across_frames=True), 1 << 20)
    while version := stream.readline():
        if version != b"WARC/1.1\r\n":
            raise ValueError("not a record")
        fields = {}
        while (line := stream.readline()) != b"\r\n":
            name, _, value = line.decode().rstrip("\r\n").partition(": ")
            fields[name] = value
        block = stream.read(int(fields["Content-Length"]))
        if stream.read(4) != b"\r\n\r\n":
            raise ValueError("a record is cut off")
        yield fields, block


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write archives below ``folder`` in order of page id; the manifest ``file, records``."""
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), text_of("html").alias("html"))
    rows = rows.withColumn("print", F.unhex(F.sha2("html", 256)))
    long = F.octet_length("html") >= min_bytes
    groups = rows.filter(long).groupBy("print").agg(F.max("page_id").alias("keep"), F.count("*").alias("n"))
    groups = written(groups.filter("n > 1").select("print", "keep"), "payload-groups")
    total = rows.agg(F.sum(F.octet_length("html").cast("long"))).first()[0] or 0
    files = max(1, -(-total // file_bytes))
    refers = F.when(F.col("keep").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keep")), F.col("keep"))
    dealt = rows.join(groups, "print", "left").select("page_id", "url", "html", refers.alias("refers_to"))
    dealt = dealt.repartitionByRange(files, "page_id").sortWithinPartitions("page_id", "url", F.length("html"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = f"{folder}/{uuid.uuid4().hex}.warc.zst"
        out = squeeze = None
        held: list[bytes] = []
        size = records = 0

        def begin():
            store, place = fs.FileSystem.from_uri(path)
            store.create_dir(place.rpartition("/")[0], recursive=True)
            file = store.open_output_stream(place, compression=None)
            dictionary = build_dictionary(held)
            file.write(DICTIONARY_FRAME.to_bytes(4, "little") + len(dictionary).to_bytes(4, "little") + dictionary)
            return file, _compressor(dictionary)

        for batch in batches:
            for i in range(batch.num_rows):
                page, url, html, refers_to = (batch.column(c)[i].as_py() for c in range(4))
                record = _record(page, url, html.encode(), refers_to)
                records += 1
                if out is not None:
                    out.write(squeeze.compress(record))
                    continue
                held.append(record)
                size += len(record)
                if size >= SAMPLE_BYTES:
                    out, squeeze = begin()
                    for r in held:
                        out.write(squeeze.compress(r))
                    held.clear()
        if records:
            if out is None:
                out, squeeze = begin()
                for r in held:
                    out.write(squeeze.compress(r))
            out.close()
            yield pa.RecordBatch.from_pylist([{"file": path, "records": records}], pa.schema([("file", pa.string()), ("records", pa.int64())]))

    return written(dealt.mapInArrow(write, "file string, records long"), "archives")


def read_archives(manifest: DataFrame) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` of each record. A response's payload is
    digested anew and must agree with its header."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                            ("record_type", pa.string()), ("refers_to", pa.int64())])
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows = []
                store, place = fs.FileSystem.from_uri(path)
                with store.open_input_stream(place, compression=None) as file:
                    for fields, block in read_records(file):
                        digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                        size = int(fields["X-Payload-Length"])
                        if fields["WARC-Type"] == "response":
                            payload = block.partition(b"\r\n\r\n")[2]
                            if base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest or len(payload) != size:
                                raise ValueError(f"{path}: payload and digest disagree")
                        page, refers = fields.get("X-Page-ID"), fields.get("X-Refers-To-Page-ID")
                        rows.append((page and int(page), size, digest, fields["WARC-Type"], refers and int(refers)))
                        if len(rows) == 10_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    files = max(1, manifest.count())
    return manifest.select("file").repartitionByRange(files, "file").mapInArrow(
        read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def round_trip(pages: DataFrame, min_bytes: int = 0, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write archives in the shared folder and read them back."""
    return read_archives(write_archives(pages, fresh_path(pages.sparkSession, "warc"), min_bytes, file_bytes))
