"""Token ids of a corpus in binary files, and back.

An id is written as its rank by frequency in the corpus, in as few whole bytes as the rank needs, so
the common ids take one byte. How many bytes each takes stands apart, two bits an id, four ids to a
control byte. Decoding looks the control bytes up in a table of 256 by 4 lengths, sums those to
places, and looks ranks up in the table of ids: numpy array steps, no loop over ids.

A file is: ``MAGIC``, the number of ranks (u4), the id of each rank (u4), then blocks. A block is four
u4 (documents, ids, data bytes, 0), document ids (i8), their null flags (u1), their lengths (u8),
control bytes, data bytes. Numbers are little-endian. Blocks are at most ``BLOCK_IDS`` ids (one longer document
is one block), so neither side holds more than a block.

A task names its file at random and hands the name on; Spark commits the names of the attempts that
count, in the manifest. Files of lost or repeated attempts are in no manifest and are never read.

Null text is empty text (only the end id). Null order values come first; equal ones stand together,
ordered by their ids; every row is a document of its own. An empty table gives no file and no row.
Other columns are not looked at.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from ..session import fresh_path, written
from .stores import drop_kept, give_back
from .tokens import encoder, in_slices

MAGIC = b"LOOMIDS1"
BLOCK_IDS = 1 << 20
FILE_IDS = 16 << 20
COUNTED_AT_ONCE = 256
_BYTES_OF = np.array([[(c >> 2 * k & 3) + 1 for k in range(4)] for c in range(256)], np.int64)
_HEAD = "<4I"


def pack_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of ranks below 2**32."""
    ranks = ranks.astype("<u4")
    n = len(ranks)
    extra = (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    lanes = np.zeros((n + 3) // 4 * 4, np.uint8)
    lanes[:n] = extra
    control = lanes.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)
    used = np.arange(4) <= extra[:, None]
    return np.bitwise_or.reduce(control, axis=1).astype(np.uint8).tobytes(), ranks.view(np.uint8).reshape(n, 4)[used].tobytes()


def unpack_ranks(control: bytes, data: bytes, n: int) -> np.ndarray:
    size = _BYTES_OF[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    ends = np.cumsum(size)
    if n and ends[-1] != len(data):
        raise ValueError("data bytes and control bytes disagree")
    raw = np.frombuffer(data + b"\0\0\0", np.uint8).astype(np.uint32)
    at = ends - size
    out = raw[at] if n else np.zeros(0, np.uint32)
    for k in (1, 2, 3):
        more = size > k
        if more.any():
            out[more] |= raw[at[more] + k] << np.uint32(8 * k)
    return out


def _block(docs: list[int | None], lengths: list[int], ids: np.ndarray, rank_of: np.ndarray) -> bytes:
    control, data = pack_ranks(rank_of[ids])
    return b"".join([
        struct.pack(_HEAD, len(docs), len(ids), len(data), 0),
        np.array([d or 0 for d in docs], "<i8").tobytes(),
        np.array([d is None for d in docs], np.uint8).tobytes(),
        np.array(lengths, "<u8").tobytes(), control, data,
    ])


def read_blocks(file) -> Iterator[tuple[list[int | None], np.ndarray, np.ndarray]]:
    """``(document ids, lengths, ids)`` of each block of an open file."""
    if file.read(len(MAGIC)) != MAGIC:
        raise ValueError("not a file of token ids")
    id_of = np.frombuffer(file.read(4 * int.from_bytes(file.read(4), "little")), "<u4")
    while head := file.read(struct.calcsize(_HEAD)):
        n_docs, n_ids, n_data, _ = struct.unpack(_HEAD, head)
        docs = np.frombuffer(file.read(8 * n_docs), "<i8")
        null = np.frombuffer(file.read(n_docs), np.uint8)
        lengths = np.frombuffer(file.read(8 * n_docs), "<u8").astype(np.int64)
        control = file.read((n_ids + 3) // 4)
        ids = id_of[unpack_ranks(control, file.read(n_data), n_ids)]
        yield [None if x else d for d, x in zip(docs.tolist(), null)], lengths, ids


def token_ids(docs: DataFrame, tokenizer: str, end_id: int, order: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, ids``: the ids of each text with the end id, as the bytes of an array of ``Encoder.dtype``."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer)
        end = np.array([end_id], own.dtype).tobytes()
        for batch in batches:
            texts = batch.column(1).to_pylist()
            ids = [x + end for _, x in in_slices(own.encode, texts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    rows = docs.select(F.col(order).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(encode, "doc_id long, ids binary")


def counted(total: np.ndarray, ids: pa.Array, dtype: str) -> np.ndarray:
    """``total``, occurrences by id, with those of some documents. A count is as long as the vocabulary, so documents are counted
    ``COUNTED_AT_ONCE`` at a time."""
    for at in range(0, len(ids), COUNTED_AT_ONCE):
        n = np.bincount(np.frombuffer(b"".join(ids.slice(at, COUNTED_AT_ONCE).to_pylist()), dtype))
        if len(n) > len(total):
            total, n = n.astype(np.int64), total
        total[:len(n)] += n
    return total


def frequency_ranks(ids: DataFrame, dtype: str) -> np.ndarray:
    """Ids from the most frequent to the rarest, ties by id. Collects one row per id in use: the
    vocabulary bounds it, whatever the size of the corpus."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_kept()
        total = np.zeros(0, np.int64)
        for batch in batches:
            total = counted(total, batch.column(0), dtype)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(total[found], pa.int64())], ["id", "n"])

    counts = ids.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    rows = sorted(counts.collect(), key=lambda r: (-r.n, r.id))
    return np.array([r.id for r in rows], "<u4")


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int, folder: str, order: str = "doc_id",
                      text: str = "text", file_ids: int = FILE_IDS) -> DataFrame:
    """Write the corpus below ``folder`` in ascending ``order``; the manifest ``part, file, docs, ids``.

    Texts are encoded once: their ids are written, counted, and then dealt by ``order`` to files of
    about ``file_ids`` ids."""
    dtype = encoder(tokenizer).dtype
    width = np.dtype(dtype).itemsize
    ids = written(token_ids(docs, tokenizer, end_id, order, text), "token-ids")
    id_of = frequency_ranks(ids, dtype)
    rank_of = np.zeros(int(id_of.max(initial=0)) + 1, "<u4")
    rank_of[id_of] = np.arange(len(id_of), dtype="<u4")
    total = ids.agg(F.sum(F.length("ids"))).first()[0] or 0
    files = max(1, -(-total // (width * file_ids)))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, path, n_docs, n_ids = None, f"{folder}/{uuid.uuid4().hex}.ids", 0, 0
        names: list[int | None] = []
        held: list[np.ndarray] = []
        size = 0

        def flush() -> None:
            nonlocal size
            if names:
                out.write(_block(names, [len(x) for x in held], np.concatenate(held), rank_of))
                names.clear()
                held.clear()
                size = 0
                give_back()

        drop_kept()
        for batch in batches:
            for doc, x in zip(batch.column(0).to_pylist(), batch.column(1)):
                if out is None:
                    store, place = fs.FileSystem.from_uri(path)
                    store.create_dir(place.rpartition("/")[0], recursive=True)
                    out = store.open_output_stream(place, compression=None)
                    out.write(MAGIC + len(id_of).to_bytes(4, "little") + id_of.tobytes())
                own = np.frombuffer(x.as_buffer(), dtype)
                if size + len(own) > BLOCK_IDS:
                    flush()
                names.append(doc)
                held.append(own)
                size += len(own)
                n_docs += 1
                n_ids += len(own)
        if out is not None:
            flush()
            out.close()
            yield pa.RecordBatch.from_pylist(
                [{"part": TaskContext.get().partitionId(), "file": path, "docs": n_docs, "ids": n_ids}],
                pa.schema([("part", pa.int32()), ("file", pa.string()), ("docs", pa.int64()), ("ids", pa.int64())]))

    dealt = ids.repartitionByRange(files, "doc_id").sortWithinPartitions(F.asc_nulls_first("doc_id"), "ids")
    return written(dealt.mapInArrow(write, "part int, file string, docs long, ids long"), "token-files")


def read_token_files(manifest: DataFrame) -> DataFrame:
    """Per document of the files: ``doc_id, start, n_tokens, ids_crc32``; ``start`` counts all ids before it."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                store, place = fs.FileSystem.from_uri(row["file"])
                start = row["start"]
                with store.open_input_stream(place, compression=None) as file:
                    for docs, lengths, ids in read_blocks(file):
                        ends = np.cumsum(lengths)
                        crcs = [zlib.crc32(ids[a:b]) for a, b in zip(ends - lengths, ends)]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(docs, pa.int64()), pa.array(start + ends - lengths), pa.array(lengths), pa.array(crcs, pa.int64())],
                            ["doc_id", "start", "n_tokens", "ids_crc32"])
                        start += int(ends[-1])
                give_back()

    # One row per file, each of millions of ids: their running total is a small window.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = manifest.select("part", "file", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("start"))
    files = max(1, manifest.count())
    return starts.repartitionByRange(files, "part").mapInArrow(
        read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, tokenizer: str, end_id: int, file_ids: int = FILE_IDS) -> DataFrame:
    """Write token files in the shared folder and read them back."""
    folder = fresh_path(docs.sparkSession, "token-binary")
    return read_token_files(write_token_files(docs, tokenizer, end_id, folder, file_ids=file_ids))
