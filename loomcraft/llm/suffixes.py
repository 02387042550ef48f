"""Removing long byte strings that a document with a smaller id holds.

Suffixes are sorted by merging sorted runs. A run is front-coded: of each suffix only what follows the prefix it shares with
the one before it. Runs are combined by a loser tree whose entries remember how long a prefix they share with the last suffix given
out. Of two entries the one that shares more comes first; only if they share as much are bytes compared, from there on. So no
prefix is ever compared again, and equal suffixes come out side by side with their common prefixes known.

Every string of ``length`` bytes holds ``width`` grams of ``length - width + 1`` bytes; the one with the least hash is its anchor, wherever the
string stands. Consecutive strings of one anchor make an *item*: the suffix that begins at the anchor and ends with the last of them,
and what stands before the anchor, read backwards. Items are what is sorted, and first of all only those whose anchor occurs
twice in the corpus: hashes of anchors are counted first, which can let through more than is needed and loses nothing. Equal items are
found by the merge; items of one anchor that differ are side by side too, and their strings are looked up one by one. An anchor
with over ``HOT`` occurrences is sorted string by string instead, dealt out by the strings, so that no task holds a hot anchor's items.

The documents are written once in slices of bounded size, bucketed by slice, so that asking which anchors occur twice, sending runs and
taking the answers read the same slice without shuffling texts. A slice sends a string once with its smallest id, and is told
whether a smaller one was seen elsewhere.

Bytes are those of the text in UTF-8; null is empty. Strings never cross documents. Rows of equal ids don't remove one another's bytes;
a row without an id counts after all others. An empty table gives no rows. Other columns are not looked at.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from operator import ne

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ..session import shared_folder, written

LENGTH = 50
SLICE_BYTES = 8 << 20
HASHES = 1_000_000  # per task that counts anchors
ITEMS = 50_000  # per task that merges runs
HOT = 8_000
_WIDEST = 31
_CHUNK = (1 << 20) - 128  # positions scanned at a time; they are told apart by 20 bits
_LAST = np.iinfo(np.int64).max
_END = b"\xff"  # no byte of UTF-8


def width_of(length: int) -> int:
    """Grams per string: the more, the fewer anchors; the fewer, the longer and rarer the grams."""
    return max(1, min(_WIDEST, length * 3 // 5 + 1))


# Scanning a slice


def _gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """A hash of every ``size`` bytes: of a power of two from two halves, of ``size`` from its powers of two."""
    part = (data.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    factor, n, whole, done = np.uint64(0x100000001B3), 1, None, 0
    while True:
        if size & n:
            whole = part[:len(data) - size + 1].copy() if whole is None else whole * factor + part[done:done + len(whole)]
            done += n
        if done == size:
            break
        part = part[:-n] * factor + part[n:]
        factor, n = factor * factor, 2 * n
    whole ^= whole >> np.uint64(32)
    whole *= np.uint64(0x9E3779B97F4A7C15)
    whole ^= whole >> np.uint64(29)
    return whole


def _least(keys: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` keys."""
    n = 1
    while 2 * n <= width:
        keys = np.minimum(keys[:-n], keys[n:])
        n *= 2
    return np.minimum(keys[:len(keys) - (width - n)], keys[width - n:]) if width > n else keys


class Slice:
    """The documents of a slice end to end, with their items: first string, number of strings, anchor and its hash."""

    def __init__(self, texts: pa.Array, length: int, scanned: bool = True) -> None:
        self.length, self.width = length, width_of(length)
        sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy().astype(np.int64)
        self.ends = np.cumsum(sizes)
        self.begins = self.ends - sizes
        self.data = b"".join(t for t in texts.to_pylist() if t)
        self.bytes = np.frombuffer(self.data, np.uint8)
        if not scanned:
            return
        fits = np.ones(len(self.bytes), bool)
        for a, b in zip(np.maximum(self.begins, self.ends - length + 1).tolist(), self.ends.tolist()):
            fits[a:b] = False
        found = [self._scan(at, fits) for at in range(0, max(0, len(self.bytes) - length + 1), _CHUNK)]
        self.first, self.count, self.anchor, self.hash = (
            np.concatenate([f[i] for f in found]) if found else np.zeros(0, kind) for i, kind in enumerate((np.int64,) * 3 + (np.uint64,)))

    def _scan(self, at: int, fits: np.ndarray) -> tuple[np.ndarray, ...]:
        piece = self.bytes[at:at + _CHUNK + self.length - 1]
        hashes = _gram_hashes(piece, self.length - self.width + 1)
        keys = hashes >> np.uint64(20) << np.uint64(20) | np.arange(len(hashes), dtype=np.uint64)
        anchor = (_least(keys, self.width) & np.uint64((1 << 20) - 1)).astype(np.int64)
        fit = fits[at:at + len(anchor)]
        new = fit.copy()
        new[1:] &= (anchor[1:] != anchor[:-1]) | ~fit[:-1]
        cut = np.flatnonzero(new | ~fit)
        after = np.append(cut[1:], len(anchor))
        own = new[cut]
        first = cut[own]
        found = hashes[anchor[first]] * np.uint64(0xD1342543DE82EF95)  # least hashes lie close together; these are dealt out by their first bits
        return first + at, after[own] - first, anchor[first] + at, found ^ found >> np.uint64(32)

    def documents(self, first: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ends, first, "right")


def _part(hashes: np.ndarray, parts: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int32)


def _planes(numbers: np.ndarray) -> bytes:
    """Numbers by byte, all first bytes first: those of sorted numbers compress well."""
    return np.ascontiguousarray(numbers.view(np.uint8).reshape(len(numbers), -1).T).tobytes()


def _from_planes(data: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(kind).ravel()


# Items, sorted and front-coded


class Items:
    """The items of a slice whose anchors occur twice: distinct keys by part and in order, and which each occurrence has
    (``later``: a smaller id of the slice has it too).

    A key is the suffix from the anchor, a byte no text holds, and the bytes before the anchor backwards."""

    def __init__(self, own: Slice, ids: np.ndarray, shared: np.ndarray, hot: np.ndarray, parts: int) -> None:
        at = np.searchsorted(shared, own.hash)
        at[at == len(shared)] = 0
        kept = np.flatnonzero(shared[at] == own.hash) if len(shared) else np.zeros(0, np.int64)
        first, count, anchor, hot = own.first[kept], own.count[kept], own.anchor[kept], hot[at[kept]]
        part = _part(own.hash[kept], parts)
        if hot.any():  # one item a string
            times = np.where(hot, count, 1)
            steps = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            first, anchor, part, hot = (np.repeat(x, times) for x in (first, anchor, part, hot))
            first, count = first + steps, np.where(hot, 1, np.repeat(count, times))
        data, back, end = own.data, own.data[::-1], len(own.data)
        last = first + count + own.length - 1
        keys = [data[a:z] + _END + back[end - a:end - f] for f, a, z in zip(first.tolist(), anchor.tolist(), last.tolist())]
        for i in np.flatnonzero(hot).tolist():
            part[i] = zlib.crc32(data[first[i]:last[i]]) * parts >> 32
        doc = ids[own.documents(first)]
        dealt = np.argsort(part, kind="stable")
        cuts = np.flatnonzero(np.diff(part[dealt], prepend=-1)).tolist()
        order: list[int] = []
        for a, b in zip(cuts, [*cuts[1:], len(dealt)]):
            order += sorted(dealt[a:b].tolist(), key=keys.__getitem__)
        keys = [keys[i] for i in order]
        new = np.array([True, *map(ne, keys[1:], keys)][:len(keys)], bool)  # equal keys are of one part
        begun = np.flatnonzero(new)
        self.keys = [keys[i] for i in begun.tolist()]
        sorted_doc = doc[order]
        self.parts = part[order][begun].astype(np.int32)
        self.least = np.minimum.reduceat(sorted_doc, begun) if len(begun) else np.zeros(0, np.int64)
        self.first, self.count, self.anchor = first, count, anchor
        self.place = np.zeros(len(order), np.int64)
        self.place[order] = np.cumsum(new) - 1
        self.later = doc > self.least[self.place]

    def runs(self) -> Iterator[tuple[int, int, bytes, bytes, bytes, bytes]]:
        """Per part: how many keys, their lengths, common prefixes with the key before, what follows, smallest ids."""
        cuts = np.flatnonzero(np.diff(self.parts)) + 1
        for a, b in zip([0, *cuts], [*cuts, len(self.keys)]):
            if a < b:
                keys = self.keys[a:b]
                same = common_prefixes(keys)
                tails = b"".join([key[s:] for key, s in zip(keys, same.tolist())])
                sizes = np.array([len(key) for key in keys], "<u2")
                yield int(self.parts[a]), b - a, _planes(sizes), _planes(same), tails, _planes(self.least[a:b].astype("<i8"))

    def places(self) -> tuple[bytes, bytes]:
        """Of each occurrence its key and first string; its number of strings, how far before the anchor the first begins, ``later``."""
        told = np.stack([self.count, self.anchor - self.first, self.later]).astype(np.uint8)
        return _planes(self.place.astype("<u4")) + _planes(self.first.astype("<u4")), told.tobytes()


def from_places(data: bytes, more: bytes) -> tuple[np.ndarray, ...]:
    half = len(data) // 2
    return _from_planes(data[:half], "<u4"), _from_planes(data[half:], "<u4").astype(np.int64), *np.frombuffer(more, np.uint8).reshape(3, -1)


def common_prefixes(keys: list[bytes]) -> np.ndarray:
    """How many bytes each key shares with the one before it."""
    sizes = np.array([len(key) for key in keys], np.int64)
    widest = int(sizes.max())
    padded = np.frombuffer(b"".join([key.ljust(widest, _END) for key in keys]), np.uint8).reshape(len(keys), widest)
    same = np.zeros(len(keys), np.int64)
    for a in range(1, len(keys), 1 << 16):
        b = min(len(keys), a + (1 << 16))
        differ = padded[a:b] != padded[a - 1:b - 1]
        same[a:b] = np.where(differ.any(axis=1), differ.argmax(axis=1), widest)
    same[1:] = np.minimum(same[1:], np.minimum(sizes[1:], sizes[:-1]))
    return same.astype("<u2")


def decoded(sizes: bytes, same: bytes, tails: bytes) -> Iterator[tuple[bytes, int]]:
    """The keys of a run with what each shares with the one before it."""
    key, at = b"", 0
    for size, shared in zip(_from_planes(sizes, "<u2").tolist(), _from_planes(same, "<u2").tolist()):
        key = key[:shared] + tails[at:at + size - shared]
        at += size - shared
        yield key, shared


def _agree(x: bytes, y: bytes, known: int) -> int:
    """How many bytes two keys share, the first ``known`` of them not looked at."""
    if x == y:
        return len(x)
    while x[known:known + 16] == y[known:known + 16]:
        known += 16
    while x[known:known + 1] == y[known:known + 1]:
        known += 1
    return known


def merged(runs: list[Iterator[tuple[bytes, int]]]) -> Iterator[tuple[bytes, int, int]]:
    """The keys of sorted runs in order: key, bytes shared with the key before it, run."""
    leaves = 1
    while leaves < len(runs):
        leaves *= 2
    keys: list[bytes] = [b""] * leaves
    known = [-1] * leaves  # bytes shared with the last key given out; -1 at a run's end
    for r, run in enumerate(runs):
        keys[r], known[r] = next(run, (b"", -1))
    loser = [0] * leaves

    def winner(at: int) -> int:
        if at >= leaves:
            return at - leaves
        x, y = winner(2 * at), winner(2 * at + 1)
        if known[x] == known[y] >= 0:
            n = _agree(keys[x], keys[y], known[x])
            if keys[x][n:n + 1] > keys[y][n:n + 1]:
                x, y = y, x
            known[y] = n
        elif known[x] < known[y]:
            x, y = y, x
        loser[at] = y
        return x

    best = winner(1)
    while known[best] >= 0:
        yield keys[best], known[best], best
        keys[best], known[best] = next(runs[best], (b"", -1))
        at = best + leaves >> 1
        while at:
            y = loser[at]
            if known[best] < known[y]:
                loser[at], best = best, y
            elif known[best] == known[y] >= 0:
                n = _agree(keys[best], keys[y], known[y])
                if keys[best][n:n + 1] > keys[y][n:n + 1]:
                    loser[at], best = best, y
                known[loser[at]] = n
            at >>= 1


def _earlier(entries: list[tuple[bytes, list[tuple[int, int, int]]]], length: int, marks: list[np.ndarray]) -> None:
    """Mark the strings of one anchor's items that a smaller id holds: bit i for the string that begins i bytes before the anchor."""
    if len(entries) == 1:
        if len(entries[0][1]) == 1:
            return
        least = min(doc for _, _, doc in entries[0][1])
        for run, i, doc in entries[0][1]:
            marks[run][i] = -(doc > least)
        return
    least: dict[bytes, int] = {}
    strings = []
    for key, found in entries:
        ahead, back = key.split(_END)
        low = min(doc for _, _, doc in found)
        own = []
        for i in range(max(0, length - len(ahead)), len(back) + 1):
            string = back[:i][::-1] + ahead[:length - i]
            own.append((1 << i, string))
            if low < least.get(string, _LAST + 1):
                least[string] = low
        strings.append(own)
    for (_, found), own in zip(entries, strings):
        for run, i, doc in found:
            marks[run][i] = sum(bit for bit, string in own if least[string] < doc)


def merge_part(runs: list[tuple[bytes, bytes, bytes, bytes]], length: int) -> list[np.ndarray]:
    """For each key of each run the strings that a smaller id than the run's own holds, as bits."""
    gram = length - width_of(length) + 1
    docs = [_from_planes(r[3], "<i8").tolist() for r in runs]
    marks = [np.zeros(len(d), np.int64) for d in docs]
    at = [0] * len(runs)
    entries: list[tuple[bytes, list[tuple[int, int, int]]]] = []
    for key, known, run in merged([decoded(*r[:3]) for r in runs]):
        if known < gram and entries:
            _earlier(entries, length, marks)
            entries = []
        if not entries or known < len(key):
            entries.append((key, []))
        entries[-1][1].append((run, at[run], docs[run][at[run]]))
        at[run] += 1
    if entries:
        _earlier(entries, length, marks)
    return marks


# The job


def _sliced(docs: DataFrame, doc_id: str, text: str, slice_bytes: int) -> DataFrame:
    """``slice, doc, text`` as a table bucketed by slice. Which rows make a slice is settled by what is written."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, filled = TaskContext.get().partitionId() << 40, 0
        for batch in batches:
            ends = filled + np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy().astype(np.int64) + 64)
            filled = int(ends[-1]) if len(ends) else filled
            yield pa.RecordBatch.from_arrays([pa.array(base + ends // slice_bytes), *batch.columns], ["slice", "doc", "text"])

    spark = docs.sparkSession
    database = f"suffix_slices_{uuid.uuid4().hex}"
    spark.sql(f"CREATE DATABASE {database} LOCATION '{shared_folder(spark)}/{database}'")
    rows = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(None)).alias("doc"), F.col(text).cast("string").cast("binary").alias("text"))
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows.mapInArrow(deal, "slice long, doc long, text binary").write.bucketBy(buckets, "slice").saveAsTable(f"{database}.slices")
    return spark.table(f"{database}.slices")


def _ids(table: pa.Table) -> np.ndarray:
    return pc.fill_null(table.column("doc"), int(_LAST)).to_numpy()


def _texts(table: pa.Table) -> pa.Array:
    texts = table.column("text").combine_chunks()
    return pa.concat_arrays(texts.chunks) if isinstance(texts, pa.ChunkedArray) else texts


def shared_anchors(slices: DataFrame, length: int, hashes: int, hot: int) -> DataFrame:
    """``slice, part`` (-1), ``n``, ``data, more``: hashes of a slice's anchors that occur twice at least, n times in all, and if often."""
    size = slices.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-2 * size // ((width_of(length) + 1) * hashes)))

    def ask(table: pa.Table) -> pa.Table:
        own, times = np.unique(Slice(_texts(table), length).hash, return_counts=True)
        cuts = np.searchsorted(_part(own, parts), np.arange(parts + 1))
        rows = [{"part": p, "slice": table.column("slice")[0].as_py(), "data": _planes(own[a:b]), "more": _planes(times[a:b].astype("<u4"))}
                for p, (a, b) in enumerate(zip(cuts, cuts[1:])) if a < b]
        return pa.Table.from_pylist(rows, pa.schema([("part", pa.int32()), ("slice", pa.int64()), ("data", pa.binary()), ("more", pa.binary())]))

    def answer(table: pa.Table) -> pa.Table:
        own = [_from_planes(d, "<u8") for d in table.column("data").to_pylist()]
        times = [_from_planes(d, "<u4") for d in table.column("more").to_pylist()]
        distinct, place = np.unique(np.concatenate(own), return_inverse=True)
        total = np.bincount(place, np.concatenate(times), len(distinct))
        rows, at = [], 0
        for s, h, k in zip(table.column("slice").to_pylist(), own, times):
            found = total[place[at:at + len(h)]]
            at += len(h)
            if (found > 1).any():
                rows.append({"slice": s, "part": -1, "n": int(k[found > 1].sum()), "data": _planes(h[found > 1]),
                             "more": (found[found > 1] > hot).tobytes()})
        return pa.Table.from_pylist(rows, _ANSWER)

    asked = slices.groupBy("slice").applyInArrow(ask, "part int, slice long, data binary, more binary")
    return written(asked.groupBy("part").applyInArrow(answer, _ANSWER_SQL), "shared-anchors")


_ANSWER_SQL = "slice long, part int, n long, data binary, more binary"
_ANSWER = pa.schema([("slice", pa.int64()), ("part", pa.int32()), ("n", pa.int64()), ("data", pa.binary()), ("more", pa.binary())])


def _items(table: pa.Table, answers: pa.Table, length: int, parts: int) -> Items:
    shared = np.concatenate([np.zeros(0, np.uint64), *[_from_planes(d, "<u8") for d in answers.column("data").to_pylist()]])
    hot = np.concatenate([np.zeros(0, bool), *[np.frombuffer(d, bool) for d in answers.column("more").to_pylist()]])
    order = np.argsort(shared)
    return Items(Slice(_texts(table), length), _ids(table), shared[order], hot[order], parts)


def earlier_strings(slices: DataFrame, shared: DataFrame, length: int, parts: int) -> DataFrame:
    """``slice, part, n, data, more``: by part, for a slice's items in order, the strings a smaller id holds elsewhere; and under
    a part below 0 where in the slice they occur, so that whoever takes the answers needn't find the items again."""

    def send(table: pa.Table, answers: pa.Table) -> pa.Table:
        names = ["part", "n", "sizes", "same", "tails", "docs"]
        rows = []
        if len(answers):
            own, found = table.column("slice")[0].as_py(), _items(table, answers, length, parts)
            data, more = found.places()
            rows = [{"slice": own, "part": -1 - (zlib.crc32(own.to_bytes(8, "little")) * parts >> 32), "n": len(found.place), "tails": data, "docs": more}]
            rows += [dict(zip(names, run), slice=own) for run in found.runs()]
        return pa.Table.from_pylist(rows, pa.schema([("slice", pa.int64()), ("part", pa.int32()), ("n", pa.int64()), *[(c, pa.binary()) for c in names[2:]]]))

    def combine(table: pa.Table) -> pa.Table:
        slices, part = table.column("slice").to_pylist(), table.column("part")[0].as_py()
        if part < 0:
            return table.select(["slice", "part", "n", "tails", "docs"]).rename_columns(_ANSWER.names)
        runs = list(zip(*(table.column(c).to_pylist() for c in ("sizes", "same", "tails", "docs"))))
        rows = [{"slice": s, "part": part, "n": len(m), "data": _planes(m.astype("<i8")), "more": b""}
                for s, m in zip(slices, merge_part(runs, length))]
        return pa.Table.from_pylist(rows, _ANSWER)

    sent = slices.groupBy("slice").cogroup(shared.groupBy("slice")).applyInArrow(
        send, "slice long, part int, n long, sizes binary, same binary, tails binary, docs binary")
    return written(sent.groupBy("part").applyInArrow(combine, _ANSWER_SQL), "earlier-strings")


def drop_repeats(docs: DataFrame, length: int = LENGTH, doc_id: str = "doc_id", text: str = "text", slice_bytes: int = SLICE_BYTES,
                 hashes: int = HASHES, items: int = ITEMS, hot: int = HOT) -> DataFrame:
    """One row per document: its id, ``kept`` (the bytes that stay), ``n_bytes, n_removed, n_spans``.

    A byte goes if a string of ``length`` bytes around it also stands in a document with a smaller id."""
    slices = _sliced(docs, doc_id, text, slice_bytes)
    shared = shared_anchors(slices, length, hashes, hot)
    parts = max(1, -(-(shared.agg(F.sum("n")).first()[0] or 0) // items))
    answers = earlier_strings(slices, shared, length, parts)

    def cut(table: pa.Table, told: pa.Table) -> pa.Table:
        whole = Slice(_texts(table), length, scanned=False)
        gone = np.zeros(len(whole.bytes), bool)
        if len(told):
            told = told.sort_by("part")
            data, more = (told.column(c).to_pylist() for c in ("data", "more"))
            place, first, count, back, later = from_places(data[0], more[0])
            marks = np.concatenate([_from_planes(d, "<i8") for d in data[1:]])
            bits = np.where(later, -1, marks[place])
            for i in range(whole.width):
                own = (i <= back) & (back < count + i) & (bits >> i & 1 == 1)
                gone[first[own] + back[own] - i] = True
        reach = np.cumsum(gone, dtype=np.int32)
        reach[length:] -= reach[:-length].copy()
        gone = reach > 0
        removed = np.concatenate([[0], np.cumsum(gone, dtype=np.int32)])
        begun = gone.copy()
        begun[1:] &= ~gone[:-1]
        held = whole.begins[whole.begins < whole.ends]
        begun[held] = gone[held]
        spans = np.concatenate([[0], np.cumsum(begun, dtype=np.int32)])
        begins, ends = whole.begins, whole.ends
        cuts = np.append(begins - removed[begins], ends[-1:] - removed[ends[-1:]]).astype(np.int32)
        kept = pa.Array.from_buffers(pa.binary(), len(begins), [None, pa.py_buffer(cuts.tobytes()), pa.py_buffer(whole.bytes[~gone].tobytes())])
        numbers = [ends - begins, *((c[ends] - c[begins]).astype(np.int64) for c in (removed, spans))]
        return pa.Table.from_arrays([table.column("doc").combine_chunks(), kept, *map(pa.array, numbers)], [doc_id, "kept", "n_bytes", "n_removed", "n_spans"])

    return slices.groupBy("slice").cogroup(answers.groupBy("slice")).applyInArrow(
        cut, f"{doc_id} long, kept binary, n_bytes long, n_removed long, n_spans long")
