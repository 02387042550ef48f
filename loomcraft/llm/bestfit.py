"""Packing token sequences into as few fixed-size windows as can be found.

Which sequences of one length go where does not matter, so the search sees only how many pieces there
are of each length: at most ``capacity`` numbers, whatever the size of the corpus. Its plan is a short list
of fillings with the number of windows that use each. The pieces find their place by their rank among
those of their length; no window's pieces are ever gathered.

The search is bin completion: the largest piece left opens a window, the undominated ways to fill the
rest of it are tried from the fullest on, each for as many windows as it lasts, and a branch ends as
soon as its waste leaves no room for a better plan than the incumbent. The first incumbent is best fit in descending order.
If that meets the lower bound, it is a best plan and nothing is left to search.

Null text is empty text: one piece, the end id. Every row is a document of its own, repeated ids or not.
An empty table gives no rows. Other columns are not looked at.
"""

from __future__ import annotations

import bisect
import zlib
from collections import Counter
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..session import written
from .tokens import encoder, in_slices

Filling = tuple[tuple[int, int], ...]  # (length, copies), longest first
Plan = list[tuple[int, Filling]]  # (windows, filling)
SEARCH_NODES = 200
FILLINGS_TRIED = 24
_STEPS = 1_000
SHARD_ROWS = 50_000


def lower_bound(counts: Mapping[int, int], capacity: int) -> int:
    total = sum(n * k for n, k in counts.items())
    return max(-(-total // capacity), sum(k for n, k in counts.items() if 2 * n > capacity))


def best_fit(counts: Mapping[int, int], capacity: int) -> Plan:
    """Best fit in descending order of length, done for all windows of equal room at once."""
    room: dict[int, list[tuple[int, Filling]]] = {}
    rooms: list[int] = []

    def put(r: int, k: int, filling: Filling) -> None:
        if r not in room:
            bisect.insort(rooms, r)
            room[r] = []
        room[r].append((k, filling))

    for n in sorted(counts, reverse=True):
        left = counts[n]
        while left:
            i = bisect.bisect_left(rooms, n)
            if i < len(rooms):
                r = rooms[i]
                k, filling = room[r].pop()
                if not room[r]:
                    del room[r], rooms[i]
            else:
                r, k, filling = capacity, left, ()
            each = r // n
            full = min(k, left // each)
            left -= full * each
            if full:
                put(r - each * n, full, (*filling, (n, each)))
            if k > full and left:
                put(r - left * n, 1, (*filling, (n, left)))
                full, left = full + 1, 0
            if k > full and filling:
                put(r, k - full, filling)
    return [x for r in rooms for x in room[r]]


def windows(plan: Plan) -> int:
    return sum(k for k, _ in plan)


def fillings(counts: Mapping[int, int], room: int, tried: int = FILLINGS_TRIED) -> list[Filling]:
    """Undominated ways to fill ``room``, the fullest first: none could take another piece, nor a longer
    one in place of one it has. Looks at ``_STEPS`` partial fillings at most, the longest pieces first."""
    lengths = sorted((n for n, k in counts.items() if k and n <= room), reverse=True)
    found: list[tuple[int, Filling]] = []
    steps = perfect = 0

    def dominated(chosen: Filling, slack: int) -> bool:
        used = dict(chosen)
        for n in lengths:
            if counts[n] > used.get(n, 0):
                if n <= slack:
                    return True
                if any(m < n <= m + slack for m in used):
                    return True
        return False

    def extend(i: int, slack: int, chosen: Filling) -> None:
        nonlocal steps, perfect
        steps += 1
        while i < len(lengths) and lengths[i] > slack:
            i += 1
        if slack == 0 or i == len(lengths):
            if slack == 0 or not dominated(chosen, slack):
                found.append((slack, chosen))
                perfect += slack == 0
            return
        n = lengths[i]
        for k in range(min(counts[n], slack // n), -1, -1):
            if steps > _STEPS or perfect >= tried:
                return
            extend(i + 1, slack - k * n, (*chosen, (n, k)) if k else chosen)

    extend(0, room, ())
    found.sort(key=lambda x: x[0])
    return [f for _, f in found[:tried]]


def _branches(left: Counter, capacity: int) -> Iterator[tuple[int, Filling]]:
    """The undominated windows around the longest piece left, each as often as its pieces last, then once."""
    longest = max(left)
    left[longest] -= 1
    found = fillings(left, capacity - longest)
    left[longest] += 1
    for filling in found:
        whole = Counter(dict(filling))
        whole[longest] += 1
        most = min(left[n] // k for n, k in whole.items())
        for times in dict.fromkeys((most, 1)):
            yield times, tuple(sorted(whole.items(), reverse=True))


def bin_completion(counts: Mapping[int, int], capacity: int, nodes: int = SEARCH_NODES) -> Plan:
    """The best plan found. ``nodes`` bounds the search, not what is packed: every plan packs every piece.

    Depth first over one table of the pieces left, which steps take from and give back to: memory is that
    of one path."""
    left = Counter({n: k for n, k in counts.items() if k})
    if any(n > capacity or n < 1 for n in left):
        raise ValueError("a piece is longer than a window, or empty")
    best = best_fit(left, capacity)
    fewest = windows(best)
    bound = lower_bound(left, capacity)
    total = sum(n * k for n, k in left.items())
    path: Plan = []
    opened = waste = seen = 0
    if fewest <= bound or not left:
        return best
    stack = [_branches(left, capacity)]
    while stack and fewest > bound and seen < nodes:
        step = next(stack[-1], None)
        if step is None:
            stack.pop()
            if path:
                times, filling = path.pop()
                for n, k in filling:
                    left[n] += times * k
                opened -= times
                waste -= times * (capacity - sum(n * k for n, k in filling))
            continue
        times, filling = step
        slack = times * (capacity - sum(n * k for n, k in filling))
        if waste + slack > (fewest - 1) * capacity - total:
            continue
        seen += 1
        path.append(step)
        opened, waste = opened + times, waste + slack
        for n, k in filling:
            left[n] -= times * k
            if not left[n]:
                del left[n]
        rest = best_fit(left, capacity)
        if opened + windows(rest) < fewest:
            best, fewest = path + rest, opened + windows(rest)
        stack.append(_branches(left, capacity) if left else iter(()))
    return best


def pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` of each text's ids with the end id, cut at ``capacity``."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer)
        for batch in batches:
            names = batch.column(0).to_pylist()
            rows = []
            for i, data in in_slices(own.encode, batch.column(1).to_pylist()):
                ids = np.append(np.frombuffer(data, own.dtype), end_id).astype("<u4")
                rows += [(names[i], p, a, min(capacity, len(ids) - a), zlib.crc32(ids[a:a + capacity].tobytes()))
                         for p, a in enumerate(range(0, len(ids), capacity))]
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            columns = [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 5, kinds)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    return rows.mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def ranked(rows: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Add ``rank``, from 0, among the rows of a length. A common length is numbered in shards of about
    ``shard_rows`` rows, each from where the shards before it end."""
    shards = max(1, -(-rows.count() // shard_rows))
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(shards)))
    earlier = Window.partitionBy("length").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy("length", "shard").agg(F.count("*").alias("size"))
    starts = sizes.select("length", "shard", F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("before"))
    inside = Window.partitionBy("length", "shard").orderBy("doc_id", "piece", "ids_crc32")
    numbered = dealt.withColumn("inside", F.row_number().over(inside) - 1).join(starts, ["length", "shard"])
    return numbered.select(*rows.columns, (F.col("before") + F.col("inside")).alias("rank"))


def place(rows: DataFrame, plan: Plan) -> DataFrame:
    """Give each ranked piece its ``sequence_id`` and ``offset``.

    The plan travels with the tasks: it has fewer entries than ``capacity`` squared over two, whatever the corpus."""
    entries = []
    used: Counter = Counter()
    first = 0
    for count, filling in plan:
        at = 0
        for n, k in filling:
            entries.append((n << 40 | used[n], n, k, first, at))
            used[n] += count * k
            at += n * k
        first += count
    table = np.array(sorted(entries), np.int64).reshape(-1, 5)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            key = length << 40 | rank
            own = table[np.searchsorted(table[:, 0], key, "right") - 1]
            window, copy = np.divmod(key - own[:, 0], own[:, 2])
            columns = [batch.column(c) for c in batch.schema.names if c != "rank"]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(own[:, 3] + window), pa.array(own[:, 4] + copy * length)],
                [*[c for c in batch.schema.names if c != "rank"], "sequence_id", "offset"])

    return rows.mapInArrow(
        find, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = 4096) -> DataFrame:
    """Pack the token ids of all texts: one row per piece with its window and place there."""
    rows = written(pieces(docs, tokenizer, end_id, capacity), "pieces")
    counts = {r.length: r.n for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect()}
    return place(ranked(rows), bin_completion(counts, capacity))
