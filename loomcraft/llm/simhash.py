"""Near duplicates by SimHash fingerprints and covering locality-sensitive hashing.

Bit i of a fingerprint is given a vector m(i) of radius + 1 bits, not zero. Each of the 2^(radius+1) - 1
vectors v that aren't zero makes a table: its mask has the bits i for which m(i) and v share an odd number of
ones, its key is the fingerprint under the mask. The vectors of ``radius`` differing bits span no more than
``radius`` dimensions, so some v is orthogonal to all of them, and its mask leaves them all out: every
pair within the radius meets in some table. No link is missed.

Equal fingerprints are one from the start. A bucket is compared block by block, each pair of blocks in a task
of its own, so a hot bucket is split however large it is; what leaves a comparison is a spanning
forest of its links, never all pairs. Links are joined into components by alternating stars.

No side of a join is as small as it looks: tables of keys and links compress well and grow with the corpus. All joins
are merge joins, so that none is gathered by the driver to be sent around.

Null and empty texts have the fingerprint zero, which links like any other. Rows are told apart by nothing but their
fingerprint, so repeated and null ids do no harm; a component's id is its smallest id, null if all are null.
An empty table gives no rows. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from ..session import written
from .stores import drop_kept, give_back

BITS = 64
SEED = 42
BLOCK = 1024
_HASHES = 1 << 16
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def fingerprint(text: str | None, width: int) -> int:
    """Majority of the bits of the XXH64 of all word shingles."""
    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    n = max(1, len(words) - width + 1)
    last = ends[min(width, len(words)) - 1:].tolist()
    first = [0, *(ends[:n - 1] + 1).tolist()]
    ones = np.zeros(BITS, np.int64)
    for i in range(0, n, _HASHES):
        h = np.array([xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in zip(first[i:i + _HASHES], last[i:i + _HASHES])], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 4, doc_id: str = "doc_id", text: str = "text", **longs: Column) -> DataFrame:
    """``_doc, print``: the fingerprint as a signed long; and ``longs``, further numbers of the row, between them."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_kept()
        for batch in batches:
            prints = np.array([fingerprint(t.as_py(), width) for t in batch.column(len(names))], np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(prints.view(np.int64))], [*names, "print"])
            give_back()

    names = ["_doc", *longs]
    numbers = [c.cast("long").alias(n) for n, c in zip(names, [F.col(doc_id), *longs.values()])]
    rows = docs.select(*numbers, F.col(text).cast("string").alias("_text"))
    return rows.mapInArrow(of, ", ".join(f"{n} long" for n in [*names, "print"]))


def masks(radius: int) -> list[int]:
    """The covering masks, as signed longs."""
    last = (1 << radius + 1) - 1
    vector = [i % last + 1 for i in range(BITS)]
    found = [sum(1 << i for i in range(BITS) if (vector[i] & v).bit_count() % 2) for v in range(1, last + 1)]
    return [m - (1 << BITS) if m >> BITS - 1 else m for m in found]


def _forest(members: np.ndarray, radius: int) -> np.ndarray:
    """For each member the first one its links within the radius lead to."""
    near = np.bitwise_count(members[:, None] ^ members[None, :]) <= radius
    label = np.arange(len(members))
    while True:
        low = np.where(near, label[None, :], len(members)).min(axis=1)
        low = low[low]
        if (low == label).all():
            return label
        label = low


def links(distinct: DataFrame, radius: int, block: int = BLOCK) -> DataFrame:
    """``u, v``: edges between the distinct ``print``s that join the same components as all links do."""
    tables = F.array(*[F.struct(F.lit(t).alias("t"), F.col("print").bitwiseAND(F.lit(m)).alias("key"))
                       for t, m in enumerate(masks(radius))])
    rows = distinct.select("print", F.explode(tables).alias("_b")).select("print", "_b.t", "_b.key")
    sizes = rows.groupBy("t", "key").agg(F.count("*").alias("size")).filter("size > 1")
    met = rows.join(sizes.hint("merge"), ["t", "key"])
    blocks = F.ceil(F.col("size") / F.lit(block)).cast("int")
    own = F.pmod(F.xxhash64("print"), blocks).cast("int")
    pairs = met.withColumn("own", own).select(
        "t", "key", "print", "own", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
    group = ["t", "key", "a", "b"]
    dealt = pairs.select("t", "key", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "print")
    dealt = dealt.repartition(*group).sortWithinPartitions(*group, "print")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def edges(prints: list[np.ndarray]) -> pa.RecordBatch | None:
            members = np.concatenate(prints)
            label = _forest(members.view(np.uint64), radius)
            child = np.flatnonzero(label != np.arange(len(members)))
            if not len(child):
                return None
            return pa.RecordBatch.from_arrays([pa.array(members[child]), pa.array(members[label[child]])], ["u", "v"])

        held: list[np.ndarray] = []
        current = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in group], axis=1)
            prints = batch.column("print").to_numpy()
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(keys)]):
                if held and (keys[a] != current).any():
                    if (found := edges(held)) is not None:
                        yield found
                    held = []
                current = keys[a]
                held.append(prints[a:b])
        if held and (found := edges(held)) is not None:
            yield found

    return dealt.mapInArrow(compare, "u long, v long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``u, v``: every vertex but the smallest of a component, with that smallest one.

    Large and small stars in turn: each vertex's larger (then smaller) neighbours are tied to its least
    neighbour, until nothing changes. Minima are pre-aggregated; nothing is gathered per vertex. Each round
    is written, and the driver compares a count and a sum only."""

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())

    edges = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), "links")
    before = state(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        tied = large.join(lowest.hint("merge"), "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = written(tied.unionByName(lowest.select("u", F.col("m").alias("v"))).distinct(), "links")
        after = state(edges)
        if after == before:
            break
        before = after
    return edges


def rooted(distinct: DataFrame, radius: int, block: int) -> DataFrame:
    """``print, low, root``: the distinct prints with their component's smallest print."""
    stars = components(links(distinct.select("print"), radius, block))
    return distinct.join(stars.hint("merge"), distinct["print"] == stars["u"], "left").select(
        "print", "low", F.coalesce("v", "print").alias("root"))


def near_groups(docs: DataFrame, width: int = 4, radius: int = 4, doc_id: str = "doc_id", text: str = "text",
                block: int = BLOCK) -> DataFrame:
    """One row per document: its id, ``fingerprint`` (16 hex digits), ``component_id`` (smallest id it is linked to)."""
    rows = written(fingerprints(docs, width, doc_id, text), "fingerprints")
    distinct = written(rows.groupBy("print").agg(F.min("_doc").alias("low")), "distinct-fingerprints")
    roots = rooted(distinct, radius, block)
    lows = roots.groupBy("root").agg(F.min("low").alias("component_id"))
    members = roots.join(lows.hint("merge"), "root").select("print", "component_id")
    return rows.join(members.hint("merge"), "print").select(
        F.col("_doc").alias(doc_id), F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def one_per_group(docs: DataFrame, width: int = 4, radius: int = 4, block: int = BLOCK) -> DataFrame:
    """One document of each component: that with the smallest id, one without an id only if all are.

    Documents of one id are told apart by their fingerprints, then by a hash of their texts; of rows alike
    in all that, any one stays. Rows are numbered and written first, so that ids may repeat or be null."""
    number = "_number"
    while number.lower() in {c.lower() for c in docs.columns}:
        number += "_"
    numbered = written(docs.withColumn(number, F.monotonically_increasing_id()), "numbered-documents")
    rows = fingerprints(numbered, width, hash=F.xxhash64("text"), number=F.col(number))
    first = F.min(F.struct(F.col("_doc").isNull().alias("no_id"), "_doc", "print", "hash", "number"))
    distinct = written(rows.groupBy("print").agg(first.alias("low")), "distinct-fingerprints")
    keep = rooted(distinct, radius, block).groupBy("root").agg(F.min("low").alias("low"))
    kept = keep.select(F.col("low.number").alias("_keep")).hint("merge")
    return numbered.join(kept, F.col(number) == F.col("_keep"), "left_semi").drop(number)
