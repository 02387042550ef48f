"""How far the sources of a language are apart in their words.

Every (language, source) group has a share of each kept term, smoothed and in whole billionths; two groups' distance sums the
triangular divergence of their shares over all kept terms, and a group's own terms are those it uses more than its language does.

The terms with their counts per source are a term-major index, one row a term, cut into blocks of terms. In a block
each group goes through its own terms row by row (Gustavson): a term's postings are scattered into one dense accumulator
with a place per peer. Pairs of postings are never rows; what leaves a block is one sum per pair of groups. Terms a
group lacks have a share too, the same for all of them. So an accumulator starts with the sums over terms that one
or both lack, from the numbers of terms by share, and what a scattered posting adds is corrected by these zero baselines.

Counts are gathered by task in a table of bounded size, then by group and term, so a hot source or word is summed up before it is
shuffled. A block holds ``BLOCK_POSTINGS`` postings about, and its groups' baselines: as many numbers as the language has sources,
which is also the size of one group's result.

Null texts, languages and sources are empty ones. A term is a run of letters, A-Z lower-cased, all that isn't ASCII counted as
letters. Repeated rows and ids count as documents of their own; ids are not read. A text may be of any length: it is cut at
word borders. A language without kept terms has distances of 0 and no terms; an empty table gives no rows. Equal values
rank by their item's UTF-8 bytes. Other columns are not looked at.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from ..session import written
from .columns import text_of

UNIT = 1000  # shares are worked out three decimal digits at a time, to nine
BLOCK_POSTINGS = 200_000
HELD_TERMS = 400_000
_PIECE = 1 << 20
_SCATTERED = 1 << 19
_LETTERS = bytes(c if c >= 0x80 or chr(c).isalpha() else 0x20 for c in range(256)).lower()
_FOUND = "lang string, source string, part string, item string, value long"


def words(data: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in UTF-8, some of them at a time."""
    plain = data.translate(_LETTERS)
    start = 0
    while start < len(plain):
        end = plain.find(b" ", start + _PIECE)
        end = len(plain) if end < 0 else end
        yield plain[start:end].split()
        start = end


def term_counts(docs: DataFrame) -> DataFrame:
    """``lang, source, term, n, docs``: occurrences and documents of each term in each group."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        size = 0

        def given() -> Iterator[pa.RecordBatch]:
            for (lang, source), (found, where) in held.items():
                terms = pa.array(list(found), pa.binary()).cast(pa.string())
                columns = [pa.array([lang] * len(found), pa.string()), pa.array([source] * len(found), pa.string()), terms,
                           pa.array(list(found.values()), pa.int64()), pa.array([where[t] for t in found], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "n", "docs"])

        for batch in batches:
            for lang, source, data in zip(*(batch.column(c).to_pylist() for c in range(3))):
                found, where = held.setdefault((lang, source), (Counter(), Counter()))
                size -= len(found)
                own: set[bytes] = set()
                for some in words(data):
                    found.update(some)
                    own.update(some)
                where.update(own)
                size += len(found)
                if size > HELD_TERMS:
                    yield from given()
                    held.clear()
                    size = 0
        yield from given()

    rows = docs.select(text_of("lang").alias("lang"), text_of("source").alias("source"), text_of().cast("binary").alias("text"))
    parts = rows.mapInArrow(count, "lang string, source string, term string, n long, docs long")
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def term_index(counts: DataFrame, min_docs: int) -> DataFrame:
    """The term-major index: ``lang, term`` with ``sources`` and ``counts``, for terms in ``min_docs`` documents of the language.

    A term has one posting a source at most."""
    postings = F.collect_list(F.struct("source", "n"))
    whole = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), postings.alias("p")).filter(F.col("docs") >= min_docs)
    return whole.select("lang", "term", F.col("p.source").alias("sources"), F.col("p.n").alias("counts"))


def peers_of(docs: DataFrame, index: DataFrame) -> DataFrame:
    """One row a language: its ``sources`` in order, the ``counts`` of kept terms in each, and ``kept``, how many terms it keeps."""
    groups = docs.select(text_of("lang").alias("lang"), text_of("source").alias("source")).distinct()
    sizes = index.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("p")).groupBy(
        "lang", F.col("p.sources").alias("source")).agg(F.sum("p.counts").alias("n"))
    kept = index.groupBy("lang").agg(F.count("*").alias("kept"))
    sized = groups.join(sizes, ["lang", "source"], "left").groupBy("lang").agg(
        F.sort_array(F.collect_list(F.struct("source", F.coalesce("n", F.lit(0)).alias("n")))).alias("p"))
    return sized.join(kept, "lang", "left").select(
        "lang", F.col("p.source").alias("sources"), F.col("p.n").alias("counts"), F.coalesce("kept", F.lit(0)).alias("kept"))


def share(count: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """1 + floor(10^9 (count + 2) / whole), by long division: exact while ``whole`` is below 9 * 10^15."""
    out, rest = np.divmod(count + 2, whole)
    for _ in range(3):
        digits, rest = np.divmod(rest * UNIT, whole)
        out = out * UNIT + digits
    return out + 1


def apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


class _Block:
    """The terms of a language in one block: postings term by term, and the peers' baselines."""

    def __init__(self, table: pa.Table) -> None:
        table = table.combine_chunks()
        sources, counts = (table.column(c).chunk(0) for c in ("sources", "counts"))
        self.peers = sources[0].values
        totals = counts[0].values.to_numpy()
        self.terms = table.column("term").slice(1)
        self.size = len(self.terms)
        if not self.size:
            return
        rest, numbers = sources.slice(1), counts.slice(1)
        lengths = pc.list_value_length(rest).to_numpy()
        self.ends = np.concatenate([[0], np.cumsum(lengths)])
        self.group = pc.index_in(rest.flatten(), value_set=self.peers).to_numpy().astype(np.int64)
        n = numbers.flatten().to_numpy()
        self.term = np.repeat(np.arange(self.size), lengths)
        kept = table.column("kept")[0].as_py()
        whole = totals + 2 * kept
        self.zero = share(np.zeros(len(totals), np.int64), whole)
        self.p = share(n, whole[self.group])
        self.usual = share(np.add.reduceat(n, self.ends[:-1]), totals.sum() + 2 * kept)
        self.rows = np.argsort(self.group, kind="stable")
        self.starts = np.searchsorted(self.group[self.rows], np.arange(len(totals) + 1))
        self.held = np.diff(self.starts)
        keys, self.times = np.unique(self.group << 31 | self.p, return_counts=True)
        self.held_by, self.held_p = keys >> 31, keys & (1 << 31) - 1

    def distances(self, g: int) -> np.ndarray:
        """Group ``g``'s distance to each peer over the terms of this block."""
        own = self.rows[self.starts[g]:self.starts[g + 1]]
        zero = self.zero[g]
        # Terms both lack, terms only g has, terms only the peer has: as if no term were common.
        total = (self.size - len(own) - self.held) * apart(zero, self.zero)
        mine = slice(*np.searchsorted(self.held_by, [g, g + 1]))
        for p, k in zip(self.held_p[mine], self.times[mine]):
            total += k * apart(p, self.zero)
        np.add.at(total, self.held_by, self.times * apart(zero, self.held_p))
        # The postings of g's terms, scattered.
        terms = self.term[own]
        sizes = self.ends[terms + 1] - self.ends[terms]
        cuts = np.searchsorted(np.cumsum(sizes), np.arange(0, sizes.sum(), _SCATTERED))
        for a, b in zip(cuts, [*cuts[1:], len(own)]):
            k = sizes[a:b]
            at = np.arange(k.sum()) + np.repeat(self.ends[terms[a:b]] - np.cumsum(k) + k, k)
            p, q, h = np.repeat(self.p[own[a:b]], k), self.p[at], self.group[at]
            base = self.zero[h]
            np.add.at(total, h, apart(p, q) - apart(p, base) - apart(zero, q) + apart(zero, base))
        return total

    def leading(self, g: int, top: int) -> tuple[np.ndarray, np.ndarray]:
        """The terms group ``g`` uses more than its language, furthest first, and how far."""
        own = self.rows[self.starts[g]:self.starts[g + 1]]
        p, q = self.p[own], self.usual[self.term[own]]
        own, far = self.term[own][p > q], apart(p, q)[p > q]
        first = np.argsort(-far, kind="stable")[:top]  # terms are in order, so ties are too
        return own[first], far[first]


def _compare(block: int, lang: str, table: pa.Table, top: int) -> Iterator[pa.RecordBatch]:
    own = _Block(table)
    if not own.size and block:
        return
    n = len(own.peers)

    def rows(part: str, source: pa.Scalar, items: pa.Array, values: np.ndarray) -> pa.RecordBatch:
        same = [pa.array([x] * len(items), pa.string()) for x in (lang, source.as_py(), part)]
        return pa.RecordBatch.from_arrays([*same, items, pa.array(values, pa.int64())], ["lang", "source", "part", "item", "value"])

    for g in range(n):
        others = np.flatnonzero(np.arange(n) != g)
        far = own.distances(g) if own.size else np.zeros(n, np.int64)
        yield rows("pair", own.peers[g], own.peers.take(pa.array(others)), far[others])
        if own.size:
            terms, values = own.leading(g, top)
            yield rows("term", own.peers[g], own.terms.take(pa.array(terms)).combine_chunks(), values)


def compared(index: DataFrame, peers: DataFrame, top: int, block_postings: int = BLOCK_POSTINGS) -> DataFrame:
    """``lang, source, part, item, value`` block by block: sums for pairs, the best ``top`` terms of each group."""
    postings = index.agg(F.sum(F.size("sources"))).first()[0] or 0
    blocks = max(1, -(-postings // block_postings))
    terms = index.select(F.pmod(F.xxhash64("lang", "term"), F.lit(blocks)).cast("int").alias("block"), "lang", "term", "sources", "counts",
                         F.lit(0).cast("long").alias("kept"))
    bases = peers.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "lang", F.lit(None).cast("string").alias("term"),
                         "sources", "counts", F.col("kept").cast("long").alias("kept"))
    dealt = bases.unionByName(terms).repartition("block").sortWithinPartitions("block", "lang", "term")

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        current = None
        for batch in batches:
            keys = list(zip(batch.column("block").to_pylist(), batch.column("lang").to_pylist()))
            cuts = [i for i in range(len(keys)) if i == 0 or keys[i] != keys[i - 1]]
            for a, b in zip(cuts, [*cuts[1:], len(keys)]):
                if held and keys[a] != current:
                    yield from _compare(*current, pa.Table.from_batches(held), top)
                    held = []
                current = keys[a]
                held.append(batch.slice(a, b - a))
        if held:
            yield from _compare(*current, pa.Table.from_batches(held), top)

    return dealt.mapInArrow(scatter, _FOUND)


def audit(docs: DataFrame, min_docs: int = 10, top: int = 10, block_postings: int = BLOCK_POSTINGS) -> DataFrame:
    """``lang, source, part, item, value, rank``: for every source its distance to each other source of its language (``pair``),
    and the ``top`` terms it uses more than the language does (``term``)."""
    index = written(term_index(term_counts(docs), min_docs), "term-index")
    found = written(compared(index, peers_of(docs, index), top, block_postings), "divergences")
    group = ["lang", "source", "part"]
    ranked = Window.partitionBy(*group).orderBy(F.col("value").desc(), "item")
    pairs = found.filter("part = 'pair'").groupBy(*group, "item").agg(F.sum("value").alias("value"))
    pairs = pairs.withColumn("rank", F.row_number().over(ranked))
    terms = found.filter("part = 'term'").withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= top)
    return pairs.unionByName(terms)
