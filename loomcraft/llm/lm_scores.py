"""Stupid-backoff language-model scores from counts of the corpus itself.

Words are the ids of a tokenizer, so a table of single words never has more rows than the vocabulary, whatever
the corpus, and every task can have it. Pairs are counted per task and then by hash partition of the pair. Of N pairs
at most ``COMMON`` can make up N / ``COMMON`` or more each: these are sent to all tasks too, which
score them in place, and no pair that is left can gather many rows. The others are exploded, one row
per document and pair, joined to the table of counts by the pair, and summed per document.

A document is scored by the counts of all others (its own are taken off): a word after another is worth
c(pair) / c(first), or, if no other document has the pair, ``ALPHA`` * c(word) / N; a word no other document
has counts as once in N + 1. The first word is scored alone.

Null and empty texts have no words and no mean. Every row comes back, rows with the same id and the same text with the same score;
null ids are ids like any other. An empty table gives no rows. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import written
from .columns import join_same
from .stores import drop_kept, give_back
from .tokens import encoder, in_slices

ALPHA = 0.4
COMMON = 500_000
_BASE = 1 << 32


def _pairs(ids: np.ndarray) -> np.ndarray:
    return ids[:-1].astype(np.int64) * _BASE + ids[1:]


def _ids(docs: DataFrame, tokenizer: str) -> DataFrame:
    """``doc_id, print, ids``: the ids of each text as little-endian bytes."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer)
        for batch in batches:
            texts = batch.column(2).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([x for _, x in in_slices(own.encode, texts)], pa.binary())], ["doc_id", "print", "ids"])

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("print"), text.alias("_text"))
    return rows.mapInArrow(encode, "doc_id long, print long, ids binary")


def count_table(ids: DataFrame, dtype: str) -> DataFrame:
    """``pair, n``: pairs of ids, and single ids as ``-1 - id``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_kept()
        for batch in batches:
            held: list[np.ndarray] = []
            size = 0
            for i, x in enumerate(batch.column(0)):
                own = np.frombuffer(x.as_buffer(), dtype)
                held += [_pairs(own), -1 - own.astype(np.int64)]
                size += 2 * len(own)
                if size > 2_000_000 or i + 1 == batch.num_rows:
                    key, n = np.unique(np.concatenate(held), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n.astype(np.int64))], ["pair", "n"])
                    held, size = [], 0
                    give_back()

    return ids.select("ids").mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def score(docs: DataFrame, tokenizer: str, alpha: float = ALPHA, common: int = COMMON) -> DataFrame:
    """``doc_id, n_tokens, log_score, mean_log_score`` of each document."""
    dtype = encoder(tokenizer).dtype
    ids = written(_ids(docs, tokenizer), "lm-ids")
    table = written(count_table(ids, dtype), "lm-counts")
    # Bounded by the vocabulary, and by the number of common pairs.
    single = table.filter("pair < 0").collect()
    total = sum(r.n for r in single)
    words = np.zeros(max((-r.pair for r in single), default=1), np.int64)
    for r in single:
        words[-1 - r.pair] = r.n
    floor = -(-total // common)
    often = table.filter((F.col("pair") >= 0) & (F.col("n") >= max(2, floor))).orderBy("pair").toPandas()
    pair, times = often["pair"].to_numpy(np.int64), often["n"].to_numpy(np.int64)
    shared = docs.sparkSession.sparkContext.broadcast((words, pair, times))

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_kept()
        words, pair, times = shared.value
        for batch in batches:
            for a in range(0, batch.num_rows, 1_000):
                some = batch.slice(a, 1_000)
                sizes, sums, rest = [], [], []
                for x in some.column(2):
                    own = np.frombuffer(x.as_buffer(), dtype).astype(np.int64)
                    sizes.append(len(own))
                    if not len(own):
                        sums.append(0.0)
                        rest.append(())
                        continue
                    known, back, n = np.unique(own, return_inverse=True, return_counts=True)
                    others = words[known] - n
                    left = total - len(own)
                    alone = np.where(others > 0, np.log(np.maximum(others, 1)) - np.log(max(left, 1)), -np.log(left + 1.0))
                    context = np.log(np.maximum(others, 1))
                    key, first, m = np.unique(_pairs(own), return_index=True, return_counts=True)
                    hit, miss = -context[back[first]], np.log(alpha) + alone[back[first + 1]]
                    at = np.searchsorted(pair, key)
                    found = at < len(pair)
                    found[found] = pair[at[found]] == key[found]
                    more = times[at[found]] - m[found]
                    value = np.where(more > 0, np.log(np.maximum(more, 1)) + hit[found], miss[found])
                    sums.append(float(alone[back[0]] + (m[found] * value).sum()))
                    rest.append((key[~found], m[~found], hit[~found], miss[~found]))
                ends = np.cumsum([0, *[len(r[0]) if r else 0 for r in rest]]).astype(np.int32)
                flat = [np.concatenate([r[k] for r in rest if r] or [np.zeros(0)]) for k in range(4)]
                kinds = (np.int64, np.int32, np.float32, np.float32)
                lists = [pa.ListArray.from_arrays(ends, pa.array(c.astype(t))) for c, t in zip(flat, kinds)]
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), some.column(1), pa.array(sizes, pa.int64()), pa.array(sums, pa.float64()), *lists],
                    ["doc_id", "print", "n_tokens", "sum", "pair", "m", "hit", "miss"])
            give_back()

    scored = ids.mapInArrow(
        local, "doc_id long, print long, n_tokens long, sum double, pair array<long>, m array<int>, hit array<float>, miss array<float>")
    scored = written(scored, "lm-local").dropDuplicates(["doc_id", "print"])
    rare = scored.select("doc_id", "print", F.explode(F.arrays_zip("pair", "m", "hit", "miss")).alias("x")).select("doc_id", "print", "x.*")
    counted = rare.join(table.filter("pair >= 0"), "pair")
    others = F.col("n") - F.col("m")
    value = F.col("m") * F.when(others > 0, F.log(others.cast("double")) + F.col("hit")).otherwise(F.col("miss").cast("double"))
    parts = counted.select("doc_id", "print", F.lit(0).cast("long").alias("n_tokens"), value.alias("sum"))
    whole = scored.select("doc_id", "print", "n_tokens", "sum").unionByName(parts)
    done = whole.groupBy("doc_id", "print").agg(F.sum("n_tokens").alias("n_tokens"), F.sum("sum").alias("log_score"))
    each = join_same(ids.select("doc_id", "print"), done, ["doc_id", "print"])  # a row for every row, also for those alike
    return each.select("doc_id", "n_tokens", "log_score", F.expr("try_divide(log_score, n_tokens)").alias("mean_log_score"))
