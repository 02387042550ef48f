"""Exact deduplication by naming blocks.

A text is cut into blocks of ``block_bytes`` bytes. Distinct blocks are sorted and numbered; the number is
the block's name, and equal names mean equal blocks. Then names at places 2i and 2i+1 of a text become
pairs, distinct pairs are sorted and numbered, and so on until a text has one name left. Two texts are equal
if and only if they end at the same level with the same name: nothing rests on a hash being free of collisions.

Blocks are numbered in order of a 128-bit digest, so that their bytes are shuffled once only, to find
out which digests stand for more than one block. Those (in practice none) are numbered by their bytes.
Every numbering is written before it is used, so a task that runs again can't number differently.

Null text equals empty text. Rows with the same id and the same text are one document given twice: they count in
``group_size`` and have the same ``kept``. A null id is smaller than any other; in a group of null ids all
stay. An empty table gives no rows. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from ..session import written
from .columns import digest, join_same, rows_of

BLOCK_BYTES = 4096


def _numbered(distinct: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Number rows in order of ``keys``: ever larger numbers, with gaps."""
    return written(distinct.repartitionByRange(*keys).sortWithinPartitions(*keys)
                   .withColumn("name", F.monotonically_increasing_id()), name)


def _blocks(docs: DataFrame, doc_id: str, text: str, block_bytes: int, print_of: Callable[[Column], tuple[Column, Column]]) -> DataFrame:
    data = F.col("_text").cast("binary")
    count = F.greatest(F.lit(1), F.ceil(F.octet_length("_text") / F.lit(block_bytes)).cast("int"))
    cut = F.transform(F.sequence(F.lit(0), F.col("_n") - 1), lambda i: F.substring(data, i * block_bytes + 1, block_bytes))
    rows = rows_of(docs, doc_id, text).withColumn("_n", count).select(
        "_doc", "_print", "_n", F.posexplode(cut).alias("_at", "_block"))
    k1, k2 = print_of(F.col("_block"))
    return rows.withColumns({"_k1": k1, "_k2": k2})


def identities(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES,
               print_of: Callable[[Column], tuple[Column, Column]] = digest) -> DataFrame:
    """``_doc, _print, _rows, level, name``: equal ``(level, name)`` if and only if the texts are equal."""
    spark = docs.sparkSession
    blocks = _blocks(docs, doc_id, text, block_bytes, print_of)
    contents = blocks.groupBy("_k1", "_k2", "_block").agg(F.lit(1).alias("one"))
    prints = contents.groupBy("_k1", "_k2").agg(F.sum("one").alias("contents"))
    names = _numbered(prints, ["_k1", "_k2"], "block-names")
    places = blocks.groupBy("_doc", "_print", "_n", "_at", "_k1", "_k2").agg(F.count("*").alias("_rows"))
    single = names.filter("contents = 1").select("_k1", "_k2", "name")
    columns = ["_doc", "_print", "_n", "_at", "_rows", "name"]
    rows = places.join(single, ["_k1", "_k2"]).select(*columns)
    clashing = names.filter("contents > 1").select("_k1", "_k2")
    if not clashing.isEmpty():
        among = blocks.join(clashing, ["_k1", "_k2"], "left_semi")
        keys = ["_k1", "_k2", "_block"]
        told_apart = _numbered(among.select(*keys).distinct(), keys, "clashing-blocks")
        told_apart = told_apart.withColumn("name", -1 - F.col("name"))
        counted = among.groupBy("_doc", "_print", "_n", "_at", *keys).agg(F.count("*").alias("_rows"))
        rows = rows.unionByName(counted.join(told_apart, keys).select(*columns))
    rows = written(rows, "block-rows")
    found = rows.filter("_n = 1").select("_doc", "_print", "_rows", F.lit(0).alias("level"), "name")
    longest = rows.agg(F.max("_n")).first()[0] or 1
    level = 0
    while longest > 1:
        level, longest = level + 1, -(-longest // 2)
        even, half = F.col("_at") % 2 == 0, F.expr("_at div 2").cast("int")
        pairs = rows.filter("_n > 1").groupBy("_doc", "_print", "_n", half.alias("_at")).agg(
            F.max(F.when(even, F.col("name"))).alias("left"),
            F.max(F.when(~even, F.col("name"))).alias("right"), F.max("_rows").alias("_rows"))
        distinct = pairs.select("left", "right").distinct()
        pair_names = _numbered(distinct, ["left", "right"], "pair-names")
        named = join_same(pairs, pair_names, ["left", "right"]).select(
            "_doc", "_print", F.ceil(F.col("_n") / 2).cast("int").alias("_n"), "_at", "_rows", "name")
        rows = written(named, "pair-rows")
        found = found.unionByName(rows.filter("_n = 1").select("_doc", "_print", "_rows", F.lit(level).alias("level"), "name"))
    return found


def exact_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES,
                 print_of: Callable[[Column], tuple[Column, Column]] = digest) -> DataFrame:
    """One row per document: its id, ``keep_id`` (largest id of the equal texts), ``group_size``, ``kept``, ``text_sha256``."""
    found = identities(docs, doc_id, text, block_bytes, print_of)
    groups = found.groupBy("level", "name").agg(F.max("_doc").alias("keep_id"), F.sum("_rows").alias("group_size"))
    members = found.join(groups, ["level", "name"]).select("_doc", "_print", "keep_id", "group_size")
    rows = rows_of(docs, doc_id, text).select("_doc", "_print", F.sha2("_text", 256).alias("text_sha256"))
    return join_same(rows, members, ["_doc", "_print"]).select(
        F.col("_doc").alias(doc_id), "keep_id", "group_size",
        F.col("_doc").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
