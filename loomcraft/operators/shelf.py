"""Long texts that several steps need, written once.

A step that carries a text along writes it again with each of its tables and shuffles. Here the texts lie in one table, bucketed by a
digest of the rows they come from, and rows carry the digest only. Where texts are needed, rows are joined to that table, which is
read as it lies: rows are shuffled, texts are not.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from ..session import shared_folder

KEY = "_key"
PART_BYTES = 4 << 20


def _parts(df: DataFrame, text: str, part_bytes: int) -> int:
    """So many that texts evenly dealt out come to ``part_bytes`` each, and no fewer than Spark would shuffle rows to."""
    conf = df.sparkSession.conf
    size = df.agg(F.sum(F.octet_length(text))).first()[0] or 0
    least = max(df.sparkSession.sparkContext.defaultParallelism, int(conf.get("spark.sql.shuffle.partitions")))
    return min(max(least, -(-size // part_bytes)), int(conf.get("spark.sql.sources.bucketing.maxBuckets")))


def shelved(df: DataFrame, text: str, name: str, part_bytes: int = PART_BYTES) -> tuple[DataFrame, DataFrame]:
    """The rows of ``df`` with ``KEY`` in place of the column ``text``, and the texts, ``KEY, text``, a row per key.

    Rows that are equal in all columns share a key and stay as many as they were. ``df`` is read twice, to size the parts and to write them."""
    others = [c for c in df.columns if c != text]
    each = [F.coalesce(F.sha2(F.col(f"`{c}`").cast("string"), 256), F.lit("-")) for c in df.columns]
    parts = _parts(df, text, part_bytes)
    # Dealt out first, so that equal rows are counted within a part and the parts are written as they are.
    dealt = df.withColumn(KEY, F.unhex(F.sha2(F.concat(*each), 256))).repartition(parts, KEY)
    folded = dealt.groupBy(KEY).agg(*[F.any_value(F.col(f"`{c}`")).alias(c) for c in df.columns], F.count("*").alias("_times"))
    spark, database = df.sparkSession, f"{name}_{uuid.uuid4().hex}"
    spark.sql(f"CREATE DATABASE {database} LOCATION '{shared_folder(spark)}/{database}'")
    folded.write.bucketBy(parts, KEY).saveAsTable(f"{database}.texts")
    table = spark.table(f"{database}.texts")
    rows = table.select(KEY, *[f"`{c}`" for c in others], F.explode(F.sequence(F.lit(1), F.col("_times"))).alias("_time")).drop("_time")
    return rows, table.select(KEY, f"`{text}`")


def with_text(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """``rows`` with the text of their ``KEY``. They are what is hashed; a part of the texts only passes by."""
    return rows.hint("shuffle_hash").join(texts, KEY)
