"""Token totals kept up to date by deltas.

A batch is rows ``op, doc_id, text, source, lang`` with ``op`` 'insert', 'revise' or 'delete'. Its texts are counted by
each tokenizer version, the counts are set against the last known of the same document and version, and
what changes becomes signed deltas by source, language and version: minus the old, plus the new. Totals are the sum
of all committed deltas; no text is counted twice.

A batch is committed by one row in ``commits``, written last. A batch that is sent again after that does nothing; one
that broke off before it is written anew over what it left. Known counts (``ledger``) and deltas of a batch are read
only if it is committed.

Inserting a known document revises it, revising an unknown one inserts it, deleting an unknown one does nothing.
Repeated rows of an id in a batch count once: a delete before others, then the largest count. Rows without an id are
documents of their own, told apart by text, source and language and counted: every row inserts one more, a delete takes one
such document away if there is one left. A null or unknown ``op`` is refused. Null
texts have no tokens; null sources and languages are groups of their own. Empty batches commit nothing but their name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .columns import join_same, text_of
from .tokens import encoder, in_slices

# Words an encoder keeps here, and the rows and characters it is given at a time: they bound a worker's memory.
WORDS_KEPT = 200_000
_ROWS = 256
_CHARS = 500_000
_KEY = ["doc_id", "twin", "version"]
OPS = ("insert", "revise", "delete")
_GROUP = ["source", "lang", "version"]
LEDGER = (
    "doc_id long, twin string, version string, source string, lang string, tokens long, copies long, seq long, batch string, "
    "old struct<source:string,lang:string,tokens:long,copies:long>")
DELTAS = "source string, lang string, version string, docs long, tokens long, batch string"


def tokenizer_count(path: str) -> Callable[[Column], Column]:
    """Counts the ids of a tokenizer."""

    @F.arrow_udf("long")
    def count(texts: pa.Array) -> pa.Array:
        own = encoder(path, WORDS_KEPT)
        width = np.dtype(own.dtype).itemsize
        sizes = [len(ids) // width for i in range(0, len(texts), _ROWS)
                 for _, ids in in_slices(own.encode, texts.slice(i, _ROWS).to_pylist(), _CHARS)]
        return pa.array(sizes, pa.int64())

    return count


def word_count(text: Column) -> Column:
    """Counts runs of characters that aren't white space."""
    return F.size(F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")).cast("long")


class TokenRollup:
    """Totals by source, language and tokenizer version, in tables below ``path``."""

    def __init__(self, spark: SparkSession, path: str, versions: dict[str, Callable[[Column], Column]]) -> None:
        self.spark, self.path, self.versions = spark, path, versions
        self._write(spark.createDataFrame([], "batch string, seq long"), "commits", "none")

    def _write(self, rows: DataFrame, table: str, part: str) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/{table}/{part}")

    def commits(self) -> DataFrame:
        return self.spark.read.schema("batch string, seq long").parquet(f"{self.path}/commits/*")

    def _committed(self, table: str, schema: str) -> DataFrame:
        parts = [f"{self.path}/{table}/{self._part(r.batch)}" for r in self.commits().collect()]
        return self.spark.read.schema(schema).parquet(*parts) if parts else self.spark.createDataFrame([], schema)

    @staticmethod
    def _part(batch: str) -> str:
        return "batch-" + hashlib.sha256(batch.encode()).hexdigest()[:32]

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Apply a batch; whether it was new. The driver reads the names of earlier batches only."""
        done = {r.batch: r.seq for r in self.commits().collect()}
        if batch in done:
            return False
        seq = max(done.values(), default=0) + 1
        known = self._committed("ledger", LEDGER)
        counts = F.array(*[F.struct(F.lit(v).alias("version"), f(F.col("_text")).alias("tokens")) for v, f in self.versions.items()])
        source, lang = F.col("source").cast("string"), F.col("lang").cast("string")
        op = F.when(F.col("op").isin(*OPS), F.col("op")).otherwise(
            F.raise_error(F.concat(F.lit(f"op must be one of {', '.join(OPS)}, not "), F.coalesce("op", F.lit("null")))))
        doc_id = F.col("doc_id").cast("long")
        twin = F.when(doc_id.isNull(), F.sha2(F.to_json(F.array(text_of(), source, lang)), 256))
        rows = changes.select(
            doc_id.alias("doc_id"), twin.alias("twin"), source.alias("source"), lang.alias("lang"), (op != "delete").alias("alive"),
            F.when(F.col("op") != "delete", text_of()).otherwise("").alias("_text"))
        rows = rows.select("doc_id", "twin", "source", "lang", "alive", F.explode(counts).alias("_c")).select(
            "doc_id", "twin", "source", "lang", "alive", "_c.version", "_c.tokens")
        latest = rows.groupBy(*_KEY).agg(
            F.max(F.struct((~F.col("alive")).alias("gone"), "tokens", "source", "lang")).alias("_new"),
            F.max("tokens").alias("_most"), F.sum(F.when(F.col("alive"), 1).otherwise(-1)).alias("_more"))
        self._write(latest, "counts", self._part(batch))
        own = self.spark.read.schema(latest.schema).parquet(f"{self.path}/counts/{self._part(batch)}")
        last = known.groupBy(*_KEY).agg(F.max_by(F.struct("source", "lang", "tokens", "copies"), "seq").alias("old"))
        met = join_same(own, last, _KEY, "left")
        named, here = F.col("twin").isNull(), ~F.col("_new.gone")
        had = lambda name: F.coalesce(F.col(f"old.{name}"), F.lit(0))
        self._write(met.select(
            *_KEY, "_new.source", "_new.lang",
            F.when(~named, F.greatest(had("tokens"), "_most")).when(here, F.col("_new.tokens")).otherwise(0).cast("long").alias("tokens"),
            F.when(~named, F.greatest(had("copies") + F.col("_more"), F.lit(0))).when(here, 1).otherwise(0).cast("long").alias("copies"),
            F.lit(seq).cast("long").alias("seq"), F.lit(batch).alias("batch"), "old"), "ledger", self._part(batch))
        told = self.spark.read.schema(LEDGER).parquet(f"{self.path}/ledger/{self._part(batch)}")
        signed = lambda sign, of: (F.lit(sign) * F.col(f"{of}copies"), F.lit(sign) * F.col(f"{of}copies") * F.col(f"{of}tokens"))
        of_old, of_new = signed(-1, "old."), signed(1, "")
        minus = told.filter("old.copies > 0").select("old.source", "old.lang", "version", of_old[0].alias("docs"), of_old[1].alias("tokens"))
        plus = told.filter("copies > 0").select(*_GROUP, of_new[0].alias("docs"), of_new[1].alias("tokens"))
        deltas = plus.unionByName(minus).groupBy(*_GROUP).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        self._write(deltas.withColumn("batch", F.lit(batch)), "deltas", self._part(batch))
        self._write(self.spark.createDataFrame([(batch, seq)], "batch string, seq long"), "commits", self._part(batch))
        return True

    def totals(self) -> DataFrame:
        """``source, lang, version, docs, tokens`` of the documents there are."""
        deltas = self._committed("deltas", DELTAS)
        return deltas.groupBy(*_GROUP).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).filter("docs > 0")
