"""Dropping lines that many documents share.

What is known of the lines seen so far is kept as *runs*: tables of line keys with the number of
documents that hold them, bucketed and sorted by key, so that a batch meets them in a merge join
without the runs being shuffled again. A batch adds a run at level 0; as soon as a level has ``fanout``
runs they are merged into one run of the next level, so n batches leave some log n runs.

``drop_seen_lines`` is the form for batches that arrive over time: a batch is anti-joined with the runs,
loses the lines they hold, and adds its own. ``drop_common_lines`` is the form for a whole table:
its slices are written as one run for each ``fanout`` of them (one in all, unless ``batches`` is larger), and
then lines are anti-joined with the keys enough documents hold.

A line's key is the line without white space at its ends, A-Z lower-cased; 128 bits of it stand for
it. Lines whose key is shorter than ``min_chars`` are kept and never looked up. Null text is one empty line, as is empty text.
Every row counts as a document, also where ids repeat or are null. An empty table gives no rows.
Other columns are passed through, whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import shared_folder, written
from .columns import digest, join_same, lower_ascii, rows_of

SPACE = " \t\n\x0b\x0c\r"
_KEY = ["k1", "k2"]


def line_keys(lines: Column) -> Column:
    """The key of each line; one step after the other, so that none is worked out twice."""
    return F.transform(F.transform(lines, lambda x: F.btrim(x, F.lit(SPACE))), lower_ascii)


class LineRuns:
    """Levelled sorted runs of line keys, in tables below the shared folder."""

    def __init__(self, spark: SparkSession, fanout: int = 4) -> None:
        self.spark, self.fanout = spark, fanout
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.database = f"line_runs_{uuid.uuid4().hex}"
        self.levels: list[list[str]] = []
        spark.sql(f"CREATE DATABASE {self.database} LOCATION '{shared_folder(spark)}/{self.database}'")

    def _write(self, counts: DataFrame, level: int) -> str:
        name = f"{self.database}.run_{level}_{uuid.uuid4().hex}"
        dealt = counts.select(*_KEY, "n").repartition(self.buckets, *_KEY)
        dealt.write.bucketBy(self.buckets, *_KEY).sortBy(*_KEY).saveAsTable(name)
        return name

    def add(self, counts: DataFrame) -> None:
        """Add a run of distinct keys ``k1, k2`` with the number ``n`` of documents, and merge what is due."""
        self._place(self._write(counts, 0), 0)

    def add_all(self, counts: DataFrame, batch: str, batches: int) -> None:
        """Add one run of level 1 for each ``fanout`` of the ``batches`` values of the column ``batch``."""
        staged = f"{self.database}.staged_{uuid.uuid4().hex}"
        dealt = counts.select(batch, *_KEY, "n").repartition(self.buckets, *_KEY)
        dealt.write.partitionBy(batch).bucketBy(self.buckets, *_KEY).sortBy(*_KEY).saveAsTable(staged)
        for first in range(0, batches, self.fanout):
            some = self.spark.table(staged).filter(F.col(batch).between(first, first + self.fanout - 1))
            self._place(self._write(_merged(some), 1), 1)
        self.spark.sql(f"DROP TABLE {staged}")

    def _place(self, run: str, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            old, self.levels[level] = self.levels[level], []
            self._place(self._write(_merged(self._union(old)), level + 1), level + 1)
            for name in old:
                self.spark.sql(f"DROP TABLE {name}")

    def _union(self, names: list[str]) -> DataFrame:
        runs = [self.spark.table(n) for n in names]
        whole = runs[0]
        for r in runs[1:]:
            whole = whole.unionByName(r)
        return whole

    def names(self) -> list[str]:
        return [n for level in self.levels for n in level]

    def unseen(self, keys: DataFrame) -> DataFrame:
        """The rows of ``keys`` whose key is in no run: one merge join per run."""
        for name in self.names():
            keys = keys.join(self.spark.table(name), _KEY, "left_anti")
        return keys

    def frequent(self, min_docs: int) -> DataFrame:
        """Keys that at least ``min_docs`` documents hold."""
        names = self.names()
        if not names:
            return self.spark.createDataFrame([], "k1 long, k2 long")
        whole = self.spark.table(names[0]) if len(names) == 1 else _merged(self._union(names))
        return whole.filter(F.col("n") >= min_docs).select(*_KEY)


def _merged(runs: DataFrame) -> DataFrame:
    return runs.groupBy(*_KEY).agg(F.sum("n").alias("n"))


def _with_lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """``rows_of`` with ``_lines`` and ``_keys``, the keys in line order, null for those not looked up."""

    def looked_up(key: Column) -> Column:
        k1, k2 = digest(key)
        return F.when(F.char_length(key) >= max(1, min_chars), F.struct(k1.alias("k1"), k2.alias("k2")))

    rows = rows_of(docs).withColumn("_lines", F.split("_text", "\n"))
    return rows.withColumn("_keys", F.transform(line_keys(F.col("_lines")), looked_up))


def _counts(rows: DataFrame, *by: Column) -> DataFrame:
    """Documents per key. A document names a key once, so partial sums are all that is shuffled."""
    keys = rows.select(*by, F.explode(F.array_distinct(F.array_compact("_keys"))).alias("_key"))
    names = [c for c in keys.columns if c != "_key"]
    keys = keys.select(*names, F.col("_key.k1").alias("k1"), F.col("_key.k2").alias("k2"))
    return keys.groupBy(*names, *_KEY).agg(F.count("*").alias("n"))


def _places(rows: DataFrame) -> DataFrame:
    """``_doc, _print, _at, k1, k2`` of every line. Lines that aren't looked up have no ``k2``, so they meet nothing,
    and a ``k1`` that spreads them out."""
    lines = rows.select("_doc", "_print", F.posexplode("_keys").alias("_at", "_key"))
    return lines.select("_doc", "_print", "_at", F.coalesce("_key.k1", F.xxhash64("_doc", "_print", "_at")).alias("k1"), F.col("_key.k2").alias("k2"))


def _rebuilt(docs: DataFrame, rows: DataFrame, kept: DataFrame) -> DataFrame:
    """The documents with the lines at the ``kept`` places."""
    places = kept.groupBy("_doc", "_print").agg(F.array_sort(F.collect_set("_at")).alias("_at"))
    joined = join_same(rows.select("_row", "_doc", "_print", "_lines"), places, ["_doc", "_print"], "left")
    text = F.array_join(F.transform("_at", lambda i: F.get("_lines", i)), "\n")
    n_lines, n_kept = F.size("_lines").cast("long"), F.coalesce(F.size("_at"), F.lit(0)).cast("long")
    done = joined.select("_row", F.coalesce(text, F.lit("")).alias("_new"), n_lines.alias("_n_lines"), (n_lines - n_kept).alias("_n_dropped"))
    columns = [F.col("_new").alias(c) if c == "text" else F.col(f"_row.`{c}`").alias(c)
               for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return done.select(*columns, F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"))


def drop_common_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, batches: int = 4) -> DataFrame:
    """The documents without the lines whose key at least ``min_docs`` of them hold, and with ``n_lines``
    (before) and ``n_dropped``. The table is taken in ``batches`` slices by id; every four of them,
    the ``fanout``, are one run of level 1, and with the four of the default no level fills."""
    rows = _with_lines(docs, min_chars)
    runs = LineRuns(docs.sparkSession)
    slice_ = F.pmod(F.xxhash64("_doc"), F.lit(batches)).cast("int")
    runs.add_all(_counts(rows, slice_.alias("batch")), "batch", batches)
    kept = _places(rows).join(runs.frequent(min_docs), _KEY, "left_anti")
    return _rebuilt(docs, rows, kept)


def drop_seen_lines(runs: LineRuns, docs: DataFrame, min_chars: int = 1) -> DataFrame:
    """A new batch without the lines that earlier batches hold; its own lines are then added to the runs.

    The result is written before the runs change, so it can be read at any time after."""
    rows = _with_lines(docs, min_chars)
    fresh = written(_rebuilt(docs, rows, runs.unseen(_places(rows))), "line-batch")
    runs.add(_counts(rows))
    return fresh
