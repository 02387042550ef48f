"""An example index that is kept: vectors in cells, added to in segments, searched exactly.

Below one folder lie ``examples`` (id and payload), ``cells`` (the vectors, each in the cell of its nearest pivot),
``summaries`` (size and radii per cell) and ``pivots``. Every batch becomes a segment of its own, the last thing written is
the row in ``commits`` that makes it count. What has no such row was left by a job that broke off, counts for nothing
and is written anew. Nothing that counts is ever changed, so searches go on while a batch is added.

``fanout`` segments of one level are merged into one of the next; their vectors keep their cells. Once there are as many
vectors outside the base as in it, all become a new base around new pivots. So a vector is written again a number of times
that grows with the logarithm of the index. One job adds at a time.
"""

from __future__ import annotations

import uuid
from collections import defaultdict

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.types import StructType

from .retrieval import cell_summaries, folded, in_cells, pivot_vectors, search_cells
from .selection import not_done

_COMMITS = "batch string, segment string, base string, level int, vectors long, merged array<string>"
_SUMMARIES = "cell int, n long, low double, high double, inner array<double>"


class CellIndex:
    """The index below ``path``: ids of type ``id_type`` in column ``id``, payload columns ``payload`` (a schema).

    A search may ask for up to ``most`` neighbours: so many ids are kept with vectors that are alike, and so many least
    distances with a cell. The first entry of an id counts, in a batch the one with the least vector."""

    def __init__(
        self, spark: SparkSession, path: str, id_type: str = "long", payload: str = "content string", most: int = 16, fanout: int = 4,
    ) -> None:
        if most < 1 or fanout < 2:
            raise ValueError("most must be at least 1 and fanout at least 2")
        self.spark, self.path, self.id_type, self.most, self.fanout = spark, path, id_type, most, fanout
        self._examples = f"id {id_type}, {payload}"
        self._cells = f"v array<float>, ids array<{id_type}>, cell int, dist double"

    def _read(self, table: str, schema: str, segments: list[str]) -> DataFrame:
        paths = [f"{self.path}/{table}/{s}" for s in segments]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def commits(self) -> DataFrame:
        """One row per committed segment, merged ones included."""
        try:
            return self.spark.read.schema(_COMMITS).parquet(f"{self.path}/commits")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], _COMMITS)

    def segments(self) -> list[Row]:
        """The segments that count and have vectors: less than ``fanout`` a level and the base."""
        rows = self.commits()
        merged = rows.select(F.explode("merged").alias("segment"))
        return rows.filter("vectors > 0").join(merged, "segment", "left_anti").orderBy("segment").collect()

    def add(self, batch: str, examples: DataFrame, embedding: str = "embedding") -> bool:
        """Add ``id``, payload and ``embedding`` of a batch under its name; whether it was new.

        Rows without id, or whose vector is null or all zero, can't be found by anyone and are left out."""
        if not self.commits().filter(F.col("batch") == batch).isEmpty():
            return False
        segment = f"batch-{uuid.uuid4().hex}"
        live = self.segments()
        names = [f"`{n}`" for n in StructType.fromDDL(self._examples).names]
        usable = examples.filter(F.col("id").isNotNull() & F.col(embedding).isNotNull() & F.exists(embedding, lambda x: x != 0))
        row = F.struct(F.col(embedding).cast("array<float>").alias("_v"), *names[1:])
        first = usable.groupBy("id").agg(F.min(row).alias("_row")).select("id", *[f"_row.{n}" for n in names[1:]], "_row._v")
        arrived = f"{self.path}/arrived/{segment}"
        first.write.parquet(arrived)
        first = self.spark.read.schema(f"{self._examples}, _v array<float>").parquet(arrived)
        # The ids of the batch are few: they are looked for among all, not all among them.
        known = self._all_examples().select("id").join(first.select("id"), "id", "left_semi").distinct()
        not_done(first, known, ["id"]).write.parquet(f"{self.path}/examples/{segment}")
        new = self.spark.read.schema(f"{self._examples}, _v array<float>").parquet(f"{self.path}/examples/{segment}")
        distinct = folded(new, "id", "_v", self.most)
        base = next((s.base for s in live), None)
        if base is None:
            base = self._choose_pivots(distinct, segment)
        pivots = self._pivots(base)
        vectors = self._store(in_cells(distinct, pivots), segment) if pivots else 0
        self._commit(batch, segment, base, -1 if base == segment else 0, vectors, [])
        self._merge()
        return True

    def _all_examples(self) -> DataFrame:
        """Payload rows are never merged; each stays in the segment of its batch."""
        batches = self.commits().filter("batch is not null").select("segment")
        rows = self._files("examples", f"{self._examples}, _v array<float>")
        return rows.join(batches, "segment", "left_semi")

    def _files(self, table: str, schema: str) -> DataFrame:
        try:
            rows = self.spark.read.schema(schema).option("recursiveFileLookup", True).parquet(f"{self.path}/{table}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], f"{schema}, segment string")
        return rows.withColumn("segment", F.element_at(F.split("_metadata.file_path", "/"), -2))

    def _choose_pivots(self, distinct: DataFrame, base: str) -> str:
        pivots = pivot_vectors(distinct)
        rows = [(i, [float(x) for x in v]) for i, v in enumerate(pivots)]
        self.spark.createDataFrame(rows, "cell int, v array<float>").write.mode("overwrite").parquet(f"{self.path}/pivots/{base}")
        return base

    def _pivots(self, base: str) -> list[list[float]]:
        return [r.v for r in self._read("pivots", "cell int, v array<float>", [base]).orderBy("cell").collect()]

    def _store(self, celled: DataFrame, segment: str) -> int:
        """Write a segment's vectors and the summary of its cells; their number."""
        celled.write.parquet(f"{self.path}/cells/{segment}")
        own = self._read("cells", self._cells, [segment])
        cell_summaries(own, self.most).write.parquet(f"{self.path}/summaries/{segment}")
        return self._read("summaries", _SUMMARIES, [segment]).agg(F.sum("n")).first()[0] or 0

    def _commit(self, batch: str | None, segment: str, base: str, level: int, vectors: int, merged: list[str]) -> None:
        row = [(batch, segment, base, level, vectors, merged)]
        self.spark.createDataFrame(row, _COMMITS).coalesce(1).write.mode("append").parquet(f"{self.path}/commits")

    def _merge(self) -> None:
        """Merge until no level is full; all into a new base where the base is the lesser part."""
        while True:
            levels = defaultdict(list)
            for s in self.segments():
                levels[s.level].append(s)
            full = next((n for n in sorted(levels) if n >= 0 and len(levels[n]) >= self.fanout), None)
            if full is None:
                return
            everything = [s for rows in levels.values() for s in rows]
            outside = sum(s.vectors for s in everything if s.level >= 0)
            rebase = outside >= sum(s.vectors for s in everything if s.level < 0)
            parts = everything if rebase else levels[full]
            segment = f"merged-{uuid.uuid4().hex}"
            rows = self._read("cells", self._cells, [s.segment for s in parts])
            # A vector is once in a segment, so no group here has more rows than there are segments.
            ids = F.slice(F.sort_array(F.flatten(F.collect_list("ids"))), 1, self.most).alias("ids")
            if rebase:
                again = f"{self.path}/again/{segment}"
                rows.groupBy("v").agg(ids).write.parquet(again)
                distinct = self.spark.read.schema(f"v array<float>, ids array<{self.id_type}>").parquet(again)
                base = self._choose_pivots(distinct, segment)
                celled = in_cells(distinct, self._pivots(base))
            else:
                base = parts[0].base
                celled = rows.groupBy("v").agg(ids, F.first("cell").alias("cell"), F.first("dist").alias("dist"))
            vectors = self._store(celled, segment)
            self._commit(None, segment, base, -1 if rebase else full + 1, vectors, [s.segment for s in parts])

    def search(self, queries: DataFrame, k: int, query_id: str = "query_id", embedding: str = "embedding") -> DataFrame:
        """The ``k`` most similar examples of each query: ``query_id, rank, id, similarity``, exact, as ``nearest`` gives them."""
        if k > self.most:
            raise ValueError(f"this index keeps what up to {self.most} neighbours need, not {k}")
        live = [s.segment for s in self.segments()]
        celled = self._read("cells", self._cells, live)
        summaries = self._read("summaries", _SUMMARIES, live).collect()
        pivots = self._pivots(self.segments()[0].base) if live else []
        return search_cells(queries, celled, summaries, pivots, k, self.id_type, query_id, "id", embedding)

    def examples(self, queries: DataFrame, k: int, query_id: str = "query_id", embedding: str = "embedding") -> DataFrame:
        """What ``search`` finds with its payload."""
        found = self.search(queries, k, query_id, embedding)
        return found.join(self._all_examples().drop("_v", "segment"), "id")
