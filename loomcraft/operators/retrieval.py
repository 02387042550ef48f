"""Exact nearest neighbours by cosine similarity.

Comparing every query with every vector would be a cross join of rows. Instead the vectors are cut into
cells around pivots. From each cell's radius and the distances of its k members nearest the pivot
follows, by the triangle inequality, an upper bound on every query's k-th distance and a lower
bound on its distance to anything in a cell; cells beyond the bound cannot hold an answer and are
never compared. Vectors of a cell and queries at home in one are packed into blocks of bounded size, a row
each, and every task passes the blocks of vectors by its own blocks of queries. Both are written or shuffled
once, however many blocks meet: a task reads the written vectors again, keeps the best k found so far, and gives out those only.

On unit vectors the order by Euclidean distance is the order by cosine similarity.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row, Window, functions as F

from ..session import written

# Slack for rounding in the bounds; an extra candidate costs time, a missing one costs the answer.
_SLACK = 1e-6
MAX_CELLS = 1024
# Queries compared with all pivots at a time within a batch.
_CHUNK = 1024
# Queries compared with a part's vectors at a time, vectors of which one greatest similarity is taken, most pairs that are worked
# out again one by one.
_STRIP = 256
_GROUPED = 16
_EXACT = 1 << 16
# Blocks of queries of a task, and what their numbers may take.
_MOST_HELD = 16
_HELD_BYTES = 16 << 20


def _unit(column: pd.Series) -> np.ndarray:
    m = np.array(column.tolist(), dtype=np.float64)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Vectors as Arrow has them, without an object for each."""
    lengths = pc.min_max(pc.list_value_length(column)).as_py()
    if lengths["min"] != lengths["max"]:
        raise ValueError(f"vectors of {lengths['min']} and of {lengths['max']} numbers")
    return pc.list_flatten(column).to_numpy().astype(np.float32).reshape(len(column), lengths["min"])


def _as_one(column: pa.ChunkedArray) -> pa.Array:
    """A column's values as the list of one row."""
    return pa.ListArray.from_arrays(pa.array([0, len(column)], pa.int32()), column.combine_chunks())


def _unit_rows(m: np.ndarray) -> np.ndarray:
    m = m.astype(np.float64)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2.0 - 2.0 * (a @ b.T), 0.0))


def _near_best(sims: np.ndarray, keep: int) -> np.ndarray:
    """Of each row a number that at least ``keep`` of its values reach: the least of the ``keep`` greatest among the maxima of
    some groups of its columns, far fewer than there are columns."""
    groups = sims.shape[1] // _GROUPED
    if groups >= keep:
        whole = sims[:, :groups * _GROUPED].reshape(len(sims), _GROUPED, groups).max(axis=1)
        sims = np.concatenate([whole, sims[:, groups * _GROUPED:]], axis=1)
    at = sims.shape[1] - keep
    return np.partition(sims, at, axis=1)[:, at]


def best_pairs(
    queries: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int, known_best: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``row, col, similarity`` of the ``k`` vectors most similar to each query, similarities to nine digits, equal ones by id.

    All are compared in single precision; which of them can be among the ``k``, whatever its errors, is worked out again in double.
    Queries go in strips, so that memory is bounded also where all vectors are nearly alike; such strips are compared in double
    anew. Vectors that have a number that isn't finite are like none. ``known_best`` is a similarity for each query below which
    answers are of no use."""
    known = np.flatnonzero(np.isfinite(vectors).all(axis=1))
    vectors, ids = vectors[known], ids[known]
    keep = min(k, len(vectors))
    # An inner product of unit vectors is off by less than this in single precision; twice, as the k-th best may be off too.
    slack = np.float32(4 * (vectors.shape[1] + 4) * 2.0**-24)
    short_queries, short_vectors = queries.astype(np.float32), np.ascontiguousarray(vectors.T, np.float32)
    if known_best is None:
        known_best = np.full(len(queries), -np.inf)
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    for first in range(0, len(queries) if keep else 0, _STRIP):
        sims = short_queries[first:first + _STRIP] @ short_vectors
        useful = known_best[first:first + _STRIP]
        least = useful.astype(np.float32) - slack
        hits = sims >= least[:, None]
        if np.count_nonzero(hits) > 2 * keep * len(sims):
            least = np.maximum(least, _near_best(sims, keep) - slack)
            hits = sims >= least[:, None]
        row, col = np.nonzero(hits)
        if len(row) <= _EXACT:
            exact = np.round(np.einsum("ij,ij->i", queries[first + row], vectors[col]), 9)
        else:
            sims = np.round(queries[first:first + _STRIP] @ vectors.T, 9)
            row, col = np.nonzero(sims >= np.maximum(useful, _near_best(sims, keep))[:, None])
            exact = sims[row, col]
        fits = exact >= useful[row]
        row, col, exact = row[fits], col[fits], exact[fits]
        order = np.lexsort((ids[col], -exact, row))
        row, col, exact = row[order], col[order], exact[order]
        top = np.arange(len(row)) - np.searchsorted(row, row) < keep
        found.append((first + row[top], known[col[top]], exact[top]))
    return tuple(np.concatenate(x) for x in zip(*found))


class _Asking:
    """A block of queries and the best ``k`` found for each so far."""

    def __init__(self, ids: pa.Array, units: np.ndarray, wants: np.ndarray, k: int) -> None:
        self.ids, self.units, self.wants, self.k = ids, units, wants, k
        self.row, self.similarity = np.zeros(0, np.int64), np.zeros(0)
        self.first = self.found = None
        self.least = np.full(len(units), -np.inf)

    def meet(self, place: int, units: np.ndarray, first: np.ndarray, ids: pa.Array) -> None:
        """Compare the queries that want the cell at ``place`` with vectors of it; ``first`` is the least of a vector's ``ids``."""
        asks = np.flatnonzero(self.wants[:, place >> 3] & (128 >> (place & 7)))
        whole = len(asks) == len(self.units)
        row, col, similarity = best_pairs(self.units if whole else self.units[asks], units, first, self.k, self.least[asks])
        if not len(row):
            return
        row, first, found = asks[row], first[col], ids.take(pa.array(col))
        if self.found is not None:
            row, similarity = np.concatenate([self.row, row]), np.concatenate([self.similarity, similarity])
            first, found = np.concatenate([self.first, first]), pa.concat_arrays([self.found, found])
        order = np.lexsort((first, -similarity, row))
        place_in_row = np.arange(len(row)) - np.searchsorted(row[order], row[order])
        order, place_in_row = order[place_in_row < self.k], place_in_row[place_in_row < self.k]
        self.row, self.similarity, self.first, self.found = row[order], similarity[order], first[order], found.take(pa.array(order))
        last = place_in_row == self.k - 1
        self.least[self.row[last]] = self.similarity[last]


def _usable(df: DataFrame, embedding: str) -> DataFrame:
    """Vectors with a direction: a null or all-zero one has no similarity to anything."""
    return df.filter(F.col(embedding).isNotNull() & F.exists(embedding, lambda x: x != 0))


def folded(vectors: DataFrame, vector_id: str, embedding: str, copies: int) -> DataFrame:
    """``v, ids``: each vector with a direction once, with the ``copies`` smallest ids that have it."""
    per_copy = Window.partitionBy(embedding).orderBy(vector_id)
    return (
        _usable(vectors, embedding).select(vector_id, embedding)
        .withColumn("_n", F.row_number().over(per_copy)).filter(F.col("_n") <= copies)
        .groupBy(embedding).agg(F.sort_array(F.collect_list(vector_id)).alias("ids"))
        .select(F.col(embedding).alias("v"), "ids")
    )


def pivot_vectors(distinct: DataFrame, cells: int | None = None) -> list[list[float]]:
    """Vectors (column ``v``) to lay cells around, at most ``MAX_CELLS`` unless ``cells`` says how many."""
    if cells is None:
        cells = min(MAX_CELLS, max(4, math.isqrt(distinct.count()) // 4))
    return [r["v"] for r in distinct.select("v").orderBy(F.xxhash64("v"), "v").limit(cells).collect()]


def in_cells(distinct: DataFrame, pivots: list[list[float]]) -> DataFrame:
    """Add ``cell``, the place of the nearest pivot, and ``dist`` to it, to rows ``v, ids``."""
    units = _unit(pd.Series(pivots))

    def to_cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            d = _distances(_unit(pdf["v"]), units)
            home = d.argmin(axis=1)
            yield pdf.assign(cell=home.astype("int32"), dist=d[np.arange(len(pdf)), home])

    id_type = distinct.schema["ids"].dataType.elementType.simpleString()
    return distinct.select("v", "ids").mapInPandas(to_cells, f"v array<float>, ids array<{id_type}>, cell int, dist double")


def cell_summaries(celled: DataFrame, k: int) -> DataFrame:
    """``cell, n, low, high, inner`` per cell: its size, least and greatest distance, and up to ``k`` least distances."""
    near = Window.partitionBy("cell").orderBy("dist")
    inner = celled.select("cell", "dist").withColumn("_n", F.row_number().over(near)).filter(F.col("_n") <= k)
    inner = inner.groupBy("cell").agg(F.sort_array(F.collect_list("dist")).alias("inner"))
    sizes = celled.groupBy("cell").agg(F.count("*").alias("n"), F.min("dist").alias("low"), F.max("dist").alias("high"))
    return sizes.join(inner, "cell")


def nearest(
    queries: DataFrame, vectors: DataFrame, k: int = 2, query_id: str = "query_id", vector_id: str = "vec_id",
    embedding: str = "embedding", cells: int | None = None, rows_per_part: int = 4096,
) -> DataFrame:
    """The ``k`` most similar vectors of every query: ``query_id, rank, vector_id, similarity``.

    Equal similarities (to nine digits) are ranked by id. Copies of a vector are folded into one
    before anything is joined, keeping the ``k`` smallest ids, which is all that ties can ask for.
    ``cells`` defaults to a quarter of the root of the number of vectors, 1024 at most, so the driver holds at most
    that many pivots and ``k`` distances for each. A large cell is dealt out over blocks, and so are
    the queries at home in one; a block of vectors is shown only to blocks that have a query that asks for its cell."""
    id_type = vectors.schema[vector_id].dataType.simpleString()
    distinct = written(folded(vectors, vector_id, embedding, k), "vectors")
    pivots = pivot_vectors(distinct, cells)
    celled = written(in_cells(distinct, pivots), "cells") if pivots else distinct
    summaries = cell_summaries(celled, k).collect() if pivots else []
    return search_cells(queries, celled, summaries, pivots, k, id_type, query_id, vector_id, embedding, rows_per_part)


def search_cells(
    queries: DataFrame, celled: DataFrame, summaries: list[Row], pivots: list[list[float]], k: int, id_type: str,
    query_id: str = "query_id", vector_id: str = "vec_id", embedding: str = "embedding", rows_per_part: int = 4096,
) -> DataFrame:
    """``nearest`` over vectors that lie in cells. A cell may have several summaries, one per table its rows come from."""
    spark = queries.sparkSession
    qid_type = queries.schema[query_id].dataType.simpleString()
    if not summaries:
        return spark.createDataFrame([], f"{query_id} {qid_type}, rank int, {vector_id} {id_type}, similarity double")
    sizes = Counter()
    for r in summaries:
        sizes[r["cell"]] += r["n"]
    used = np.array(sorted(sizes))
    place = {c: i for i, c in enumerate(used)}
    low, high = np.full(len(used), np.inf), np.zeros(len(used))
    for r in summaries:
        at = place[r["cell"]]
        low[at], high[at] = min(low[at], r["low"]), max(high[at], r["high"])
    inner_cell = np.array([place[r["cell"]] for r in summaries for _ in r["inner"]])
    inner_dist = np.array([d for r in summaries for d in r["inner"]])
    used_pivots = _unit(pd.Series([pivots[c] for c in used]))
    between = _distances(used_pivots, used_pivots)

    def wanted(units: np.ndarray) -> np.ndarray:
        """Which of the used cells may hold an answer to each query."""
        d = _distances(units, used_pivots)
        reach = d[:, inner_cell] + inner_dist
        if reach.shape[1] < k:  # fewer vectors than asked for: every one is an answer
            bound = np.full(len(units), np.inf)
        else:
            bound = np.partition(reach, k - 1, axis=1)[:, k - 1] + _SLACK
        home = d.argmin(axis=1)
        d_home = d[np.arange(len(units)), home]
        with np.errstate(divide="ignore", invalid="ignore"):
            plane = (d**2 - d_home[:, None] ** 2) / (2 * between[home])
        plane = np.nan_to_num(plane, nan=0.0, posinf=0.0, neginf=0.0)
        return np.maximum.reduce([d - high, low - d, plane]) <= bound[:, None]

    def to_homes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(home=used[_distances(_unit(pdf["e"]), used_pivots).argmin(axis=1)].astype("int32"))

    query_rows = _usable(queries, embedding).select(F.col(query_id).alias("q"), F.col(embedding).alias("e"))
    asked = written(query_rows.mapInPandas(to_homes, f"q {qid_type}, e array<float>, home int"), "asked")
    homes = {r["home"]: r["n"] for r in asked.groupBy("home").agg(F.count("*").alias("n")).collect()}
    if not homes:
        return spark.createDataFrame([], f"{query_id} {qid_type}, rank int, {vector_id} {id_type}, similarity double")

    parts_of = lambda n: math.ceil(n / rows_per_part)
    lookup = lambda counts, cell: F.try_element_at(  # noqa: E731  of at most ``cells`` entries
        F.create_map(*[F.lit(int(x)) for pair in counts.items() for x in pair]), F.col(cell))

    def vector_block(rows: pa.Table) -> pa.Table:
        return pa.table({"cell": rows["cell"][:1], "part": rows["part"][:1], "ids": _as_one(rows["ids"]),
                         "v": pa.array([_matrix(rows["v"]).tobytes()])})

    shares = {c: parts_of(n) for c, n in sizes.items()}
    dealt = celled.select("v", "ids", "cell", F.pmod(F.xxhash64("v"), lookup(shares, "cell")).cast("int").alias("part"))
    vector_blocks = written(dealt.groupBy("cell", "part").applyInArrow(
        vector_block, f"cell int, part int, ids array<array<{id_type}>>, v binary"), "vector-blocks")

    def query_block(rows: pa.Table) -> pa.Table:
        matrix = _matrix(rows["e"])
        wants = np.concatenate([wanted(_unit_rows(matrix[at:at + _CHUNK])) for at in range(0, len(matrix), _CHUNK)])
        return pa.table({"block": rows["block"][:1], "q": _as_one(rows["q"]), "e": pa.array([matrix.tobytes()]),
                         "wants": pa.array([np.packbits(wants, axis=1).tobytes()]),
                         "cells": pa.array([used[wants.any(axis=0)].tolist()], pa.list_(pa.int32()))})

    # Blocks of queries are numbered, so that tasks get equally many, and no more than they can hold.
    chunks = {h: parts_of(n) for h, n in sorted(homes.items())}
    starts = dict(zip(chunks, np.cumsum([0, *chunks.values()])))
    blocks, numbers = sum(chunks.values()), len(pivots[0])
    held = max(1, min(_MOST_HELD, _HELD_BYTES // (4 * numbers * rows_per_part)))
    tasks = max(min(blocks, 3 * spark.sparkContext.defaultParallelism), math.ceil(blocks / held))
    number = (lookup(starts, "home") + F.pmod(F.xxhash64("q"), lookup(chunks, "home"))).cast("int")
    numbered = asked.select("q", "e", number.alias("block")).withColumn("task", F.col("block") % tasks)
    query_blocks = numbered.repartitionById(tasks, F.col("task")).groupBy("task", "block").applyInArrow(
        query_block, f"block int, q array<{qid_type}>, e binary, wants binary, cells array<int>")

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asking, at = {}, None
        for batch in batches:
            columns = dict(zip(batch.schema.names, batch.columns))
            value = lambda name, i: columns[name][i].as_py()
            matrix = lambda name, i: np.frombuffer(columns[name][i].as_buffer(), np.float32).reshape(-1, numbers)
            for i in range(batch.num_rows):
                block, vectors = value("block", i), (value("cell", i), value("part", i))
                if block not in asking:
                    queries_of = _unit_rows(matrix("e", i))
                    wants = np.frombuffer(columns["wants"][i].as_buffer(), np.uint8).reshape(len(queries_of), -1).copy()
                    own_ids = columns["q"][i].values.take(pa.array(np.arange(len(queries_of))))
                    asking[block] = _Asking(own_ids, queries_of, wants, k)
                if vectors != at:
                    at, ids = vectors, columns["ids"][i].values
                    units, first = _unit_rows(matrix("v", i)), pc.list_element(ids, 0).to_numpy(zero_copy_only=False)
                asking[block].meet(place[vectors[0]], units, first, ids)
        for x in asking.values():
            if x.found is not None:
                yield pa.RecordBatch.from_pydict({"q": x.ids.take(pa.array(x.row)), "ids": x.found, "similarity": x.similarity})

    # One task per part of the queries reads all blocks of vectors, as they are written; nothing of them is shuffled.
    shown = vector_blocks.coalesce(1).hint("shuffle_replicate_nl").join(query_blocks, F.array_contains("cells", F.col("cell")))
    found = shown.select("block", "q", "e", "wants", "cell", "part", "ids", "v").mapInArrow(
        best, f"q {qid_type}, ids array<{id_type}>, similarity double")
    by_rank = Window.partitionBy("q").orderBy(F.desc("similarity"), "id")
    return (
        found.select("q", F.explode("ids").alias("id"), "similarity")
        .withColumn("rank", F.row_number().over(by_rank)).filter(F.col("rank") <= k)
        .select(F.col("q").alias(query_id), "rank", F.col("id").alias(vector_id), "similarity")
    )
