"""The kept example index against plain comparison of all vectors."""

import numpy as np
import pytest

from loomcraft.operators.cell_index import CellIndex
from loomcraft.session import fresh_path

COLUMNS = "id long, content string, embedding array<float>"


def rows_of(rng, ids):
    """Few directions, so that many vectors are alike."""
    return [(i, f"c{i}", [float(x) for x in rng.integers(-2, 3, 3)]) for i in ids]


def expected(queries, rows, k):
    held = {}
    for i, content, v in rows:
        if i is not None and v is not None and any(v):
            held.setdefault(i, (content, v))
    unit = lambda v: np.asarray(v, dtype=float) / np.linalg.norm(v)
    out = set()
    for q, e in queries:
        ranked = sorted((-round(float(unit(e) @ unit(v)), 9), i, c) for i, (c, v) in held.items())[:k]
        out |= {(q, n, i, c) for n, (_, i, c) in enumerate(ranked, 1)}
    return out


def found(spark, index, queries, k):
    asked = spark.createDataFrame(queries, "query_id long, embedding array<float>")
    return {(r.query_id, r["rank"], r.id, r.content) for r in index.examples(asked, k).collect()}


def test_batches_merge_and_searches_stay_exact(spark):
    rng = np.random.default_rng(5)
    index = CellIndex(spark, fresh_path(spark, "index"), most=4, fanout=2)
    queries = [(n, [1.0, float(n), -1.0]) for n in range(4)]
    rows, sizes, levels = [], [], set()
    for n, ids in enumerate([range(0, 30), range(25, 40), range(40, 44), range(44, 90), range(90, 150)]):
        batch = rows_of(rng, ids)
        assert index.add(f"b{n}", spark.createDataFrame(batch, COLUMNS))
        rows += batch
        sizes.append(len(index.segments()))
        levels |= {s.level for s in index.segments() if s.segment.startswith("merged-")}
    assert not index.add("b1", spark.createDataFrame(rows_of(rng, range(200, 210)), COLUMNS))
    assert found(spark, index, queries, 4) == expected(queries, rows, 4)
    assert max(sizes) <= 3 and levels == {1, -1} and len(index.segments()) == 1
    with pytest.raises(ValueError):
        index.search(spark.createDataFrame(queries, "query_id long, embedding array<float>"), 5)


def test_what_a_broken_job_left_counts_for_nothing(spark, monkeypatch):
    rng = np.random.default_rng(6)
    index = CellIndex(spark, fresh_path(spark, "index"), most=3)
    first, second = rows_of(rng, range(20)), rows_of(rng, range(20, 40))
    index.add("first", spark.createDataFrame(first, COLUMNS))

    def breaks(*args):
        raise RuntimeError("executor lost")

    with monkeypatch.context() as m:
        m.setattr(index, "_commit", breaks)
        with pytest.raises(RuntimeError):
            index.add("second", spark.createDataFrame(second, COLUMNS))
    queries = [(1, [1.0, 1.0, 0.0])]
    assert found(spark, index, queries, 3) == expected(queries, first, 3)
    assert index.add("second", spark.createDataFrame(second, COLUMNS))
    assert found(spark, index, queries, 3) == expected(queries, first + second, 3)


def test_odd_batches(spark):
    index = CellIndex(spark, fresh_path(spark, "index"), most=3)
    queries = [(1, [1.0, 0.0, 0.0])]
    assert found(spark, index, queries, 3) == set()
    odd = [(None, "none", [1.0, 0.0, 0.0]), (1, None, None), (2, "zero", [0.0, 0.0, 0.0])]
    assert index.add("odd", spark.createDataFrame(odd, COLUMNS))
    assert index.add("empty", spark.createDataFrame([], COLUMNS))
    assert found(spark, index, queries, 3) == set()
    few = [(7, None, [1.0, 0.0, 0.0]), (7, None, [1.0, 0.0, 0.0]), (8, "b", [0.0, 2.0, 0.0])]
    assert index.add("few", spark.createDataFrame(few, COLUMNS))
    assert found(spark, index, queries, 3) == expected(queries, few, 3)
