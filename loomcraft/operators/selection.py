"""Selecting rows: work still to do, first rows, first per name, merged result lists."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F


def not_done(tasks: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Tasks without a result yet, null keys equal to null. Keys are reduced before the join, so repeated results cost nothing."""
    known = done.select(*[F.col(k).alias(f"_done_{k}") for k in keys]).distinct()
    met = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_done_{k}")) for k in keys])
    return tasks.join(known, met, "left_anti")


def first_rows(df: DataFrame, n: int, order: Sequence[str]) -> DataFrame:
    """The first ``n`` rows in order (a feature: ``num_tasks``, ``num_samples``, ``max_files``)."""
    return df.orderBy(*order).limit(n)


def first_successes(df: DataFrame, success: str, n: int, order: Sequence[str]) -> DataFrame:
    """Stop after ``n`` successes, in order."""
    return first_rows(df.filter(F.col(success)), n, order)


def skip_rows(df: DataFrame, n: int, ordinal: str) -> DataFrame:
    """All rows behind the first ``n``; ``ordinal`` counts from 0, so this is a filter, not a sort."""
    return df.filter(F.col(ordinal) >= n)


def first_per_name(df: DataFrame, name: str, order: str) -> DataFrame:
    """The first row of each name. ``order`` is unique.

    Only names and order are aggregated (map-side first); the wide columns meet the winners in a
    semi join, which Spark broadcasts when the winners turn out small."""
    winners = df.groupBy(name).agg(F.min(order).alias(order))
    return df.join(winners, [name, order], "left_semi")


def merged_results(first: DataFrame, second: DataFrame | None, keys: Sequence[str], position: str, item: str) -> DataFrame:
    """Two engines' result lists as one: the first list as it is, then what only the second found.

    Duplicates inside the first list stay; the second list loses those the first has and its own
    repeats. Result order is (``engine``, ``position``). Without a second list (its engine failed) the
    first is the result."""
    keys = list(keys)
    columns = [*keys, "engine", position, item]
    kept = first.withColumn("engine", F.lit(1)).select(*columns)
    if second is None:
        return kept
    fresh = (
        second.groupBy(*keys, item).agg(F.min(position).alias(position))
        .join(first.select(*keys, item).distinct(), [*keys, item], "left_anti")
        .withColumn("engine", F.lit(2)).select(*columns)
    )
    return kept.unionByName(fresh)


def with_side_sets(df: DataFrame, *side_sets: DataFrame | None) -> DataFrame:
    """Append optional data sets; columns one of them lacks become null."""
    for side in side_sets:
        if side is not None:
            df = df.unionByName(side, allowMissingColumns=True)
    return df
