"""Evaluating an expensive expression exactly once, and on all cores.

A filter on a computed column is pushed below its projection, and the expression is then worked out
twice: to filter, and again to show. A generator is not duplicated that way, so the value is put
through one, as an array of one element, or of none where the row is to go.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

SPREAD_BYTES = 1 << 20


def bind(df: DataFrame, **values: Column) -> DataFrame:
    """Add columns whose expressions are evaluated once, however often they are used."""
    one = F.struct(*[v.alias(n) for n, v in values.items()])
    kept = [c for c in df.columns if c not in values]
    return df.select(*kept, F.explode(F.array(one)).alias("_bound")).select(*kept, *[f"_bound.{n}" for n in values])


def spread(df: DataFrame, part_bytes: int = SPREAD_BYTES) -> DataFrame:
    """Deal the rows of a scan out if it has fewer splits than there are cores, or than its files hold ``part_bytes``.

    For work that costs far more than moving its input, and for plain scans only: their splits and the size of their
    files are known without running anything. Parts are bounded by size, so that tasks don't grow with the table."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    parts = max(df.sparkSession.sparkContext.defaultParallelism, -(-size // part_bytes))
    return df.repartition(parts) if df.rdd.getNumPartitions() < parts else df


def distinct(df: DataFrame, part_bytes: int = SPREAD_BYTES) -> DataFrame:
    """The different rows of a plain scan, which has columns that can be hashed.

    ``DataFrame.distinct`` first gathers the rows of each scan task in that task's memory, whatever the size of its split. Here rows
    are dealt out by their values first, in parts of at most ``part_bytes``, so that no task's table grows with the scan's."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    parts = max(df.sparkSession.sparkContext.defaultParallelism, -(-size // part_bytes))
    return df.repartition(parts, *[F.col(f"`{c}`") for c in df.columns]).distinct()


def keep(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column and drop the rows in which it is null."""
    kept = [c for c in df.columns if c != name]
    return df.select(*kept, F.explode(F.filter(F.array(value), lambda x: x.isNotNull())).alias(name))
