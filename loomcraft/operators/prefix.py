"""Running computations along an order that survive a hot key.

A plain window sends all rows of a key (or, without a key, the whole table) to one task. Here the
rows of a key are cut into blocks of the order column, ``order div block_rows``. Each block is
summarised by a partial aggregate, the summaries (one row per block) are carried forward, and the
rows are finished inside their block. ``order`` is an integer that is unique within a key, so no
block holds more than ``block_rows`` rows however the keys are distributed. Keys are not null.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import written

BLOCK_ROWS = 100_000
# Texts weigh more than numbers: a part must fit a task even if its pieces are long.
PART_ROWS = 10_000
_BLOCK = "_block"


def _blocked(df: DataFrame, order: str, block_rows: int) -> DataFrame:
    return df.withColumn(_BLOCK, F.expr(f"`{order}` div {block_rows}"))


def running_total(
    df: DataFrame, keys: Sequence[str], order: str, value: str, out: str,
    up_to: str | None = None, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``out`` = sum of the non-negative ``value`` over the rows of the key up to and including this one.

    With ``up_to`` (a column constant within a key) only rows whose total stays within it are kept.
    Blocks that start beyond it are dropped by their summaries. Those left are written first, so that
    Spark knows their size when it plans the join: usually they are few, are broadcast, and only rows
    that may stay are shuffled; if they are many, the join is an ordinary shuffled one."""
    keys = list(keys)
    rows = _blocked(df, order, block_rows)
    limit = [F.max(up_to).alias("_limit")] if up_to else []
    totals = rows.groupBy(*keys, _BLOCK).agg(F.sum(value).alias("_total"), *limit)
    earlier = Window.partitionBy(*keys).orderBy(_BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.withColumn("_before", F.coalesce(F.sum("_total").over(earlier), F.lit(0)))
    if up_to:
        starts = written(starts.filter(F.col("_before") <= F.col("_limit")), "starts")
    inside = Window.partitionBy(*keys, _BLOCK).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    joined = rows.join(starts.select(*keys, _BLOCK, "_before"), [*keys, _BLOCK])
    result = joined.withColumn(out, F.sum(value).over(inside) + F.col("_before")).drop(_BLOCK, "_before")
    return result.filter(F.col(out) <= F.col(up_to)) if up_to else result


def forward_fill(
    df: DataFrame, columns: Sequence[str], order: str, keys: Sequence[str] = (), block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Replace nulls by the last earlier value of the key (of the table, if there are no keys)."""
    keys = list(keys)
    rows = _blocked(df, order, block_rows)
    newest = [F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in columns]
    lasts = rows.groupBy(*keys, _BLOCK).agg(*newest)
    earlier = Window.partitionBy(*keys).orderBy(_BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    carried = lasts.select(
        *keys, _BLOCK, *[F.last(c, ignorenulls=True).over(earlier).alias(f"_carry_{c}") for c in columns]
    )
    inside = Window.partitionBy(*keys, _BLOCK).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    filled = {
        c: F.coalesce(F.last(c, ignorenulls=True).over(inside), F.col(f"_carry_{c}")) for c in columns
    }
    joined = rows.join(carried, [*keys, _BLOCK])
    return joined.select(*[filled[c].alias(c) if c in filled else F.col(c) for c in df.columns])


def _in_order(order: str, piece: Column, separator: str) -> Column:
    pieces = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), piece.alias("p"))))
    return F.array_join(F.transform(pieces, lambda x: x["p"]), separator)


def concat_in_parts(
    df: DataFrame, keys: Sequence[str], order: str, piece: Column, out: str, separator: str = "",
    part_rows: int = PART_ROWS,
) -> DataFrame:
    """Join the text pieces of a key in order, one row per key and ``part``, a range of the order column.

    Parts are cut by the value of ``order``, so a key with gaps has more of them than its pieces need;
    ``concat_by_position`` counts pieces instead. The parts of a key, read in order, are its whole
    text; none of them is more than one task can hold."""
    rows = _blocked(df, order, part_rows)
    return (
        rows.groupBy(*keys, F.col(_BLOCK).alias("part")).agg(_in_order(order, piece, separator).alias(out))
    )


def with_position(
    df: DataFrame, keys: Sequence[str], order: str, out: str, ties: Sequence[str] = (), block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """``out`` = number of rows of the key before this one, nulls of ``order`` first.

    Counts per block are carried forward as in ``running_total``. Null keys are a key like any other."""
    names = [f"`{k}`" for k in keys]
    block = F.expr(f"`{order}` div {block_rows}").alias(_BLOCK)
    rows = df.withColumn("_group", F.struct(*names, block))  # structs are equal where both hold null
    counts = rows.groupBy("_group").agg(F.count("*").alias("_rows"))
    of_key = Window.partitionBy(*[f"_group.{n}" for n in names]).orderBy(f"_group.{_BLOCK}")
    earlier = F.sum("_rows").over(of_key.rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("_group", F.coalesce(earlier, F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_group").orderBy(order, *ties)
    joined = rows.join(starts, "_group").withColumn(out, F.row_number().over(inside) - 1 + F.col("_before"))
    return joined.drop("_group", "_before")


def concat_by_position(
    df: DataFrame, keys: Sequence[str], order: str, piece: Column, out: str, separator: str = "",
    part_rows: int = PART_ROWS, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Join the text pieces of a key in order, one row per key and ``part`` of ``part_rows`` pieces.

    A key with no more pieces than that has the single part 0, whatever its order values are. The
    parts of a larger key, read in order, are its whole text; none of them is more than one task can
    hold."""
    pieces = df.select(*[F.col(f"`{k}`") for k in keys], F.col(order).alias("_order"), piece.alias("_piece"))
    rows = with_position(pieces, keys, "_order", "_position", ["_piece"], block_rows)
    part = F.expr(f"_position div {part_rows}").alias("part")
    return rows.groupBy(*keys, part).agg(_in_order("_position", F.col("_piece"), separator).alias(out))


def concat_in_order(
    df: DataFrame, keys: Sequence[str], order: str, piece: Column, out: str, separator: str = "",
    block_rows: int = PART_ROWS,
) -> DataFrame:
    """Join the text pieces of a key into one text.

    For texts the caller bounds (a character budget, k examples): blocks are joined first, so the
    last step merges one short text per block. Rows are dealt out by key before that, so pieces are shuffled once, not again as blocks."""
    dealt = df.repartition(*[F.col(f"`{k}`") for k in keys])
    parts = concat_in_parts(dealt, keys, order, piece, "_text", separator, block_rows)
    return parts.groupBy(*keys).agg(_in_order("part", F.col("_text"), separator).alias(out))
