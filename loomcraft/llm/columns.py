"""Column expressions the operators share."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, functions as F


def text_of(column: str = "text") -> Column:
    """A text, null as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased and nothing else. Texts of ASCII only take the quick way."""
    only_ascii = F.octet_length(text) == F.char_length(text)
    return F.when(only_ascii, F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def digest(value: Column) -> tuple[Column, Column]:
    """128 bits in two numbers."""
    return F.xxhash64(value), F.xxhash64(F.lit(1), value)


def join_same(left: DataFrame, right: DataFrame, names: list[str], how: str = "inner") -> DataFrame:
    """Join on columns of both sides, null equal to null; the columns appear once."""
    other = right.withColumnsRenamed({n: f"{n}_right" for n in names})
    condition = F.lit(True)
    for n in names:
        condition = condition & F.col(n).eqNullSafe(F.col(f"{n}_right"))
    return left.join(other, condition, how).drop(*[f"{n}_right" for n in names])


def rows_of(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``_row`` (all columns), ``_doc``, ``_text`` (null as empty) and ``_print``, a print of the text.

    ``_doc`` and ``_print`` tell rows apart where ids repeat or are null; rows alike in both are copies
    of one row, for which an operator finds the same. Whatever else the columns are called, they are
    inside ``_row``."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    own = docs.select(row, F.col(doc_id).alias("_doc"), text_of(text).alias("_text"))
    return own.withColumn("_print", F.xxhash64("_text"))
