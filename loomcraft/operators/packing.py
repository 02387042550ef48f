"""Packing search documents and examples into prompt text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.jsons import entries, last_or_null
from ..functions.text import clean_text, markdown_tables
from .prefix import concat_in_order, running_total


def usable_documents(df: DataFrame, url: str = "url", content: str = "content") -> DataFrame:
    return df.filter(F.col(url).isNotNull() & F.col(content).isNotNull())


def packed_text(content: str, tables: str | None = None) -> Column:
    """What a document contributes: its cleaned content and, if it has tables, those as Markdown."""
    body = clean_text(content)
    if not tables:
        return body
    return F.when(F.col(tables).isNull(), body).otherwise(F.concat(body, F.lit("\n"), markdown_tables(tables)))


def document_block(url: Column, body: Column) -> Column:
    return F.concat(F.lit('<doc index="'), url, F.lit('">\n'), body, F.lit("\n</doc>\n"))


def within_budget(
    docs: DataFrame, keys: Sequence[str], rank: str, budget: str, url: str = "url", content: str = "content",
    tables: str | None = None, block_rows: int = 1000,
) -> DataFrame:
    """The documents of each key that fit its character budget: in rank order up to the first that does not.

    Lengths are not negative, so stopping there equals keeping the rows whose running total fits."""
    body = packed_text(content, tables)
    sized = usable_documents(docs, url, content).withColumn("body", body)
    sized = sized.withColumn("body_chars", F.length("body"))
    return running_total(sized, keys, rank, "body_chars", "total_chars", up_to=budget, block_rows=block_rows)


def pack_documents(
    docs: DataFrame, keys: Sequence[str], rank: str, budget: str, url: str = "url", content: str = "content",
    tables: str | None = None, out: str = "doc_list", block_rows: int = 1000,
) -> DataFrame:
    """One text per key with the documents that fit. Rows are joined only after the budget cut them down."""
    fitting = within_budget(docs, keys, rank, budget, url, content, tables, block_rows)
    return concat_in_order(fitting, keys, rank, document_block(F.col(url), F.col("body")), out, block_rows=block_rows)


def example_block(source: Column, content: Column, messages_only: bool = False) -> Column:
    body = F.to_json(last_or_null(entries(content), F.lit("messages"))) if messages_only else content
    return F.concat(
        F.lit("<example = "), F.substring_index(source, "/", -1), F.lit(">\n"), body, F.lit("\n</example>\n")
    )


def pack_examples(
    ranked: DataFrame, keys: Sequence[str], rank: str, source: str = "source", content: str = "content",
    messages_only: bool = False, out: str = "examples",
) -> DataFrame:
    """The examples found for each key as one text, best first. ``ranked`` holds k rows per key."""
    block = example_block(F.col(source), F.col(content), messages_only)
    return concat_in_order(ranked, keys, rank, block, out)


def enrich_tasks(tasks: DataFrame, packs: DataFrame, examples: DataFrame | None, keys: Sequence[str]) -> DataFrame:
    """Tasks with their documents and examples; a task without either gets empty text."""
    joined = tasks.join(packs, list(keys), "left").withColumn("doc_list", F.coalesce("doc_list", F.lit("")))
    if examples is not None:
        joined = joined.join(examples, list(keys), "left").withColumn("examples", F.coalesce("examples", F.lit("")))
    return joined
