"""A corpus made ready for training, stage by stage.

Each stage takes the session, the documents its predecessor kept and the folder of the tables. All but the last return
documents with the columns they came with.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomcraft.llm import bestfit, catalog, decontaminate, line_dedup, simhash, toxicity
from loomcraft.session import written


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go."""
    return toxicity.drop_toxic(docs, catalog.table(spark, sf_dir, "labels"))


def without_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that ten documents share go; documents stay."""
    return line_dedup.drop_common_lines(docs, catalog.MIN_DOCS).select(*docs.columns)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked as near copies one stays, that with the smallest id."""
    return simhash.one_per_group(docs, width=4, radius=4)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are contaminated by the benchmark go."""
    return decontaminate.clean_documents(docs, catalog.table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of what is left, packed."""
    return bestfit.pack(docs, catalog.TOKENIZER, catalog.END_ID, 4096)


STAGES = [
    ("toxicity", without_toxic),
    ("line_dedup", without_common_lines),
    ("simhash", without_near_copies),
    ("decontamination", without_benchmark),
    ("packing", packed),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written and read again."""
    docs = catalog.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
