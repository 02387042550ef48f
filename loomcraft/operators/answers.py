"""Answers that outlast a job: a log by digest of the prompt."""

from __future__ import annotations

import time
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

_ANSWERS = "prompt_key string, completion string, error string, attempts int, slice string"
_COMMITS = "slice string, answers long"


def prompt_key(prompt: str):
    """Prompts with one key are one prompt; null for none."""
    return F.sha2(F.col(prompt), 256)


class AnswerLog:
    """Answers and errors by ``prompt_key``, below ``path``, added in slices.

    A slice's rows are appended, then the row that commits it. Rows of a slice without such a row were left by a job that
    broke off and count for nothing. Nothing is ever rewritten, so several jobs may add to one log."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def _read(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def rows(self) -> DataFrame:
        """The committed rows: every answer, and the errors of every job."""
        return self._read("answers", _ANSWERS).join(self._read("commits", _COMMITS), "slice", "left_semi")

    def add(self, answered: DataFrame) -> None:
        """Append ``prompt_key, completion, error, attempts`` as one slice; slice names sort by time."""
        name = f"{time.time_ns():020d}-{uuid.uuid4().hex}"
        columns = ["prompt_key", "completion", "error", "attempts"]
        answered.select(*columns).withColumn("slice", F.lit(name)).write.mode("append").parquet(f"{self.path}/answers")
        own = self._read("answers", _ANSWERS).filter(F.col("slice") == name)
        own.agg(F.lit(name).alias("slice"), F.count("*").alias("answers")).write.mode("append").parquet(f"{self.path}/commits")

    def answered(self) -> DataFrame:
        """The keys that need not be asked again. Errors are no answers: the next job asks these prompts anew."""
        return self.rows().filter(F.col("error").isNull()).select("prompt_key")

    def latest(self) -> DataFrame:
        """One row a key: its answer if there is one, else its last error.

        Only keys and slice names are aggregated; texts meet the winners in a join."""
        rows = self.rows()
        rank = F.struct(F.col("error").isNull().alias("good"), "slice")
        winners = rows.groupBy("prompt_key").agg(F.max(rank)["slice"].alias("slice"))
        return rows.join(winners, ["prompt_key", "slice"], "left_semi").drop("slice")
