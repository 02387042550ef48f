"""Reading matter for tasks: searched once, kept, and read from there ever after."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window, functions as F

from ..operators.packing import usable_documents
from ..operators.pages import extract_pages
from ..operators.selection import merged_results, not_done
from ..session import written

RESULTS = 10
Search = Callable[[DataFrame], "tuple[DataFrame, DataFrame | None]"]
Fetch = Callable[[DataFrame], DataFrame]
_DOCUMENTS = "task_key {key}, rank long, url string, content string, tables array<array<array<string>>>, run string"
_COMPLETE = "task_key {key}, documents long, run string"


class DocumentCache:
    """The documents found for tasks, below ``path``.

    A run adds its documents, then one row for each of its tasks, also for those nothing was found for. Only tasks with
    such a row are known, and only documents of the run that it names are read: what a run that broke off has left counts for nothing."""

    def __init__(self, tasks: DataFrame, path: str) -> None:
        self.spark, self.path = tasks.sparkSession, path
        self.key = tasks.schema["task_key"].dataType.simpleString()

    def _read(self, name: str, schema: str) -> DataFrame:
        schema = schema.format(key=self.key)
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def complete(self) -> DataFrame:
        """One row a known task; of runs that overlapped the one with the least name counts."""
        rows = self._read("complete", _COMPLETE)
        return rows.groupBy("task_key").agg(F.min("run").alias("run"))

    def add(self, documents: DataFrame, tasks: DataFrame) -> None:
        run = uuid.uuid4().hex
        columns = ["task_key", "rank", "url", "content", "tables"]
        documents.select(*columns).withColumn("run", F.lit(run)).write.mode("append").parquet(f"{self.path}/documents")
        own = self._read("documents", _DOCUMENTS).filter(F.col("run") == run).groupBy("task_key").agg(F.count("*").alias("documents"))
        counted = tasks.select("task_key").distinct().join(own, "task_key", "left")
        counted.select("task_key", F.coalesce("documents", F.lit(0)).alias("documents"), F.lit(run).alias("run")).write.mode(
            "append").parquet(f"{self.path}/complete")

    def documents(self, tasks: DataFrame) -> DataFrame:
        """``task_key, rank, url, content, tables`` of the tasks that are known."""
        wanted = self.complete().join(tasks.select("task_key").distinct(), "task_key")
        return self._read("documents", _DOCUMENTS).join(wanted, ["task_key", "run"]).drop("run")


def ranked_results(first: DataFrame, second: DataFrame | None, num_results: int = RESULTS) -> DataFrame:
    """Two engines' lists (``task_key, position, url``) as one, ``task_key, rank, url``: the best ``num_results`` of each, ranks
    from 0 without gaps. A task has twice ``num_results`` rows at most, so its rows can be numbered in one window."""
    best = lambda rows: rows.filter(F.col("position") < num_results) if rows is not None else None
    merged = merged_results(best(first), best(second), ["task_key"], "position", "url")
    order = Window.partitionBy("task_key").orderBy("engine", "position", "url")
    return merged.select("task_key", (F.row_number().over(order) - 1).cast("long").alias("rank"), "url")


def gather_documents(tasks: DataFrame, search: Search, fetch: Fetch, path: str, num_results: int = RESULTS) -> DataFrame:
    """The documents of all ``tasks`` (``task_key``): those known from earlier runs as they are, the others searched for now.

    ``search`` gets the tasks that are not known and gives one or two lists ``task_key, position, url``, positions from 0; ``fetch``
    gets distinct ``url`` and gives ``url, html``. A page that many tasks found is fetched and read once. Pages without
    text, and urls without a page, leave a gap in the ranks. Gives ``task_key, rank, url, content, tables``."""
    cache = DocumentCache(tasks, path)
    missing = written(not_done(tasks, cache.complete(), ["task_key"]).dropDuplicates(["task_key"]), "tasks-to-search")
    if not missing.isEmpty():
        found = written(ranked_results(*search(missing), num_results), "search-results")
        pages = extract_pages(fetch(found.select("url").distinct()).select("url", "html").dropDuplicates(["url"]))
        documents = found.join(usable_documents(pages).filter(F.length("content") > 0), "url")
        cache.add(documents, missing)
    return cache.documents(tasks)
