"""The completion stage: a prompt column in, a completion column out."""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..session import fresh_path, written
from .answers import AnswerLog, prompt_key
from .selection import not_done

ATTEMPTS = 3
SLICES = 16
Client = Callable[[str], str]


def pick_client(clients: Mapping[str, Client], vendor: str) -> Client:
    """The client of a vendor; clients are the user's, none is built in."""
    if vendor not in clients:
        raise ValueError(f"no client for vendor {vendor!r}")
    return clients[vendor]


def _asking(
    prompt: str, client: Client, attempts: int, wait_seconds: float, accept: Callable[[str], bool] | None, in_flight: int
) -> Column:
    """``completion, error, attempts`` of a prompt. Only the prompt goes through Python."""

    def ask(text):
        if not isinstance(text, str):
            return None, "no prompt", 0
        error = None
        for attempt in range(1, attempts + 1):
            try:
                reply = client(text)
                if accept is None or accept(reply):
                    return reply, None, attempt
                error = "reply not accepted"
            except Exception as e:  # kept as the row's error
                error = str(e)
            if wait_seconds and attempt < attempts:
                time.sleep(wait_seconds)
        return None, error, attempts

    @F.pandas_udf("completion string, error string, attempts int")
    def run(prompts: pd.Series) -> pd.DataFrame:
        if in_flight > 1:
            with ThreadPoolExecutor(in_flight) as calls:
                answers = list(calls.map(ask, prompts))
        else:
            answers = [ask(t) for t in prompts]
        return pd.DataFrame(answers, columns=["completion", "error", "attempts"])

    return run.asNondeterministic()(F.col(prompt))


def complete(
    df: DataFrame, prompt: str, client: Client, attempts: int = ATTEMPTS, wait_seconds: float = 0.0,
    concurrency: int | None = None, accept: Callable[[str], bool] | None = None, name: str = "completions",
    in_flight: int = 1, log: str | None = None, slices: int = SLICES, kept: Sequence[str] | None = None,
) -> DataFrame:
    """Call ``client`` for every prompt; adds ``completion``, ``error`` and ``attempts`` to the columns of ``df``, or to those in
    ``kept``: what is not kept, such as the prompt, is not written with the answers.

    A failing call is tried again, then kept as a row with its error, so one bad prompt never ends
    the job. ``accept`` turns away replies worth another try. ``concurrency`` caps the number of
    tasks; without it the input keeps its partitions. A task has up to ``in_flight`` calls under way
    at once, for which the client must bear threads. Answers are written to the shared folder before
    anything else reads them, so neither a lost executor nor a second action asks again for what is there.

    With ``log``, a folder, a whole job may break off and be started again: prompts are told apart by
    their texts, equal ones asked once, and asked in ``slices`` steps, each committed to the log. The
    next job with that log asks only what has no answer there, at most one slice of calls twice."""
    taken = {"completion", "error", "attempts"} & set(df.columns)
    if taken:
        raise ValueError(f"rename {sorted(taken)} first")
    dealt = (lambda rows: rows.repartition(concurrency)) if concurrency else (lambda rows: rows)
    answer = lambda column: _asking(column, client, attempts, wait_seconds, accept, in_flight)
    columns = [F.col(f"`{c}`") for c in (df.columns if kept is None else kept)]
    if log is None:
        answered = written(dealt(df).select(*columns, answer(prompt).alias("_answer")), name)
        return answered.select(*columns, "_answer.completion", "_answer.error", "_answer.attempts")

    answers = AnswerLog(df.sparkSession, log)
    needed = df if kept is None else df.select(*columns, *([] if prompt in kept else [prompt]))
    keyed = written(needed.withColumn("_prompt_key", prompt_key(prompt)), name)
    asked = keyed.filter(F.col("_prompt_key").isNotNull())
    todo = asked.select(F.col("_prompt_key").alias("prompt_key"), F.col(prompt).alias("_prompt")).dropDuplicates(["prompt_key"])
    for rows in _in_slices(not_done(todo, answers.answered(), ["prompt_key"]), slices, f"{name}-to-ask"):
        told = dealt(rows).select("prompt_key", answer("_prompt").alias("_answer"))
        answers.add(told.select("prompt_key", "_answer.*"))
    met = asked.join(answers.latest().withColumnRenamed("prompt_key", "_prompt_key"), "_prompt_key", "left")
    nothing = keyed.filter(F.col("_prompt_key").isNull()).select(
        *columns, F.lit(None).cast("string").alias("completion"), F.lit("no prompt").alias("error"), F.lit(0).alias("attempts"))
    return met.select(*columns, "completion", "error", "attempts").unionByName(nothing)


def _in_slices(todo: DataFrame, slices: int, name: str):
    """``todo`` (``prompt_key`` and its prompt) in up to ``slices`` parts of about equal size, each a folder of its own."""
    path = fresh_path(todo.sparkSession, name)
    numbered = todo.withColumn("_slice", F.pmod(F.xxhash64("prompt_key"), F.lit(slices)).cast("int"))
    numbered.hint("rebalance", "_slice").write.partitionBy("_slice").parquet(path)
    rows = todo.sparkSession.read.schema(numbered.schema).parquet(path)
    for row in rows.select("_slice").distinct().orderBy("_slice").collect():  # at most ``slices`` numbers
        yield rows.filter(F.col("_slice") == row["_slice"]).drop("_slice")


def failures(answered: DataFrame) -> DataFrame:
    """The rows that ended in an error, for the log."""
    return answered.filter(F.col("error").isNotNull())
