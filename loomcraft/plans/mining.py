"""From source files to checked JSON-mode records: a task is mined from a file, a record made for it with the file to read."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.jsons import salvaged
from ..functions.text import task_file_name
from ..operators.binding import bind
from ..operators.completion import ATTEMPTS, Client, complete
from ..operators.prompts import mining_prompt, section_prompt
from ..operators.schema_check import schema_verdict
from ..operators.shelf import KEY, shelved, with_text
from ..session import written
from .export import json_mode_parts

REMARK = "\nAnswer %d could not be used: "
NO_TASK = "no usable task"
NO_OBJECT = "no object with a schema"
_STATE = [KEY, "path", "task_json", "fault"]


def _field(task_json: str, name: str) -> Column:
    """A field of a task, which models write with a capital or without."""
    return F.coalesce(F.get_json_object(task_json, f"$.{name}"), F.get_json_object(task_json, f"$.{name.lower()}"))


def mine_and_generate(
    code: DataFrame, examples: Sequence[str], task_schema: str, sections: Mapping[str, str], output_schema: str, client: Client,
    known: DataFrame | None = None, attempts: int = ATTEMPTS, tell_fault: bool = False, concurrency: int | None = None,
    in_flight: int = 1, log: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Records for source files (``path, code``, a row per path): ``path, task_file, task_json, record, json_object, rounds``,
    and the files without one: ``path, task_file, task_json, fault, rounds``.

    A row goes through the rounds with what it has got so far: without a task it is asked for one, with one (mined now, in
    an earlier round, or ``known`` as ``path, task_json`` from an earlier job) for a record, in the same round. The record's object has to fit the
    record's schema. Only rows without such a record see the next round; each round is written, its calls are made once. Code is
    written once (``operators/shelf``), in parts of bounded size, so that the batches of files a Python worker holds don't grow with
    their number; what rounds write are tasks, faults and records, no code and no prompts.
    ``tell_fault`` ends a prompt that is asked again with the round and what was wrong. ``log`` keeps answers for a job started
    again (``complete``); a log gives one answer a prompt, so it needs ``tell_fault``.

    Null code is empty code. Rows are told apart by ``path``; ``task_file`` is a label, which files of one name share."""
    if log is not None and not tell_fault:
        raise ValueError("with a log, prompts asked again must differ: set tell_fault")
    none = F.lit(None).cast("string")
    rows, texts = shelved(code.select("path", F.coalesce("code", F.lit("")).alias("code")), "code", "mined_code")
    if known is None:
        rows = rows.withColumn("task_json", none)
    else:
        rows = rows.join(known.select("path", "task_json").dropDuplicates(["path"]), "path", "left")
    todo = rows.withColumn("fault", none).select(_STATE)
    ask = lambda rows, prompt, name, kept: complete(
        with_text(rows, texts).withColumn("prompt", prompt), "prompt", client, attempts=1, concurrency=concurrency, name=name,
        in_flight=in_flight, log=log, kept=kept)
    told = lambda name, other="": F.coalesce(_field("task_json", name), F.lit(other))
    for_task = mining_prompt("code", examples, task_schema)
    for_record = section_prompt(sections, {
        "category": told("Category"), "subcategory": told("SubCategory"), "task": told("Task"), "task_schema": told("Schema", "None"),
        "doc_list": "code", "examples": F.lit(""), "pydantic_schema": F.lit(output_schema)})
    label = task_file_name("path").alias("task_file")
    accepted = None
    for turn in range(1, attempts + 1):
        rounds = F.lit(turn).alias("rounds")
        remark = F.coalesce(F.concat(F.lit(REMARK % (turn - 1)), "fault"), F.lit("")) if tell_fault else F.lit("")
        asked = ask(todo.filter(F.col("task_json").isNull()), F.concat(for_task, remark), "mined", [KEY, "path"])
        mined = bind(asked, _task=salvaged("completion"))
        mined = mined.withColumn("task_json", F.when(_field("_task", "Task").isNotNull(), F.col("_task")))
        mined = mined.withColumn("fault", F.when(F.col("task_json").isNull(), F.coalesce("error", F.lit(NO_TASK))))
        tasked = mined.select(_STATE).unionByName(todo.filter(F.col("task_json").isNotNull()).select(_STATE))
        tasked = written(tasked, "tasks")
        ready = tasked.filter(F.col("task_json").isNotNull())
        replies = bind(ask(ready, F.concat(for_record, remark), "records", [KEY, "path", "task_json"]), record=salvaged("completion"))
        parts = bind(replies, **json_mode_parts(F.col("record")))
        verdict = bind(parts, _verdict=schema_verdict("json_object", "json_schema"))
        fits = F.coalesce(F.col("_verdict.valid"), F.lit(False)) & F.col("json_object").isNotNull() & F.col("json_schema").isNotNull()
        missing = F.when(F.col("json_object").isNull() | F.col("json_schema").isNull(), F.lit(NO_OBJECT))
        wrong = F.coalesce("error", missing, F.col("_verdict.error"), F.lit("object does not fit its schema"))
        judged = verdict.select(KEY, "path", "task_json", F.when(~fits, wrong).alias("fault"), *[
            F.when(fits, F.col(c)).alias(c) for c in ("record", "json_object")])
        judged = written(judged, "judged")
        fine = judged.filter(F.col("fault").isNull()).select("path", label, "task_json", "record", "json_object", rounds)
        accepted = fine if accepted is None else accepted.unionByName(fine)
        todo = judged.filter(F.col("fault").isNotNull()).select(_STATE).unionByName(tasked.filter(F.col("task_json").isNull()))
        if turn == attempts or todo.isEmpty():
            return accepted, todo.select("path", label, "task_json", "fault", rounds)
    raise ValueError("attempts must be at least 1")
