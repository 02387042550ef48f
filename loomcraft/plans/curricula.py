"""Making task lists: from source files, from an industry sheet; adding detail to user messages."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.jsons import entries, is_json, last_or_null, quoted
from ..functions.text import task_file_name
from ..operators.binding import bind
from ..operators.completion import ATTEMPTS, Client, complete
from ..operators.prefix import forward_fill
from ..operators.prompts import enrichment_prompt, industry_prompt, mining_prompt
from ..operators.replies import parse_replies
from ..operators.schema_check import validate_json
from ..operators.selection import not_done, skip_rows
from ..operators.validation import task_schemas_present
from ..session import written
from .export import json_mode_parts

# Fixed value: rows at the head of the published industry list that are not used; callers pass it.
SKIPPED_ROWS = 5
SHEET = ("Sector", "Industry Group", "Industry", "Sub-Industry")


def mine_tasks(
    code: DataFrame, examples: Sequence[str], schema_text: str, client: Client, done: DataFrame | None = None,
    concurrency: int | None = None,
) -> DataFrame:
    """A task per source file (``path, code``): ``task_file, path, task_json``; files in ``done`` are left out."""
    named = code.withColumn("task_file", task_file_name("path"))
    if done is not None:
        named = not_done(named, done, ["task_file"])
    prompted = named.select("task_file", "path", mining_prompt("code", examples, schema_text).alias("prompt"))
    answered = complete(prompted, "prompt", client, concurrency=concurrency, name="mined-tasks")
    good, _ = parse_replies(answered, "completion", "task_json")
    return good.select("task_file", "path", "task_json")


def valid_objects(records: DataFrame, record: str = "record") -> DataFrame:
    """The assistant's object of each JSON-mode record with whether it fits the record's schema."""
    parts = json_mode_parts(F.col(record))
    named = bind(records, json_object=parts["json_object"], json_schema=parts["json_schema"])
    return validate_json(named, "json_object", "json_schema")


def retry_invalid(
    prompts: DataFrame, key: str, prompt: str, client: Client, attempts: int = ATTEMPTS, concurrency: int | None = None
) -> DataFrame:
    """JSON-mode records for ``prompts``; rows whose object does not fit its schema are asked again, alone."""
    accepted, todo = None, prompts.select(key, prompt)
    for _ in range(attempts):
        answered = complete(todo, prompt, client, attempts=1, concurrency=concurrency, name="checked-records")
        good, _ = parse_replies(answered, "completion", "record")
        checked = valid_objects(good)
        fine = written(checked.filter("valid").select(key, "record", "json_object"), "accepted")
        accepted = fine if accepted is None else accepted.unionByName(fine)
        todo = written(not_done(todo, fine, [key]), "to-ask-again")
        if todo.isEmpty():
            break
    return accepted


def industry_tasks(rows: DataFrame, ordinal: str = "ordinal", skip: int = 0) -> DataFrame:
    """Curriculum rows of an industry sheet: merged cells filled down, columns renamed, the first ``skip`` rows left out."""
    filled = forward_fill(rows, SHEET, ordinal)
    group, industry, sub = (F.col(f"`{c}`") for c in SHEET[1:])
    line = F.concat(
        F.lit('{"Category":'), quoted(group), F.lit(',"SubCategory":'), quoted(industry), F.lit(',"Task":'), quoted(sub), F.lit("}")
    )
    named = filled.select(
        ordinal, group.alias("category"), industry.alias("subcategory"), sub.alias("task"), line.alias("task_json")
    )
    return skip_rows(named, skip, ordinal)


def generate_industry_tasks(
    rows: DataFrame, examples: str, schema_text: str, client: Client, concurrency: int | None = None, skip: int = 0
) -> DataFrame:
    """Five tasks with schemas per industry row: ``ordinal, position, task_json``. A reply in which any
    task lacks its schema is not used."""
    tasks = industry_tasks(rows, skip=skip).withColumn("prompt", industry_prompt("task_json", examples, schema_text))
    answered = complete(tasks.select("ordinal", "prompt"), "prompt", client, concurrency=concurrency, name="industry-tasks")
    good, _ = parse_replies(answered, "completion")
    usable = good.filter(task_schemas_present("reply"))
    listed = F.from_json(F.get_json_object("reply", "$.Tasks"), "array<string>")
    return usable.select("ordinal", F.posexplode(listed).alias("position", "task_json"))


def updated_message(completion: str = "completion"):
    """The new user message in a reply, null if there is none."""
    return F.when(is_json(completion), F.try_variant_get(
        last_or_null(entries(completion), F.lit("updated_message")), "$", "string"))


def enrich_queries(
    data: DataFrame, client: Client, examples: Sequence[Mapping[str, str]] = (), conversations: str = "conversations",
    concurrency: int | None = None,
) -> DataFrame:
    """Replace the user's turn (the second) of each conversation by one with all details of the answer's
    object. Rows for which no usable reply came keep their message."""
    said = lambda i: F.get(F.col(conversations), F.lit(i))["value"]
    prompted = data.withColumn("prompt", enrichment_prompt(said(1), said(2), examples))
    answered = complete(prompted, "prompt", client, concurrency=concurrency, name="enriched", accept=_is_json_text)
    message = updated_message()
    turns = F.transform(
        F.col(conversations),
        lambda t, i: F.struct(t["from"].alias("from"), F.when(i == 1, F.coalesce(F.col("_message"), t["value"]))
                              .otherwise(t["value"]).alias("value")),
    )
    return answered.withColumn("_message", message).withColumn(conversations, turns).select(*data.columns)


def _is_json_text(text: str) -> bool:
    try:
        json.loads(text)
        return True
    except ValueError:
        return False
