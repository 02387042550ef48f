"""Exporting chat data sets from record trees, and scoring runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import messages as M
from ..functions.jsons import array_text, is_empty_value, let, quoted
from ..functions.tools import record_verdicts
from ..operators.binding import bind, keep
from ..operators.completion import Client, complete
from ..operators.conversations import assemble_turns, last_tool_calls, parse_records, sharegpt_conversation, tool_responses
from ..operators.prefix import PART_ROWS
from ..operators.schema_check import validate_json
from ..operators.scoring import score_completions
from ..operators.selection import with_side_sets
from ..sources.scans import scan_dataset


def export_sharegpt(records: DataFrame, turn: str = "multi", *side_sets: DataFrame | None) -> DataFrame:
    """ShareGPT rows ``id, conversations, category, subcategory, task`` of the records whose calls hold.

    All of it happens inside the row: scan, filter, write."""
    parsed = bind(parse_records(records), _calls=last_tool_calls(F.col("messages")))
    judged = bind(parsed, _verdicts=record_verdicts("_calls", "tools"))
    conversation = sharegpt_conversation(F.col("messages"), F.col("tools"), turn, F.col("_calls"), F.col("_verdicts"))
    good = keep(judged, "conversations", conversation).select(
        "id", "conversations", "category", "subcategory", "task")
    return with_side_sets(good, *side_sets)


def export_turns(
    turns: DataFrame, turn: str = "multi", tools_json: str = "[]", calls: str | None = None, part_rows: int = PART_ROWS
) -> DataFrame:
    """The same from a table with one row per turn (``conv_id, turn, role, [name,] text, [calls]``).

    ``multi``: the turns of each conversation, ``conv_id, position, part, from, value``. Position 0 is the
    system message, 1 what was asked, 2 the last calls, 3 all tool results in parts of ``part_rows``, 4 the
    last summary; what a conversation has none of has no row. Null texts are empty ones.
    ``single``: one row per conversation, ``conv_id, system, human, [calls,] summary``, the summary only
    where nothing is called."""
    if turn not in ("multi", "single"):
        raise ValueError(f"turn must be multi or single, not {turn!r}")
    assembled = turn_columns(turns, tools_json, calls)
    if turn == "single":
        if calls:
            assembled = assembled.withColumn("summary", F.when(F.col("calls").isNull(), F.col("summary")))
        return assembled
    said = lambda position, sender, value: F.struct(
        F.lit(position).alias("position"), F.lit(0).cast("long").alias("part"), F.lit(sender).alias("from"), value.alias("value"))
    around = F.array(
        said(0, "system", F.col("system")), said(1, "human", F.col("human")),
        said(2, "gpt", F.col("calls") if calls else F.lit(None).cast("string")), said(4, "gpt", F.col("summary")))
    rows = assembled.select("conv_id", F.inline(F.filter(around, lambda t: t["value"].isNotNull())))
    if "name" not in turns.columns:
        turns = turns.withColumn("name", F.lit(None).cast("string"))
    asked = assembled.select(F.col("conv_id").alias("_asked"))
    results = tool_responses(turns, part_rows=part_rows)
    results = results.join(asked, F.col("conv_id").eqNullSafe(F.col("_asked")), "left_semi")
    return rows.unionByName(results.select(
        "conv_id", F.lit(3).alias("position"), "part", F.lit("tool").alias("from"), F.col("tool").alias("value")))


def turn_columns(turns: DataFrame, tools_json: str = "[]", calls: str | None = None) -> DataFrame:
    """System message, last user message, [last calls,] and last summary, one row per conversation in which
    somebody asks. Tool results are not among them: ``export_turns`` gives them in parts."""
    assembled = assemble_turns(turns, calls=calls).filter(F.col("human").isNotNull())
    return assembled.withColumn("system", M.tool_caller_system(F.lit(tools_json)))


def json_mode_parts(record: Column) -> dict[str, Column]:
    """User message, assistant object and schema (JSON texts) of a JSON-mode record."""
    raw = F.from_json(F.get_json_object(record, "$.messages"), "array<string>")
    last = lambda role: let(
        F.filter(raw, lambda m: F.get_json_object(m, "$.role") == role),
        lambda m: F.when(F.size(m) > 0, F.get(m, F.size(m) - 1)))

    def content_json(message):
        content = F.get_json_object(message, "$.content")
        is_text = F.schema_of_variant(F.try_variant_get(F.try_parse_json(message), "$.content", "variant")) == "STRING"
        return F.when(is_text, quoted(content)).otherwise(content)

    return {
        "user": F.get_json_object(last("user"), "$.content"),
        "json_object": let(last("assistant"), content_json),
        "json_schema": F.get_json_object(record, "$.pydantic_schema"),
    }


def json_mode_conversation(user: str, json_object: str, json_schema: str) -> Column:
    turn = lambda sender, value: F.struct(F.lit(sender).alias("from"), value.alias("value"))
    return F.array(
        turn("system", M.json_mode_system(json_schema)), turn("human", F.col(user)), turn("gpt", F.col(json_object)))


def export_json_mode(records: DataFrame) -> DataFrame:
    """ShareGPT rows ``id, conversations, category, subcategory, schema`` of the JSON-mode records whose
    object fits its schema; empty objects and empty schemas are left out."""
    parts = bind(records, **json_mode_parts(F.col("record"))).drop("record")
    usable = parts.filter(
        F.col("user").isNotNull() & ~is_empty_value("json_object") & ~is_empty_value("json_schema"))
    valid = validate_json(usable, "json_object", "json_schema").filter("valid")
    return valid.select(
        "id", json_mode_conversation("user", "json_object", "json_schema").alias("conversations"),
        "category", "subcategory", F.col("json_schema").alias("schema"),
    )


def evaluate(
    samples: DataFrame, client: Client | None = None, template: str = "chatml", one_shot: str | None = None,
    concurrency: int | None = None,
) -> DataFrame:
    """Score samples (``prompt, completion, system, user``). With a client its answers to the rendered
    prompts are scored, else the column ``model_output`` is."""
    if one_shot:
        samples = samples.withColumn("prompt", M.append_to_first("prompt", one_shot))
    if client is not None:
        rendered = samples.withColumn("_prompt", M.chatml("prompt", generation_prompt=True))
        rendered = rendered.withColumnRenamed("completion", "_expected")
        answered = complete(rendered, "_prompt", client, concurrency=concurrency, name="model-outputs")
        output = F.concat("_prompt", F.coalesce("completion", F.lit("")))
        samples = answered.withColumn("model_output", output).drop("_prompt", "completion", "error", "attempts")
        samples = samples.withColumnRenamed("_expected", "completion")
    return score_completions(samples, template=template)


def evaluate_dataset(
    spark: SparkSession, path: str, client: Client | None = None, num_samples: int | None = None, fmt: str = "parquet",
    template: str = "chatml", one_shot: str | None = None, concurrency: int | None = None,
) -> DataFrame:
    """``evaluate`` over a published data set; with ``num_samples`` over its first rows, and no others are read or asked."""
    samples = scan_dataset(spark, path, fmt, num_samples)
    return evaluate(samples, client, template, one_shot, concurrency)


def records_text(messages: Column, tools: Column) -> Column:
    """A record's JSON text from arrays of message and tool texts."""
    return F.concat(F.lit('{"messages":'), array_text(messages), F.lit(',"tools":'), array_text(tools), F.lit("}"))
