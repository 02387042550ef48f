"""Conversations: records with nested messages, and tables with one row per turn."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import messages as M
from ..functions.tools import record_verdicts
from ..functions.jsons import array_text
from .binding import bind
from .prefix import PART_ROWS, concat_by_position

_RECORD = (
    "struct<messages:array<struct<role:string,content:string,name:string,tool_call_id:string,"
    "tool_calls:array<struct<id:string,type:string,function:struct<name:string,arguments:variant>>>>>,tools:array<string>>"
)


def _message(m: Column) -> Column:
    def call(c):
        arguments = c["function"]["arguments"]
        text = F.when(F.schema_of_variant(arguments) == "STRING", F.try_variant_get(arguments, "$", "string"))
        return F.struct(
            c["id"].alias("id"), c["type"].alias("type"),
            F.struct(c["function"]["name"].alias("name"), text.alias("arguments")).alias("function"),
        )

    return F.struct(
        m["role"].alias("role"), m["content"].alias("content"), m["name"].alias("name"),
        m["tool_call_id"].alias("tool_call_id"), F.transform(m["tool_calls"], call).alias("tool_calls"),
    )


def parse_records(df: DataFrame, record: str = "record") -> DataFrame:
    """Tool-call records from JSON text: adds ``messages`` (an array of wide structs) and ``tools`` (JSON texts).

    ``content`` keeps strings as they are and everything else as JSON text; ``arguments`` is null
    unless it is a JSON string, as a call must carry it."""
    parsed = bind(df, _record=F.from_json(F.col(record), _RECORD))
    return bind(
        parsed, messages=F.transform(F.col("_record.messages"), _message), tools=F.col("_record.tools")).drop("_record")


def calls_text(tool_calls: Column) -> Column:
    """``<tool_call>`` blocks of a call array."""
    return M.joined(F.transform(
        tool_calls, lambda c: M.tool_call_block(M.call_json(c["function"]["name"], c["function"]["arguments"]))))


def _turn(sender: str, value: Column) -> Column:
    return F.struct(F.lit(sender).alias("from"), value.alias("value"))


def last_tool_calls(messages: Column) -> Column:
    """The calls of the last assistant message that has any, null where none has."""
    calling = F.filter(messages, lambda m: (m["role"] == "assistant") & m["tool_calls"].isNotNull())
    return F.try_element_at(calling, F.lit(-1))["tool_calls"]


def sharegpt_conversation(
    messages: Column, tools: Column, turn: str = "multi", last_calls: Column | None = None, verdicts: Column | None = None
) -> Column:
    """A record as a ShareGPT conversation, null if its last calls fail or nobody asks anything.

    Last user message, last tool calls, all tool results, last summary. ``single`` stops at the
    calls, or at the answer where there are none. Last calls and their verdicts may be given as columns."""
    if turn not in ("multi", "single"):
        raise ValueError(f"turn must be multi or single, not {turn!r}")
    summaries = F.filter(messages, lambda m: (m["role"] == "assistant") & m["tool_calls"].isNull())
    results = M.joined(F.transform(
        M.with_role(messages, "tool"), lambda m: M.tool_response_block(m["name"], m["content"])))
    last_calls = last_tool_calls(messages) if last_calls is None else last_calls
    has_calls = last_calls.isNotNull()
    verdicts = record_verdicts(last_calls, tools) if verdicts is None else verdicts
    fine = F.coalesce(F.forall(verdicts, lambda v: v["status"] == "accepted"), F.lit(True))
    asked = M.last_content(M.with_role(messages, "user"))
    summary = M.last_content(summaries)
    nothing = F.lit(None).cast("struct<from:string,value:string>")
    turns = [
        _turn("system", M.tool_caller_system(array_text(tools))),
        _turn("human", asked),
        F.when(has_calls, _turn("gpt", calls_text(last_calls))).otherwise(nothing),
    ]
    if turn == "multi":
        turns.append(F.when(results != "", _turn("tool", results)).otherwise(nothing))
        turns.append(F.when(F.size(summaries) > 0, _turn("gpt", summary)).otherwise(nothing))
    else:
        turns.append(F.when(~has_calls & (F.size(summaries) > 0), _turn("gpt", summary)).otherwise(nothing))
    return F.when(fine & asked.isNotNull(), F.filter(F.array(*turns), lambda t: t.isNotNull()))


def last_by_role(turns: DataFrame, key: str = "conv_id", order: str = "turn", role: str = "role",
                 content: str = "text", roles: Sequence[str] = ("user", "assistant")) -> DataFrame:
    """The last content of each role per conversation. State per key is one value a role, so hot keys are fine."""
    return turns.groupBy(key).agg(*[
        F.max_by(F.col(content), F.when(F.col(role) == r, F.col(order))).alias(f"last_{r}") for r in roles
    ])


def assemble_turns(turns: DataFrame, key: str = "conv_id", order: str = "turn", role: str = "role",
                   content: str = "text", calls: str | None = None) -> DataFrame:
    """Last user message, last tool calls and last summary per conversation, from one row per turn.

    ``calls`` is a text column, null on assistant turns that call nothing. Tool results are not
    collected here: ``tool_responses`` gives them in parts a task can hold."""
    said = F.coalesce(F.col(content), F.lit(""))  # a turn without text is a turn
    of = lambda test: F.max_by(said, F.when(test, F.col(order)))
    by = F.col(role)
    calling = F.col(calls).isNotNull() if calls else F.lit(False)
    columns = [
        of(by == "user").alias("human"),
        of((by == "assistant") & ~calling).alias("summary"),
    ]
    if calls:
        columns.append(F.max_by(F.col(calls), F.when((by == "assistant") & calling, F.col(order))).alias("calls"))
    return turns.groupBy(key).agg(*columns)


def tool_responses(turns: DataFrame, key: str = "conv_id", order: str = "turn", role: str = "role",
                   name: str = "name", content: str = "text", part_rows: int = PART_ROWS) -> DataFrame:
    """All tool results of a conversation as response blocks, one row per conversation and part of ``part_rows`` results."""
    tool = turns.filter(F.col(role) == "tool")
    return concat_by_position(
        tool, [key], order, M.tool_response_block(F.col(name), F.col(content)), "tool", part_rows=part_rows
    )


def chatml_by_conversation(turns: DataFrame, key: str = "conv_id", order: str = "turn", role: str = "role",
                           content: str = "text", part_rows: int = PART_ROWS) -> DataFrame:
    """Whole conversations as ChatML, one row per conversation and part of ``part_rows`` turns."""
    return concat_by_position(turns, [key], order, M.chatml_message(role, content), "chatml", part_rows=part_rows)
