"""Reading model replies: JSON objects and tool calls."""

from __future__ import annotations

import ast
import json

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.jsons import is_json, salvaged
from ..functions.messages import assistant_turn, fenced_call_texts, fenced_tools_text, tool_call_texts
from .binding import bind


def parse_replies(df: DataFrame, completion: str, out: str = "reply") -> tuple[DataFrame, DataFrame]:
    """Replies with their JSON text, and the replies that hold no usable JSON."""
    parsed = bind(df, **{out: salvaged(completion)})
    return parsed.filter(F.col(out).isNotNull()), parsed.filter(F.col(out).isNull()).drop(out)


def _literal_json(text):
    try:
        return json.dumps(ast.literal_eval(text))
    except Exception:  # not a literal either: the block is skipped
        return None


@F.pandas_udf(T.ArrayType(T.StringType()))
def _literals(blocks: pd.Series) -> pd.Series:
    return blocks.map(lambda b: None if b is None else [None if x is None else _literal_json(x) for x in b])


def with_blocks(df: DataFrame, blocks: Column, out: str) -> DataFrame:
    """Add ``out``, the JSON texts of the blocks; blocks that are Python literals are rewritten, others dropped.

    JSON stays in the JVM. Python is handed only the blocks that are not JSON, null for every row
    that has none."""
    found = bind(df, _blocks=blocks)
    marked = bind(found, _json=F.transform("_blocks", lambda b: F.when(is_json(b), b)))
    others = F.zip_with("_blocks", "_json", lambda b, j: F.when(j.isNull(), b))
    marked = marked.withColumn("_others", F.when(F.exists("_json", lambda j: j.isNull()), others))
    read = marked.withColumn("_literals", _literals("_others"))
    merged = F.when(F.col("_literals").isNull(), F.col("_json")).otherwise(
        F.zip_with("_json", "_literals", lambda j, x: F.coalesce(j, x)))
    return bind(read, **{out: F.filter(merged, lambda x: x.isNotNull())}).drop(
        "_blocks", "_json", "_others", "_literals")


def with_fenced_calls(df: DataFrame, content: str, out: str = "calls") -> DataFrame:
    """All fenced ``tool_call`` blocks of a text."""
    return with_blocks(df, fenced_call_texts(content), out)


def with_fenced_tools(df: DataFrame, content: str, out: str = "tools") -> DataFrame:
    """The first fenced ``tools`` block of a text, null if there is none or it cannot be read."""
    block = F.filter(F.array(fenced_tools_text(content)), lambda b: b.isNotNull())
    return with_blocks(df, block, "_tools").withColumn(out, F.get("_tools", F.lit(0))).drop("_tools")


def with_tool_calls(df: DataFrame, completion: str, template: str = "chatml", out: str = "calls") -> DataFrame:
    """``assistant_message`` and the ``<tool_call>`` elements in it; ``parsed`` if there is at least one."""
    turn = bind(df, assistant_message=assistant_turn(completion, template))
    return with_blocks(turn, tool_call_texts("assistant_message"), out).withColumn("parsed", F.size(out) > 0)
