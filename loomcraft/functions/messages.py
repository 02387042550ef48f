"""Message expressions: chat templates, call blocks, system texts, roles within a record."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .jsons import let, object_text, quoted
from .text import _col, strip

# The texts and tags exported conversations carry.
TOOL_CALLER_INTRO = (
    "You are a function calling AI model. You are provided with function signatures within <tools> </tools> XML tags. "
    "You may call one or more functions to assist with the user query. "
    "Don't make assumptions about what values to plug into functions."
)
TOOL_CALLER_OUTRO = (
    "For each function call return a json object with function name and arguments within <tool_call> </tool_call> tags "
    "with the following schema:\n<tool_call>\n{'arguments': <args-dict>, 'name': <function-name>}\n</tool_call>\n"
)
PREFERENCE_OUTRO = TOOL_CALLER_OUTRO.replace("</tool_call> tags", "</tool_call> XML tags")
JSON_MODE_INTRO = "You are a helpful assistant that answers in JSON. Here's the json schema you must adhere to:"
END_OF_TEXT = "<|endoftext|>\n"
CHATML_START = "<|im_start|>"
CHATML_END = "<|im_end|>\n"
# Patterns of the blocks found in replies. The anchor keeps a text without the marker
# from being searched again from each of its characters.
LAST_ASSISTANT_TURN = {
    "chatml": r"(?s)\A.*<\|im_start\|>\s*assistant(.*)\z",
    "zephyr": r"(?s)\A.*<\|assistant\|>(.*)\z",
}
TOOL_CALL_XML = r"(?s)<tool_call>(.*?)(?:</tool_call>|\z)"
TOOL_CALL_FENCE = r"(?s)```tool_call\s*(\{.*?\})\s*```"
TOOLS_FENCE = r"(?s)```tools\s*([\[{].*?[\]}])\s*```"


def tool_caller_system(tools_json) -> Column:
    return F.concat(
        F.lit(TOOL_CALLER_INTRO + "\n<tools>\n"), _col(tools_json), F.lit("\n</tools>\n" + TOOL_CALLER_OUTRO)
    )


def preference_system(tools_json) -> Column:
    return F.concat(
        F.lit(TOOL_CALLER_INTRO + "\n<tools>\n"), _col(tools_json), F.lit("\n</tools>\n" + PREFERENCE_OUTRO)
    )


def json_mode_system(schema_json) -> Column:
    return F.concat(F.lit(JSON_MODE_INTRO + "\n<schema>\n"), _col(schema_json), F.lit("\n</schema>\n"))


def call_json(name, arguments) -> Column:
    """A call as JSON; ``arguments`` is JSON text already."""
    pairs = F.array(
        F.struct(F.lit("arguments").alias("key"), _col(arguments).alias("value")),
        F.struct(F.lit("name").alias("key"), quoted(name).alias("value")),
    )
    return object_text(pairs)


def tool_call_block(call) -> Column:
    return F.concat(F.lit("<tool_call>\n"), _col(call), F.lit("\n</tool_call>\n"))


def fenced_call_block(call) -> Column:
    return F.concat(F.lit("```tool_call\n"), _col(call), F.lit("\n```\n"))


def fenced_tools(tools_json) -> Column:
    return F.concat(F.lit("```tools\n"), _col(tools_json), F.lit("\n```"))


def tool_response_block(name, content) -> Column:
    """One tool result; ``content`` is JSON text and stands unquoted. A null name is empty, null content is ``null``."""
    return F.concat(
        F.lit('<tool_response>\n{"name": "'), F.coalesce(_col(name), F.lit("")), F.lit('", "content": '),
        F.coalesce(_col(content), F.lit("null")),
        F.lit("}\n</tool_response>\n"),
    )


def joined(items: Column) -> Column:
    return F.array_join(items, "")


def chatml_message(role, content) -> Column:
    """One message; a null role or content is empty, so no message is ever lost in joining."""
    empty = F.lit("")
    return F.concat(F.lit(CHATML_START), F.coalesce(_col(role), empty), F.lit("\n"), F.coalesce(_col(content), empty), F.lit(CHATML_END))


def chatml(messages, generation_prompt: bool = False) -> Column:
    """A message array as ChatML text, open for the assistant if asked."""
    text = joined(F.transform(_col(messages), lambda m: chatml_message(m["role"], m["content"])))
    return F.concat(text, F.lit(CHATML_START + "assistant\n")) if generation_prompt else text


def assistant_turn(completion, template: str = "chatml") -> Column:
    """What follows the last assistant marker; empty if there is none."""
    return strip(F.regexp_extract(_col(completion), LAST_ASSISTANT_TURN[template], 1))


def tool_call_texts(c) -> Column:
    """Contents of all ``<tool_call>`` elements; an unclosed last one counts."""
    found = F.regexp_extract_all(_col(c), F.lit(TOOL_CALL_XML), F.lit(1))
    return F.transform(found, strip)


def fenced_call_texts(c) -> Column:
    return F.regexp_extract_all(_col(c), F.lit(TOOL_CALL_FENCE), F.lit(1))


def fenced_tools_text(c) -> Column:
    """Content of the first ``tools`` fence (an object or a list), null if there is none."""
    found = F.regexp_extract(_col(c), TOOLS_FENCE, 1)
    return F.when(found != "", found)


def with_role(messages, role: str) -> Column:
    return F.filter(_col(messages), lambda m: m["role"] == role)


def last_content(messages: Column) -> Column:
    """Content of the last message, null content as empty text; null only where there is no message."""
    return let(messages, lambda m: F.when(F.size(m) > 0, F.coalesce(F.get(m, F.size(m) - 1)["content"], F.lit(""))))


def append_to_first(messages, addition) -> Column:
    """Put ``addition`` behind the content of the first message (a one-shot example)."""
    extra = _col(addition) if isinstance(addition, Column) else F.lit(addition)
    return F.transform(
        _col(messages),
        lambda m, i: F.struct(
            m["role"].alias("role"), F.when(i == 0, F.concat(m["content"], extra)).otherwise(m["content"]).alias("content")
        ),
    )


def reply_payload(envelope) -> Column:
    """Struct ``calls`` (JSON texts of the called functions) and ``content`` of a raw completion envelope.

    ``content`` is null where the reply calls functions."""
    shape = "struct<choices:array<struct<message:struct<content:string,tool_calls:array<struct<function:string>>>>>>"
    message = F.get(F.from_json(_col(envelope), shape)["choices"], F.lit(0))["message"]
    return let(
        message,
        lambda m: F.struct(
            F.transform(m["tool_calls"], lambda t: t["function"]).alias("calls"),
            F.when(F.coalesce(F.size(m["tool_calls"]), F.lit(0)) <= 0, m["content"]).alias("content"),
        ),
    )


def preference_row(system, question, chosen, rejected) -> list[Column]:
    """Prompt and endings of one preference example, as a trainer reads them."""
    user = F.concat(chatml_message(F.lit("user"), question), F.lit(CHATML_START + "assistant\n"))
    head = F.when(F.length(_col(system)) > 0, chatml_message(F.lit("system"), system)).otherwise(F.lit(""))
    return [
        F.concat(head, user).alias("prompt"),
        F.concat(_col(chosen), F.lit(END_OF_TEXT)).alias("chosen"),
        F.concat(_col(rejected), F.lit(END_OF_TEXT)).alias("rejected"),
    ]
