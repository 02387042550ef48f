"""Tool admission and tool-call validation over tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import tools as T
from ..functions.jsons import entries, is_json, last_or_null, let, python_type, variant_field
from .binding import bind


def admit_tools(tools: DataFrame, signature: str = "signature") -> tuple[DataFrame, DataFrame]:
    """Usable tools, and the others with the ``reason`` they were turned away."""
    checked = bind(tools, reason=T.rejection_reason(signature))
    return checked.filter(F.col("reason").isNull()).drop("reason"), checked.filter(F.col("reason").isNotNull())


def signature_table(tools: DataFrame, scope: Sequence[str] = (), position: str = "position",
                    signature: str = "signature") -> DataFrame:
    """One compiled signature per scope and function name: the first admitted one."""
    usable, _ = admit_tools(tools, signature)
    named = usable.withColumn("name", T.signature_name(signature))
    first = named.groupBy(*scope, "name").agg(F.min_by(signature, position).alias(signature))
    return bind(first, compiled=T.compiled_signature(signature))


def validate_calls(calls: DataFrame, signatures: DataFrame, scope: Sequence[str] = (), name: str = "name",
                   arguments: str = "arguments") -> DataFrame:
    """Every call with ``status`` and ``message``; calls of an unknown function are kept as failures.

    ``signatures`` comes from ``signature_table``. The join is left to Spark: a small signature table
    is broadcast once its size is known, a large one is shuffled and AQE splits the hot names."""
    table = signatures.select(*scope, F.col("name").alias(name), "compiled")
    joined = calls.join(table, [*scope, name], "left")
    verdict = T.call_verdict(F.col(name), F.col(arguments), F.col("compiled"))
    checked = bind(joined, _verdict=verdict).drop("compiled")
    return checked.select("*", "_verdict.status", "_verdict.message").drop("_verdict")


def verdicts_by(validated: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Calls, failures and the any-failed flag per key. Counts only, so a hot key costs nothing."""
    failed = F.col("status") == "failed"
    return validated.groupBy(*keys).agg(
        F.count("*").alias("n_calls"),
        F.count_if(failed).alias("n_failed"),
        F.bool_or(failed).alias("failed"),
    )


def task_schemas_present(reply: str = "reply"):
    """A generated task list is usable: every one of its tasks has a schema."""
    tasks = F.from_json(F.get_json_object(F.col(reply), "$.Tasks"), "array<string>")
    return F.coalesce(
        F.forall(tasks, lambda t: F.array_contains(F.json_object_keys(t), "Schema")) & is_json(reply), F.lit(False)
    )


_SIDES = {"function_calling": ("tools", "list"), "json_mode": ("pydantic_schema", "dict")}
_PLACED = "array<struct<place:string,reason:string>>"


def _shape(v: Column) -> Column:
    return F.coalesce(python_type(v), F.lit("absent"))


def _found(*checks: tuple[Column, Column, str]) -> Column:
    """The checks (where, whether it is wrong, what is wrong) that went wrong, in order."""
    return F.filter(
        F.array(*[F.when(wrong, F.struct(place.alias("place"), F.lit(reason).alias("reason"))) for place, wrong, reason in checks]),
        lambda x: x.isNotNull())


def _all_found(items: Column, found: Callable[[Column, Column], Column]) -> Column:
    return F.coalesce(F.flatten(F.transform(items, found)), F.array().cast(_PLACED))


def _at(place: Column | str, number: Column) -> Column:
    return F.concat(F.lit(place) if isinstance(place, str) else place, F.lit("["), number.cast("string"), F.lit("]"))


def _call_violations(call: Column, place: Column) -> Column:
    named = _shape(variant_field(call, "$.function.name")) == "str"
    arguments = _shape(variant_field(call, "$.function.arguments"))
    return _found(
        (place, _shape(variant_field(call, "$.id")) != "str", "call id is not a string"),
        (place, _shape(variant_field(call, "$.type")) != "str", "call type is not a string"),
        (place, ~named, "call without function name"),
        (place, ~arguments.isin("dict", "str", "NoneType", "absent"), "call arguments are neither object nor string"))


def _message_violations(m: Column, place: Column, kind: str) -> Column:
    role = variant_field(m, "$.role", "string")
    nameless = _shape(variant_field(m, "$.role")) != "str"

    def found(content):
        if kind == "json_mode":
            return _found((place, nameless, "message without role"),
                          (place, ~content.isin("str", "dict"), "content is neither string nor object"))
        by = lambda name: F.coalesce(role == name, F.lit(False)) & ~nameless
        calls = _shape(variant_field(m, "$.tool_calls"))
        return _found(
            (place, nameless, "message without role"),
            (place, ~nameless & ~role.isin("system", "user", "assistant", "tool"), "unknown role"),
            (place, (by("user") | by("system")) & ~content.isin("str", "absent"), "content is not a string"),
            (place, by("assistant") & ~content.isin("str", "NoneType", "absent"), "content is not a string"),
            (place, by("assistant") & ~calls.isin("list", "NoneType", "absent"), "tool_calls is not a list"),
            (place, by("tool") & (_shape(variant_field(m, "$.tool_call_id")) != "str"), "tool message without tool_call_id"),
            (place, by("tool") & (_shape(variant_field(m, "$.name")) != "str"), "tool message without name"))

    own = let(_shape(variant_field(m, "$.content")), found)
    if kind == "json_mode":
        return own
    calls = F.when(role == "assistant", variant_field(m, "$.tool_calls", "array<variant>"))
    return F.concat(own, _all_found(calls, lambda c, i: _call_violations(c, _at(F.concat(place, F.lit(".tool_calls")), i))))


def _tool_violations(tool: Column, place: Column) -> Column:
    named = F.greatest(*[_shape(variant_field(tool, path)) == "str" for path in ("$.name", "$.function.name")])
    other = _shape(tool) != "dict"
    return _found((place, other, "tool is not an object"), (place, ~other & ~named, "tool without name"))


def envelope_violations(record: str, kind: str) -> Column:
    """Everything that keeps a record from its declared shape: ``struct<place, reason>`` each, in the order of the record.

    ``kind`` is ``function_calling`` (messages, tools) or ``json_mode`` (messages, pydantic_schema). A text that is no JSON
    object has that one violation; a null record is no JSON. Of repeated keys the last counts. User and system messages may
    lack their content; tool messages may hold any."""
    side, side_shape = _SIDES[kind]

    def found(pairs):
        messages, beside = last_or_null(pairs, F.lit("messages")), last_or_null(pairs, F.lit(side))
        parts = [
            _found((F.lit("messages"), _shape(messages) != "list", "messages is not a list")),
            _all_found(F.try_variant_get(messages, "$", "array<variant>"),
                       lambda m, i: _message_violations(m, _at("messages", i), kind)),
            _found((F.lit(side), _shape(beside) != side_shape, f"{side} is not a {side_shape}")),
        ]
        if kind == "function_calling":
            parts.append(_all_found(F.try_variant_get(beside, "$", "array<variant>"), lambda t, i: _tool_violations(t, _at("tools", i))))
        return F.when(pairs.isNull(), _found((F.lit(""), F.lit(True), "not an object"))).otherwise(F.concat(*parts))

    broken = ~F.coalesce(is_json(record), F.lit(False))
    return F.when(broken, _found((F.lit(""), F.lit(True), "not JSON"))).otherwise(let(entries(record), found))


def envelope_errors(record: str, kind: str) -> Column:
    """The first thing that keeps a record from its declared shape, null if nothing."""
    return F.get(envelope_violations(record, kind), F.lit(0))["reason"]


def split_by_envelope(records: DataFrame, kind: str, record: str = "record") -> tuple[DataFrame, DataFrame]:
    """The records of the declared shape, and the others once for each ``reason`` they were turned away for, with the ``places``.

    All in the row; each side reads ``records`` on its own."""
    checked = bind(records, _violations=envelope_violations(record, kind))
    reasons = F.array_distinct(F.transform("_violations", lambda v: v["reason"]))
    turned = checked.filter(F.size("_violations") > 0).withColumn("reason", F.explode(reasons))
    places = F.transform(F.filter("_violations", lambda v: v["reason"] == F.col("reason")), lambda v: v["place"])
    return checked.filter(F.size("_violations") == 0).drop("_violations"), turned.withColumn("places", places).drop("_violations")
