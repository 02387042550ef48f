"""Tool signatures and call verdicts as Column expressions.

A signature is compiled once into a struct (``compiled_signature``); ``call_verdict`` then checks
one call against one compiled signature. Both work on columns and inside array functions, so the
same rules serve a join of calls with a signature table and the calls nested in a record.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, functions as F

from .jsons import (
    array_text, entries, has_key, is_json, is_truthy, last_or_null,
    let, object_entries, object_text, python_quoted, python_type, quoted,
)
from .text import _col

# The Python types a JSON Schema type name admits. ``bool`` is an ``int`` in Python.
ADMITTED_TYPES = {
    "string": ["str"],
    "number": ["int", "float", "bool"],
    "integer": ["int", "bool"],
    "boolean": ["bool"],
    "array": ["list"],
    "object": ["dict"],
    "null": ["NoneType"],
}
# Verdict messages.
VALID = "Function call is valid"
NO_MATCH = "No matching function signature found for function: "
MISSING = "Missing required arguments: "
BROKEN_SIGNATURE = "Error validationg function call: "
BROKEN_CALL = "Invalid tool call: "

_PROPERTIES = "array<struct<name:string,error:string,type:string,allowed:array<string>,listed:string>>"


def _text_or(v: Column, default: str) -> Column:
    return F.coalesce(F.to_json(v), F.lit(default))


def _python_text(v: Column) -> Column:
    """A scalar as Python prints it."""
    return let(F.try_variant_get(v, "$", "string"), lambda t: F.when(
        F.schema_of_variant(v) == "BOOLEAN", F.initcap(t)).otherwise(F.coalesce(t, F.lit("None"))))


def admitted(signature) -> Column:
    """The tool is a function with a name, well-typed description and parameters."""
    def usable(v):
        kind = lambda path: F.coalesce(python_type(F.try_variant_get(v, path, "variant")), F.lit("NoneType"))
        return F.coalesce(
            (F.try_variant_get(v, "$.type", "string") == "function")
            & (kind("$.function.name") == "str")
            & kind("$.function.description").isin("str", "NoneType")
            & kind("$.function.parameters").isin("dict", "NoneType"),
            F.lit(False),
        )

    return let(F.try_parse_json(_col(signature)), usable)


def rejection_reason(signature) -> Column:
    """Why ``admitted`` turned a tool away."""
    named = F.array_contains(F.json_object_keys(F.get_json_object(_col(signature), "$.function")), "name")
    return F.when(
        ~admitted(signature),
        F.when(F.coalesce(named, F.lit(False)), F.lit("Validation error for function signature")).otherwise(
            F.lit("Missing required fields in function signature")
        ),
    )


def signature_name(signature) -> Column:
    return F.get_json_object(_col(signature), "$.function.name")


def _enum_as_list(fields: Column) -> Column:
    """JSON text of a property whose ``enum``, if any, is a list: of the keys of a map, of a lone value."""

    def one(e):
        v = e["value"]
        keys = F.transform(F.map_keys(F.try_variant_get(v, "$", "map<string,variant>")), quoted)
        listed = let(python_type(v), lambda kind: (
            F.when(kind == "dict", array_text(keys))
            .when(kind == "list", F.to_json(v))
            .otherwise(F.concat(F.lit("["), F.to_json(v), F.lit("]")))))
        return F.struct(
            e["key"].alias("key"), F.when(e["key"] == "enum", listed).otherwise(F.to_json(v)).alias("value")
        )

    return object_text(F.transform(fields, one))


def _with_value(pairs: Column, key: str, text: Column) -> Column:
    """Object text from ``pairs`` (VARIANT values) with the value of ``key`` replaced, order kept."""
    return object_text(
        F.transform(
            pairs,
            lambda e: F.struct(
                e["key"].alias("key"), F.when(e["key"] == key, text).otherwise(F.to_json(e["value"])).alias("value")
            ),
        )
    )


def _enums_listed(properties_text: Column) -> Column:
    """Properties text with every ``enum`` a list; properties and their keys keep their order."""
    loose = entries(properties_text)
    ordered = F.map_entries(F.from_json(properties_text, "map<string,map<string,variant>>"))

    def one(e, o):
        fields = F.coalesce(F.map_entries(o["value"]), F.map_entries(F.try_variant_get(e["value"], "$", "map<string,variant>")))
        return F.struct(e["key"].alias("key"), F.coalesce(_enum_as_list(fields), F.to_json(e["value"])).alias("value"))

    return F.coalesce(object_text(F.zip_with(loose, ordered, one)), F.lit("{}"))


def wrapped_tool(tool) -> Column:
    """A tool definition in its wrapped form, ``{"type": "function", "function": {...}}``, enums as lists.

    Flat definitions are wrapped with empty defaults; wrapped ones keep their shape."""
    tool = _col(tool)
    field = lambda path: F.get_json_object(tool, path)
    flat_properties = _enums_listed(F.coalesce(field("$.parameters.properties"), F.lit("{}")))
    flat_pairs = entries(tool)
    flat = F.concat(
        F.lit('{"type":"function","function":{"name":'), _text_or(last_or_null(flat_pairs, F.lit("name")), '""'),
        F.lit(',"description":'), _text_or(last_or_null(flat_pairs, F.lit("description")), '""'),
        F.lit(',"parameters":{"type":"object","properties":'), flat_properties,
        F.lit(',"required":'), F.coalesce(field("$.parameters.required"), F.lit("[]")), F.lit("}}}"),
    )
    parameters = _with_value(
        entries(field("$.function.parameters")), "properties", _enums_listed(field("$.function.parameters.properties"))
    )
    function = _with_value(entries(field("$.function")), "parameters", parameters)
    whole = _with_value(entries(tool), "function", function)
    return F.when(F.coalesce(field("$.type") == "function", F.lit(False)), whole).otherwise(flat)


def _compiled_property(e: Column) -> Column:
    prop = e["value"]
    declared = F.try_variant_get(prop, "$.type", "variant")
    enum = F.try_variant_get(prop, "$.enum", "variant")
    facts = F.struct(
        e["key"].alias("name"),
        python_type(prop).alias("kind"),
        F.when(is_truthy(declared), python_type(declared)).alias("type_kind"),
        _python_text(declared).alias("type_text"),
        F.when(F.try_variant_get(prop, "$.type", "string") == "string", python_type(enum)).alias("enum_kind"),
        F.try_variant_get(prop, "$.enum", "array<variant>").alias("values"),
        F.map_keys(F.try_variant_get(prop, "$.enum", "map<string,variant>")).alias("keys"),
    )

    def compiled(f):
        unknown = F.when(f["type_kind"] == "str", python_quoted(f["type_text"])).otherwise(f["type_text"])
        error = (
            F.when(f["kind"] != "dict", F.concat(F.lit("'"), f["kind"], F.lit("' object has no attribute 'get'")))
            .when(f["type_kind"].isNull(), F.lit(None).cast("string"))
            .when(f["enum_kind"].isin("NoneType", "int", "float", "bool"),
                  F.concat(F.lit("argument of type '"), f["enum_kind"], F.lit("' is not iterable")))
            .when(f["enum_kind"] == "str", F.lit("'in <string>' requires string as left operand, not NoneType"))
            .when(f["type_kind"].isin("list", "dict"), F.concat(F.lit("unhashable type: '"), f["type_kind"], F.lit("'")))
            .when(~f["type_text"].isin(*ADMITTED_TYPES), unknown)
        )
        texts = F.transform(f["values"], lambda x: F.to_json(x))
        members = F.when(f["enum_kind"] == "dict", F.transform(f["keys"], quoted)).when(
            (f["enum_kind"] == "list") & (F.size(f["values"]) > 0) & ~F.array_contains(texts, "null"), texts)
        listed = F.when(f["enum_kind"] == "dict", f["keys"]).otherwise(F.transform(f["values"], _python_text))
        return F.struct(
            f["name"].alias("name"), error.alias("error"),
            F.when(f["type_kind"].isNotNull(), f["type_text"]).alias("type"),
            members.alias("allowed"), F.array_join(listed, ", ").alias("listed"),
        )

    return let(facts, compiled)


def compiled_signature(signature) -> Column:
    """Everything a call is checked against, read once off an admitted signature.

    ``error`` is set where the signature itself makes every call of it fail."""
    signature = _col(signature)
    parameters = F.get_json_object(signature, "$.function.parameters")
    pairs = entries(parameters)
    properties = last_or_null(pairs, F.lit("properties"))
    required = last_or_null(pairs, F.lit("required"))
    properties_kind = F.coalesce(python_type(properties), F.lit("dict"))
    required_kind = F.coalesce(python_type(required), F.lit("list"))
    no_attribute = lambda kind, what: F.concat(F.lit("'"), kind, F.lit(f"' object has no attribute '{what}'"))
    error = F.when(pairs.isNull(), no_attribute(F.lit("NoneType"), "get")).when(
        properties_kind != "dict", no_attribute(properties_kind, "items"))
    late_error = F.when(
        required_kind != "list", F.concat(F.lit("'"), required_kind, F.lit("' object is not iterable")))
    in_order = entries(F.get_json_object(signature, "$.function.parameters.properties"))
    careful = F.coalesce(F.transform(in_order, _compiled_property), F.array().cast(_PROPERTIES))

    def compiled(shape):
        """The usual signature, known types and no enum, is read in one pass; others get the careful one."""
        fields = F.map_entries(shape["properties"])
        plain = F.transform(fields, lambda e: F.struct(
            e["key"].alias("name"), F.lit(None).cast("string").alias("error"), e["value"]["type"].alias("type"),
            F.lit(None).cast("array<string>").alias("allowed"), F.lit(None).cast("string").alias("listed")))
        usual = (
            shape["properties"].isNotNull() & ~F.contains(signature, F.lit('"enum"'))
            & F.forall(fields, lambda e: F.coalesce(e["value"]["type"].isin(*ADMITTED_TYPES), F.lit(False)))
        )
        return F.struct(
            signature_name(signature).alias("name"),
            F.when(shape["properties"].isNull(), error).alias("error"),
            F.when(usual, plain).otherwise(careful).alias("properties"),
            F.coalesce(shape["required"], F.array().cast("array<string>")).alias("required"),
            F.when(shape["required"].isNull(), late_error).alias("late_error"),
        )

    return let(F.from_json(parameters, "struct<properties:map<string,struct<type:string>>,required:array<string>>"), compiled)


def _admits(kind: Column, declared: Column) -> Column:
    """Whether a declared JSON Schema type admits a Python type."""
    pairs = [f"{name} {k}" for name, kinds in ADMITTED_TYPES.items() for k in kinds]
    return F.concat_ws(" ", declared, kind).isin(*pairs)


def _argument_error(prop: Column, value: Column) -> Column:
    """Message for one declared property that is present and true, null if it is fine. ``value`` is used as often as it comes."""

    def error(f):
        outside = prop["allowed"].isNotNull() & ~F.array_contains(prop["allowed"], F.to_json(value))
        detail = (
            F.when(prop["error"].isNotNull(), prop["error"])
            .when(outside, F.concat(
                F.lit("Error validating function call: Invalid value '"), _python_text(value), F.lit("' for parameter "),
                prop["name"], F.lit(". Expected one of "), prop["listed"]))
            .when(prop["type"].isNotNull() & ~_admits(f, prop["type"]), F.concat(
                F.lit("Type mismatch for parameter "), prop["name"], F.lit(". Expected: "), prop["type"],
                F.lit(", Got: <class '"), f, F.lit("'>")))
        )
        return F.concat(F.lit("Invalid argument '"), prop["name"], F.lit("': "), detail)

    return F.when(is_truthy(value), let(python_type(value), error))


def call_message(name, arguments, signature) -> Column:
    """Verdict text of one call: ``VALID`` or what is wrong with it first.

    ``arguments`` is JSON text, ``signature`` a compiled signature or null if no signature has the name.
    Empty or otherwise false values are never type-checked; undeclared arguments are ignored."""
    name, arguments, signature = _col(name), _col(arguments), _col(signature)

    def argument(pairs):
        return lambda p: let(last_or_null(pairs, p["name"]), lambda value: _argument_error(p, value))

    def against(pairs):
        errors = F.filter(F.transform(signature["properties"], argument(pairs)), lambda e: e.isNotNull())
        missing = F.filter(signature["required"], lambda r: ~has_key(pairs, r))
        return (
            F.when(pairs.isNull(), F.lit(BROKEN_CALL + "arguments are not a JSON object"))
            .when(signature.isNull(), F.concat(F.lit(NO_MATCH), name))
            .when(signature["error"].isNotNull(), F.concat(F.lit(BROKEN_SIGNATURE), signature["error"]))
            .otherwise(F.coalesce(
                F.get(errors, F.lit(0)),
                F.concat(F.lit(BROKEN_SIGNATURE), signature["late_error"]),
                let(missing, lambda m: F.when(F.size(m) > 0, F.concat(
                    F.lit(MISSING + "["), F.array_join(F.transform(m, python_quoted), ", "), F.lit("]")))),
                F.lit(VALID)))
        )

    return F.when(name.isNull(), F.lit(BROKEN_CALL + "no function name")).otherwise(
        let(object_entries(arguments), against))


def call_verdict(name, arguments, signature) -> Column:
    """Struct ``status`` (``accepted`` / ``failed``) and ``message``."""
    return let(
        call_message(name, arguments, signature),
        lambda m: F.struct(F.when(m == VALID, F.lit("accepted")).otherwise(F.lit("failed")).alias("status"), m.alias("message")),
    )


def shaped_call_error(call) -> Column:
    """Envelope check of a call struct ``id, type, function{name, arguments}``; null if well shaped."""
    call = _col(call)
    return (
        F.when(call["id"].isNull(), F.lit(BROKEN_CALL + "no id"))
        .when(~F.coalesce(call["type"] == "function", F.lit(False)), F.lit(BROKEN_CALL + "type is not function"))
    )


def record_verdicts(calls, tools) -> Column:
    """Verdicts of the calls nested in a record against the tools (JSON texts) of the same record.

    Runs inside the row: no join, no shuffle, whatever the size of any one tool's following. Thousands of calls to the
    JVM go into the expression; for columns given by name it is built once."""
    return _named_verdicts(calls, tools) if isinstance(calls, str) and isinstance(tools, str) else _verdicts(calls, tools)


@cache
def _named_verdicts(calls: str, tools: str) -> Column:
    return _verdicts(calls, tools)


def _of_name(tool: Column, name: Column) -> Column:
    """Whether a tool has the name. Most tools that haven't are told by their text: one without escapes holds its name as it is."""
    return (F.contains(tool, name) | F.contains(tool, F.lit("\\"))) & (signature_name(tool) == name)


def _verdicts(calls, tools) -> Column:
    def of_names(called):
        wanted = lambda t: F.exists(called, lambda name: F.contains(t, name) | F.contains(t, F.lit("\\")))
        return F.transform(
            F.filter(_col(tools), lambda t: wanted(t) & F.array_contains(called, signature_name(t)) & admitted(t)), compiled_signature)

    usable = let(F.transform(_col(calls), lambda c: c["function"]["name"]), of_names)

    def all_calls(signatures):
        def one(call):
            name, arguments = call["function"]["name"], call["function"]["arguments"]
            first = F.get(F.filter(signatures, lambda s: s["name"] == name), F.lit(0))
            message = F.coalesce(shaped_call_error(call), let(first, lambda s: call_message(name, arguments, s)))
            return let(message, lambda m: F.struct(
                F.when(m == VALID, F.lit("accepted")).otherwise(F.lit("failed")).alias("status"), m.alias("message")))
        return F.transform(_col(calls), one)

    return let(usable, all_calls)


def call_results(calls, tools, verdicts) -> Column:
    """The verdicts of a record's calls as JSON text: ``[{"status", "message", "call": {"name", "arguments"}, "signature"}, …]``.

    The signature is the tool the call was held against, null if none has its name. Arguments that aren't JSON are
    given as the text they are."""

    def shown(call, verdict):
        function = call["function"]
        name, arguments = function["name"], function["arguments"]
        signature = F.get(F.filter(_col(tools), lambda t: _of_name(t, name) & admitted(t)), F.lit(0))
        null = F.lit("null")
        told = lambda text: F.coalesce(quoted(text), null)
        given = F.when(is_json(arguments), arguments).otherwise(told(arguments))
        return F.concat(
            F.lit('{"status":'), told(verdict["status"]), F.lit(',"message":'), told(verdict["message"]),
            F.lit(',"call":{"name":'), told(name), F.lit(',"arguments":'), given,
            F.lit('},"signature":'), F.coalesce(signature, null), F.lit("}"))

    listed = F.array_join(F.zip_with(_col(calls), _col(verdicts), shown), ",")
    return F.concat(F.lit("["), F.coalesce(listed, F.lit("")), F.lit("]"))
