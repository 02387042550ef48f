"""JSON expressions.

JSON arrives as text and the text is kept, so that key order survives; VARIANT is derived where a
value has to be typed. Spark's readers accept text behind a complete value, single quotes and (for
VARIANT) no repeated keys, so whether a text *is* one JSON value is decided by ``is_json``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from .text import _col, strip

_STRICT = {"allowSingleQuotes": "false"}
_END = "␞ end of value ␞"
_STRING = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
_NUMBER = r"-?[0-9][0-9.eE+-]*"
# Only a text in which this is found can have something to fold.
_TO_FOLD = r"true|false|-0|[0-9][.eE]"
_TOKEN = rf"(?s){_STRING}|{_NUMBER}|true|false|null|[\[\]{{}}:,]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times in ``body``.

    The result is put in a struct, whose type is worked out once. Without, taking it out of the array asks for the type of the
    whole body for every row, and in each ``let`` inside another again."""
    return F.get(F.transform(F.array(value), lambda x: F.struct(body(x).alias("let"))), F.lit(0))["let"]


def is_json(c) -> Column:
    """The whole text is exactly one JSON value."""
    wrapped = F.concat(F.lit("["), _col(c), F.lit(f',"{_END}"]'))
    return let(
        F.from_json(wrapped, "array<string>", _STRICT),
        lambda v: F.coalesce((F.size(v) == 2) & (F.get(v, F.lit(1)) == _END), F.lit(False)),
    )


def is_object(c) -> Column:
    """The whole text is one JSON object."""
    return F.startswith(strip(c), F.lit("{")) & is_json(c)


def is_empty_value(c) -> Column:
    """``{}``, ``[]``, ``""``, zero, ``false`` and ``null``: JSON texts Python calls false."""
    return strip(c).rlike(r'^(?:\{\s*\}|\[\s*\]|""|-?0+(?:\.0*)?(?:[eE][+-]?[0-9]+)?|false|null|)$')


def entries(c) -> Column:
    """Key/value pairs of a JSON object in text order, values as VARIANT; null for anything else."""
    return F.map_entries(F.from_json(_col(c), "map<string,variant>", _STRICT))


def object_entries(c) -> Column:
    """``entries`` of a text that is one JSON object and nothing else; null otherwise."""
    wrapped = F.concat(F.lit("["), _col(c), F.lit(f',{{"{_END}":0}}]'))
    return let(
        F.from_json(wrapped, "array<map<string,variant>>", _STRICT),
        lambda v: F.when((F.size(v) == 2) & F.map_contains_key(F.get(v, F.lit(1)), _END), F.map_entries(F.get(v, F.lit(0)))),
    )


def last_value(pairs: Column, key: Column) -> Column:
    """Value of ``key``; of a repeated key the last, as Python reads it. Null if absent."""
    return F.try_element_at(F.transform(F.filter(pairs, lambda e: e["key"] == key), lambda e: e["value"]), F.lit(-1))


def last_or_null(pairs: Column, key: Column) -> Column:
    hits = F.filter(pairs, lambda e: e["key"] == key)
    return let(hits, lambda h: F.when(F.size(h) > 0, F.get(h, F.size(h) - 1)["value"]))


def has_key(pairs: Column, key: Column) -> Column:
    return F.exists(pairs, lambda e: e["key"] == key)


def variant_field(v: Column, path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(v, path, kind)


# The Python type each VARIANT type decodes to.
_PYTHON_TYPES = {
    "STRING": "str", "BIGINT": "int", "BOOLEAN": "bool", "VOID": "NoneType", "DOUBLE": "float", "FLOAT": "float",
}
# Canonical texts of the JSON values Python calls false.
_FALSE_VALUES = ("null", "false", '""', "[]", "{}", "0", "0.0", "-0.0")


def python_type(v: Column) -> Column:
    """Name of the Python type a JSON value has once decoded. Whole numbers beyond 18 digits are decimals
    to VARIANT, and still ``int``."""

    def named(kind):
        known = F.when(F.startswith(kind, F.lit("OBJECT")), F.lit("dict")).when(F.startswith(kind, F.lit("ARRAY")), F.lit("list"))
        for variant, python in _PYTHON_TYPES.items():
            known = known.when(kind == variant, F.lit(python))
        whole = kind.rlike(r"^DECIMAL\((?:19|[23][0-9]),0\)$")
        return known.when(F.startswith(kind, F.lit("DECIMAL")), F.when(whole, F.lit("int")).otherwise(F.lit("float")))

    return let(F.schema_of_variant(v), named)


def is_truthy(v: Column) -> Column:
    """Python truth of a JSON value; an absent one is false."""
    return F.coalesce(~F.to_json(v).isin(*_FALSE_VALUES), F.lit(False))


def quoted(c) -> Column:
    """A string as JSON text."""
    return let(F.to_json(F.array(_col(c))), lambda listed: F.substring(listed, F.lit(2), F.length(listed) - 2))


def object_text(pairs: Column) -> Column:
    """JSON object from an array of ``struct<key, value>`` whose values are JSON text."""
    items = F.transform(pairs, lambda e: F.concat(quoted(e["key"]), F.lit(":"), e["value"]))
    return F.concat(F.lit("{"), F.array_join(items, ","), F.lit("}"))


def array_text(items: Column) -> Column:
    """JSON array from an array of JSON texts."""
    return F.concat(F.lit("["), F.array_join(items, ","), F.lit("]"))


def without_nulls(c) -> Column:
    """A JSON object without its null fields."""
    kept = F.filter(entries(c), lambda e: F.schema_of_variant(e["value"]) != "VOID")
    return object_text(F.transform(kept, lambda e: F.struct(e["key"].alias("key"), F.to_json(e["value"]).alias("value"))))


def _canonical_token(t: Column) -> Column:
    as_double = t.try_cast("double")
    whole = (as_double == F.floor(as_double)) & (F.abs(as_double) < 1e18)
    return (
        F.when(t.startswith('"'), t)
        .when(t == "true", F.lit("1"))
        .when(t == "false", F.lit("0"))
        .when(t == "-0", F.lit("0"))
        .when(t.rlike("^-?[0-9]+$"), t)
        .when(t.rlike("^-?[0-9]"), F.when(whole, as_double.try_cast("bigint").cast("string")).otherwise(as_double.cast("string")))
        .otherwise(t)
    )


def canonical_value(v: Column) -> Column:
    """Text form under which two JSON values (VARIANT) are equal exactly if Python calls them equal:
    object keys sorted, ``1``, ``1.0``, ``1e0`` and ``true`` alike."""

    def folded(text):
        tokens = F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(0))
        return F.when(text.rlike(_TO_FOLD), F.array_join(F.transform(tokens, _canonical_token), "")).otherwise(text)

    return let(F.to_json(v), folded)


def canonical(c) -> Column:
    """``canonical_value`` of JSON text."""
    return canonical_value(F.try_parse_json(_col(c)))


def python_quoted(c: Column) -> Column:
    """A plain string as Python's ``repr`` shows it (quotes and backslashes)."""
    escaped = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    double = F.contains(c, F.lit("'")) & ~F.contains(c, F.lit('"'))
    return F.when(double, F.concat(F.lit('"'), escaped, F.lit('"'))).otherwise(
        F.concat(F.lit("'"), F.replace(escaped, F.lit("'"), F.lit("\\'")), F.lit("'"))
    )


def between_braces(c) -> Column:
    """From the first ``{`` to the last ``}``, or the empty string."""
    text = _col(c)
    start = F.instr(text, "{")
    end = F.length(text) - F.length(F.substring_index(text, "}", -1))
    return F.when((start > 0) & F.contains(text, F.lit("}")) & (start < end), F.substring(text, start, end - start + 1)).otherwise("")


def salvaged(c) -> Column:
    """The JSON text of a reply: the whole reply, else what lies between its outer braces.

    Null if neither is JSON, or if the value is an empty one."""
    inner = let(between_braces(c), lambda text: F.when(is_object(text), text))
    return let(F.when(is_json(c), strip(c)).otherwise(inner), lambda found: F.when(~is_empty_value(found), found))
