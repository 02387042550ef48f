"""Tools and calls: admission, normal form, verdicts; JSON against schemas; record shapes."""

import json

from pyspark.sql import functions as F

from ..functions import messages as M, tools as T
from ..operators import validation as V
from ..operators import selection as S
from ..operators.binding import bind
from ..operators.conversations import parse_records
from ..operators.schema_check import validate_json
from ..plans.export import export_json_mode
from ..session import fresh_path
from ..sources.sinks import quarantine
from .registry import lit, query, table

# A tool per part: flat, wrapped, nameless, ill-typed, not a function; enums as map, list, scalar, null.
SQL_KIND = "CASE WHEN p_size <= 10 THEN 'flat' WHEN p_size <= 20 THEN 'wrapped' WHEN p_size <= 30 THEN 'nameless' WHEN p_size <= 40 THEN 'illtyped' ELSE 'other' END"
SQL_ENUM = """CASE p_type WHEN 'ECONOMY' THEN '{"a": "x", "b": "y"}' WHEN 'STANDARD' THEN '["a", "b"]'
    WHEN 'PROMO' THEN '7' ELSE 'null' END"""
SQL_ENUM_LISTED = """CASE p_type WHEN 'ECONOMY' THEN '["a","b"]' WHEN 'STANDARD' THEN '["a","b"]'
    WHEN 'PROMO' THEN '[7]' ELSE '[null]' END"""
SQL_TOOL = f"""CASE {SQL_KIND}
    WHEN 'flat' THEN '{{"name": "' || p_name || '", "parameters": {{"properties": {{"q": {{"type": "string", "enum": ' || {SQL_ENUM} || '}}, "n": {{"type": "integer"}}}}, "required": ["q"]}}}}'
    WHEN 'wrapped' THEN '{{"type": "function", "function": {{"name": "' || p_name || '", "parameters": {{"type": "object", "properties": {{"q": {{"type": "string", "enum": ' || {SQL_ENUM} || '}}}}}}}}}}'
    WHEN 'nameless' THEN '{{"type": "function", "function": {{"description": "' || p_brand || '"}}}}'
    WHEN 'illtyped' THEN '{{"type": "function", "function": {{"name": "' || p_name || '", "description": 5}}}}'
    ELSE '{{"type": "tool", "function": {{"name": "' || p_name || '"}}}}' END"""


def part_tools(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.expr(SQL_TOOL).alias("signature"))


@query(f"""
SELECT p_partkey, CASE {SQL_KIND} WHEN 'wrapped' THEN NULL
    WHEN 'illtyped' THEN 'Validation error for function signature' WHEN 'other' THEN 'Validation error for function signature'
    ELSE 'Missing required fields in function signature' END AS reason
FROM part""")
def admit_tools(spark, sf):
    good, bad = V.admit_tools(part_tools(spark, sf))
    return good.select("p_partkey", F.lit(None).cast("string").alias("reason")).unionByName(bad.select("p_partkey", "reason"))


@query(f"""
SELECT p_partkey, CASE {SQL_KIND}
    WHEN 'flat' THEN '{{"type":"function","function":{{"name":"' || p_name || '","description":"","parameters":{{"type":"object","properties":{{"q":{{"type":"string","enum":' || {SQL_ENUM_LISTED} || '}},"n":{{"type":"integer"}}}},"required":["q"]}}}}}}'
    ELSE '{{"type":"function","function":{{"name":"' || p_name || '","parameters":{{"type":"object","properties":{{"q":{{"type":"string","enum":' || {SQL_ENUM_LISTED} || '}}}}}}}}}}' END AS tool
FROM part WHERE p_size <= 20""")
def normalized_tools(spark, sf):
    tools = part_tools(spark, sf).join(table(spark, sf, "part").filter("p_size <= 20").select("p_partkey"), "p_partkey")
    return tools.select("p_partkey", T.wrapped_tool("signature").alias("tool"))


# Calls are events: function ``event_type`` with arguments ``props`` ({"k": n}).
# Fixed signatures; ``error`` has none, ``view`` has a second one that must not be used.
SIGNATURES = [
    '{"type":"function","function":{"name":"view","parameters":{"properties":{"k":{"type":"integer"}},"required":["k"]}}}',
    '{"type":"function","function":{"name":"click","parameters":{"properties":{"k":{"type":"string"}}}}}',
    '{"type":"function","function":{"name":"purchase","parameters":{"properties":{"k":{"type":"integer"},"amount":{"type":"number"}},"required":["k","amount"]}}}',
    '{"type":"function","function":{"name":"signup","parameters":{"properties":{"k":{"type":"integer"}}}}}',
    '{"type":"function","function":{"name":"view","parameters":{"properties":{},"required":["never"]}}}',
    '{"name":"error","parameters":{"properties":{}}}',
]
SQL_K = "CAST(regexp_extract(props, '[0-9]+', 0) AS INTEGER)"
SQL_MESSAGE = f"""CASE event_type
    WHEN 'error' THEN 'No matching function signature found for function: error'
    WHEN 'click' THEN CASE WHEN {SQL_K} = 0 THEN 'Function call is valid'
         ELSE 'Invalid argument ''k'': Type mismatch for parameter k. Expected: string, Got: <class ''int''>' END
    WHEN 'purchase' THEN 'Missing required arguments: [''amount'']'
    ELSE 'Function call is valid' END"""


def signatures(spark):
    listed = F.posexplode(F.array(*[F.lit(s) for s in SIGNATURES])).alias("position", "signature")
    return V.signature_table(spark.range(1).select(listed))


def validated(spark, sf):
    calls = table(spark, sf, "events", spread_out=True).select(
        "event_id", "user_id", F.col("event_type").alias("name"), F.col("props").alias("arguments"))
    return V.validate_calls(calls, signatures(spark))


@query(f"""
SELECT event_id, user_id, event_type AS name, props AS arguments, {SQL_MESSAGE} AS message,
       CASE WHEN {SQL_MESSAGE} = 'Function call is valid' THEN 'accepted' ELSE 'failed' END AS status
FROM events""")
def validate_calls(spark, sf):
    return validated(spark, sf)


@query(f"""
SELECT user_id, count(*) AS n_calls, count(*) FILTER ({SQL_MESSAGE} <> 'Function call is valid') AS n_failed,
       bool_or({SQL_MESSAGE} <> 'Function call is valid') AS failed
FROM events GROUP BY user_id""")
def call_verdicts(spark, sf):
    return V.verdicts_by(validated(spark, sf), ["user_id"])


@query(f"""
SELECT event_id, user_id FROM events WHERE {SQL_MESSAGE} = 'Function call is valid' ORDER BY event_id LIMIT 50""")
def first_successes(spark, sf):
    """The first fifty calls that hold (a cap on successes, as preference runs have one)."""
    checked = validated(spark, sf).withColumn("good", F.col("status") == "accepted")
    return S.first_successes(checked, "good", 50, ["event_id"]).select("event_id", "user_id")


# One chat record per event: a question, one or two calls, a tool result, a summary.
SQL_RECORD = """'{"messages": [{"role": "system", "content": "be kind"}, {"role": "user", "content": "do ' || event_type || ' for ' || user_id
    || '"}, {"role": "assistant", "content": null, "tool_calls": [{"id": "c1", "type": "function", "function": {"name": "' || event_type
    || '", "arguments": "{\\"k\\": ' || regexp_extract(props, '[0-9]+', 0) || '}"}}' || CASE WHEN value > 20 THEN
       ', {"id": "c2", "type": "function", "function": {"name": "signup", "arguments": "{}"}}' ELSE '' END
    || ']}, {"role": "tool", "tool_call_id": "c1", "name": "' || event_type || '", "content": {"done": ' || user_id
    || '}}, {"role": "assistant", "content": "did ' || event_type || '"}], "tools": [' || '%s' || ']}'"""
TOOLS_TEXT = ",".join(SIGNATURES)


def event_records(spark, sf):
    text = SQL_RECORD.replace("\\", "\\\\") % TOOLS_TEXT
    return table(spark, sf, "events", spread_out=True).select(
        "event_id", F.col("event_id").cast("string").alias("id"), F.lit("events").alias("category"),
        F.col("event_type").alias("subcategory"), F.col("user_id").cast("string").alias("task"),
        F.expr(text).alias("record"))


@query(f"""
SELECT event_id, {SQL_MESSAGE} AS first_message, CASE WHEN value > 20 THEN 2 ELSE 1 END AS n_calls
FROM events""")
def record_verdicts(spark, sf):
    return judged_records(spark, sf).select("event_id", F.get("v", F.lit(0))["message"].alias("first_message"), F.size("v").alias("n_calls"))


def judged_records(spark, sf):
    records = parse_records(event_records(spark, sf))
    calls = F.try_element_at(F.filter("messages", lambda m: m["tool_calls"].isNotNull()), F.lit(-1))["tool_calls"]
    return bind(records.select("event_id", calls.alias("calls"), "tools"), v=T.record_verdicts("calls", "tools"))


def sql_result(name: str, arguments: str, message: str) -> str:
    """A call's verdict with call and signature, as SQL."""
    held = " ".join(f"WHEN {lit(json.loads(s)['function']['name'])} THEN {lit(s)}" for s in SIGNATURES[:-1])
    return f"""'{{"status":"' || CASE WHEN {message} = 'Function call is valid' THEN 'accepted' ELSE 'failed' END || '","message":' || to_json({message})
       || ',"call":{{"name":"' || {name} || '","arguments":' || {arguments} || '}},"signature":' || CASE {name} {held} ELSE 'null' END || '}}'"""


@query(f"""
SELECT event_id, {SQL_MESSAGE} <> 'Function call is valid' AS failed,
       '[' || {sql_result("event_type", f"""'{{"k": ' || {SQL_K} || '}}'""", SQL_MESSAGE)}
       || CASE WHEN value > 20 THEN ',' || {sql_result("'signup'", "'{}'", "'Function call is valid'")} ELSE '' END || ']' AS results
FROM events""")
def record_results(spark, sf):
    """What became of each record's calls, with calls and signatures, and whether any failed."""
    failed = F.exists("v", lambda v: v["status"] == "failed").alias("failed")
    return judged_records(spark, sf).select("event_id", failed, T.call_results("calls", "tools", "v").alias("results"))


# JSON against a schema: one object, or a list whose second item counts as well.
SCHEMA = '{"type": "object", "properties": {"k": {"type": "integer", "maximum": 49}}, "required": ["k"]}'
SQL_VALUE = """CASE event_type WHEN 'view' THEN '[' || props || ', {"k": 1.0}]' WHEN 'click' THEN '[' || props || ', {"k": true}]'
    WHEN 'error' THEN '{"l": 5' ELSE props END"""


@query(f"""
SELECT event_id, CASE event_type WHEN 'click' THEN false WHEN 'error' THEN false ELSE {SQL_K} <= 49 END AS valid
FROM events""")
def schema_valid(spark, sf):
    values = table(spark, sf, "events", spread_out=True).select(
        "event_id", F.expr(SQL_VALUE).alias("value"), F.lit(SCHEMA).alias("schema"))
    return validate_json(values, "value", "schema").select("event_id", "valid")


@query("SELECT event_id, event_type NOT IN ('error', 'purchase') AS usable FROM events")
def task_schemas(spark, sf):
    reply = F.concat(
        F.lit('{"Tasks": [{"Task": "a", "Schema": {}}, {"Task": "'), "event_type", F.lit('"'),
        F.when(F.col("event_type") == "purchase", F.lit("")).otherwise(F.lit(', "Schema": {"type": "object"}')),
        F.when(F.col("event_type") == "error", F.lit("}]")).otherwise(F.lit("}]}")))
    replies = table(spark, sf, "events").select("event_id", reply.alias("reply"))
    return replies.select("event_id", V.task_schemas_present("reply").alias("usable"))


SQL_ENVELOPE = """CASE event_type
    WHEN 'view' THEN '{"messages": [{"role": "user", "content": "x"}], "tools": []}'
    WHEN 'click' THEN '{"messages": [{"content": "' || user_id || '"}], "tools": []}'
    WHEN 'purchase' THEN '{"messages": {}, "tools": []}'
    WHEN 'signup' THEN '{"messages": [{"role": "user"}], "tools": {}}'
    ELSE '[' || props || ']' END"""


@query("""
SELECT event_id, CASE event_type WHEN 'click' THEN 'message without role' WHEN 'purchase' THEN 'messages is not a list'
    WHEN 'signup' THEN 'tools is not a list' WHEN 'error' THEN 'not an object' END AS error
FROM events""")
def envelope_check(spark, sf):
    records = table(spark, sf, "events").select("event_id", F.expr(SQL_ENVELOPE).alias("record"))
    return records.select("event_id", V.envelope_errors("record", "function_calling").alias("error"))


SQL_VARIETY = """CASE event_type
    WHEN 'view' THEN '{"messages": [{"role": "user", "content": "x"}, {"role": "assistant", "content": null, "tool_calls": [{"id": "1", "type": "function",
        "function": {"name": "f", "arguments": "{}"}}]}, {"role": "tool", "tool_call_id": "1", "name": "f", "content": {"k": 1}}], "tools": [{"type": "function", "function": {"name": "f"}}]}'
    WHEN 'click' THEN '{"messages": [{"role": "user"}, {"role": "tool", "content": "' || user_id || '"}], "tools": []}'
    WHEN 'purchase' THEN '{"messages": [{"role": "assistant", "tool_calls": [{"id": "1", "type": "function", "function": {"name": "f"}}, {"id": 5, "type": "function", "function": {}}]}], "tools": []}'
    WHEN 'signup' THEN '{"messages": [{"role": "user", "content": ' || user_id || '}], "tools": [{"name": "f"}, 1, {}]}'
    ELSE '{"messages": [{"content": "x"}, {"role": "robot"}, 7], "tools": {}}' END"""


def varied_records(spark, sf):
    return table(spark, sf, "events").select("event_id", F.expr(SQL_VARIETY).alias("record"))


# Per event type: the violations of its record, in order.
VIOLATIONS = {
    "click": [("messages[1]", "tool message without tool_call_id"), ("messages[1]", "tool message without name")],
    "purchase": [("messages[0].tool_calls[1]", "call id is not a string"), ("messages[0].tool_calls[1]", "call without function name")],
    "signup": [("messages[0]", "content is not a string"), ("tools[1]", "tool is not an object"), ("tools[2]", "tool without name")],
    "error": [("messages[0]", "message without role"), ("messages[1]", "unknown role"), ("messages[2]", "message without role"),
              ("tools", "tools is not a list")],
}
SQL_VIOLATIONS = ", ".join(
    f"({lit(kind)}, {number}, {lit(place)}, {lit(reason)})"
    for kind, found in VIOLATIONS.items() for number, (place, reason) in enumerate(found))


@query(f"""
SELECT event_id, number, place, reason
FROM events JOIN (VALUES {SQL_VIOLATIONS}) v(kind, number, place, reason) ON event_type = kind""")
def record_violations(spark, sf):
    """Everything that is wrong with each record, a row each."""
    found = bind(varied_records(spark, sf), found=V.envelope_violations("record", "function_calling"))
    rows = found.select("event_id", F.posexplode("found").alias("number", "v"))
    return rows.select("event_id", "number", "v.place", "v.reason")


@query(f"""
SELECT event_id, reason, string_agg(place, ' ' ORDER BY number) AS places
FROM events JOIN (VALUES {SQL_VIOLATIONS}) v(kind, number, place, reason) ON event_type = kind GROUP BY event_id, reason
UNION ALL SELECT event_id, NULL, NULL FROM events WHERE event_type = 'view'""")
def quarantined_records(spark, sf):
    """Records of the declared shape, and the others from their quarantine."""
    good, bad = V.split_by_envelope(varied_records(spark, sf), "function_calling")
    path = fresh_path(spark, "quarantine")
    quarantine(bad, path)
    nothing = F.lit(None).cast("string")
    read = spark.read.parquet(path).select("event_id", "reason", F.array_join("places", " ").alias("places"))
    return read.unionByName(good.select("event_id", nothing.alias("reason"), nothing.alias("places")))


SQL_JSON_RECORD = """'{"messages": [{"role": "user", "content": "give k for ' || user_id || '"}, {"role": "assistant", "content": '
    || CASE event_type WHEN 'signup' THEN '{}' WHEN 'error' THEN '"' || user_id || '"' ELSE props END || '}], "pydantic_schema": '
    || CASE event_type WHEN 'view' THEN '{}' ELSE '%s' END || '}'"""
SQL_SCHEMA_TEXT = SCHEMA.replace(": ", ":").replace(", ", ",")


@query(f"""
SELECT CAST(event_id AS VARCHAR) AS id, 'events' AS category, event_type AS subcategory, {lit(SQL_SCHEMA_TEXT)} AS schema,
       {lit(M.JSON_MODE_INTRO)} || chr(10) || '<schema>' || chr(10) || {lit(SQL_SCHEMA_TEXT)} || chr(10) || '</schema>' || chr(10) AS system,
       'give k for ' || user_id AS human, replace(props, ' ', '') AS gpt
FROM events WHERE event_type IN ('click', 'purchase') AND {SQL_K} <= 49""")
def json_mode_export(spark, sf):
    records = table(spark, sf, "events", spread_out=True).select(
        F.col("event_id").cast("string").alias("id"), F.lit("events").alias("category"),
        F.col("event_type").alias("subcategory"), F.expr(SQL_JSON_RECORD % SCHEMA).alias("record"))
    rows = export_json_mode(records)
    said = lambda i: F.get("conversations", F.lit(i))["value"]
    return rows.select("id", "category", "subcategory", "schema", said(0).alias("system"), said(1).alias("human"), said(2).alias("gpt"))
