"""Scoring completions and making preference pairs."""

import json
import re

from pyspark.sql import functions as F

from ..functions import messages as M
from ..operators.scoring import failed_pairs as pairs_of_failed, pass_rate as rate, score_completions
from ..plans.export import evaluate, evaluate_dataset
from ..plans.preference import build_preferences, correct_calls, export_preferences, paired
from ..session import fresh_path
from .registry import lit, query, table
from .validation import SIGNATURES, SQL_K, SQL_MESSAGE, event_records

# A sample per event: one expected call (two for 'signup'), and what a model said about it.
# 'view' repeats it with other spelling, 'click' calls with k + 1, 'purchase' has a further argument and a
# second call of the same name that agrees only for even users, 'signup' forgets the second, 'error' calls nothing.
SQL_EXPECTED = f"""CASE event_type
    WHEN 'signup' THEN '[{{"name": "signup", "arguments": {{"k": ' || {SQL_K} || ', "x": null}}}}, {{"name": "confirm", "arguments": {{}}}}]'
    ELSE '{{"name": "' || event_type || '", "arguments": {{"k": ' || {SQL_K} || ', "list": [true, {{"b": 1.50, "a": "1.0"}}]}}}}' END"""
SQL_SAID = f"""'<|im_start|>user' || chr(10) || 'go<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) || CASE event_type
    WHEN 'view' THEN '<tool_call>{{"arguments": {{"list": [1, {{"a": "1.0", "b": 1.5}}], "k": ' || {SQL_K} || '.0}}, "name": "view"}}</tool_call>'
    WHEN 'click' THEN '<tool_call>{{"name": "click", "arguments": {{"k": ' || ({SQL_K} + 1) || ', "list": [true, {{"b": 1.50, "a": "1.0"}}]}}}}</tool_call>'
    WHEN 'purchase' THEN '<tool_call>{{"name": "purchase", "arguments": {{"k": ' || {SQL_K} || ', "list": [true, {{"b": 1.50, "a": "1.0"}}], "more": 1}}}}</tool_call>'
         || '<tool_call>{{"name": "purchase", "arguments": {{"k": ' || ({SQL_K} + CAST(value > 20 AS INTEGER)) || ', "list": [true, {{"b": 1.50, "a": "1.0"}}]}}}}</tool_call>'
    WHEN 'signup' THEN '<tool_call>{{"name": "signup", "arguments": {{"k": ' || {SQL_K} || '}}}}</tool_call>'
         || CASE WHEN value > 20 THEN '<tool_call>{{"name": "confirm", "arguments": {{"sure": 1}}}}' ELSE '' END
    ELSE 'no, sorry' END"""
SQL_PASSED = """CASE event_type WHEN 'view' THEN true WHEN 'purchase' THEN value <= 20 WHEN 'signup' THEN value > 20 ELSE false END"""


def samples(spark, sf):
    rows = table(spark, sf, "events", spread_out=True)
    rows.createOrReplaceTempView("loomcraft_samples")
    return spark.sql(f"""
        SELECT event_id, event_type, 'tools of ' || event_type AS system, 'ask ' || user_id AS user,
               {SQL_EXPECTED} AS completion, {SQL_SAID} AS model_output FROM loomcraft_samples""")


def scored(spark, sf):
    return score_completions(samples(spark, sf))


SQL_BLOCK = "'<tool_call>' || chr(10) || %s || chr(10) || '</tool_call>' || chr(10)"
SQL_SHOWN = f"""CASE event_type
    WHEN 'view' THEN {SQL_BLOCK % f'''('{{"arguments": {{"list": [1, {{"a": "1.0", "b": 1.5}}], "k": ' || {SQL_K} || '.0}}, "name": "view"}}')'''}
    WHEN 'click' THEN {SQL_BLOCK % f'''('{{"name": "click", "arguments": {{"k": ' || ({SQL_K} + 1) || ', "list": [true, {{"b": 1.50, "a": "1.0"}}]}}}}')'''}
    WHEN 'purchase' THEN {SQL_BLOCK % f'''('{{"name": "purchase", "arguments": {{"k": ' || {SQL_K} || ', "list": [true, {{"b": 1.50, "a": "1.0"}}], "more": 1}}}}')'''}
         || {SQL_BLOCK % f'''('{{"name": "purchase", "arguments": {{"k": ' || ({SQL_K} + CAST(value > 20 AS INTEGER)) || ', "list": [true, {{"b": 1.50, "a": "1.0"}}]}}}}')'''}
    WHEN 'signup' THEN {SQL_BLOCK % f'''('{{"name": "signup", "arguments": {{"k": ' || {SQL_K} || '}}}}')'''}
         || CASE WHEN value > 20 THEN {SQL_BLOCK % """'{"name": "confirm", "arguments": {"sure": 1}}'"""} ELSE '' END
    ELSE 'no, sorry' END"""


@query(f"""
SELECT event_id, {SQL_SHOWN} AS model_completion, CASE WHEN {SQL_PASSED} THEN 'passed' ELSE 'failed' END AS result FROM events""")
def scored_samples(spark, sf):
    return scored(spark, sf).select("event_id", "model_completion", "result")


@query(f"""
SELECT event_type, count(*) FILTER ({SQL_PASSED}) AS n_passed, count(*) FILTER (NOT {SQL_PASSED}) AS n_failed,
       avg(CASE WHEN {SQL_PASSED} THEN 1.0 ELSE 0.0 END) AS pass_rate
FROM events GROUP BY event_type""")
def pass_rate(spark, sf):
    return rate(scored(spark, sf), ["event_type"])


@query(f"""
SELECT 'tools of ' || event_type AS system, 'ask ' || user_id AS question, {SQL_SHOWN} AS rejected,
       CASE event_type WHEN 'signup' THEN {SQL_BLOCK % f'''('{{"name":"signup","arguments":{{"k":' || {SQL_K} || ',"x":null}}}}')'''}
            || {SQL_BLOCK % """'{"name":"confirm","arguments":{}}'"""}
       ELSE {SQL_BLOCK % f'({SQL_EXPECTED})'} END AS chosen
FROM events WHERE NOT {SQL_PASSED}""")
def failed_pairs(spark, sf):
    return pairs_of_failed(scored(spark, sf))


def corrector(request: str) -> str:
    """A stand-in model: repairs purchases at the second attempt, clicks at the first, nothing else."""
    asked = json.loads(request)
    prompt = asked["prompt"]
    name, k = re.search(r"do (\w+) with (\d+)", prompt).groups()
    if name == "click":
        arguments = {"k": f"v{k}"}
    elif name == "purchase":
        arguments = {"k": int(k), "amount": "much"} if "Missing" in prompt else {"k": int(k), "amount": 1.5}
    else:
        arguments = {}
    call = {"id": "n", "type": "function", "function": {"name": name, "arguments": json.dumps(arguments)}}
    return json.dumps({"role": "assistant", "tool_calls": [call]})


SQL_FENCE = "'```tool_call' || chr(10) || %s || chr(10) || '```' || chr(10)"


@query(f"""
SELECT event_id AS id, '```tools' || chr(10) || {lit("[" + ",".join(SIGNATURES) + "]")} || chr(10) || '```' AS system,
       'do ' || event_type || ' with ' || {SQL_K} AS user,
       {SQL_FENCE % f'''('{{"arguments":' || CASE event_type WHEN 'click' THEN '{{"k": "v' || {SQL_K} || '"}}'
           ELSE '{{"k": ' || {SQL_K} || ', "amount": 1.5}}' END || ',"name":"' || event_type || '"}}')'''} AS chosen,
       {SQL_FENCE % '''('{"arguments":' || props || ',"name":"' || event_type || '"}')'''} AS rejected
FROM events WHERE event_type = 'purchase' OR (event_type = 'click' AND {SQL_K} <> 0)""")
def correction_pairs(spark, sf):
    call = F.struct(
        F.lit("c").alias("id"), F.lit("function").alias("type"),
        F.struct(F.col("event_type").alias("name"), F.col("props").alias("arguments")).alias("function"))
    conversations = table(spark, sf, "events", spread_out=True).select(
        F.col("event_id").alias("conv_id"),
        F.concat(F.lit("do "), "event_type", F.lit(" with "), F.regexp_extract("props", "[0-9]+", 0)).alias("user"),
        F.array(*[F.lit(s) for s in SIGNATURES]).alias("tools"), F.array(call).alias("tool_calls"))
    return paired(*correct_calls(conversations, corrector))


def fixer(request: str) -> str:
    """A stand-in model that repairs clicks only."""
    name = "click" if json.loads(request)["prompt"].startswith("do click ") else "nothing"
    call = {"id": "n", "type": "function", "function": {"name": name, "arguments": "{}"}}
    return json.dumps({"role": "assistant", "tool_calls": [call]})


@query(f"""
SELECT CAST(event_id AS VARCHAR) AS id, 'do click for ' || user_id AS user,
       {SQL_FENCE % """'{"arguments":{},"name":"click"}'"""} AS chosen,
       {SQL_FENCE % f"""('{{"arguments":{{"k": ' || {SQL_K} || '}},"name":"click"}}')"""}
       || CASE WHEN value > 20 THEN {SQL_FENCE % """'{"arguments":{},"name":"signup"}'"""} ELSE '' END AS rejected
FROM events WHERE event_type = 'click' AND {SQL_MESSAGE} <> 'Function call is valid'""")
def preference_records(spark, sf):
    """Preference pairs from whole chat records."""
    records = event_records(spark, sf).withColumn("source", F.col("id"))
    return build_preferences(records, fixer, max_files=None).select("id", "user", "chosen", "rejected")


@query(f"""
SELECT CAST(event_id AS VARCHAR) AS id, 'do click for ' || user_id AS user
FROM events WHERE event_type = 'click' AND {SQL_MESSAGE} <> 'Function call is valid' ORDER BY event_id LIMIT 20""")
def first_preferences(spark, sf):
    """The first twenty preference pairs (a cap on successes) of a model that can mend clicks only."""
    records = event_records(spark, sf).withColumn("source", F.lpad("id", 12, "0"))
    return build_preferences(records, fixer, max_files=20).select("id", "user")


def speller(prompt: str) -> str:
    """A stand-in model: calls what the user names, spelling numbers as fractions; errors get words."""
    name, k = re.search(r"user\n(\w+) (\d+)<", prompt).groups()
    return "no" if name == "error" else '<tool_call>{"name": "%s", "arguments": {"k": %s.0}}' % (name, k)


SQL_SPELLED = f"""
SELECT event_id, CASE WHEN event_type = 'error' THEN 'failed' ELSE 'passed' END AS result,
       CASE WHEN event_type = 'error' THEN 'no'
            ELSE {SQL_BLOCK % f"""('{{"name": "' || event_type || '", "arguments": {{"k": ' || {SQL_K} || '.0}}}}')"""} END AS model_completion
FROM events"""


def spelling_samples(spark, sf):
    number = F.regexp_extract("props", "[0-9]+", 0)
    turn = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return table(spark, sf, "events", spread_out=True).select(
        "event_id", F.array(turn("system", F.lit("tools")), turn("user", F.concat_ws(" ", "event_type", number))).alias("prompt"),
        F.concat(F.lit('{"name": "'), "event_type", F.lit('", "arguments": {"k": '), number, F.lit("}}")).alias("completion"),
        F.lit("s").alias("system"), F.lit("u").alias("user"))


@query(SQL_SPELLED)
def evaluated_samples(spark, sf):
    """Prompts rendered, answered by a client and scored."""
    return evaluate(spelling_samples(spark, sf), speller).select("event_id", "result", "model_completion")


@query(f"{SQL_SPELLED} ORDER BY event_id LIMIT 1000")
def evaluated_first_samples(spark, sf):
    """The first thousand samples of a data set of many files (a cap the user sets); the other files are neither read nor asked."""
    path = fresh_path(spark, "samples")
    spelling_samples(spark, sf).repartitionByRange(24, "event_id").sortWithinPartitions("event_id").write.parquet(path)
    return evaluate_dataset(spark, path, speller, num_samples=1000).select("event_id", "result", "model_completion")


@query(f"""
SELECT {lit(M.TOOL_CALLER_INTRO)} || chr(10) || '<tools>' || chr(10) || '[{{"name": "' || event_type || '"}}]' || chr(10) || '</tools>' || chr(10)
       || {lit(M.PREFERENCE_OUTRO)} AS system, 'ask ' || user_id AS question,
       '<tool_call>' || chr(10) || '{{"name": "' || event_type || '", "arguments": ' || props || '}}' || chr(10) || '</tool_call>' || chr(10) AS chosen,
       CASE WHEN event_type = 'error' THEN 'nothing to call'
            ELSE '<tool_call>' || chr(10) || '{{"name": "' || event_type || '", "arguments": {{}}}}' || chr(10) || '</tool_call>' || chr(10) END AS rejected
FROM events
UNION ALL SELECT NULL, text, NULL, NULL FROM benchmark""")
def preference_export(spark, sf):
    name = F.col("event_type")
    pairs = table(spark, sf, "events", spread_out=True).select(
        F.col("event_id").alias("id"), M.fenced_tools(F.concat(F.lit('[{"name": "'), name, F.lit('"}]'))).alias("system"),
        F.concat(F.lit("ask "), F.col("user_id").cast("string")).alias("human"),
        M.fenced_call_block(F.concat(F.lit('{"name": "'), name, F.lit('", "arguments": '), "props", F.lit("}"))).alias("accepted"),
        F.when(name == "error", F.lit("nothing to call")).otherwise(
            M.fenced_call_block(F.concat(F.lit("{'name': '"), name, F.lit("', 'arguments': {}}")))).alias("rejected"))
    side = table(spark, sf, "benchmark").select(F.col("text").alias("question"))
    return export_preferences(pairs, side)
