"""Replies: JSON salvage, fenced and tagged calls, envelopes, chat templates."""

from pyspark.sql import functions as F

from ..functions import jsons as J, messages as M, text as X
from ..operators.conversations import chatml_by_conversation, last_by_role
from ..operators.replies import with_fenced_calls, with_fenced_tools, with_tool_calls
from ..plans.generation import tool_message_texts
from .registry import lit, query, table

# A reply per event: bare JSON, JSON in prose, two objects, an empty object, an unclosed one.
SQL_REPLY = """CASE event_type
    WHEN 'click' THEN props
    WHEN 'view' THEN 'Sure, here it is: ' || props || ' - anything else?'
    WHEN 'purchase' THEN 'One ' || props || ' and another {"b": 1}'
    WHEN 'signup' THEN '{ }'
    ELSE 'I apologize, {"k": ' || user_id END"""


@query(f"""
SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN props END AS reply
FROM (SELECT *, {SQL_REPLY} AS completion FROM events)""")
def salvage_json(spark, sf):
    replies = table(spark, sf, "events", spread_out=True).withColumn("completion", F.expr(SQL_REPLY))
    return replies.select("event_id", J.salvaged("completion").alias("reply"))


# A text with two fenced calls per event: JSON, a Python literal (true for 'view'), or neither.
SQL_FENCED = """'```tools' || chr(10) || '[{"name": "' || event_type || '"}]' || chr(10) || '```' || chr(10) || 'Calling.' || chr(10)
    || '```tool_call' || chr(10) || '{"name": "' || event_type || '", "arguments": ' || props || '}' || chr(10) || '```'
    || chr(10) || 'and' || chr(10) || '```tool_call' || chr(10)
    || CASE event_type WHEN 'view' THEN '{''name'': ''again'', ''arguments'': {''k'': ' || user_id || ', ''on'': True, ''x'': None}}'
                       WHEN 'error' THEN '{name: broken(}'
                       ELSE '{"name": "again", "arguments": {"k": ' || user_id || '}}' END
    || chr(10) || '```' || chr(10)"""
SPARK_FENCED = SQL_FENCED.replace("''", "\\'")


@query("""
SELECT event_id, '[{"name": "' || event_type || '"}]' AS tools, CASE WHEN event_type = 'error' THEN 1 ELSE 2 END AS n_calls,
       '{"name": "' || event_type || '", "arguments": ' || props || '}' || CASE event_type
           WHEN 'view' THEN '|{"name": "again", "arguments": {"k": ' || user_id || ', "on": true, "x": null}}'
           WHEN 'error' THEN '' ELSE '|{"name": "again", "arguments": {"k": ' || user_id || '}}' END AS calls
FROM events""")
def fenced_calls(spark, sf):
    texts = table(spark, sf, "events", spread_out=True).select("event_id", F.expr(SPARK_FENCED).alias("content"))
    read = with_fenced_tools(with_fenced_calls(texts, "content"), "content")
    return read.select("event_id", "tools", F.size("calls").alias("n_calls"), F.array_join("calls", "|").alias("calls"))


# What a model says per event: prose between calls, a Python literal, an unclosed last call, or no call.
SQL_OUTPUT = """'<|im_start|>system' || chr(10) || 'You have tools.<tool_call>{"name": "not this"}</tool_call><|im_end|>' || chr(10)
    || '<|im_start|>assistant' || chr(10) || CASE event_type
        WHEN 'error' THEN 'I cannot do that.'
        ELSE '<tool_call>' || chr(10) || '{"arguments": ' || props || ', "name": "' || event_type || '"}' || chr(10) || '</tool_call> then '
             || CASE event_type
                  WHEN 'view' THEN '<tool_call>{''arguments'': {''k'': ' || user_id || '}, ''name'': ''again''}</tool_call> done'
                  WHEN 'click' THEN '<tool_call>{"arguments": {"k": ' || user_id || '}, "name": "again"}'
                  WHEN 'signup' THEN '<tool_call>again please</tool_call>'
                  ELSE 'that is all & <enough>' END END"""


@query("""
SELECT event_id, event_type <> 'error' AS parsed,
       CASE WHEN event_type = 'error' THEN '' ELSE '{"arguments": ' || props || ', "name": "' || event_type || '"}' END || CASE event_type
           WHEN 'view' THEN '|{"arguments": {"k": ' || user_id || '}, "name": "again"}'
           WHEN 'click' THEN '|{"arguments": {"k": ' || user_id || '}, "name": "again"}' ELSE '' END AS calls
FROM events""")
def tool_call_extraction(spark, sf):
    outputs = table(spark, sf, "events", spread_out=True).select("event_id", F.expr(SQL_OUTPUT.replace("''", "\\'")).alias("output"))
    read = with_tool_calls(outputs, "output")
    return read.select("event_id", "parsed", F.array_join("calls", "|").alias("calls"))


@query(f"""
SELECT doc_id, regexp_replace(regexp_replace(text, '^[{X.SPACE}]+', ''), '[{X.SPACE}]+$', '') AS chatml_turn,
       regexp_replace(regexp_replace(text, '^[{X.SPACE}]+', ''), '[{X.SPACE}]+$', '') AS zephyr_turn,
       '' AS no_turn
FROM documents""")
def assistant_turns(spark, sf):
    docs = table(spark, sf, "documents")
    chatml = F.concat(F.lit("<|im_start|>user\n"), "source", F.lit("<|im_end|>\n<|im_start|> assistant\nno<|im_end|>\n<|im_start|>assistant\n"), "text")
    zephyr = F.concat(F.lit("<|user|>\n"), "source", F.lit("<|assistant|>\n"), "text", F.lit("  \n"))
    turns = docs.select("doc_id", chatml.alias("c"), zephyr.alias("z"))
    return turns.select(
        "doc_id", M.assistant_turn("c").alias("chatml_turn"), M.assistant_turn("z", "zephyr").alias("zephyr_turn"),
        M.assistant_turn("z").alias("no_turn"))


@query("""
SELECT event_id,
       CASE WHEN event_type = 'error' THEN '' ELSE '{"name":"' || event_type || '","arguments":"{\\"k\\":' || user_id || '}"}' END AS calls,
       CASE WHEN event_type = 'error' THEN 'nothing to call for ' || user_id END AS content
FROM events""")
def reply_payloads(spark, sf):
    calling = F.concat(
        F.lit('{"id":"x","choices":[{"index":0,"message":{"role":"assistant","content":null,"tool_calls":[{"id":"1","type":"function","function":{"name":"'),
        "event_type", F.lit('","arguments":"{\\"k\\":'), F.col("user_id").cast("string"), F.lit('}"}}]}}]}'))
    saying = F.concat(F.lit('{"choices":[{"message":{"content":"nothing to call for '), F.col("user_id").cast("string"), F.lit('"}}]}'))
    envelope = F.when(F.col("event_type") == "error", saying).otherwise(calling)
    read = table(spark, sf, "events").select("event_id", M.reply_payload(envelope).alias("p"))
    return read.select("event_id", F.coalesce(F.array_join("p.calls", "|"), F.lit("")).alias("calls"), "p.content")


@query("""
SELECT event_id, '{"role":"assistant"' || CASE WHEN event_type = 'error' THEN ',"content":"failed"' ELSE '' END
       || ',"k":' || user_id || '}' AS message
FROM events""")
def without_nulls(spark, sf):
    text = F.concat(
        F.lit('{"role": "assistant", "content": '),
        F.when(F.col("event_type") == "error", F.lit('"failed"')).otherwise(F.lit("null")),
        F.lit(', "function_call": null, "k": '), F.col("user_id").cast("string"), F.lit("}"))
    return table(spark, sf, "events").select("event_id", J.without_nulls(text).alias("message"))


@query("""
SELECT event_id, '{"role":"tool","name":"' || event_type || '","content":"{\\"k\\":' || user_id || ',\\"a\\":[1,2]}"}' AS message
FROM events""")
def tool_messages(spark, sf):
    results = F.concat(
        F.lit('{"tools": [{"role": "tool", "name": "'), "event_type", F.lit('", "content": {"k": '),
        F.col("user_id").cast("string"), F.lit(', "a": [1, 2]}}]}'))
    return table(spark, sf, "events").select("event_id", F.explode(tool_message_texts(results)).alias("message"))


@query("""
SELECT conv_id, arg_max(text, turn) FILTER (role = 'user') AS last_user,
       arg_max(text, turn) FILTER (role = 'assistant') AS last_assistant,
       arg_max(text, turn) FILTER (role = 'system') AS last_system
FROM conversations GROUP BY conv_id""")
def last_turns(spark, sf):
    return last_by_role(table(spark, sf, "conversations"), roles=("user", "assistant", "system"))


@query("""
SELECT conv_id, (place - 1) // 10000 AS part,
       string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY place) AS chatml
FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place FROM conversations) GROUP BY ALL""")
def chatml_render(spark, sf):
    return chatml_by_conversation(table(spark, sf, "conversations"))


@query("""
SELECT doc_id, '<|im_start|>system' || chr(10) || source || '<|im_end|>' || chr(10) || '<|im_start|>user' || chr(10) || text
       || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) AS chatml
FROM documents""")
def chatml_prompts(spark, sf):
    turns = F.array(
        F.struct(F.lit("system").alias("role"), F.col("source").alias("content")),
        F.struct(F.lit("user").alias("role"), F.col("text").alias("content")))
    return table(spark, sf, "documents").select("doc_id", M.chatml(turns, generation_prompt=True).alias("chatml"))


@query(f"""
SELECT conv_id, CASE WHEN length(s) > 0 THEN '<|im_start|>system' || chr(10) || s || '<|im_end|>' || chr(10) ELSE '' END
       || '<|im_start|>user' || chr(10) || u || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) AS prompt,
       a || {lit(M.END_OF_TEXT)} AS chosen, u || {lit(M.END_OF_TEXT)} AS rejected
FROM (SELECT conv_id, arg_max(text, turn) FILTER (role = 'user') AS u, arg_max(text, turn) FILTER (role = 'assistant') AS a,
             coalesce(arg_max(text, turn) FILTER (role = 'system'), '') AS s FROM conversations GROUP BY conv_id)""")
def preference_format(spark, sf):
    turns = last_by_role(table(spark, sf, "conversations"), roles=("user", "assistant", "system"))
    rows = turns.withColumn("last_system", F.coalesce("last_system", F.lit("")))
    return rows.select("conv_id", *M.preference_row("last_system", "last_user", "last_assistant", "last_user"))
