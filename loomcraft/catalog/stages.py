"""The completion stage and the jobs built around it, with stand-in clients.

The clients are plain functions of the prompt, so SQL can say what they answer.
"""

import json
import re

from pyspark.sql import functions as F

from ..operators.binding import distinct
from ..operators.completion import complete, failures
from ..operators.prompts import MINING_CODE, MINING_SCHEMA
from ..plans import curricula as C, generation as G, mining
from ..session import fresh_path
from .registry import query, table
from .texts import RUN_DATE, industry_sheet, sql_slug
from .validation import SCHEMA, SQL_K


def reverse(prompt: str) -> str:
    """Answers with the prompt backwards; the first words decide whether it fails."""
    if prompt.startswith("error"):
        raise RuntimeError("no answer to " + prompt)
    return prompt[::-1]


SQL_PROMPT = "event_type || ' ' || user_id || ' ' || props"


def event_prompts(spark, sf):
    prompt = F.expr(SQL_PROMPT.replace("user_id", "cast(user_id AS STRING)"))
    return table(spark, sf, "events", spread_out=True).select("event_id", prompt.alias("prompt"))


def answered(spark, sf):
    return complete(event_prompts(spark, sf), "prompt", reverse)


@query(f"""
SELECT event_id, CASE WHEN event_type <> 'error' THEN reverse({SQL_PROMPT}) END AS completion,
       CASE WHEN event_type = 'error' THEN 'no answer to ' || {SQL_PROMPT} END AS error,
       CASE WHEN event_type = 'error' THEN 3 ELSE 1 END AS attempts
FROM events""")
def batch_complete(spark, sf):
    return answered(spark, sf).select("event_id", "completion", "error", "attempts")


@query(f"SELECT event_id, 'no answer to ' || {SQL_PROMPT} AS error FROM events WHERE event_type = 'error'")
def completion_failures(spark, sf):
    return failures(answered(spark, sf)).select("event_id", "error")


def shout(prompt: str) -> str:
    """Answers with the prompt in capitals, errors as well."""
    return prompt.upper()


@query(f"""
SELECT event_id, CASE WHEN event_type IN ('view', 'click') THEN reverse({SQL_PROMPT}) ELSE upper({SQL_PROMPT}) END AS completion,
       CAST(NULL AS VARCHAR) AS error, 1 AS attempts
FROM events""")
def resumed_completions(spark, sf):
    """A first job got as far as views, clicks and errors, whose calls failed; a second one asks for all events with another
    client and the first job's log: what was answered stays, errors and the rest are asked."""
    log = fresh_path(spark, "answers")
    prompts = event_prompts(spark, sf)
    complete(prompts.filter("prompt rlike '^(view|click|error) '"), "prompt", reverse, log=log, slices=3)
    return complete(prompts, "prompt", shout, log=log, slices=3, in_flight=4).select("event_id", "completion", "error", "attempts")


FORWARD = {"Role": "Write JSON.", "Objective": "{category}|{subcategory}|{task}", "Documents": "{doc_list}", "Assistant": "Now:"}


def summarise(prompt: str) -> str:
    """Answers with what it was asked and how many documents it was given, in prose."""
    asked = re.search(r"Objective:\n(.*)\nGuidelines:", prompt, re.S).group(1)
    category, subcategory, _ = asked.split("|", 2)
    return "Sure: " + json.dumps({"c": category, "s": subcategory, "docs": prompt.count("<doc index=")}) + " done"


@query(f"""
WITH tasks AS (
  SELECT s_suppkey, s_name, 'results/acme_{RUN_DATE}/' || replace(s_name, ' ', '_') || '/s' || s_nationkey || '/' || {sql_slug("'list ' || s_name || ' parts'")} || '.json' AS path,
         s_nationkey FROM supplier),
docs AS (
  SELECT s_suppkey, n, sum(len) OVER (PARTITION BY s_suppkey ORDER BY p_partkey ROWS UNBOUNDED PRECEDING) AS total
  FROM (SELECT s_suppkey, p_partkey, 1 AS n, length(regexp_replace(p_name || ' ' || p_brand, '[^a-zA-Z0-9 ]', '', 'g')) AS len
        FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey)),
packed AS (SELECT s_suppkey, count(*) AS docs FROM docs WHERE total <= 1000 GROUP BY s_suppkey)
SELECT path, s_name AS category, 's' || s_nationkey AS subcategory, 'list ' || s_name || ' parts' AS task,
       '{{"c": "' || s_name || '", "s": "s' || s_nationkey || '", "docs": ' || coalesce(docs, 0) || '}}' AS reply
FROM tasks LEFT JOIN packed USING (s_suppkey) WHERE s_nationkey <> 0""")
def forward_generation(spark, sf):
    """Suppliers as tasks, the parts they ship as documents; suppliers of the first nation are done already."""
    suppliers = table(spark, sf, "supplier").select(
        "s_suppkey", F.col("s_name").alias("category"), F.concat(F.lit("s"), F.col("s_nationkey").cast("string")).alias("subcategory"),
        F.concat(F.lit("list "), "s_name", F.lit(" parts")).alias("task"), "s_nationkey")
    prepared = G.prepared_tasks(suppliers, "acme", RUN_DATE, 4500)
    shipped = distinct(table(spark, sf, "lineitem").select("l_suppkey", "l_partkey"))
    parts = table(spark, sf, "part").select(
        "p_partkey", F.concat(F.lit("http://part/"), F.col("p_partkey").cast("string")).alias("url"),
        F.concat_ws(" ", "p_name", "p_brand").alias("content"))
    documents = (
        shipped.join(parts, F.col("l_partkey") == F.col("p_partkey"))
        .join(prepared.select("s_suppkey", "task_key"), F.col("l_suppkey") == F.col("s_suppkey"))
        .select("task_key", F.col("p_partkey").alias("rank"), "url", "content", F.lit(None).cast("array<array<array<string>>>").alias("tables")))
    done = prepared.filter("s_nationkey = 0").select("task_key")
    good, _ = G.generate_forward(suppliers, documents, None, FORWARD, "{}", summarise, "acme", RUN_DATE, 4500, done)
    return good.select("path", "category", "subcategory", "task", "reply")


SAME_START = "Describe the calls that a document of this language and source needs, given its length of "


@query(f"""
SELECT DISTINCT lang AS category, source AS subcategory, '{SAME_START}' || n_chars AS task,
       '{{"c": "' || lang || '", "s": "' || source || '", "docs": 1}}' AS reply
FROM documents""")
def repeated_tasks(spark, sf):
    """Tasks that many documents repeat and that differ only behind a long common start; each has one document to read."""
    tasks = table(spark, sf, "documents").select(
        F.col("lang").alias("category"), F.col("source").alias("subcategory"),
        F.concat(F.lit(SAME_START), F.col("n_chars").cast("string")).alias("task"))
    documents = G.prepared_tasks(tasks, "acme", RUN_DATE, 4500).select(
        "task_key", F.lit(0).alias("rank"), F.lit("u").alias("url"), F.col("task").alias("content"),
        F.lit(None).cast("array<array<array<string>>>").alias("tables"))
    good, _ = G.generate_forward(tasks, documents, None, FORWARD, "{}", summarise, "acme", RUN_DATE, 4500)
    return good.select("category", "subcategory", "task", "reply")


QUERY_SECTIONS = {"Role": "ask", "Objective": "{user_message}/{assistant_message}/{tool_call_results}"}
RESULT_SECTIONS = {"Role": "results", "Objective": "{user_message}/{results_summary}"}


def writer(request: str) -> str:
    """Writes the user query, or the tool results, a request asks for."""
    asked = json.loads(request)["messages"][0]["content"]
    objective = re.search(r"Objective:\n(.*)\nGuidelines:", asked, re.S).group(1)
    if asked.startswith("Role:\nask"):
        return "please " + objective.split("/")[0]
    return "Here: " + json.dumps({"tools": [{"role": "tool", "name": "t", "content": {"said": objective}}]})


def caller(request: str) -> str:
    """Calls a function, or sums up once there are tool results."""
    asked = json.loads(request)
    if asked["tool_choice"] == "auto":
        name = asked["tools"][0]["function"]["name"]
        return json.dumps({"role": "assistant", "content": None, "tool_calls": [{"id": "1", "name": name}]})
    return json.dumps({"role": "assistant", "content": f"{len(asked['messages'])} messages"})


@query("""
SELECT event_id AS task_key, 'results/' || user_id AS path,
  '{"messages":[{"role":"user","content":"please do ' || event_type || '"},'
  || '{"role":"assistant","tool_calls":[{"id":"1","name":"' || event_type || '"}]},'
  || '{"role":"tool","name":"t","content":"{\\"said\\":\\"please do ' || event_type || '/did ' || user_id || '\\"}"},'
  || '{"role": "assistant", "content": "3 messages"}],"tools":[{"type":"function","function":{"name":"' || event_type
  || '","description":"","parameters":{"type":"object","properties":{},"required":[]}}}]}' AS record
FROM events WHERE event_type <> 'error'""")
def stepwise_generation(spark, sf):
    """Event records rebuilt in steps; those of type error are done already. All records of a user have one path."""
    record = F.concat(
        F.lit('{"messages": [{"role": "user", "content": "do '), "event_type",
        F.lit('"}, {"role": "assistant", "tool_calls": [{"id": "0"}]}, {"role": "tool", "content": {"x": 1}}, {"role": "assistant", "content": "did '),
        F.col("user_id").cast("string"), F.lit('"}], "tools": [{"name": "'), "event_type", F.lit('"}]}'))
    empty = F.lit("")
    records = table(spark, sf, "events", spread_out=True).select(
        F.col("event_id").alias("task_key"), F.concat(F.lit("results/"), F.col("user_id").cast("string")).alias("path"), "event_type", record.alias("record"),
        empty.alias("category"), empty.alias("subcategory"), empty.alias("task"), empty.alias("doc_list"), empty.alias("examples"))
    done = records.filter("event_type = 'error'").select("task_key")
    return G.regenerate_in_steps(records.drop("event_type"), QUERY_SECTIONS, RESULT_SECTIONS, writer, caller, done)


def miner(prompt: str) -> str:
    """Names the task after the length of the code it was shown."""
    code = prompt.split(MINING_CODE, 1)[1].rsplit("\n" + MINING_SCHEMA, 1)[0]
    return json.dumps({"Category": "code", "SubCategory": "x", "Task": f"read {len(code)}", "Schema": {}})


@query("""
SELECT task_file, min(path) AS path, arg_min('{"Category": "code", "SubCategory": "x", "Task": "read ' || length(code) || '", "Schema": {}}', path) AS task_json
FROM (SELECT 'f' || doc_id || '.json' AS task_file, 'f' || doc_id || '.py' AS path, text AS code FROM documents)
WHERE task_file NOT IN (SELECT 'f' || doc_id || '.json' FROM labels WHERE toxic = 1)
GROUP BY task_file""")
def mined_tasks(spark, sf):
    """A task per document taken as a source file; those labelled toxic are done already."""
    name = lambda suffix: F.concat(F.lit("f"), F.col("doc_id").cast("string"), F.lit(suffix))
    code = table(spark, sf, "documents").select(name(".py").alias("path"), F.col("text").alias("code"))
    done = table(spark, sf, "labels").filter("toxic = 1").select(name(".json").alias("task_file"))
    return C.mine_tasks(code, [], "{}", miner, done)


MINED_SECTIONS = {"Role": "Write a record.", "Objective": "{category}|{task}", "Documents": "{doc_list}", "Assistant": "Now:"}


def mined_records(prompt: str) -> str:
    """Mines a task from code, or makes a record for a task, by how long the code is. Of every four lengths one goes well at once,
    one is mined at the second try, one makes an object that fits at the third, one never does."""
    head, told, fault = prompt.partition("\nAnswer ")
    if head.startswith("Please extract"):
        code = head.split(MINING_CODE, 1)[1].rsplit("\n" + MINING_SCHEMA, 1)[0]
        if len(code) % 4 in (1, 2) and not told:
            return "no idea"
        return json.dumps({"Category": "code", "Task": f"read {len(code)}"})
    read = int(re.search(r"Objective:\ncode\|read (\d+)\n", head).group(1))
    fits = read % 4 < 2 or read % 4 == 2 and fault.startswith("2 ")
    return '{"messages": [{"role": "assistant", "content": {"k": %d}}], "pydantic_schema": %s}' % (read % 50 if fits else 50, SCHEMA)


@query("""
WITH files AS (SELECT 'f' || doc_id || '.py' AS path, length(coalesce(text, '')) AS n FROM documents)
SELECT path, '{"Category": "code", "Task": "read ' || n || '"}' AS task_json,
       CASE WHEN n % 4 < 3 THEN '{"k":' || n % 50 || '}' END AS json_object,
       CAST(least(n % 4 + 1, 3) AS INTEGER) AS rounds, n % 4 = 3 AS failed
FROM files""")
def mined_and_generated(spark, sf):
    """Every document as a source file: a task mined from it, a record made for the task, failing rows asked up to three times."""
    path = F.concat(F.lit("f"), F.col("doc_id").cast("string"), F.lit(".py")).alias("path")
    code = table(spark, sf, "documents").select(path, F.col("text").alias("code"))
    fine, failed = mining.mine_and_generate(code, [], "{}", MINED_SECTIONS, "{}", mined_records, tell_fault=True)
    return fine.select("path", "task_json", "json_object", "rounds", F.lit(False).alias("failed")).unionByName(
        failed.select("path", "task_json", F.lit(None).cast("string").alias("json_object"), "rounds", F.lit(True).alias("failed")))


def industry(prompt: str) -> str:
    """Two tasks per industry row; now and then one of them lacks its schema."""
    row = json.loads(prompt.rsplit("the schema added:\n", 1)[1])
    tasks = [{"Task": row["Task"] + f" {i}", "Schema": {"n": i}} for i in (1, 2)]
    if row["Category"].endswith("7"):
        del tasks[1]["Schema"]
    return json.dumps({"Tasks": tasks})


@query("""
SELECT c_custkey AS ordinal, CAST(p AS INTEGER) AS position, '{"Task":"' || c_name || ' ' || (p + 1) || '","Schema":{"n":' || (p + 1) || '}}' AS task_json
FROM customer JOIN nation ON c_nationkey = n_nationkey, (VALUES (0), (1)) t(p)
WHERE c_custkey >= 5 AND n_name NOT LIKE '%7'""")
def industry_generation(spark, sf):
    return C.generate_industry_tasks(industry_sheet(spark, sf), "[]", "{}", industry, skip=C.SKIPPED_ROWS)


def enricher(prompt: str) -> str:
    """Adds the object to the message; answers an error in prose."""
    said = prompt.split("needs to be updated: ", 1)[1].split(".Please add missing details", 1)[0]
    obj = prompt.split("part of the user message: ", 1)[1].split(".Given the above json object", 1)[0]
    return "sorry" if said.startswith("error") else json.dumps({"updated_message": f"{said} with {obj}"})


@query("""
SELECT event_id, 'be kind' AS system, event_type || ' it' || CASE WHEN event_type <> 'error' THEN ' with ' || props ELSE '' END AS human, props AS gpt
FROM events""")
def enriched_queries(spark, sf):
    turn = lambda sender, value: F.struct(F.lit(sender).alias("from"), value.alias("value"))
    turns = F.array(turn("system", F.lit("be kind")), turn("human", F.concat("event_type", F.lit(" it"))), turn("gpt", F.col("props")))
    data = table(spark, sf, "events", spread_out=True).select("event_id", turns.alias("conversations"))
    rows = C.enrich_queries(data, enricher)
    said = lambda i: F.get("conversations", F.lit(i))["value"]
    return rows.select("event_id", said(0).alias("system"), said(1).alias("human"), said(2).alias("gpt"))


def objects(prompt: str) -> str:
    """A JSON-mode record whose object is the prompt's number; too large ones do not fit the schema."""
    return '{"messages": [{"role": "user", "content": "k"}, {"role": "assistant", "content": {"k": %s}}], "pydantic_schema": %s}' % (
        prompt, SCHEMA)


@query(f"""SELECT event_id, '{{"k":' || {SQL_K} || '}}' AS json_object FROM events WHERE {SQL_K} <= 49""")
def checked_objects(spark, sf):
    prompts = table(spark, sf, "events", spread_out=True).select("event_id", F.regexp_extract("props", "[0-9]+", 0).alias("prompt"))
    return C.retry_invalid(prompts, "event_id", "prompt", objects).select("event_id", "json_object")
