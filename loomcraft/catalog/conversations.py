"""Chat exports from records and from turn tables."""

from pyspark.sql import functions as F

from ..functions import messages as M
from ..operators.conversations import tool_responses
from ..plans.export import export_sharegpt, export_turns, turn_columns
from ..session import fresh_path
from ..sources.scans import scan_saved_results
from ..sources.sinks import save_results
from .registry import lit, query, table
from .validation import SIGNATURES, SQL_K, SQL_MESSAGE, event_records

SQL_SYSTEM = f"""{lit(M.TOOL_CALLER_INTRO)} || chr(10) || '<tools>' || chr(10) || %s || chr(10) || '</tools>' || chr(10) || {lit(M.TOOL_CALLER_OUTRO)}"""


@query(f"""
SELECT conv_id, {SQL_SYSTEM % "'[]'"} AS system, arg_max(text, turn) FILTER (role = 'user') AS human,
       arg_max(text, turn) FILTER (role = 'assistant') AS summary
FROM conversations GROUP BY conv_id HAVING human IS NOT NULL""")
def sharegpt_turns(spark, sf):
    return turn_columns(table(spark, sf, "conversations"))


# An order as a conversation: a question, calls, a result per line, a summary. Lines of one number and
# part would share a place; the data has next to none, and supplier keys part them.
SQL_TURNS = """
SELECT o_orderkey AS conv_id, CAST(0 AS BIGINT) AS turn, 'user' AS role, CAST(NULL AS VARCHAR) AS name, 'status of ' || o_orderkey AS text, CAST(NULL AS VARCHAR) AS calls FROM orders
UNION ALL SELECT l_orderkey, 10 + (l_linenumber * 1000000 + l_partkey) * 10000 + l_suppkey, 'assistant', NULL, NULL, '<tool_call>' || l_partkey || '</tool_call>' FROM lineitem WHERE l_returnflag <> 'N'
UNION ALL SELECT l_orderkey, 100000000000 + (l_linenumber * 1000000 + l_partkey) * 10000 + l_suppkey, 'tool', 'part_' || l_suppkey, '"' || l_returnflag || l_partkey || '"', NULL FROM lineitem
UNION ALL SELECT o_orderkey, 900000000000, 'assistant', NULL, 'it is ' || o_orderstatus, NULL FROM orders"""


def order_turns(spark, sf):
    for name in ("orders", "lineitem"):
        table(spark, sf, name).createOrReplaceTempView(f"loomcraft_{name}")
    sql = SQL_TURNS.replace("VARCHAR", "STRING").replace("FROM orders", "FROM loomcraft_orders").replace("FROM lineitem", "FROM loomcraft_lineitem")
    return spark.sql(sql)


@query(f"""
SELECT conv_id, {SQL_SYSTEM % "'[]'"} AS system, arg_max(text, turn) FILTER (role = 'user') AS human,
       CASE WHEN arg_max(calls, turn) FILTER (role = 'assistant' AND calls IS NOT NULL) IS NULL
            THEN arg_max(text, turn) FILTER (role = 'assistant' AND calls IS NULL) END AS summary,
       arg_max(calls, turn) FILTER (role = 'assistant' AND calls IS NOT NULL) AS calls
FROM ({SQL_TURNS}) GROUP BY conv_id HAVING human IS NOT NULL""")
def sharegpt_turns_single(spark, sf):
    return export_turns(order_turns(spark, sf), "single", calls="calls")


SQL_PARTS = 3  # tool results in a part, few enough that orders have several parts


@query(f"""
WITH turns AS ({SQL_TURNS}),
assembled AS (
    SELECT conv_id, arg_max(text, turn) FILTER (role = 'user') AS human,
           arg_max(calls, turn) FILTER (role = 'assistant' AND calls IS NOT NULL) AS calls,
           arg_max(text, turn) FILTER (role = 'assistant' AND calls IS NULL) AS summary
    FROM turns GROUP BY conv_id HAVING human IS NOT NULL),
results AS (
    SELECT conv_id, '<tool_response>' || chr(10) || '{{"name": "' || name || '", "content": ' || text || '}}' || chr(10) || '</tool_response>' || chr(10) AS block,
           row_number() OVER (PARTITION BY conv_id ORDER BY turn, block) AS place
    FROM turns WHERE role = 'tool' AND conv_id IN (SELECT conv_id FROM assembled))
SELECT conv_id, 0 AS position, 0::BIGINT AS part, 'system' AS from, {SQL_SYSTEM % "'[]'"} AS value FROM assembled
UNION ALL SELECT conv_id, 1, 0, 'human', human FROM assembled
UNION ALL SELECT conv_id, 2, 0, 'gpt', calls FROM assembled WHERE calls IS NOT NULL
UNION ALL SELECT conv_id, 3, (place - 1) // {SQL_PARTS}, 'tool', string_agg(block, '' ORDER BY place) FROM results GROUP BY conv_id, (place - 1) // {SQL_PARTS}
UNION ALL SELECT conv_id, 4, 0, 'gpt', summary FROM assembled WHERE summary IS NOT NULL""")
def sharegpt_turns_multi(spark, sf):
    return export_turns(order_turns(spark, sf), "multi", calls="calls", part_rows=SQL_PARTS)


# A user's events as the turns of one conversation: pages are what they asked for, the rest tool results.
@query("""
SELECT conv_id, (place - 1) // 10 AS part,
       string_agg('<tool_response>' || chr(10) || '{"name": "' || event_type || '", "content": ' || props || '}' || chr(10) || '</tool_response>' || chr(10), ''
                  ORDER BY place) AS tool
FROM (SELECT user_id AS conv_id, event_type, props, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS place
      FROM events WHERE event_type <> 'view') GROUP BY ALL""")
def tool_results(spark, sf):
    """Ten results a part; ``tool_results_whole`` has all results of a conversation together."""
    return tool_responses(event_turns(spark, sf), part_rows=10)


@query("""
SELECT conv_id, (place - 1) // 1000 AS part,
       string_agg('<tool_response>' || chr(10) || '{"name": "' || event_type || '", "content": ' || props || '}' || chr(10) || '</tool_response>' || chr(10), ''
                  ORDER BY place) AS tool
FROM (SELECT user_id AS conv_id, event_type, props, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS place
      FROM events WHERE event_type <> 'view') GROUP BY ALL""")
def tool_results_whole(spark, sf):
    return tool_responses(event_turns(spark, sf), part_rows=1000)


def event_turns(spark, sf):
    role = F.when(F.col("event_type") == "view", F.lit("user")).otherwise(F.lit("tool"))
    return table(spark, sf, "events").select(
        F.col("user_id").alias("conv_id"), F.col("event_id").alias("turn"), role.alias("role"),
        F.col("event_type").alias("name"), F.col("props").alias("text"))


# Views ask, errors answer; those of a small value say nothing.
SQL_SILENT = """SELECT user_id AS conv_id, event_id AS turn, CASE event_type WHEN 'view' THEN 'user' ELSE 'assistant' END AS role,
    CASE WHEN value >= 50 THEN props END AS text FROM events WHERE event_type IN ('view', 'error')"""


@query(f"""
SELECT conv_id, {SQL_SYSTEM % "'[]'"} AS system, arg_max(coalesce(text, ''), turn) FILTER (role = 'user') AS human,
       arg_max(coalesce(text, ''), turn) FILTER (role = 'assistant') AS summary
FROM ({SQL_SILENT}) GROUP BY conv_id HAVING human IS NOT NULL""")
def sharegpt_silent_turns(spark, sf):
    """Turns without text are exported as empty ones."""
    table(spark, sf, "events").createOrReplaceTempView("loomcraft_events")
    return turn_columns(spark.sql(SQL_SILENT.replace("FROM events", "FROM loomcraft_events")))


TOOLS_TEXT = "[" + ",".join(SIGNATURES) + "]"
SQL_CALL = f"""'<tool_call>' || chr(10) || '{{"arguments":{{"k": ' || {SQL_K} || '}},"name":"' || event_type || '"}}' || chr(10) || '</tool_call>' || chr(10)
    || CASE WHEN value > 20 THEN '<tool_call>' || chr(10) || '{{"arguments":{{}},"name":"signup"}}' || chr(10) || '</tool_call>' || chr(10) ELSE '' END"""
SQL_GOOD = f"FROM events WHERE {SQL_MESSAGE} = 'Function call is valid'"


def flattened(rows):
    said = lambda i: F.get("conversations", F.lit(i))["value"]
    return rows.select(
        "id", "category", "subcategory", "task", said(0).alias("system"), said(1).alias("human"), said(2).alias("gpt"),
        said(3).alias("tool"), said(4).alias("summary"))


SQL_RECORDS = f"""
SELECT CAST(event_id AS VARCHAR) AS id, 'events' AS category, event_type AS subcategory, CAST(user_id AS VARCHAR) AS task,
       {SQL_SYSTEM % lit(TOOLS_TEXT)} AS system, 'do ' || event_type || ' for ' || user_id AS human, {SQL_CALL} AS gpt,
       %s AS tool, %s AS summary {SQL_GOOD}"""


@query(SQL_RECORDS % (
    """'<tool_response>' || chr(10) || '{"name": "' || event_type || '", "content": {"done":' || user_id || '}}' || chr(10) || '</tool_response>' || chr(10)""",
    "'did ' || event_type"))
def sharegpt_multi(spark, sf):
    return flattened(export_sharegpt(event_records(spark, sf), "multi"))


@query(SQL_RECORDS % ("NULL", "NULL"))
def sharegpt_single(spark, sf):
    return flattened(export_sharegpt(event_records(spark, sf), "single"))


@query(f"""SELECT category, subcategory, id AS task, system, human, gpt, tool, summary FROM ({SQL_RECORDS % (
    """'<tool_response>' || chr(10) || '{"name": "' || event_type || '", "content": {"done":' || user_id || '}}' || chr(10) || '</tool_response>' || chr(10)""",
    "'did ' || event_type")})""")
def saved_sharegpt(spark, sf):
    """Records saved as results, read back from there and exported."""
    path = fresh_path(spark, "results")
    save_results(event_records(spark, sf).select("category", "subcategory", F.col("id").alias("task"), F.col("record").alias("reply")), path)
    return flattened(export_sharegpt(scan_saved_results(spark, path), "multi")).drop("id")
