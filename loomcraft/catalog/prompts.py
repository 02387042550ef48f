"""Prompt texts."""

from pyspark.sql import functions as F

from ..functions import jsons as J, messages as M
from ..operators import prompts as P
from ..operators.prefix import concat_in_order
from ..operators.selection import first_rows
from .registry import lit, query, table
from .texts import industry_sheet
from ..plans.curricula import SKIPPED_ROWS, industry_tasks

SECTIONS = {
    "Role": "You write examples.\n", "Objective": "Category {category}, subcategory {subcategory}:\n{task}\n",
    "Guidelines": "- Keep {{braces}}.\n", "Documents": "<documents>\n{doc_list}\n</documents>", "Examples": "{examples}",
    "Output_instructions": "- JSON only.", "Output_schema": "<output_schema>\n{pydantic_schema}\n</output_schema>",
    "Assistant": "Here it is for {category}, {task}:",
}
SYSTEM = {
    "Role": "You call functions.\nAlways.\n", "Objective": "Help.\n", "Tools": "Tools:\n<tools>\n{tools}\n</tools>\n",
    "Examples": "Like this:\n{examples}\n", "Schema": "Schema:\n{schema}\n",
    "Instructions": "Answer so:\n<tool_call>\n{{tool_call}}\n</tool_call>",
}
SCHEMA = '{"title":"FunctionCall"}'
MINING_EXAMPLES = ['{"Category":"A","Task":"x"}', '{"Category":"B","Task":"it\'s y"}']
ENRICH_EXAMPLES = [{"updated_message": "I'd like it \"all\"."}]
ONE_SHOT = "###Example\n<tool_call>\n{}\n</tool_call>\n"


def variables():
    return {
        "category": "source", "subcategory": "lang", "task": "text", "doc_list": F.concat(F.lit("docs "), "source"),
        "examples": F.lit("none"), "pydantic_schema": F.lit(SCHEMA)}


def sql_template(text: str, values: dict[str, str]) -> str:
    out = lit(text.replace("{{", "\0").replace("}}", "\1"))
    for name, expr in values.items():
        out = out.replace("{" + name + "}", f"' || {expr} || '")
    return "(" + out.replace("\0", "{").replace("\1", "}") + ")"


VALUES = {
    "category": "source", "subcategory": "lang", "task": "text", "doc_list": "'docs ' || source", "examples": "'none'",
    "pydantic_schema": lit(SCHEMA)}


@query("SELECT doc_id, " + " || ".join(
    f"{lit(n + ':' + chr(10))} || {sql_template(SECTIONS[n], VALUES)} || chr(10)" for n in P.SECTIONS) + " AS prompt FROM documents")
def render_prompt(spark, sf):
    return table(spark, sf, "documents").select("doc_id", P.section_prompt(SECTIONS, variables()).alias("prompt"))


@query("SELECT doc_id, " + lit("PREFIX " + "\n".join(SECTIONS[n] for n in ("Role", "Guidelines", "Output_instructions")) + "\n" + SCHEMA)
       + " AS system, " + " || chr(10) || ".join(
           sql_template(SECTIONS[n], VALUES) for n in ("Objective", "Documents", "Examples", "Assistant")) + " AS user FROM documents")
def prompt_messages(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", P.prompt_messages(SECTIONS, variables(), "PREFIX ").alias("m"))
    return rows.select("doc_id", F.get("m", F.lit(0))["content"].alias("system"), F.get("m", F.lit(1))["content"].alias("user"))


SYSTEM_VALUES = {"tools": "source", "examples": "text", "schema": lit(SCHEMA)}


@query("SELECT doc_id, " + " || ".join(
    f"coalesce(replace({sql_template(SYSTEM[n], SYSTEM_VALUES | {'examples': 'e'})}, chr(10), ' '), '')" for n in P.SYSTEM_SECTIONS[:-1])
       + f" || {sql_template(SYSTEM['Instructions'], {})} || chr(10) AS prompt"
       + " FROM (SELECT *, CASE WHEN lang <> 'en' THEN text END AS e FROM documents)")
def system_prompt(spark, sf):
    values = {"tools": "source", "schema": F.lit(SCHEMA), "examples": F.when(F.col("lang") != "en", F.col("text"))}
    return table(spark, sf, "documents").select("doc_id", P.flat_system_prompt(SYSTEM, values).alias("prompt"))


@query("SELECT doc_id, " + lit(
    P.MINING_INTRO + "".join(f"<example={i}> {e} </example>\n" for i, e in enumerate(MINING_EXAMPLES)) + P.MINING_CODE)
       + " || text || " + lit("\n" + P.MINING_SCHEMA + SCHEMA + "\n" + P.MINING_OUTRO) + " AS prompt FROM documents")
def mining_prompts(spark, sf):
    return table(spark, sf, "documents").select("doc_id", P.mining_prompt("text", MINING_EXAMPLES, SCHEMA).alias("prompt"))


@query(f"""
SELECT c_custkey AS ordinal, {sql_template(P.INDUSTRY_TEMPLATE, {
    "examples": lit("[]"), "schema": lit(SCHEMA),
    "task": '''CAST(json_object('Category', n_name, 'SubCategory', 'Industry ' || (c_custkey // 4), 'Task', c_name) AS VARCHAR)'''})} AS prompt
FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey >= 5""")
def industry_prompts(spark, sf):
    tasks = industry_tasks(industry_sheet(spark, sf), skip=SKIPPED_ROWS)
    return tasks.select("ordinal", P.industry_prompt("task_json", "[]", SCHEMA).alias("prompt"))


@query("SELECT doc_id, " + lit(P.ENRICH_MESSAGE) + " || text || " + lit(P.ENRICH_OBJECT) + " || source || "
       + lit(P.ENRICH_EXAMPLES + '[{"updated_message": "I\'d like it \\"all\\"."}]' + P.ENRICH_SCHEMA + P.ENRICH_OUTRO)
       + " AS prompt FROM documents")
def enrichment_prompts(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", P.enrichment_prompt("text", "source", ENRICH_EXAMPLES).alias("prompt"))


@query("SELECT doc_id, text || " + lit(P.CORRECTION) + " || source AS prompt FROM documents")
def correction_prompts(spark, sf):
    return table(spark, sf, "documents").select("doc_id", P.correction_prompt("text", "source").alias("prompt"))


@query(f"""
SELECT doc_id, {lit(M.TOOL_CALLER_INTRO)} || chr(10) || '<tools>' || chr(10) || '[{{"name":"' || source || '"}}]' || chr(10) || '</tools>'
       || chr(10) || {lit(M.TOOL_CALLER_OUTRO)} AS tool_caller,
       {lit(M.JSON_MODE_INTRO)} || chr(10) || '<schema>' || chr(10) || to_json(text) || chr(10) || '</schema>' || chr(10) AS json_mode
FROM documents""")
def system_messages(spark, sf):
    tools = F.concat(F.lit('[{"name":"'), "source", F.lit('"}]'))
    return table(spark, sf, "documents").select(
        "doc_id", M.tool_caller_system(tools).alias("tool_caller"), M.json_mode_system(J.quoted("text")).alias("json_mode"))


@query(f"SELECT doc_id, text || {lit(ONE_SHOT)} AS first, lang AS second FROM documents")
def one_shot(spark, sf):
    turns = F.array(
        F.struct(F.lit("system").alias("role"), F.col("text").alias("content")),
        F.struct(F.lit("user").alias("role"), F.col("lang").alias("content")))
    m = table(spark, sf, "documents").select("doc_id", M.append_to_first(turns, ONE_SHOT).alias("m"))
    return m.select("doc_id", F.get("m", F.lit(0))["content"].alias("first"), F.get("m", F.lit(1))["content"].alias("second"))


@query("""
SELECT 0::BIGINT AS part, string_agg(text, chr(10) ORDER BY item_id) AS examples
FROM (SELECT * FROM benchmark ORDER BY item_id LIMIT 3)""")
def few_shot(spark, sf):
    picked = first_rows(table(spark, sf, "benchmark"), 3, ["item_id"])
    picked = picked.withColumn("set", F.lit(0).cast("long"))
    whole = concat_in_order(picked, ["set"], "item_id", F.col("text"), "examples", "\n")
    return whole.select(F.col("set").alias("part"), "examples")
