"""Generating records: in one go from a task, and in steps from an earlier record."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as X
from ..functions.jsons import array_text, entries, let, quoted, salvaged, without_nulls
from ..functions.tools import wrapped_tool
from ..operators.binding import bind, keep
from ..operators.completion import Client, complete
from ..operators.packing import enrich_tasks, pack_documents, pack_examples
from ..operators.prompts import section_prompt
from ..operators.replies import parse_replies
from ..operators.retrieval import nearest
from ..operators.selection import not_done

EXAMPLES_PER_PROMPT = 2


def prepared_tasks(tasks: DataFrame, vendor: str, run_date: str, context_tokens: int, stepwise: bool = False) -> DataFrame:
    """Tasks (``category, subcategory, task``), equal ones once, with ``task_key``, search query and character budget.

    The key is made of the whole texts; ``path`` is a label, in which long names are cut and may meet."""
    slug = X.task_slug("task")
    return tasks.dropDuplicates(["category", "subcategory", "task"]).select(
        "*",
        F.sha2(F.to_json(F.array("category", "subcategory", "task")), 256).alias("task_key"),
        X.search_query("category", "subcategory", "task").alias("search_query"),
        X.result_path(F.lit(vendor), F.lit(run_date), "category", "subcategory", slug).alias("path"),
        X.character_budget(F.lit(context_tokens), stepwise).alias("budget"),
    )


def example_texts(tasks: DataFrame, index: DataFrame, k: int = EXAMPLES_PER_PROMPT, messages_only: bool = False) -> DataFrame:
    """The ``k`` index entries nearest to each task's ``embedding``, as one text per ``task_key``."""
    ranked = nearest(
        tasks.select("task_key", "embedding"), index.select("source", "embedding"), k, query_id="task_key", vector_id="source"
    )
    contents = index.groupBy("source").agg(F.min_by("content", "seq_num").alias("content"))
    return pack_examples(ranked.join(contents, "source"), ["task_key"], "rank", messages_only=messages_only)


def prompted_tasks(
    tasks: DataFrame, documents: DataFrame, index: DataFrame | None, sections: Mapping[str, str], output_schema: str
) -> DataFrame:
    """Prepared tasks with documents, examples and the filled-in prompt.

    ``documents``: ``task_key, rank, url, content, tables`` (rank unique within a task)."""
    budgets = tasks.select("task_key", "budget")
    packs = pack_documents(documents.join(budgets, "task_key"), ["task_key"], "rank", "budget", tables="tables")
    examples = example_texts(tasks, index) if index is not None else None
    joined = enrich_tasks(tasks, packs, examples, ["task_key"])
    if examples is None:
        joined = joined.withColumn("examples", F.lit(""))
    variables: dict[str, Column | str] = {n: n for n in ("category", "subcategory", "task", "doc_list", "examples")}
    variables["pydantic_schema"] = F.lit(output_schema)
    variables["task_schema"] = "schema" if "schema" in joined.columns else F.lit("None")
    return joined.withColumn("prompt", section_prompt(sections, variables))


def generate_forward(
    tasks: DataFrame, documents: DataFrame, index: DataFrame | None, sections: Mapping[str, str], output_schema: str,
    client: Client, vendor: str, run_date: str, context_tokens: int, done: DataFrame | None = None,
    concurrency: int | None = None, in_flight: int = 1, log: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Records for all tasks not in ``done`` (``task_key``): results (``task_key, path, …, reply``) and the tasks without one.
    ``log`` names a folder of answers that a job started again reads instead of asking (``complete``)."""
    todo = prepared_tasks(tasks, vendor, run_date, context_tokens)
    if done is not None:
        todo = not_done(todo, done, ["task_key"])
    prompted = prompted_tasks(todo, documents, index, sections, output_schema)
    kept = [c for c in ("task_key", "path", "category", "subcategory", "task") if c in prompted.columns]
    answered = complete(
        prompted.select(*kept, "prompt"), "prompt", client, concurrency=concurrency, in_flight=in_flight, log=log)
    return parse_replies(answered.drop("prompt"), "completion")


def tool_request(messages: Column, tools: Column, tool_choice: str) -> Column:
    """A request to a tool-calling client as JSON text; ``messages`` and ``tools`` are arrays of JSON texts."""
    return F.concat(
        F.lit('{"messages":'), array_text(messages), F.lit(',"tools":'), array_text(tools),
        F.lit(f',"tool_choice":"{tool_choice}"}}'),
    )


def _user_message(content: Column) -> Column:
    return F.concat(F.lit('{"role":"user","content":'), quoted(content), F.lit("}"))


def tool_message_texts(results: Column) -> Column:
    """Tool messages of a results object ``{"tools": [...]}`` with their content as JSON string."""
    items = F.from_json(F.get_json_object(results, "$.tools"), "array<string>")

    def message(item):
        content = F.get_json_object(item, "$.content")
        pairs = entries(item)
        return F.concat(F.lit("{"), F.array_join(F.transform(pairs, lambda e: F.concat(
            quoted(e["key"]), F.lit(":"),
            F.when(e["key"] == "content", quoted(F.when(F.schema_of_variant(e["value"]) == "STRING", F.to_json(e["value"]))
                                                 .otherwise(content))).otherwise(F.to_json(e["value"])))), ","), F.lit("}"))

    return F.transform(items, message)


def split_roles(records: DataFrame, record: str = "record") -> DataFrame:
    """Adds the last user message, summary and calls of a record, its tool messages, its tools in wrapped form.

    Here an assistant message with a ``content`` key, null included, is a summary."""
    field = lambda m, name: F.get_json_object(m, f"$.{name}")
    has = lambda m, name: F.array_contains(F.json_object_keys(m), name)
    last = lambda test, name: let(
        F.filter("_raw", test), lambda h: F.when(F.size(h) > 0, field(F.get(h, F.size(h) - 1), name)))
    said = bind(
        records,
        _raw=F.from_json(F.get_json_object(record, "$.messages"), "array<string>"),
        tools=F.transform(F.from_json(F.get_json_object(record, "$.tools"), "array<string>"), wrapped_tool),
    )
    return bind(
        said,
        user_message=last(lambda m: field(m, "role") == "user", "content"),
        summary=last(lambda m: (field(m, "role") == "assistant") & has(m, "content"), "content"),
        calls=last(lambda m: (field(m, "role") == "assistant") & ~has(m, "content") & has(m, "tool_calls"), "tool_calls"),
        tool_messages=F.filter("_raw", lambda m: field(m, "role") == "tool"),
    ).drop("_raw")


def regenerate_in_steps(
    records: DataFrame, query_sections: Mapping[str, str], result_sections: Mapping[str, str], text_client: Client,
    tool_client: Client, done: DataFrame | None = None, concurrency: int | None = None,
) -> DataFrame:
    """Rebuild records (``task_key, path, category, subcategory, task, doc_list, examples, record``) in four steps:
    a new user query, new calls, new results, a summary. Each step's answers are written before the next
    starts, so a lost executor costs at most the step under way. Output: ``task_key, path, record``. Tasks are
    told apart by ``task_key``; paths are labels and may meet."""
    if done is not None:
        records = not_done(records, done, ["task_key"])
    names = ("category", "subcategory", "task", "doc_list", "examples")
    state = split_roles(records.select("task_key", "path", *names, "record")).drop("record")
    shown = F.coalesce(array_text(F.col("tool_messages")), F.lit("[]"))
    variables = {n: F.col(n) for n in names} | {
        "user_message": F.col("user_message"), "assistant_message": F.col("calls"), "tool_call_results": shown}

    asked = state.withColumn("prompt", tool_request(
        F.array(_user_message(section_prompt(query_sections, variables))), F.col("tools"), "none"))
    asked = complete(asked, "prompt", text_client, concurrency=concurrency, name="user-query")
    asked = asked.filter(F.col("completion").isNotNull()).withColumn("user_query", F.col("completion"))
    asked = asked.drop("prompt", "completion", "error", "attempts")

    called = asked.withColumn("prompt", tool_request(F.array(_user_message(F.col("user_query"))), F.col("tools"), "auto"))
    called = complete(called, "prompt", tool_client, concurrency=concurrency, name="tool-calls")
    called = keep(called, "call_message", without_nulls("completion"))
    called = called.drop("prompt", "completion", "error", "attempts")

    result_variables = {n: F.col(n) for n in names} | {
        "user_message": F.col("user_query"), "results_summary": F.col("summary"), "tool_call_results": shown,
        "assistant_message": F.get_json_object("call_message", "$.tool_calls")}
    resulted = called.withColumn("prompt", tool_request(
        F.array(_user_message(section_prompt(result_sections, result_variables))), F.col("tools"), "none"))
    resulted = complete(resulted, "prompt", text_client, concurrency=concurrency, name="tool-results")
    resulted = keep(resulted, "results", salvaged("completion"))
    chain = F.concat(F.array(_user_message(F.col("user_query")), F.col("call_message")), tool_message_texts(F.col("results")))
    resulted = bind(resulted, chain=chain).drop("prompt", "completion", "error", "attempts")

    summed = resulted.withColumn("prompt", tool_request(F.col("chain"), F.col("tools"), "none"))
    summed = complete(summed, "prompt", tool_client, concurrency=concurrency, name="summaries")
    final = F.when(F.col("completion").isNotNull(), F.concat("chain", F.array("completion"))).otherwise(F.col("chain"))
    record = F.concat(F.lit('{"messages":'), array_text(final), F.lit(',"tools":'), array_text(F.col("tools")), F.lit("}"))
    return summed.select("task_key", "path", record.alias("record"))
