"""Scans of real files, whole jobs, re-runs, and the shape of plans."""

import json
import os
import random
import re

import pytest
from pyspark.sql import functions as F

from loomcraft.catalog import QUERIES
from loomcraft.functions import messages
from loomcraft.operators.completion import complete
from loomcraft.operators.conversations import parse_records
from loomcraft.operators import pages as page_reading
from loomcraft.operators.pages import extract_pages
from loomcraft.plans import export, generation as G, preference
from loomcraft.sources import scans, sinks
from loomcraft.streaming import index as I
from tests.conftest import SF


def write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)


CALL = {"id": "1", "type": "function", "function": {"name": "f", "arguments": '{"a": "x"}'}}
TOOL = {"type": "function", "function": {"name": "f", "parameters": {"properties": {"a": {"type": "integer"}}}}}
RECORD = {"messages": [{"role": "user", "content": "go"}, {"role": "assistant", "content": None, "tool_calls": [CALL]}], "tools": [TOOL]}


def test_curriculum_scan(spark, tmp_path):
    write(f"{tmp_path}/c/a.csv", 'Category,SubCategory,Task,Schema\nA,B,"two\nlines, ""quoted""",\nC,D,next,"{}"\n')
    write(f"{tmp_path}/c/b.csv", "Category,SubCategory,Task,Schema\nE,F,last,\n")
    rows = scans.scan_curriculum(spark, f"{tmp_path}/c").orderBy("ordinal").collect()
    assert [(r.ordinal, r.Category, r.Task) for r in rows] == [(0, "A", 'two\nlines, "quoted"'), (1, "C", "next"), (2, "E", "last")]
    assert scans.scan_curriculum(spark, f"{tmp_path}/c", 2).count() == 2


def test_json_lines_scan(spark, tmp_path):
    write(f"{tmp_path}/t.jsonl", '{"Category": "a", "Task": "x"}\n{"Category": oops\n{"Category": "b"}\n')
    tasks, bad = scans.scan_json_lines(spark, f"{tmp_path}/t.jsonl")
    assert [(r.ordinal, r.Category, r.Task) for r in tasks.orderBy("ordinal").collect()] == [(0, "a", "x"), (2, "b", None)]
    assert [tuple(r) for r in bad.collect()] == [(2, '{"Category": oops')]


def test_result_tree_and_exports(spark, tmp_path):
    root = f"{tmp_path}/one/results one"
    write(f"{root}/Cat_A/results one/again.json", json.dumps(RECORD))
    write(f"{root}/Cat_A/Sub_1/first_task.json", json.dumps(RECORD))
    good = json.loads(json.dumps(RECORD).replace('\\"x\\"', "1"))
    write(f"{root}/Cat_A/Sub 2/a+b_é.json", json.dumps(good, indent=2))
    write(f"{root}/Cat_A/Sub_1/notes.txt", "no")
    tree = scans.scan_result_tree(spark, root)
    assert {(r.category, r.subcategory, r.task) for r in tree.collect()} == {
        ("Cat A", "Sub 1", "first task"), ("Cat A", "Sub 2", "a+b é"), ("Cat A", "results one", "again")}
    assert [r.task for r in export.export_sharegpt(tree).collect()] == ["a+b é"]
    assert [r.id for r in scans.scan_result_tree(spark, root).orderBy("id").collect()] == [r.id for r in tree.orderBy("id").collect()]


def test_json_mode_export(spark):
    record = lambda obj, schema: json.dumps({
        "messages": [{"role": "user", "content": "u"}, {"role": "assistant", "content": obj}], "pydantic_schema": schema})
    schema = {"type": "object", "required": ["a"]}
    cases = [record({"a": 1}, schema), record({"b": 1}, schema), record({"a": 1}, {}), record({}, {"type": "object"}), record("a", schema),
             record([{"a": 1}, {"a": 2}], schema), record([{"a": 1}, {}], schema), record({"a": 1}, {"type": "nope"})]
    df = spark.createDataFrame([(str(i), "c", "s", r) for i, r in enumerate(cases)], "id string, category string, subcategory string, record string")
    rows = export.export_json_mode(df).orderBy("id").collect()
    assert [(r.id, r.conversations[2]["value"]) for r in rows] == [("0", '{"a":1}'), ("5", '[{"a":1},{"a":2}]')]


def test_code_scan(spark, tmp_path):
    for name, text in {"a/x.py": "first", "b/x.py": "second", "a/__init__.py": "z", "a/blank.js": " \n", "a/n.md": "no", "c/l.txt": "q" * 250_010}.items():
        write(f"{tmp_path}/src/{name}", text)
    rows = {r.name: r.code for r in scans.scan_code(spark, f"{tmp_path}/src").collect()}
    assert rows == {"x.py": "first", "l.txt": "q" * 250_010}
    cut = {r.name: r.code for r in scans.scan_code(spark, f"{tmp_path}/src", 250_000).collect()}
    assert cut == {"x.py": "first", "l.txt": "q" * 250_000}


def test_examples_and_sheet(spark, tmp_path):
    write(f"{tmp_path}/ex/one.json", '{"a": 1}')
    row = scans.scan_examples(spark, f"{tmp_path}/ex").first()
    assert (row.source.rsplit("/", 1)[1], row.seq_num, row.content) == ("one.json", 1, '{"a": 1}')
    write(f"{tmp_path}/s.csv", "t,,,,,,,\n,,,,,,,\nx,,,,,,,\n" + ",S,,G,,I,,U\n10,a,1,b,2,c,3,d\n,,,,,,4,e\n")
    rows = scans.scan_industry_sheet(spark, f"{tmp_path}/s.csv").orderBy("ordinal").collect()
    assert [tuple(r) for r in rows] == [(0, "a", "b", "c", "d"), (1, None, None, None, "e")]


def test_saving_twice_adds_nothing(spark, tmp_path):
    rows = spark.createDataFrame([("a", "b", str(i), "r") for i in range(50)], "category string, subcategory string, task string, reply string")
    for _ in range(2):
        sinks.save_results(rows, f"{tmp_path}/out")
    assert spark.read.parquet(f"{tmp_path}/out").count() == 50


def test_forward_generation_resumes(spark):
    tasks = spark.createDataFrame([("c", "s", f"t {i}", [float(i), 1.0]) for i in range(4)], "category string, subcategory string, task string, embedding array<float>")
    index = spark.createDataFrame([("ex/a.json", 1, "EX-A", [0.0, 1.0]), ("ex/b.json", 1, "EX-B", [5.0, 1.0])], "source string, seq_num int, content string, embedding array<float>")
    prepared = G.prepared_tasks(tasks, "v", "2024-01-01", 5000)
    docs = prepared.select("task_key", F.lit(0).alias("rank"), F.lit("u").alias("url"), F.lit("doc!").alias("content"),
                           F.lit(None).cast("array<array<array<string>>>").alias("tables"))
    sections = {"Documents": "{doc_list}", "Examples": "{examples}", "Objective": "{task} {{x}}"}
    client = lambda p: json.dumps({"docs": p.count("<doc "), "best": re.search(r"EX-[AB]", p).group(), "ok": "{x}" in p}) if "t 3" not in p else "sorry"
    good, bad = G.generate_forward(tasks, docs, index, sections, "{}", client, "v", "2024-01-01", 5000)
    got = {r.task: json.loads(r.reply) for r in good.collect()}
    assert got == {f"t {i}": {"docs": 1, "best": best, "ok": True} for i, best in enumerate(["EX-A", "EX-B", "EX-B"])}
    assert [r.path for r in bad.collect()] == ["results/v_2024-01-01/c/s/t_3.json"]
    again, _ = G.generate_forward(tasks, docs, index, sections, "{}", client, "v", "2024-01-01", 5000, done=good)
    assert again.count() == 0


def test_tasks_alike_in_their_first_letters_stay_apart(spark):
    long = "x" * 70
    rows = [("c", "s", long + "1"), ("c", "s", long + "2"), ("c", "s", long + "2"), ("c", None, "t"), ("c", None, "t")]
    tasks = spark.createDataFrame(rows, "category string, subcategory string, task string")
    prepared = G.prepared_tasks(tasks, "v", "2024-01-01", 5000)
    docs = prepared.select("task_key", F.lit(0).alias("rank"), F.lit("u").alias("url"), F.col("task").alias("content"),
                           F.lit(None).cast("array<array<array<string>>>").alias("tables"))
    client = lambda p: json.dumps({"docs": p.count("<doc ")})
    good, bad = G.generate_forward(tasks, docs, None, {"Documents": "{doc_list}"}, "{}", client, "v", "2024-01-01", 5000)
    got = good.collect()
    assert sorted((r.task, json.loads(r.reply)["docs"]) for r in got) == [("t", 1), (long + "1", 1), (long + "2", 1)]
    assert len({r.task_key for r in got}) == 3 and bad.count() == 0


def test_preferences_from_a_tree(spark):
    good = json.loads(json.dumps(RECORD).replace('\\"x\\"', "1"))
    records = spark.createDataFrame([(f"i{n}", f"s{n}", json.dumps(r)) for n, r in enumerate([RECORD, good, RECORD])], "id string, source string, record string")
    answer = json.dumps({"tool_calls": [{"id": "2", "type": "function", "function": {"name": "f", "arguments": '{"a": 2}'}}]})
    pairs = preference.build_preferences(records, lambda p: answer).collect()
    assert sorted((r.id, r.chosen, r.rejected) for r in pairs) == [  # pairs have no order
        (i, '```tool_call\n{"arguments":{"a": 2},"name":"f"}\n```\n', '```tool_call\n{"arguments":{"a": "x"},"name":"f"}\n```\n') for i in ("i0", "i2")]
    assert len(preference.build_preferences(records, lambda p: answer, max_files=1).collect()) == 1
    assert preference.build_preferences(records, lambda p: "{}").count() == 0


def test_evaluation_with_a_client(spark):
    prompt = [("system", "s"), ("user", "u")]
    df = spark.createDataFrame([(prompt, '{"name": "f", "arguments": {"a": 1}}', "s", "u")],
                               "prompt array<struct<role:string,content:string>>, completion string, system string, user string")
    client = lambda p: '<tool_call>{"name": "f", "arguments": {"a": 1.0}}</tool_call>' if "SHOT" in p else "no"
    assert [export.evaluate(df, client, one_shot=s).first().result for s in ("SHOT", None)] == ["passed", "failed"]


def test_stream_replays_nothing_twice(spark, tmp_path):
    base = str(tmp_path)
    batch = lambda rows: spark.createDataFrame(rows, "source string, completion string").write.mode("append").parquet(f"{base}/in")
    run = lambda: I.follow_results(spark, f"{base}/in", "source string, completion string", f"{base}/index", f"{base}/cp").awaitTermination()
    batch([("a", '{"x": 1}'), ("b", "none")])
    run()
    batch([("a", '{"x": 2}'), ("c", 'so {"y": 1}')])
    run()
    run()
    seeds = spark.createDataFrame([("c", 1, "seed")], "source string, seq_num int, content string")
    assert {(r.source, r.content) for r in I.example_index(spark, f"{base}/index", seeds).collect()} == {("a", '{"x": 1}'), ("c", "seed")}
    assert [r.source for r in I.rejects(spark, f"{base}/index").collect()] == ["b"]


def plan(spark, name):
    return QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


JVM_ONLY = ["validate_calls", "call_verdicts", "record_verdicts", "sharegpt_multi", "sharegpt_turns", "salvage_json", "doc_packing",
            "clean_text", "render_prompt", "chatml_render", "url_union", "skip_done", "forward_fill_all", "normalized_tools", "code_files"]


@pytest.mark.parametrize("name", JVM_ONLY)
def test_no_python_and_no_cross_join(spark, name):
    text = plan(spark, name)
    assert not re.search(r"ArrowEvalPython|BatchEvalPython|MapInPandas|CartesianProduct|BroadcastNestedLoopJoin", text)


def test_scans_read_only_what_is_needed(spark):
    assert "ReadSchema: struct<user_id:bigint,event_type:string,props:string>" in plan(spark, "call_verdicts")
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan(spark, "clean_text")
    assert "WindowGroupLimit" in plan(spark, "topk_similar")
    assert "TakeOrderedAndProject" in plan(spark, "first_tasks")
    assert "PushedFilters: [IsNotNull(c_custkey), GreaterThanOrEqual(c_custkey,5)]" in plan(spark, "skip_head")


def test_verdicts_are_worked_out_once(spark):
    assert plan(spark, "sharegpt_multi").count("No matching function signature") == 1


def test_records_keep_null_calls_apart_from_empty_ones(spark):
    texts = ['{"messages": [{"role": "assistant", "tool_calls": []}, {"role": "assistant", "tool_calls": null}], "tools": []}']
    row = parse_records(spark.createDataFrame([(t,) for t in texts], "record string")).first()
    assert [m["tool_calls"] for m in row.messages] == [[], None]


def test_json_data_sets_come_back_whole(spark, tmp_path):
    rows = spark.range(100).select("id", F.lit("a").alias("x"))
    sinks.save_dataset(rows, f"{tmp_path}/lines", "json")
    assert sorted(r.id for r in scans.scan_dataset(spark, f"{tmp_path}/lines", "json").collect()) == list(range(100))
    write(f"{tmp_path}/array/a.json", '[{"id": 1}, {"id": 2}]')
    assert sorted(r.id for r in scans.scan_dataset(spark, f"{tmp_path}/array", "json_array").collect()) == [1, 2]


def test_other_columns_pass_completion_and_extraction_unchanged(spark):
    big = 2**53 + 1
    rows = spark.createDataFrame([(big, "p", "<p>x</p>"), (None, "q", None)], "id long, prompt string, html string")
    answered = complete(rows, "prompt", str.upper)
    assert {(r.id, r.completion, r.attempts) for r in answered.collect()} == {(big, "P", 1), (None, "Q", 1)}
    assert {(r.id, r.content) for r in extract_pages(rows).collect()} == {(big, "x"), (None, None)}


def test_sinks_save_a_key_once(spark, tmp_path):
    schema = "category string, subcategory string, task string, reply string"
    rows = spark.createDataFrame([("01", "s", "t", "r"), (None, "s", "t", "r"), ("01", "s", "t", "again")], schema)
    for _ in range(2):
        sinks.save_results(rows, f"{tmp_path}/results")
    saved = spark.read.schema(schema).parquet(f"{tmp_path}/results").collect()
    assert sorted((r.category is not None, r.category) for r in saved) == [(False, None), (True, "01")]
    found = spark.createDataFrame([("c", "s", "t", 0, "u", "text"), ("c", "s", "t", 1, "u", "more")],
                                  "category string, subcategory string, task string, rank int, url string, content string")
    for _ in range(2):
        sinks.save_search_results(found, f"{tmp_path}/search")
    assert spark.read.parquet(f"{tmp_path}/search").count() == 2


def test_no_message_is_lost_for_a_null(spark):
    turns = spark.createDataFrame([([("user", "hi"), ("assistant", None), (None, "x")],)], "m array<struct<role:string,content:string>>")
    text = turns.select(messages.chatml("m").alias("t")).first().t
    assert text.count(messages.CHATML_START) == 3
    block = turns.select(messages.tool_response_block(F.lit(None).cast("string"), F.lit(None).cast("string")).alias("t")).first().t
    assert '"content": null' in block


def test_usual_pages_are_split_at_once_and_read_alike(monkeypatch):
    bits = ["<p>", "</P>", "<td>", "</td>", "<tr>", "<table class='a b' x>", "</table>", "<br/>", "<p/>", "t", " \n", "&amp;", "&zz;", "&#39;",
            "&", "<", "<!-- p -->", "<!---->", "<!DOCTYPE html>", "<script>a='</p><p>'</script>", "<style>p</style>", "<title>a</title>",
            "<title>", "<template>", "</template>", "<a href=x>", "<noscript>", "\0"]
    made = ["".join(random.Random(seed).choices(bits, k=8)) for seed in range(3_000)]
    split = [page_reading._Page().read(page) for page in made]
    with monkeypatch.context() as m:
        m.setattr(page_reading, "_PIECE", re.compile("()()()()()()(.)", re.S))  # nothing is usual
        assert [page_reading._Page().read(page) for page in made] == split
    fed = []
    monkeypatch.setattr(page_reading._Page, "feed", lambda self, page: fed.append(page))
    usual = "<!DOCTYPE html><p class=\"a\">x &lt; <i>y</i><script>if (a<b) {'<p>'}</script><table><tr><td>z<br/></table>"
    assert page_reading._Page().read(usual) == ("x < yz", [[["z"]]]) and not fed
