"""Record shapes with every violation, their quarantine, and what is saved and read back."""

import json

from pyspark.sql import functions as F

from loomcraft.operators import validation as V
from loomcraft.plans import export, preference
from loomcraft.sources import scans, sinks

TOOL = {"type": "function", "function": {"name": "f", "parameters": {"properties": {"a": {"type": "integer"}}}}}


def record(messages, tools=(TOOL,)):
    return json.dumps({"messages": messages, "tools": list(tools)})


def call(**changed):
    made = {"id": "1", "type": "function", "function": {"name": "f", "arguments": '{"a": 1}'}} | changed
    return {"role": "assistant", "content": None, "tool_calls": [made]}


USER = {"role": "user", "content": "u"}
CALLING = [
    (record([USER, call(), {"role": "tool", "tool_call_id": "1", "name": "f", "content": [1]}, {"role": "assistant", "content": "a"}]), []),
    (record([]), []),
    (record([USER, {"role": "tool", "content": "c"}]), [("messages[1]", "tool message without tool_call_id"), ("messages[1]", "tool message without name")]),
    (record([call(id=5)]), [("messages[0].tool_calls[0]", "call id is not a string")]),
    (record([USER], [1]), [("tools[0]", "tool is not an object")]),
    (record([call(function={"name": "f", "arguments": [1]})]), [("messages[0].tool_calls[0]", "call arguments are neither object nor string")]),
    (record([call(function="f", type=None)]), [("messages[0].tool_calls[0]", "call type is not a string"), ("messages[0].tool_calls[0]", "call without function name")]),
    (record([{"role": "assistant", "tool_calls": {}}, {"role": 7}, None]),
     [("messages[0]", "tool_calls is not a list"), ("messages[1]", "message without role"), ("messages[2]", "message without role")]),
    (record([{"role": "user", "content": None}, {"role": "critic"}], [{"name": "f"}, {"function": {}}]),
     [("messages[0]", "content is not a string"), ("messages[1]", "unknown role"), ("tools[1]", "tool without name")]),
    ('{"messages": 1, "messages": [], "tools": []}', []),
    ('{"messages": []}', [("tools", "tools is not a list")]),
    ("[]", [("", "not an object")]), ("{", [("", "not JSON")]), ("", [("", "not JSON")]), (None, [("", "not JSON")]),
    (record([{"role": "user", "content": "x" * 300_000}] + [{"role": "robot"}] * 2),
     [("messages[1]", "unknown role"), ("messages[2]", "unknown role")]),
]
JSON_MODE = [
    (json.dumps({"messages": [USER, {"role": "assistant", "content": {"a": 1}}], "pydantic_schema": {"a": "b"}}), []),
    (json.dumps({"messages": [{"role": "user"}, {"content": 5}], "pydantic_schema": "s"}),
     [("messages[0]", "content is neither string nor object"), ("messages[1]", "message without role"),
      ("messages[1]", "content is neither string nor object"), ("pydantic_schema", "pydantic_schema is not a dict")]),
]


def test_every_violation_has_its_place(spark):
    for kind, cases in (("function_calling", CALLING), ("json_mode", JSON_MODE)):
        df = spark.createDataFrame([(i, text) for i, (text, _) in enumerate(cases)], "i int, record string")
        rows = df.select("i", V.envelope_violations("record", kind).alias("v"), V.envelope_errors("record", kind).alias("e")).collect()
        got = {r.i: [tuple(v) for v in r.v] for r in rows}
        assert got == {i: found for i, (_, found) in enumerate(cases)}
        assert {r.i: r.e for r in rows} == {i: found[0][1] if found else None for i, (_, found) in enumerate(cases)}


def test_quarantine_grows_by_reason(spark, tmp_path):
    df = spark.createDataFrame([(i, text) for i, (text, _) in enumerate(CALLING)], "i int, record string")
    good, bad = V.split_by_envelope(df, "function_calling")
    assert sorted(r.i for r in good.collect()) == [i for i, (_, found) in enumerate(CALLING) if not found]
    for times in (1, 2):
        sinks.quarantine(bad, f"{tmp_path}/q")
        rows = spark.read.parquet(f"{tmp_path}/q").filter("reason = 'unknown role'").collect()
        assert sorted((r.i, r.places) for r in rows) == sorted([(8, ["messages[1]"]), (15, ["messages[1]", "messages[2]"])] * times)


def test_saved_results_feed_exports_and_preferences(spark, tmp_path):
    broken = call(function={"name": "f", "arguments": '{"a": "x"}'})
    rows = [("01", None, "t/1", record([USER, call()])), ("01", "s", "t 2", record([USER, broken]))]
    results = spark.createDataFrame(rows, "category string, subcategory string, task string, reply string")
    sinks.save_results(results, f"{tmp_path}/r")
    saved = scans.scan_saved_results(spark, f"{tmp_path}/r")
    assert sorted((r.category, r.subcategory or "", r.task, r.record) for r in saved.collect()) == sorted((c, s or "", t, r) for c, s, t, r in rows)
    assert [(r.category, r.task) for r in export.export_sharegpt(saved).collect()] == [("01", "t/1")]
    answer = json.dumps({"tool_calls": call()["tool_calls"]})
    pairs = preference.build_preferences(saved, lambda p: answer).collect()
    assert [p.source for p in pairs] == ["01/s/t 2"]


def test_json_arrays_are_whole_files(spark, tmp_path):
    rows = spark.range(25).select(F.col("id"), F.concat(F.lit('say "'), F.col("id").cast("string"), F.lit("\n,[")).alias("said"))
    sinks.save_dataset(rows.repartition(3), f"{tmp_path}/a", "json_array")
    files = list((tmp_path / "a").glob("*.txt"))
    assert len(files) == 3 and sorted(x["id"] for f in files for x in json.loads(f.read_text())) == list(range(25))
    back = scans.scan_dataset(spark, f"{tmp_path}/a", "json_array")
    assert sorted((r.id, r.said) for r in back.collect()) == [(i, f'say "{i}\n,[') for i in range(25)]
    sinks.save_dataset(rows.filter("id < 5").repartition(8, "id"), f"{tmp_path}/some", "json_array")
    assert sum(len(json.loads(f.read_text())) for f in (tmp_path / "some").glob("*.txt")) == 5
