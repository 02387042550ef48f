"""One row per rule of the tool, reply, text and conversation expressions."""

import json

import pytest
from pyspark.sql import Row, functions as F

from loomcraft.functions import jsons as J, messages as M, text as X, tools as T
from loomcraft.operators import scoring, validation as V
from loomcraft.operators.conversations import parse_records, sharegpt_conversation
from loomcraft.operators.replies import with_fenced_calls, with_tool_calls


def column(spark, values, expression, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in rows.select(expression(F.col("v")).alias("x"), "i").orderBy("i").select("x").collect()]


def tool(parameters, name="f"):
    return json.dumps({"type": "function", "function": {"name": name, "parameters": parameters}})


def props(**kinds):
    return {"properties": kinds}


S, I, N, B = ({"type": t} for t in ("string", "integer", "number", "boolean"))
OK = "Function call is valid"
MISMATCH = "Invalid argument 'a': Type mismatch for parameter a. Expected: {}, Got: <class '{}'>"
CALLS = [
    (props(a=I), {"a": 5}, OK),
    (props(a=I), {"a": True}, OK),
    (props(a=I), {"a": 1.5}, MISMATCH.format("integer", "float")),
    (props(a=I), {"a": 1.0}, MISMATCH.format("integer", "float")),
    (props(a=I), {"a": 12345678901234567890}, OK),
    (props(a=I), {"a": "5"}, MISMATCH.format("integer", "str")),
    (props(a=S), {"a": 0}, OK),
    (props(a=I), {"a": ""}, OK),
    (props(a=I), {"a": False}, OK),
    (props(a=I), {"a": None}, OK),
    (props(a=I), {"a": []}, OK),
    (props(a=I), {"a": 0.0}, OK),
    (props(a=N), {"a": 2.5}, OK),
    (props(a=B), {"a": 1}, MISMATCH.format("boolean", "int")),
    (props(a={"type": "array"}), {"a": {"x": 1}}, MISMATCH.format("array", "dict")),
    (props(a={"type": "object"}), {"a": [1]}, MISMATCH.format("object", "list")),
    (props(a={"type": "null"}), {"a": 1}, MISMATCH.format("null", "int")),
    (props(a={"type": ["string"]}), {"a": "x"}, "Invalid argument 'a': unhashable type: 'list'"),
    (props(a={"type": "text"}), {"a": "x"}, "Invalid argument 'a': 'text'"),
    (props(a={}), {"a": "x"}, OK),
    (props(a={"type": "string", "enum": ["u", "v"]}), {"a": "u"}, OK),
    (props(a={"type": "string", "enum": ["u", "v"]}), {"a": "w"},
     "Invalid argument 'a': Error validating function call: Invalid value 'w' for parameter a. Expected one of u, v"),
    (props(a={"type": "string", "enum": {"u": 1}}), {"a": "u"}, OK),
    (props(a={"type": "string", "enum": []}), {"a": "w"}, OK),
    (props(a={"type": "string", "enum": ["u", None]}), {"a": "w"}, OK),
    (props(a={"type": "string", "enum": None}), {"a": "w"}, "Invalid argument 'a': argument of type 'NoneType' is not iterable"),
    (props(a={"type": "integer", "enum": [1]}), {"a": 2}, OK),
    (props(a=I) | {"required": ["a", "b"]}, {}, "Missing required arguments: ['a', 'b']"),
    (props(a=I) | {"required": ["it's"]}, {}, 'Missing required arguments: ["it\'s"]'),
    (props(a=I), {"z": object}, OK),
    (props(**{"a b.c": S}), {"a b.c": 5}, MISMATCH.replace("'a'", "'a b.c'").replace("parameter a.", "parameter a b.c.").format("string", "int")),
    (props(z=S, a=S), {"a": 1, "z": 2}, "Invalid argument 'z': Type mismatch for parameter z. Expected: string, Got: <class 'int'>"),
    ({}, {"a": 1}, OK),
    (None, {"a": 1}, "Error validationg function call: 'NoneType' object has no attribute 'get'"),
    ({"properties": None}, {}, "Error validationg function call: 'NoneType' object has no attribute 'items'"),
    ({"properties": {}, "required": None}, {}, "Error validationg function call: 'NoneType' object is not iterable"),
]


def test_call_messages(spark):
    rows = [
        (i, tool(p), json.dumps(a, default=lambda _: "undeclared")) for i, (p, a, _) in enumerate(CALLS)
    ]
    df = spark.createDataFrame(rows, "i int, signature string, arguments string")
    df = df.withColumn("compiled", T.compiled_signature("signature"))
    got = df.select("i", T.call_message(F.lit("f"), "arguments", "compiled").alias("m")).orderBy("i").collect()
    assert [r.m for r in got] == [m for _, _, m in CALLS]


@pytest.mark.parametrize("arguments,message", [
    ("[1]", "Invalid tool call: arguments are not a JSON object"), ("oops", "Invalid tool call: arguments are not a JSON object"),
    ("{'a': 1}", "Invalid tool call: arguments are not a JSON object"), ('{"a": 1} x', "Invalid tool call: arguments are not a JSON object"),
    ('{"a": "x", "a": 1}', OK), (None, "Invalid tool call: arguments are not a JSON object"),
])
def test_arguments_text(spark, arguments, message):
    df = spark.createDataFrame([(tool(props(a=I)), arguments)], "signature string, arguments string")
    df = df.withColumn("compiled", T.compiled_signature("signature"))
    assert df.select(T.call_message(F.lit("f"), "arguments", "compiled")).first()[0] == message


def test_first_signature_of_a_name_counts(spark):
    tools = spark.createDataFrame([(0, tool(props(a=I))), (1, tool(props(a=S)))], "position int, signature string")
    calls = spark.createDataFrame([("f", '{"a": 1}'), ("g", "{}")], "name string, arguments string")
    got = {r.name: (r.status, r.message) for r in V.validate_calls(calls, V.signature_table(tools)).collect()}
    assert got == {"f": ("accepted", OK), "g": ("failed", "No matching function signature found for function: g")}


def test_admission(spark):
    cases = {
        tool({}): None, '{"type": "function", "function": {}}': "Missing required fields in function signature",
        '{"name": "f"}': "Missing required fields in function signature",
        '{"type": "tool", "function": {"name": "f"}}': "Validation error for function signature",
        '{"type": "function", "function": {"name": 5}}': "Validation error for function signature",
        '{"type": "function", "function": {"name": "f", "parameters": []}}': "Validation error for function signature",
    }
    assert column(spark, list(cases), T.rejection_reason) == list(cases.values())


def test_salvage(spark):
    cases = {
        '{"a": 1}': '{"a": 1}', ' {"a": 1}\n': '{"a": 1}', 'Sure: {"a": 1} ok': '{"a": 1}', '{"a": 1} {"b": 2}': None, "{}": None,
        "[ ]": None, "5": "5", "0": None, "x {} y": None, '{"a": {"b": 1}': None, "": None, "}{": None, '{"a":1,"a":2}': '{"a":1,"a":2}',
        '"word"': '"word"', "[1, 2]": "[1, 2]", "1, 2": None, "{'a': 1}": None,
    }
    assert column(spark, list(cases), J.salvaged) == list(cases.values())


def test_canonical_equality(spark):
    same = [("1", "1.0"), ("1", "true"), ("1", "1e0"), ('{"b": [1.50, "A"], "a": null}', '{"a":null,"b":[1.5,"\\u0041"]}'), ("-0", "0"), ("1000", "1e3")]
    different = [("1", '"1"'), ('"true"', "true"), ("[1]", "[1,2]"), ("0.1", "0.10000001"), ('"a 1.0"', '"a 1"'), ("9007199254740993", "9007199254740992")]
    flat = column(spark, [x for pair in same + different for x in pair], J.canonical)
    assert [a == b for a, b in zip(flat[::2], flat[1::2])] == [True] * len(same) + [False] * len(different)


def test_names_and_text(spark):
    names = ["a b-c", "é/ü.json", "tab\tline\n", "x" * 300, "a b", "é"]
    assert column(spark, names, X.safe_name) == ["a_b-c", "éüjson", "tab\tline\n", "x" * 254, "a b", "e"]
    assert column(spark, ["y" * 66, "y" * 65], X.task_slug) == ["y" * 55, "y" * 65]
    assert column(spark, ["One. Two", "none", "all."], X.to_last_full_stop) == ["One.", "none", "all."]
    assert column(spark, ["a/b.c.json", "a/.json", "noext"], X.file_stem) == ["b.c", ".json", "noext"]
    assert column(spark, ["x/a.py", "b.ipynb", "c.md"], X.task_file_name) == ["a.json", "b.json", "c.md.json"]


def test_markdown(spark):
    tables = [[[["h", "k"], ["1", "2"]], [], [[]], [["only"]]]]
    assert column(spark, tables, X.markdown_tables, "array<array<array<string>>>") == [
        "| h | k |\n| --- | --- |\n| 1 | 2 |\n" + "|\n|\n" + "| only |\n| --- |\n"]


def test_assistant_turn(spark):
    text = "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\none<|im_end|>\n<|im_start|> assistant\n two \n"
    assert column(spark, [text, "nothing"], M.assistant_turn) == ["two", ""]


def test_tool_call_elements(spark):
    said = "<|im_start|>assistant\n"
    cases = [
        '<tool_call>{"name": "a"}</tool_call> and <tool_call>\n{"name": "b"}', "no calls", "<tool_call>{'name': 'c', 'x': True}</tool_call>",
        '<tool_call>{"name": "R&D <x>"}</tool_call>', "<tool_call>broken(</tool_call><tool_call>{}</tool_call>",
    ]
    rows = spark.createDataFrame([(i, said + c) for i, c in enumerate(cases)], "i int, t string")
    got = with_tool_calls(rows, "t").orderBy("i").collect()
    assert [r.calls for r in got] == [
        ['{"name": "a"}', '{"name": "b"}'], [], ['{"name": "c", "x": true}'], ['{"name": "R&D <x>"}'], ["{}"]]
    assert [r.parsed for r in got] == [True, False, True, True, True]


def test_fenced_blocks(spark):
    text = "```tool_call\n{'a': {'b': None}}\n```\nx\n```tool_call\n{\"c\": true}\n```\n```tool_call\n{oops}\n```"
    rows = with_fenced_calls(spark.createDataFrame([(text,)], "t string"), "t")
    assert rows.first().calls == ['{"a": {"b": null}}', '{"c": true}']


def test_scoring(spark):
    call = lambda n, **a: {"name": n, "arguments": a}
    cases = [
        (call("f", a=1), [call("f", a=1.0)], "passed"), (call("f", a=1), [call("f", a=2)], "failed"),
        (call("f", a=1), [call("f", a=1, b=2)], "passed"), (call("f", a=None), [call("f")], "passed"),
        (call("f", a=1), [call("g", a=1)], "failed"), (call("f", a=1), [call("f", a=1), {"arguments": {}}], "failed"),
        (call("f", a=1), [{"name": "f"}], "failed"), (call("f"), [], "failed"),
        ([call("f", a=1), call("f", a=2)], [call("f", a=1), call("f", a=2)], "failed"),
        ([call("f", a=1), call("g")], [call("g"), call("f", a={"x": [1]} and 1)], "passed"),
        (call("f", a={"x": 1, "y": [2]}), [call("f", a={"y": [2.0], "x": 1})], "passed"),
        (call("f", a="1"), [call("f", a=1)], "failed"), ([], [{"arguments": {}}], "passed"),
    ]
    rows = [
        (i, json.dumps(e), "<|im_start|>assistant\n" + "".join(f"<tool_call>{json.dumps(c)}</tool_call>" for c in g), "s", "u")
        for i, (e, g, _) in enumerate(cases)
    ]
    df = spark.createDataFrame(rows, "i int, completion string, model_output string, system string, user string")
    scored = scoring.score_completions(df)
    assert [r.result for r in scored.orderBy("i").collect()] == [r for _, _, r in cases]
    total = scoring.pass_rate(scored).first()
    assert (total.n_passed, total.n_failed) == (6, 7)
    assert scoring.pass_rate(scored.limit(0)).first().pass_rate is None
    assert scoring.failed_pairs(scored).count() == 7


def test_of_repeated_keys_the_last_counts(spark):
    said = '<|im_start|>assistant\n<tool_call>{"name": "g", "arguments": {"a": 2}, "name": "f", "arguments": {"a": 1}}</tool_call>'
    expected = [json.dumps({"name": n, "arguments": {"a": a}}) for n, a in (("f", 1), ("g", 2))]
    rows = [(i, e, said, "s", "u") for i, e in enumerate(expected)]
    df = spark.createDataFrame(rows, "i int, completion string, model_output string, system string, user string")
    assert [r.result for r in scoring.score_completions(df).orderBy("i").collect()] == ["passed", "failed"]


def record(*messages, tools=(tool(props(a=I)),)):
    return json.dumps({"messages": list(messages), "tools": [json.loads(t) for t in tools]})


def said(role, content=None, **more):
    return {"role": role, "content": content, **more}


def calling(*calls):
    return said("assistant", tool_calls=[
        {"id": "1", "type": "function", "function": {"name": n, "arguments": json.dumps(a)}} for n, a in calls])


def test_sharegpt_rules(spark):
    good, bad = calling(("f", {"a": 1})), calling(("f", {"a": "x"}))
    result = said("tool", {"r": 1}, name="f", tool_call_id="1")
    records = [
        record(said("user", "u1"), good, result, result, said("assistant", "done")),
        record(said("user", "u1"), said("user", "u2"), said("assistant", "plain")),
        record(said("user", "u"), good, bad), record(said("user", "u"), bad, good),
        record(said("assistant", "nobody asked")), record(said("system", "s"), said("user", "u"), calling(), said("assistant", "z")),
    ]
    df = parse_records(spark.createDataFrame([(i, r) for i, r in enumerate(records)], "i int, record string"))
    show = lambda turn: [
        None if r.c is None else [(t["from"], t["value"]) for t in r.c[1:]]
        for r in df.select("i", sharegpt_conversation(F.col("messages"), F.col("tools"), turn).alias("c")).orderBy("i").collect()]
    block = '<tool_call>\n{"arguments":{"a": 1},"name":"f"}\n</tool_call>\n'
    response = '<tool_response>\n{"name": "f", "content": {"r":1}}\n</tool_response>\n'
    assert show("multi") == [
        [("human", "u1"), ("gpt", block), ("tool", response * 2), ("gpt", "done")], [("human", "u2"), ("gpt", "plain")],
        None, [("human", "u"), ("gpt", block)], None, [("human", "u"), ("gpt", ""), ("gpt", "z")]]
    assert show("single") == [
        [("human", "u1"), ("gpt", block)], [("human", "u2"), ("gpt", "plain")], None, [("human", "u"), ("gpt", block)], None,
        [("human", "u"), ("gpt", "")]]


def test_messages_without_content_are_exported_empty(spark):
    rows = [record(said("user", "first"), said("user"), said("assistant", "x"), said("assistant")), record(said("assistant", "nobody asked"))]
    df = parse_records(spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, record string"))
    got = df.select("i", sharegpt_conversation(F.col("messages"), F.col("tools")).alias("c")).orderBy("i").collect()
    assert [None if r.c is None else [(t["from"], t["value"]) for t in r.c[1:]] for r in got] == [[("human", ""), ("gpt", "")], None]


def test_object_arguments_and_misplaced_type_fail(spark):
    as_object = said("assistant", tool_calls=[{"id": "1", "type": "function", "function": {"name": "f", "arguments": {"a": 1}}}])
    misplaced = said("assistant", tool_calls=[{"id": "1", "function": {"type": "function", "name": "f", "arguments": "{}"}}])
    df = parse_records(spark.createDataFrame([Row(record=record(said("user", "u"), c)) for c in (as_object, misplaced)]))
    got = df.select(sharegpt_conversation(F.col("messages"), F.col("tools")).alias("c")).collect()
    assert [r.c for r in got] == [None, None]


def test_results_show_call_and_signature(spark):
    kind = "calls array<struct<id:string,type:string,function:struct<name:string,arguments:string>>>, tools array<string>"
    tool = '{"type":"function","function":{"name":"f","parameters":{"properties":{}}}}'
    calls = [("1", "function", ("f", '{"a": 1}')), ("2", "function", ("g", "not JSON")), ("3", "function", (None, None))]
    df = spark.createDataFrame([(calls, [tool]), ([], []), (None, None)], kind)
    rows = [json.loads(r.t) for r in df.select("*", T.record_verdicts("calls", "tools").alias("v")).select(
        T.call_results("calls", "tools", "v").alias("t")).collect()]
    assert rows[1:] == [[], []]
    assert [(r["status"], r["call"], r["signature"]) for r in rows[0]] == [
        ("accepted", {"name": "f", "arguments": {"a": 1}}, json.loads(tool)),
        ("failed", {"name": "g", "arguments": "not JSON"}, None), ("failed", {"name": None, "arguments": None}, None)]
