"""Operators against brute force, with hot keys and small blocks."""

import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from loomcraft.catalog import QUERIES
from loomcraft.operators.binding import spread
from loomcraft.operators import conversations as C, packing as P, prefix, selection as S
from loomcraft.operators.completion import complete
from loomcraft.operators.pages import _Page
from loomcraft.operators.retrieval import nearest
from loomcraft.operators.schema_check import check_value
from loomcraft.plans import export as E


def hot_rows(n=600, seed=1):
    """Rows of which every second belongs to one key."""
    rnd = random.Random(seed)
    return [("hot" if i % 2 else f"k{rnd.randrange(9)}", i, rnd.choice([0, 1, 5, 40]), rnd.choice([None, None, f"v{i}"])) for i in range(n)]


def test_running_total_and_budget(spark):
    rows = hot_rows()
    df = spark.createDataFrame(rows, "k string, o long, n int, v string").withColumn("limit", F.lit(300))
    expected, totals = {}, {}
    for k, o, n, _ in rows:
        totals[k] = totals.get(k, 0) + n
        expected[o] = totals[k]
    got = {r.o: r.t for r in prefix.running_total(df, ["k"], "o", "n", "t", block_rows=7).collect()}
    assert got == expected
    kept = {r.o for r in prefix.running_total(df, ["k"], "o", "n", "t", up_to="limit", block_rows=7).collect()}
    assert kept == {o for o, t in expected.items() if t <= 300}


def test_forward_fill(spark):
    rows = hot_rows()
    df = spark.createDataFrame(rows, "k string, o long, n int, v string")
    by_key, last, overall, current = {}, {}, {}, None
    for k, o, _, v in rows:
        last[k] = v if v is not None else last.get(k)
        current = v if v is not None else current
        by_key[o], overall[o] = last[k], current
    assert {r.o: r.v for r in prefix.forward_fill(df, ["v"], "o", ["k"], block_rows=5).collect()} == by_key
    assert {r.o: r.v for r in prefix.forward_fill(df, ["v"], "o", block_rows=5).collect()} == overall


def test_concat_parts_and_whole(spark):
    rows = hot_rows()
    df = spark.createDataFrame(rows, "k string, o long, n int, v string").withColumn("p", F.concat(F.col("o").cast("string"), F.lit(";")))
    whole = {}
    for k, o, *_ in rows:
        whole[k] = whole.get(k, "") + f"{o};"
    assert {r.k: r.t for r in prefix.concat_in_order(df, ["k"], "o", F.col("p"), "t", block_rows=11).collect()} == whole
    parts = prefix.concat_in_parts(df, ["k"], "o", F.col("p"), "t", part_rows=50).collect()
    assert len([r for r in parts if r.k == "hot"]) == 12
    joined = {}
    for r in sorted(parts, key=lambda r: r.part):
        joined[r.k] = joined.get(r.k, "") + r.t
    assert joined == whole


def test_parts_are_cut_by_position(spark):
    rows = [(k if k != "k1" else None, o * o * 37 - 5_000, f"{o};") for k, o, *_ in hot_rows()]
    df = spark.createDataFrame(rows, "k string, o long, p string")
    whole = {}
    for k, _, p in rows:
        whole.setdefault(k, []).append(p)
    expected = {(k, i // 50): "".join(ps[i:i + 50]) for k, ps in whole.items() for i in range(0, len(ps), 50)}
    for block_rows in (7, 100_000):
        got = prefix.concat_by_position(df, ["k"], "o", F.col("p"), "t", part_rows=50, block_rows=block_rows).collect()
        assert len(got) == len(expected) and {(r.k, r.part): r.t for r in got} == expected


def test_short_conversations_with_gaps_are_one_text(spark):
    turns = spark.createDataFrame(
        [(1, 0, "user", None, "a"), (1, 20_000, "tool", "f", "1"), (1, 5_000_000, "tool", "g", None), (None, 70_000, "user", None, "b")],
        "conv_id long, turn long, role string, name string, text string")
    block = "<tool_response>\n{\"name\": \"%s\", \"content\": %s}\n</tool_response>\n"
    assert [tuple(r) for r in C.tool_responses(turns).collect()] == [(1, 0, block % ("f", 1) + block % ("g", "null"))]
    chats = C.chatml_by_conversation(turns.filter("text IS NOT NULL")).collect()
    assert {(r.conv_id, r.part, r.chatml) for r in chats} == {
        (1, 0, "<|im_start|>user\na<|im_end|>\n<|im_start|>tool\n1<|im_end|>\n"), (None, 0, "<|im_start|>user\nb<|im_end|>\n")}


def test_multi_turn_export_has_all_tool_results(spark):
    rows = [(1, 0, "user", None, "ask", None), (1, 5, "assistant", None, None, "<c>"), (1, 70_000, "tool", "f", "1", None),
            (1, 900_000, "tool", "g", "2", None), (1, 900_001, "tool", "f", "3", None), (1, 10**9, "assistant", None, "sum", None),
            (2, 0, "tool", "f", "4", None), (3, 0, "user", None, "only", None), (None, 0, "user", None, "x", None), (None, 1, "tool", None, None, None)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, name string, text string, calls string")
    block = "<tool_response>\n{\"name\": \"%s\", \"content\": %s}\n</tool_response>\n"
    got = E.export_turns(turns, calls="calls", part_rows=2).collect()
    assert sorted((repr(r.conv_id), r.position, r.part, r["from"], r.value) for r in got if r.position) == [
        ("1", 1, 0, "human", "ask"), ("1", 2, 0, "gpt", "<c>"), ("1", 3, 0, "tool", block % ("f", 1) + block % ("g", 2)),
        ("1", 3, 1, "tool", block % ("f", 3)), ("1", 4, 0, "gpt", "sum"), ("3", 1, 0, "human", "only"),
        ("None", 1, 0, "human", "x"), ("None", 3, 0, "tool", block % ("", "null"))]
    assert sorted(repr(r.conv_id) for r in got if not r.position) == ["1", "3", "None"]


def test_turns_without_text_are_exported_empty(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "user", None), (1, 2, "assistant", None), (2, 0, "assistant", "b"), (3, 0, "user", None)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = E.export_turns(turns).filter("position > 0").collect()
    assert sorted((r.conv_id, r.position, r["from"], r.value) for r in got) == [(1, 1, "human", ""), (1, 4, "gpt", ""), (3, 1, "human", "")]
    assert sorted(r.conv_id for r in E.export_turns(turns, "single").collect()) == [1, 3]


def test_few_shot_and_tool_results_whatever_the_ids(spark, tmp_path):
    spark.createDataFrame([(i, f"t{i}") for i in (9_999, 10_000, 20_001, 30_000)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [tuple(r) for r in QUERIES["few_shot"](spark, str(tmp_path)).collect()] == [(0, "t9999\nt10000\nt20001")]
    events = [(i * 999, i % 2, "click" if i % 5 else "view", f"{i}") for i in range(40)]
    spark.createDataFrame(events, "event_id long, user_id long, event_type string, props string").write.parquet(f"{tmp_path}/events.parquet")
    rows = QUERIES["tool_results_whole"](spark, str(tmp_path)).collect()
    assert {(r.conv_id, r.part, r.tool.count("<tool_response>")) for r in rows} == {(0, 0, 16), (1, 0, 16)}


def test_packing_stops_at_the_first_that_does_not_fit(spark):
    docs = [("t", 0, "u0", "a" * 5, None), ("t", 1, "u1", None, None), ("t", 2, "u2", "b!" * 3, [[["h"], ["c"]]]),
            ("t", 3, "u3", "c" * 60, None), ("t", 4, "u4", "d", None), ("s", 0, "u5", "e" * 99, None)]
    df = spark.createDataFrame(docs, "k string, rank int, url string, content string, tables array<array<array<string>>>")
    rows = P.pack_documents(df.withColumn("b", F.lit(60)), ["k"], "rank", "b", tables="tables").collect()
    assert [(r.k, r.doc_list) for r in rows] == [
        ("t", '<doc index="u0">\naaaaa\n</doc>\n<doc index="u2">\nbbb\n| h |\n| --- |\n| c |\n\n</doc>\n')]


def test_merged_results(spark):
    first = spark.createDataFrame([("q", 0, "a"), ("q", 1, "a"), ("q", 2, "b")], "q string, position int, url string")
    second = spark.createDataFrame([("q", 0, "b"), ("q", 1, "c"), ("q", 2, "c"), ("r", 0, "a")], "q string, position int, url string")
    got = [tuple(r) for r in S.merged_results(first, second, ["q"], "position", "url").orderBy("q", "engine", "position").collect()]
    assert got == [("q", 1, 0, "a"), ("q", 1, 1, "a"), ("q", 1, 2, "b"), ("q", 2, 1, "c"), ("r", 2, 0, "a")]
    assert S.merged_results(first, second.limit(0), ["q"], "position", "url").count() == 3


def brute(queries, vectors, k):
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    sims = np.round(unit(queries) @ unit(vectors).T, 9)
    return {i: [int(j) for j in np.lexsort((np.arange(len(vectors)), -sims[i]))[:k]] for i in range(len(queries))}


def test_nearest_is_exact_with_copies_and_small_parts(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 8))
    vectors = (centres[rng.integers(0, 6, 400)] + 0.1 * rng.normal(size=(400, 8))).astype("float32").astype(float)
    vectors[:140] = vectors[0]
    queries = np.vstack([vectors[130:150], rng.normal(size=(30, 8)).astype("float32").astype(float)])
    frame = lambda m, name: spark.createDataFrame(
        pd.DataFrame({name: range(len(m)), "embedding": [list(map(float, v)) for v in m]}), f"{name} long, embedding array<float>")
    zero = spark.createDataFrame([(1000, [0.0] * 8)], "vec_id long, embedding array<float>")
    for k in (1, 4):
        found = nearest(
            frame(queries, "query_id"), frame(vectors, "vec_id").unionByName(zero), k, cells=12, rows_per_part=16).collect()
        got = {}
        for r in sorted(found, key=lambda r: r["rank"]):
            got.setdefault(r.query_id, []).append(r.vec_id)
        assert got == brute(queries, vectors, k)


def test_completion_keeps_errors_and_counts_attempts(spark, tmp_path):
    log = str(tmp_path / "asked")

    def client(prompt):
        with open(log, "a") as f:
            f.write(prompt + "\n")
        if prompt == "bad":
            raise RuntimeError("down")
        return prompt.upper()

    prompts = spark.createDataFrame([(1, "a"), (2, "bad"), (3, None), (4, "b")], "i int, p string")
    answered = complete(prompts, "p", client, attempts=2, accept=lambda r: r != "B")
    rows = {r.i: (r.completion, r.error, r.attempts) for r in answered.collect()}
    answered.count()
    assert rows == {1: ("A", None, 1), 2: (None, "down", 2), 3: (None, "no prompt", 0), 4: (None, "reply not accepted", 2)}
    assert sorted(open(log).read().split()) == ["a", "b", "b", "bad", "bad"]


def test_pages():
    read = lambda page: _Page().read(page)
    assert read("<p> a </p><div>x</div><p></p><p>b<br>c</p>") == ("a bc", [])
    # Left out, the end of a paragraph, cell or row is where the next one starts: no text is kept twice.
    assert read("<p>a<p>b") == ("a b", [])
    assert read("<table><tr><td>a<td>b<tr><td>c</table>") == ("", [[["a", "b"], ["c"]]])
    assert read("<p>x<table><tr><td><p>y<p>z</table>w") == ("xyzw y z", [[["yz"]]])
    assert len(read("<p>ab" * 20_000)[0]) == 3 * 20_000 - 1
    assert read("<p>a<script>var p='</p>'</script>b</p><!-- <p>no</p> --></p><p>&amp; &lt;&nosuch; &#233;</p>")[0] == "ab & <&nosuch é"
    table = "<table><tr><th>h</th></tr><tr><td> a <b>b </b></td><td></td></tr></table><table></table>"
    assert read(table) == ("", [[[], ["ab", ""]], []])
    assert read("<table><tr><td>o<table><tr><td>i</td></tr></table></td></tr></table>")[1] == [[["oi", "i"], ["i"]], [["i"]]]


SCHEMA_CASES = [
    ('{"type": "object", "required": ["a"]}', '{"a": 1}', True), ('{"type": "object", "required": ["a"]}', "{}", False),
    ('{"type": "integer"}', "1.0", True), ('{"type": "integer"}', "true", False), ('{"type": "number"}', "true", False),
    ('{"type": ["string", "null"]}', "null", True), ('{"type": "text"}', '"x"', False), ("[]", "1", False), ("true", "1", True),
    ('{"enum": [1, "a"]}', "1.0", True), ('{"enum": [1]}', "true", False), ('{"const": {"a": [1]}}', '{"a": [1.0]}', True),
    ('{"properties": {"a": {"type": "string"}}, "additionalProperties": false}', '{"b": 1}', False),
    ('{"patternProperties": {"^x": {"type": "string"}}, "additionalProperties": false}', '{"xa": "v"}', True),
    ('{"items": {"type": "integer"}, "minItems": 2}', '[[1, 2], [1]]', False), ('{"items": {"type": "integer"}}', '[[1, 2], ["x"]]', False),
    ('{"prefixItems": [{"type": "string"}], "items": {"type": "integer"}}', '[["a", 1]]', True),
    ('{"uniqueItems": true}', "[[1, 1.0]]", False), ('{"uniqueItems": true}', "[[1, true]]", True),
    ('{"$ref": "#/$defs/A", "$defs": {"A": {"type": "string"}}}', "5", False),
    ('{"properties": {"a": {"$ref": "#/$defs/A"}}, "$defs": {"A": {"minLength": 2}}}', '{"a": "x"}', False),
    ('{"$ref": "http://x/y"}', "1", False), ('{"anyOf": [{"type": "string"}, {"minimum": 5}]}', "7", True),
    ('{"oneOf": [{"minimum": 1}, {"minimum": 5}]}', "7", False), ('{"allOf": [{"minimum": 1}, {"maximum": 5}]}', "7", False),
    ('{"not": {"type": "string"}}', '"x"', False), ('{"if": {"type": "string"}, "then": {"minLength": 3}}', '"ab"', False),
    ('{"pattern": "^a"}', '"ba"', False), ('{"multipleOf": 0.5}', "1.5", True), ('{"exclusiveMaximum": 5}', "5", False),
    ('{"format": "email"}', '"nobody"', True), ('{"Model": {"whatever": 1}}', '{"x": 1}', True), ('{"type": "object"}', "{oops", False),
    ('{"$ref": "#"}', "1", False), (None, "1", False),
    ('{"properties": {"x": {"type": "nope"}}}', '{"a": 1}', False), ('{"required": "a"}', '{"a": 1}', False),
    ('{"properties": {"x": {"minLength": -1}}}', '{"a": 1}', False), ('{"anyOf": []}', "1", False), ('{"pattern": "("}', "1", False),
    ('{"$defs": {"unused": 5}}', "1", False), ('{"dependentRequired": {"a": ["b"]}}', '{"a": 1}', False),
    ('{"dependentSchemas": {"a": {"required": ["b"]}}}', '{"a": 1, "b": 2}', True),
    ('{"contains": {"type": "integer"}, "minContains": 0}', '[["a"]]', True),
    ('{"contains": {"type": "integer"}, "minContains": 2}', '[["a", 1]]', False), ('{"contains": {"type": "integer"}, "maxContains": 1}', "[[1, 2]]", False),
    ('{"$schema": "http://json-schema.org/draft-07/schema#", "items": [{"type": "integer"}], "additionalItems": false}', '[[1, 2]]', False),
    ('{"$schema": "http://json-schema.org/draft-07/schema#", "items": [{"type": "integer"}]}', '[[1, "b"]]', True), ('{"items": [{}]}', "[[1]]", False),
]


def test_json_schema():
    assert [(s, v, check_value(v, s)[0]) for s, v, _ in SCHEMA_CASES] == SCHEMA_CASES


def test_task_functions_travel_by_value():
    """Executors have no copy of the package."""
    from pyspark import cloudpickle

    data = cloudpickle.dumps(check_value)
    assert b"_check_object" in data and "loomcraft" in cloudpickle.list_registry_pickle_by_value()


def test_parts_of_a_spread_table_are_bounded_by_size(spark, tmp_path):
    spark.range(200_000).coalesce(1).write.parquet(f"{tmp_path}/one")
    rows = spark.read.parquet(f"{tmp_path}/one")
    size = sum(f.stat().st_size for f in (tmp_path / "one").glob("*.parquet"))
    dealt = spread(rows, part_bytes=size // 40)
    assert dealt.rdd.getNumPartitions() >= 40 > spread(rows).rdd.getNumPartitions()
    assert dealt.agg(F.count("*"), F.countDistinct("id")).first() == (200_000, 200_000)
