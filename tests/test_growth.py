"""What must not grow with a table: lookups per call, tasks of saved results, judging done twice."""

import json
import os

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import functions as F

from loomcraft.functions import tools as T
from loomcraft.functions.jsons import salvaged
from loomcraft.operators import binding, prefix, retrieval
from loomcraft.plans import generation, mining, preference
from loomcraft.plans.export import json_mode_parts
from loomcraft.sources.scans import scan_saved_results
from loomcraft.sources.sinks import save_results

_TOOL = '{"type":"function","function":{"name":%s,"parameters":{"properties":{"k":{"type":"integer"}},"required":["k"]}}}'


def test_verdicts_look_values_up_once(spark):
    assert T.record_verdicts("calls", "tools")._jc.toString().count("filter(") <= 12


def test_verdicts_find_tools_whose_names_are_escaped(spark):
    call = F.expr("array(struct('c' AS id, 'function' AS type, struct('view' AS name, '{\"k\": 1}' AS arguments) AS function))")
    for name, message in ((r'"vi\u0065w"', T.VALID), ('"view"', T.VALID), ('"views"', T.NO_MATCH + "view")):
        rows = spark.range(1).select(call.alias("calls"), F.array(F.lit(_TOOL % name)).alias("tools"))
        assert rows.select(T.record_verdicts("calls", "tools").alias("v")).first()["v"][0]["message"] == message


def test_saved_results_are_dealt_out(spark, tmp_path):
    rows = spark.range(50).select(
        F.lit("a").alias("category"), F.lit("b").alias("subcategory"), F.col("id").cast("string").alias("task"), F.lit("{}").alias("reply"))
    save_results(rows, f"{tmp_path}/r")
    found = scan_saved_results(spark, f"{tmp_path}/r")
    assert found.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert found.count() == 50


def test_first_pairs_judge_a_conversation_once(spark):
    judged = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(n):
        judged.add(1)
        return f"do {n}"

    call = "array(struct('c' AS id, 'function' AS type, struct('view' AS name, '{}' AS arguments) AS function))"
    rows = spark.range(40).repartition(4).select(
        F.col("id").alias("conv_id"), counted.asNondeterministic()("id").alias("user"), F.array(F.lit(_TOOL % '"view"')).alias("tools"),
        F.expr(call).alias("tool_calls"))
    fixed = json.dumps({"tool_calls": [{"id": "n", "type": "function", "function": {"name": "view", "arguments": '{"k": 1}'}}]})
    assert [r["id"] for r in preference.first_pairs(rows, lambda request: fixed, 3).collect()] == [0, 1, 2]
    assert judged.value == 40


def test_written_tasks_are_dealt_out_again(spark):
    def client(prompt):
        if prompt.startswith("Please extract"):
            return '{"Category": "code", "Task": "read"}'
        return '{"messages": [{"role": "assistant", "content": {"k": %d}}], "pydantic_schema": {"type": "object"}}' % TaskContext.get().partitionId()

    code = spark.range(40).coalesce(1).select(F.concat("id", F.lit(".py")).alias("path"), F.lit("x = 1").alias("code"))
    fine, _ = mining.mine_and_generate(code, [], "{}", {"Role": "Write.", "Objective": "{task}", "Assistant": "Now:"}, "{}", client)
    found = [json.loads(r["json_object"])["k"] for r in fine.collect()]
    assert len(found) == 40 and len(set(found)) >= spark.sparkContext.defaultParallelism


def test_rows_are_dealt_out_before_distinct_gathers_them(spark, tmp_path):
    rows = spark.range(1000).select((F.col("id") % 7).alias("a"), F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("b"))
    rows.coalesce(1).write.parquet(str(tmp_path / "t"))
    found = binding.distinct(spark.read.parquet(str(tmp_path / "t")), part_bytes=100)
    assert sorted(found.collect(), key=str) == sorted(rows.distinct().collect(), key=str)
    plan = found._jdf.queryExecution().executedPlan().toString()
    plan = plan.split("== Initial Plan ==")[-1]
    assert plan.count("Exchange") == 1 and plan.rindex("HashAggregate") < plan.index("Exchange")


def test_results_of_a_step_are_read_out_once(spark, monkeypatch):
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(text):
        read.add(1)
        return text

    monkeypatch.setattr(generation, "salvaged", lambda c: counted(F.col(c)))
    record = json.dumps({"messages": [{"role": "user", "content": "do"}], "tools": [{"name": "t"}]})
    names = ("path", "category", "subcategory", "task", "doc_list", "examples")
    rows = spark.range(40).coalesce(1).select(F.col("id").alias("task_key"), *[F.lit("").alias(n) for n in names], F.lit(record).alias("record"))
    sections = {"Role": "ask", "Objective": "{user_message}"}
    made = generation.regenerate_in_steps(
        rows, sections, sections, lambda request: '{"tools": [{"role": "tool", "content": "x"}]}', lambda request: '{"tool_calls": []}')
    assert made.count() == 40 and read.value == 40


def test_best_pairs_are_those_of_all_pairs(monkeypatch):
    draw = np.random.default_rng(7)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    widths = []
    partition = np.partition
    monkeypatch.setattr(np, "partition", lambda x, *a, **b: widths.append(x.shape[1]) or partition(x, *a, **b))
    queries = unit(draw.normal(size=(600, 24)))
    spread = unit(draw.normal(size=(3_000, 24)))
    alike = unit(spread[:1] + 1e-8 * draw.normal(size=(900, 24)))  # many equal to nine digits
    with_nan = np.where(np.arange(40)[:, None] % 7 == 3, np.nan, spread[:40])
    for vectors in (spread, alike, with_nan, spread[:3], spread[:1]):
        ids = draw.permutation(len(vectors))
        row, col, similarity = retrieval.best_pairs(queries, vectors, ids, 5)
        sims = np.round(queries @ vectors.T, 9)
        wanted = [sorted((-s, i) for s, i in zip(r, ids) if s == s)[:5] for r in sims]
        got = [[] for _ in queries]
        for r, c, s in zip(row, col, similarity):
            got[r].append((-s, ids[c]))
        assert got == wanted
    assert max(widths) < 300  # not whole rows of 3,000


def _random_vectors(spark, count, numbers, name, seed):
    m = np.random.default_rng(seed).normal(size=(count, numbers)).astype("float32")
    rows = pd.DataFrame({name: range(count), "embedding": list(m.astype(float))})
    return m.astype(float), spark.createDataFrame(rows, f"{name} long, embedding array<float>").repartition(4)


def test_searches_that_rule_out_no_cell_shuffle_vectors_once(spark):
    folders = [f.getPath() for f in spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().localDirs()]
    shuffled = lambda: sum(
        os.path.getsize(os.path.join(d, f)) for top in folders for d, _, files in os.walk(top) for f in files if f.startswith("shuffle_"))
    _, vectors = _random_vectors(spark, 4000, 64, "vec_id", 1)
    before = shuffled()
    found = retrieval.nearest(vectors.withColumnRenamed("vec_id", "query_id"), vectors, 2, cells=32)
    assert found.filter("rank = 1 AND query_id = vec_id").count() == 4000
    assert shuffled() - before < 8 * 4000 * 64 * 4  # of 32 cells


def test_several_blocks_of_queries_in_a_task(spark):
    vectors, rows = _random_vectors(spark, 300, 6, "vec_id", 2)
    queries, asked = _random_vectors(spark, 400, 6, "query_id", 3)
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    sims = np.round(unit(queries) @ unit(vectors).T, 9)
    wanted = {(q, n + 1, int(v)) for q in range(400) for n, v in enumerate(np.lexsort((np.arange(300), -sims[q]))[:3])}
    found = retrieval.nearest(asked, rows, 3, cells=10, rows_per_part=7).collect()
    assert {(r.query_id, r["rank"], r.vec_id) for r in found} == wanted and len(found) == len(wanted)


def test_best_pairs_leave_out_what_is_of_no_use():
    draw = np.random.default_rng(9)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    queries, vectors, ids = unit(draw.normal(size=(50, 8))), unit(draw.normal(size=(200, 8))), np.arange(200)
    every = list(zip(*retrieval.best_pairs(queries, vectors, ids, 4)))
    for least in (-1.0, 0.8, 2.0):
        got = list(zip(*retrieval.best_pairs(queries, vectors, ids, 4, np.full(50, least))))
        assert got == [x for x in every if x[2] >= least]
    assert [len(x) for x in retrieval.best_pairs(queries, vectors[:0], ids[:0], 4)] == [0, 0, 0]


def test_pieces_joined_in_order_are_shuffled_once(spark):
    rows = spark.range(100).select((F.col("id") % 5).alias("k"), F.col("id").alias("o"), F.col("id").cast("string").alias("p"))
    joined = prefix.concat_in_order(rows, ["k"], "o", F.col("p"), "t", ",", block_rows=10)
    assert joined._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert {r.k: r.t for r in joined.collect()} == {k: ",".join(str(i) for i in range(k, 100, 5)) for k in range(5)}


def _times(spark, column, what):
    return spark.range(1).select(column.alias("x"))._jdf.queryExecution().analyzed().toString().count(what)


def test_replies_and_records_are_read_once(spark):
    parts = json_mode_parts(F.lit("{}"))
    assert _times(spark, parts["json_object"], "from_json(") == 1
    assert _times(spark, salvaged(F.lit("{}")), "from_json(") == 2  # the reply, and what its braces hold


def test_salvaged_replies_and_objects_of_records(spark):
    record = lambda *said: json.dumps({"messages": [{"role": r, "content": c} for r, c in said], "pydantic_schema": {}})
    rows = [(' {"a":1} ', '{"a":1}'), ('so: {"a":{}} .', '{"a":{}}'), ("{}", None), ("see {} there", None), ("", None), (None, None),
            ("{'a'}", None), ("[0]", "[0]")]
    got = spark.createDataFrame([(i, r) for i, (r, _) in enumerate(rows)], "i int, r string").select("i", salvaged("r").alias("x"))
    assert [r.x for r in got.orderBy("i").collect()] == [x for _, x in rows]
    records = [(record(("user", "u"), ("assistant", {"k": 1}), ("assistant", {"k": 2})), '{"k":2}'),
               (record(("assistant", 'a "b"')), '"a \\"b\\""'), (record(("user", "u")), None), ("[]", None), ("no", None), (None, None)]
    frame = spark.createDataFrame([(i, r) for i, (r, _) in enumerate(records)], "i int, r string")
    found = frame.select("i", json_mode_parts(F.col("r"))["json_object"].alias("x")).orderBy("i").collect()
    assert [r.x for r in found] == [x for _, x in records]
