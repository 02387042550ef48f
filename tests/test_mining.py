"""Tasks mined and records made in one plan: rounds, faults, known tasks, a job started again."""

import json
import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

from loomcraft.operators.shelf import KEY, shelved, with_text
from loomcraft.plans.mining import NO_OBJECT, NO_TASK, mine_and_generate
from loomcraft.session import shared_folder

SECTIONS = {"Objective": "{task}", "Documents": "{doc_list}"}
SCHEMA = '{"type": "object", "properties": {"k": {"type": "integer"}}, "required": ["k"]}'


def client(log):
    """Writes what it is asked to a file; answers by words in the code."""

    def answer(prompt):
        with open(log, "a") as f:
            f.write(json.dumps(prompt) + "\n")
        if prompt.startswith("Please extract"):
            return "prose" if "NOTASK" in prompt or "LATE" in prompt and "Answer" not in prompt else '{"category": "c", "task": "t"}'
        if "BOOM" in prompt:
            raise RuntimeError("down")
        if "PROSE" in prompt:
            return "prose"
        k = '"x"' if "BAD" in prompt else "1"
        return '{"messages": [{"role": "assistant", "content": {"k": %s}}], "pydantic_schema": %s}' % (k, SCHEMA)

    return answer


def run(spark, calls, rows, **options):
    code = spark.createDataFrame(rows, "path string, code string, extra int")
    fine, failed = mine_and_generate(code, [], "{}", SECTIONS, "{}", client(calls), **options)
    return {r.path: r for r in fine.collect()}, {r.path: r for r in failed.collect()}


def asked(log):
    with open(log) as f:
        return [json.loads(line) for line in f]


def test_rounds_and_faults(spark, tmp_path):
    log = f"{tmp_path}/calls"
    words = ["", "LATE", "NOTASK", "BOOM", "PROSE", "BAD"]
    rows = [(f"d/{w.lower() or 'good'}.py", w, 1) for w in words] + [("e/good.js", None, None)]
    fine, failed = run(spark, log, rows, tell_fault=True)
    assert {p: r.rounds for p, r in fine.items()} == {"d/good.py": 1, "e/good.js": 1, "d/late.py": 2}
    assert {r.task_file for r in fine.values()} == {"good.json", "late.json"} and all(r.json_object == '{"k":1}' for r in fine.values())
    faults = {p.removeprefix("d/").removesuffix(".py"): r.fault for p, r in failed.items()}
    assert faults.pop("bad") not in (None, NO_OBJECT) and faults == {"notask": NO_TASK, "boom": "down", "prose": NO_OBJECT}
    assert all(r.rounds == 3 for r in failed.values())
    calls = asked(log)
    assert sum(p.startswith("Please extract") and "NOTASK" in p for p in calls) == 3
    assert sum("BAD" in p and p.startswith("Please extract") for p in calls) == 1
    assert len(calls) == 7 + 1 + 2 + 3 * 3 + 3  # mined, late and twice no task again, failing records thrice, good ones once


def test_known_tasks_are_not_mined(spark, tmp_path):
    log = f"{tmp_path}/calls"
    known = spark.createDataFrame([("a.py", '{"Task": "old"}'), ("a.py", '{"Task": "old"}'), ("gone.py", "{}")], "path string, task_json string")
    fine, failed = run(spark, log, [("a.py", "x", 1), ("b.py", "y", 2)], known=known)
    assert not failed and fine["a.py"].task_json == '{"Task": "old"}' and fine["b.py"].task_json == '{"category": "c", "task": "t"}'
    assert sum(p.startswith("Please extract") for p in asked(log)) == 1


def test_a_job_started_again_asks_for_failures_only(spark, tmp_path):
    log, answers = f"{tmp_path}/calls", f"{tmp_path}/answers"
    rows = [("a.py", "x", 1), ("b.py", "BOOM", 2)]
    run(spark, log, rows, tell_fault=True, log=answers)
    first = len(asked(log))
    fine, failed = run(spark, log, rows, tell_fault=True, log=answers)
    assert set(fine) == {"a.py"} and set(failed) == {"b.py"}
    assert all("BOOM" in p and not p.startswith("Please") for p in asked(log)[first:])
    with pytest.raises(ValueError):
        run(spark, log, rows, log=answers)


def test_no_files(spark, tmp_path):
    assert run(spark, f"{tmp_path}/calls", []) == ({}, {})


def on_disk(folder):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, files in os.walk(folder) for f in files)


def test_rounds_write_code_once(spark, tmp_path):
    folder = shared_folder(spark).removeprefix("file:")
    codes = ["BAD" + os.urandom(20_000).hex() for _ in range(40)]
    before = on_disk(folder)
    fine, failed = run(spark, f"{tmp_path}/calls", [(f"{i}.py", c, i) for i, c in enumerate(codes)], tell_fault=True)
    assert not fine and len(failed) == 40 and {r.rounds for r in failed.values()} == {3}
    assert on_disk(folder) - before < 1.5 * sum(map(len, codes))


def test_equal_rows_and_rows_without_path_stay(spark, tmp_path):
    rows = [("a.py", "x"), ("a.py", "x"), ("a.py", "BAD"), (None, "x"), (None, None), (None, ""), ("b.py", "NOTASK"), ("b.py", "NOTASK")]
    code = spark.createDataFrame(rows, "path string, code string")
    fine, failed = mine_and_generate(code, [], "{}", SECTIONS, "{}", client(f"{tmp_path}/calls"), tell_fault=True)
    assert Counter(r.path for r in fine.collect()) == {"a.py": 2, None: 3}
    assert Counter(r.path for r in failed.collect()) == {"a.py": 1, "b.py": 2}


def test_shelved_texts_are_not_shuffled_again(spark):
    rows = [(1, None, "x"), (1, None, "x"), (None, "", None), (1, "", "x"), (2, "-", "y" * 100)]
    df = spark.createDataFrame(rows, "i int, s string, t string")
    kept, texts = shelved(df, "t", "test_shelf", part_bytes=10)
    assert Counter(map(tuple, with_text(kept, texts).select("i", "s", "t").collect())) == Counter(rows)
    few = with_text(kept.filter("i = 2").withColumn("u", F.lit(1)), texts).select(KEY, "t", "u")
    assert [r.t for r in few.collect()] == ["y" * 100]
    elsewhere = spark.createDataFrame(kept.filter("i = 2").select(KEY).collect())
    plan = with_text(elsewhere, texts)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Bucketed: true" in plan
