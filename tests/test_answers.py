"""Asking a client: jobs that break off, calls in flight, stopping after enough successes."""

import json
import os
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from loomcraft.operators.answers import AnswerLog
from loomcraft.operators.completion import complete
from loomcraft.plans import preference


def noting(folder, die_at=None):
    """A client that leaves a file per call; with ``die_at`` files there it ends its process."""

    def client(prompt):
        if die_at is not None and len(os.listdir(folder)) >= die_at:
            os._exit(1)
        with open(f"{folder}/{time.time_ns()}-{prompt}", "w"):
            pass
        if prompt.startswith("bad"):
            raise RuntimeError("no")
        return prompt[::-1]

    return client


def asked(folder):
    return Counter(name.split("-", 1)[1] for name in os.listdir(folder))


def test_a_job_that_broke_off_goes_on_where_it_was(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()
    log = str(tmp_path / "log")
    rows = spark.range(40).select(F.concat(F.lit("p"), (F.col("id") % 30).cast("string")).alias("prompt")).repartition(3)
    with pytest.raises(Exception):
        complete(rows, "prompt", noting(calls, die_at=17), log=log, slices=6, concurrency=1)
    known = {r.prompt_key for r in AnswerLog(spark, log).answered().collect()}
    before = asked(calls)
    assert 0 < len(known) <= 17 and max(before.values()) == 1

    answers = complete(rows, "prompt", noting(calls), log=log, slices=6, in_flight=2).collect()
    assert len(answers) == 40 and all(r.completion == r.prompt[::-1] and r.error is None for r in answers)
    counts = asked(calls)
    assert len(counts) == 30 and sum(counts.values()) == 30 + 17 - len(known)  # only the slice under way was asked twice

    complete(rows, "prompt", noting(calls), log=log).collect()
    assert asked(calls) == counts


def test_errors_are_asked_again_and_missing_prompts_never(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()
    log = str(tmp_path / "log")
    rows = spark.createDataFrame([(1, "ok"), (2, "bad"), (3, None), (4, ""), (5, "ok")], "id int, prompt string")
    for round_ in (1, 2):
        got = {r.id: (r.completion, r.error, r.attempts) for r in complete(rows, "prompt", noting(calls), attempts=1, log=log).collect()}
        assert got == {1: ("ko", None, 1), 2: (None, "no", 1), 3: (None, "no prompt", 0), 4: ("", None, 1), 5: ("ko", None, 1)}
        assert asked(calls) == {"ok": 1, "bad": round_, "": 1}
    mended = complete(rows, "prompt", lambda p: "now", log=log).collect()
    assert {r.id: r.completion for r in mended} == {1: "ko", 2: "now", 3: None, 4: "", 5: "ko"}
    assert complete(rows.limit(0), "prompt", noting(calls), log=str(tmp_path / "none")).collect() == []


def test_calls_in_flight_overlap_up_to_the_bound(spark):
    rows = spark.range(12).select(F.concat(F.lit("p"), F.col("id").cast("string")).alias("prompt")).coalesce(1)

    def client(prompt):
        start = time.time()
        time.sleep(0.3)
        return json.dumps([start, time.time()])

    for bound in (1, 4):
        spans = [json.loads(r.completion) for r in complete(rows.limit(3 * bound), "prompt", client, in_flight=bound).collect()]
        most = max(sum(s <= t < e for s, e in spans) for t, _ in spans)
        assert most == bound


CALL = {"id": "1", "type": "function", "function": {"name": "f", "arguments": '{"a": "x"}'}}
TOOL = {"type": "function", "function": {"name": "f", "parameters": {"properties": {"a": {"type": "integer"}}}}}


def test_no_more_corrections_than_the_successes_need(spark, tmp_path):
    """Of 200 failing records every second can be mended; six are wanted."""
    calls = tmp_path / "calls"
    calls.mkdir()
    record = lambda n: json.dumps({
        "messages": [{"role": "user", "content": f"go {n}."}, {"role": "assistant", "content": None, "tool_calls": [CALL]}], "tools": [TOOL]})
    rows = [(f"i{n:03}", f"s{n:03}", record(n)) for n in range(200)]
    rows.append(("i-", None, record(0)))
    records = spark.createDataFrame(rows, "id string, source string, record string").repartition(4)

    def client(request):
        prompt = json.loads(request)["prompt"]
        n = int(prompt.split("go ")[1].split(".")[0])
        with open(f"{calls}/{time.time_ns()}-{n}", "w"):
            pass
        arguments = '{"a": 2}' if n % 2 == 0 else '{"a": "x"}'
        return json.dumps({"tool_calls": [{"id": "2", "type": "function", "function": {"name": "f", "arguments": arguments}}]})

    pairs = preference.build_preferences(records, client, max_files=6).collect()
    assert sorted(r.id for r in pairs) == ["i-", "i000", "i002", "i004", "i006", "i008"]
    assert set(asked(calls)) <= {str(n) for n in range(18)}
    assert preference.build_preferences(records.limit(0), client, max_files=6).count() == 0
    assert preference.build_preferences(records.filter("id = 'i001'"), client, max_files=6).count() == 0
