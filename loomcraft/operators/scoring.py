"""Scoring completions by exact call matching."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import messages as M
from ..functions.jsons import canonical_value, entries, is_json, is_object, last_value, let
from .binding import bind
from .replies import with_tool_calls


def _call(text: Column) -> Column:
    """A call's JSON text as struct: ``name`` (canonical), ``arguments`` in canonical text per key."""
    pairs = entries(text)
    field = lambda key: F.to_json(last_value(pairs, F.lit(key)))
    has = lambda key: F.exists(pairs, lambda e: e["key"] == key)
    given = last_value(pairs, F.lit("arguments"))
    arguments = F.transform(F.map_entries(F.try_variant_get(given, "$", "map<string,variant>")), lambda e: F.struct(
        e["key"].alias("key"), canonical_value(e["value"]).alias("value")))
    return F.struct(
        text.alias("text"),
        F.when(has("name"), field("name")).alias("name"),
        F.coalesce(has("arguments"), F.lit(False)).alias("has_arguments"),
        arguments.alias("arguments"),
    )


def _same(expected: Column, generated: Column) -> Column:
    """Every expected argument has its value; a null one may be missing; further ones do not matter."""
    return F.coalesce(
        F.forall(expected, lambda e: F.coalesce(last_value(generated, e["key"]), F.lit("null")) == e["value"]),
        F.lit(False),
    ) & generated.isNotNull()


def expected_calls(completion: Column) -> Column:
    """Call texts of an expected completion: a list of calls or a single one."""
    listed = F.from_json(completion, "array<string>", {"allowSingleQuotes": "false"})
    return F.when(is_object(completion), F.array(completion)).when(is_json(completion), listed)


def score_completions(
    samples: DataFrame, completion: str = "completion", model_output: str = "model_output", template: str = "chatml"
) -> DataFrame:
    """Adds ``model_completion`` and ``result`` (``passed`` / ``failed``) to every sample.

    Passed means: the output has calls, and for each expected call there is one of its name, all of its
    name carry the expected arguments, and every call has a name. Where nothing is expected, nothing is
    looked at. Matching happens inside the row."""
    parsed = with_tool_calls(samples, model_output, template, out="_calls")
    ready = bind(
        parsed, _generated=F.transform("_calls", _call), _expected=F.transform(expected_calls(F.col(completion)), _call))
    generated = F.col("_generated")

    def tried(e):
        """Generated calls of this name, in order, with whether they match."""
        named = F.filter(generated, lambda g: F.coalesce(g["name"] == e["name"], F.lit(False)) & g["has_arguments"])
        return F.transform(named, lambda g: F.struct(g["text"].alias("text"), _same(e["arguments"], g["arguments"]).alias("ok")))

    def outcome(e):
        hits = F.filter(generated, lambda g: F.coalesce(g["name"] == e["name"], F.lit(False)))
        return let(tried(e), lambda t: F.struct(
            ((F.size(hits) > 0) & F.forall(hits, lambda g: g["has_arguments"]) & F.forall(t, lambda x: x["ok"])).alias("ok"),
            F.when(F.forall(t, lambda x: x["ok"]), t).otherwise(
                F.slice(t, F.lit(1), F.array_position(F.transform(t, lambda x: x["ok"]), False).cast("int"))).alias("shown"),
        ))

    judged = bind(ready, _outcome=F.transform("_expected", outcome))
    fits = F.coalesce(
        F.forall("_outcome", lambda o: o["ok"])
        & ((F.size("_expected") == 0) | F.forall(generated, lambda g: g["name"].isNotNull())), F.lit(False)
    )
    shown = M.joined(F.transform(F.flatten(F.transform("_outcome", lambda o: o["shown"])), lambda s: M.tool_call_block(s["text"])))
    return judged.withColumn(
        "model_completion", F.when(F.col("parsed"), F.coalesce(shown, F.lit(""))).otherwise(F.col("assistant_message"))
    ).withColumn(
        "result", F.when(F.col("parsed") & fits, F.lit("passed")).otherwise(F.lit("failed"))
    ).drop("_calls", "_generated", "_expected", "_outcome", "parsed", "assistant_message")


def pass_rate(scored: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Samples passed, failed and the rate (pass@1); null on no samples."""
    passed = F.col("result") == "passed"
    return scored.groupBy(*keys).agg(
        F.count_if(passed).alias("n_passed"),
        F.count_if(~passed).alias("n_failed"),
        F.avg(passed.cast("int")).alias("pass_rate"),
    )


def failed_pairs(scored: DataFrame, completion: str = "completion") -> DataFrame:
    """Preference pairs from failed samples: the expected calls against what the model said."""
    calls = F.transform(expected_calls(F.col(completion)), M.tool_call_block)
    return scored.filter(F.col("result") == "failed").select(
        "system", F.col("user").alias("question"), M.joined(calls).alias("chosen"),
        F.col("model_completion").alias("rejected"),
    )
