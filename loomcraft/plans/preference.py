"""Preference pairs: correcting failed calls, exporting the pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, functions as F

from ..functions import messages as M
from ..functions.jsons import array_text, quoted
from ..functions.tools import call_results, record_verdicts
from ..operators.binding import bind
from ..operators.completion import ATTEMPTS, Client, complete
from ..operators.conversations import parse_records
from ..operators.prompts import correction_prompt
from ..operators.replies import with_fenced_calls, with_fenced_tools
from ..operators.selection import first_rows, not_done, with_side_sets
from ..session import written

_CALLS = "array<struct<id:string,type:string,function:struct<name:string,arguments:string>>>"


def _all_accepted(verdicts: Column) -> Column:
    return F.coalesce(F.forall(verdicts, lambda v: v["status"] == "accepted"), F.lit(False))


def failing_calls(conversations: DataFrame) -> DataFrame:
    """The conversations (``conv_id, user, tools, tool_calls``) with a call that fails, with the ``verdicts`` of their calls."""
    judged = bind(conversations, verdicts=record_verdicts("tool_calls", "tools"))
    return judged.filter(~_all_accepted(F.col("verdicts"))).select("conv_id", "user", "tools", "tool_calls", "verdicts")


def correct_calls(
    conversations: DataFrame, client: Client, rounds: int = ATTEMPTS, concurrency: int | None = None,
    in_flight: int = 1, log: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Validate the calls of each conversation (``conv_id, user, tools, tool_calls``) and have failing ones
    made again, in at most ``rounds`` rounds over the shrinking failing set.

    ``client`` gets ``{"prompt": …, "tools": […]}`` and answers with a message holding ``tool_calls``. The prompt shows
    every call with its verdict and the signature it was held against. Returns ``rejected`` (the first calls of conversations that failed) and ``accepted`` (the first
    correction that passes), both by ``conv_id``. The driver sees only whether a round is empty."""
    return _corrected(written(failing_calls(conversations), "failing"), client, rounds, concurrency, in_flight, log)


def _corrected(
    failing: DataFrame, client: Client, rounds: int, concurrency: int | None, in_flight: int, log: str | None
) -> tuple[DataFrame, DataFrame]:
    rejected = failing.select("conv_id", "user", "tools", F.col("tool_calls").alias("rejected_calls"))
    accepted = None
    for number in range(1, rounds + 1):
        shown = correction_prompt("user", call_results("tool_calls", "tools", "verdicts"))
        request = F.concat(
            F.lit('{"prompt":'), quoted(shown),
            F.lit(',"tools":'), array_text(F.col("tools")), F.lit("}"))
        answered = complete(
            failing.withColumn("prompt", request), "prompt", client, concurrency=concurrency, name="corrections",
            in_flight=in_flight, log=log)
        calls = F.from_json(F.get_json_object("completion", "$.tool_calls"), _CALLS)
        judged = bind(bind(answered, new_calls=calls), new_verdicts=record_verdicts("new_calls", "tools"))
        judged = written(judged.drop("prompt", "completion", "error", "attempts"), "judged")
        passing = _all_accepted(F.col("new_verdicts"))
        fixed = judged.filter(passing & (F.size("new_calls") > 0)).select(
            "conv_id", F.col("new_calls").alias("accepted_calls"), F.lit(number).alias("round"))
        accepted = fixed if accepted is None else accepted.unionByName(fixed)
        failing = judged.filter(~passing).select(
            "conv_id", "user", "tools", F.coalesce("new_calls", "tool_calls").alias("tool_calls"),
            F.coalesce("new_verdicts", "verdicts").alias("verdicts"))
        if number < rounds and failing.isEmpty():
            break
    return rejected, accepted


def _constant(value) -> Column:
    """A value read from a table as a Column again; rows become structs."""
    if isinstance(value, Row):
        return F.struct(*[_constant(v).alias(k) for k, v in value.asDict().items()])
    return F.lit(value)


def first_pairs(
    conversations: DataFrame, client: Client, n: int, rounds: int = ATTEMPTS, concurrency: int | None = None,
    in_flight: int = 1, log: str | None = None,
) -> DataFrame:
    """The first ``n`` preference pairs in the order of ``conv_id`` (nulls first), without asking for many more.

    Failing conversations are corrected in slices along the order. The first slice has ``n`` of them; each further one as
    many as the share of successes so far makes likely to be enough, at most twice what has been asked for. Rows of one ``conv_id``
    share a slice. The driver learns the last ``conv_id`` of a slice and how many pairs came of it."""
    rank = F.struct(F.col("conv_id").isNotNull().alias("named"), "conv_id")
    judged = written(failing_calls(conversations).withColumn("_rank", rank), "failing")  # sorting reads its input twice
    rest = failing = written(judged.orderBy("_rank"), "failing-in-order")
    found, asked, wanted, pairs = 0, 0, n, None
    while found < n:
        last = rest.select("_rank").orderBy("_rank").limit(wanted).agg(F.max("_rank")).first()[0]
        if last is None:
            break
        last = _constant(last).cast(failing.schema["_rank"].dataType)
        part = written(rest.filter(F.col("_rank") <= last).drop("_rank"), "slice")
        rest = failing.filter(F.col("_rank") > last)
        made = written(paired(*_corrected(part, client, rounds, concurrency, in_flight, log)), "pairs")
        pairs = made if pairs is None else pairs.unionByName(made)
        found, asked = found + made.count(), asked + part.count()
        wanted = min(2 * asked, -(-(n - found) * asked // found) if found else 2 * asked)
    if pairs is None:
        pairs = paired(*_corrected(failing.limit(0).drop("_rank"), client, 1, None, 1, None))
    return first_rows(pairs, n, ["id"])


def _fenced(calls: str) -> Column:
    return M.joined(F.transform(calls, lambda c: M.fenced_call_block(
        M.call_json(c["function"]["name"], c["function"]["arguments"]))))


def paired(rejected: DataFrame, accepted: DataFrame) -> DataFrame:
    """Pairs of conversations that have both sides: ``id, system, user, chosen, rejected``."""
    both = rejected.join(accepted, "conv_id")
    return both.select(
        F.col("conv_id").alias("id"), M.fenced_tools(array_text(F.col("tools"))).alias("system"), "user",
        _fenced("accepted_calls").alias("chosen"), _fenced("rejected_calls").alias("rejected"),
    )


def build_preferences(
    records: DataFrame, client: Client, done: DataFrame | None = None, max_files: int | None = None,
    concurrency: int | None = None, in_flight: int = 1, log: str | None = None,
) -> DataFrame:
    """Preference pairs from a result tree scan (``id, source, record``); with ``max_files`` the first that many in source
    order, of which no more corrections are asked for than they need (``first_pairs``)."""
    if done is not None:
        records = not_done(records, done, ["id"])
    parsed = parse_records(records)
    calling = F.filter("messages", lambda m: (m["role"] == "assistant") & (F.coalesce(F.size(m["tool_calls"]), F.lit(0)) > 0))
    read = bind(
        parsed, user=M.last_content(M.with_role("messages", "user")), tool_calls=F.try_element_at(calling, F.lit(-1))["tool_calls"])
    conversations = read.select(F.struct("source", "id").alias("conv_id"), "user", "tools", "tool_calls").filter(
        F.col("tool_calls").isNotNull())
    asking = {"concurrency": concurrency, "in_flight": in_flight, "log": log}
    if max_files is None:
        pairs = paired(*correct_calls(conversations, client, **asking))
    else:
        pairs = first_pairs(conversations, client, max_files, **asking)
    return pairs.select(F.col("id.id").alias("id"), F.col("id.source").alias("source"), "system", "user", "chosen", "rejected")


def export_preferences(pairs: DataFrame, *side_sets: DataFrame | None) -> DataFrame:
    """Saved pairs as ``system, question, chosen, rejected`` with ``<tool_call>`` blocks, plus side sets.

    Texts without a readable fenced call stay as they are. Older key names (``human``, ``accepted``)
    are understood."""
    for new, old in (("user", "human"), ("chosen", "accepted")):
        if new not in pairs.columns and old in pairs.columns:
            pairs = pairs.withColumnRenamed(old, new)
    read = with_fenced_tools(pairs, "system", "_listed")
    for side in ("chosen", "rejected"):
        read = with_fenced_calls(read, side, f"_{side}")
    blocks = lambda side: F.when(
        F.size(f"_{side}") > 0, M.joined(F.transform(f"_{side}", M.tool_call_block))).otherwise(F.col(side))
    exported = read.select(
        M.preference_system(F.coalesce("_listed", F.lit("None"))).alias("system"), F.col("user").alias("question"),
        blocks("chosen").alias("chosen"), blocks("rejected").alias("rejected"),
    )
    return with_side_sets(exported, *side_sets)
