"""Repairing the turn structure of conversations at the least cost.

A conversation reads ``(s?(ua)+)?`` by the initials of its roles: perhaps a system row, then user and assistant in turn. Rows are
kept (free), given another role (2), deleted (3) or put in empty (2); one that is cut off costs 1 more unless deleted, and blank rows and
repeats must be deleted. The audit of a repair is its edits in order, ``K R D I``; of the cheapest the ASCII-least is taken.

A row is one symbol of role and fault, a conversation the string of its symbols. All distinct strings are read from the end into an
automaton whose nodes are shared by equal suffixes: sorted by their reverse and dealt out by range, strings that end alike follow
one another, so that a node is made once for all conversations of a task. Nodes with the same symbol before nodes that behave alike are one, too.
A node knows, for each of the four states of the grammar, the cost to go, the edits that come next and how its best audits
compare; that is worked out once per node from the node behind it. A string's audit is then read off its path.

A conversation is never held: its rows are streamed in order, once for their symbols and once to be edited. What grows with its
length is its string, a byte a row. Strings are met again by string and a salt, so one that a third of all conversations share is split.

Null roles and texts are one space. Rows are in order of turn, nulls first; of one turn in order of role and text, repeats together.
Null conversation ids are one conversation. A row is a repeat if role and text were there before. An empty table gives no rows. Other
columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import cache
from itertools import chain, islice
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import written

SPACE = " \t\n\x0b\x0c\r"
SALTS = 16
RETYPE, DELETE, INSERT, CUT_OFF = 2, 3, 2, 1
# States: nothing yet, after s, after u, after a. Where an initial leads, and what stands next if a role is chosen.
_NEXT = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}
_CHOSEN = {0: "u", 1: "u", 2: "a", 3: "u"}
_NAMES = {"u": "user", "a": "assistant"}
_LEGAL = {("s", "u"), ("u", "a"), ("a", "u")}


class Node(NamedTuple):
    """By state: cost to go beyond ``base``, order among the best audits, and the next edits with the state they lead to."""

    base: int
    costs: tuple[int, ...]
    ranks: tuple[int, ...]
    edits: tuple[tuple[str, int], ...]


def _ranked(keys: list) -> tuple[int, ...]:
    order = sorted(set(keys))
    return tuple(order.index(k) for k in keys)


END = Node(0, (0, 2 * INSERT, INSERT, 0), _ranked(["", "II", "I", ""]), (("", 0), ("II", 3), ("I", 3), ("", 3)))


@cache
def node(symbol: str, costs: tuple[int, ...], ranks: tuple[int, ...]) -> Node:
    """The node of ``symbol`` before one with these costs and ranks. Upper case is cut off, ``x`` must go."""
    role, late = symbol.lower(), CUT_OFF * symbol.isupper()
    best = []
    for q in range(4):
        ways = [(DELETE + costs[q], "D", ranks[q], q)]
        if role != "x":
            to = _NEXT[_CHOSEN[q], q]
            ways.append((RETYPE + late + costs[to], "R", ranks[to], to))
            if (to := _NEXT.get((role, q))) is not None:
                ways.append((late + costs[to], "K", ranks[to], to))
        best.append(min(ways))
    for _ in range(3):  # rows put in before this one, two at most
        for q in range(4):
            to = _NEXT[_CHOSEN[q], q]
            best[q] = min(best[q], (INSERT + best[to][0], "I" + best[to][1], *best[to][2:]))
    base = min(b[0] for b in best)
    return Node(base, tuple(b[0] - base for b in best), _ranked([b[1:3] for b in best]), tuple((b[1], b[3]) for b in best))


def audits(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Rows of reversed strings and what goes with them, in order: string, what goes with it, cost and best audit."""
    path, spent, last = [END], [0], ""
    for tail, *rest in rows:
        same = next((i for i, (a, b) in enumerate(zip(tail, last)) if a != b), min(len(tail), len(last)))
        del path[same + 1:], spent[same + 1:]
        for symbol in tail[same:]:
            path.append(node(symbol, path[-1].costs, path[-1].ranks))
            spent.append(spent[-1] + path[-1].base)
        q, edits = 0, []
        for own in reversed(path):
            edit, q = own.edits[q]
            edits.append(edit)
        last = tail
        yield tail[::-1], *rest, spent[-1] + path[-1].costs[0], "".join(edits)


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, tuple]]:
    """The rows of sorted batches, and whether each begins another value of the first column."""
    last: tuple | None = None
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            yield last is None or row[0] != last[0], row
            last = row


def _in_lots(batches: Iterator[pa.RecordBatch], work: Callable[[Iterator[tuple[bool, tuple]]], Iterator[tuple]], names: list[str],
             kinds: list[pa.DataType], size: int = 2_000) -> Iterator[pa.RecordBatch]:
    """What ``work`` makes of the rows, in batches. The first column is of the type it had, the others of ``kinds``."""
    first = next(batches, None)
    if first is None:
        return
    schema = pa.schema(list(zip(names, [first.schema.field(0).type, *kinds])))
    rows = work(_groups(chain([first], batches)))
    while lot := list(islice(rows, size)):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*lot), schema)], schema=schema)


def numbered(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` with ``role_text``, a digest, ``initial``, ``flaw`` (blank, truncated or empty) and a number ``n``
    for each row; written."""
    said = rows.select("conv_id", "turn", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")])
    both = F.sha2(F.concat(F.char_length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    initial = F.substring("role", 1, 1)
    solid = F.rtrim("text", F.lit(SPACE))
    flaw = F.when(solid == "", "blank").when(~F.right(solid, F.lit(1)).isin(".", "!", "?"), "truncated").otherwise("")
    return written(said.select(
        "*", both.alias("role_text"), F.when(initial.isin("s", "u", "a"), initial).otherwise("o").alias("initial"),
        flaw.alias("flaw"), F.monotonically_increasing_id().alias("n")), "turns")


def _in_order(rows: DataFrame, *before: str) -> DataFrame:
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", *before, "turn", "role", "role_text", "n")


def structure(turns: DataFrame) -> DataFrame:
    """Per conversation its faults and ``signature``, the string of its symbols."""
    id_type = turns.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "signature"]

    def conversations(rows: Iterator[tuple[bool, tuple]]) -> Iterator[tuple]:
        conv, signature = None, []
        for new, (own, turn, initial, fault) in rows:
            if new:
                if signature:
                    yield conv, gaps, *faults.values(), illegal, "".join(signature)
                conv, signature, gaps, illegal, last, before = own, [], 0, 0, None, None
                faults = {"blank": 0, "duplicate": 0, "truncated": 0}
            if turn is not None:
                gaps += turn - last - 1 if last is not None and turn != last else 0
                last = turn
            if fault:
                faults[fault] += 1
            illegal += before is not None and (before, initial) not in _LEGAL
            before = initial
            signature.append("x" if fault in ("blank", "duplicate") else initial.upper() if fault else initial)
        if signature:
            yield conv, gaps, *faults.values(), illegal, "".join(signature)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _in_lots(batches, conversations, names, [pa.int64()] * 5 + [pa.string()])

    light = turns.select("conv_id", "turn", "role", "role_text", "initial", "flaw", "n")
    first = light.groupBy("conv_id", "role_text").agg(F.min(F.struct("turn", "n")).alias("first")).select(
        F.col("first.n").alias("n"), F.lit(True).alias("new"))
    fault = F.when(F.col("new").isNull() & (F.col("flaw") != "blank"), "duplicate").otherwise(F.col("flaw"))
    ordered = _in_order(light.join(first, "n", "left")).select("conv_id", F.col("turn").cast("long"), "initial", fault)
    return ordered.mapInArrow(read, f"conv_id {id_type}, gaps long, blank long, duplicate long, truncated long, illegal long, signature string")


def audited(structures: DataFrame) -> DataFrame:
    """``structures`` with ``cost`` and ``audit``, each distinct signature worked out once a salt."""
    salted = structures.withColumn("salt", F.pmod(F.xxhash64("conv_id"), F.lit(SALTS)).cast("int"))
    tails = salted.select(F.reverse("signature").alias("tail"), "salt").distinct()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _in_lots(batches, lambda rows: audits(row for _, row in rows), ["signature", "salt", "cost", "audit"],
                            [pa.int32(), pa.int64(), pa.string()])

    dealt = tails.repartitionByRange("tail", "salt").sortWithinPartitions("tail", "salt")
    return salted.join(dealt.mapInArrow(work, "signature string, salt int, cost long, audit string"), ["signature", "salt"]).drop("salt")


class _Editor:
    """Goes through a conversation's audit as its rows come by; gives the rows of the repaired conversation."""

    def __init__(self, audit: str) -> None:
        self.audit, self.at, self.state = audit, 0, 0

    def inserted(self) -> Iterator[tuple[str, str, str]]:
        while self.audit[self.at:self.at + 1] == "I":
            self.at += 1
            role = _CHOSEN[self.state]
            self.state = _NEXT[role, self.state]
            yield "I", _NAMES[role], ""

    def given(self, role: str, initial: str, text: str) -> Iterator[tuple[str, str, str]]:
        yield from self.inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self.state = _NEXT[initial, self.state]
            yield edit, role, text
        elif edit == "R":
            initial = _CHOSEN[self.state]
            self.state = _NEXT[initial, self.state]
            yield edit, _NAMES[initial], text


def _with_audits(turns: DataFrame, audits_: DataFrame) -> DataFrame:
    """``conv_id, audit, role, initial, text``: each conversation's audit ahead of its rows, in order."""
    given = ["conv_id", "audit", "role", "initial", "text"]
    order = ["turn", "role_text", "n"]
    ahead = audits_.select("conv_id", "audit", F.lit(0).alias("kind"))
    rest = turns.select("conv_id", *given[2:], *order, F.lit(1).alias("kind"))
    return _in_order(ahead.unionByName(rest, allowMissingColumns=True), "kind").select(*given)


def repaired(turns: DataFrame, audits_: DataFrame) -> DataFrame:
    """The rows of the repaired conversations: ``conv_id, place`` (from 0), ``edit, role, text``."""
    id_type = turns.schema["conv_id"].dataType.simpleString()

    def edited(rows: Iterator[tuple[bool, tuple]]) -> Iterator[tuple]:
        conv, place, editor = None, 0, _Editor("")
        for new, (own, audit, role, initial, text) in rows:
            for edit in editor.inserted() if new else editor.given(role, initial, text):
                yield conv, place, *edit
                place += 1
            if new:
                conv, place, editor = own, 0, _Editor(audit)
        for edit in editor.inserted():
            yield conv, place, *edit
            place += 1

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _in_lots(batches, edited, ["conv_id", "place", "edit", "role", "text"], [pa.int64()] + [pa.string()] * 3)

    return _with_audits(turns, audits_).mapInArrow(apply, f"conv_id {id_type}, place long, edit string, role string, text string")


def digests(turns: DataFrame, audits_: DataFrame) -> DataFrame:
    """``conv_id, repaired_sha256`` of the repaired rows as ``role:text`` lines, hashed as they stream by."""
    id_type = turns.schema["conv_id"].dataType.simpleString()

    def hashed(rows: Iterator[tuple[bool, tuple]]) -> Iterator[tuple]:
        conv, editor, lines, digest = None, None, 0, hashlib.sha256()
        for new, (own, audit, role, initial, text) in rows:
            for _, name, said in editor.given(role, initial, text) if not new else editor.inserted() if editor else ():
                digest.update(("\n" * (lines > 0) + f"{name}:{said}").encode())
                lines += 1
            if new:
                if editor:
                    yield conv, digest.hexdigest()
                conv, editor, lines, digest = own, _Editor(audit), 0, hashlib.sha256()
        if editor:
            for _, name, said in editor.inserted():
                digest.update(("\n" * (lines > 0) + f"{name}:{said}").encode())
                lines += 1
            yield conv, digest.hexdigest()

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _in_lots(batches, hashed, ["conv_id", "repaired_sha256"], [pa.string()])

    return _with_audits(turns, audits_).mapInArrow(apply, f"conv_id {id_type}, repaired_sha256 string")


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The report, one row a conversation (``conv_id``, its faults, ``cost``, ``audit``, ``repaired_sha256``), and the repaired rows."""
    turns = numbered(rows)
    report = written(audited(structure(turns)), "audits").drop("signature")
    hashed = digests(turns, report).withColumnRenamed("conv_id", "_own")
    whole = report.join(hashed, F.col("conv_id").eqNullSafe(F.col("_own"))).drop("_own")
    return whole, repaired(turns, report)
