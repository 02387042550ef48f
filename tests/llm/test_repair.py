import hashlib
import re
import zlib
from collections import Counter
from functools import cache

import pytest

from loomcraft.llm import repair
from loomcraft.llm.catalog import QUERIES

from ..conftest import SF

SPACE = " \t\n\x0b\x0c\r"
NUMBERS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def damage(rows):
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        hit = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if hit:
            text = "" if hit == 1 else re.sub("[.!?]", "", text) if hit == 2 else text
            yield from [(conv, turn, "user" if hit == 4 else role, text)] * (2 if hit == 3 else 1)


def cheapest(roles, must, late):
    """Cost, audit and repaired rows by trying every edit at every row."""
    after = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}

    @cache
    def best(i, state, put):
        ways = [(0, "", ())] if i == len(roles) and state in ("", "a") else []
        for role in "ua":
            if put < 2 and (state, role) in after:
                cost, audit, rest = best(i, after[state, role], put + 1)
                ways.append((cost + 2, "I" + audit, ((role, None), *rest)))
        if i < len(roles):
            cost, audit, rest = best(i + 1, state, 0)
            ways.append((cost + 3, "D" + audit, rest))
            for edit, role, price in (("K", roles[i], 0), ("R", "u", 2), ("R", "a", 2)):
                if not must[i] and (state, role) in after:
                    cost, audit, rest = best(i + 1, after[state, role], 0)
                    ways.append((cost + price + late[i], edit + audit, ((role if edit == "R" else "", i), *rest)))
        return min(ways, key=lambda w: w[:2]) if ways else (10**9, "", ())

    return best(0, "", 0)


def expected(rows):
    ids = {r[0] for r in rows}
    own = {i: [] for i in ids}
    for r in damage(rows):
        own[r[0]].append(r)
    out = Counter()
    for conv, said in own.items():
        said.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(f"{len(r[2])}:{r[2]}{r[3]}".encode()).hexdigest()))
        counts, seen, must, late = Counter(), set(), [], []
        for _, _, role, text in said:
            solid = text.strip(SPACE)
            fault = "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else ""
            seen.add((role, text))
            counts[fault] += 1
            must.append(fault in ("blank", "duplicate"))
            late.append(int(fault == "truncated"))
        turns = {r[1] for r in said} - {None}
        initials = [r[2][:1] for r in said]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        cost, audit, kept = cheapest(tuple(initials), tuple(must), tuple(late))
        names = {"u": "user", "a": "assistant"}
        lines = [f"{names.get(role) or said[i][2]}:{said[i][3] if i is not None else ''}" for role, i in kept]
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out[(conv, gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit,
             hashlib.sha256("\n".join(lines).encode()).hexdigest())] += 1
    return out


def found(spark, folder):
    return Counter(tuple(r) for r in QUERIES["op13_conversation_repair"](spark, folder).select(
        "conv_id", *NUMBERS, "audit", "repaired_sha256").collect())


@pytest.fixture
def query_over(spark, tmp_path):
    def run(rows, extra=True):
        schema = "conv_id long, turn long, role string, text string" + (", n long, audit string, initial string" if extra else "")
        spark.createDataFrame([(*r, 1, "x", "y") for r in rows], schema).write.parquet(f"{tmp_path}/conversations.parquet")
        return found(spark, str(tmp_path))

    return run


def test_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert found(spark, SF) == expected(rows)


def test_odd_rows(query_over):
    roles = ["user", "assistant", "system", "tool", "", None, "ur", "User"]
    texts = ["Yes.", "no", None, "", " \t", "What?", "end. \n", "long " * 30_000 + "."]
    rows = [(conv, None if (conv + i) % 11 == 0 else 3 * i - i * i // 4, roles[zlib.crc32(f"{conv}r{i}".encode()) % 8], texts[zlib.crc32(f"{conv}t{i}".encode()) % 8])
            for conv in range(60) for i in range(conv % 13)]
    rows += [(None, t, "user", "Hi.") for t in (None, None, 1, 1, 5)] + [(99, 1, "assistant", "Same.")] * 3
    assert query_over(rows) == expected(rows)


def test_no_rows(query_over):
    assert query_over([]) == Counter()


def test_long_conversation_of_one_id(query_over):
    rows = [(7, t, ("user", "assistant")[t % 2], f"Turn {t // 3}{'.' * (t % 5 > 0)}") for t in range(150)]
    assert query_over(rows) == expected(rows)


def test_repaired_rows_follow_the_grammar(spark):
    rows = spark.read.parquet(f"{SF}/conversations.parquet")
    report, fixed = repair.repair(rows)
    audits = {r.conv_id: r.audit for r in report.collect()}
    turns = {}
    for r in fixed.orderBy("conv_id", "place").collect():
        turns.setdefault(r.conv_id, []).append(r)
    for conv, audit in audits.items():
        own = turns.get(conv, [])
        assert re.fullmatch("(s?(ua)+)?", "".join(r.role[0] for r in own))
        assert "".join(r.edit for r in own) == audit.replace("D", "")


def test_nodes_are_shared():
    repair.node.cache_clear()
    strings = ["".join("suaoSUAOx"[zlib.crc32(f"{i}{j}".encode()) % 9] for j in range(i % 9)) for i in range(2_000)]
    tails = sorted({s[::-1] for s in strings})
    got = {s: (cost, audit) for s, cost, audit in repair.audits((t,) for t in tails)}
    assert len(got) == len(tails)
    assert repair.node.cache_info().currsize < len({t[:i] for t in tails for i in range(len(t))}) / 4
    for s in strings[:400]:
        roles, must, late = [c.lower() for c in s], [c == "x" for c in s], [int(c.isupper()) for c in s]
        assert got[s] == cheapest(tuple(roles), tuple(must), tuple(late))[:2]
