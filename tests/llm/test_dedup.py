import hashlib
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from loomcraft.llm import exact_dedup, line_dedup, simhash
from loomcraft.llm.catalog import QUERIES, SQL

from ..conftest import SF
from .conftest import ODD

UP = {i: i + 32 for i in range(65, 91)}


def by_sql(db, rows, name):
    ours = Counter(map(repr, (tuple(r[c] for c in sorted(r.asDict())) for r in rows)))
    theirs = db.execute(SQL[name])
    columns = [c[0] for c in theirs.description]
    order = [columns.index(c) for c in sorted(columns)]
    assert ours == Counter(map(repr, (tuple(r[i] for i in order) for r in theirs.fetchall())))


@pytest.mark.parametrize("name", ["op1_line_dedup", "op2_exact_dedup", "op8_decontamination"])
def test_queries_agree_with_sql(spark, db, name):
    by_sql(db, QUERIES[name](spark, SF).collect(), name)


def lines_left(texts, least):
    def key(line):
        return line.strip(" \t\n\x0b\x0c\r").translate(UP)

    split = [(t or "").split("\n") for t in texts]
    held = Counter(k for ls in split for k in {key(x) for x in ls})
    return ["\n".join(x for x in ls if not key(x) or held[key(x)] < least) for ls in split]


def test_common_lines_of_odd_rows(make):
    texts = [*ODD, "x\n A \n\nÉ", "X\t\ny\n", "x\né\n\n", "z\nx", "\n", "x\nx\nonly"]
    docs = make(texts).withColumn("n_lines", F.lit("clash"))
    for least in (2, 3, 100):
        found = line_dedup.drop_common_lines(docs, least)
        assert set(found.columns) == {*docs.columns, "n_dropped"}
        rows, before = found.collect(), docs.collect()
        assert Counter((r.doc_id, r.text) for r in rows) == Counter(zip([r.doc_id for r in before], lines_left([r.text for r in before], least)))
        assert all(r.n_lines - r.n_dropped == (r.text.count("\n") + 1 if r.n_lines > r.n_dropped else 0) for r in rows)
    assert line_dedup.drop_common_lines(make([]), 2).count() == 0


def test_batches_lose_lines_of_earlier_ones_and_runs_are_merged(spark, make):
    runs = line_dedup.LineRuns(spark, fanout=2)
    seen = set()
    for k in range(5):
        texts = [f"line {k}\nline {k + 1}\nshared\n", f"line {k}\nown {k}"]
        rows = line_dedup.drop_seen_lines(runs, make(texts)).collect()
        expected = ["\n".join(x for x in t.split("\n") if not x or x not in seen) for t in texts]
        assert sorted(r.text for r in rows) == sorted(expected)
        seen |= {x for t in texts for x in t.split("\n") if x}
        assert len(runs.names()) <= 3 and sum(spark.table(n).count() for n in runs.names()) >= len(seen)
    assert {r.n for n in runs.names() for r in spark.table(n).collect()} >= {1, 2}
    assert line_dedup.LineRuns(spark).frequent(1).count() == 0


def test_runs_are_not_shuffled_to_meet_a_batch(spark, make):
    runs = line_dedup.LineRuns(spark)
    line_dedup.drop_seen_lines(runs, make(["a\nb", "a"]))
    keys = spark.range(10).selectExpr("id AS k1", "id AS k2")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = runs.unseen(keys)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan.count("Exchange hashpartitioning") == 1 and "SortMergeJoin" in plan


def equal_texts(docs):
    groups = {}
    for r in docs.collect():
        groups.setdefault(r.text or "", []).append(r.doc_id)
    out = Counter()
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = max(known) if known else None
        out.update((i, keep, len(ids), i == keep, hashlib.sha256(text.encode()).hexdigest()) for i in ids)
    return out


def weak(block):
    return F.octet_length(block).cast("long"), F.lit(0).cast("long")


@pytest.mark.parametrize("print_of", [exact_dedup.digest, weak])
@pytest.mark.parametrize("block_bytes", [1, 3, 4096])
def test_exact_groups_of_odd_rows(make, print_of, block_bytes):
    texts = [*ODD[:-1], "abcabc", "abcabd", "abcabc", "abcabcabc", "abc", "é" * 5, "é" * 5, "abcabca", "aaaa", "aaa"]
    docs = make(texts)
    rows = exact_dedup.exact_groups(docs, block_bytes=block_bytes, print_of=print_of).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in rows) == equal_texts(docs)


def test_exact_groups_of_nothing(make):
    assert exact_dedup.exact_groups(make([])).count() == 0


def print_by_words(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UP))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def linked(prints, ids, radius):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    groups = {}
    for i in range(len(prints)):
        groups.setdefault(find(i), []).append(ids[i])
    low = {k: min((x for x in v if x is not None), default=None) for k, v in groups.items()}
    return [low[find(i)] for i in range(len(prints))]


def check_near(rows, docs, **how):
    before = docs.collect()
    prints = [print_by_words(r.text, 4) for r in before]
    ids = [r.doc_id for r in before]
    expected = Counter((i, f"{p:016x}", c) for i, p, c in zip(ids, prints, linked(prints, ids, 4)))
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in rows) == expected


def test_near_groups_of_the_table(spark):
    check_near(QUERIES["op5_simhash"](spark, SF).collect(), spark.read.parquet(f"{SF}/documents.parquet"))


def test_near_groups_of_odd_rows(make):
    words = "the quick brown fox jumps over the lazy dog and runs away from a very small cat in spring".split()
    near = [" ".join(words[:k] + ["new"] + words[k:]) for k in range(len(words))]
    docs = make([*ODD[:-1], *near, " ".join(words).upper(), "x\x85y z", "one two"])
    for block in (2, 1024):
        check_near(simhash.near_groups(docs, block=block).collect(), docs)
    assert simhash.near_groups(make([])).count() == 0


def test_masks_cover_every_pair_within_the_radius():
    rng = np.random.default_rng(1)
    for radius in (1, 2, 4):
        own = simhash.masks(radius)
        assert len(own) == 2 ** (radius + 1) - 1
        for _ in range(500):
            differing = sum(1 << int(b) for b in rng.choice(64, radius, replace=False))
            assert any(m & differing == 0 for m in own)


def test_one_stays_of_each_group(make):
    texts = ["alpha beta gamma delta epsilon zeta"] * 3 + ["entirely other words stand here today again"]
    assert sorted(r.doc_id for r in simhash.one_per_group(make(texts)).collect()) == [0, 3]


def test_one_stays_of_each_group_whatever_the_ids(make):
    words = "the quick brown fox jumps over the lazy dog and runs away from a very small cat in spring".split()
    near = [" ".join(words[:k] + ["new"] + words[k:]) for k in range(len(words))]
    other, third = "entirely other words stand here today again", "a third text with nothing in common at all"
    docs = make([*ODD[:-1], *near, (7, near[0]), (7, near[0]), (7, other), (7, other), (None, other), (None, near[1]),
                 (None, third), (None, third), (None, third.upper())]).withColumn("_Number", F.lit("clash"))
    before = docs.collect()
    group = linked([print_by_words(r.text, 4) for r in before], list(range(len(before))), 4)
    members = {}
    for r, g in zip(before, group):
        members.setdefault(g, []).append(r)
    lows = Counter(min((r.doc_id for r in rows if r.doc_id is not None), default=None) for rows in members.values())
    assert None in lows and max(lows.values()) > 1
    for block in (2, 1024):
        found = simhash.one_per_group(docs, block=block)
        assert found.columns == docs.columns
        rows = found.collect()
        assert Counter(r.doc_id for r in rows) == lows
        kept = [group[before.index(r)] for r in rows]
        assert sorted(kept) == sorted(members)
    assert simhash.one_per_group(make([])).count() == 0


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)]
    found = {r.u: r.v for r in simhash.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert found == {i: 0 for i in range(1, 41)} | {i: 100 for i in range(101, 130)}


def test_simhash_joins_send_nothing_through_the_driver(make):
    def plan(df):
        return df._jdf.queryExecution().executedPlan().toString()

    docs = make([f"word{i % 7} and " * (i % 5) for i in range(40)])
    distinct = simhash.fingerprints(docs).groupBy("print").agg(F.min("_doc").alias("low"))
    for found in (simhash.links(distinct.select("print"), 4), simhash.near_groups(docs), simhash.one_per_group(docs)):
        assert "SortMergeJoin" in plan(found) and "Broadcast" not in plan(found)
