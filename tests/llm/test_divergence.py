import re
from collections import Counter, defaultdict

import pytest

from loomcraft.llm import divergence
from loomcraft.llm.catalog import QUERIES, SQL
from tools.compare import plain

from ..conftest import SF

SCHEMA = "doc_id long, text string, lang string, source string, n string, item string, kept long"


def expected(rows, min_docs, top):
    terms, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        found = ["".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
        terms[lang, source].update(found)
        docs[lang].update(set(found))
        groups[lang].add(source)
    out = set()
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= min_docs]
        usual = sum((terms[lang, s] for s in sources), Counter())

        def share(counts, t):
            return 1 + 10**9 * (counts[t] + 2) // (sum(counts[k] for k in kept) + 2 * len(kept))

        p = {s: {t: share(terms[lang, s], t) for t in kept} for s in sources}
        q = {t: share(usual, t) for t in kept}
        for s in sources:
            pairs = [(sum((p[s][t] - p[o][t]) ** 2 // (p[s][t] + p[o][t]) for t in kept), o) for o in sources if o != s]
            own = [((p[s][t] - q[t]) ** 2 // (p[s][t] + q[t]), t) for t in kept if terms[lang, s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", own, top)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out |= {(lang, s, part, item, value, i + 1) for i, (value, item) in enumerate(found[:most])}
    return out


@pytest.mark.parametrize("block", [200_000, 7])
def test_odd_rows(spark, block):
    rows = [(1, "One two, TWO three", "en", "a"), (1, "one Über-über", "en", "b"), (2, "two three\nfour", "en", None), (None, None, "en", "c"),
            (3, "", None, None), (4, "un deux deux", "fr", "a"), (4, "un deux deux", "fr", "a"), (5, "trois", "fr", "b"), (6, "12 3.4", "xx", "a"),
            (7, "x", "xx", "b"), (8, "one two zwei " * 200_000, "en", "long"), (9, "ÉTÉ Été éTÉ one", "en", "a")]
    rows += [(i, " ".join(f"w{'abcdefgh'[(i * k) % 8]}" for k in range(i % 7)), "en", f"s{i % 5}") for i in range(100, 160)]
    docs = spark.createDataFrame([(*r, "x", "y", 1) for r in rows], SCHEMA)
    for min_docs in (1, 2, 10):
        found = divergence.audit(docs, min_docs, 3, block).collect()
        assert len(found) == len(set(found))
        assert set(map(tuple, found)) == expected(rows, min_docs, 3)
    assert divergence.audit(docs.limit(0)).count() == 0


def test_query_against_sql(spark, db):
    found = QUERIES["op11_divergence"](spark, SF)
    have = db.execute(SQL["op11_divergence"])
    columns = [c[0] for c in have.description]
    assert Counter(map(tuple, found.select(*columns).collect())) == Counter(tuple(map(plain, r)) for r in have.fetchall())


def test_terms_of_long_texts_are_cut_between_words(monkeypatch):
    monkeypatch.setattr(divergence, "_PIECE", 8)
    text = "Alpha beta-gamma  d éé 12 zeta " * 20
    pieces = list(divergence.words(text.encode()))
    assert len(pieces) > 10
    assert [w for p in pieces for w in p] == "alpha beta gamma d éé zeta".encode().split() * 20


def test_counts_in_tasks_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(divergence, "HELD_TERMS", 50)
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(30)
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in docs.collect()]
    assert set(map(tuple, divergence.audit(docs, 2, 5).collect())) == expected(rows, 2, 5)
