import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from loomcraft.llm import suffixes
from loomcraft.llm.catalog import QUERIES

from ..conftest import SF
from .conftest import ODD

LAST = float("inf")


def expected(rows, length):
    """Every string of every document against the smallest id that holds it."""
    rows = [(LAST if i is None else i, (t or "").encode()) for i, t in rows]
    least = {}
    for i, data in rows:
        for a in range(len(data) - length + 1):
            string = data[a:a + length]
            least[string] = min(i, least.get(string, LAST))
    out = Counter()
    for i, data in rows:
        gone = bytearray(len(data))
        for a in range(len(data) - length + 1):
            if least[data[a:a + length]] < i:
                gone[a:a + length] = b"\1" * length
        spans = sum(g and not (a and gone[a - 1]) for a, g in enumerate(gone))
        kept = bytes(c for c, g in zip(data, gone) if not g)
        out[(None if i == LAST else i, len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest())] += 1
    return out


def found(rows):
    return Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in rows.collect())


def test_table(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    own = QUERIES["op12_suffix_dedup"](spark, SF).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert Counter(map(tuple, own)) == expected(rows, 50)
    assert sum(r.n_removed > 0 for r in own) > 10


@pytest.mark.parametrize("length,hot", [(50, 50_000), (50, 3), (12, 50_000), (7, 2), (1, 1), (90, 4)])
def test_odd_rows(make, length, hot):
    draw = random.Random(length)
    words = ["alpha", "bé", "gamma", "d", "\0\0", "épsilon", "\n", "aaaaaaaa", "zeta eta theta"]
    passages = [" ".join(draw.choices(words, k=draw.randint(3, 30))) for _ in range(6)]
    texts = [(draw.randint(0, 70), "".join(draw.choice(passages)[draw.randint(0, 9):] + draw.choice(words) for _ in range(draw.randint(0, 5)))) for _ in range(150)]
    texts += ODD + [(900 + i, "a" * (40 + i)) for i in range(30)] + [(2_000, "ab" * 3_000), (1_999, "ab" * 3_000), (None, passages[0] * 2)]
    docs = make(texts).repartition(5)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert found(suffixes.drop_repeats(docs, length, slice_bytes=4_000, hashes=500, items=300, hot=hot)) == expected(rows, length)


def test_no_rows(make):
    assert suffixes.drop_repeats(make([])).count() == 0
    assert found(suffixes.drop_repeats(make([None, ""]))) == expected([(0, None), (1, "")], 50)


def test_long_text_spans_chunks(make, monkeypatch):
    draw = random.Random(1)
    text = "".join(draw.choices("abcdefgh ", k=60_000))
    monkeypatch.setattr(suffixes, "_CHUNK", 1_000)
    rows = [(1, text), (2, text[500:40_000] + "é" + text[100:700]), (3, "x" + text[-30_000:])]
    assert found(suffixes.drop_repeats(make(rows), 50)) == expected(rows, 50)


def test_merge_never_compares_known_prefixes(monkeypatch):
    draw = random.Random(2)
    runs = [sorted({bytes(draw.choices(b"ab", k=draw.randint(1, 14))) for _ in range(200)}) for _ in range(5)] + [[]]
    compared = []
    agree = suffixes._agree
    monkeypatch.setattr(suffixes, "_agree", lambda x, y, n: compared.append((x[:n] == y[:n], n)) or agree(x, y, n))
    coded = []
    for run in runs:
        if not run:
            coded.append(iter(()))
            continue
        same = suffixes.common_prefixes(run)
        sizes = suffixes._planes(np.array([len(k) for k in run], "<u2"))
        coded.append(suffixes.decoded(sizes, suffixes._planes(same), b"".join(k[s:] for k, s in zip(run, same.tolist()))))
    out = list(suffixes.merged(coded))
    assert [k for k, _, _ in out] == sorted(sum(runs, []))
    for (a, _, _), (b, known, _) in zip(out, out[1:]):
        assert known == next((i for i, (p, q) in enumerate(zip(a, b)) if p != q), min(len(a), len(b)))
    assert all(same for same, _ in compared) and any(n > 3 for _, n in compared)


def test_places_say_what_items_found():
    texts = pa.array([b"a long line that is here twice, and then some more of it " * 2, None, b"x" * 120, b"", b"a long line that is here twice, and then"], pa.binary())
    own = suffixes.Slice(texts, 20)
    hashes, n = np.unique(own.hash, return_counts=True)
    items = suffixes.Items(own, np.array([3, 4, 5, 6, 1]), hashes[n > 1], n[n > 1] > 30, 4)
    place, first, count, back, later = suffixes.from_places(*items.places())
    assert len(place) and all(a < b for p in range(4) for a, b in zip(*[[k for k, q in zip(items.keys, items.parts) if q == p][i:] for i in (0, 1)]))
    for p, f, c, b, late in zip(place, first, count, back, later):
        key = own.data[f + b:f + c + 19] + b"\xff" + own.data[f:f + b][::-1]
        assert items.keys[p] == key
        doc = np.array([3, 4, 5, 6, 1])[own.documents(np.array([f]))][0]
        assert late == (doc > items.least[p])
    unscanned = suffixes.Slice(texts, 20, scanned=False)
    assert (unscanned.begins == own.begins).all() and not hasattr(unscanned, "hash")
