import base64
import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

import corpus_pipeline
from loomcraft.llm import decontaminate, lm_scores, rollups, toxicity, warc
from loomcraft.llm.catalog import QUERIES, TOKENIZER
from loomcraft.llm.tokens import Encoder
from loomcraft.session import fresh_path

from ..conftest import SF
from .conftest import ODD

# Archives


def archived(rows, least=0):
    def data(r):
        return (r.html or "").encode()

    groups = {}
    for r in rows:
        if len(data(r)) >= least:
            groups.setdefault(data(r), []).append(r.page_id)
    out = Counter()
    for r in rows:
        ids = [i for i in groups.get(data(r), []) if i is not None]
        refers = max(ids) if ids and r.page_id != max(ids) else None
        digest = base64.b32encode(hashlib.sha1(data(r)).digest()).decode()
        out[(r.page_id, len(data(r)), digest, "response" if refers is None else "revisit", refers)] += 1
    return out


def test_archives_of_the_table(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    assert Counter(map(tuple, QUERIES["op6_warc"](spark, SF).collect())) == archived(pages)


def test_archives_of_odd_pages(spark):
    rows = [(1, "u", None), (2, None, ""), (None, "u\r\nX: y", "same"), (5, "u", "same"), (5, "u", "same"), (4, "é", "same"),
            (None, "u", "lone"), (None, "u", "lone"), (9, "u", "x\r\n\r\ny"), (10, "u", "z" * 300_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("file", F.lit(1))
    for least in (0, 10):
        found = warc.round_trip(pages, least, file_bytes=1_000).collect()
        assert Counter(map(tuple, found)) == archived(pages.collect(), least)
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_records_are_frames_of_their_own_behind_the_dictionary(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    manifest = warc.write_archives(pages, fresh_path(spark, "test-warc"))
    path = manifest.first().file.removeprefix("file:")
    data = open(path, "rb").read()
    assert int.from_bytes(data[:4], "little") == warc.DICTIONARY_FRAME
    size = int.from_bytes(data[4:8], "little")
    dictionary, rest, frames = zstandard.ZstdCompressionDict(data[8:8 + size]), data[8 + size:], 0
    while rest:
        frame = zstandard.ZstdDecompressor(dict_data=dictionary).decompressobj()
        record = frame.decompress(rest)
        assert record.startswith(b"WARC/1.1\r\n") and record.endswith(b"\r\n\r\n")
        rest, frames = frame.unused_data, frames + 1
    assert frames == pages.count()


# Totals


def test_totals_follow_inserts_revisions_and_deletes(spark):
    path = fresh_path(spark, "test-rollup")
    rollup = rollups.TokenRollup(spark, path, {"words": rollups.word_count, "bpe": rollups.tokenizer_count(TOKENIZER)})
    schema = "op string, doc_id long, text string, source string, lang string, tokens long"
    batches = [
        ("a", [("insert", 1, "one two", "s", "en", 0), ("insert", 2, None, "s", "en", 0), ("insert", None, "x", None, None, 0),
               ("insert", 3, "a b c", "t", "de", 0), ("insert", 3, "a", "t", "de", 0)]),
        ("b", [("revise", 1, "one two three", "t", "en", 0), ("delete", 3, None, None, None, 0), ("delete", 99, "x", "s", "en", 0)]),
        ("c", [("insert", 3, "again here", "t", "de", 0), ("revise", 7, "new", "s", "fr", 0), ("delete", 2, "", "s", "en", 0)]),
        ("d", []),
    ]
    state = {}
    for name, rows in batches:
        changes = spark.createDataFrame(rows, schema)
        assert rollup.commit(name, changes) and not rollup.commit(name, changes)
        chosen = {}
        for op, doc, text, source, lang, _ in rows:
            n = len((text or "").split())
            chosen[doc] = max(chosen.get(doc, (False, -1)), (op == "delete", n, source, lang), key=lambda x: x[:2])
        for doc, (gone, n, *group) in chosen.items():
            state.pop(doc, None)
            if not gone:
                state[doc] = (*group, n)
        docs, tokens = Counter(), Counter()
        for source, lang, n in state.values():
            docs[source, lang] += 1
            tokens[source, lang] += n
        found = {(r.source, r.lang): (r.docs, r.tokens) for r in rollup.totals().collect() if r.version == "words"}
        assert found == {k: (docs[k], tokens[k]) for k in docs}
    # What a batch that broke off has left is not read, and is written over.
    rollup._write(rollup.totals().withColumn("batch", F.lit("e")), "deltas", rollup._part("e"))
    assert sum(r.docs for r in rollup.totals().collect()) == 2 * len(state)
    assert rollup.commit("e", spark.createDataFrame([("delete", 1, None, None, None, 0)], schema))
    assert sum(r.docs for r in rollup.totals().collect()) == 2 * len(state) - 2


def test_documents_without_an_id_are_counted(spark):
    rollup = rollups.TokenRollup(spark, fresh_path(spark, "test-rollup"), {"words": rollups.word_count})
    schema = "op string, doc_id long, text string, source string, lang string, twin int, old int"
    batch = lambda *rows: spark.createDataFrame([(op, None, *r, 0, 0) for op, *r in rows], schema)
    steps = [
        ([("delete", "a b", "s", "en")], {}),
        ([("insert", "a b", "s", "en"), ("insert", "a b", "s", "en"), ("insert", "a b", None, "en"), ("revise", None, "s", "en")],
         {("s", "en"): (3, 4), (None, "en"): (1, 2)}),
        ([("delete", "a b", "s", "en"), ("insert", "c", "s", "en"), ("delete", "never", "s", "en")], {("s", "en"): (3, 3), (None, "en"): (1, 2)}),
        ([("delete", "a b", "s", "en"), ("delete", "a b", "s", "en"), ("delete", "a b", None, "en")], {("s", "en"): (2, 1)}),
        ([("insert", "a b", "s", "en")], {("s", "en"): (3, 3)}),
    ]
    for n, (rows, want) in enumerate(steps):
        assert rollup.commit(f"b{n}", batch(*rows)) and not rollup.commit(f"b{n}", batch(*rows))
        assert {(r.source, r.lang): (r.docs, r.tokens) for r in rollup.totals().collect()} == want, n
    for op in (None, "upsert"):
        with pytest.raises(Exception, match="op must be one of"):
            rollup.commit("bad", batch((op, "x", "s", "en")))


def test_totals_of_the_table(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    own, total, known = Encoder(TOKENIZER), Counter(), Counter()
    labels = {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    for i, r in docs.items():
        text, label = r.text or "", labels.get(i)
        if label and label.toxic:
            continue
        if label and not label.quality:
            text = "\n".join(dict.fromkeys(text.split("\n")))
        total[r.source, r.lang, "word_bpe_49k"] += len(own.encode([text])[0]) // 2
        total[r.source, r.lang, "words"] += len(text.split())
        known[r.source, r.lang] += 1
    rows = QUERIES["op7_token_counts"](spark, SF).collect()
    assert {(r.source, r.lang, r.version): r.tokens for r in rows} == dict(total)
    assert {(r.source, r.lang, r.version): r.docs for r in rows} == {k: known[k[:2]] for k in total}


# Decontamination


def test_windows_of_odd_rows(make, spark):
    words = [f"w{i}" for i in range(40)]
    items = spark.createDataFrame(
        [(1, " ".join(words[:20])), (2, "Short, one!"), (3, None), (4, "..."), (10, " ".join(words[:20])), (None, "solo"), (5, "é a b c d")],
        "item_id long, text string")
    texts = [" ".join(words), "x " + " ".join(words[2:15]).upper() + "; y", " ".join(words[2:14]), "a short ONE b", "solo", "É a b c d é a b c d", *ODD]
    docs = make(texts)
    rows = {(r.doc_id, r.n_words, r.n_hit, tuple(r["items"]), r.contaminated) for r in decontaminate.report(docs, items).collect()}
    assert {(0, 40, 20, ("1", "10"), True), (1, 15, 13, ("1", "10"), True), (2, 12, 0, (), False), (3, 4, 2, ("2",), True)} <= rows
    assert (5, 10, 5, ("5",), True) in rows and (6, 0, 0, (), False) in rows
    assert len(decontaminate.report(docs, items).collect()) == len(texts)
    assert not [r for r in decontaminate.report(docs, items.limit(0)).collect() if r.contaminated]
    assert decontaminate.report(make([]), items).count() == 0
    kept = decontaminate.clean_documents(docs, items)
    assert kept.columns == docs.columns and kept.count() == len(texts) - sum(r[-1] for r in rows)


# Language-model scores


def test_scores_by_brute_force(spark, make):
    own = Encoder(TOKENIZER)
    table = spark.read.parquet(f"{SF}/documents.parquet")
    extra = make([None, "", "the", "the", (None, "the of the"), (None, "the of the"), (None, "the of the"), (2, "the")]).select("doc_id", "text").withColumn("doc_id", F.col("doc_id") + 10_000)
    docs = table.select("doc_id", "text").unionByName(extra)
    texts = [(r.doc_id, r.text or "") for r in docs.collect()]
    ids = [np.frombuffer(own.encode([t])[0], own.dtype).astype(int).tolist() for _, t in texts]
    one, two = Counter(x for d in ids for x in d), Counter(p for d in ids for p in zip(d, d[1:]))
    total = sum(one.values())
    expected = []
    for d in ids:
        own1, own2, left, sum_ = Counter(d), Counter(zip(d, d[1:])), total - len(d), 0.0
        for i, w in enumerate(d):
            alone = math.log((one[w] - own1[w]) / left) if one[w] > own1[w] else -math.log(left + 1)
            if not i:
                sum_ += alone
                continue
            pair = (d[i - 1], w)
            n = two[pair] - own2[pair]
            sum_ += math.log(n / (one[d[i - 1]] - own1[d[i - 1]])) if n else math.log(0.4) + alone
        expected.append(sum_)
    for common in (20, 500_000):
        rows = lm_scores.score(docs, TOKENIZER, common=common).collect()
        found = sorted((r.doc_id is not None, r.doc_id or 0, r.n_tokens, r.log_score) for r in rows)
        wanted = sorted((i is not None, i or 0, len(d), s) for (i, _), d, s in zip(texts, ids, expected))
        assert [x[:3] for x in found] == [x[:3] for x in wanted]
        assert np.allclose([x[3] for x in found], [x[3] for x in wanted], rtol=1e-5, atol=1e-4)
    assert lm_scores.score(make([]), TOKENIZER).count() == 0
    assert [tuple(r)[1:] for r in lm_scores.score(make(["", None]), TOKENIZER).collect()] == [(0, 0.0, None)] * 2


# Toxicity


def kernel(s, t):
    """By the definition: pairs of index sets that spell the same letters."""
    from itertools import combinations

    def weights(w):
        out = Counter()
        for at in combinations(range(len(w)), toxicity.ORDER):
            out["".join(w[i] for i in at)] += toxicity.DECAY ** (at[-1] - at[0] + 1)
        return out

    a, b = weights(s), weights(t)
    return sum(a[u] * b[u] for u in a)


def test_kernel_is_that_of_the_definition():
    words, marks = ["idiot", "idxiot", "aaaa", "ab", "moron", "x-y-z"], ["idiot", "aabaa", "xyz"]
    for w, row in zip(words, toxicity.likeness(words, marks)):
        for z, value in zip(marks, row):
            norm = math.sqrt(kernel(w, w) * kernel(z, z))
            assert value == pytest.approx(kernel(w, z) / norm if norm else 0, abs=1e-5)
    model = toxicity.Model(marks, np.array([1.0, -2.0, 0.5], np.float32), 0.25)
    assert np.allclose(model.margins(words), toxicity.likeness(words, marks) @ model.weights + 0.25, atol=1e-5)


def test_inserted_and_spaced_letters_score_high(spark, make):
    clean = [f"calm words number {i} walk along the river and the hill." for i in range(60)]
    bad = [f"calm words number {i} walk. the {('stupid', 'moron')[i % 2]} river! the hill." for i in range(40)]
    docs = make(clean + bad)
    labels = spark.createDataFrame([(i, 1, int(i >= 60)) for i in range(100)] + [(3, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, labels)
    given = ["the river and the hill", "a stu-pid thing", "m o r o n", "stuupid!", "m-o-r-o-n", "s.t.u.p.i.d!", "walk-along the well-known river"]
    tests = make([*given, *ODD])
    rows = toxicity.score(tests, model).collect()
    assert [r.predicted for r in rows[:len(given)]] == [0, 1, 1, 1, 1, 1, 0]
    assert all(0 <= r.score <= 1 for r in rows) and len(rows) == len(ODD) + len(given) and not any(r.predicted for r in rows[len(given):])
    kept = toxicity.drop_toxic(tests, labels.limit(0))
    assert kept.columns == tests.columns and kept.count() == tests.count()
    assert toxicity.score(make([]), model).count() == 0


def test_held_out_accuracy_on_the_table(spark):
    sf = SF.replace("sf0.001", "sf0.1")
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = QUERIES["op10_toxicity"](spark, sf).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    test = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    found = sum(p and y for p, y in test)
    assert found / sum(y for _, y in test) >= 0.85 and found / sum(p for p, _ in test) >= 0.75


def test_scores_by_the_definition(spark):
    """A text scores as its worst word, and a word as the kernel says."""
    marks = ["idiot", "trash", "river"]
    model = toxicity.Model(marks, np.array([2.0, 1.5, -1.0], np.float32), -0.5, 2.0, -0.25)

    def margin(w):
        norm = kernel(w, w)
        return -0.5 + sum(x * kernel(w, z) / math.sqrt(norm * kernel(z, z)) for x, z in zip((2.0, 1.5, -1.0), marks)) if norm else -0.5

    texts = {"a idiot b": ["idiot"], "the river, trashy!": ["the", "river", "trashy"], "t r a s h": ["trash"], "i.d.i.o.t": ["i.d.i.o.t", "idiot"], "": []}
    for text, words in texts.items():
        best = max([-0.5, *map(margin, words)])
        assert model.scores([text])[0] == pytest.approx(1 / (1 + math.exp(-(2 * best - 0.25))), abs=1e-5)


def test_any_span_of_a_long_word_lies_whole_in_a_window():
    word = "".join(chr(97 + i % 26) + chr(97 + i // 26) for i in range(60))
    assert all(any(word[a:a + 20] in p for p in toxicity.pieces(word)) for a in range(len(word) - 19))


# Pipeline


def test_stages_keep_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == columns and 0 < docs.count() <= before
    # The same by the operators one after the other, written down in plain Python where that is short.
    left = {r.doc_id for r in docs.collect()}
    packed = corpus_pipeline.run(spark, SF)
    assert {r.doc_id for r in packed.collect()} == left
