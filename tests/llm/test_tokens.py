import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from loomcraft.llm import bestfit, token_files
from loomcraft.llm.catalog import QUERIES, TOKENIZER
from loomcraft.llm.tokens import Encoder, in_slices

from ..conftest import SF
from .conftest import ODD

PLAIN = Tokenizer.from_file(TOKENIZER)
OWN = Encoder(TOKENIZER, words_kept=50)


def ids_of(text):
    return np.array(PLAIN.encode(text or "", add_special_tokens=False).ids + [1], "<u4")


@given(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from(" \n\t\x1c\x85.,'’*aAéÉßİΣσs<|endoftext|>")), max_size=60))
@settings(max_examples=400, deadline=None)
def test_words_encode_like_whole_texts(text):
    assert np.frombuffer(OWN.encode([text])[0], OWN.dtype).tolist() == PLAIN.encode(text, add_special_tokens=False).ids


def test_other_tokenizers_encode_whole_texts():
    path = public_tokenizers.path("byte_bpe_50k.json")
    own, plain = Encoder(path), Tokenizer.from_file(path)
    for text in ("The cat\n sat.", " x  y", ""):
        assert np.frombuffer(own.encode([text])[0], own.dtype).tolist() == plain.encode(text, add_special_tokens=False).ids


def test_slices_keep_order():
    texts = ["a b", None, "c " * 50, "", "d"]
    assert [i for i, _ in in_slices(OWN.encode, texts, chars=3)] == list(range(5))


@given(st.lists(st.integers(0, 2**32 - 1), max_size=40))
def test_ranks_round_trip(ranks):
    ranks = np.array(ranks, "<u4")
    control, data = token_files.pack_ranks(ranks)
    assert len(control) == -(-len(ranks) // 4)
    assert token_files.unpack_ranks(control, data, len(ranks)).tolist() == ranks.tolist()


def check_files(rows, texts):
    start, expected = 0, []
    key = lambda x: (x[0] is not None, x[0] or 0, ids_of(x[1]).astype("<u2").tobytes())
    for doc, text in sorted(texts, key=key):
        ids = ids_of(text)
        expected.append((doc, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(map(tuple, rows), key=lambda r: r[1]) == expected


def test_token_files_of_the_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = QUERIES["op4_token_files"](spark, SF).collect()
    check_files(rows, [(r.doc_id, r.text) for r in docs.collect()])


def test_token_files_of_odd_rows_in_small_files(make):
    docs = make(ODD)
    rows = token_files.round_trip(docs, TOKENIZER, 1, file_ids=5).collect()
    check_files(rows, [(r.doc_id, r.text) for r in docs.collect()])
    assert token_files.round_trip(make([]), TOKENIZER, 1).count() == 0


def check_packing(rows, texts, capacity):
    expected = Counter()
    for doc, text in texts:
        ids = ids_of(text)
        expected.update((doc, p, a, len(ids[a:a + capacity]), zlib.crc32(ids[a:a + capacity].tobytes()))
                        for p, a in enumerate(range(0, len(ids), capacity)))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == expected
    windows = {}
    for r in rows:
        windows.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in windows.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= capacity
    return len(windows)


def test_packing_the_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    rows = QUERIES["op3_bestfit_packing"](spark, SF).collect()
    used = check_packing(rows, [(r.doc_id, r.text) for r in docs], 4096)
    assert used == -(-sum(r.length for r in rows) // 4096)


def test_packing_odd_rows(make):
    docs = make(ODD)
    check_packing(bestfit.pack(docs, TOKENIZER, 1, 64).collect(), [(r.doc_id, r.text) for r in docs.collect()], 64)
    assert bestfit.pack(make([]), TOKENIZER).count() == 0


def test_ranks_are_gapless_over_shards(spark):
    rows = spark.range(500).selectExpr("id % 90 AS doc_id", "0 AS piece", "0L AS start", "id % 3 AS length", "0L AS ids_crc32")
    found = bestfit.ranked(rows, shard_rows=20).collect()
    for n in range(3):
        own = sorted(r["rank"] for r in found if r.length == n)
        assert own == list(range(len(own)))


counts = st.dictionaries(st.integers(1, 30), st.integers(1, 6), max_size=12)


@given(counts)
@settings(max_examples=200, deadline=None)
def test_plans_hold_all_pieces_and_search_is_no_worse(pieces):
    greedy, plan = bestfit.best_fit(pieces, 30), bestfit.bin_completion(pieces, 30)
    for p in (greedy, plan):
        held = Counter()
        for k, filling in p:
            assert k > 0 and sum(n * c for n, c in filling) <= 30
            held.update({n: k * c for n, c in filling})
        assert held == Counter(pieces)
    assert bestfit.lower_bound(pieces, 30) <= bestfit.windows(plan) <= bestfit.windows(greedy)


def test_search_beats_best_fit():
    pieces = {6: 2, 5: 2, 4: 3, 3: 1, 2: 1}  # 15 + 15 + ...: best fit wastes a window of 12
    hard = {n: 400 for n in range(1100, 1600, 7)}
    for own, capacity in ((pieces, 12), (hard, 4096)):
        assert bestfit.windows(bestfit.bin_completion(own, capacity)) <= bestfit.windows(bestfit.best_fit(own, capacity))
    assert bestfit.windows(bestfit.bin_completion(hard, 4096)) < bestfit.windows(bestfit.best_fit(hard, 4096))


def test_too_long_pieces_are_refused():
    with pytest.raises(ValueError):
        bestfit.bin_completion({31: 1}, 30)
