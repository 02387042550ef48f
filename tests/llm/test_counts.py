import subprocess
import sys

import numpy as np
import public_tokenizers
import pyarrow as pa

from loomcraft.llm import stores, token_files, tokens
from loomcraft.llm.tokens import Encoder

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def test_documents_are_counted_many_at_a_time(monkeypatch):
    calls = []
    count = np.bincount
    monkeypatch.setattr(np, "bincount", lambda x: calls.append(len(x)) or count(x))
    docs = [np.array([i % 7, 300 - i % 5], "<u2").tobytes() for i in range(600)] + [b""]
    total = np.zeros(0, np.int64)
    for ids in (pa.array(docs[:500], pa.binary()), pa.array(docs[500:], pa.binary()).slice(0, 101), pa.array([], pa.binary())):
        total = token_files.counted(total, ids, "<u2")
    wanted = count(np.frombuffer(b"".join(docs), "<u2"))
    assert (total[:len(wanted)] == wanted).all() and total.sum() == 1200
    assert len(calls) == 3


class Counting(dict):
    asked = 0

    def get(self, *args):
        self.asked += 1
        return super().get(*args)


def test_words_are_looked_up_once_a_slice():
    own = Encoder(TOKENIZER)
    own.known = Counting()
    texts = ["the river, THE hill the  river " * 500, None, "", "the hill\x1cthe", "  the river Río 7 "] * 3
    for _ in range(2):
        own.known.asked = 0
        wanted = [own._whole(t) if t else b"" for t in texts]
        assert own.encode(texts) == wanted
        assert own.known.asked < 20
    assert own.encode([]) == [] and own.encode([None, ""]) == [b"", b""]


def test_forgotten_words_are_learnt_again():
    own = Encoder(TOKENIZER, words_kept=3)
    texts = ["one two three four five", "five! six. One,"]
    for t in texts * 2:
        assert own.encode([t]) == [own._whole(t)]
        assert len(own.known) <= 9 and len(own.size) < 30


class Noting:
    def __init__(self, tokenizer, sizes):
        self.tokenizer, self.sizes = tokenizer, sizes

    def encode_batch_fast(self, texts, **options):
        self.sizes.append(len(texts))
        return self.tokenizer.encode_batch_fast(texts, **options)


def test_the_tokenizer_gets_new_words_in_bounded_groups():
    own, sizes = Encoder(TOKENIZER), []
    letters = "abcdefghijklmnopqrstuvwxyz"
    text = " ".join(a + b + c + d for a in letters for b in letters for c in letters for d in "aeo")
    wanted = own._whole(text)
    own.plain = Noting(own.plain, sizes)
    assert own.encode([text]) == [wanted]
    assert len(sizes) > 1 and max(sizes) <= tokens._AT_ONCE


_RESTING = """
import random, re, sys
import public_tokenizers
from loomcraft.llm.stores import give_back
from loomcraft.llm.tokens import encoder, in_slices

def held():
    return sum(map(int, re.findall(r"Pss_Anon:\\s+(\\d+)", open("/proc/self/smaps_rollup").read()))) / 1024

own = encoder(public_tokenizers.path("word_bpe_49k.json"))
draw = random.Random(1)
for _ in range(2):
    texts = [" ".join("".join(draw.choices("abcdefghij", k=7)) for _ in range(250)) for _ in range(400)]
    assert len(list(in_slices(own.encode, texts))) == 400
del texts
before = held()
give_back()
print(before - held())
"""


def test_slices_give_their_memory_back():
    assert float(subprocess.run([sys.executable, "-c", _RESTING], capture_output=True, text=True, check=True).stdout) < 20


def test_what_a_worker_lets_go_of_is_given_back(monkeypatch):
    calls = []
    monkeypatch.setattr(stores, "give_back", lambda: calls.append(1))
    stores.kept("words of another stage", dict)
    stores.drop_kept()
    stores.drop_kept()
    assert calls == [1]
