"""Token ids of whole texts, inside tasks.

The ids are those of ``Tokenizer.encode(text, add_special_tokens=False)``. Encoding invented or natural
prose spends nearly all its time on words it has met before, so the ids of a white-space-delimited
word are kept. Arrow splits the texts of a slice and finds their distinct words; only those are looked up, and the ids of
all words are gathered at once. That is exact: the pre-tokenizers meant here never join characters across white space,
and no vocabulary entry holds any. Where Python and the tokenizer could see white space differently
(U+001C to U+001F) the text goes to the tokenizer whole. Tokenizers whose normalizer or pre-tokenizer
is of another kind encode every text whole.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer, pre_tokenizers

from .stores import give_back, kept

WORDS_KEPT = 600_000
# Words of two pre-tokens, letters and then a mark; lower-casing is all that is done to them first.
_PLAIN = r"^(?P<core>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<mark>[!-&(-/:-@\[-`{-~]*)$"
_ODD = re.compile("[\x1c-\x1f]")
_GROUP = 400
# Groups or texts the tokenizer is given at a time: what it says of each is many times as large as its ids.
_AT_ONCE = 32


def _word_based(spec: dict) -> bool:
    """Whether the tokenizer collapses white space, lower-cases and splits at white space, as ``word_bpe``."""
    steps = [x["type"] for x in (spec.get("normalizer") or {}).get("normalizers", [])]
    return steps == ["NFC", "Replace", "Lowercase"] and spec["model"].get("end_of_word_suffix") == "</w>"


class Encoder:
    """Encodes texts to little-endian ids, two bytes each if the vocabulary allows it, else four."""

    def __init__(self, path: str, words_kept: int = WORDS_KEPT) -> None:
        self.whole = Tokenizer.from_file(path)
        self.dtype = "<u2" if self.whole.get_vocab_size() <= 1 << 16 else "<u4"
        self.words_kept = words_kept
        self._forget()
        with open(path, encoding="utf-8") as f:
            self.by_word = _word_based(json.load(f))
        if self.by_word:
            self.plain = Tokenizer.from_file(path)
            self.plain.normalizer = None
            self.plain.pre_tokenizer = pre_tokenizers.Sequence([
                pre_tokenizers.WhitespaceSplit(),
                pre_tokenizers.ByteLevel(add_prefix_space=False, trim_offsets=False, use_regex=False),
            ])
            self.last = np.zeros(self.whole.get_vocab_size(), bool)
            for token, i in self.whole.get_vocab().items():
                self.last[i] = token.endswith("</w>")

    def _whole(self, text: str) -> bytes:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def _forget(self) -> None:
        """Words by slot; the ids of all slots lie end to end."""
        self.known: dict[str, int] = {}
        self.marks: dict[str, int] = {}
        self.ids = np.zeros(0, self.dtype)
        self.begin, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _added(self, ids: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The slots of new ids, cut by size."""
        slots = np.arange(len(self.size), len(self.size) + len(size))
        self.begin = np.concatenate([self.begin, len(self.ids) + np.cumsum(size) - size])
        self.size = np.concatenate([self.size, size])
        self.ids = np.concatenate([self.ids, ids])
        return slots

    def _tokenized(self, tokenizer: Tokenizer, texts: list[str], at_once: int) -> list[np.ndarray]:
        """The ids of each text."""
        return [np.array(e.ids, self.dtype) for a in range(0, len(texts), at_once)
                for e in tokenizer.encode_batch_fast(texts[a:a + at_once], add_special_tokens=False)]

    def _encoded(self, texts: list[str]) -> np.ndarray:
        """The slots of some texts, each read whole."""
        found = self._tokenized(self.whole, texts, _AT_ONCE * _GROUP)
        return self._added(np.concatenate([np.zeros(0, self.dtype), *found]), np.array([len(x) for x in found], np.int64))

    def _gathered(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of slots end to end, and where each ends."""
        size = self.size[slots]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        return self.ids[np.arange(total) + np.repeat(self.begin[slots] - ends + size, size)], ends

    def _cores(self, cores: list[str]) -> np.ndarray:
        """The slots of lower-cased letters, encoded many at a time."""
        groups = [" ".join(cores[i:i + _GROUP]) for i in range(0, len(cores), _GROUP)]
        ids = np.concatenate([np.zeros(0, self.dtype), *self._tokenized(self.plain, groups, _AT_ONCE)])
        return self._added(ids, np.diff(np.flatnonzero(self.last[ids]), prepend=-1))

    def _learn(self, words: list[str]) -> np.ndarray:
        """The slots of words not met before."""
        parts = pc.extract_regex(pa.array(words, pa.large_string()), _PLAIN)
        plain = parts.is_valid().to_numpy(zero_copy_only=False)
        slots = np.zeros(len(words), np.int64)
        if plain.any():
            parts = parts.filter(plain)
            core = pc.utf8_lower(parts.field("core")).dictionary_encode()
            mark = parts.field("mark").dictionary_encode()
            cores, marks = (x.dictionary.to_numpy(zero_copy_only=False).tolist() for x in (core, mark))
            own = np.array([-1 if slot is None else slot for slot in map(self.known.get, cores)])
            new = np.flatnonzero(own < 0)
            own[new] = self._cores([cores[i] for i in new.tolist()])
            late = [m for m in marks if m not in self.marks]
            self.marks.update(zip(late, self._encoded(late).tolist()))
            after = np.array([self.marks[m] for m in marks])
            ids, ends = self._gathered(np.stack([own[core.indices.to_numpy()], after[mark.indices.to_numpy()]], axis=1).ravel())
            slots[plain] = self._added(ids, np.diff(ends[1::2], prepend=0))
        rest = np.flatnonzero(~plain)
        slots[rest] = self._encoded([words[i] for i in rest.tolist()])
        self.known.update(zip(words, slots.tolist()))
        return slots

    def encode(self, texts: Sequence[str | None]) -> list[bytes]:
        """The ids of each text; of null none."""
        if not self.by_word:
            return [self._whole(t) if t else b"" for t in texts]
        if len(self.known) > self.words_kept:
            self._forget()
        whole = {i: self._whole(t) for i, t in enumerate(texts) if t and _ODD.search(t)}
        split = pc.utf8_split_whitespace(pa.array([None if i in whole else t for i, t in enumerate(texts)], pa.large_string()))
        last = np.cumsum(pc.fill_null(pc.list_value_length(split), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        met = split.flatten().dictionary_encode()
        words = met.dictionary.to_numpy(zero_copy_only=False).tolist()
        slots = np.array([-1 if slot is None else slot for slot in map(self.known.get, words)], np.int64)
        unknown = np.flatnonzero(slots < 0)
        if len(unknown):
            slots[unknown] = self._learn([words[i] for i in unknown.tolist()])
        ids, ends = self._gathered(slots[met.indices.to_numpy()])
        data = ids.tobytes()
        cuts = (np.append(0, ends)[np.append(0, last)] * ids.itemsize).tolist()
        return [whole[i] if i in whole else data[a:b] for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]


def encoder(path: str, words_kept: int = WORDS_KEPT) -> Encoder:
    """The encoder of this Python worker: kept over tasks, with the words it has met, ``words_kept`` about."""
    own = kept(f"encoder {path}", lambda: Encoder(path))
    own.words_kept = words_kept
    return own


def in_slices(encode: Callable[[Sequence[str | None]], list[bytes]], texts: Sequence[str | None], chars: int = 4_000_000):
    """Encode in slices of bounded size: ``(position, ids)`` of each text in order. What a slice needed is given back behind it."""
    start = size = 0
    for i, text in enumerate(texts):
        size += len(text or "")
        if size >= chars or i + 1 == len(texts):
            yield from zip(range(start, i + 1), encode(texts[start:i + 1]))
            give_back()
            start, size = i + 1, 0
