"""Toxicity by a support vector machine on a string-subsequence kernel.

The kernel counts the subsequences of ``ORDER`` letters that two words share, each weighed by
``DECAY`` for every letter it spans, and is scaled so that a word's with itself is 1. Letters put in, left out
or set apart change it little, endings hardly. The words it is held against are the landmarks of a Nyström
map: words of toxic training documents that clean ones have much less often, unlike one another, and the clean words
most like them. The machine is linear in the mapped kernel values (squared hinge loss, Newton steps).

It is trained on sentences of labelled documents. A toxic sentence is one of a toxic document with a word that is
toxic by the counts, later by the machine; the word that scores highest stands for the sentence, and all
words of clean sentences stand against it. A text scores as its highest word; a logistic curve fitted on
documents makes that a probability. Single letters set apart by spaces or by marks are read as one word.

The fit uses a sample bounded by ``SAMPLE_TOXIC``, ``SAMPLE_CLEAN`` documents and ``SAMPLE_SENTENCES`` sentences of each, in order of a
hash; all else covers every text, whole. Labels are learnt only from documents that aren't held out; no
score sees a label, an id, a language or a source. Null and empty texts, and texts without words, get the score of
no likeness to any landmark. Repeated and null ids are scored like others; a document labelled twice
has its highest label. Without labels of both kinds every text scores 0. Other columns are not looked at.
"""

from __future__ import annotations

import itertools
import re
import sys
import uuid
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import written
from .stores import give_back, kept

ORDER = 3
DECAY = 0.6
SAMPLE_TOXIC = 1_500
SAMPLE_CLEAN = 3_000
SAMPLE_SENTENCES = 100
LANDMARKS = 48
CLEAN_LANDMARKS = 16
ALIKE = 0.6
CLEAN_WORDS = 15_000
PENALTY = 3e-4
ROUNDS = 8
DISGUISED = 1_000
LONGEST = 24
_STEP = 4
THRESHOLD = 0.3
_WORDS_KEPT = 150_000
_SPACED = re.compile(r"(?<!\S)(?:[^\W\d_]\s+){2,}[^\W\d_](?!\S)")
_MARKED = re.compile(r"(?<![^\W\d_])(?:[^\W\d_][^\w\s]+){2,}[^\W\d_](?![^\W\d_])")
_MARK = re.compile(r"[^\w]+")
_END = re.compile(r"[.!?\n]+")


def pieces(word: str, step: int = _STEP) -> list[str]:
    """A lower-cased word without marks at its ends; of a long one, windows in which any ``LONGEST - step`` letters lie whole."""
    a, b = 0, len(word)
    while a < b and not word[a].isalnum():
        a += 1
    while b > a and not word[b - 1].isalnum():
        b -= 1
    word = word[a:b]
    if len(word) <= LONGEST:
        return [word]
    return [word[i:i + LONGEST] for i in range(0, len(word) - LONGEST + step, step)]


def words_of(text: str) -> list[str]:
    text = text.lower()
    apart = ["".join(m.group().split()) for m in _SPACED.finditer(text)]
    apart += [_MARK.sub("", m.group()) for m in _MARKED.finditer(text)]
    return text.split() + apart


def _codes(words: list[str], length: int) -> np.ndarray:
    return np.array([[ord(c) for c in w] for w in words], np.int32).reshape(len(words), length)


def _subsequences(s: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Kernel values of rows: ``s`` is words by letters, ``t`` words by others by letters (negative: no letter)."""
    shape = np.broadcast_shapes((len(s), 1), t.shape[:2])
    total = np.zeros(shape, np.float32)
    length = t.shape[2]
    before = [[np.zeros(shape, np.float32) for _ in range(length + 1)] for _ in range(ORDER - 1)]
    square = np.float32(DECAY * DECAY)
    decay = np.float32(DECAY)
    for i in range(s.shape[1]):
        letter = s[:, i, None]
        hits = [(letter == t[:, :, j]) * square for j in range(length)]
        # From the highest order down, so that each reads the lower order as it was before this letter.
        for j in range(length):
            total += hits[j] * before[ORDER - 2][j]
        for q in range(ORDER - 2, -1, -1):
            run = np.zeros(shape, np.float32)
            lower = before[q - 1] if q else None
            new = []
            for j in range(length):
                run = run * decay
                run += hits[j] * lower[j] if lower else hits[j]
                new.append(run)
            for j in range(length):
                before[q][j + 1] = before[q][j + 1] * decay + new[j]
    return total


def likeness(words: list[str], landmarks: list[str]) -> np.ndarray:
    """Scaled kernel values, words by landmarks; 0 for words of fewer letters than ``ORDER``."""
    longest = max(map(len, landmarks))
    others = np.full((1, len(landmarks), longest), -1, np.int32)
    for k, z in enumerate(landmarks):
        others[0, k, :len(z)] = [ord(c) for c in z]
    norms = np.concatenate([_subsequences(c, c[:, None, :])[:, 0] for c in (_codes([z], len(z)) for z in landmarks)])
    out = np.zeros((len(words), len(landmarks)), np.float32)
    by_length: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        if len(w) >= ORDER:
            by_length.setdefault(len(w), []).append(i)
    for n, places in by_length.items():
        for a in range(0, len(places), 2048):
            some = places[a:a + 2048]
            codes = _codes([words[i] for i in some], n)
            own = _subsequences(codes, codes[:, None, :])
            out[some] = _subsequences(codes, others) / np.sqrt(own * norms[None, :])
    return out


def _triples(length: int) -> np.ndarray:
    return np.array(list(itertools.combinations(range(length), 3)), np.int64).reshape(-1, 3)


@dataclass
class Model:
    """``weights`` and ``bias`` of the machine on kernel values; ``slope`` and ``shift`` of the curve.

    A margin is linear in the kernel values, and those in the weights of shared subsequences, so the landmarks
    are summed up in one table of subsequence weights; a word then costs a look-up for each of its subsequences."""

    landmarks: list[str] = field(default_factory=list)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))
    bias: float = 0.0
    slope: float = 0.0
    shift: float = -40.0
    name: str = field(default_factory=lambda: uuid.uuid4().hex)

    def __post_init__(self) -> None:
        self.letters = sorted({c for z in self.landmarks for c in z})
        self.base = len(self.letters) + 1
        self.table = np.zeros(self.base**ORDER, np.float64)
        place = {c: i + 1 for i, c in enumerate(self.letters)}
        for z, weight in zip(self.landmarks, self.weights):
            codes = _codes([z], len(z))
            norm = float(np.sqrt(_subsequences(codes, codes[:, None, :])[0, 0]))
            own = np.array([place[c] for c in z], np.int64)
            at = _triples(len(z))
            key = (own[at] * self.base ** np.array([2, 1, 0])).sum(axis=1)
            np.add.at(self.table, key, weight / norm * DECAY ** (at[:, 2] - at[:, 0] + 1))

    def margins(self, words: list[str]) -> np.ndarray:
        """As ``likeness(words, landmarks) @ weights + bias``."""
        out = np.full(len(words), self.bias)
        if not self.landmarks:
            return out
        letters = np.array([ord(c) for c in self.letters], np.int32)
        by_length: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            if len(w) >= ORDER:
                by_length.setdefault(len(w), []).append(i)
        for n, places in by_length.items():
            at = _triples(n)
            span = DECAY ** (at[:, 2] - at[:, 0] + 1)
            step = max(64, 400_000 // len(at))
            for a in range(0, len(places), step):
                some = places[a:a + step]
                codes = _codes([words[i] for i in some], n)
                found = np.searchsorted(letters, codes)
                own = np.where(letters[np.minimum(found, len(letters) - 1)] == codes, found + 1, 0).astype(np.int64)
                key = (own[:, at[:, 0]] * self.base + own[:, at[:, 1]]) * self.base + own[:, at[:, 2]]
                norm = np.sqrt(_subsequences(codes, codes[:, None, :])[:, 0])
                out[some] += self.table[key] @ span / norm
        return out

    def scores(self, texts: Iterable[str | None]) -> list[float]:
        """The probability of each text. Words met before are looked up in this worker's store."""
        known: dict[str, float] = kept(f"scores {self.name}", dict)
        split = [words_of(t) if t else [] for t in texts]
        if len(known) > _WORDS_KEPT:
            known.clear()
        new = list({w for ws in split for w in ws if w not in known})
        own = [pieces(w) for w in new]
        distinct = list({p for ps in own for p in ps})
        margin = dict(zip(distinct, self.margins(distinct).tolist()))
        known.update((w, max(margin[p] for p in ps)) for w, ps in zip(new, own))
        get = known.__getitem__
        best = np.array([max(map(get, ws), default=self.bias) for ws in split])
        best = np.maximum(best, self.bias)
        return (1 / (1 + np.exp(-np.clip(self.slope * best + self.shift, -40, 40)))).tolist()


def _svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = 1e-3) -> np.ndarray:
    """Newton steps on the squared hinge loss; the last column is the bias."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    ridge = np.eye(x.shape[1]) * penalty
    ridge[-1, -1] = 1e-6
    for _ in range(30):
        active = y * (x @ w) < 1
        xa, wa = x[active], weight[active]
        new = np.linalg.solve(xa.T @ (xa * wa[:, None]) / weight.sum() + ridge, xa.T @ (wa * y[active]) / weight.sum())
        if np.allclose(new, w, atol=1e-6):
            break
        w = new
    return w


def _curve(margin: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Logistic slope and shift, smoothed so that separable data stay finite."""
    x = np.stack([margin, np.ones(len(margin))], axis=1)
    target = np.where(y > 0, 1 - 1 / (2 + (y > 0).sum()), 1 / (2 + (y <= 0).sum()))
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]) + 1e-6 * np.eye(2), x.T @ (weight * (target - p)))
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def fit(toxic: list[list[list[str]]], clean: list[list[list[str]]], toxic_share: float) -> Model:
    """Train on documents as lists of sentences as lists of words."""
    in_toxic = Counter(w for d in toxic for w in {w for s in d for w in s if len(w) >= ORDER})
    in_clean = Counter(w for d in clean for w in {w for s in d for w in s if len(w) >= ORDER})
    nt, nc = len(toxic), len(clean)
    if not in_toxic or not in_clean:
        return Model()

    def lean(w: str) -> float:
        a, b = (in_toxic[w] + 0.5) / (nt + 1), (in_clean[w] + 0.5) / (nc + 1)
        return (a - b) / np.sqrt(a * (1 - a) / nt + b * (1 - b) / nc)

    def some(words: Iterable[str], count: int) -> list[str]:
        return sorted(words, key=lambda w: (zlib.crc32(w.encode()), w))[:count]

    # Words several times as common in toxic documents; the more often, the less by chance.
    leaning = {w for w, n in in_toxic.items() if n * nc > 4 * in_clean[w] * nt}
    suspects = sorted((w for w in leaning if in_toxic[w] >= 3 and lean(w) > 2.5), key=lambda w: (-lean(w), w))
    suspects = suspects or some(leaning or in_toxic, LANDMARKS)
    if not suspects:
        return Model()
    landmarks: list[str] = []
    for w in suspects[:12 * LANDMARKS]:
        if len(landmarks) < LANDMARKS and (not landmarks or likeness([w], landmarks).max() < ALIKE):
            landmarks.append(w)
    suspect = set(suspects)
    # Suspects with a mark put in or a letter doubled stand beside them, with less weight.
    plain = [w for w in suspects[:DISGUISED] if len(w) > ORDER]
    disguised = [w[:len(w) // 2] + c + w[len(w) // 2:] for w in plain for c in ("-", w[len(w) // 2])]
    often = sorted((w for w in in_clean if w not in suspect), key=lambda w: (-in_clean[w], w))
    clean_words = often[:CLEAN_WORDS] + some(often[CLEAN_WORDS:], CLEAN_WORDS)
    toxic_words = suspects[:CLEAN_WORDS] + some(leaning - set(suspects[:CLEAN_WORDS]) - set(clean_words), CLEAN_WORDS)
    place = {w: i for i, w in enumerate(toxic_words)}
    under = np.repeat([place[w] for w in plain], 2).astype(np.int64)
    hidden = [[i for i in map(place.get, s) if i is not None] for d in toxic for s in d]
    hidden = [s for s in hidden if s]
    y = np.concatenate([np.ones(len(toxic_words) + len(disguised)), -np.ones(len(clean_words))])
    standing = np.array([lean(w) for w in toxic_words])
    least = 2.5
    for stage in range(2):
        values, vectors = np.linalg.eigh(likeness(landmarks, landmarks).astype(np.float64))
        root = vectors / np.sqrt(np.maximum(values, 1e-3)) @ vectors.T
        x_toxic = likeness(toxic_words, landmarks).astype(np.float64) @ root
        x_clean = likeness(clean_words, landmarks).astype(np.float64) @ root
        x_disguised = likeness(disguised, landmarks).astype(np.float64) @ root
        # A text is as toxic as its worst word, so clean words that come near count more and more.
        hard = np.ones(len(clean_words))
        for _ in range(ROUNDS):
            stands = np.zeros(len(toxic_words))
            for s in hidden:
                best = max(s, key=standing.__getitem__)
                if standing[best] > least:
                    stands[best] += 1
            if not stands.any():
                stands[:len(suspects)] = 1
            up = np.sqrt(stands)
            up = np.concatenate([up, up[under] / 4])
            weight = np.concatenate([up / up.sum(), hard / hard.sum()])
            w = _svm(np.concatenate([x_toxic, x_disguised, x_clean]), y, weight, PENALTY)
            standing, least = x_toxic @ w[:-1] + w[-1], 0.0
            margin = x_clean @ w[:-1] + w[-1]
            hard = np.where(margin > -0.5, 4 * hard, hard)
        if stage == 0:
            for i in np.argsort(-margin, kind="stable")[:8 * CLEAN_LANDMARKS]:
                if len(landmarks) < LANDMARKS + CLEAN_LANDMARKS and likeness([clean_words[i]], landmarks).max() < 0.9:
                    landmarks.append(clean_words[i])
    model = Model(landmarks, (root @ w[:-1]).astype(np.float32), float(w[-1]))
    margin_of = dict(zip(clean_words, margin.tolist())) | dict(zip(toxic_words, standing.tolist()))
    best = np.array([max((margin_of.get(w, model.bias) for s in d for w in s), default=model.bias) for d in toxic + clean])
    kinds = np.array([1.0] * nt + [-1.0] * nc)
    weight = np.where(kinds > 0, toxic_share / nt, (1 - toxic_share) / nc) * (nt + nc)
    model.slope, model.shift = _curve(np.maximum(best, model.bias), kinds, weight)
    return model


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2


def train(docs: DataFrame, labels: DataFrame, toxic: int = SAMPLE_TOXIC, clean: int = SAMPLE_CLEAN, sentences: int = SAMPLE_SENTENCES) -> Model:
    """Fit on the labelled documents that aren't held out. The driver receives the sample only."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id")))
    known = known.groupBy(F.col("doc_id").alias("_doc")).agg(F.max("toxic").cast("int").alias("_toxic"))
    counts = {r["_toxic"]: r["n"] for r in known.groupBy("_toxic").agg(F.count("*").alias("n")).collect()}
    if not counts.get(0) or not counts.get(1):
        return Model()
    some = [known.filter(F.col("_toxic") == kind).orderBy(F.xxhash64("_doc"), "_doc").limit(n) for kind, n in ((1, toxic), (0, clean))]
    sample = written(some[0].unionByName(some[1]), "toxicity-sample")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, text, kind in zip(*(batch.column(c).to_pylist() for c in range(3))):
                found = [s for s in _END.split(text or "") if s.strip()]
                if len(found) > sentences:
                    found = sorted(found, key=lambda s: zlib.crc32(s.encode()))[:sentences]
                said = [" ".join(sorted({p for w in words_of(s) for p in pieces(w, LONGEST // 2)})) for s in found]
                rows.append({"doc": doc, "toxic": kind, "sentences": said})
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("doc", pa.int64()), ("toxic", pa.int32()), ("sentences", pa.list_(pa.string()))]))

    texts = docs.select(F.col("doc_id").alias("_doc"), F.col("text").cast("string").alias("_text"))
    chosen = texts.join(sample, "_doc").select(F.col("_doc").cast("long"), "_text", "_toxic")
    rows = chosen.mapInArrow(cut, "doc long, toxic int, sentences array<string>").toArrow().sort_by([("doc", "ascending")])
    found: dict[int, list[list[list[str]]]] = {0: [], 1: []}
    for kind, said in zip(rows.column("toxic").to_pylist(), rows.column("sentences")):
        found[kind].append([[sys.intern(w) for w in s.as_py().split()] for s in said.values])
    return fit(found[1], found[0], counts[1] / (counts[0] + counts[1]))


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD, columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The given columns of each row with ``score`` and ``predicted``."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                some = batch.slice(a, 500)
                found = np.array(model.scores(some.column("text").to_pylist()))
                kept = [some.column(c) for c in columns]
                yield pa.RecordBatch.from_arrays(
                    [*kept, pa.array(found, pa.float64()), pa.array((found >= threshold).astype(np.int32))], [*columns, "score", "predicted"])
            give_back()

    own = docs.select(*dict.fromkeys([*columns, "text"]))
    schema = own.select(*columns).schema.add("score", "double").add("predicted", "integer")
    return own.mapInArrow(of, schema)


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score below ``threshold``, as they are. Only texts go through Python."""
    model = train(docs, labels)

    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        found = pa.array([s for a in range(0, len(texts), 500) for s in model.scores(texts.slice(a, 500).to_pylist())], pa.float64())
        give_back()
        return found

    return docs.filter(scored(F.col("text").cast("string")) < threshold)
