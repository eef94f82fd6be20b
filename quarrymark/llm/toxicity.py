"""Toxicity behind disguised spelling: restore the text, then score it.

Restoring is noisy-channel decoding. Words that mix letters with look-alike signs or separators,
double letters, or are spelled out one letter at a time (from three on, signs behind them or not) span a
lattice of possible characters (itself, letters it may stand for, nothing); Viterbi finds the likeliest
path under a character trigram model counted over the whole corpus. Letters with marks, of full width or of
scripts that look like Latin are also read as the Latin ones, characters without width as none. White
space inside a word is a character that may stand for nothing, too: of all joins of neighbouring
words, one of three letters or fewer among them, those are read that spell a word the model weighs. The score is a logistic function of which
word and word-beginning features the restored text has, the raw text and its parts between inner
punctuation included. Runs of more than ``LONGEST`` characters are read in overlapping pieces, and
scripts without spaces at every position, so that each character of a text can change its score;
only repeats beyond the second, which restoring drops, are squeezed before. Features and weights are learned
from at most ``most_rows`` labelled documents, those with the smallest hash of doc_id. The model has
at most ``most_features`` weights, those of the features with the largest gain; every text is read
for all of them.

Defined results: null and empty texts get the score of a text without features; documents with
several labels count as toxic if any says so; of rows that repeat a labelled doc_id the greatest
text is learned from, and each is scored by its own text; without labels, or with labels of one
kind, the score is the smoothed share of toxic labels; an empty table gives no rows. A column of
the name ``into`` is replaced, other columns pass unchanged.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunks, slices
from .quality import Remembered

#: Signs and the letters they may stand for.
LOOKALIKES = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e"}
SEPARATORS = ".-_*~^'`,/"
#: Cyrillic and Greek letters and the Latin ones they look like.
SCRIPTS = str.maketrans("авекмнорстухіјѕԁһԛԝαβεικνορτυχ", "abekmhopctyxijsdhqwabeikvoptux")
SWAP_COST, REPEAT_COST, DROP_COST, KEEP_COST, CUT_COST = 1.0, 0.7, 0.7, 4.0, 1.5
LONGEST = 40
CLASSES = 32
_CODE = np.full(256, 29, np.uint8)
_CODE[[9, 10, 11, 12, 13, 32]] = 0
_CODE[97:123] = _CODE[65:91] = np.arange(1, 27)
_CODE[128:] = 27
_CODE[48:58] = 28
_MIXED = re.compile(r"[^\W\d_][0-9@$!|+(€.\-_*~^'`,/]+[^\W\d_]|^[0-9@$!|+(€]+[^\W\d_]|[^\W\d_][0-9@$|+(€]+$|([^\W\d_])\1", re.I)
_BEFORE, _BEHIND = "\"'[{<", ".,;:?!\"')]}>"
_CORE = re.compile(r"[^\W\d_](?:.*[^\W\d_])?", re.S)
_INNER = re.compile(r"[!-/:-@\[-`{-~\u2010-\u205e\u3000-\u3003\u3008-\u3011\uff01-\uff0f\uff1a-\uff20]+")
_UNSPACED = re.compile(r"[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff]")
_DOUBLED = re.compile(r"([^\W\d_])\1+", re.I)
_STRETCHED, _PARTED = re.compile(r"(.)\1{2,}", re.I | re.S), re.compile(r"[.\-_*~^'`,/]{2,}")
_UNSEEN = re.compile("[\u00ad\u034f\u200b-\u200f\u2060-\u2064\ufe00-\ufe0f\ufeff]")
#: Beyond ASCII and the marked letters of Latin scripts, and what those are without their marks.
_OTHER = re.compile("[^\x00-\x7f\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]")
_UNMARKED = {c: "".join(x for x in unicodedata.normalize("NFKD", chr(c)) if not unicodedata.combining(x)) for c in range(0xC0, 0x250)}
#: Three single letters with signs behind them.
_DOTTED = re.compile(r"(?<!\S)[^\W_][.,*_/;:~-]\s+[^\W_][.,*_/;:~-]\s+[^\W_](?:[.,*_/;:~!?-]|(?!\S))")
SHORT_PART, SHORTEST_WORD = 3, 4


def char_code(c: str) -> int:
    return 27 if ord(c) >= 128 else int(_CODE[ord(c)])


@dataclass
class CharModel:
    """Costs, -log P(c | two before), from trigram counts over character classes; class 0 is the edge of a word."""

    costs: np.ndarray

    def __post_init__(self):
        self.flat: list[float] = self.costs.ravel().tolist()  # quicker to index one by one

    @classmethod
    def from_counts(cls, counts: np.ndarray) -> CharModel:
        cube = counts.reshape(CLASSES, CLASSES, CLASSES).astype(float)
        two = cube.sum(axis=0)
        lower = (two + 0.5) / (two + 0.5).sum(axis=1, keepdims=True)
        joint = (cube + 5 * lower[None]) / (cube.sum(axis=2, keepdims=True) + 5)
        return cls(-np.log(joint))

    def restore(self, word: str, spelled: bool = False) -> str:
        """The likeliest reading of a word; of a letter run, words parted by spaces."""
        flat = self.flat
        states: dict[tuple[int, int], tuple[float, str]] = {(0, 0): (0.0, "")}
        before = ""
        for c in word.lower():
            options: list[tuple[str, float]] = []
            if c.isalpha():
                options.append((c, 0.0))
                if c == before:
                    options.append(("", REPEAT_COST))
            elif c in LOOKALIKES:
                options += [(x, SWAP_COST) for x in LOOKALIKES[c]]
                options.append(("", DROP_COST + 2) if c == before else (c, KEEP_COST))
            elif c in SEPARATORS:
                options += [("", DROP_COST), (c, KEEP_COST)]
            else:
                options.append((c, KEEP_COST))
            following: dict[tuple[int, int], tuple[float, str]] = {}
            for (a, b), (cost, text) in states.items():
                for out, extra in options:
                    ways = [(a, b, cost + extra, text)]
                    if spelled and out and text:
                        ways.append((b, 0, cost + extra + CUT_COST + flat[(a * CLASSES + b) * CLASSES], text + " "))
                    for p, q, total, so_far in ways:
                        if out:
                            r = char_code(out)
                            total, key = total + flat[(p * CLASSES + q) * CLASSES + r], (q, r)
                        else:
                            key = (p, q)
                        if key not in following or total < following[key][0]:
                            following[key] = (total, so_far + out)
            states, before = following, c
        return min(((cost + flat[(a * CLASSES + b) * CLASSES], text) for (a, b), (cost, text) in states.items()), default=(0.0, ""))[1]


def char_counts(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Trigram counts of the whole corpus: summed in each task, then over tasks; as many rows as there are trigrams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CLASSES**3, np.int64)
        for batch in slices(batches):
            for part in chunks([(t or "").encode() for t in batch.column(0).to_pylist()]):
                codes = _CODE[np.frombuffer(b"  " + b"  ".join(part) + b" ", np.uint8)].astype(np.int32)
                total += np.bincount((codes[:-2] * CLASSES + codes[1:-1]) * CLASSES + codes[2:], minlength=CLASSES**3)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], names=["gram", "n"])

    counts = np.zeros(CLASSES**3, np.int64)
    summed = docs.select(text).mapInArrow(run, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    for row in summed.collect():  # at most CLASSES ** 3 rows
        counts[row["gram"]] = row["n"]
    return counts


def word_features(word: str) -> list[int]:
    """Hashes of a plain word, from its first letter to its last, and of its beginnings."""
    if not word.isalpha():
        core = _CORE.search(word)
        if core is None:
            return []
        word = core[0]
    word = word.lower()
    size = len(word)
    if size < 3:
        return []
    if not word.isascii():
        return [zlib.crc32(x.encode()) for x in (word + "$", *(word[:n] for n in (4, 5, 6) if size >= n))]
    data = word.encode()
    found = [0]
    so_far = zlib.crc32(data[:3])
    for n in (4, 5, 6):
        if size < n:
            break
        so_far = zlib.crc32(data[n - 1 : n], so_far)
        found.append(so_far)
    found[0] = zlib.crc32(data[len(found) + 2 :] + b"$", so_far)
    return found


def squeeze(run: str) -> str:
    """Repeats of a character cut to two and of separators to one: restoring drops them anyway."""
    return _PARTED.sub(lambda m: m[0][0], _STRETCHED.sub(r"\1\1", run))


def pieces(run: str) -> list[str]:
    """The whole run in overlapping pieces; a word of up to half a piece lies whole in one of them."""
    half = LONGEST // 2
    return [run[at : at + LONGEST] for at in range(0, max(1, len(run) - half), half)]


def folded(word: str) -> str:
    """The word in Latin letters without marks, as far as its characters look like some; without unseen characters."""
    parts = unicodedata.normalize("NFKD", _UNSEEN.sub("", word)).lower().translate(SCRIPTS)
    return "".join(c for c in parts if not unicodedata.combining(c))


class Reader:
    """The features of whole texts, raw and restored; ``known`` are the words looked for across white space."""

    def __init__(self, chars: CharModel, known: tuple[str, ...] = ()):
        self.chars = chars
        self.known = None
        if known:
            self.known = ahocorasick.Automaton()
            for word in known:
                self.known.add_word(word, len(word))
            self.known.make_automaton()

    def text(self, text: str | None, word_features) -> set[int]:
        """The features of a whole text; ``word_features`` gives a word's (``word``, or what is remembered of it)."""
        words = (text or "").split()
        found = set(self.spelled(words, text or "")).union(self.spaced(words))
        return found.union(*filter(None, map(word_features, set(words))))

    def spaced(self, words: list[str]) -> list[int]:
        """Features of the known words that neighbouring words spell together, one of them short."""
        if self.known is None or len(words) < 2:
            return []
        joined = "".join(words).lower()
        ends: dict[int, int] | None = None
        found: list[int] = []
        for last, size in self.known.iter(joined):
            if ends is None:  # matches are rare: places of words only where there is one
                lengths = list(map(len, words)) if len(joined) == sum(map(len, words)) else [len(w.lower()) for w in words]
                ends = {at: k for k, at in enumerate(accumulate(lengths, initial=0))}
            first, behind = ends.get(last + 1 - size), ends.get(last + 1)
            if first is not None and behind is not None and behind > first + 1 and min(map(len, words[first:behind])) <= SHORT_PART:
                found += word_features(joined[last + 1 - size : last + 1])
        return found

    def word(self, word: str) -> list[int]:
        found = self._word(word)
        if word.isascii():
            return found
        if not _OTHER.search(word):  # the letters of Latin scripts: marks are dropped, and there is nothing else to restore
            return found + word_features(word.lower().translate(_UNMARKED))
        plain = folded(word)
        return found + self._word(plain) if plain != word and plain.isascii() else found

    def _word(self, word: str) -> list[int]:
        bare = word.lstrip(_BEFORE).rstrip(_BEHIND)
        if bare.isalpha() and len(word) <= LONGEST and not _DOUBLED.search(bare) and (bare.isascii() or not _UNSPACED.search(bare)):
            return word_features(word)  # nothing to restore
        found = self.run(word)
        parts = [p for p in _INNER.split(word) if p]
        if len(parts) > 1:
            for part in dict.fromkeys(parts):
                found += self.run(part)
        return found

    def run(self, run: str) -> list[int]:
        """Features of a run without white space, of its pieces if it is long, and of what they may stand for."""
        found = word_features(run)
        if _UNSPACED.search(run):
            return found + [zlib.crc32(run[at : at + n].lower().encode()) for at in range(len(run)) for n in (2, 3, 4) if at + n <= len(run)]
        squeezed = squeeze(run)
        if len(squeezed) > LONGEST:
            for piece in pieces(squeezed):
                found += word_features(piece)
                for part in self.chars.restore(piece, spelled=True).split():
                    found += word_features(part)
            return found
        bare = squeezed.lstrip(_BEFORE).rstrip(_BEHIND)
        if not _MIXED.search(bare):
            return found
        for form in {bare: 0, bare.lstrip("("): 0}:  # a bracket, or a look-alike of c
            for part in self.chars.restore(form).split():
                found += word_features(part)
        single = _DOUBLED.sub(r"\1", bare)
        if single != bare:
            found += word_features(single)
        return found

    def spelled(self, words: list[str], text: str = "") -> list[int]:
        """Features of runs of at least three single characters, signs behind them or not."""
        sizes = list(map(len, words))
        if _DOTTED.search(text):
            words = [w[0] if len(w) == 2 and w[0].isalnum() and not w[1].isalnum() else w for w in words]
            sizes = list(map(len, words))
        if sizes.count(1) < 3:
            return []
        singles = [n == 1 for n in sizes]
        found: list[int] = []
        run: list[str] = []
        for w, single in [*zip(words, singles, strict=True), ("", False)]:
            if single:
                run.append(w)
                continue
            if len(run) >= 3:
                for piece in pieces("".join(run)):
                    found += word_features(piece)
                    for part in self.chars.restore(piece, spelled=True).split():
                        found += word_features(part)
            run = []
        return found


@dataclass
class ToxicityModel:
    chars: CharModel
    bias: float
    weights: dict[int, float] = field(default_factory=dict)
    #: The plain words of the labelled documents whose whole-word feature is weighed, for joins across white space.
    known: tuple[str, ...] = ()


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", most_rows: int = 10_000, most_features: int = 4096, usable: Column | None = None) -> ToxicityModel:
    """The model of the labels (doc_id, label) for which ``usable`` holds; the character model reads all documents."""
    chars = CharModel.from_counts(char_counts(docs))
    known = labels.where(usable) if usable is not None else labels
    known = known.select(F.col("doc_id").cast("long").alias("label_id"), F.col(label).cast("int").alias("label")).where("label is not null and label_id is not null")
    chosen = known.groupBy("label_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("label_id"), "label_id").limit(most_rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("label_id"), "text").join(F.broadcast(chosen), "label_id")
    texts = texts.groupBy("label_id").agg(F.max("text").alias("text"), F.max("label").alias("label")).select("text", "label")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(chars)
        features = Remembered(reader.word, 50_000)
        for batch in slices(batches):
            found = []
            for t in batch.column(0).to_pylist():
                found.append(np.array(sorted(reader.text(t, features.__getitem__)), np.uint32).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), batch.column(1)], names=["features", "label"])

    rows = texts.mapInArrow(run, "features binary, label int").toPandas()
    y = (rows["label"].to_numpy() > 0).astype(float)
    n1, n0 = float(y.sum()), float((1 - y).sum())
    bias = float(np.log((n1 + 0.5) / (n0 + 0.5)))
    if not n1 or not n0:
        return ToxicityModel(chars, bias)
    per_row = [np.frombuffer(x, np.uint32) for x in rows["features"]]
    ids, inverse = np.unique(np.concatenate(per_row), return_inverse=True)
    row_of = np.repeat(np.arange(len(per_row)), [len(x) for x in per_row])
    d1 = np.bincount(inverse, y[row_of], len(ids))
    d = np.bincount(inverse, minlength=len(ids))
    d0 = d - d1
    p1, p0 = (d1 + 0.5) / (n1 + 1), (d0 + 0.5) / (n0 + 1)
    gain = np.where((p1 > 3 * p0) & (d1 >= 3), d1 * np.log(p1 / p0), 0)
    top = np.argsort(-gain, kind="stable")[:most_features]
    top = top[gain[top] > 3.0]
    place = np.full(len(ids), -1)
    place[top] = np.arange(len(top))
    keep = place[inverse] >= 0
    weights, bias = _logistic(row_of[keep], place[inverse[keep]], y, len(top), bias)
    learned = {int(ids[f]): float(w) for f, w in zip(top, weights, strict=True)}
    return ToxicityModel(chars, bias, learned, known_words(texts, learned))


def known_words(texts: DataFrame, weights: dict[int, float]) -> tuple[str, ...]:
    """The lower-case words of the learned texts whose own feature, not one of their beginnings', adds to the score."""
    good = frozenset(f for f, w in weights.items() if w > 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[str] = set()
        for batch in slices(batches):
            words = {w.lower() for t in batch.column(0).to_pylist() for w in (t or "").split() if w.isascii() and w.isalpha() and len(w) >= SHORTEST_WORD} - seen
            seen |= words
            fit = sorted(w for w in words if word_features(w)[0] in good)
            yield pa.RecordBatch.from_arrays([pa.array(fit, pa.string())], names=["word"])

    return tuple(sorted(r["word"] for r in texts.select("text").mapInArrow(run, "word string").distinct().collect()))  # one or few per weight


def _logistic(row_of: np.ndarray, columns: np.ndarray, y: np.ndarray, k: int, bias: float, steps: int = 300, rate: float = 0.05, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    x, m, v = np.zeros(k + 1), np.zeros(k + 1), np.zeros(k + 1)
    x[k] = bias
    for step in range(1, steps + 1):
        z = np.bincount(row_of, x[columns], len(y)) + x[k]
        miss = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) / len(y)
        grad = np.append(np.bincount(columns, miss[row_of], k) + decay * x[:k], miss.sum())
        m += 0.1 * (grad - m)
        v += 0.001 * (grad * grad - v)
        x -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return x[:k], float(x[k])


def score(docs: DataFrame, model: ToxicityModel, text: str = "text", into: str = "toxicity") -> DataFrame:
    """Adds the probability that a document is toxic."""

    @F.pandas_udf("double")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        reader, weights = Reader(model.chars, model.known), model.weights
        hits = Remembered(lambda w: frozenset(f for f in reader.word(w) if f in weights) or None, 500_000)
        for part in parts:
            out = np.zeros(len(part))
            for i, t in enumerate(part):
                own = reader.text(t, hits.__getitem__)
                out[i] = model.bias + sum(weights[f] for f in sorted(own) if f in weights)
            yield pd.Series(1 / (1 + np.exp(-np.clip(out, -40, 40))))

    return docs.withColumn(into, run(F.col(text)))
