"""Toxicity from a weighted lexicon, matched by Aho-Corasick on folded text.

Folding takes the compatibility form (NFKC), drops combining marks, maps A-Z, look-alikes of other
scripts and digits or signs that stand for letters to lower-case letters, and everything else but
letters to one space.  The lexicon holds
whole words and word beginnings with weights, learnt as smoothed log-odds between toxic and
other labelled documents.  Texts are counted where they are; only counts and three features a
document come to the driver.  A match that lies in an exception phrase doesn't count.  The matched
weights of a text, as a sum, its share of the text's length and its greatest, enter a logistic
scale fitted on the same sample.

Edge cases: a null or empty text scores as one without matches; without labels of both kinds
the lexicon is empty and all scores are 0; repeated rows each get their own result; rows with a
null id count as held out; a doc_id with labels that differ teaches nothing; texts are taken whole.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm import logit
from pagemill.llm import words as W
from pagemill.llm.store import crc_rest, give_back, label_sample, saved, small_batches

#: Labelled documents of either kind that lexicon and scale are learnt from, at most.
PER_CLASS = 3000
#: Entries of the lexicon, at most.
LEXICON = 4000
#: Letters of the word beginnings that may become entries.
STEMS = range(4, 8)
THRESHOLD = 0.7
#: Harmless uses of words that are insults elsewhere.
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "take out the trash", "class clown", "circus clown", "clown fish", "pathetic fallacy", "pond scum", "soap scum", "disgusting taste", "stupid mistake of mine")
#: Letters of other scripts and their Latin look-alikes.
HOMOGLYPHS = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h", "ԁ": "d", "ɡ": "g", "ո": "n", "ս": "u",
    "А": "a", "Е": "e", "О": "o", "Р": "p", "С": "c", "У": "y", "Х": "x", "І": "i", "Ј": "j", "Ѕ": "s", "К": "k", "М": "m", "Т": "t", "В": "b", "Н": "h",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ſ": "s",
}
#: Digits and signs within words and the letters they stand for.
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i"}


def _ascii_table() -> bytes:
    out = bytearray(b" " * 128) + bytearray(range(128, 256))
    for c in range(26):
        out[65 + c] = out[97 + c] = 97 + c
    for k, v in DIGITS.items():
        out[ord(k)] = ord(v)
    out[ord("\n")] = 10
    return bytes(out)


_ASCII = _ascii_table()
_OTHER = str.maketrans(HOMOGLYPHS)


def fold(text: str) -> str:
    """Folded words between single spaces, one at either end; numbers, and signs at a word's end, are no letters."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text).translate(_OTHER).lower()
        for c in set(text):
            if c > "\x7f" and not c.isalpha():
                text = text.replace(c, "" if unicodedata.combining(c) else " ")
    words = " ".join([w.rstrip("!@$.,;:") for w in text.split() if not w.isdigit()])
    return f" {' '.join(words.encode().translate(_ASCII).decode().split())} "


@dataclass
class Lexicon:
    """Weights of entries: `` word `` for a whole word, `` stem`` for words that begin so."""

    entries: dict[str, float]
    exceptions: tuple[str, ...] = EXCEPTIONS
    scale: tuple[float, ...] = field(default=(0.0, 0.0, 0.0, 0.0))

    @cached_property
    def automaton(self):
        out = ahocorasick.Automaton()
        for e, w in self.entries.items():
            out.add_word(e, (len(e), w))
        for p in self.exceptions:
            e = fold(p)
            old = out.get(e, None)
            out.add_word(e, (len(e), None if old is None else old[1], True))
        if len(out):
            out.make_automaton()
        return out

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "automaton"}

    def matches(self, folded: str) -> list[float]:
        """For each word with matches outside exceptions, its greatest weight."""
        if not len(self.automaton):
            return []
        found, free = {}, []
        for end, hit in self.automaton.iter(folded):
            if len(hit) == 3:
                free.append((end - hit[0] + 1, end))
            else:
                begin = end - hit[0] + 1
                found[begin] = max(hit[1], found.get(begin, hit[1]))
        if free:
            found = {b: w for b, w in found.items() if not any(a <= b < z for a, z in free)}
        return list(found.values())

    def features(self, text: str) -> tuple[float, float, float]:
        """Sum of the weights, sum over the root of the words, greatest weight."""
        folded = fold(text)
        got = self.matches(folded)
        total = float(sum(got))
        return np.log1p(max(0.0, total)), total / np.sqrt(max(1, folded.count(" ") - 1)), max(got, default=0.0)

    def score(self, features: np.ndarray) -> np.ndarray:
        if not self.entries:
            return np.zeros(len(features))
        return logit.sigmoid(features @ np.array(self.scale[:3]) + self.scale[3])


def _candidates(folded: str) -> set[str]:
    out = set()
    for w in set(folded.split()):
        out.add(f" {w} ")
        out.update(f" {w[:n]}" for n in STEMS if n < len(w))
    return out


def entries(odds: dict[str, float], limit: int = LEXICON) -> dict[str, float]:
    """The best entries by their odds; of nested stems the shortest as good stays."""
    left = dict(odds)
    for e in sorted(left, key=lambda e: (len(e), e)):
        stem = e.rstrip()
        if any(left.get(stem[:m], 0) >= left[e] - 0.25 for m in range(min(STEMS) + 1, len(stem) + (stem != e))):
            del left[e]
    return {e: left[e] for e in sorted(left, key=lambda e: (-left[e], e))[:limit]}


def scaled(lexicon: Lexicon, x: np.ndarray, y: np.ndarray) -> Lexicon:
    """The lexicon with the logistic scale of its features that fits the labels."""
    spread = np.maximum(x.std(axis=0), 1e-6)
    w, b = logit.fit(logit.Rows.dense(x / spread), y, decay=1e-3, steps=400)
    margin = x @ (w[:, 0] / spread) + b[0]
    slope, offset = logit.calibration(margin, y)
    return Lexicon(lexicon.entries, lexicon.exceptions, (*(float(v) for v in w[:, 0] / spread * slope), float(b[0] * slope + offset)))


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = PER_CLASS, smallest: int = 4, least: float = 1.5, exceptions: tuple[str, ...] = EXCEPTIONS) -> Lexicon:
    """Learn from at most ``per_class`` labelled documents of either kind.

    An entry's weight is its smoothed log-odds by document frequency, less two standard
    deviations; it has ``smallest`` toxic documents and the weight ``least`` at least.
    """
    keys = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("_y")).where("_y in (0, 1)")
    keys = label_sample(keys, "_y", per_class)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = saved(texts.join(F.broadcast(keys), "doc_id").select("doc_id", "_y", "text"), "labelled")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found, n = (Counter(), Counter()), [0, 0]
            for y, text in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                found[y].update(_candidates(fold(text)))
                n[y] += 1
            names = list(found[0] | found[1])
            yield pa.RecordBatch.from_arrays([pa.array([None, *names], pa.string()), *(pa.array([n[y], *(found[y][e] for e in names)], pa.int64()) for y in (1, 0))], names=["entry", "yes", "no"])
            give_back()

    counts = saved(rows.mapInArrow(count, "entry string, yes long, no long").groupBy("entry").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no")), "entries")
    total = counts.where("entry is null").first()
    if not total or not total.yes or not total.no:
        return Lexicon({}, exceptions)
    half = lambda n: F.col(n) + 0.5  # noqa: E731  half a document of doubt on either side
    weight = F.log(half("yes") / (total.yes + 1)) - F.log(half("no") / (total.no + 1))
    # chance alone gives rare entries high odds: count on a lower bound
    weight -= 2 * F.sqrt(1 / half("yes") + F.when(F.col("no") > 0, 1 / half("no")).otherwise(0))
    best = counts.where(F.col("entry").isNotNull() & (F.col("yes") >= smallest)).select("entry", weight.alias("w")).where(F.col("w") >= least).orderBy(F.desc("w"), "entry").limit(8 * LEXICON)
    lexicon = Lexicon(entries({r.entry: r.w for r in best.collect()}), exceptions)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([lexicon.features(t) for t in b.column(2).to_pylist()], dtype=np.float64).reshape(b.num_rows, 3)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(np.ascontiguousarray(c)) for c in x.T)], names=["doc_id", "y", "a", "b", "c"])
            give_back()

    found = sorted(tuple(r) for r in rows.mapInArrow(describe, "doc_id long, y int, a double, b double, c double").collect())
    return scaled(lexicon, np.array([f[2:] for f in found]), np.array([f[1] for f in found], dtype=np.int64))


def scores(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """doc_id, score, predicted and n_matches for every row."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            x = np.array([lexicon.features(t) for t in texts]).reshape(len(texts), 3)
            score = lexicon.score(x)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))], names=["doc_id", "score", "predicted"])
            give_back()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double, predicted int")


def toxicity(docs: DataFrame, labels: DataFrame, divisor: int = 3, rest: int = 1, per_class: int = PER_CLASS, exceptions: tuple[str, ...] = EXCEPTIONS) -> DataFrame:
    """doc_id, held_out, score, predicted; learnt without labels of rows whose crc32 leaves ``rest``."""
    lexicon = train(docs, labels.where(crc_rest("doc_id", divisor) != rest), per_class=per_class, exceptions=exceptions)
    return scores(docs, lexicon).select("doc_id", F.coalesce(crc_rest("doc_id", divisor) == rest, F.lit(True)).alias("held_out"), "score", "predicted")
