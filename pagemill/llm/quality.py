"""Document quality: plain counts with fixed limits, then a calibrated n-gram classifier.

The classifier is a logistic regression over hashed word and character n-grams, fitted on at most
``PER_CLASS`` labelled documents of either quality and calibrated on a part it didn't see, with
the shares of the qualities among all labels as prior.  Documents are scored in Arrow batches.

Edge cases: null and empty texts have no word and fail; without labels of both kinds nothing
is rejected by the classifier; repeated rows each get their own result; rows with a null id are
judged, but teach nothing, nor does a doc_id with labels that differ; equal labels count once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm import logit
from pagemill.llm import words as W
from pagemill.llm.exchange import groups
from pagemill.llm.store import give_back, small_batches

#: Labelled documents of either quality that the classifier is fitted on, at most.
PER_CLASS = 1200
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
#: Documents whose probability of good quality is lower are rejected.
MIN_PROBABILITY = 0.5
REPEAT_WINDOW = 8

_SYMBOLS = W.separators(b"#*$%&|<>")


def featurize(texts: list[bytes]) -> np.ndarray:
    """Word 1- and 2-grams as written, and 3-grams of code points; a text's features don't depend on its neighbours."""
    return np.concatenate([logit.shares(logit.word_counts(W.scan(texts), len(texts), (1, 2))), logit.shares(logit.char_counts(texts, (3,), points=True))], axis=1)


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    slope: float = 1.0
    offset: float = 0.0

    def probability(self, features: np.ndarray) -> np.ndarray:
        return logit.sigmoid((features @ self.weights + self.bias) * self.slope + self.offset)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = PER_CLASS) -> Model | None:
    """Fit on labelled documents; None unless both qualities are there."""
    keys = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("_y")).where("_y in (0, 1)")
    sizes = {int(r[0]): int(r[1]) for r in keys.groupBy("_y").count().collect()}
    names, x = logit.sampled(docs, keys, "_y", featurize, per_class)
    y = np.array([n == "1" for n in names], dtype=np.int64)
    if len(sizes) < 2 or not 0 < y.sum() < len(y):
        return None
    # every fourth of each class calibrates
    rank = np.empty(len(y), dtype=np.int64)
    for c in (0, 1):
        rank[y == c] = np.arange((y == c).sum())
    held = rank % 4 == 3
    if not held.any() or len({*y[held].tolist()}) < 2:
        held = np.zeros(len(y), dtype=bool)
    w, b = logit.fit(x.take(np.flatnonzero(~held)), y[~held])
    check = held if held.any() else ~held
    slope, offset = logit.calibration(x.dot(w[:, 0])[check] + b[0], y[check])
    return Model(w[:, 0], float(b[0]), slope, offset + float(np.log(sizes[1] / sizes[0])))


def measures(texts: list[bytes]) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text."""
    words = W.scan(texts)
    data = words.data
    edges = np.concatenate(([0], np.cumsum(np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + 1)))

    def per_text(flags: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate(([0], np.cumsum(flags)))[edges])

    ok = words.whole(REPEAT_WINDOW)
    at = np.flatnonzero(ok)
    covered = np.zeros(len(words) + 1, dtype=np.int32)
    if len(at):
        order, begin = groups(words.grams(REPEAT_WINDOW)[at], words.doc[at])
        sizes = np.diff(np.append(begin, len(order)))
        again = at[order[np.repeat(sizes > 1, sizes)]]
        np.add.at(covered, again, 1)
        np.add.at(covered, again + REPEAT_WINDOW, -1)
    repeated = np.concatenate(([0], np.cumsum(np.cumsum(covered[:-1]) > 0)))[words.first]
    doubles = np.zeros(len(texts), dtype=np.int64)
    for i, t in enumerate(texts):
        lines = [x for x in t.split(b"\n") if x and not x.isspace()]
        doubles[i] = len(lines) - len(set(lines))
    return {
        "n_words": np.diff(words.first), "word_chars": per_text(~W.SPACE_TABLE[data] & ((data & 0xC0) != 0x80)),
        "n_symbols": per_text(_SYMBOLS[data]), "n_dup_lines": doubles, "n_repeat_words": np.diff(repeated),
    }


def judge(docs: DataFrame, model: Model | None) -> DataFrame:
    """All columns of ``docs`` but text, and the measures, base_failed, probability and kept."""
    small_batches(docs.sparkSession)
    own = [c for c in docs.columns if c != "text"]
    fields = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name != "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = W.encoded(b.column(0))
            for i, j in logit.parts(texts):
                part = texts[i:j]
                m = measures(part)
                failed = (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > MAX_REPEAT_PERCENT * m["n_words"])
                p = model.probability(featurize(part)) if model else np.ones(len(part))
                cols = [pa.array(v.astype(np.int64)) for v in m.values()]
                cols += [pa.array(failed), pa.array(p.astype(np.float64)), pa.array(~failed & (p >= MIN_PROBABILITY))]
                yield pa.RecordBatch.from_arrays([*cols, *(b.column(k + 1).slice(i, j - i) for k in range(len(own)))], names=[*m, "base_failed", "probability", "kept", *own])
            give_back()

    schema = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, probability double, kept boolean" + fields
    return docs.select(F.col("text").cast("string").alias("text"), *(F.col(f"`{c}`") for c in own)).mapInArrow(run, schema)


def rules(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """doc_id, the measures, base_failed, probability and kept for every row of ``docs``."""
    model = train(docs, labels, per_class=per_class)
    out = judge(docs.select("doc_id", "text"), model)
    return out.select("doc_id", *(c for c in out.columns if c != "doc_id"))


def good(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """The rows of ``docs`` that the rules keep, all columns as they are."""
    small_batches(docs.sparkSession)
    model = train(docs, labels, per_class=per_class)
    names = docs.columns

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = W.encoded(b.column(names.index("text")))
            keep_rows = np.zeros(len(texts), dtype=bool)
            for i, j in logit.parts(texts):
                m = measures(texts[i:j])
                failed = (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > MAX_REPEAT_PERCENT * m["n_words"])
                keep_rows[i:j] = ~failed & ((model.probability(featurize(texts[i:j])) >= MIN_PROBABILITY) if model else True)
            yield b.filter(pa.array(keep_rows))
            give_back()

    return docs.mapInArrow(keep, docs.schema)
