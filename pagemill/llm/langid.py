"""Language identification with error-correcting output codes.

Every language gets a codeword of bits; for each bit a logistic regression over hashed byte
n-grams tells the languages whose codeword sets it from the others.  A text gets the language
whose codeword has the least sum of logistic losses over the bits' margins.  The score is that
word's share under exp(-loss); texts whose two best words are close are flagged as ambiguous.

Edge cases: a null text, or one without a letter, is ``und`` with score 0; with one learned
language all others are that language with score 1, with none everything is ``und``; repeated
rows each get their own result; rows with a null id teach nothing, nor does a doc_id with languages that differ;
a text's features don't depend on the rows around it; texts of any length are taken whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm import logit
from pagemill.llm import words as W
from pagemill.llm.store import crc_rest, give_back, small_batches

#: Documents of each language that the classifiers are fitted on, at most.
PER_LANGUAGE = 1000
#: Below this score a prediction is flagged as ambiguous.
CLEAR = 0.7
UNKNOWN = "und"
_LATIN = re.compile(rb"[A-Za-z]")


def featurize(texts: list[bytes]) -> np.ndarray:
    """Shares of byte 2- to 4-grams, A-Z lower-cased."""
    low = [t.lower() for t in texts]
    return np.concatenate([logit.shares(logit.char_counts(low, (2, 3))), logit.shares(logit.char_counts(low, (4,)))], axis=1)


def codewords(n: int, seed: int = 17) -> np.ndarray:
    """A row of 0/1 for each of n classes: all splits in two up to 5 classes, else random bits far apart."""
    if n < 2:
        return np.zeros((n, 0), dtype=np.int8)
    if n <= 5:
        columns = [c for c in product((0, 1), repeat=n) if c[0] and not all(c)]
        return np.array(columns, dtype=np.int8).T.copy()
    rng, length, best = np.random.default_rng(seed), 15 * int(np.ceil(np.log2(n))), None
    for _ in range(40):
        code = rng.integers(0, 2, size=(n, length), dtype=np.int8)
        code[0, code.sum(axis=0) == 0] ^= 1
        code[0, code.sum(axis=0) == n] ^= 1
        apart = min(int((code[i] != code[j]).sum()) for i in range(n) for j in range(i))
        if best is None or apart > best[0]:
            best = (apart, code)
    return best[1]


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    slope: float

    def shares(self, features: np.ndarray) -> np.ndarray:
        """Of each text: exp(-loss) of each language's codeword, scaled to the sum 1."""
        if not self.code.shape[1]:
            return np.ones((len(features), len(self.languages)))
        margin = (features @ self.weights + self.bias) * self.slope
        sign = 2.0 * self.code - 1
        loss = np.logaddexp(0, -margin[:, None, :] * sign[None]).sum(axis=2)
        e = np.exp(loss.min(axis=1, keepdims=True) - loss)
        return e / e.sum(axis=1, keepdims=True)


def train(docs: DataFrame, per_language: int = PER_LANGUAGE, label: str = "lang") -> Model:
    """Fit on rows with a label; at most ``per_language`` of each."""
    keys = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("string").alias("_lang")).where("_lang is not null")
    names, x = logit.sampled(docs.select("doc_id", "text").where("text is not null"), keys, "_lang", featurize, per_language)
    languages = sorted(set(names))
    code = codewords(len(languages))
    own = np.array([languages.index(n) for n in names], dtype=np.int64)
    if not code.shape[1]:
        return Model(languages, code, np.zeros((x.width, 0)), np.zeros(0), 1.0)
    w, b = logit.fit(x, code[own])
    margin, y = (x.dot(w) + b).ravel(), code[own].ravel()
    return Model(languages, code, w, b, logit.calibration(margin, y)[0])


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score, ambiguous for every row."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, found = W.encoded(b.column(1)), []
            for i, j in logit.parts(texts):
                part = texts[i:j]
                lettered = np.array([bool(_LATIN.search(t)) or any(map(str.isalpha, t.decode())) for t in part])
                if not model.languages:
                    found += [(UNKNOWN, 0.0, True)] * len(part)
                    continue
                share = model.shares(featurize(part))
                best = share.argmax(axis=1)
                found += [(model.languages[k], float(s[k]), bool(s[k] < CLEAR)) if ok else (UNKNOWN, 0.0, True) for k, s, ok in zip(best, share, lettered, strict=True)]
            cols = list(zip(*found, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cols[0], pa.string()), pa.array(cols[1], pa.float64()), pa.array(cols[2], pa.bool_())], names=["doc_id", "lang_pred", "score", "ambiguous"])
            give_back()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double, ambiguous boolean")


def identify(docs: DataFrame, divisor: int = 4, rest: int = 2, per_language: int = PER_LANGUAGE) -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous; learnt without the rows whose crc32 leaves ``rest``."""
    model = train(docs.where(crc_rest("doc_id", divisor) != rest), per_language)
    out = predict(docs, model)
    return out.select("doc_id", F.coalesce(crc_rest("doc_id", divisor) == rest, F.lit(True)).alias("held_out"), "lang_pred", "score", "ambiguous")
