"""Hashed n-gram features and regularised logistic regression, fitted on bounded samples."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm import words as W
from pagemill.llm.store import give_back, label_sample

#: Buckets of each family of n-grams.
BUCKETS = 4096
#: Texts whose features are made at once.
AT_ONCE = 128
#: Sampled documents whose features the driver holds, at most, over all labels.
MOST_ROWS = 4000
_SHIFT = np.uint64(64 - 12)

#: Features of many texts: a row for each text.
Featurizer = Callable[[list[bytes]], np.ndarray]


def _counts(doc: np.ndarray, bucket: np.ndarray, docs: int) -> np.ndarray:
    return np.bincount(doc.astype(np.int64) * BUCKETS + bucket.astype(np.int64), minlength=docs * BUCKETS).reshape(docs, BUCKETS)


def char_counts(texts: list[bytes], sizes: tuple[int, ...], points: bool = False) -> np.ndarray:
    """Counts of n-grams of bytes (or code ``points``) by bucket; each text is taken between two spaces, by itself."""
    joined = b" " + b" ".join(texts) + b" "
    if points:
        data = np.frombuffer(joined.decode().encode("utf-32-le"), dtype=np.uint32)
        lengths = np.fromiter((len(t.decode()) for t in texts), dtype=np.int64, count=len(texts)) + 1
    else:
        data = np.frombuffer(joined, dtype=np.uint8)
        lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + 1
    doc = np.repeat(np.arange(len(texts), dtype=np.int32), lengths)
    # where the space after each text stands: no n-gram of the text goes beyond
    last = np.cumsum(lengths).astype(np.int32)[doc] if len(texts) else np.zeros(0, dtype=np.int32)
    out = np.zeros((len(texts), BUCKETS), dtype=np.int64)
    for n in sizes:
        size = min(len(doc), max(0, len(data) - n + 1))
        own = np.arange(n - 1, n - 1 + size, dtype=np.int32) <= last[:size]
        gram = np.full(size, n, dtype=np.uint32)
        for j in range(n):
            gram = gram * np.uint32(0x01000193) + data[j : j + size]
        gram = (gram ^ (gram >> np.uint32(16))) * np.uint32(0x9E3779B1)
        gram = (gram ^ (gram >> np.uint32(15))) * np.uint32(0x85EBCA6B)
        out += _counts(doc[:size][own], (gram >> np.uint32(20))[own], len(texts))
    return out


def word_counts(words: W.Words, docs: int, sizes: tuple[int, ...]) -> np.ndarray:
    """Counts of word n-grams by bucket."""
    out = np.zeros((docs, BUCKETS), dtype=np.int64)
    for n in sizes:
        ok = words.whole(n)
        out += _counts(words.doc[: len(ok)][ok], (words.grams(n)[ok] >> _SHIFT), docs)
    return out


def shares(counts: np.ndarray) -> np.ndarray:
    """Square roots of each bucket's share of a row, so that a text's length doesn't count."""
    total = np.maximum(1, counts.sum(axis=1, keepdims=True))
    return np.sqrt((counts / total).astype(np.float32))


def parts(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges of texts whose features are made at once: few rows, since each takes all buckets."""
    for i, j in W.chunks(texts, 1 << 20):
        for a in range(i, j, AT_ONCE):
            yield a, min(j, a + AT_ONCE)


@dataclass
class Rows:
    """Rows of features of which only those that aren't zero are held; ``chunks`` spells out a few at a time."""

    begin: np.ndarray
    at: np.ndarray
    value: np.ndarray
    width: int

    @staticmethod
    def of(at: list[np.ndarray], value: list[np.ndarray], width: int) -> Rows:
        begin = np.cumsum([0, *map(len, at)])
        return Rows(begin, np.concatenate([np.zeros(0, dtype=np.int32), *at]), np.concatenate([np.zeros(0, dtype=np.float32), *value]), width)

    @staticmethod
    def dense(x: np.ndarray) -> Rows:
        full = [np.flatnonzero(r).astype(np.int32) for r in x]
        return Rows.of(full, [r[f].astype(np.float32) for r, f in zip(x, full, strict=True)], x.shape[1])

    def __len__(self) -> int:
        return len(self.begin) - 1

    def take(self, rows: np.ndarray) -> Rows:
        parts = [slice(int(self.begin[k]), int(self.begin[k + 1])) for k in rows]
        return Rows.of([self.at[p] for p in parts], [self.value[p] for p in parts], self.width)

    def chunks(self) -> Iterator[tuple[int, int, np.ndarray]]:
        """First row, last row (excluded) and their features; the array is used again for the next ones."""
        room = np.zeros((min(AT_ONCE, len(self)), self.width), dtype=np.float32)
        for i in range(0, len(self), AT_ONCE):
            j = min(i + AT_ONCE, len(self))
            part = slice(int(self.begin[i]), int(self.begin[j]))
            places = np.repeat(np.arange(j - i) * self.width, np.diff(self.begin[i : j + 1])) + self.at[part]
            room.reshape(-1)[places] = self.value[part]
            yield i, j, room[: j - i]
            room.reshape(-1)[places] = 0

    def dot(self, w: np.ndarray) -> np.ndarray:
        out = np.zeros((len(self), *w.shape[1:]), dtype=np.float32)
        for i, j, x in self.chunks():
            out[i:j] = x @ w
        return out


def sampled(docs: DataFrame, labels: DataFrame, label: str, featurize: Featurizer, per_class: int) -> tuple[list, Rows]:
    """Labels and features of at most ``per_class`` documents of each label, ``MOST_ROWS`` of all, in order of doc_id.

    ``labels`` has doc_id and the label; a doc_id with several labels teaches nothing.  The
    sample is bounded, its ids are sent to all tasks and only features come back to the driver.
    """
    keys = label_sample(labels, label, per_class, MOST_ROWS).withColumnRenamed(label, "_label")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(keys), "doc_id").select("doc_id", F.col("_label").cast("string"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = W.encoded(b.column(2))
            for i, j in parts(texts):
                x = featurize(texts[i:j])
                full = [np.flatnonzero(r).astype(np.int32) for r in x]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), b.column(1).slice(i, j - i).cast(pa.string()), pa.array([f.tobytes() for f in full], pa.binary()), pa.array([r[f].tobytes() for r, f in zip(x, full, strict=True)], pa.binary())], names=["doc_id", "label", "at", "x"])
            give_back()

    # documents that repeat a doc_id count once, by the least of their features
    found = rows.mapInArrow(run, "doc_id long, label string, at binary, x binary").groupBy("doc_id", "label").agg(F.min(F.struct("at", "x")).alias("f")).select("doc_id", "label", "f.*").toArrow()
    order = np.argsort(found.column("doc_id").to_numpy(), kind="stable").tolist()
    names = [found.column("label")[k].as_py() for k in order]
    cells = lambda name, kind: [np.frombuffer(found.column(name)[k].as_buffer(), dtype=kind) for k in order]
    out = Rows.of(cells("at", np.int32), cells("x", np.float32), featurize([b""]).shape[1])
    del found
    give_back()
    return names, out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def fit(x: Rows, y: np.ndarray, decay: float = 1e-4, steps: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias of one logistic regression for each column of ``y`` (0/1), by accelerated descent.

    Classes of a column weigh the same together, whatever their number of rows.
    """
    y = y.astype(np.float32).reshape(len(x), -1)
    ones = np.maximum(1, y.sum(axis=0))
    weight = np.where(y > 0, 0.5 / ones, 0.5 / np.maximum(1, len(y) - y.sum(axis=0))).astype(np.float32)
    w, b = np.zeros((x.width, y.shape[1]), dtype=np.float32), np.zeros(y.shape[1], dtype=np.float32)
    ahead_w, ahead_b = w, b
    longest = max((float(np.einsum("ij,ij->i", part, part).max(initial=0)) for _, _, part in x.chunks()), default=0.0)
    rate = np.float32(4.0 / (1.0 + longest) / (1 + 4 * decay))
    for k in range(steps):
        slope_w, slope_b = decay * ahead_w, np.zeros_like(b)
        for i, j, part in x.chunks():
            slope = (sigmoid(part @ ahead_w + ahead_b) - y[i:j]) * weight[i:j]
            slope_w += part.T @ slope
            slope_b += slope.sum(axis=0)
        new_w, new_b = ahead_w - rate * slope_w, ahead_b - rate * slope_b
        pull = np.float32(k / (k + 3))
        ahead_w, ahead_b = new_w + pull * (new_w - w), new_b + pull * (new_b - b)
        w, b = new_w.astype(np.float32), new_b.astype(np.float32)
    return w, b


def calibration(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Platt scaling: slope and offset so that sigmoid(slope*margin+offset) is a probability.

    Targets are smoothed by the class sizes and classes weigh the same together.
    """
    pos, neg = max(1, int((y > 0).sum())), max(1, int((y == 0).sum()))
    target = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    weight = np.where(y > 0, 0.5 / pos, 0.5 / neg)
    theta, x = np.array([1.0, 0.0]), np.stack([margin, np.ones(len(margin))], axis=1)
    for _ in range(50):
        p = sigmoid(x @ theta)
        slope = x.T @ ((p - target) * weight) + 1e-6 * theta
        curve = (x * (p * (1 - p) * weight)[:, None]).T @ x + 1e-6 * np.eye(2)
        theta = theta - np.clip(np.linalg.solve(curve, slope), -5, 5)
    return float(max(theta[0], 1e-3)), float(theta[1])
