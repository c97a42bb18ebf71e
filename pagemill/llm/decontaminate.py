"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment of words.

From each position of a test item the shortest n-gram is taken that is rare: one that chance
would give ``max_expected`` times or fewer in the corpus, by the corpus frequencies of its
words.  A shorter item
without a rare one is its own seed.  Rarity looks at words only, so a passage that very many documents copy stays a seed.
Documents that hold a seed are aligned around it with the item; the alignment's score over that
of the whole item is the similarity, so edited and paraphrased copies count by what is left.

The benchmark is handled in slices of bounded size, each sent to the executors whole.

Edge cases: null or empty texts on either side match nothing; items under ``min_words`` words
are no evidence and match nothing, and a short item needs ``min_matched`` of its words or all of them; repeated rows each get their own result; empty tables give
an empty result.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm import words as W
from pagemill.llm.store import small_batches, text_bytes

#: Bytes of benchmark text in one slice.
SLICE_BYTES = 8 << 20
MATCH, MISMATCH, GAP = 2, -1, -1
_BITS = 22


def align(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int, int, int, int]:
    """Best local alignment of word sequences: score, matches, begin and end in a, begin and end in b."""
    n, m = len(a), len(b)
    table = np.zeros((n + 1, m + 1), dtype=np.int32)
    slope = GAP * np.arange(m + 1, dtype=np.int32)
    for i in range(1, n + 1):
        row = np.zeros(m + 1, dtype=np.int32)
        row[1:] = table[i - 1, :-1] + np.where(b == a[i - 1], MATCH, MISMATCH)
        np.maximum(row, table[i - 1] + GAP, out=row)
        np.maximum(row, 0, out=row)
        table[i] = np.maximum.accumulate(row - slope) + slope  # gaps along b
    i, j = divmod(int(table.argmax()), m + 1)
    score, end_a, end_b, matches = int(table[i, j]), i, j, 0
    while i and j and table[i, j] > 0:
        here = table[i, j]
        same = a[i - 1] == b[j - 1]
        if here == table[i - 1, j - 1] + (MATCH if same else MISMATCH):
            matches += bool(same)
            i, j = i - 1, j - 1
        elif here == table[i - 1, j] + GAP:
            i -= 1
        else:
            j -= 1
    return score, matches, i, end_a, j, end_b


@dataclass
class Seeds:
    """Seeds of some items by n: sorted hashes, and the item and position of each."""

    items: list[np.ndarray]
    by_n: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]

    def hits(self, words: W.Words) -> np.ndarray:
        """Rows (doc index, item index, word in the doc's list, word in the item) of all seeds found."""
        out = []
        for n, (hashes, item, place, present) in self.by_n.items():
            grams = words.grams(n)
            at = np.flatnonzero(present[(grams & np.uint64((1 << _BITS) - 1)).astype(np.int64)] & words.whole(n))
            low, high = (np.searchsorted(hashes, grams[at], side) for side in ("left", "right"))
            many = high - low
            at, low = np.repeat(at, many), np.repeat(low, many)
            which = low + np.arange(len(low)) - np.repeat(np.cumsum(many) - many, many)
            out.append(np.stack([words.doc[at].astype(np.int64), item[which], at, place[which]], axis=1))
        return np.concatenate(out) if out else np.zeros((0, 4), dtype=np.int64)


def _vocabulary(texts: DataFrame) -> np.ndarray:
    """Sorted hashes of the distinct words of the benchmark, all slices together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(W.scan(W.encoded(b.column(0), lower=True)).hash).view(np.int64))], names=["word"])

    found = texts.select("text").mapInArrow(run, "word long").distinct().toArrow().column("word").to_numpy()
    return np.sort(np.ascontiguousarray(found).view(np.uint64))


def _counts(docs: DataFrame, wanted: np.ndarray) -> tuple[dict[int, int], int]:
    """Corpus counts of the wanted words (sorted hashes), and of all words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, total = np.zeros(len(wanted), dtype=np.int64), 0
        for b in batches:
            texts = W.encoded(b.column(0), lower=True)
            for i, j in W.chunks(texts):
                h = W.scan(texts[i:j]).hash
                total += len(h)
                at = np.minimum(np.searchsorted(wanted, h), len(wanted) - 1)
                found += np.bincount(at[wanted[at] == h], minlength=len(wanted))
        full = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *full.tolist()], pa.int64()), pa.array([total, *found[full].tolist()], pa.int64())], names=["word", "n"])

    rows = docs.select(F.col("text").cast("string")).mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n")).collect()
    by = {int(w): int(n) for w, n in rows}
    return {int(wanted[w]): n for w, n in by.items() if w >= 0}, by.get(-1, 0)


def seeds_of(items: list[np.ndarray], counts: dict[int, int], total: int, shortest: int, longest: int, max_expected: float) -> Seeds:
    found: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    for k, hashes in enumerate(items):
        seeded = False
        log_p = [np.log(max(1, counts.get(int(h), 0)) / max(1, total)) for h in hashes]
        for i in range(len(hashes)):
            for n in range(shortest, longest + 1):
                if i + n > len(hashes):
                    break
                if n == longest or np.log(max(1, total)) + sum(log_p[i : i + n]) <= np.log(max_expected):
                    found[n].append((k, i, n))
                    seeded = True
                    break
        if len(hashes) and not seeded:  # short and of common words: only all of it
            found[len(hashes)].append((k, 0, len(hashes)))
    by_n = {}
    for n, rows in found.items():
        item, place = (np.array(x, dtype=np.int64) for x in list(zip(*rows, strict=True))[:2])
        line = W.Words(None, item, None, item, np.zeros(0, np.uint64), None)
        hashes = np.empty(len(rows), dtype=np.uint64)
        for r, (k, i, _) in enumerate(rows):
            line.hash, line.start = items[k][i : i + n], np.zeros(n)
            hashes[r] = line.grams(n)[0]
        order = np.argsort(hashes, kind="stable")
        present = np.zeros(1 << _BITS, dtype=bool)
        present[(hashes & np.uint64((1 << _BITS) - 1)).astype(np.int64)] = True
        by_n[n] = (hashes[order], item[order], place[order], present)
    return Seeds(items, by_n)


def _windows(hits: np.ndarray, length: int) -> Iterator[tuple[int, int]]:
    """Word ranges of a document to align with an item: around its hits, apart if far from each other."""
    slack = length // 2 + 4
    ranges = sorted((int(p) - int(q) - slack, int(p) - int(q) + length + slack) for p, q in hits)
    low, high = ranges[0]
    for a, b in ranges[1:]:
        if a > high:
            yield low, high
            low = a
        high = max(high, b)
    yield low, high


#: Words of a document that one alignment spans; longer stretches of hits are taken in overlapping parts.
_SPAN = 4096


def matches(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.4, min_words: int = 5, shortest: int = 3, longest: int = 8, max_expected: float = 1.0, min_matched: int = 6) -> DataFrame:
    """One row per document and item that align: doc_id, item_id, similarity, matched words and spans.

    Spans count words from 0, ends excluded; of several places in a document the best one, then
    the first, is reported.  similarity is between ``threshold`` and 1; of an item so short that
    ``threshold`` stands for fewer than ``min_matched`` words, between that many words and 1.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    tests = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null").distinct()
    slices = max(1, -(-text_bytes(tests) // SLICE_BYTES))
    schema = "doc_id long, item_id long, similarity double, n_matched int, doc_begin int, doc_end int, item_begin int, item_end int"
    result = None
    wanted = _vocabulary(tests)
    # the corpus is counted once, however many slices there are
    counts, total = _counts(docs, wanted) if len(wanted) else ({}, 0)
    for s in range(slices):
        part = tests.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(slices)) == s).orderBy("item_id", "text").collect()
        names, items = [], []
        for r in part:
            hashes = W.scan([r.text.encode().lower()]).hash
            if len(hashes) >= min_words:
                names.append(r.item_id)
                items.append(hashes)
        seeds = seeds_of(items, counts, total, min(shortest, min_words), longest, max_expected)

        def run(batches: Iterator[pa.RecordBatch], seeds: Seeds = seeds, names: list[int] = names) -> Iterator[pa.RecordBatch]:
            for b in batches:
                ids, texts, rows = b.column(0).to_pylist(), W.encoded(b.column(1), lower=True), []
                for begin, end in W.chunks(texts):
                    words = W.scan(texts[begin:end])
                    hits = seeds.hits(words)
                    hits = hits[np.lexsort((hits[:, 2], hits[:, 1], hits[:, 0]))]
                    new = np.flatnonzero(np.any(np.diff(hits[:, :2], axis=0) != 0, axis=1)) + 1
                    for group in np.split(hits, new) if len(hits) else ():
                        d, k = int(group[0, 0]), int(group[0, 1])
                        item, first, last = seeds.items[k], int(words.first[d]), int(words.first[d + 1])
                        best = None
                        for low, high in _windows(group[:, 2:], len(item)):
                            low, high = max(low, first), min(high, last)
                            for at in range(low, high, _SPAN):
                                stop = min(high, at + _SPAN + 3 * len(item))
                                score, n, ia, ib, da, db = align(item, words.hash[at:stop])
                                found = (score / (MATCH * len(item)), -(at + da - first), n, at + db - first, ia, ib)
                                best = max(best, found) if best else found
                        if best and best[0] >= max(threshold, min(1.0, min_matched / len(item))):
                            rows.append((ids[begin + d], names[k], best[0], best[2], -best[1], best[3], best[4], best[5]))
                cols = list(zip(*rows, strict=True)) or [()] * 8
                types = [pa.int64(), pa.int64(), pa.float64(), *[pa.int32()] * 5]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=[c.split()[0] for c in schema.split(", ")])

        found = docs.mapInArrow(run, schema)
        result = found if result is None else result.unionByName(found)
    return result


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options: float) -> DataFrame:
    """``docs`` without those that ``matches`` finds, all columns kept; a row with a null id stays."""
    bad = matches(docs, benchmark, **options).select("doc_id").distinct()
    return docs.join(bad, "doc_id", "left_anti").select(*docs.columns)
