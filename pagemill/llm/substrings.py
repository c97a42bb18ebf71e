"""Removal of passages that an earlier document already has, to the word.

A window is ``size`` consecutive words of one document.  A word goes if some window over it
also starts in a document with a smaller doc_id.  The steps, each over all documents:

1. Blocks of documents ask which *anchors* recur.  A window's anchor is the least hash of its
   short word grams, so equal windows have equal anchors and a fifth of the keys suffices.
2. For windows whose anchor recurs, blocks ask by a 96-bit hash whether the window itself
   starts in a smaller document elsewhere: these are the confirmed passages.
3. Each block joins neighbouring confirmed windows into passages, compiles these into sharded
   Aho-Corasick automata over word codes and streams all its documents through them: every
   occurrence is located and, in documents after the passage's owner, removed.

A key is asked once a block however many documents hold it, so copies do not pile up in a task.

Edge cases: null and empty texts have no words; texts under ``size`` words lose nothing;
repeated rows of one doc_id don't remove each other; a null doc_id is no document's smaller
one and its row keeps all words; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import islice

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm import exchange as X
from pagemill.llm import words as W
from pagemill.llm.store import small_batches, text_bytes

#: Text bytes whose keys meet in one shard.
SHARD_BYTES = 12 << 20
#: Characters of the passages of one automaton: a node each at most, of some 40 bytes.
AUTOMATON_CHARS = 2_000_000
#: Characters of the automata's texts for one word.
DIGITS = 3
#: Words of one pattern: longer passages are compiled in overlapping parts, so that few patterns end at any word.
PATTERN_WORDS = 64
_NONE = np.iinfo(np.int64).max


@dataclass
class Block:
    """The documents of a block in rising order of id, those with a null id last."""

    order: np.ndarray  # of each document: its row
    ids: np.ndarray
    texts: list[bytes]
    words: W.Words
    start: np.ndarray  # of each window: its first word
    anchor: np.ndarray

    @classmethod
    def of(cls, table: pa.Table, size: int, gram: int) -> Block:
        ids = np.array([_NONE if i is None else i for i in table.column("doc_id").to_pylist()], dtype=np.int64)
        texts = W.encoded(table.column("text"))
        order = np.array(sorted(range(len(ids)), key=lambda i: (ids[i], texts[i])), dtype=np.int64)
        ids, texts = ids[order], [texts[i] for i in order]
        words = W.scan(texts)
        start = np.flatnonzero(words.whole(size))
        start = start[ids[words.doc[start]] != _NONE]
        low, span = words.grams(gram), 1
        reach = size - gram + 1
        while span < reach:
            step = min(span, reach - span)
            low = np.minimum(low[: len(low) - step], low[step:])
            span += step
        return cls(order, ids, texts, words, start, low[start] if len(start) else np.zeros(0, dtype=np.uint64))

    def id_of(self, window: np.ndarray) -> np.ndarray:
        return self.ids[self.words.doc[self.start[window]]]


def _least_and_many(order: np.ndarray, begin: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each group: its smallest id, and whether it has other ids."""
    if not len(begin):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=bool)
    low, high = np.minimum.reduceat(ids[order], begin), np.maximum.reduceat(ids[order], begin)
    return low, low < high


def _anchors(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct anchors, their smallest id, whether they have others, and each window's anchor index."""
    order, begin = X.groups(block.anchor)
    low, many = _least_and_many(order, begin, block.id_of(np.arange(len(block.start))))
    return block.anchor[order][begin], low, many, X.spread(order, begin, np.arange(len(begin)))


def _windows(block: Block, flagged: np.ndarray, size: int) -> tuple:
    """Distinct flagged windows: two hashes, smallest id, whether others have it; each one's start and index."""
    at = block.start[flagged]
    one, two = np.zeros(len(at), dtype=np.uint64), np.zeros(len(at), dtype=np.uint64)
    for j in range(size):
        h = block.words.hash[at + j]
        one = one * np.uint64(0x9FB21C651E98DF25) + h
        two = two * np.uint64(0xD1B54A32D192ED03) + (h ^ (h >> np.uint64(29)))
    one, two = W.mix(one), W.mix(two) >> np.uint64(32)
    order, begin = X.groups(one, two)
    low, many = _least_and_many(order, begin, block.ids[block.words.doc[at]])
    first = order[begin]
    return one[first], two[first].astype(np.uint32), low, many, at, X.spread(order, begin, np.arange(len(begin)))


def _spelled(known: np.ndarray, hashes: np.ndarray) -> str:
    """A string with ``DIGITS`` characters for each word: its rank among ``known``, or the mark of none.

    An automaton's node looks through its children one by one, so characters are few; each
    digit has an alphabet of its own, so nothing matches from the middle of a word.
    """
    base = max(2, int(np.ceil((len(known) + 1) ** (1 / DIGITS))))
    code = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
    code = np.where(known[code] == hashes, code, base**DIGITS)
    digits = np.stack([code // base**k % base + k * (base + 1) for k in reversed(range(DIGITS))], axis=1)
    digits[code == base**DIGITS] = base
    return digits.astype("<u4").tobytes().decode("utf-32-le")


def _passages(at: np.ndarray, owner: np.ndarray, size: int) -> Iterator[tuple[int, int, int]]:
    """Runs of neighbouring windows of one owner, in parts that share all but one word of a window: first word, last word (excluded), owner."""
    new = np.ones(len(at), dtype=bool)
    new[1:] = (np.diff(at) != 1) | (owner[1:] != owner[:-1])
    begin = np.flatnonzero(new)
    last = np.append(begin[1:], len(at)) - 1
    longest = max(PATTERN_WORDS, size)
    for a, b, who in zip(at[begin].tolist(), (at[last] + size).tolist(), owner[begin].tolist(), strict=True):
        for part in range(a, b - size + 1, longest - size + 1):
            yield part, min(b, part + longest), who


def _removed(block: Block, at: np.ndarray, owner: np.ndarray, size: int) -> np.ndarray:
    """Which words an occurrence of some passage covers, where the passage's owner is a smaller document.

    ``at`` has the starts, in order, of all confirmed windows of the block, ``owner`` their owners.
    """
    covered = np.zeros(len(block.words) + 1, dtype=np.int32)
    if not len(at):
        return covered[:-1] > 0
    inside = np.zeros(len(block.words) + 1, dtype=np.int32)
    np.add.at(inside, at, 1)
    np.add.at(inside, at + size, -1)
    hashes = block.words.hash
    chars = _spelled(np.unique(hashes[np.cumsum(inside[:-1]) > 0]), hashes)
    bounds = block.words.first
    # the rest has no confirmed window, so no passage occurs there
    streams = np.unique(block.words.doc[at]).tolist()

    def locate(automaton: ahocorasick.Automaton) -> None:
        automaton.make_automaton()
        # one stream a document: an occurrence doesn't run over a document's end
        for d in streams:
            a, b, own = int(bounds[d]), int(bounds[d + 1]), block.ids[d]
            hits = ((end, n) for end, (n, who) in automaton.iter(chars[DIGITS * a : DIGITS * b]) if who < own)
            while found := list(islice(hits, 1 << 16)):
                end, n = np.array(found, dtype=np.int64).T
                end = end // DIGITS + a + 1
                np.add.at(covered, end - n, 1)
                np.add.at(covered, end, -1)

    automaton, room = ahocorasick.Automaton(), AUTOMATON_CHARS
    for a, b, who in _passages(at, owner, size):
        if room < DIGITS * (b - a) and len(automaton):
            locate(automaton)
            automaton, room = ahocorasick.Automaton(), AUTOMATON_CHARS
        if automaton.add_word(chars[DIGITS * a : DIGITS * b], (b - a, who)):
            room -= DIGITS * (b - a)
    locate(automaton)
    return np.cumsum(covered[:-1]) > 0


def _cut(docs: DataFrame, size: int, gram: int, result: Callable[[Block, pa.Table, np.ndarray], pa.Table], schema: str) -> DataFrame:
    """What ``result`` makes of each block, its rows and the flags of the words to remove."""
    small_batches(docs.sparkSession)
    if not 1 < gram <= size:
        raise ValueError("an anchor gram has two words or more and fits a window")
    total = text_bytes(docs)
    blocks, number = X.with_blocks(docs, total)
    n = max(1, -(-total // SHARD_BYTES))
    empty = pa.table({"block": pa.array([], pa.int32()), "shard": pa.array([], pa.int32()), "answer": pa.array([], pa.binary())})

    def ask_anchors(table: pa.Table) -> pa.Table:
        keys, low, many, _ = _anchors(Block.of(table, size, gram))
        return X.questions(table.column(number)[0].as_py(), keys, {"low": low, "many": many}, n)

    def recurring(table: pa.Table) -> pa.Table:
        blocks, cut, got = X.unpacked(table, {"key": np.uint64, "low": np.int64, "many": np.bool_})
        order, begin = X.groups(got["key"])
        _, many = _least_and_many(order, begin, got["low"])
        if len(begin):
            many |= np.logical_or.reduceat(got["many"][order], begin)
        return X.answers(table.column("shard")[0].as_py(), blocks, cut, X.spread(order, begin, many))

    def flagged(block: Block, table: pa.Table) -> np.ndarray:
        keys, _, _, of = _anchors(block)
        return np.flatnonzero(X.answered(table, keys, n, np.bool_)[of]) if len(of) else np.zeros(0, dtype=np.int64)

    def ask_windows(table: pa.Table, reply: pa.Table) -> pa.Table:
        if not table.num_rows:
            return X.questions(0, np.zeros(0, dtype=np.uint64), {"more": np.zeros(0, dtype=np.uint32), "low": np.zeros(0, dtype=np.int64)}, n)
        block = Block.of(table, size, gram)
        one, two, low, *_ = _windows(block, flagged(block, reply), size)
        return X.questions(table.column(number)[0].as_py(), one, {"more": two, "low": low}, n)

    def smaller_elsewhere(table: pa.Table) -> pa.Table:
        blocks, cut, got = X.unpacked(table, {"key": np.uint64, "more": np.uint32, "low": np.int64})
        order, begin = X.groups(got["key"], got["more"])
        low, _ = _least_and_many(order, begin, got["low"])
        return X.answers(table.column("shard")[0].as_py(), blocks, cut, X.spread(order, begin, low) < got["low"])

    def remove(table: pa.Table, reply: pa.Table) -> pa.Table:
        block = Block.of(table, size, gram)
        kind = np.asarray(reply.column("step").to_pylist(), dtype=np.int64)
        flags = flagged(block, reply.filter(pa.array(kind == 1)) if len(kind) else empty)
        one, _, low, many, at, of = _windows(block, flags, size)
        outside = X.answered(reply.filter(pa.array(kind == 2)) if len(kind) else empty, one, n, np.bool_)
        confirmed = (outside | many)[of]
        owner = np.where(outside, np.iinfo(np.int64).min, low)[of]
        return result(block, table, _removed(block, at[confirmed], owner[confirmed], size))

    first = blocks.groupBy(number).applyInArrow(ask_anchors, X.question_schema(["low", "many"])).groupBy("shard").applyInArrow(recurring, X.ANSWER_SCHEMA)
    second = blocks.groupBy(number).cogroup(first.groupBy("block")).applyInArrow(ask_windows, X.question_schema(["more", "low"])).groupBy("shard").applyInArrow(smaller_elsewhere, X.ANSWER_SCHEMA)
    replies = first.withColumn("step", F.lit(1)).unionByName(second.withColumn("step", F.lit(2)))
    return blocks.groupBy(number).cogroup(replies.groupBy("block")).applyInArrow(remove, schema)


def _kept(block: Block, d: int, gone: np.ndarray) -> tuple[int, int, bytes]:
    """Of a document: its words, those removed, and the rest joined by single spaces."""
    a, b = int(block.words.first[d]), int(block.words.first[d + 1])
    own, lost = block.texts[d].split(), gone[a:b]
    n = int(lost.sum())
    return b - a, n, b" ".join([w for w, g in zip(own, lost.tolist(), strict=True) if not g] if n else own)


def deduplicate(docs: DataFrame, size: int = 13, gram: int = 6, texts: bool = False) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256 and, with ``texts``, kept.

    kept has the words left, joined by single spaces; kept_sha256 is its SHA-256 as UTF-8.
    """

    def result(block: Block, _: pa.Table, gone: np.ndarray) -> pa.Table:
        rows = []
        for d, i in enumerate(block.ids.tolist()):
            n, lost, kept = _kept(block, d, gone)
            rows.append((None if i == _NONE else i, n, lost, hashlib.sha256(kept).hexdigest(), kept.decode() if texts else None))
        cols = list(zip(*rows, strict=True))
        out = {"doc_id": pa.array(cols[0], pa.int64()), "n_words": pa.array(cols[1], pa.int64()), "n_removed": pa.array(cols[2], pa.int64()), "kept_sha256": pa.array(cols[3], pa.string())}
        return pa.table(out | ({"kept": pa.array(cols[4], pa.string())} if texts else {}))

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return _cut(narrow, size, gram, result, "doc_id long, n_words long, n_removed long, kept_sha256 string" + (", kept string" if texts else ""))


def without_repeats(docs: DataFrame, size: int = 13, gram: int = 6) -> DataFrame:
    """``docs``, all columns kept, without the repeated passages.

    A text that loses words has the rest joined by single spaces; n_chars, where there is one,
    counts what is left; a document of which nothing is left goes.  All other rows stay as they are.
    """
    names = docs.columns

    def result(block: Block, table: pa.Table, gone: np.ndarray) -> pa.Table:
        texts, stay = table.column("text").to_pylist(), np.ones(table.num_rows, dtype=bool)
        sizes = table.column("n_chars").to_pylist() if "n_chars" in names else None
        for d, row in enumerate(block.order.tolist()):
            if gone[int(block.words.first[d]) : int(block.words.first[d + 1])].any():
                kept = _kept(block, d, gone)[2].decode()
                texts[row], stay[row] = kept, bool(kept)
                if sizes:
                    sizes[row] = len(kept)
        table = table.set_column(table.column_names.index("text"), "text", pa.array(texts, table.schema.field("text").type))
        if sizes:
            table = table.set_column(table.column_names.index("n_chars"), "n_chars", pa.array(sizes, table.schema.field("n_chars").type))
        return table.select(names).filter(pa.array(stay))

    return _cut(docs.withColumn("doc_id", F.col("doc_id").cast("long")), size, gram, result, docs.withColumn("doc_id", F.col("doc_id").cast("long")).schema)
