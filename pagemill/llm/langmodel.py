"""Language-model scores from a weighted backoff automaton over bigrams of the whole corpus.

The root state holds smoothed unigrams; each known word is a state.  From state v an arc on
word w carries log10 of (c(v,w) + k * p(w)) / (c(v) + k), Dirichlet smoothing of strength k; where
there is none, the failure arc of v leads to the root at the weight k / (c(v) + k), so a state seen
often backs off dearly and an unknown one for nothing, and the root reads w at
p(w) = (c(w)+1)/(N+V+1).  So each state's outgoing probabilities sum to one.  One
left-to-right traversal carries the state (the last word) and adds up the arcs taken.

Counts are exact and cover all training documents: blocks of documents send their distinct
words and bigrams with counts to shards and get back the corpus totals of these.  Each block
then holds the part of the automaton that its documents can reach, and no more.

Edge cases: null and empty texts are the end token alone; without training rows N and V are
zero and every word has p = 1; repeated rows count as often as they occur; a null doc_id counts
as held out; texts are taken whole; columns beside doc_id and text may have any name.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm import exchange as X
from pagemill.llm import words as W
from pagemill.llm.store import crc_rest, saved, small_batches, text_bytes

#: Text bytes whose keys meet in one shard.
SHARD_BYTES = 12 << 20
#: Smoothing of the bigrams: as many words read by the root as so many occurrences of a state weigh.
STRENGTH = 20.0
#: Key of the end token: outside the words' texts, so it equals a word's key only by chance, 2^-64.
END = W.mix(np.array([0xA5A5A5A5A5A5A5A5], dtype=np.uint64))[0]
_PAIR = np.uint64(0x9FB21C651E98DF25)


def pair_key(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return W.mix(left * _PAIR + (right ^ (right >> np.uint64(31))))


@dataclass
class Automaton:
    """Part of the automaton: word states with counts, bigram arcs with counts; corpus totals."""

    words: np.ndarray  # sorted keys
    counts: np.ndarray
    arcs: np.ndarray  # sorted keys
    arc_counts: np.ndarray
    total: int
    types: int
    strength: float

    def count(self, words: np.ndarray) -> np.ndarray:
        return _looked_up(self.words, self.counts, words)

    def root(self, counts: np.ndarray) -> np.ndarray:
        """log10 of the smoothed unigram probability."""
        return np.log10((counts + 1) / (self.total + (self.types + 1)))

    def traverse(self, state: np.ndarray, word: np.ndarray) -> np.ndarray:
        """log10 probability of reading each word in its state."""
        at, p = self.count(state), self.root(self.count(word))
        both = _looked_up(self.arcs, self.arc_counts, pair_key(state, word))
        failure = np.log10(self.strength / (at + self.strength))
        arc = np.log10((both + self.strength * 10.0**p) / (at + self.strength))
        return np.where(both > 0, arc, failure + p)


def _looked_up(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    if not len(keys):
        return np.zeros(len(wanted), dtype=np.int64)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], 0)


@dataclass
class _Tokens:
    """Tokens of a block: each document's words and then its end; each with the token before it."""

    key: np.ndarray
    before: np.ndarray
    first: np.ndarray
    training: np.ndarray

    @classmethod
    def of(cls, table: pa.Table) -> _Tokens:
        words = W.scan(W.encoded(table.column("text"), lower=True))
        docs = table.num_rows
        first = words.first + np.arange(docs + 1)
        key = np.full(len(words) + docs, END, dtype=np.uint64)
        inner = np.ones(len(key), dtype=bool)
        inner[first[1:] - 1] = False
        key[inner] = words.hash
        before = np.empty_like(key)
        before[1:] = key[:-1]
        before[:1] = END
        train = ~np.asarray(table.column("held_out").to_pylist(), dtype=bool)
        return cls(key, before, first, np.repeat(train, np.diff(first)))

    def distinct(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order, begin = X.groups(keys)
        counts = np.add.reduceat(self.training[order].astype(np.int64), begin) if len(begin) else np.zeros(0, dtype=np.int64)
        return keys[order][begin], counts.astype(np.uint32)


def scores(docs: DataFrame, held_out: str = "held_out", strength: float = STRENGTH) -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    ``held_out`` names a boolean column; its false rows are the training documents.
    """
    small_batches(docs.sparkSession)
    if strength <= 0:
        raise ValueError("the strength of smoothing is over 0")
    total = text_bytes(docs)
    n_blocks, n = max(1, -(-total // X.BLOCK_BYTES)), max(1, -(-total // SHARD_BYTES))
    blocks = docs.select(
        F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_blocks)).cast("int").alias("block"),
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
        F.coalesce(F.col(held_out), F.lit(True)).alias("held_out"),
    )

    def ask(table: pa.Table) -> pa.Table:
        block, tokens = table.column("block")[0].as_py(), _Tokens.of(table)
        parts = []
        for kind, keys in ((0, tokens.key), (1, pair_key(tokens.before, tokens.key))):
            key, count = tokens.distinct(keys)
            part = X.questions(block, key, {"count": count}, n)
            parts.append(part.append_column("kind", pa.array([kind] * part.num_rows, pa.int32())))
        return pa.concat_tables(parts)

    def add_up(table: pa.Table) -> pa.Table:
        shard, kind = table.column("shard")[0].as_py(), table.column("kind")[0].as_py()
        blocks, cut, got = X.unpacked(table, {"key": np.uint64, "count": np.uint32})
        order, begin = X.groups(got["key"])
        sums = np.add.reduceat(got["count"][order].astype(np.int64), begin) if len(begin) else np.zeros(0, dtype=np.int64)
        out = X.answers(shard, blocks, cut, X.spread(order, begin, sums))
        out = pa.table({**{c: out.column(c) for c in out.column_names}, "kind": pa.array([kind] * len(blocks), pa.int32())})
        for name, value in (("tokens", int(sums.sum())), ("types", int((sums > 0).sum()))):
            values = [value if kind == 0 and not i else 0 for i in range(len(blocks))]
            out = out.append_column(name, pa.array(values, pa.int64()))
        return out

    replies = saved(
        blocks.groupBy("block").applyInArrow(ask, X.question_schema(["count"]) + ", kind int")
        .groupBy("kind", "shard").applyInArrow(add_up, X.ANSWER_SCHEMA + ", kind int, tokens long, types long"), "counts",
    )
    tokens, types = (int(x or 0) for x in replies.agg(F.sum("tokens"), F.sum("types")).first())

    def score(table: pa.Table, reply: pa.Table) -> pa.Table:
        own = _Tokens.of(table)
        kind = np.asarray(reply.column("kind").to_pylist(), dtype=np.int64)
        word, arc = np.unique(own.key), np.unique(pair_key(own.before, own.key))
        found = [X.answered(reply.filter(pa.array(kind == k)), keys, n, np.int64) for k, keys in ((0, word), (1, arc))]
        model = Automaton(word, found[0], arc, found[1], tokens, types, strength)
        count = model.count(own.key)
        begin = own.first[:-1]
        return pa.table({
            "doc_id": table.column("doc_id"),
            "held_out": table.column("held_out"),
            "n_tokens": pa.array(np.diff(own.first).astype(np.int64)),
            "n_known": pa.array(np.add.reduceat((count > 0).astype(np.int64), begin)),
            "train_tokens": pa.array(np.full(table.num_rows, tokens, dtype=np.int64)),
            "base_score": pa.array(np.add.reduceat(model.root(count), begin)),
            "score": pa.array(np.add.reduceat(model.traverse(own.before, own.key), begin)),
        })

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return blocks.groupBy("block").cogroup(replies.select("block", "shard", "answer", "kind").groupBy("block")).applyInArrow(score, schema)


def corpus_scores(docs: DataFrame, divisor: int = 7, rest: int = 2, strength: float = STRENGTH) -> DataFrame:
    """``scores`` with the documents whose crc32 of the id leaves ``rest`` held out of the training."""
    return scores(docs.withColumn("held_out", F.coalesce(crc_rest("doc_id", divisor) == rest, F.lit(True))), "held_out", strength)
