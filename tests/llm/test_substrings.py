import hashlib
import random

import pytest

from pagemill.llm import exchange, substrings


def brute(rows, size):
    first = {}
    split = [(d, (t or "").encode().split()) for d, t in rows]
    for d, w in split:
        if d is not None:
            for i in range(len(w) - size + 1):
                g = tuple(w[i : i + size])
                first[g] = min(d, first.get(g, d))
    out = []
    for d, w in split:
        gone = [False] * len(w)
        if d is not None:
            for i in range(len(w) - size + 1):
                if first[tuple(w[i : i + size])] < d:
                    gone[i : i + size] = [True] * size
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((d, len(w), sum(gone), hashlib.sha256(kept).hexdigest(), kept.decode()))
    return sorted(out, key=str)


def make(seed):
    rng = random.Random(seed)
    vocabulary = ["a", "the", "été", "x y", *(f"w{i}" for i in range(25))]
    passages = [[rng.choice(vocabulary) for _ in range(rng.randrange(10, 50))] for _ in range(12)]
    rows = []
    for d in rng.sample(range(-50, 500), 120):
        w = [rng.choice(vocabulary) for _ in range(rng.randrange(0, 30))]
        for _ in range(rng.randrange(3)):
            p = rng.choice(passages)
            cut = rng.randrange(len(p))
            w += p[cut:] if rng.random() < 0.5 else p
            w += [f"u{rng.random()}"] * rng.randrange(2)
        rows.append((d, rng.choice([" ", "\n", "  \t"]).join(w)))
    rows += rows[:5]
    return rows + [(9001, None), (9002, ""), (None, rows[3][1]), (None, None), (9003, " ".join(["z"] * 40)), (9004, " ".join(["z"] * 30))]


@pytest.mark.parametrize("seed, block", [(1, 4 << 20), (2, 900)])
def test_words_removed_match_brute_force(spark, monkeypatch, seed, block):
    monkeypatch.setattr(exchange.with_blocks, "__defaults__", (block,))
    monkeypatch.setattr(substrings, "SHARD_BYTES", 4 * block)
    rows = make(seed)
    df = spark.createDataFrame([(d, t, 1, 2) for d, t in rows], "doc_id long, text string, block int, n_words int")
    got = sorted((tuple(r) for r in substrings.deduplicate(df, texts=True).collect()), key=str)
    assert got == brute(rows, 13)


def test_automata_are_sharded(spark, monkeypatch):
    monkeypatch.setattr(substrings, "AUTOMATON_CHARS", 150)
    rows = make(5)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in substrings.deduplicate(df, size=8, gram=4, texts=True).collect()), key=str)
    assert got == brute(rows, 8)


def test_runs_of_one_word_in_many_lengths(spark, monkeypatch):
    """Patterns that are each other's ends: matches stay bounded and all words are found."""
    monkeypatch.setattr(substrings, "PATTERN_WORDS", 20)
    rows = [(d, " ".join(["z"] * (13 + 7 * d) + [f"e{d}"] + ["y"] * (200 - d))) for d in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in substrings.deduplicate(df, texts=True).collect()), key=str)
    assert got == brute(rows, 13)


def test_no_rows(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert substrings.deduplicate(df).count() == 0
