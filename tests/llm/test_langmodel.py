import math
import random
import zlib
from collections import Counter

import pytest

from pagemill.llm import exchange, langmodel


def brute(rows, k=20.0):
    tokens = lambda t: [*(t or "").encode().lower().split(), None]
    uni, bi = Counter(), Counter()
    held = lambda d: d is None or zlib.crc32(str(d).encode()) % 7 == 2
    for d, t in rows:
        if not held(d):
            w = tokens(t)
            uni.update(w)
            bi.update(zip([None, *w], w))
    n, v = sum(uni.values()), len(uni)
    out = []
    for d, t in rows:
        w, base, score = tokens(t), 0.0, 0.0
        for a, b in zip([None, *w], w):
            p = (uni[b] + 1) / (n + 1 * (v + 1))
            base += math.log10(p)
            q = (bi[a, b] + k * p) / (uni[a] + k)
            score += math.log10(q)
        out.append((d, held(d), len(w), sum(uni[b] > 0 for b in w), n, base, score))
    return out


def key(r):
    return (str(r[0]), *map(str, r[1:5]), round(r[5], 6))


@pytest.mark.parametrize("block", [4 << 20, 700])
def test_scores_match_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(exchange, "BLOCK_BYTES", block)
    monkeypatch.setattr(langmodel, "SHARD_BYTES", 3 * block)
    rng = random.Random(4)
    vocabulary = ["The", "the", "été", "end", *(f"w{i}" for i in range(30))]
    rows = [(d, rng.choice([" ", "\n"]).join(rng.choice(vocabulary) for _ in range(rng.randrange(0, 40)))) for d in range(150)]
    rows += rows[:4] + [(900, None), (901, ""), (None, "the w1"), (902, "never seen words")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in langmodel.corpus_scores(df).collect()), key=key)
    want = sorted(brute(rows), key=key)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for g, w in zip(got, want, strict=True):
        assert g[5:] == pytest.approx(w[5:], rel=1e-9)


def test_no_rows_and_no_training_rows(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert langmodel.corpus_scores(df).count() == 0
    one = spark.createDataFrame([(None, "a b")], "doc_id long, text string")
    (r,) = langmodel.corpus_scores(one).collect()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) == (3, 0, 0, 0.0, 0.0)


def test_states_sum_to_one():
    import numpy as np

    words = np.sort(langmodel.W.mix(np.arange(1, 6, dtype=np.uint64)))
    counts = np.array([7, 3, 1, 4, 0])
    pairs = {(0, 1): 3, (0, 0): 2, (0, 3): 2, (1, 3): 3, (2, 0): 1, (3, 2): 1, (3, 0): 3}
    keys = np.array([langmodel.pair_key(words[a : a + 1], words[b : b + 1])[0] for a, b in pairs], dtype=np.uint64)
    order = np.argsort(keys)
    model = langmodel.Automaton(words, counts, keys[order], np.array([*pairs.values()])[order], 15, 4, 20.0)
    for v in range(5):
        # all words there are, and one for all that were never seen
        every = 10.0 ** model.traverse(np.repeat(words[v : v + 1], 5), words)
        assert every[counts == 0].sum() > 0
        assert math.isclose(every.sum(), 1.0, rel_tol=1e-9)
