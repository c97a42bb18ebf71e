import random
from collections import Counter

import numpy as np

from pagemill.llm import logit, quality


def brute(text):
    t = text or ""
    b = t.encode()
    w = b.split()
    grams = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    many = Counter(grams)
    covered = set()
    for i, g in enumerate(grams):
        if many[g] > 1:
            covered.update(range(i, i + 8))
    lines = [x for x in b.split(b"\n") if x.split()]
    return len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in t), sum(x in lines[:i] for i, x in enumerate(lines)), len(covered)


def make(n=240, seed=1):
    rng = random.Random(seed)
    rows = []
    for d in range(n):
        bad = d % 4 == 0
        w = [rng.choice(["the", "été", "of", *(f"w{i}" for i in range(50))]) + (rng.choice(["%%%", "***"]) if bad else "") for _ in range(rng.randrange(25, 90))]
        if d % 7 == 0:
            w = w[:9] * 4 + w[:3]
        rows.append((d, rng.choice([" ", "\n", " \t"]).join(w), not bad))
    return rows


def test_measures_match_brute_force(spark):
    rows = [*make(), (900, None, True), (901, "", True), (902, "a\n\na\n \n a\na", True), (902, "a\n\na\n \n a\na", True), (None, "x " * 40, True)]
    docs = spark.createDataFrame([(d, t, True, 0) for d, t, _ in rows], "doc_id long, text string, kept boolean, n_words int")
    labels = spark.createDataFrame([(d, int(q)) for d, _, q in rows if d is not None and d < 900 and d % 3], "doc_id long, quality int")
    got = quality.rules(docs, labels).collect()
    assert len(got) == len(rows)
    by = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got)
    assert by == Counter((d, *brute(t)) for d, t, _ in rows)
    quality_of = {d: q for d, _, q in rows}
    for r in got:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert not (r.base_failed and r.kept)
    judged = [r for r in got if not r.base_failed and r.doc_id is not None and r.doc_id < 900 and not r.doc_id % 3]
    assert sum(r.kept == quality_of[r.doc_id] for r in judged) >= 0.95 * len(judged)
    kept = quality.good(docs, labels)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in got if r.kept)


def test_no_labels_and_no_rows(spark):
    docs = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(30)))], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert [r.kept for r in quality.rules(docs, labels).collect()] == [True]
    assert quality.rules(docs.where("false"), labels).count() == 0


def test_features_are_of_one_text_only():
    import numpy as np

    from pagemill.llm import langid

    texts = [t.encode() for t in ("hello world", "zebra", "", "été", "été mit Maß", "a", " x ", "hello world")]
    for featurize in (quality.featurize, langid.featurize):
        every = featurize(texts)
        for i, t in enumerate(texts):
            assert np.array_equal(every[i], featurize([t])[0])
        assert np.array_equal(featurize(texts[::-1])[::-1], every)


def test_rows_in_any_order_and_labels_that_differ(spark):
    rows = make(120, seed=4)
    labels = [(d, int(q)) for d, _, q in rows if d % 2]
    table = lambda r, n: spark.createDataFrame([(d, t) for d, t, _ in r], "doc_id long, text string").repartition(n)
    key = lambda r: (r.doc_id, r.kept, r.probability)
    given = spark.createDataFrame(labels, "doc_id long, quality int")
    want = sorted(map(key, quality.rules(table(rows, 1), given).collect()))
    both = spark.createDataFrame([*labels, *labels[:9], (2, 0), (2, 1), (4, 1), (4, 0), (None, 1)], "doc_id long, quality int")
    got = sorted(map(key, quality.rules(table(rows[::-1], 5), both).collect()))
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert max(abs(g[2] - w[2]) for g, w in zip(got, want, strict=True)) < 0.02  # prior counts all labels


def test_rows_without_zeros_equal_dense_ones():
    rng = np.random.default_rng(5)
    x = (rng.random((300, 40)) * (rng.random((300, 40)) < 0.2)).astype(np.float32)
    x[[0, 127, 128, 299]] = 0
    rows, w = logit.Rows.dense(x), rng.random((40, 3)).astype(np.float32)
    assert np.array_equal(np.concatenate([part.copy() for _, _, part in rows.chunks()]), x)
    assert np.allclose(rows.dot(w), x @ w, atol=1e-5)
    some = np.array([299, 3, 128, 7])
    assert np.array_equal(next(rows.take(some).chunks())[2], x[some])
    none = logit.Rows.dense(np.zeros((0, 40)))
    assert len(none) == 0 and not list(none.chunks()) and none.dot(w).shape == (0, 3)
