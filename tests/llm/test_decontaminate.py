import random

import numpy as np
import pytest

from pagemill.llm import decontaminate as D


def plain_align(a, b):
    best, h = 0, [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
            best = max(best, h[i][j])
    return best


def test_alignment_matches_plain_dynamic_programming():
    rng = random.Random(1)
    for _ in range(200):
        a, b = ([rng.randrange(5) for _ in range(rng.randrange(1, 14))] for _ in range(2))
        score, n, i, j, k, m = D.align(np.array(a), np.array(b))
        assert score == plain_align(a, b)
        assert score == plain_align(a[i:j], b[k:m])
        assert n <= min(j - i, m - k)


def corpus(seed=2):
    rng = random.Random(seed)
    word = lambda: rng.choice(["the", "of", "and", "to"]) if rng.random() < 0.4 else f"w{rng.randrange(4000)}"
    items = [(i, " ".join(word() for _ in range(rng.randrange(18, 50)))) for i in range(20)]
    docs = []
    for d in range(200):
        w, held = [word() for _ in range(rng.randrange(0, 120))], None
        if d % 4 == 0:
            held, text = rng.choice(items)
            copy = text.upper().split()
            if d % 8 == 0:
                copy = [f"e{rng.randrange(99)}" if rng.random() < 0.12 else x for x in copy if rng.random() > 0.06]
            w[len(w) // 2 : len(w) // 2] = copy
        docs.append((d, " ".join(w), held))
    return docs, items


def test_planted_passages_and_edits_are_found(spark):
    docs, items = corpus()
    df = spark.createDataFrame([d[:2] for d in docs] + [(900, None), (901, ""), (None, "the of")], "doc_id long, text string")
    bench = spark.createDataFrame([*items, (50, None), (51, ""), (52, "the of and to"), items[0]], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in D.matches(df, bench).collect()}
    assert {(d, held) for d, _, held in docs if held is not None} == set(got)
    for d, text, held in docs:
        if held is not None and d % 8:
            r = got[d, held]
            assert r.similarity == 1.0
            assert " ".join(text.split()[r.doc_begin : r.doc_end]).lower() == items[held][1]
    left = D.decontaminate(df, bench)
    assert left.columns == df.columns
    assert sorted(str(r.doc_id) for r in left.collect()) == sorted([str(d) for d, _, h in docs if h is None] + ["900", "901", "None"])


def test_a_passage_in_most_documents_is_still_found(spark):
    docs, items = corpus(3)
    rows = [(d, f"{t} {items[0][1]}") for d, t, _ in docs]
    got = D.matches(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items[:1], "item_id long, text string"))
    assert got.count() == len(rows)


def test_slices_and_no_rows(spark, monkeypatch):
    docs, items = corpus(4)
    df = spark.createDataFrame([d[:2] for d in docs], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    whole = {tuple(r) for r in D.matches(df, bench).collect()}
    monkeypatch.setattr(D, "SLICE_BYTES", 1500)
    assert {tuple(r) for r in D.matches(df, bench).collect()} == whole
    assert D.matches(df, bench.where("false")).count() == 0
    assert D.matches(df.where("false"), bench).count() == 0


@pytest.mark.parametrize("n", [5000])
def test_long_runs_of_hits(spark, n, monkeypatch):
    monkeypatch.setattr(D, "_SPAN", 64)
    item = "alpha beta gamma delta epsilon zeta"
    text = " ".join([item.split()[i % 6] if i % 7 else "x" for i in range(n)]) + " " + item
    got = D.matches(spark.createDataFrame([(1, text)], "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    assert [r.similarity for r in got] == [1.0]


def test_short_items_need_more_than_a_few_words(spark):
    df = spark.createDataFrame([(1, "x alpha beta gamma y z"), (2, "x alpha beta gamma delta epsilon y"), (3, "alpha beta gamma delta q")], "doc_id long, text string")
    tests = spark.createDataFrame([(1, "alpha beta gamma delta epsilon")], "item_id long, text string")
    assert [(r.doc_id, r.similarity) for r in D.matches(df, tests).collect()] == [(2, 1.0)]


def test_short_items_of_common_words_are_found(spark):
    rng = random.Random(2)
    words = ["the", "of", "and", "to", "in", "is"]
    item = "of the and in to is"
    docs = [(i, " ".join(rng.choice(words[:3]) for _ in range(4000))) for i in range(40)] + [(i, " ".join(words[3:] * 1000)) for i in range(40, 80)]
    docs += [(100, "zebra " * 30 + item + " zebra" * 30)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    tests = spark.createDataFrame([(1, item)], "item_id long, text string")
    rows = [r for r in D.matches(df, tests).collect() if r.similarity == 1.0]
    assert [(r.doc_id, r.item_id, r.doc_begin, r.doc_end) for r in rows] == [(100, 1, 30, 36)]
