import os
import random
import time

import pytest

from pagemill.llm import pieces

MODEL = os.environ.get("PIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")


def small():
    texts = [pieces.SPACE, f"{pieces.SPACE}a", "a", "b", "ab", "aba", f"{pieces.SPACE}ab", "ba", "bb", pieces.SPACE * 2]
    rng = random.Random(1)
    vocab = {t: (i, -float(rng.randrange(1, 9))) for i, t in enumerate(texts)}
    decoded = [t.replace(pieces.SPACE, " ").encode() for t in texts] + [bytes([b]) for b in range(256)]
    return pieces.Vocabulary(vocab, list(range(10, 266)), decoded)


def every(v, text):
    s = f"{pieces.SPACE}{text.replace(' ', pieces.SPACE)}" if text else ""
    out = []

    def grow(at, ids, score):
        if at == len(s):
            out.append((score, ids))
        for end in range(at + 1, min(len(s), at + v.longest) + 1):
            hit = v.pieces.get(s[at:end])
            if hit:
                grow(end, (*ids, hit[0]), score + hit[1])
            elif end == at + 1:
                grow(end, ids + v.ids_of(s[at]), score + v.unknown)

    grow(0, (), 0.0)
    return sorted(out, key=lambda x: -x[0])


def test_nbest_matches_enumeration():
    v, rng = small(), random.Random(2)
    for _ in range(150):
        text = "".join(rng.choice("aabb  \né") for _ in range(rng.randrange(0, 9)))
        want = every(v, text)
        ids, score = v.encode(text)
        assert score == want[0][0] and (score, tuple(ids)) in want
        assert v.decode(ids) == text.encode()
        for n in (1, 2, 5):
            got = v.nbest(text, n)
            assert [s for _, s in got] == [s for s, _ in want[:n]]
            assert len({tuple(i) for i, _ in got}) == len(got)
            assert all((s, tuple(i)) in want for i, s in got)
            units = v.units(text)
            assert v.nbest_scores(units, [v.solve(u) for u in units], n) == [s for _, s in got]


def every_unit(v, unit):
    """All segmentations of a unit, best first."""
    if not unit:
        return [(0.0, ())]
    hits = [(v.pieces.get(unit[:k]), k) for k in range(1, len(unit) + 1)]
    steps = [((hit[0],), hit[1], k) for hit, k in hits if hit] + ([] if hits[0][0] else [(v.ids_of(unit[0]), v.unknown, 1)])
    return sorted(((s + score, ids + more) for ids, s, k in steps for score, more in every_unit(v, unit[k:])), key=lambda x: -x[0])


def looked_up(memory, units):
    ends, ids, scores, losses = memory.look(units)
    begins = [0, *ends.tolist()][:-1]
    return [(ids[a:b].tolist(), s, x) for a, b, s, x in zip(begins, ends.tolist(), scores.tolist(), losses.tolist(), strict=True)]


def test_units_solved_together_match_enumeration(monkeypatch):
    monkeypatch.setattr(pieces, "REMEMBERED", 60)
    monkeypatch.setattr(pieces, "TOGETHER", 7)
    monkeypatch.setattr(pieces, "SHORT", 6)
    v, rng = small(), random.Random(4)
    assert looked_up(v.memory, []) == []
    for _ in range(40):
        units = [u for _ in range(12) for u in v.units("".join(rng.choice("aaabbb  \né") for _ in range(rng.randrange(0, 12))))]
        for unit, (ids, score, loss) in zip(units, looked_up(v.memory, units), strict=True):
            want = every_unit(v, unit)
            assert score == want[0][0] and (score, tuple(ids)) in want
            assert loss == (want[0][0] - want[1][0] if len(want) > 1 else float("inf"))
            assert (pieces.packed(ids), score, loss) == v.solve(unit)
        assert len(v.memory.numbers) <= 60 + len(units)


@pytest.mark.skipif(not os.path.exists(MODEL), reason="no model file")
def test_new_units_cost_less_together_than_one_by_one():
    v, rng = pieces.Vocabulary.load(MODEL), random.Random(5)
    units = list({pieces.SPACE + "".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(4, 12))) + rng.choice(["", ",", "."]) for _ in range(20000)})
    looked_up(v.memory, ["warm", "up"]), v.solve("warmup")
    began = time.thread_time()
    ends, ids, scores, losses = v.memory.look(units)
    together = time.thread_time() - began
    began = time.thread_time()
    alone = [v.solve(u) for u in units]
    assert together < 0.7 * (time.thread_time() - began)
    assert ids.tobytes() == b"".join(a[0] for a in alone) and list(zip(scores, losses, strict=True)) == [a[1:] for a in alone]


@pytest.mark.skipif(not os.path.exists(MODEL), reason="no model file")
def test_round_trip_through_spark(spark):
    texts = ["Hello  wörld\n a\tb", "", None, " x ", "梦 \U0001f600 end", f"a{pieces.SPACE}b", "z" * 3000, "\n\n", "The cat sat.\nOn it"]
    df = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)] + [(None, "x", 1), (3, " x ", 2)], "doc_id long, text string, ids int")
    got = pieces.encode(df, MODEL)
    rows = got.collect()
    assert len(rows) == len(texts) + 2
    for r in rows:
        assert r.round_trip == (r.doc_id != 5) and r.n_pieces == len(r.ids)
        assert r.nbest_scores[0] == r.score and sorted(r.nbest_scores, reverse=True) == r.nbest_scores
    back = {r.doc_id: r.text for r in pieces.decode(got, MODEL).collect() if r.doc_id is not None}
    assert back == {i: (t or "").replace(pieces.SPACE, " ") for i, t in enumerate(texts)}
    assert pieces.encode(df.where("false"), MODEL).count() == 0
    every = pieces.encode(df, MODEL, segmentations=True).collect()
    assert sorted(map(str, (r[:6] for r in every))) == sorted(map(str, (tuple(r) for r in rows)))
    for r in every:
        assert len(r.nbest_ids) == len(r.nbest_scores) == len({tuple(x) for x in r.nbest_ids}) and r.nbest_ids[0] == r.ids


@pytest.mark.skipif(not os.path.exists(MODEL), reason="no model file")
def test_the_query_gives_the_nbest_segmentations(spark, tmp_path):
    from pagemill.llm.queries import QUERIES

    texts = ["Hello  wörld\n a\tb", "", None, "The cat sat.\nOn it"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    v = pieces.Vocabulary.load(MODEL)
    rows = QUERIES["op1_sentencepiece"](spark, str(tmp_path)).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert [(i, s) for i, s in zip(r.nbest_ids, r.nbest_scores, strict=True)] == v.nbest(texts[r.doc_id] or "", 3)
        assert r.nbest_ids[0] == r.ids and all(v.decode(i) == (texts[r.doc_id] or "").encode() for i in r.nbest_ids)
