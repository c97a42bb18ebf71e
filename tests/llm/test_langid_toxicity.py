import random
import zlib

import pytest

from pagemill.llm import langid, toxicity

SYLLABLES = {"aa": ["the", "of", "ing", "tion", "wh"], "bb": ["der", "sch", "ung", "ß", "keit"], "cc": ["le", "eau", "é", "oi", "eux"], "dd": ["ción", "que", "ñ", "ado", "ll"]}


def lang_rows(n=400, seed=1):
    rng = random.Random(seed)
    out = []
    for d in range(n):
        lang = rng.choice(sorted(SYLLABLES))
        out.append((d, " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(15, 60))), lang))
    return out


def test_held_out_languages(spark):
    rows = [*lang_rows(), (900, None, "aa"), (901, "", "bb"), (902, "123 %% \n", "cc"), (None, "der schung keit", None), (3, "ción que", None)]
    df = spark.createDataFrame([(d, t, lang, "x") for d, t, lang in rows], "doc_id long, text string, lang string, score string")
    got = langid.identify(df).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.held_out == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1
    by = {r.doc_id: r.lang_pred for r in got if r.doc_id != 3}
    held = [(d, lang) for d, _, lang in rows if d is not None and d < 900 and d != 3 and zlib.crc32(str(d).encode()) % 4 == 2]
    assert sum(by[d] == lang for d, lang in held) >= 0.98 * len(held)
    assert [by[d] for d in (900, 901, 902)] == ["und"] * 3
    assert langid.identify(df.where("false")).count() == 0


@pytest.mark.parametrize("n", [2, 3, 5, 9, 30])
def test_codewords_are_apart(n):
    code = langid.codewords(n)
    apart = min((code[i] != code[j]).sum() for i in range(n) for j in range(i))
    assert apart >= max(1, code.shape[1] // 4)
    assert all(0 < c.sum() < n for c in code.T)


def test_one_language_or_none(spark):
    df = spark.createDataFrame([(i, "abc def", "aa") for i in range(20)], "doc_id long, text string, lang string")
    assert {(r.lang_pred, r.score) for r in langid.identify(df).collect()} == {("aa", 1.0)}
    assert {r.lang_pred for r in langid.identify(df.withColumn("lang", df.lang.substr(9, 1)).where("lang <> ''").unionByName(df.selectExpr("doc_id", "text", "cast(null as string) lang"))).collect()} == {"und"}


@pytest.mark.parametrize("text, want", [("1D10T!!", " idiot "), ("ѕtuріd, $cum", " stupid scum "), ("Été 2024 ok", " été ok "), ("", "  "), ("ＭＯＲＯＮ", " moron "), ("𝐦𝐨𝐫𝐨𝐧 s\u0336c\u0336um", " moron scum ")])
def test_folding(text, want):
    assert toxicity.fold(text) == want


def test_exceptions_and_stems():
    lex = toxicity.Lexicon({" trash ": 3.0, " lowe": 2.0}, ("trash can",))
    assert lex.matches(toxicity.fold("a TRA5H can, tr4sh! loweisch slowest")) == [3.0, 2.0]
    assert lex.matches(toxicity.fold("trash can")) == []


def tox_rows(n=600, seed=2):
    rng, out = random.Random(seed), []
    for d in range(n):
        toxic = d % 5 == 0
        w = [rng.choice(["the", "été", *(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}x" for i in range(300))]) for _ in range(rng.randrange(10, 80))]
        if toxic:
            for _ in range(rng.randrange(2, 5)):
                w.insert(rng.randrange(len(w)), rng.choice(["idiot", "1d1ot", "scum", "зcum".replace("з", "s"), "vequ" + rng.choice(["la", "mo", "ta", "re"])]))
        out.append((d, " ".join(w), int(toxic)))
    return out


def test_held_out_toxicity(spark):
    rows = tox_rows()
    docs = spark.createDataFrame([(d, t, 0.5) for d, t, _ in rows] + [(900, None, 0.0), (901, "", 0.0), (None, "idiot", 0.0), (5, rows[5][1], 0.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(d, y) for d, _, y in rows], "doc_id long, toxic int")
    got = toxicity.toxicity(docs, labels).collect()
    assert len(got) == len(rows) + 4
    want = {d: y for d, _, y in rows}
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 900]
    assert len(held) > 100
    assert sum(r.predicted == want[r.doc_id] for r in held) >= 0.98 * len(held)
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
        assert r.held_out == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
    assert {r.score for r in toxicity.toxicity(docs, labels.where("false")).collect()} == {0.0}
    assert toxicity.toxicity(docs.where("false"), labels).count() == 0
