import random

import corpus_pipeline
from pagemill.llm import simhash, substrings


def jaccard(a, b, k=5):
    grams = lambda t: {tuple(w[i : i + k]) for w in [t.lower().split()] for i in range(max(1, len(w) - k + 1))}
    x, y = grams(a), grams(b)
    return len(x & y) / len(x | y)


def near_rows(seed=1):
    rng = random.Random(seed)
    word = lambda: rng.choice(["the", "of", "and"]) if rng.random() < 0.3 else f"w{rng.randrange(9000)}"
    base = [[word() for _ in range(rng.randrange(60, 200))] for _ in range(60)]
    rows = [" ".join(b) for b in base]
    for b in base[:25]:
        for _ in range(rng.randrange(1, 5)):
            copy = list(b)
            for _ in range(rng.randrange(0, 1 + len(b) // 70)):
                copy[rng.randrange(len(copy))] = word()
            rows.append(rng.choice([" ", "\n"]).join(copy).upper())
    for _ in range(90):  # a crowd of near copies
        copy = list(base[30])
        copy[rng.randrange(len(copy))] = word()
        rows.append(" ".join(copy))
    rng.shuffle(rows)
    return list(enumerate(rows))


def test_one_document_of_each_group_stays(spark):
    rows = near_rows()
    root = {d: d for d, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in rows:
        for j, b in rows[:i]:
            if jaccard(a, b) >= 0.8:
                x, y = sorted((find(i), find(j)))
                root[y] = x
    df = spark.createDataFrame([*((d, t, "en", "s", len(t)) for d, t in rows), (None, rows[0][1], None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    groups = {r.doc_id: r.group_id for r in simhash.similar_groups(df).collect()}
    assert groups == {d: find(d) for d, _ in rows}
    left = simhash.one_of_each(df)
    assert left.columns == df.columns
    assert sorted(str(r.doc_id) for r in left.collect()) == sorted([str(d) for d in root if find(d) == d] + ["None"])


def test_passages_are_cut_and_other_rows_stay(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(1, f"one\n{passage}\nend", "x", 0), (2, f"two {passage}  tail", "y", 5), (3, "a\n b", "z", 3), (4, passage, "q", 7), (None, passage, "n", None), (5, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    clashing = substrings.without_repeats(df.withColumnRenamed("source", "_block"))
    assert clashing.columns == ["doc_id", "text", "_block", "n_chars"] and clashing.count() == 5
    got = {(r.doc_id, r.text, r.source, r.n_chars) for r in substrings.without_repeats(df).collect()}
    assert got == {rows[0], (2, "two tail", "y", 8), rows[2], rows[4], rows[5]}
    assert substrings.without_repeats(df.where("false")).schema == df.schema


def test_stages_run_one_after_another(spark, tmp_path):
    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(6000)}"
    bench = [(i, " ".join(f"b{rng.randrange(9999)}" for _ in range(30))) for i in range(40)]
    docs, labels, kind = [], [], {}
    for d in range(300):
        text = [word() for _ in range(rng.randrange(40, 90))]
        bad = d % 5 == 0
        kind[d] = "bad" if bad else "clean"
        if bad:
            text = [f"{w}%%%" for w in text]
        elif d % 11 == 0:
            kind[d], text = "leak", text[:20] + bench[d // 11][1].split() + text[20:]
        docs.append((d, " ".join(text), "en", "s", 1))
        if d % 2:
            labels.append((d, int(not bad), 0))
    docs.append((300, docs[1][1], "en", "s", 1))
    for name, rows, schema in (("documents", docs, "doc_id long, text string, lang string, source string, n_chars long"), ("labels", labels, "doc_id long, quality int, toxic int"), ("benchmark", bench, "item_id long, text string")):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = now.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        now = stage(spark, now, str(tmp_path))
        if k < 4:
            assert now.columns == columns, name
            now.write.parquet(f"{tmp_path}/stage{k}")
            now = spark.read.parquet(f"{tmp_path}/stage{k}")
    got = sorted(now.collect())
    assert {r.doc_id for r in got} == {d for d, k in kind.items() if k == "clean"}
    assert all(r.round_trip for r in got)
    assert sorted(corpus_pipeline.run(spark, str(tmp_path)).collect()) == got


def test_stages_take_nulls_no_rows_and_clashing_columns(spark, tmp_path):
    long = " ".join(f"w{i}" for i in range(40))
    very_long = " ".join(f"v{i}" for i in range(30_000))
    docs = [(1, long, None, None, None, 1), (1, long, None, None, None, 1), (2, None, "en", None, 3, 2), (3, "", "en", "s", 0, 3), (None, long, "en", "s", 9, 4), (None, None, None, None, None, None), (4, very_long, "en", "s", 9, 5), (5, very_long, "en", "s", 9, 6)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, label int"
    labels = spark.createDataFrame([(1, None, None), (None, 1, 1), (9, 0, 0)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(None, "a b c d e f"), (1, None)], "item_id long, text string")
    for name, rows in (("full", docs), ("none", [])):
        for table, df in (("documents", spark.createDataFrame(rows, schema)), ("labels", labels if rows else labels.where("false")), ("benchmark", bench if rows else bench.where("false"))):
            df.write.parquet(f"{tmp_path}/{name}/{table}.parquet")
        now = spark.read.parquet(f"{tmp_path}/{name}/documents.parquet")
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            now = stage(spark, now, f"{tmp_path}/{name}")
            assert k == 4 or now.columns == [c.split()[0] for c in schema.split(", ")]
            now.write.parquet(f"{tmp_path}/{name}-{k}")
            now = spark.read.parquet(f"{tmp_path}/{name}-{k}")
        # rows without words go, rows of one doc_id or without an id stay
        assert sorted(str(r.doc_id) for r in now.collect()) == (["1", "1", "4", "None"] if rows else [])


def brute_groups(rows):
    root = {d: d for d, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in rows:
        for j, b in rows[:i]:
            if jaccard(a, b) >= 0.8:
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {d: find(d) for d, _ in rows}


def test_pairs_in_a_crowded_family_are_found(spark):
    """Form letters that share most words, under 0.8 to each other; each has one near copy."""
    rng = random.Random(5)
    frame = [f"f{rng.randrange(400)}" for _ in range(200)]
    rows = []
    for i in range(120):
        letter = frame[:86] + [f"own{i}x{k}" for k in range(20)] + frame[106:]
        copy = list(letter)
        for _ in range(4):
            copy[rng.randrange(len(copy))] = f"edit{i}"
        rows += [" ".join(letter), " ".join(copy)]
    rng.shuffle(rows)
    rows = list(enumerate(rows))
    want = brute_groups(rows)
    assert len(set(want.values())) == 120
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.group_id for r in simhash.similar_groups(df).collect()} == want


def test_copies_with_a_block_more_or_less_are_found(spark):
    """Texts at 0.8 or just over by one block cut off, put in or replaced, among many others."""
    rng = random.Random(9)
    rows = []
    for i in range(120):
        base = [f"v{rng.randrange(30000)}" for _ in range(300)]
        block = [f"v{rng.randrange(30000)}" for _ in range(rng.randrange(40, 64))]
        at, n = rng.randrange(200), len(block)
        rows += [base, [base[n:], base[:at] + block + base[at:], base[:at] + block[: n // 2] + base[at + n // 2 :]][i % 3]]
    rows = [(d, " ".join(t)) for d, t in enumerate(rows)]
    want = {d: d - (d % 2 and jaccard(t, rows[d - 1][1]) >= 0.8) for d, t in rows}
    assert sum(d != g for d, g in want.items()) > 100
    df = spark.createDataFrame(rows, "doc_id long, text string")
    others = spark.range(1000, 61000).selectExpr("id AS doc_id", "concat_ws(' ', 'a', id, 'b', id + 1, 'c', id + 2) AS text")
    got = simhash.similar_groups(df.unionByName(others)).where("doc_id < 1000 or doc_id <> group_id").collect()
    assert {r.doc_id: r.group_id for r in got} == want


def test_long_texts_at_the_limit_are_told_apart(spark):
    rng = random.Random(11)
    rows = []
    for i in range(60):
        base = [f"v{rng.randrange(90000)}" for _ in range(3000)]
        n = 635 + i  # shingles that one cut leaves out: 0.789 to 0.768; a cut of 600 leaves 0.8
        rows += [base, base[(n if i % 2 else 565 + i) :]]
    rows = [(d, " ".join(t)) for d, t in enumerate(rows)]
    want = {d: d - (d % 2 and jaccard(t, rows[d - 1][1]) >= 0.8) for d, t in rows}
    assert 10 < sum(d != g for d, g in want.items()) < 50
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.group_id for r in simhash.similar_groups(df).collect()} == want
