import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from pagemill.llm import simhash


def brute(rows, size=3, distance=2):
    out = {}
    for d, t in rows:
        w = (t or "").encode().lower().split()
        grams = [b" ".join(w[i : i + size]) for i in range(max(1, len(w) - size + 1))] if w else []
        hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        out[d] = sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))
    ids, root = sorted(out), {}
    for d in ids:
        root[d] = d
    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if (out[a] ^ out[b]).bit_count() <= distance:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {(d, f"{out[d]:016x}", find(d)) for d in ids}


def texts(n=300, seed=1):
    rng = random.Random(seed)
    vocabulary = ["The", "of", "and", "Zug", "été", *(f"w{i}" for i in range(60))]
    base = [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(0, 40))) for _ in range(n // 3)]
    rows = list(base)
    while len(rows) < n:
        w = rng.choice(base).split()
        if w and rng.random() < 0.6:
            w[rng.randrange(len(w))] = "edit"
        rows.append("  ".join(w))
    return [(i, t) for i, t in enumerate(rows)] + [(n, None), (n + 1, ""), (n + 2, " \t\n")]


def test_components_match_brute_force(spark):
    rows = texts()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {tuple(r) for r in simhash.near_duplicates(df).collect()}
    assert got == brute(rows)


def test_large_blocks_lose_no_link(spark, monkeypatch):
    rng = random.Random(3)
    fps = {rng.getrandbits(64) for _ in range(50)}
    for base in list(fps)[:6]:
        for _ in range(40):
            f = base
            for _ in range(rng.randrange(1, 4)):
                f ^= 1 << rng.randrange(64)
            fps.add(f)
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    df = spark.createDataFrame(signed, "fp long")
    from pagemill.llm.graph import components

    def classes(limit):
        monkeypatch.setattr(simhash, "PAIRWISE", limit)
        return {(r.node, r.label) for r in components(simhash.links(df)).collect()}

    every = classes(10**6)
    assert every == classes(2)
    nodes = {n for n, _ in every}
    wide = 2**64 - 1
    for (a,) in signed:
        near = any(b != a and ((a ^ b) & wide).bit_count() <= 2 for (b,) in signed)
        assert near == (a in nodes)


def test_large_blocks_at_one_bit(spark, monkeypatch):
    from pagemill.llm.graph import components

    rng = random.Random(8)
    base, fps = rng.getrandbits(62), set()
    for _ in range(60):
        f = base
        for _ in range(rng.randrange(1, 4)):
            f ^= 1 << rng.randrange(20)
        fps.add(f)
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    found = {}
    for limit in (10**6, 2):
        monkeypatch.setattr(simhash, "PAIRWISE", limit)
        found[limit] = {(r.node, r.label) for r in components(simhash.links(df, 1)).collect()}
        assert simhash.links(df, 0).count() == 0
    assert found[2] == found[10**6] and {n for n, _ in found[2]} == {a for a in fps if any((a ^ b).bit_count() == 1 for b in fps)}


def test_extra_columns_nulls_and_no_rows(spark):
    df = spark.createDataFrame([(1, "a b c d", 5, "x"), (1, "a b c d", 6, "y"), (None, "a b c d", 7, "z")], "doc_id long, text string, fp int, component_id string")
    got = simhash.near_duplicates(df).collect()
    assert sorted(str(r.doc_id) for r in got) == ["1", "1", "None"]
    assert {r.component_id for r in got} == {1}
    assert simhash.near_duplicates(df.where("false")).count() == 0


def described(spark, rows):
    """Nodes with their rows as the pipeline's stage describes them."""
    none = (np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return simhash._described(df, 5, 0.8, none).withColumnRenamed("doc_id", "node").cache()


def test_the_pipelines_stage_proposes_by_simhash(spark):
    rng = random.Random(5)
    base = [f"w{rng.randrange(9999)}" for _ in range(3000)]
    other = [f"v{rng.randrange(9999)}" for _ in range(3000)]
    own = described(spark, [(1, " ".join(base)), (2, " ".join([*base[:-1], "edit"])), (3, " ".join(base).upper()), (4, " ".join(other))])
    fps = {r.node: r.fp & (2**64 - 1) for r in own.collect()}
    want = {(v, u) for u, a in fps.items() for v, b in fps.items() if u < v and (a ^ b).bit_count() <= 2}
    got = {(r.u, r.v) for r in simhash._simhash_pairs(own).collect()}
    assert got and got <= want and {(3, 1), (2, 1)} <= got and not any(4 in p for p in got)


def test_unlike_pairs_of_a_file_are_passed_over(spark):
    rng = random.Random(6)
    shared = [f"s{k}" for k in range(60)]
    rows = [(i, " ".join(shared + [f"w{rng.randrange(99999)}" for _ in range(240)])) for i in range(30)]
    copy = rows[0][1].split()
    copy[150] = "edit"
    rows.append((30, " ".join(copy)))
    own = described(spark, rows)
    bits = own.select("node", "level", "bits")
    files = simhash._files(own)
    members = [tuple(sorted(r.nodes)) for r in files.groupBy("key").agg(F.collect_list("node").alias("nodes")).collect()]
    assert len(members) == len(set(members)) and all(len(m) == len(set(m)) > 1 for m in members)
    label = spark.createDataFrame([], "node long, label long")
    assert {tuple(r) for r in simhash._across(simhash._mixed(files, label, bits), 0.8).collect()} == {(30, 0)}


def test_bit_sets_never_part_near_copies():
    rng = np.random.default_rng(7)
    for n in (3, 50, 500, 3000, 40_000):
        for _ in range(40):
            grams = rng.integers(0, 1 << 64, size=n + n // 9, dtype=np.uint64)
            one, two = grams[:n], grams[n // 9 :]
            (k, a), (m, b) = simhash._bit_set(one), simhash._bit_set(two)
            may = (len(one) + len(two)) / 9 / 4**k
            assert k == m and sum((int(x) ^ int(y)).bit_count() for x, y in zip(a.view(np.uint64), b.view(np.uint64), strict=True)) <= may + (8 * may**0.5 + 8 if k else 0)


def test_a_pair_is_compared_in_one_of_its_files(spark):
    rng = random.Random(8)
    base = [f"w{rng.randrange(99999)}" for _ in range(400)]
    rows = [(i, " ".join(f"e{i}" if k in (200, 201 + i) else w for k, w in enumerate(base))) for i in range(3)]
    # runs of shingles that other texts have too are files of their own, so each pair shares many
    rows += [(3 + k, " ".join(base[30 * k : 30 * k + 30] + [f"x{k}y{j}" for j in range(300)])) for k in range(12)]
    own = described(spark, rows)
    files = simhash._files(own)
    crowd = simhash._mixed(files, spark.createDataFrame([], "node long, label long"), own.select("node", "level", "bits"))
    met = simhash._compared(crowd.join(simhash._marks(files), "node"), 0.8)
    pairs = [(max(r.a, r.b), min(r.a, r.b)) for r in met.collect()]
    places = files.join(files.select("key", F.col("node").alias("other")), "key").where("node = 1 and other = 0").count()
    assert places > 3 and {(1, 0), (2, 0), (2, 1)} <= set(pairs) and len(pairs) == len(set(pairs))


def test_few_edges_are_solved_without_rounds(spark, monkeypatch):
    from pagemill.llm import graph

    rng = random.Random(9)
    edges = spark.createDataFrame([(rng.randrange(-500, 500), rng.randrange(-500, 500)) for _ in range(450)] + [(k, k + 1) for k in range(2000, 2040)], "u long, v long").cache()
    tables = []
    monkeypatch.setattr(graph, "saved", lambda df, name="table", keep=False, to=graph.saved: tables.append(name) or to(df, name, keep))
    few = {tuple(r) for r in graph.components(edges).collect()}
    assert tables == ["edges", "components"]
    monkeypatch.setattr(graph, "ALONE", 0)
    assert few == {tuple(r) for r in graph.components(edges).collect()} and len(tables) > 4
    assert graph.components(edges.where("false")).count() == 0
