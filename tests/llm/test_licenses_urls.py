import os
import re

import duckdb

from pagemill.llm import licenses, urls


def test_licenses_match_brute_force(spark):
    filler = "the été of 3 words and Zug "
    rows = [
        (1, filler * 9 + "Released under the MIT License. " + filler), (2, "MIT\nLICENSE mit-license; Apache  License"), (3, filler + "GNU General Public License, version 3."),
        (4, filler + "Licensed under CC BY-NC 4.0. " + filler), (5, "All rights reserved."), (6, filler * 50), (7, None), (8, ""), (None, "mit license"), (1, "mit license"),
        (9, "Redistribution and use in source and binary forms, with or without any modification, are permitted provided that the following conditions are met: " + filler),
        (10, "mitlicense mit licenses emit license"), (11, "This work is licensed under the GNU General Public License, version 3.\n" * 3), (11, "This work is licensed under the GNU General Public License, version 3.\n" * 3),
    ]
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, label string, uid int")
    got = licenses.scan(df).collect()
    want = []
    for d, t in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        places = [(i, label) for p, label in licenses.PHRASES for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        at = [i for i, _ in places]
        want.append((d, len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))))
    assert sorted(map(str, want)) == sorted(str(tuple(r)[:6]) for r in got)
    labels = {(r.doc_id, r.n_words): (r.labels, r.score) for r in got}
    assert [labels[d, n][0] for d, n in sorted(k for k in labels if k[0] in (4, 5, 9))] == ["cc-by-nc", "all-rights-reserved", "bsd"]
    for r in got:
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))
        assert (r.score > 0) == bool(r.labels) and 0 <= r.score <= 1
    assert max(v[1] for k, v in labels.items() if k[0] == 1) == 1.0
    assert licenses.scan(df.where("false")).count() == 0


def test_urls_match_sql(spark, tmp_path):
    hosts = ["a.example.com", "b.example.com", "EXAMPLE.net", "x.example.net", "deep.x.example.net", "spam.example.org", "fine.example.org", "shop.co.uk", "a.shop.co.uk", "localhost", "notnet", "net", "x.org", "user:pw@a.example.com:8080", "10.0.0.7", "[::1]:80"]
    rows = []
    for i in range(400):
        h = hosts[i % len(hosts)]
        rows.append((i, f"http{'s' * (i % 2)}://{h}{['/en/1', '/de/x?y=/fr/', '/fr/2#a://b', '', '/', '?q', '/EN/', '#top'][i % 8]}"))
    rows += [(900, None), (901, ""), (902, "no scheme/net/"), (903, "://"), (None, "https://x.example.net/en/"), (3, rows[3][1]), (904, "a://b\n://c.net/en/x")]
    pages = spark.createDataFrame([(i, u, "allow") for i, u in rows], "page_id long, url string, verdict string")
    labels = spark.createDataFrame([(i, int(hosts[i % len(hosts)] != "spam.example.org" and i % 10 != 0)) for i in range(400) if i % 3], "doc_id long, quality int")
    got = urls.judge(pages, urls.page_outcomes(labels)).drop("bad_bound").toPandas()
    con = duckdb.connect()
    p, l = pages.toPandas(), labels.toPandas()
    con.register("pages", p)
    con.register("labels", l)
    want = con.sql(urls.ORACLE).df()
    fix = lambda df: sorted(map(str, df[["page_id", "host", "path", "rule", "verdict"]].astype(object).where(df.notna(), None).values.tolist()))
    assert [x.replace(".0", "") for x in fix(got)] == [x.replace(".0", "") for x in fix(want)]
    assert len(got) == len(rows)
    assert set(got[(got.host == "spam.example.org") & got.rule.isna()].verdict) == {"block"}
    assert set(got[got.host == "fine.example.org"].verdict) == {"allow"}
    assert urls.judge(pages.where("false"), urls.page_outcomes(labels.where("false"))).count() == 0
    assert set(urls.judge(pages, urls.page_outcomes(labels.where("false"))).where("rule is null").toPandas().verdict) == {"allow"}


def test_repeated_short_templates_do_not_cancel(spark):
    one = "All rights reserved."
    every = spark.createDataFrame([(k, " ".join([one] * k)) for k in range(1, 51)], "doc_id long, text string")
    assert {(r.labels, r.score) for r in licenses.scan(every).collect()} == {("all-rights-reserved", 1.0)}
    texts = [f"{one} 2020 {one}", " ".join([one] * 3), " ".join([one] * 40), f"{one} a b c d e f {one}"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.labels, r.score) for r in licenses.scan(df).collect()}
    assert got == {d: ("all-rights-reserved", 1.0) for d in range(4)}
