"""Queries without SQL on small tables where a prefix or a subset would show."""

import re

import pytest

from pagemill.plans.registry import QUERIES
from pagemill.plans import web_queries  # noqa: F401


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("tables"))
    text = " ".join(f"word{i}" for i in range(200))
    ids = [7, 500, 1500, 4545]
    spark.createDataFrame([(d, text) for d in ids], "doc_id long, text string").write.parquet(f"{out}/documents.parquet")
    lines = [(d, n, 10 * n + 3, 5 * n, 1.5, "1997-01-01") for d in ids for n in range(1, 8)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_extendedprice double, l_shipdate string").write.parquet(f"{out}/lineitem.parquet")
    items = [(i, f"no such item{i} here at all") for i in range(100)]
    items[45] = (45, "x y word50 word51 word52 word53 z")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    return out


def test_annotate_items_takes_all_pages(spark, tables):
    by = {}
    for r in QUERIES["annotate_items"](spark, tables).collect():
        by.setdefault(r.page_id, set()).add((r.item_pos, r.text))
    assert by[7] and set(by) == {7, 500, 1500, 4545} and len({frozenset(x) for x in by.values()}) == 1


def test_annotate_page_text_takes_whole_texts(spark, tables):
    rows = QUERIES["annotate_page_text"](spark, tables).collect()
    assert len(rows) == 4
    for r in rows:
        plain = re.sub(r"\[([^\]]*)\]\([^)]*\)", r"\1", r.text)
        assert plain.split() == [f"word{i}" for i in range(200)]


def test_fuzzy_best_match_asks_all_items(spark, tables):
    rows = {r.doc_id: r for r in QUERIES["fuzzy_best_match"](spark, tables).collect()}
    text = " ".join(f"word{i}" for i in range(200))
    s = text.index("word50 word51")
    assert set(rows) == {7, 500, 1500, 4545}
    assert (rows[4545].phrase, rows[4545].s, rows[4545].e) == ("word50 word51 word52 word53", s, s + len("word50 word51 word52 word53"))


def test_merged_links_deal_the_cells_out_once(spark):
    from pagemill.operators.layout import merged_links

    cells = spark.createDataFrame([(p, n, 10 * n, 0, 10 * n + 8, 10, f"c{n}") for p in (1, 2) for n in range(4)] + [(1, 3, 500, 0, 508, 10, "twin")], "page_id long, cell_pos int, l int, t int, r int, b int, text string")
    links = spark.createDataFrame([(1, 7, 0, 0, 30, 10, "late"), (1, 2, 10, 0, 20, 10, "early"), (1, 9, 30, 0, 40, 10, "end"), (3, 1, 0, 0, 99, 99, "none")], "page_id long, link_pos int, l int, t int, r int, b int, uri string")
    out = merged_links(cells, links)
    rows = sorted((r.page_id, r.out_pos, r.text, r.uri) for r in out.collect())
    assert rows == [(1, 1, "c1", "early"), (1, 2, "c0 c2", "late"), (1, 3, "c3 twin", "end")] + [(2, n + 1, f"c{n}", None) for n in range(4)]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert sum(line.lstrip(" :+-").startswith("Join") for line in plan.splitlines()) == 2  # one in each part of the union: cells aren't joined with themselves


def test_annotated_cells_are_the_annotated_lines_of_the_same_cells(spark):
    from pagemill.operators.layout import lines
    from pagemill.operators.links import annotated_cells, annotated_pages

    words = ["plain", "two words", " padded\t", "a\nb", "", " ", None, "größe", "\U0001f600", "x"]
    rows = []
    for page in range(12):
        for n in range(page * 4):
            k = n * 7 + page
            uri = [None, "", f"u{k % 5}", f"v{k % 3}"][k % 4] if page % 5 else f"w{n}"
            t = (n // 5) * 20 + k % 13 - 6 * (k % 11 == 0)
            rows.append((page, n, (k * 37) % 90, t, t + 5 + k % 9, words[k % len(words)] if page != 3 else None, uri))
    rows.append((50, 0, 0, 0, 9, None, None))
    cells = spark.createDataFrame(rows, "page_id long, cell_pos int, l int, t int, b int, text string, uri string").repartition(3)
    out = annotated_cells(cells)
    assert {r.page_id: r.text for r in out.collect()} == {r.page_id: r.text for r in annotated_pages(lines(cells.drop("uri")), cells).collect()}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [") == 1 and "Join" not in plan  # the cells are dealt out once
