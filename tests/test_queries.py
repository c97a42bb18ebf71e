"""Every query with SQL gives the rows that DuckDB gives for it."""

import decimal
import math
import os

import duckdb
import pytest

from pagemill.plans import document_queries, flagship, geometry_queries, layout_queries, parser_queries, web_queries  # noqa: F401
from pagemill.plans.registry import ORACLE_SQL, QUERIES

DATA = os.environ.get("QUERY_DATA", "/root/testdata/sf0.001")
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "benchmark", "conversations")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


@pytest.fixture(scope="module")
def con():
    out = duckdb.connect()
    for t in TABLES:
        out.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return out


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return "nan" if math.isnan(v) else f"{float(v):.9g}"
    return str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, DATA)
    got = df.collect()
    assert got
    if name in ORACLE_SQL:
        want = con.execute(ORACLE_SQL[name])
        columns = [d[0] for d in want.description]
        assert sorted(columns) == sorted(df.columns)
        order = [columns.index(c) for c in sorted(columns)]
        assert sorted(tuple(plain(r[c]) for c in sorted(columns)) for r in got) == sorted(tuple(plain(r[i]) for i in order) for r in want.fetchall())


def test_joins_have_keys(spark):
    """No cartesian product, and range conditions are residuals of equi joins."""
    for name in ("cell_region_overlap", "hyperlink_merge", "item_uri_candidates", "nested_region_filter", "box_overlap"):
        plan = QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
        assert "Cartesian" not in plan and "NestedLoop" not in plan, name


def test_filters_and_columns_reach_the_scan(spark):
    plan = QUERIES["src_file_kinds"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<page_id:bigint,url:string>" in plan
    plan = QUERIES["retry_anti_join"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(o_orderstatus,F)" in plan
