"""Inputs of the queries, derived from the raw tables by integer arithmetic.

Each view has a Spark form and an SQL form (a ``WITH`` list without the keyword) with equal rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Raw layout labels of the regions, by category number.
LABELS = ("Table", "Picture", "chart", "figure_caption", "Footnote", "Page-footer", "Page-header", "Section-header", "List-item", "display_formula", "Text", "aside_text", "Code-Block", "Diagram", "footer_image", "doc_title")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layout regions on pages of 1000 x 1000: page_id, item_pos, l, t, r, b, cat_id, category, text."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    part = F.col("l_partkey")
    left = ((part * 7 + F.col("l_linenumber") * 131) % 900).cast("int")
    top = ((F.col("l_suppkey") * 13 + F.col("l_linenumber") * 173) % 900).cast("int")
    cat = (part % 16).cast("int")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("page_id"), F.row_number().over(order).alias("item_pos"), left.alias("l"), top.alias("t"),
        (left + 20 + (part % 80).cast("int")).alias("r"), (top + 10 + (part % 60).cast("int")).alias("b"), cat.alias("cat_id"),
        F.element_at(F.array(*map(F.lit, LABELS)), cat + 1).alias("category"), F.concat(F.lit("item "), part.cast("string")).alias("text"),
    )


REGIONS = f"""regions AS (
  SELECT l_orderkey AS page_id,
    CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS INT) AS item_pos,
    CAST((l_partkey * 7 + l_linenumber * 131) % 900 AS INT) AS l, CAST((l_suppkey * 13 + l_linenumber * 173) % 900 AS INT) AS t,
    CAST((l_partkey * 7 + l_linenumber * 131) % 900 AS INT) + 20 + CAST(l_partkey % 80 AS INT) AS r,
    CAST((l_suppkey * 13 + l_linenumber * 173) % 900 AS INT) + 10 + CAST(l_partkey % 60 AS INT) AS b,
    CAST(l_partkey % 16 AS INT) AS cat_id, (ARRAY{list(LABELS)})[l_partkey % 16 + 1] AS category,
    concat('item ', CAST(l_partkey AS VARCHAR)) AS text
  FROM lineitem)"""


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of regions of a page, the first one earlier: page_id, a_pos, b_pos, a_l .. a_b, b_l .. b_b."""
    own = regions(spark, sf_dir)
    side = lambda p: own.select("page_id", F.col("item_pos").alias(f"{p}_pos"), *(F.col(c).alias(f"{p}_{c}") for c in "ltrb"))
    return side("a").join(side("b"), "page_id").where("a_pos < b_pos")


PAIRS = (
    REGIONS
    + """, pairs AS (
  SELECT a.page_id, a.item_pos AS a_pos, b.item_pos AS b_pos, a.l AS a_l, a.t AS a_t, a.r AS a_r, a.b AS a_b,
    b.l AS b_l, b.t AS b_t, b.r AS b_r, b.b AS b_b
  FROM regions a JOIN regions b ON a.page_id = b.page_id AND a.item_pos < b.item_pos)"""
)


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word cells of every document, ten to a line: page_id, cell_pos, l, t, r, b, text."""
    words = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", " ")).alias("pos", "w")).where(F.length("w") > 0)
    left, top = F.col("pos") % 10 * 90 + 5, F.floor(F.col("pos") / 10).cast("int") * 22 + F.col("pos") * 7 % 5
    return words.select(F.col("doc_id").alias("page_id"), F.col("pos").alias("cell_pos"), left.alias("l"), top.alias("t"), (left + 8 * F.length("w")).alias("r"), (top + 14).alias("b"), F.col("w").alias("text"))


CELLS = """cells AS (
  SELECT doc_id AS page_id, CAST(pos AS INT) AS cell_pos, CAST((pos % 10) * 90 + 5 AS INT) AS l, CAST((pos // 10) * 22 + (pos * 7) % 5 AS INT) AS t,
    CAST((pos % 10) * 90 + 5 + 8 * length(w) AS INT) AS r, CAST((pos // 10) * 22 + (pos * 7) % 5 + 14 AS INT) AS b, w AS text
  FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS w, generate_subscripts(string_split(text, ' '), 1) - 1 AS pos FROM documents)
  WHERE length(w) > 0)"""


def uri_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``cells`` with a uri on every seventh word of the first line of a page's blocks."""
    n = F.col("cell_pos")
    uri = F.when(n % 7 == 0, F.concat(F.lit("https://link.example/"), (F.floor(n / 14).cast("int") % 5).cast("string"))).when(n % 7 == 3, "")
    return cells(spark, sf_dir).withColumn("uri", uri)


URI_CELLS = (
    CELLS
    + """, uri_cells AS (
  SELECT *, CASE WHEN cell_pos % 7 = 0 THEN concat('https://link.example/', CAST((cell_pos // 14) % 5 AS VARCHAR)) WHEN cell_pos % 7 = 3 THEN '' END AS uri FROM cells)"""
)


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of every page: page_id, link_pos, uri, text."""
    pattern = F.lit('<a href="([^"]*)">([^<]*)</a>')
    both = F.arrays_zip(F.regexp_extract_all("html", pattern, 1).alias("uri"), F.regexp_extract_all("html", pattern, 2).alias("text"))
    return table(spark, sf_dir, "pages").select("page_id", F.posexplode(both).alias("link_pos", "x")).select("page_id", "link_pos", "x.uri", "x.text")


LINKS = """links AS (
  SELECT page_id, CAST(generate_subscripts(u, 1) - 1 AS INT) AS link_pos, unnest(u) AS uri, unnest(x) AS text FROM (
    SELECT page_id, regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1) AS u, regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2) AS x FROM pages))"""


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page results of a run: doc_id, page_number, prompt_tokens, completion_tokens, latency, is_error."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("doc_id"), F.col("event_id").alias("page_number"), F.floor(F.col("value") * 10).cast("int").alias("prompt_tokens"),
        F.when(F.col("event_id") % 3 != 0, F.floor(F.col("value") * 30).cast("int")).alias("completion_tokens"), (F.col("event_id") % 997).alias("latency_ms"), (F.col("event_type") == "error").alias("is_error"),
    )


USAGE = """usage AS (
  SELECT user_id AS doc_id, event_id AS page_number, CAST(floor(value * 10) AS INT) AS prompt_tokens,
    CASE WHEN event_id % 3 <> 0 THEN CAST(floor(value * 30) AS INT) END AS completion_tokens, event_id % 997 AS latency_ms, event_type = 'error' AS is_error
  FROM events)"""
