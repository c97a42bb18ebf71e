"""End to end: pages to items, unified categories, page texts and a summary by language."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.functions import categories as C
from pagemill.functions import html as H
from pagemill.functions.text import BLANK_LINE, in_order
from pagemill.plans.inputs import table
from pagemill.plans.registry import query


def page_items(pages: DataFrame) -> DataFrame:
    """page_id, lang, item_pos, category, text: title, headings and list entries of raw pages."""
    entry = lambda label, texts: F.transform(texts, lambda t: F.struct(F.lit(label).alias("category"), t.alias("text")))
    listed = F.transform(F.regexp_extract_all("html", F.lit("<li>(?:<a [^>]*>)?([^<]*)"), 1), H.unescaped)
    items = F.concat(entry("doc_title", F.array(H.title(F.col("html")))), entry("Section-header", H.tagged(F.col("html"), "h1")), entry("List-item", listed))
    lang = F.regexp_extract("html", '<html lang="([^"]*)"', 1)
    return pages.select("page_id", lang.alias("lang"), F.posexplode(items).alias("item_pos", "x")).select("page_id", "lang", "item_pos", "x.category", "x.text")


_ITEMS = f"""raw AS (
  SELECT page_id, regexp_extract(html, '<html lang="([^"]*)"', 1) AS lang,
    list_concat(list_concat([{{'category': 'doc_title', 'text': regexp_extract(html, '<title>([^<]*)</title>', 1)}}],
      list_transform(regexp_extract_all(html, '<h1>([^<]*)</h1>', 1), lambda t: {{'category': 'Section-header', 'text': t}})),
      list_transform(regexp_extract_all(html, '<li>(?:<a [^>]*>)?([^<]*)', 1), lambda t: {{'category': 'List-item', 'text': t}})) AS items FROM pages),
items AS (SELECT page_id, lang, generate_subscripts(items, 1) - 1 AS item_pos, unnest(items).category AS category, unnest(items).text AS raw_text FROM raw),
plain AS (SELECT page_id, lang, item_pos, {C.sql_case(C.UNIFIED, "translate(lower(category), '- ', '__')", C.OTHER)} AS unified, {{0}} AS text FROM items)"""


def _sql() -> str:
    x = "raw_text"
    for name, char in H._ENTITIES:
        x = f"""replace({x}, '{name}', '{char.replace("'", "''")}')"""
    return _ITEMS.replace("{0}", x)


@query(f"""WITH {_sql()}, texts AS (SELECT page_id, lang, string_agg(text, chr(10) || chr(10) ORDER BY item_pos) AS markdown, count(*) AS n, CAST(count(*) FILTER (unified = 'title') AS BIGINT) AS titles FROM plain GROUP BY page_id, lang)
SELECT lang, count(*) AS n_pages, CAST(sum(n) AS BIGINT) AS n_items, CAST(sum(titles) AS BIGINT) AS n_titles, CAST(sum(length(markdown)) AS BIGINT) AS n_chars FROM texts GROUP BY lang""")
def page_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = page_items(table(spark, sf_dir, "pages")).withColumn("unified", C.unified(F.col("category")))
    texts = items.groupBy("page_id", "lang").agg(in_order(F.col("text"), F.col("item_pos"), separator=BLANK_LINE).alias("markdown"), F.count("*").alias("n"), F.count_if(F.col("unified") == "title").alias("titles"))
    return texts.groupBy("lang").agg(F.count("*").alias("n_pages"), F.sum("n").alias("n_items"), F.sum("titles").alias("n_titles"), F.sum(F.length("markdown")).alias("n_chars"))
