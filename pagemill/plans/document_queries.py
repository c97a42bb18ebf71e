"""Files, page selection, texts, categories and roll-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagemill.functions import categories as C
from pagemill.functions import text as T
from pagemill.operators import documents as D
from pagemill.plans.inputs import REGIONS, URI_CELLS, USAGE, regions, table, uri_cells, usage
from pagemill.plans.registry import query

_FILES = "concat(split_part(split_part(url, '?', 1), '#', 1), ['.pdf', '.PNG', '.html', '', '.jpeg'][page_id % 5 + 1])"


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.split_part(F.split_part("url", F.lit("?"), F.lit(1)), F.lit("#"), F.lit(1))
    ending = F.element_at(F.array(*map(F.lit, (".pdf", ".PNG", ".html", "", ".jpeg"))), (F.col("page_id") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "pages").select("page_id", F.concat(path, ending).alias("file"))


_NAME = "regexp_extract(file, '([^/]*)/*$', 1)"
_SUFFIX = f"lower(regexp_extract({_NAME}, '.([.][^.]+)$', 1))"
_KIND = f"CASE WHEN {{0}} = '.pdf' THEN 'pdf' WHEN {{0}} IN {D.IMAGE_SUFFIXES} THEN 'image' ELSE 'unsupported' END"


@query(f"WITH f AS (SELECT page_id, {_FILES} AS file FROM pages), s AS (SELECT *, {_SUFFIX} AS suffix FROM f) SELECT page_id, suffix, {_KIND.format('suffix')} AS kind FROM s")
def src_file_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    suffix = T.suffix(F.col("file"))
    return _files(spark, sf_dir).select("page_id", suffix.alias("suffix"), D.file_kind(suffix).alias("kind"))


@query(f"WITH f AS (SELECT page_id, {_FILES} AS file FROM pages) SELECT page_id, CASE WHEN {_SUFFIX} = '.pdf' THEN page_id % 9 + 1 ELSE 1 END AS n_pages FROM f")
def src_page_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _files(spark, sf_dir).select("page_id", D.page_count(T.suffix(F.col("file")), F.col("page_id") % 9 + 1).alias("n_pages"))


@query(f"""WITH f AS (SELECT page_id, {_FILES} AS file FROM pages), p AS (SELECT DISTINCT conv_id, turn FROM conversations)
SELECT conv_id, turn, concat(regexp_replace({_NAME}, '(.)[.][^.]*$', '\\1'), '/page_', lpad(CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS VARCHAR), 4, '0'), '.md') AS path
FROM p JOIN f ON f.page_id = p.conv_id""")
def md_page_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn").distinct()
    n = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    return turns.join(_files(spark, sf_dir), F.col("conv_id") == F.col("page_id")).select("conv_id", "turn", F.format_string("%s/page_%04d.md", T.stem(F.col("file")), n).alias("path"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%Hh%Mm%Ss') AS folder FROM orders")
def run_folder_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd'T'HH'h'mm'm'ss's'").alias("folder"))


@query(f"WITH {USAGE} SELECT doc_id, CASE WHEN bool_or(is_error) THEN 'errors' ELSE 'results' END AS outcome, CAST(count(*) FILTER (is_error) AS BIGINT) AS n_errors FROM usage GROUP BY doc_id")
def doc_outcome_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage(spark, sf_dir).groupBy("doc_id").agg(D.outcome(F.bool_or("is_error")).alias("outcome"), F.count_if("is_error").alias("n_errors"))


_TURNS = "turns AS (SELECT conv_id AS doc_id, turn AS page_pos, CASE WHEN turn % 3 <> 2 THEN text END AS text FROM (SELECT DISTINCT * FROM conversations))"


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as documents, turns as pages; every third page has no text."""
    return table(spark, sf_dir, "conversations").distinct().select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page_pos"), F.when(F.col("turn") % 3 != 2, F.col("text")).alias("text"))


@query(f"WITH {_TURNS} SELECT doc_id, coalesce(string_agg(text, chr(10) || chr(10) ORDER BY page_pos), '') AS text FROM turns GROUP BY doc_id")
def doc_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.document_texts(_turns(spark, sf_dir)).select("doc_id", "text")


@query(f"WITH {_TURNS} SELECT doc_id, string_agg(coalesce(text, ''), chr(10) || chr(10) ORDER BY page_pos) AS markdown FROM turns GROUP BY doc_id")
def doc_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.document_texts(_turns(spark, sf_dir)).select("doc_id", "markdown")


@query(f"WITH {_TURNS} SELECT concat('results/doc_', CAST(doc_id AS VARCHAR), '.md') AS path, string_agg(coalesce(text, ''), chr(10) || chr(10) ORDER BY page_pos) AS content FROM turns GROUP BY doc_id")
def doc_markdown_save(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.document_texts(_turns(spark, sf_dir)).select(F.format_string("results/doc_%d.md", "doc_id").alias("path"), F.col("markdown").alias("content"))


@query(f"""WITH {REGIONS} SELECT page_id, count(*) AS n_items, concat('[', string_agg(concat('{{"category":"', category, '","l":', l, ',"t":', t, ',"r":', r, ',"b":', b, ',"text":"', text, '"}}'), ',' ORDER BY item_pos), ']') AS items FROM regions GROUP BY page_id""")
def doc_json_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = "struct<category:string,l:int,t:int,r:int,b:int,text:string>"
    rows = F.array_sort(F.collect_list(F.struct("item_pos", F.struct("category", "l", "t", "r", "b", "text").alias("item"))))
    saved = regions(spark, sf_dir).groupBy("page_id").agg(F.to_json(F.transform(rows, lambda x: x["item"])).alias("json"))
    again = saved.select("page_id", F.from_json("json", f"array<{item}>").alias("items"))
    return again.select("page_id", F.size("items").cast("long").alias("n_items"), F.to_json("items").alias("items"))


@query("SELECT doc_id, to_base64(encode(text)) AS encoded, text AS decoded FROM documents")
def fn_base64_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace(F.base64(F.encode("text", "UTF-8")), r"\s", "").alias("encoded"))
    return docs.select("doc_id", "encoded", F.decode(F.unbase64("encoded"), "UTF-8").alias("decoded"))


@query("SELECT concat('in/doc_', CAST(o_orderkey AS VARCHAR), '.pdf') AS file FROM orders WHERE o_orderstatus IS DISTINCT FROM 'F'")
def retry_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    name = lambda form: F.format_string(form, "o_orderkey").alias("file")
    return D.unprocessed(orders.select(name("in/doc_%d.pdf")), orders.where("o_orderstatus = 'F'").select(name("out/results/doc_%d.zip")))


@query("SELECT o_custkey, max(strftime(o_orderdate, '%Y-%m-%dT%Hh%Mm%Ss')) AS last_run FROM orders GROUP BY o_custkey")
def retry_last_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH'h'mm'm'ss's'")).alias("last_run"))


_SPECS = ("1", "3", "1,2,3", "1-5", "1-5,8,10", "1-1", "2,2,2", "10,1,5", " 1 , 3 ", "", "7-12,,2", "4 - 6")


@query(f"""WITH s AS (SELECT o_orderkey, {list(_SPECS)}[o_orderkey % {len(_SPECS)} + 1] AS spec, CAST(o_orderkey % 11 + 1 AS INT) AS num_pages FROM orders),
  parts AS (SELECT o_orderkey, num_pages, trim(unnest(string_split(spec, ','))) AS part FROM s),
  numbers AS (SELECT o_orderkey, num_pages, unnest(range(CAST(regexp_extract(part, '^([0-9]+)', 1) AS INT), CAST(regexp_extract(part, '([0-9]+)$', 1) AS INT) + 1)) - 1 AS page FROM parts WHERE part <> ''),
  lists AS (SELECT o_orderkey, string_agg(DISTINCT CAST(page AS VARCHAR), ',' ORDER BY page) AS pages, string_agg(DISTINCT CAST(page AS VARCHAR), ',' ORDER BY page) FILTER (page < num_pages) AS clipped FROM (SELECT DISTINCT * FROM numbers) GROUP BY o_orderkey)
SELECT s.o_orderkey, s.spec, coalesce(pages, '') AS pages, coalesce(clipped, '') AS clipped FROM s LEFT JOIN lists l ON s.o_orderkey = l.o_orderkey""".replace("string_agg(DISTINCT CAST(page AS VARCHAR)", "string_agg(CAST(page AS VARCHAR)"))
def page_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    specs = F.array(*map(F.lit, _SPECS))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.element_at(specs, (F.col("o_orderkey") % len(_SPECS) + 1).cast("int")).alias("spec"), (F.col("o_orderkey") % 11 + 1).cast("int").alias("num_pages"))
    joined = lambda c: F.array_join(c.cast("array<string>"), ",")
    return orders.select("o_orderkey", "spec", joined(D.selected_pages(F.col("spec"))).alias("pages"), joined(D.selected_pages(F.col("spec"), F.col("num_pages"))).alias("clipped"))


@query("""WITH d AS (SELECT o_orderkey AS doc_id, CAST(o_orderkey % 7 + 1 AS INT) AS num_pages FROM orders),
  asked AS (SELECT doc_id, num_pages, k, CAST((doc_id * 3 + k * 5) % 9 - 1 AS INT) AS page_number FROM d, range(6) g(k)),
  firsts AS (SELECT doc_id, num_pages, page_number, min(k) AS k FROM asked GROUP BY ALL)
SELECT doc_id, page_number, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS INT) AS page_pos FROM firsts WHERE page_number >= 0 AND page_number < num_pages""")
def pages_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), (F.col("o_orderkey") % 7 + 1).cast("int").alias("num_pages"))
    asked = docs.select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("request_pos"))
    asked = asked.withColumn("page_number", ((F.col("doc_id") * 3 + F.col("request_pos") * 5) % 9 - 1).cast("int"))
    return D.requested_pages(asked, docs)


@query(f"""WITH {REGIONS}, j AS (SELECT page_id, string_agg(text, chr(10) || chr(10) ORDER BY item_pos) FILTER (text <> '') AS joined FROM (SELECT page_id, item_pos, CASE WHEN item_pos % 4 = 0 THEN '' ELSE text END AS text FROM regions) GROUP BY page_id)
SELECT page_id, CASE WHEN page_id % 5 = 0 THEN concat('page ', CAST(page_id AS VARCHAR)) ELSE coalesce(joined, '') END AS markdown FROM j""")
def page_to_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = regions(spark, sf_dir).withColumn("text", F.when(F.col("item_pos") % 4 == 0, "").otherwise(F.col("text")))
    items = F.transform(F.array_sort(F.collect_list(F.struct("item_pos", "text"))), lambda x: x["text"])
    pages = rows.groupBy("page_id").agg(items.alias("items"))
    text = F.when(F.col("page_id") % 5 == 0, F.concat(F.lit("page "), F.col("page_id").cast("string")))
    return pages.select("page_id", D.page_markdown(text, F.col("items")).alias("markdown"))


@query(f"WITH {URI_CELLS} SELECT page_id, cell_pos, CASE WHEN uri <> '' THEN concat('[', text, '](', uri, ')') ELSE text END AS markdown FROM uri_cells")
def cell_to_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return uri_cells(spark, sf_dir).select("page_id", "cell_pos", T.item_markdown(F.col("text"), F.col("uri")).alias("markdown"))


@query(f"WITH {USAGE} SELECT doc_id, count(*) AS n_pages, CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens, CAST(sum(completion_tokens) AS BIGINT) AS completion_tokens, count(completion_tokens) AS n_with_completion FROM usage GROUP BY doc_id")
def doc_token_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("n_pages"), F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"), F.count("completion_tokens").alias("n_with_completion"))


@query(f"WITH {USAGE} SELECT doc_id, CAST(sum(latency_ms) AS BIGINT) AS total_ms, max(latency_ms) AS max_ms, round(avg(latency_ms), 6) AS avg_ms FROM usage GROUP BY doc_id")
def doc_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage(spark, sf_dir).groupBy("doc_id").agg(F.sum("latency_ms").alias("total_ms"), F.max("latency_ms").alias("max_ms"), F.round(F.avg("latency_ms"), 6).alias("avg_ms"))


_NORMAL = "translate(lower(category), '- ', '__')"
_UNIFIED = C.sql_case(C.UNIFIED, _NORMAL, C.OTHER)


@query(f"WITH {REGIONS} SELECT page_id, item_pos, {_NORMAL} AS category FROM regions")
def category_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions(spark, sf_dir).select("page_id", "item_pos", C.normalized(F.col("category")).alias("category"))


@query(f"WITH {REGIONS} SELECT page_id, item_pos, category, {_UNIFIED} AS unified FROM regions")
def category_unify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions(spark, sf_dir).select("page_id", "item_pos", "category", C.unified(F.col("category")).alias("unified"))


@query(f"WITH {REGIONS} SELECT page_id, item_pos, text FROM regions WHERE category = 'Picture'")
def items_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions(spark, sf_dir).where("category = 'Picture'").select("page_id", "item_pos", "text")


@query(f"WITH {REGIONS} SELECT page_id, item_pos, category, text FROM regions WHERE {_UNIFIED} = 'image'")
def items_by_unified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions(spark, sf_dir).where(C.unified(F.col("category")) == "image").select("page_id", "item_pos", "category", "text")


@query(f"WITH {REGIONS} SELECT page_id, item_pos, category FROM regions WHERE category IN {C.DESCRIBED}")
def items_to_describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions(spark, sf_dir).where(F.col("category").isin(*C.DESCRIBED)).select("page_id", "item_pos", "category")


_RESPONSES = "(SELECT doc_id, concat([' ```markdown', '```html' || chr(10), chr(10) || 'markdown', '```', ''][doc_id % 5 + 1], text, ['```', '``` ' || chr(10), ''][doc_id % 3 + 1]) AS x FROM documents)"
_STRIP = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"


@query(f"""WITH a AS (SELECT doc_id, {_STRIP.format('x')} AS x FROM {_RESPONSES}), b AS (SELECT doc_id, CASE WHEN starts_with(x, '```') THEN x[4:] ELSE x END AS x FROM a),
  c AS (SELECT doc_id, CASE WHEN suffix(x, '```') THEN x[:-4] ELSE x END AS x FROM b), d AS (SELECT doc_id, CASE WHEN starts_with(x, 'markdown') THEN x[9:] ELSE x END AS x FROM c),
  e AS (SELECT doc_id, CASE WHEN starts_with(x, 'html') THEN x[5:] ELSE x END AS x FROM d) SELECT doc_id, {_STRIP.format('x')} AS text FROM e""")
def clean_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (F.col("doc_id") % len(values) + 1).cast("int"))
    raw = F.concat(pick([" ```markdown", "```html\n", "\nmarkdown", "```", ""]), F.col("text"), pick(["```", "``` \n", ""]))
    return table(spark, sf_dir, "documents").select("doc_id", T.clean_response(raw).alias("text"))


def _normal_sql() -> str:
    x = "text"
    for pattern, to in ((r"<br/?>", " "), (r"[ \t]+", " "), (r"[-=]{3,}", ""), (r"\n *", "\n"), (r"\n{2,}", "\n\n"), (r"\*\*(.*?)\*\*", r"\1"), (r"</?[bi]>", ""), (r"\*(.*?)\*", r"\1"), (r" {2,}", " ")):
        x = f"regexp_replace({x}, '{pattern}', '{to}', 'g')"
    x = f"""translate(nfc_normalize({x}), '{T.FANCY}', '{T.PLAIN.replace("'", "''")}')"""
    return _STRIP.format(f"regexp_replace({x}, '!\\[[\\s\\S]*?\\]\\([\\s\\S]*?\\)', '', 'g')")


@query(f"SELECT doc_id, {_normal_sql()} AS text FROM documents")
def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.normalize_text(F.col("text")).alias("text"))


def _repeat_sql(x: str) -> str:
    times = "(CAST(trunc(4 * (1 + 3.0::DOUBLE / n)) AS INT) + 1)"
    return f"len(list_filter(range(1, 251), lambda n: length({x}) >= n * {times} AND right({x}, n * {times}) = repeat(right({x}, n), {times}))) > 0"


@query(f"SELECT doc_id, {_repeat_sql('text')} AS repeats FROM documents")
def repeat_tail_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.repeats_at_end(F.col("text")).alias("repeats"))


@query(f"SELECT doc_id, ({_repeat_sql('text')}) OR (length(text) > 50 AND ({_repeat_sql('cut')})) AS repeats FROM (SELECT doc_id, text, left(text, greatest(0, length(text) - 50)) AS cut FROM documents)")
def repeat_tail_detect_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.repeats_near_end(F.col("text")).alias("repeats"))


@query(f"""WITH s AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(replace(text, '. ', '.' || chr(10) || chr(10)), '\\n{{2,}}'), lambda x: {_STRIP.format('x')}), lambda x: x <> '') AS p FROM documents)
SELECT doc_id, CAST(generate_subscripts(p, 1) - 1 AS INT) AS item_pos, unnest(p) AS text FROM s""")
def split_paragraph_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.replace(F.col("text"), F.lit(". "), F.lit(".\n\n"))
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.paragraphs(text)).alias("item_pos", "text"))


@query("""WITH s AS (SELECT c_custkey, regexp_replace(regexp_replace(lower(concat('-#', c_name, ' (', c_mktsegment, ')')), '[^a-z0-9_-]+', '-', 'g'), '^[^a-z0-9]+|[-_]+$', '', 'g') AS x FROM customer)
SELECT c_custkey, CASE WHEN x = '' THEN 'project' ELSE x END AS slug FROM s""")
def slug_sanitize(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lit("-#"), "c_name", F.lit(" ("), "c_mktsegment", F.lit(")"))
    return table(spark, sf_dir, "customer").select("c_custkey", T.slug(name, "project").alias("slug"))


@query("""SELECT conv_id, turn, array_to_string(list_transform(range(0, greatest(1, CAST(ceil(length(text) / 30.0) AS INT))), lambda i: substr(text, i * 30 + 1, 30)), chr(10)) AS text FROM conversations""")
def hard_wrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.wrapped(F.col("text"), 30).alias("text"))


@query("""WITH c AS (SELECT DISTINCT p_brand, p_type FROM part)
SELECT p_brand, concat('Find:', chr(10), string_agg(concat('- "', p_type, '": ', lower(p_type)), chr(10) ORDER BY p_type), chr(10), 'Scale 1000') AS layout_prompt, concat('One of ', string_agg(concat('"', p_type, '"'), ', ' ORDER BY p_type)) AS image_prompt FROM c GROUP BY p_brand""")
def prompt_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.array_sort(F.collect_set("p_type")).alias("kinds"))
    lines = F.array_join(F.transform("kinds", lambda k: F.concat(F.lit('- "'), k, F.lit('": '), F.lower(k))), "\n")
    names = F.array_join(F.transform("kinds", lambda k: F.concat(F.lit('"'), k, F.lit('"'))), ", ")
    layout = F.replace(F.concat(F.lit("Find:\n"), lines, F.lit("\nScale {bbox_scale}")), F.lit("{bbox_scale}"), F.lit("1000"))
    return kinds.select("p_brand", layout.alias("layout_prompt"), F.concat(F.lit("One of "), names).alias("image_prompt"))
