"""Responses built from the layout regions and parsed again; SQL gives the items they were built from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.operators import parsers as P
from pagemill.plans.inputs import REGIONS, regions, table
from pagemill.plans.registry import query

W, H = 850, 1100


def _responses(spark: SparkSession, sf_dir: str, entry: Column, separator: str = ",", before: str = "[", after: str = "]") -> DataFrame:
    """page_id and one response for each page, its entries in order of the regions."""
    rows = F.array_sort(F.collect_list(F.struct("item_pos", entry.alias("x"))))
    joined = F.array_join(F.transform(rows, lambda r: r["x"]), separator)
    return regions(spark, sf_dir).groupBy("page_id").agg(F.concat(F.lit(before), joined, F.lit(after)).alias("response"))


def _rounded(items: DataFrame) -> DataFrame:
    return items.select("page_id", "item_pos", "category", "text", *(F.round(n, 4).alias(n) for n in "ltrb"))


def _entry(form: str, *names: str) -> Column:
    return F.format_string(form, *names)


@query(f"""WITH {REGIONS}, k AS (SELECT * FROM regions WHERE item_pos % 6 <> 5)
SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY item_pos) - 1 AS INT) AS item_pos, CASE WHEN item_pos % 4 = 1 THEN 'other' ELSE category END AS category, text,
  round(l / 1000.0::DOUBLE * {W}, 4) AS l, round(t / 1000.0::DOUBLE * {H}, 4) AS t, round(r / 1000.0::DOUBLE * {W}, 4) AS r, round(b / 1000.0::DOUBLE * {H}, 4) AS b FROM k""")
def parse_layout_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("item_pos")
    box = F.when(n % 6 == 5, _entry("[%d,%d]", "t", "l")).when(n % 3 == 0, _entry("[[%d,%d,%d,%d]]", "t", "l", "b", "r")).otherwise(_entry("[%d,%d,%d,%d]", "t", "l", "b", "r"))
    entry = F.concat(F.lit("{"), F.when(n % 4 != 1, _entry('"category":"%s",', "category")).otherwise(""), F.when(n % 2 == 0, '"box":').otherwise('"bbox":'), box, _entry(',"text":"%s"}', "text"))
    rows = _responses(spark, sf_dir, entry)
    page = F.col("page_id")
    wrapped = F.when(page % 4 == 0, F.concat(F.lit("Here:\n```json\n"), "response", F.lit("\n```\nDone."))).when(page % 4 == 1, F.replace("response", F.lit('"'), F.lit("'"))).otherwise(F.col("response"))
    return _rounded(P.exploded(rows, P.layout_json(wrapped, F.lit(W), F.lit(H))))


_TAGS = "SELECT page_id, item_pos, category, text, l, t, r, b FROM regions"


@query(f"""WITH {REGIONS}, x AS (SELECT page_id, item_pos * 10 AS k, 'text' AS category, concat('before ', CAST(item_pos AS VARCHAR)) AS text, 0 AS l, 0 AS t, 1000 AS r, 1000 AS b FROM regions
  UNION ALL SELECT page_id, item_pos * 10 + 1, category, text, l, t, r, b FROM regions WHERE item_pos % 5 <> 4
  UNION ALL SELECT DISTINCT page_id, 1000000, 'text', 'tail', 0, 0, 1000, 1000 FROM regions)
SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY k) - 1 AS INT) AS item_pos, category, text, round(l::DOUBLE, 4) AS l, round(t::DOUBLE, 4) AS t, round(r::DOUBLE, 4) AS r, round(b::DOUBLE, 4) AS b FROM x WHERE page_id % 9 <> 0""")
def parse_region_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(P.exploded(_tagged(spark, sf_dir), P.region_tags(F.col("response"))))


def _tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("item_pos")
    box = F.when(n % 5 == 4, _entry("%d,%d", "t", "l")).when(F.col("page_id") % 9 == 0, F.lit("1,x,3,4")).otherwise(_entry("%d,%d,%d,%d", "t", "l", "b", "r"))
    entry = F.concat(_entry("before %d\n\n  \n\n", "item_pos"), F.lit('<region box="'), box, _entry('" category="%s"> %s\n</region>', "category", "text"))
    return _responses(spark, sf_dir, entry, "", "", "\n\ntail\n")


@query(f"""WITH {REGIONS} SELECT page_id, concat(string_agg(concat('before ', CAST(item_pos AS VARCHAR), chr(10), chr(10), '  ', chr(10), chr(10), '![', text, ']([image-placeholder])'), '' ORDER BY item_pos), chr(10), chr(10), 'tail', chr(10)) AS text FROM regions GROUP BY page_id""")
def region_tags_clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tagged(spark, sf_dir).select("page_id", P.region_tags_text(F.col("response")).alias("text"))


def _grounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    second = F.when(F.col("item_pos") % 3 == 0, _entry(", [%d, %d, %d, %d]", "l", "t", "r", "b")).otherwise("")
    label = F.when(F.col("item_pos") % 4 == 0, "image").otherwise(F.col("category"))
    entry = F.concat(F.lit("<|ref|>"), label, F.lit("<|/ref|><|det|>["), _entry("[%d, %d, %d, %d]", "r", "t", "l", "b"), second, F.lit("]<|/det|>\n\n\n\nx \\coloneqq "), "text")
    return _responses(spark, sf_dir, entry, "\n", " ", "<｜end▁of▁sentence｜>")


@query(f"""WITH {REGIONS}, x AS (SELECT *, CASE WHEN item_pos % 4 = 0 THEN 'image' ELSE category END AS label FROM regions)
SELECT page_id, item_pos - 1 AS item_pos, label AS category, label AS text, round(l / 999.0::DOUBLE * {W}, 4) AS l, round(t / 999.0::DOUBLE * {H}, 4) AS t, round(r / 999.0::DOUBLE * {W}, 4) AS r, round(b / 999.0::DOUBLE * {H}, 4) AS b FROM x""")
def parse_grounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(P.exploded(_grounded(spark, sf_dir), P.grounding(F.col("response"), F.lit(W), F.lit(H))))


@query(f"""WITH {REGIONS}, x AS (SELECT page_id, bool_or(item_pos % 4 <> 0) AS others, string_agg(concat(CASE WHEN item_pos % 4 = 0 THEN '![image]' ELSE '' END, chr(10) || chr(10), 'x := ', text), chr(10) ORDER BY item_pos) AS x FROM regions GROUP BY page_id)
SELECT page_id, regexp_replace(regexp_replace(x, '\\n{{3,}}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g') AS text FROM x""")
def grounding_clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grounded(spark, sf_dir).select("page_id", P.grounding_text(F.col("response"), second=True).alias("text"))


@query(f"""WITH {REGIONS}, x AS (SELECT page_id, item_pos - 1 AS item_pos, category, text, greatest(0, trunc(l * ({W} / 1024.0::DOUBLE))) AS l, greatest(0, trunc(t * ({H} / 1024.0::DOUBLE))) AS t, least(trunc(r * ({W} / 1024.0::DOUBLE)), {W}) AS r, least(trunc(b * ({H} / 1024.0::DOUBLE)), {H}) AS b FROM regions)
SELECT page_id, item_pos, category, text, l::DOUBLE AS l, t::DOUBLE AS t, r::DOUBLE AS r, b::DOUBLE AS b FROM x""")
def parse_layout_divs(spark: SparkSession, sf_dir: str) -> DataFrame:
    box = F.when(F.col("item_pos") % 2 == 0, _entry("%d %d %d %d", "l", "t", "r", "b")).otherwise(_entry("[%d,%d,%d,%d]", "l", "t", "r", "b"))
    entry = F.concat(F.lit('<div data-bbox="'), box, _entry('" data-label="%s"><div><p>%s</p></div></div>', "category", "text"))
    return _rounded(P.exploded(_responses(spark, sf_dir, entry, "\n", "", ""), P.layout_divs(F.col("response"), F.lit(W), F.lit(H))))


@query(f"""WITH {REGIONS} SELECT page_id, item_pos - 1 AS item_pos, category, text, trunc(l / 0.8::DOUBLE) AS l, trunc(t / 0.75::DOUBLE) AS t, trunc(r / 0.8::DOUBLE) AS r, trunc(b / 0.75::DOUBLE) AS b FROM regions WHERE page_id % 5 <> 0""")
def parse_cells_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _responses(spark, sf_dir, _entry('{"bbox":[%d,%d,%d,%d],"category":"%s","text":"%s"}', "l", "t", "r", "b", "category", "text"))
    broken = F.when(F.col("page_id") % 5 == 0, F.concat("response", F.lit("]"))).otherwise(F.col("response"))
    return _rounded(P.exploded(rows, P.cells_json(broken, F.lit(0.8), F.lit(0.75))))


@query(f"""WITH {REGIONS} SELECT page_id, string_agg(CASE WHEN cat_id = 0 THEN '' ELSE text END, chr(10) || chr(10) ORDER BY item_pos) AS text FROM regions GROUP BY page_id""")
def cells_concat_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    entry = F.concat(_entry('{"bbox":[%d,%d,%d,%d],"category":"%s"', "l", "t", "r", "b", "category"), F.when(F.col("cat_id") == 0, "").otherwise(_entry(',"text":"%s"', "text")), F.lit("}"))
    return _responses(spark, sf_dir, entry).select("page_id", P.joined_text(P.cells_json(F.col("response"), F.lit(1.0), F.lit(1.0))).alias("text"))


@query(f"""WITH {REGIONS} SELECT page_id, item_pos - 1 AS item_pos, category, CASE WHEN cat_id = 0 THEN '' ELSE text END AS text, round(l / 1000.0::DOUBLE * {W}, 4) AS l, round(t / 1000.0::DOUBLE * {H}, 4) AS t, round(r / 1000.0::DOUBLE * {W}, 4) AS r, round(b / 1000.0::DOUBLE * {H}, 4) AS b FROM regions""")
def parse_unit_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    content = F.when(F.col("cat_id") == 0, "null").otherwise(_entry('"%s"', "text"))
    unit = [(F.col(n) / 1000).alias(n) for n in "ltrb"]
    entry = F.concat(F.lit('{"bbox":'), F.to_json(F.array(*unit)), _entry(',"type":"%s","content":', "category"), content, F.lit("}"))
    return _rounded(P.exploded(_responses(spark, sf_dir, entry), P.unit_cells(F.col("response"), F.lit(W), F.lit(H))))


@query(f"""WITH {REGIONS}, x AS (SELECT * FROM regions WHERE item_pos % 7 <> 6)
SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY item_pos) - 1 AS INT) AS item_pos, category, text, round(l * {W} / 1000.0::DOUBLE, 4) AS l, round(t * {H} / 1000.0::DOUBLE, 4) AS t, round(r * {W} / 1000.0::DOUBLE, 4) AS r, round(b * {H} / 1000.0::DOUBLE, 4) AS b FROM x""")
def parse_block_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    box = F.when(F.col("item_pos") % 7 == 6, F.lit("[1,2]")).otherwise(_entry("[%d,%d,%d,%d]", "l", "t", "r", "b"))
    entry = F.concat(F.lit('{"bbox_2d":'), box, _entry(',"content":"%s","label":"%s"}', "text", "category"))
    rows = _responses(spark, sf_dir, entry, ",", '{"json_result":[[', "]]}")
    return _rounded(P.exploded(rows, P.block_results(F.col("response"), "$.json_result[0]", "bbox_2d", "content", "label", F.lit(W), F.lit(H))))


@query("""SELECT conv_id, turn, role, CASE (conv_id + turn) % 4 WHEN 3 THEN 'plain' ELSE text END AS text FROM (SELECT conv_id, turn, role, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS text FROM conversations)""")
def parse_page_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, none = table(spark, sf_dir, "conversations"), F.lit(None).cast("string")
    page = lambda markdown, text: F.struct(markdown.alias("markdown"), text.alias("text"))
    whole = lambda pages, text: F.to_json(F.struct(F.array(*pages).cast("array<struct<markdown:string,text:string>>").alias("pages"), text.alias("text")))
    kind = (F.col("conv_id") + F.col("turn")) % 4
    raw = F.when(kind == 0, whole([page(F.col("text"), F.lit("no")), page(F.lit("second"), none)], none)).when(kind == 1, whole([page(F.lit(""), F.col("text"))], none))
    raw = raw.when(kind == 2, whole([], F.col("text"))).otherwise("```plain```")
    return rows.select("conv_id", "turn", "role", P.first_page_markdown(raw).alias("text"))


_ENVELOPE = '{{"choices":[{{"message":{{"role":"assistant","content":{0}}}}}],"usage":{{{1}}}}}'


@query("SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN event_type END AS content, CAST(user_id AS INT) AS prompt_tokens, CASE WHEN event_id % 3 <> 0 THEN CAST(event_id % 500 AS INT) END AS completion_tokens FROM events")
def chat_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    content = F.when(F.col("event_id") % 7 == 0, "null").otherwise(_entry('"%s"', "event_type"))
    first = F.when(F.col("event_id") % 2 == 0, '"prompt_tokens":').otherwise('"input_tokens":')
    second = F.when(F.col("event_id") % 3 == 0, "").otherwise(F.concat(F.when(F.col("event_id") % 2 == 0, ',"completion_tokens":').otherwise(',"output_tokens":'), (F.col("event_id") % 500).cast("string")))
    raw = F.concat(F.lit('{"choices":[{"message":{"role":"assistant","content":'), content, F.lit('}}],"usage":{'), first, F.col("user_id").cast("string"), second, F.lit("}}"))
    rows = table(spark, sf_dir, "events").select("event_id", raw.alias("raw"))
    used, made = P.chat_usage(F.col("raw"))
    return rows.select("event_id", P.chat_content(F.col("raw")).alias("content"), used.alias("prompt_tokens"), made.alias("completion_tokens"))


@query("SELECT event_id, CASE WHEN event_type = 'error' AND event_id % 2 = 0 THEN concat('code ', CAST(event_id AS VARCHAR)) WHEN event_type = 'error' THEN 'failed' END AS error FROM events")
def response_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = F.when(F.col("event_id") % 2 == 0, _entry('{"errorCode":7,"errorMsg":"code %d"}', "event_id")).otherwise('{"error":"failed"}')
    raw = F.when(F.col("event_type") == "error", coded).otherwise(F.concat(F.lit('{"errorCode":0,"result":'), "props", F.lit("}")))
    return table(spark, sf_dir, "events").select("event_id", P.error_of(raw).alias("error"))


@query("SELECT doc_id, text FROM documents")
def stream_delta_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagemill.streaming.deltas import concatenated

    n = F.greatest(F.lit(1), F.ceil(F.length("text") / 10)).cast("int")
    chunks = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.sequence(F.lit(0), n - 1)).alias("chunk_pos"), "text").select(F.col("doc_id").alias("response_id"), "chunk_pos", F.substr("text", F.col("chunk_pos") * 10 + 1, F.lit(10)).alias("delta"))
    return concatenated(chunks).select(F.col("response_id").alias("doc_id"), "text")


@query(f"""WITH {REGIONS} SELECT page_id, text AS first_text, category AS first_category FROM regions WHERE item_pos = 1""")
def first_result_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _responses(spark, sf_dir, _entry('{"text":"%s","label":"%s"}', "text", "category"), ",", '{"results":[', "]}")
    first = F.try_variant_get(F.try_parse_json("response"), "$.results[0]", "variant")
    return rows.select("page_id", F.try_variant_get(first, "$.text", "string").alias("first_text"), F.try_variant_get(first, "$.label", "string").alias("first_category"))


@query(f"""WITH {REGIONS}, x AS (SELECT page_id, category, item_pos FROM regions WHERE item_pos % 2 = 0) SELECT page_id, arg_min(category, item_pos) AS class_name, round(min(item_pos) / 8.0::DOUBLE, 6) AS confidence FROM x GROUP BY page_id""")
def picture_top_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("item_pos") % 2 == 0, "classification").otherwise("note")
    entry = F.concat(F.lit('{"kind":"'), kind, _entry('","predicted_classes":[{"class_name":"%s","confidence":', "category"), (F.col("item_pos") / 8).cast("string"), F.lit('},{"class_name":"x","confidence":0}]}'))
    rows = _responses(spark, sf_dir, entry)
    parsed = F.from_json("response", "array<struct<kind:string,predicted_classes:array<struct<class_name:string,confidence:double>>>>")
    top = F.try_element_at(F.try_element_at(F.filter(parsed, lambda a: a["kind"] == "classification"), F.lit(1))["predicted_classes"], F.lit(1))
    return rows.select("page_id", top["class_name"].alias("class_name"), F.round(top["confidence"], 6).alias("confidence")).where("class_name is not null")


@query(f"""WITH {REGIONS} SELECT page_id, max(CASE WHEN item_pos = page_id % 4 + 1 THEN text END) AS text FROM regions GROUP BY page_id""")
def json_pointer_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagemill.operators.trees import pointer_path

    rows = _responses(spark, sf_dir, _entry('{"text":"%s"}', "text"), ",", '{"texts":[', "]}")
    ref = F.concat(F.lit("#/texts/"), (F.col("page_id") % 4).cast("string"))
    found = F.coalesce(*(F.when(ref == f"#/texts/{k}", F.try_variant_get(F.try_parse_json("response"), pointer_path(f"#/texts/{k}") + ".text", "string")) for k in range(4)))
    return rows.select("page_id", found.alias("text"))
