"""Regions, cells, reading order and lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagemill.functions import categories as C
from pagemill.functions import geometry as G
from pagemill.operators import layout as L
from pagemill.plans.inputs import CELLS, LABELS, REGIONS, URI_CELLS, cells, regions, uri_cells
from pagemill.plans.registry import query


def _page_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions on document pages of 900 x 400, where the word cells are."""
    return regions(spark, sf_dir).withColumns({"t": F.col("t") % 300, "b": F.col("t") % 300 + (F.col("b") - F.col("t"))})


_PAGE = "page_regions AS (SELECT page_id, item_pos, category, l, t % 300 AS t, r, t % 300 + (b - t) AS b FROM regions)"
_LINES = """SELECT {key}, string_agg(line, chr(10) ORDER BY n) AS text FROM (
  SELECT {key}, n, string_agg(replace({shown}, chr(10), ' '), ' ' ORDER BY l, t, cell_pos) AS line FROM (
    SELECT *, sum(fresh) OVER (PARTITION BY {key} ORDER BY t, l, cell_pos ROWS UNBOUNDED PRECEDING) AS n FROM (
      SELECT *, CASE WHEN abs((t + b) / 2.0 - lag((t + b) / 2.0) OVER (PARTITION BY {key} ORDER BY t, l, cell_pos)) < 0.6 * greatest(b - t, 1) THEN 0 ELSE 1 END AS fresh FROM {table}))
  GROUP BY {key}, n) GROUP BY {key}"""


@query(f"""WITH {REGIONS}, j AS (SELECT page_id, item_pos, concat('{{"label":"', category, '","score":', CAST((item_pos % 10) AS VARCHAR), ',"bbox":[', l, ',', t, ',', r, ',', b, ']}}') AS j FROM regions)
SELECT page_id, item_pos, j::JSON ->> 'label' AS label, CAST(j::JSON ->> 'score' AS DOUBLE) AS score, CAST(j::JSON -> 'bbox' ->> 0 AS INT) AS l, CAST(j::JSON -> 'bbox' ->> 3 AS INT) AS b FROM j""")
def regions_from_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = F.struct(F.col("category").alias("label"), (F.col("item_pos") % 10).cast("double").alias("score"), F.array("l", "t", "r", "b").alias("bbox"))
    wire = regions(spark, sf_dir).groupBy("page_id").agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("item_pos", row.alias("x")))), lambda s: s["x"])).alias("json"))
    back = wire.select("page_id", F.posexplode(F.from_json("json", "array<struct<label:string,score:double,bbox:array<int>>>")).alias("pos", "x"))
    return back.select("page_id", (F.col("pos") + 1).alias("item_pos"), "x.label", "x.score", F.col("x.bbox")[0].alias("l"), F.col("x.bbox")[3].alias("b"))


@query(f"""WITH {REGIONS} SELECT page_id, item_pos, category AS label, CAST(trunc(l * 1.37::DOUBLE) AS INT) AS l, CAST(trunc(t * 1.37::DOUBLE) AS INT) AS t, CAST(trunc(r * 1.37::DOUBLE) AS INT) AS r, CAST(trunc(b * 1.37::DOUBLE) AS INT) AS b
FROM regions WHERE (item_pos * 7 + cat_id) % 10 / 10.0::DOUBLE > 0.3""")
def regions_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = regions(spark, sf_dir).withColumns(G.scaled(G.box(), 1.37)._asdict()).select("page_id", "item_pos", F.col("cat_id").alias("label_id"), *"ltrb", ((F.col("item_pos") * 7 + F.col("cat_id")) % 10 / 10.0).alias("score"))
    return L.thresholded(found, 0.3, dict(enumerate(LABELS))).select("page_id", "item_pos", "label", *"ltrb")


@query(f"WITH {REGIONS}, c AS (SELECT page_id, item_pos, greatest(0, least(l, 700)) AS l, greatest(0, least(t, 800)) AS t, greatest(0, least(r, 700)) AS r, greatest(0, least(b, 800)) AS b FROM regions) SELECT * FROM c WHERE r > l AND b > t")
def regions_clamped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.clamped(regions(spark, sf_dir), 700, 800).select("page_id", "item_pos", *"ltrb")


_LABEL = "translate(lower(category), '- ', '__')"


@query(f"WITH {REGIONS}, x AS (SELECT page_id, item_pos, {_LABEL} AS label FROM regions), y AS (SELECT *, {C.sql_case(C.TASKS, 'label', 'text')} AS task, {C.sql_case(C.STRICT_TASKS, 'label', 'text')} AS strict_task FROM x) SELECT * FROM y WHERE strict_task <> 'abandon'")
def region_task_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = regions(spark, sf_dir).select("page_id", "item_pos", C.normalized(F.col("category")).alias("label"))
    return L.routed(rows, "label", C.STRICT_TASKS).withColumnRenamed("task", "strict_task").withColumn("task", C.task(F.col("label")))


@query(f"WITH {REGIONS}, x AS (SELECT page_id, {C.sql_case(C.TASKS, _LABEL, 'text')} AS task, item_pos FROM regions) SELECT page_id, CAST(count(*) FILTER (task = 'skip') AS BIGINT) AS skipped, CAST(count(*) FILTER (task = 'text' AND item_pos % 2 = 0) AS BIGINT) AS native, CAST(count(*) FILTER (task <> 'skip' AND NOT (task = 'text' AND item_pos % 2 = 0)) AS BIGINT) AS model FROM x GROUP BY page_id")
def region_task_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = regions(spark, sf_dir).withColumn("task", C.task(C.normalized(F.col("category"))))
    native = (F.col("task") == "text") & (F.col("item_pos") % 2 == 0)
    return rows.groupBy("page_id").agg(F.count_if(F.col("task") == "skip").alias("skipped"), F.count_if(native).alias("native"), F.count_if((F.col("task") != "skip") & ~native).alias("model"))


@query(f"WITH {REGIONS}, {CELLS}, {_PAGE} SELECT p.page_id, p.item_pos, c.cell_pos FROM page_regions p JOIN cells c ON p.page_id = c.page_id AND c.r > p.l AND c.l < p.r AND c.b > p.t AND c.t < p.b")
def cell_region_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.in_regions(_page_regions(spark, sf_dir), cells(spark, sf_dir)).select("page_id", "item_pos", "cell_pos")


_MEET = "m AS (SELECT p.page_id, p.item_pos, p.l AS r_l, p.t AS r_t, p.r AS r_r, p.b AS r_b, c.cell_pos, c.l, c.t, c.r, c.b, c.text FROM page_regions p JOIN cells c ON p.page_id = c.page_id AND c.r > p.l AND c.l < p.r AND c.b > p.t AND c.t < p.b)"


@query(f"WITH {REGIONS}, {CELLS}, {_PAGE}, {_MEET}, x AS ({_LINES.format(key='page_id, item_pos', shown='text', table='m')}) SELECT x.page_id, x.item_pos, text, n_cells FROM x JOIN (SELECT page_id, item_pos, count(*) AS n_cells FROM m GROUP BY ALL) n ON x.page_id = n.page_id AND x.item_pos = n.item_pos")
def native_text_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    met = L.in_regions(_page_regions(spark, sf_dir), cells(spark, sf_dir))
    return L.native_text(met).select("page_id", "item_pos", "text", "n_cells")


@query(f"""WITH {REGIONS}, {CELLS}, {_PAGE}, {_MEET} SELECT page_id, item_pos, bool_or(l <= r_l + 0.05::DOUBLE * (r_r - r_l)) AND bool_or(r >= r_r - 0.05::DOUBLE * (r_r - r_l)) AND bool_or(t <= r_t + 0.05::DOUBLE * (r_b - r_t)) AS edges
FROM m GROUP BY page_id, item_pos""")
def native_text_edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    met = L.in_regions(_page_regions(spark, sf_dir), cells(spark, sf_dir))
    return L.native_text(met).select("page_id", "item_pos", "edges")


@query(f"""WITH {REGIONS} SELECT page_id, item_pos, category, CASE WHEN item_pos % 3 = 0 THEN concat('native ', CAST(item_pos AS VARCHAR)) WHEN item_pos % 3 = 1 THEN text ELSE '' END AS text FROM regions""")
def layout_items_assemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = regions(spark, sf_dir)
    texts = own.where("item_pos % 3 < 2").select("page_id", "item_pos", F.when(F.col("item_pos") % 3 == 0, F.concat(F.lit("native "), F.col("item_pos").cast("string"))).alias("native"), F.col("text").alias("model"))
    return L.recognised(own.drop("text"), texts).select("page_id", "item_pos", "category", "text")


@query(f"WITH {REGIONS} SELECT page_id, string_agg(text, chr(10) || chr(10) ORDER BY t, l, item_pos) AS text FROM regions WHERE item_pos % 5 <> 0 GROUP BY page_id")
def layout_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.page_text(regions(spark, sf_dir).withColumn("text", F.when(F.col("item_pos") % 5 == 0, "").otherwise(F.col("text"))))


@query(f'WITH {REGIONS} SELECT page_id, item_pos, CAST(row_number() OVER (PARTITION BY page_id ORDER BY t, l, item_pos) AS INT) AS "order" FROM regions')
def reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.reading_order(regions(spark, sf_dir)).select("page_id", "item_pos", "order")


@query(f"WITH {URI_CELLS} {_LINES.format(key='page_id', shown='''CASE WHEN uri <> '' THEN concat('[', text, '](', uri, ')') ELSE text END''', table='uri_cells')}")
def assemble_text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.lines(uri_cells(spark, sf_dir))


@query(f"""WITH {CELLS}, h AS (SELECT *, max(b) OVER (PARTITION BY page_id) AS h FROM cells), f AS (SELECT page_id, cell_pos, h, l, h - b AS t, r, h - t AS b, text FROM h) SELECT page_id, cell_pos, l, h - b AS t, r, h - t AS b, text FROM f WHERE l < r AND h - b < h - t AND regexp_replace(text, '^\\s+|\\s+$', '', 'g') <> ''""")
def cells_flip_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    height = F.col("h")  # of the page: the lowest edge of its cells
    low = G.flipped(G.box(), height)
    wire = cells(spark, sf_dir).withColumn("h", F.max("b").over(Window.partitionBy("page_id"))).select("page_id", "cell_pos", "h", low.l.alias("l"), low.b.alias("t"), low.r.alias("r"), low.t.alias("b"), "text")
    up = G.Box(F.col("l"), height - F.col("b"), F.col("r"), height - F.col("t"))
    return wire.where(G.valid(up) & (F.regexp_replace("text", r"^\s+|\s+$", "") != "")).select("page_id", "cell_pos", *up.named(), "text")


@query(f"WITH {CELLS} SELECT page_id, cell_pos, round(l * (175 / 72.0::DOUBLE), 6) AS l, round(t * (175 / 72.0::DOUBLE), 6) AS t, round(r * (175 / 72.0::DOUBLE), 6) AS r, round(b * (175 / 72.0::DOUBLE), 6) AS b FROM cells")
def cells_scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells(spark, sf_dir).select("page_id", "cell_pos", *(F.round(c, 6).alias(n) for n, c in G.scaled(G.box(), 175 / 72)._asdict().items()))


@query(f"""WITH {REGIONS}, {CELLS}, {_PAGE}, h AS (SELECT page_id, item_pos AS link_pos, concat('u', CAST(item_pos AS VARCHAR)) AS uri, l, t, r, b FROM page_regions),
  claim AS (SELECT c.page_id, c.cell_pos, min(link_pos) AS link_pos FROM cells c JOIN h ON c.page_id = h.page_id AND h.l <= (c.l + c.r) / 2.0 AND (c.l + c.r) / 2.0 <= h.r AND h.t <= (c.t + c.b) / 2.0 AND (c.t + c.b) / 2.0 <= h.b GROUP BY ALL),
  z AS (SELECT c.*, link_pos FROM cells c LEFT JOIN claim k ON c.page_id = k.page_id AND c.cell_pos = k.cell_pos),
  o AS (SELECT page_id, 0 AS kind, link_pos AS pos, min(l) AS l, min(t) AS t, max(r) AS r, max(b) AS b, string_agg(text, ' ' ORDER BY z.t, z.l, cell_pos) AS text, concat('u', CAST(link_pos AS VARCHAR)) AS uri FROM z WHERE link_pos IS NOT NULL GROUP BY page_id, link_pos
    UNION ALL SELECT page_id, 1, cell_pos, l, t, r, b, text, NULL FROM z WHERE link_pos IS NULL)
SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY kind, pos) AS INT) AS out_pos, l, t, r, b, text, uri FROM o""")
def hyperlink_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = _page_regions(spark, sf_dir).select("page_id", F.col("item_pos").alias("link_pos"), F.concat(F.lit("u"), F.col("item_pos").cast("string")).alias("uri"), *"ltrb")
    return L.merged_links(cells(spark, sf_dir), links)


@query(f"""WITH {REGIONS}, a AS (SELECT *, (r - l) * (b - t) AS s FROM regions) SELECT page_id, item_pos FROM a WHERE NOT EXISTS (SELECT 1 FROM a o WHERE o.page_id = a.page_id AND o.item_pos <> a.item_pos AND (o.s > a.s OR (o.s = a.s AND o.item_pos < a.item_pos))
  AND greatest(0, least(a.r, o.r) - greatest(a.l, o.l)) * greatest(0, least(a.b, o.b) - greatest(a.t, o.t)) / a.s::DOUBLE >= 0.3)""")
def nested_region_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.without_nested(regions(spark, sf_dir), 0.3).select("page_id", "item_pos")


@query(f"WITH {URI_CELLS} SELECT page_id, cell_pos, text, round(l * (175 / 72.0::DOUBLE), 1) AS l, round(t * (175 / 72.0::DOUBLE), 1) AS t, uri FROM uri_cells")
def view_text_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = G.scaled(G.box(), 175 / 72)
    return uri_cells(spark, sf_dir).select("page_id", "cell_pos", "text", F.round(x.l, 1).alias("l"), F.round(x.t, 1).alias("t"), "uri")
