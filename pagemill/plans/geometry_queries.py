"""Box arithmetic over the layout regions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.functions import geometry as G
from pagemill.functions import images as I
from pagemill.plans.inputs import PAIRS, REGIONS, pairs, regions, table
from pagemill.plans.registry import query

KEY = ("page_id", "item_pos")
PAIR = ("page_id", "a_pos", "b_pos")


def _six(c, name: str):
    return F.round(c.cast("double"), 6).alias(name)


@query(f"""WITH {REGIONS} SELECT page_id, item_pos, r - l AS width, abs(t - b) AS height, round((r - l) / 2.0, 6) AS half_w, round((b - t) / 2.0, 6) AS half_h,
  round((l + r) / 2.0, 6) AS center_x, round((t + b) / 2.0, 6) AS center_y, (r - l) * (b - t) AS area, -((r - l) * (b - t)) AS area_bottom_left,
  concat_ws(',', l, t, r, b) AS ltrb, concat_ws(',', l, t, r - l, b - t) AS xywh FROM regions""")
def box_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = G.box()
    (hw, hh), (cx, cy) = G.half_extent(x), G.center(x)
    text = lambda *c: F.concat_ws(",", *(v.cast("string") for v in c))
    return regions(spark, sf_dir).select(*KEY, G.width(x).alias("width"), G.height(x).alias("height"), _six(hw, "half_w"), _six(hh, "half_h"), _six(cx, "center_x"), _six(cy, "center_y"), G.area(x).alias("area"), G.area(x, G.BOTTOM).alias("area_bottom_left"), text(*x).alias("ltrb"), text(x.l, x.t, G.width(x), G.height(x)).alias("xywh"))


@query(f"WITH {REGIONS} SELECT page_id, item_pos, l * 2.5::DOUBLE AS l, t * 2.5::DOUBLE AS t, r * 2.5::DOUBLE AS r, b * 2.5::DOUBLE AS b FROM regions")
def box_scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions(spark, sf_dir).select(*KEY, *G.scaled(G.box(), 2.5).named())


@query(f"""WITH {REGIONS} SELECT page_id, item_pos, round(l / 800.0::DOUBLE, 6) AS l, round(t / 1200.0::DOUBLE, 6) AS t, round(r / 800.0::DOUBLE, 6) AS r, round(b / 1200.0::DOUBLE, 6) AS b,
  round(l / 800.0::DOUBLE * 800, 6) AS back_l, round(b / 1200.0::DOUBLE * 1200, 6) AS back_b FROM regions""")
def box_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    small = G.normalized(G.box(), 800.0, 1200.0)
    back = G.unnormalized(small, 800.0, 1200.0)
    return regions(spark, sf_dir).select(*KEY, *(_six(c, n) for n, c in small._asdict().items()), _six(back.l, "back_l"), _six(back.b, "back_b"))


@query(f"""WITH {REGIONS}, c AS (SELECT page_id, item_pos, greatest(0, least(l, 900)) AS l, greatest(0, least(t, 700)) AS t, greatest(0, least(r, 900)) AS r, greatest(0, least(b, 700)) AS b FROM regions)
SELECT *, l < r AND t < b AS is_valid FROM c""")
def box_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = G.clipped(G.box(), 900, 700)
    return regions(spark, sf_dir).select(*KEY, *x.named(), G.valid(x).alias("is_valid"))


@query(f"""WITH {PAIRS} SELECT page_id, a_pos, b_pos, greatest(0, a_l - b_l) AS l, greatest(0, a_t - b_t) AS t, greatest(0, a_r - b_l) AS r, greatest(0, a_b - b_t) AS b,
  greatest(0, a_t - b_b) AS bottom_left_t FROM pairs""")
def box_relative_to(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = G.box("a_"), G.box("b_")
    return pairs(spark, sf_dir).select(*PAIR, *G.relative_to(a, b).named(), G.relative_to(a, b, G.BOTTOM).t.alias("bottom_left_t"))


@query(f"""WITH {REGIONS} SELECT page_id, item_pos, least(r, l) AS l, least(b, t) AS t, greatest(r, l) AS r, greatest(b, t) AS b, greatest(b, t) AS bl_t, least(b, t) AS bl_b FROM regions""")
def box_from_tuple(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = G.box()
    other = G.from_tuple(x.r, x.b, x.l, x.t, G.BOTTOM)
    return regions(spark, sf_dir).select(*KEY, *G.from_tuple(x.r, x.b, x.l, x.t).named(), other.t.alias("bl_t"), other.b.alias("bl_b"))


@query(f"""WITH {PAIRS}, i AS (SELECT *, greatest(0, least(a_r, b_r) - greatest(a_l, b_l)) * greatest(0, least(a_b, b_b) - greatest(a_t, b_t)) AS inter,
    (a_r - a_l) * (a_b - a_t) AS a_area, (b_r - b_l) * (b_b - b_t) AS b_area FROM pairs)
SELECT page_id, a_pos, b_pos, inter, round(inter / a_area::DOUBLE, 6) AS over_self, round(inter / (a_area + b_area - inter)::DOUBLE, 6) AS iou,
  round(inter / least(a_area, b_area)::DOUBLE, 6) AS over_min FROM i""")
def box_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = G.box("a_"), G.box("b_")
    return pairs(spark, sf_dir).select(*PAIR, G.intersection(a, b).alias("inter"), _six(G.over_self(a, b), "over_self"), _six(G.over_union(a, b), "iou"), _six(G.over_minimum(a, b), "over_min"))


@query(f"""WITH {PAIRS} SELECT page_id, a_pos, b_pos, least(abs(b_t - a_b), abs(a_t - b_b)) AS vertical, least(abs(b_t - a_b), abs(a_t - b_b)) AS horizontal FROM pairs""")
def box_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = G.box("a_"), G.box("b_")
    return pairs(spark, sf_dir).select(*PAIR, G.vertical_distance(a, b).alias("vertical"), G.horizontal_distance(a, b).alias("horizontal"))


@query(f"""WITH {PAIRS} SELECT page_id, a_pos, b_pos, greatest(a_b - b_b, 0) <= 0.5::DOUBLE * (a_b - a_t) AS not_too_low, greatest(b_t - a_t, 0) <= 0.5::DOUBLE * (a_b - a_t) AS not_too_high,
  (CASE WHEN a_l >= b_l THEN abs(a_t - b_t) <= 0.9::DOUBLE * (a_b - a_t) ELSE true END) AND (CASE WHEN a_r <= b_r THEN abs(a_r - b_r) <= 0.9::DOUBLE * (a_b - a_t) ELSE true END) AS inside FROM pairs""")
def box_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = G.box("a_"), G.box("b_")
    return pairs(spark, sf_dir).select(*PAIR, G.not_too_low(a, b, 0.5).alias("not_too_low"), G.not_too_high(a, b, 0.5).alias("not_too_high"), G.inside(a, b, 0.9).alias("inside"))


@query(f"WITH {REGIONS} SELECT page_id, item_pos, l, 1000 - t AS t, r, 1000 - b AS b, t AS back_t, b AS back_b FROM regions")
def box_origin_flip(spark: SparkSession, sf_dir: str) -> DataFrame:
    low = G.flipped(G.box(), F.lit(1000))
    back = G.flipped(low, F.lit(1000))
    return regions(spark, sf_dir).select(*KEY, *low.named(), back.t.alias("back_t"), back.b.alias("back_b"))


@query(f"WITH {REGIONS} SELECT page_id, min(l) AS l, min(t) AS t, max(r) AS r, max(b) AS b, count(*) AS n FROM regions GROUP BY page_id")
def box_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions(spark, sf_dir).groupBy("page_id").agg(*G.union_of(G.box()).named(), F.count("*").alias("n"))


@query(f"""WITH {REGIONS}, a AS (SELECT *, [90, 180, 270][item_pos % 3 + 1] AS angle FROM regions) SELECT page_id, item_pos, angle,
  CASE angle WHEN 90 THEN t WHEN 180 THEN 1000 - r ELSE 1000 - b END AS l, CASE angle WHEN 90 THEN 1000 - r WHEN 180 THEN 1000 - b ELSE l END AS t,
  CASE angle WHEN 90 THEN b WHEN 180 THEN 1000 - l ELSE 1000 - t END AS r, CASE angle WHEN 90 THEN 1000 - l WHEN 180 THEN 1000 - t ELSE r END AS b FROM a""")
def box_rotate(spark: SparkSession, sf_dir: str) -> DataFrame:
    angle = F.element_at(F.array(F.lit(90), F.lit(180), F.lit(270)), F.col("item_pos") % 3 + 1)
    return regions(spark, sf_dir).withColumn("angle", angle).select(*KEY, "angle", *G.rotated(G.box(), F.col("angle"), F.lit(1000), F.lit(1000)).named())


@query(f"""WITH {REGIONS} SELECT page_id, item_pos, l >= 0 AND t >= 0 AND l < r AND t < b AND b >= 0 AS top_left, t > b AS bottom_left, l - 50 >= 0 AND l - 50 < r AND t < b AS moved FROM regions""")
def box_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = G.box()
    return regions(spark, sf_dir).select(*KEY, G.valid(x).alias("top_left"), G.valid(x, G.BOTTOM).alias("bottom_left"), G.valid(x._replace(l=x.l - 50)).alias("moved"))


@query(f"""WITH {REGIONS} SELECT page_id, item_pos, CAST(trunc(greatest(0, least(l * 1.1::DOUBLE, 850))) AS INT) AS l, CAST(trunc(greatest(0, least(t * 1.1::DOUBLE, 640))) AS INT) AS t,
  CAST(trunc(greatest(0, least(r * 1.1::DOUBLE, 850))) AS INT) AS r, CAST(trunc(greatest(0, least(b * 1.1::DOUBLE, 640))) AS INT) AS b FROM regions""")
def crop_rect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions(spark, sf_dir).select(*KEY, *G.crop(G.scaled(G.box(), 1.1), F.lit(850.0), F.lit(640.0)).named())


@query(f"""WITH {REGIONS} SELECT page_id, item_pos, round(l / 1000.0::DOUBLE * 850, 6) AS l, round(t / 1000.0::DOUBLE * 1100, 6) AS t, round(r / 1000.0::DOUBLE * 850, 6) AS r, round(b / 1000.0::DOUBLE * 1100, 6) AS b FROM regions""")
def box_grid1000(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = G.box()
    out = G.from_grid(x.t, x.l, x.b, x.r, F.lit(850), F.lit(1100))
    return regions(spark, sf_dir).select(*KEY, *(_six(c, n) for n, c in out._asdict().items()))


@query(f"""WITH {REGIONS} SELECT page_id, item_pos, round(l * 850 / 999.0::DOUBLE, 6) AS l, round(t * 1100 / 999.0::DOUBLE, 6) AS t, round(r * 850 / 999.0::DOUBLE, 6) AS r, round(b * 1100 / 999.0::DOUBLE, 6) AS b FROM regions""")
def box_grid999(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = G.box()
    out = G.from_grid_ordered(G.Box(x.r, x.t, x.l, x.b), F.lit(850), F.lit(1100))
    return regions(spark, sf_dir).select(*KEY, *(_six(c, n) for n, c in out._asdict().items()))


@query(f"""WITH {REGIONS} SELECT page_id, item_pos, greatest(0, CAST(trunc(l * (850 / 1024.0::DOUBLE)) AS INT)) AS l, greatest(0, CAST(trunc(t * (1100 / 1024.0::DOUBLE)) AS INT)) AS t,
  least(CAST(trunc(r * (850 / 1024.0::DOUBLE)) AS INT), 850) AS r, least(CAST(trunc(b * (1100 / 1024.0::DOUBLE)) AS INT), 1100) AS b FROM regions""")
def box_grid_trunc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions(spark, sf_dir).select(*KEY, *G.from_grid_truncated(G.box(), F.lit(850), F.lit(1100)).named())


@query(f"""WITH {REGIONS} SELECT page_id, item_pos, round(l / 1000.0::DOUBLE * 850, 6) AS l, round(t / 1000.0::DOUBLE * 1100, 6) AS t, round(r / 1000.0::DOUBLE * 850, 6) AS r, round(b / 1000.0::DOUBLE * 1100, 6) AS b FROM regions""")
def box_unit_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = G.scaled(G.box(), 1.0)
    out = G.unnormalized(G.normalized(unit, 1000.0, 1000.0), F.lit(850), F.lit(1100))
    return regions(spark, sf_dir).select(*KEY, *(_six(c, n) for n, c in out._asdict().items()))


@query(f"""WITH {REGIONS} SELECT page_id, item_pos, CAST(trunc(l / 0.8::DOUBLE) AS INT) AS l, CAST(trunc(t / 0.75::DOUBLE) AS INT) AS t, CAST(trunc(r / 0.8::DOUBLE) AS INT) AS r, CAST(trunc(b / 0.75::DOUBLE) AS INT) AS b FROM regions""")
def box_unresize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions(spark, sf_dir).select(*KEY, *G.unresized(G.box(), F.lit(0.8), F.lit(0.75)).named())


@query(f"""WITH {REGIONS}, f AS (SELECT page_id, item_pos, greatest(0, l) AS l, greatest(0, 700 - b) AS t, greatest(0, r) AS r, greatest(0, 700 - t) AS b FROM regions)
SELECT page_id, item_pos, CASE WHEN t < b THEN l END AS l, CASE WHEN t < b THEN t END AS t, CASE WHEN t < b THEN r END AS r, CASE WHEN t < b THEN b END AS b FROM f""")
def box_docling(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = G.box()
    return regions(spark, sf_dir).select(*KEY, *G.from_bottom_left(G.Box(x.l, x.b, x.r, x.t), F.lit(700)).named())


def _images(spark: SparkSession, sf_dir: str, factor: int = 1) -> DataFrame:
    key = F.col("p_partkey")
    return table(spark, sf_dir, "part").select("p_partkey", (key * 37 % 5000 * factor + 20).cast("int").alias("w"), (key * 53 % 4000 * factor + 20).cast("int").alias("h"))


_IMAGES = "images AS (SELECT p_partkey, CAST(p_partkey * 37 % 5000 * {0} + 20 AS INT) AS w, CAST(p_partkey * 53 % 4000 * {0} + 20 AS INT) AS h FROM part)"


@query(f"""WITH {_IMAGES.format(1)}, q AS (SELECT *, 1500.0::DOUBLE / greatest(w, h) AS q FROM images)
SELECT p_partkey, CASE WHEN q < 1 THEN CAST(trunc(w * q) AS INT) ELSE w END AS w, CASE WHEN q < 1 THEN CAST(trunc(h * q) AS INT) ELSE h END AS h FROM q""")
def img_resize_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, h = I.limited(F.col("w"), F.col("h"), 1500)
    return _images(spark, sf_dir).select("p_partkey", w.alias("w"), h.alias("h"))


@query(f"""WITH {_IMAGES.format(1)}, p AS (SELECT *, w * h AS n, sqrt(6291456.0::DOUBLE / (w * h)) AS s, sqrt(784.0::DOUBLE / (w * h)) AS g FROM images)
SELECT p_partkey, CAST(CASE WHEN n > 6291456 THEN floor(w * s) WHEN n < 784 THEN ceil(w * g) ELSE w END AS INT) AS w, CAST(CASE WHEN n > 6291456 THEN floor(h * s) WHEN n < 784 THEN ceil(h * g) ELSE h END AS INT) AS h FROM p""")
def img_scale_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, h = I.fitted(F.col("w"), F.col("h"))
    return _images(spark, sf_dir).select("p_partkey", w.alias("w"), h.alias("h"))


def _smart_sql(least: int, most: int, guard: bool) -> str:
    low = "greatest(28, {0})" if guard else "{0}"
    near, down = low.format("CAST(round_even({0} / 28.0::DOUBLE, 0) AS BIGINT) * 28"), low.format("CAST(floor({0} / d / 28) AS BIGINT) * 28")
    up = "CAST(ceil({0} * u / 28) AS BIGINT) * 28"
    pick = lambda c: f"CAST(CASE WHEN nh * nw > {most} THEN {down.format(c)} WHEN nh * nw < {least} THEN {up.format(c)} ELSE n{c} END AS INT)"
    bound = "greatest(h, w) / least(h, w)::DOUBLE <= 200" if guard else "true"
    return f"""WITH {_IMAGES.format(2)}, p AS (SELECT *, {near.format('h')} AS nh, {near.format('w')} AS nw, sqrt(h * w / {most}.0::DOUBLE) AS d, sqrt({least}.0::DOUBLE / (h * w)) AS u FROM images)
SELECT p_partkey, CASE WHEN {bound} THEN {pick('w')} END AS w, CASE WHEN {bound} THEN {pick('h')} END AS h FROM p"""


@query(_smart_sql(3136, 11_289_600, True))
def img_smart_resize(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, h = I.smart(F.col("w"), F.col("h"))
    return _images(spark, sf_dir, 2).select("p_partkey", w.alias("w"), h.alias("h"))


@query(_smart_sql(12_544, 1_003_520, False))
def img_smart_resize_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, h = I.smart(F.col("w"), F.col("h"), least=12_544, most=1_003_520, guard=False)
    return _images(spark, sf_dir, 2).select("p_partkey", w.alias("w"), h.alias("h"))


@query("SELECT p_partkey, CAST(trunc(p_size * 72 * (175 / 72.0::DOUBLE)) AS INT) AS w, CAST(trunc(p_size * 100 * ((30 + p_partkey % 571) / 72.0::DOUBLE)) AS INT) AS h FROM part")
def img_render_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    return table(spark, sf_dir, "part").select("p_partkey", I.rendered(size * 72, 175.0).cast("int").alias("w"), I.rendered(size * 100, 30 + F.col("p_partkey") % 571).cast("int").alias("h"))


@query("""WITH p AS (SELECT p_partkey, CAST(200 + p_partkey % 400 AS INT) AS dpi, (p_partkey * 7919 % 1000000 + 1000)::DOUBLE / 1000 AS ratio FROM part)
SELECT p_partkey, CAST(floor(dpi / round_even(ratio + 0.05::DOUBLE, 1)) AS BIGINT) AS dpi FROM p""")
def img_bomb_dpi(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    return table(spark, sf_dir, "part").select("p_partkey", I.reduced_dpi((200 + key % 400).cast("int"), (key * 7919 % 1000000 + 1000).cast("double"), F.lit(1000)).alias("dpi"))


@query()
def img_scale_fit_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    @F.pandas_udf("w long, h long")
    def fit(w: pd.Series, h: pd.Series) -> pd.DataFrame:
        cols, rows = I.grid_fit(w.to_numpy(), h.to_numpy())
        return pd.DataFrame({"w": cols, "h": rows})

    return _images(spark, sf_dir).select("p_partkey", fit("w", "h").alias("x")).select("p_partkey", "x.w", "x.h")
