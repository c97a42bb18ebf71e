"""Responses of document models as arrays of items.

Every parser takes a Column with the response and gives ``array<item>``; null is a response that
doesn't parse.  Built-in JSON and regular expressions do the work; a Python batch sees only what
they leave over.
"""

from __future__ import annotations

import ast
import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from pagemill.functions import geometry as G
from pagemill.functions import html as H
from pagemill.functions.text import clean_response, paragraphs, stripped

ITEM = "struct<category:string,text:string,l:double,t:double,r:double,b:double>"
_EMPTY = f"array<{ITEM}>"
REGION = r'(?s)<region\s+box="([^"]+)"\s+category="([^"]+)">(.*?)</region>'
GROUNDING = r"(?s)<\|ref\|>(.*?)<\|/ref\|><\|det\|>(.*?)<\|/det\|>"
_BOX = r"\[(\d+),\s*(\d+),\s*(\d+),\s*(\d+)\]"


def item(category: Column, text: Column, box: G.Box) -> Column:
    return F.struct(category.cast("string").alias("category"), text.cast("string").alias("text"), *(c.cast("double").alias(n) for n, c in box._asdict().items()))


def exploded(rows: DataFrame, items: Column, key: str = "page_id") -> DataFrame:
    """One row per item: key, item_pos from 0, category, text, l, t, r, b."""
    return rows.select(key, F.posexplode(items).alias("item_pos", "x")).select(key, "item_pos", "x.category", "x.text", "x.l", "x.t", "x.r", "x.b")


# ---------------------------------------------------------------- JSON lists


@F.pandas_udf(StringType())
def _literals(values: pd.Series) -> pd.Series:
    """Python literals as JSON; null stays null, and what is neither gives null."""

    def one(v: str | None) -> str | None:
        try:
            return None if v is None else json.dumps(ast.literal_eval(v))
        except (ValueError, SyntaxError, TypeError, MemoryError, RecursionError):
            return None

    return values.map(one)


def json_part(c: Column) -> Column:
    """What a fenced json block holds, or else from the first [ to the last ]."""
    fenced = F.regexp_extract(c, r"(?s)```(?:json)?\s*(\[.*?\])\s*```", 1)
    return F.when(fenced != "", fenced).otherwise(F.regexp_extract(c, r"(?s)(\[.*\])", 1))


def strict_json(c: Column) -> Column:
    """VARIANT of a JSON text; null also if something follows it, which the plain parser overlooks.

    The text must be one value of a list and of an object: what would break out of the one is an error in the other.
    """
    among = lambda before, after: F.try_parse_json(F.concat(F.lit(before), c, F.lit(after)))
    return F.when(among('{"whole":', ',"end":0}').isNotNull(), F.try_variant_get(among('{"whole":[', '],"end":0}'), "$.whole[0]", "variant"))


def _bound(c: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is worked out once, however often ``f`` uses it."""
    return F.transform(F.array(c), f)[0]


def lenient_json(c: Column) -> Column:
    """VARIANT of a JSON text or a Python literal, else null."""
    direct = strict_json(c)
    return F.coalesce(direct, F.try_parse_json(_literals(F.when(direct.isNull(), c))))


def _list(v: Column, path: str = "$") -> Column:
    return F.try_variant_get(v, path, "array<variant>")


def _box_values(entry: Column, *names: str) -> Column:
    """Four numbers under the first of the names, flat or as the only list in a list; else null."""
    options = []
    for n in names:
        for path in (f"$.{n}", f"$.{n}[0]"):
            values = F.try_variant_get(entry, path, "array<double>")
            options.append(_bound(values, lambda v: F.when((F.size(v) == 4) & ~F.exists(v, lambda x: x.isNull()), v)))
    return F.coalesce(*options)


def layout_json(c: Column, w: Column, h: Column) -> Column:
    """Entries with category, text and a box ``[ymin, xmin, ymax, xmax]`` of 0-1000; boxes that are none are skipped."""

    def one(e: Column) -> Column:
        category, text = F.coalesce(F.try_variant_get(e, "$.category", "string"), F.lit("other")), F.coalesce(F.try_variant_get(e, "$.text", "string"), F.lit(""))
        return _bound(_box_values(e, "box", "bbox"), lambda v: F.when(v.isNotNull(), item(category, text, G.from_grid(v[0], v[1], v[2], v[3], w, h))))

    found = F.transform(_list(lenient_json(json_part(c))), one)
    return F.coalesce(F.filter(found, lambda x: x.isNotNull()), F.array().cast(_EMPTY))


def cells_json(c: Column, sx: Column, sy: Column) -> Column:
    """Entries bbox (pixels of the resized image), category, text; null unless the whole response is JSON."""

    def one(e: Column) -> Column:
        category, text = F.try_variant_get(e, "$.category", "string"), F.coalesce(F.try_variant_get(e, "$.text", "string"), F.lit(""))
        return _bound(_box_values(e, "bbox"), lambda v: item(category, text, G.unresized(G.Box(v[0], v[1], v[2], v[3]), sx, sy)))

    return F.transform(_list(strict_json(c)), one)


def unit_cells(c: Column, w: Column, h: Column) -> Column:
    """Entries bbox (shares of the page), type, content; a null content is an empty text."""

    def one(e: Column) -> Column:
        category, text = F.try_variant_get(e, "$.type", "string"), F.coalesce(F.try_variant_get(e, "$.content", "string"), F.lit(""))
        return _bound(_box_values(e, "bbox"), lambda v: item(category, text, G.unnormalized(G.Box(v[0], v[1], v[2], v[3]), w, h)))

    return F.transform(_list(strict_json(c)), one)


def block_results(c: Column, path: str, box: str, content: str, label: str, scale_w: Column | None = None, scale_h: Column | None = None) -> Column:
    """Entries of a list somewhere in an object; those without a box of four numbers are skipped."""

    def one(e: Column) -> Column:
        text = lambda n: F.coalesce(F.try_variant_get(e, f"$.{n}", "string"), F.lit(""))

        def placed(v: Column) -> Column:
            x = G.Box(v[0], v[1], v[2], v[3])
            if scale_w is not None:
                x = G.Box(x.l * scale_w / 1000, x.t * scale_h / 1000, x.r * scale_w / 1000, x.b * scale_h / 1000)
            return F.when(v.isNotNull(), item(text(label), text(content), x))

        return _bound(_box_values(e, box), placed)

    return F.filter(F.transform(_list(strict_json(c), path), one), lambda x: x.isNotNull())


def joined_text(items: Column, separator: str = "\n\n") -> Column:
    return F.array_join(F.transform(items, lambda x: x["text"]), separator)


# ---------------------------------------------------------------- tags in text


def region_tags(c: Column) -> Column:
    """Markdown with <region> tags: paragraphs as text items on the whole page, regions with their boxes.

    A region without four coordinates is skipped; one with a coordinate that is no number makes
    the response unusable: no items.
    """
    segments = F.split(c, REGION)
    groups = [F.regexp_extract_all(c, F.lit(REGION), k) for k in (1, 2, 3)]
    whole = G.Box(*(F.lit(v) for v in (0, 0, 1000, 1000)))
    texts = F.transform(segments, lambda s: F.transform(paragraphs(s), lambda p: item(F.lit("text"), p, whole)))
    numbers = F.transform(groups[0], lambda b: F.transform(F.split(b, ","), lambda x: F.try_variant_get(F.try_parse_json(F.trim(x)), "$", "double")))

    def region(v: Column, k: Column) -> Column:
        made = item(F.get(groups[1], k), stripped(F.get(groups[2], k)), G.Box(v[1], v[0], v[3], v[2]))
        return F.when(F.size(v) == 4, F.array(F.when(F.size(v) == 4, made))).otherwise(F.array().cast(_EMPTY))

    regions = F.transform(numbers, region)
    none = F.array().cast(_EMPTY)
    mixed = F.flatten(F.zip_with(texts, regions, lambda t, r: F.concat(F.coalesce(t, none), F.coalesce(r, none))))
    broken = F.exists(numbers, lambda v: F.exists(v, lambda x: x.isNull()))
    return F.when(broken, none).otherwise(mixed)


def region_tags_text(c: Column) -> Column:
    """The same with a picture in place of each region."""
    segments, texts = F.split(c, REGION), F.transform(F.regexp_extract_all(c, F.lit(REGION), 3), stripped)
    parts = F.zip_with(segments, texts, lambda s, t: F.concat(F.coalesce(s, F.lit("")), F.when(t.isNotNull(), F.concat(F.lit("!["), t, F.lit("]([image-placeholder])"))).otherwise("")))
    return F.array_join(parts, "")


def grounding(c: Column, w: Column, h: Column) -> Column:
    """<|ref|>label<|/ref|><|det|>boxes<|/det|>: one item a tag, boxes merged, the label as text too."""
    labels, places = (F.regexp_extract_all(c, F.lit(GROUNDING), k) for k in (1, 2))

    def one(label: Column, det: Column) -> Column:
        n = [F.transform(F.regexp_extract_all(det, F.lit(_BOX), k), lambda x: x.cast("double")) for k in (1, 2, 3, 4)]
        low = lambda a, b: F.least(F.array_min(a), F.array_min(b))
        high = lambda a, b: F.greatest(F.array_max(a), F.array_max(b))
        box = G.Box(low(n[0], n[2]) / 999 * w, low(n[1], n[3]) / 999 * h, high(n[0], n[2]) / 999 * w, high(n[1], n[3]) / 999 * h)
        return F.when(F.size(n[0]) > 0, item(label, label, box))

    return F.filter(F.zip_with(labels, places, one), lambda x: x.isNotNull())


def grounding_text(c: Column, second: bool = False) -> Column:
    """Without the tags; images leave a mark.  ``second`` also drops the end mark and surplus line feeds."""
    if second:
        c = F.replace(c, F.lit("<｜end▁of▁sentence｜>"), F.lit(""))
    image = r"(?s)<\|ref\|>image<\|/ref\|><\|det\|>(.*?)<\|/det\|>"
    others = F.exists(F.regexp_extract_all(c, F.lit(GROUNDING), 1), lambda x: x != "image")
    out = F.regexp_replace(F.regexp_replace(c, image, "![image]"), GROUNDING, "")
    tidy = F.replace(F.replace(out, F.lit("\\coloneqq"), F.lit(":=")), F.lit("\\eqqcolon"), F.lit("=:"))
    if second:
        tidy = F.regexp_replace(tidy, "\n{3,}", "\n\n")
    return stripped(F.when(others, tidy).otherwise(out))


def layout_divs(c: Column, w: Column, h: Column, grid: int = 1024) -> Column:
    """Top-level divs with data-bbox and data-label; if one has no box attribute or a degenerate box, there are no items."""

    @F.pandas_udf("array<struct<label:string,content:string,box:array<int>>>")
    def divs(values: pd.Series) -> pd.Series:
        def one(v: str | None) -> list | None:
            if v is None:
                return None
            out = []
            for attrs, inner in H.top_divs(v):
                raw = attrs.get("data-bbox")
                if raw is None:
                    return None
                try:
                    box = json.loads(raw)
                except ValueError:
                    box = raw.split(" ")
                if not isinstance(box, list) or len(box) != 4:
                    box = [0, 0, grid, grid]
                try:
                    box = [int(x) for x in box]
                except (ValueError, TypeError):
                    return None
                out.append({"label": attrs.get("data-label", "block"), "content": H.to_markdown(inner).strip(), "box": box})
            return out

        return values.map(one)

    items = F.transform(divs(c), lambda d: item(d["label"], d["content"], G.from_grid_truncated(G.Box(*(d["box"][k] for k in range(4))), w, h, grid)))
    good = F.forall(items, lambda x: G.valid(G.Box(*(x[n] for n in "ltrb"))))
    return F.when(good, items).otherwise(F.array().cast(_EMPTY))


# ---------------------------------------------------------------- envelopes


def first_page_markdown(c: Column) -> Column:
    """First page's markdown or text, or else the object's own, or else the whole; not JSON: as it is."""
    v = strict_json(c)
    full = lambda path: F.nullif(F.try_variant_get(v, path, "string"), F.lit(""))
    paged = F.coalesce(F.size(_list(v, "$.pages")) > 0, F.lit(False))
    found = F.when(paged, F.coalesce(full("$.pages[0].markdown"), full("$.pages[0].text"), F.lit(""))).otherwise(F.coalesce(full("$.markdown"), full("$.text"), F.to_json(v)))
    return clean_response(F.when(v.isNull(), c).otherwise(found))


def chat_content(c: Column) -> Column:
    """Content of the first choice; null if there is none."""
    return F.get_json_object(c, "$.choices[0].message.content")


def chat_usage(c: Column) -> tuple[Column, Column]:
    """Prompt and completion tokens of either form of usage."""
    number = lambda *paths: F.coalesce(*(F.get_json_object(c, f"$.usage.{p}").try_cast("int") for p in paths))
    return number("input_tokens", "prompt_tokens"), number("output_tokens", "completion_tokens")


def error_of(c: Column) -> Column:
    """Message of an error envelope: a code other than 0, or an error member; null if none."""
    code = F.get_json_object(c, "$.errorCode").try_cast("int")
    coded = F.when(code != 0, F.coalesce(F.get_json_object(c, "$.errorMsg"), F.lit("unknown")))
    return F.coalesce(coded, F.get_json_object(c, "$.error"))
