"""Schemas of documents, pages, items and cells, and the way between nested and relational form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_S, _D, _I = T.StringType(), T.DoubleType(), T.IntegerType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


SIZE = _struct(width=_D, height=_D)
BOX = _struct(l=_D, t=_D, r=_D, b=_D, coord_origin=_S, relative=T.BooleanType(), reference=SIZE)
ERROR = _struct(module_class=_S, traceback=_S)
ITEM = _struct(category=_S, box=BOX, text=_S, id=_S, class_name=_S, confidence=_D, parent=_S)
CELL = _struct(box=BOX, text=_S, uri=_S)
#: What an image is made from; pixels are read late.
IMAGE = _struct(file_path=_S, page_idx=_I, dpi=_I, max_image_size=_I)
PAGE = _struct(
    text=_S, raw_response=_S, items=T.ArrayType(ITEM), text_cells=T.ArrayType(CELL), error=ERROR, image=IMAGE, page_number=_I,
    latency=_D, prompt_tokens=_I, completion_tokens=_I, reasoning_tokens=_I,
)
DOCUMENT = _struct(file_path=_S, pages=T.ArrayType(PAGE), error=ERROR, metadata=T.MapType(_S, _S), latency=_D)


def pages_of(documents: DataFrame) -> DataFrame:
    """One row per page: file_path, page_pos and the page's fields; documents without pages give none."""
    return documents.select("file_path", F.posexplode("pages").alias("page_pos", "p")).select("file_path", "page_pos", "p.*")


def items_of(pages: DataFrame) -> DataFrame:
    """One row per item: file_path, page_pos, item_pos, the item's fields and its box as l, t, r, b."""
    rows = pages.select("file_path", "page_pos", F.posexplode("items").alias("item_pos", "i"))
    return rows.select("file_path", "page_pos", "item_pos", "i.category", "i.text", "i.id", "i.class_name", "i.confidence", "i.parent", *(F.col(f"i.box.{n}").alias(n) for n in "ltrb"))


def with_items(pages: DataFrame, items: DataFrame) -> DataFrame:
    """Pages with their items from relational rows; a page without rows has an empty list."""
    box = F.struct("l", "t", "r", "b", F.lit("TOPLEFT").alias("coord_origin"), F.lit(False).alias("relative"), F.lit(None).cast(SIZE).alias("reference"))
    item = F.struct("category", box.alias("box"), "text", "id", "class_name", "confidence", "parent").cast(ITEM)
    lists = items.groupBy("file_path", "page_pos").agg(F.transform(F.array_sort(F.collect_list(F.struct("item_pos", item.alias("i")))), lambda x: x["i"]).alias("items"))
    return pages.drop("items").join(lists, ["file_path", "page_pos"], "left").withColumn("items", F.coalesce("items", F.array().cast(T.ArrayType(ITEM))))


def documents_of(pages: DataFrame) -> DataFrame:
    """Documents with their pages in order, and whether any page failed."""
    known = set(pages.columns)
    page = F.struct(*(F.col(f.name).cast(f.dataType).alias(f.name) if f.name in known else F.lit(None).cast(f.dataType).alias(f.name) for f in PAGE.fields))
    rows = pages.groupBy("file_path").agg(F.transform(F.array_sort(F.collect_list(F.struct("page_pos", page.alias("p")))), lambda x: x["p"]).alias("pages"))
    return rows.withColumn("is_error", F.exists("pages", lambda p: p["error"].isNotNull()))
