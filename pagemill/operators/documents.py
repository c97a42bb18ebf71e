"""Documents made of pages made of items: projections, roll-ups and routing.

The relational form keeps one row per page or item with its document's key and its position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions.text import BLANK_LINE, in_order

#: Suffixes of files that are read as one-page images.
IMAGE_SUFFIXES = (".png", ".jpg", ".jpeg", ".tiff", ".tif", ".bmp", ".gif", ".webp")
PDF_SUFFIX = ".pdf"


def file_kind(suffix: Column) -> Column:
    return F.when(suffix == PDF_SUFFIX, "pdf").when(suffix.isin(*IMAGE_SUFFIXES), "image").otherwise("unsupported")


def page_count(suffix: Column, pdf_pages: Column) -> Column:
    """Pages of a file: a PDF's own count, one for anything else."""
    return F.when(suffix == PDF_SUFFIX, pdf_pages).otherwise(1)


def selected_pages(spec: Column, pages: Column | None = None) -> Column:
    """Sorted 0-based pages of a selection such as ``1-5,8``; what isn't one raises an error.

    Parts count from 1, ranges hold both ends, blank parts are skipped; with ``pages`` numbers
    beyond the document are left out.
    """
    parts = F.filter(F.transform(F.split(spec, ","), lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: p != "")

    def numbers(part: Column) -> Column:
        first, last = F.regexp_extract(part, r"^(\d+)", 1), F.regexp_extract(part, r"(\d+)$", 1)
        low, high = F.try_to_number(first, F.lit("999999999")).cast("int"), F.try_to_number(last, F.lit("999999999")).cast("int")
        good = part.rlike(r"^\d+(\s*-\s*\d+)?$") & (low >= 1) & (low <= high)
        return F.when(good, F.sequence(F.when(good, low).otherwise(1) - 1, F.when(good, high).otherwise(1) - 1)).otherwise(F.raise_error(F.concat(F.lit("no page selection: "), part)).cast("array<int>"))

    out = F.array_sort(F.array_distinct(F.flatten(F.transform(parts, numbers))))
    return out if pages is None else F.filter(out, lambda p: p < pages)


def requested_pages(requests: DataFrame, documents: DataFrame) -> DataFrame:
    """Pages to process in the order asked: (doc_id, page_number, page_pos).

    ``requests`` has doc_id, request_pos and page_number; repeated requests count once, at
    their first place, and pages that ``documents`` (doc_id, num_pages) lacks are dropped.
    """
    from pyspark.sql import Window

    first = requests.groupBy("doc_id", "page_number").agg(F.min("request_pos").alias("request_pos"))
    there = first.join(documents, "doc_id").where((F.col("page_number") >= 0) & (F.col("page_number") < F.col("num_pages")))
    return there.select("doc_id", "page_number", (F.row_number().over(Window.partitionBy("doc_id").orderBy("request_pos")) - 1).alias("page_pos"))


def page_markdown(text: Column, items: Column) -> Column:
    """A page's text, or else its non-empty item texts (an array), or else nothing."""
    return F.coalesce(text, F.array_join(F.filter(items, lambda x: x != ""), BLANK_LINE), F.lit(""))


def document_texts(pages: DataFrame) -> DataFrame:
    """doc_id, text (pages without text left out) and markdown (these kept, as empty)."""
    return pages.groupBy("doc_id").agg(in_order(F.col("text"), F.col("page_pos")).alias("text"), in_order(F.coalesce("text", F.lit("")), F.col("page_pos")).alias("markdown"))


def outcome(failed: Column) -> Column:
    return F.when(failed, "errors").otherwise("results")


def unprocessed(files: DataFrame, done: DataFrame) -> DataFrame:
    """``files`` (file) without those whose name is in ``done`` (file) with .zip for .pdf."""
    name = lambda suffix: F.regexp_replace(F.regexp_extract("file", r"([^/]*)$", 1), f"\\{suffix}$", "")
    return files.withColumn("_name", name(".pdf")).join(done.select(name(".zip").alias("_name")).distinct(), "_name", "left_anti").drop("_name")
