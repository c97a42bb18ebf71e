"""Layout categories: raw labels of many models mapped to eleven unified ones."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unified category and the normalised raw labels it stands for.
UNIFIED = {
    "table": ("table",),
    "image": ("image", "picture", "chart", "figure", "footer_image", "header_image"),
    "caption": ("caption", "figure_caption", "figure_title", "table_caption"),
    "footnote": ("footnote", "vision_footnote", "table_footnote"),
    "footer": ("footer", "page_footer"),
    "header": ("header", "page_header"),
    "title": ("title", "section_header", "doc_title", "paragraph_title"),
    "list_item": ("list_item", "list_group"),
    "formula": ("formula", "display_formula", "inline_formula", "equation_block", "equation", "formula_number", "isolate_formula", "embeded_formula", "interline_equation"),
    "text": ("text", "paragraph", "abstract", "algorithm", "content", "reference_content", "vertical_text", "aside_text", "reference"),
    "other": ("number", "seal", "complex_block", "code_block", "code", "form", "table_of_contents", "abandon", "other", "unknown"),
}
OTHER = "other"

#: Recognition task of a region label; labels not listed are text.
TASKS = {
    "table": ("table",),
    "formula": ("display_formula", "inline_formula"),
    "skip": ("chart", "image", "footer_image", "header_image"),
}
#: The stricter task map, which leaves out page furniture.
STRICT_TASKS = {
    "table": ("table",),
    "formula": ("display_formula", "inline_formula"),
    "skip": ("chart", "image"),
    "abandon": ("header", "footer", "number", "footnote", "aside_text", "reference", "footer_image", "header_image"),
}
#: Categories whose items get a description by default.
DESCRIBED = ("image", "picture", "chart", "figure")


def _lookup(groups: dict[str, tuple[str, ...]], key: Column, default: str) -> Column:
    by_label = {label: group for group, labels in groups.items() for label in labels}
    found = F.create_map(*map(F.lit, chain.from_iterable(by_label.items())))
    return F.coalesce(F.try_element_at(found, key), F.lit(default))


def normalized(category: Column) -> Column:
    return F.translate(F.lower(category), "- ", "__")


def unified(category: Column) -> Column:
    return _lookup(UNIFIED, normalized(category), OTHER)


def task(label: Column, groups: dict[str, tuple[str, ...]] | None = None) -> Column:
    """text, table, formula, skip or abandon for a region label as it comes."""
    return _lookup(TASKS if groups is None else groups, label, "text")


def sql_case(groups: dict[str, tuple[str, ...]], key: str, default: str) -> str:
    """The same lookup as an SQL expression."""
    whens = " ".join(f"WHEN {key} IN ({', '.join(map(repr, labels))}) THEN '{group}'" for group, labels in groups.items())
    return f"CASE {whens} ELSE '{default}' END"
