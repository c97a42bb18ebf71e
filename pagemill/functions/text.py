"""Text of responses and pages as Columns."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Typographic characters and their plain forms, in pairs.
FANCY = "‘’‚“”„＿–—‑‒−µ"
PLAIN = "'''\"\"\"_-----μ"
BLANK_LINE = "\n\n"


def stripped(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def _cut_prefix(c: Column, prefix: str) -> Column:
    return F.when(c.startswith(prefix), F.substr(c, F.lit(len(prefix) + 1))).otherwise(c)


def _cut_suffix(c: Column, suffix: str) -> Column:
    return F.when(c.endswith(suffix), F.substr(c, F.lit(1), F.length(c) - len(suffix))).otherwise(c)


def clean_response(c: Column) -> Column:
    """Without one code fence on either side and the words markdown and html after it."""
    c = _cut_suffix(_cut_prefix(stripped(c), "```"), "```")
    return stripped(_cut_prefix(_cut_prefix(c, "markdown"), "html"))


@F.pandas_udf(StringType())
def _composed(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFC", t))


def composed(c: Column) -> Column:
    """NFC; the batch goes through Python, texts that are ASCII untouched."""
    return _composed(c)


def normalize_text(c: Column, extra: dict[str, str] | None = None, only_alphanumeric: bool = False, drop_images: bool = True) -> Column:
    """Markdown reduced to plain, evenly spaced text in NFC."""
    for pattern, to in (
        (r"<br/?>", " "), (r"[ \t]+", " "), (r"[-=]{3,}", ""), (r"\n *", "\n"), (r"\n{2,}", "\n\n"),
        (r"\*\*(.*?)\*\*", "$1"), (r"</?[bi]>", ""), (r"\*(.*?)\*", "$1"), (r" {2,}", " "),
    ):
        c = F.regexp_replace(c, f"(?d){pattern}" if "." in pattern else pattern, to)
    c = F.translate(composed(c), FANCY, PLAIN)
    for old, new in (extra or {}).items():
        c = F.replace(c, F.lit(old), F.lit(new))
    if only_alphanumeric:
        c = F.regexp_replace(c, "[^a-zA-Z0-9]", "")
    if drop_images:
        c = F.regexp_replace(c, r"!\[[\s\S]*?]\([\s\S]*?\)", "")
    return stripped(c)


def repeats_at_end(c: Column, longest: int = 250, base: float = 4.0, scale: float = 3.0) -> Column:
    """Whether the text ends in some unit repeated more often than its length allows.

    A unit of n characters may stand ``int(base * (1 + scale / n))`` times; one time more fails.
    """

    allowed = [(n, n * (int(base * (1 + scale / n)) + 1)) for n in range(1, longest + 1)]

    def broken(end: Column, unit: Column) -> Column:
        n, whole = unit["n"], unit["whole"]
        # one character first: it settles most units
        same = F.substr(end, F.lit(1), F.lit(1)) == F.substr(end, n + 1, F.lit(1))
        return (F.length(end) >= whole) & same & (F.left(end, whole) == F.repeat(F.left(end, n), (whole / n).cast("int")))

    units = F.array(*(F.struct(F.lit(n).alias("n"), F.lit(whole).alias("whole")) for n, whole in allowed))
    # bound once and backwards, so that the units look at the start of a short text and not each at the whole
    ends = F.array(F.reverse(F.right(c, F.lit(max(whole for _, whole in allowed)))))
    return F.exists(ends, lambda end: F.exists(units, lambda unit: broken(end, unit)))


def repeats_near_end(c: Column, cut: int = 50) -> Column:
    """``repeats_at_end``, with a second look without the last characters."""
    return repeats_at_end(c) | ((F.length(c) > cut) & repeats_at_end(F.substr(c, F.lit(1), F.length(c) - cut)))


def paragraphs(c: Column) -> Column:
    """Array of the non-blank parts between blank lines."""
    return F.filter(F.transform(F.split(c, "\n{2,}"), stripped), lambda x: x != "")


def slug(c: Column, fallback: str) -> Column:
    """Lower-case letters, digits, - and _; starts with a letter or digit and ends in neither sign."""
    c = F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9_-]+", "-"), "^[^a-z0-9]+|[-_]+$", "")
    return F.when(F.coalesce(c, F.lit("")) == "", fallback).otherwise(c)


def wrapped(c: Column, width: int) -> Column:
    """A line feed after every ``width`` characters but the last."""
    return F.regexp_replace(c, f"(?s)(.{{{width}}})(?=.)", "$1\n")


def stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)/*$", 1), r"(?<=.)\.[^.]*$", "")


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(F.regexp_extract(path, r"([^/]*)/*$", 1), r".(\.[^.]+)$", 1))


def item_markdown(text: Column, uri: Column) -> Column:
    return F.when(F.coalesce(uri, F.lit("")) != "", F.concat(F.lit("["), text, F.lit("]("), uri, F.lit(")"))).otherwise(text)


def in_order(text: Column, *order: Column, separator: str = BLANK_LINE) -> Column:
    """Aggregate: the group's texts joined in the given order.

    ``order`` must be unique in a group; nulls are left out, empty texts kept.
    """
    rows = F.array_sort(F.collect_list(F.when(text.isNotNull(), F.struct(*(o.alias(f"o{i}") for i, o in enumerate(order)), text.alias("text")))))
    return F.array_join(F.transform(rows, lambda x: x["text"]), separator)


def described_list(categories: dict[str, str]) -> str:
    return "\n".join(f'- "{name}": {what}' for name, what in categories.items())


def quoted_list(names: list[str]) -> str:
    return ", ".join(f'"{n}"' for n in names)
