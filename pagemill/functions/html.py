"""HTML and Markdown: probes as Columns, conversion by the standard library's parser in batches."""

from __future__ import annotations

import re
from collections.abc import Callable
from html import escape, unescape
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&copy;", "©"), ("&middot;", "·"), ("&nbsp;", " "), ("&amp;", "&"))
_BLOCKS = {"p", "div", "article", "section", "main", "header", "footer", "nav", "aside", "blockquote", "ul", "ol", "pre", "address", "figure", "figcaption", "form", "fieldset", "dl", "dt", "dd", "body", "html"}
_SILENT = {"script", "style", "title", "template", "noscript"}
_VOID = {"br", "hr", "img", "meta", "link", "input", "col", "area", "base", "source", "wbr"}
_IMAGE_BLOCK = r"<img>([\s\S]*?)</img>"


# ---------------------------------------------------------------- probes


def unescaped(c: Column) -> Column:
    """The common entities as characters."""
    for name, char in _ENTITIES:
        c = F.replace(c, F.lit(name), F.lit(char))
    return c


def without_image_blocks(c: Column) -> Column:
    return F.regexp_replace(c, _IMAGE_BLOCK, "")


def title(c: Column) -> Column:
    return unescaped(F.regexp_extract(c, r"<title>([^<]*)</title>", 1))


def tagged(c: Column, tag: str) -> Column:
    """Array of the plain contents of all elements of a tag, written without attributes."""
    return F.transform(F.regexp_extract_all(c, F.lit(f"<{tag}>([^<]*)</{tag}>"), 1), unescaped)


def visible_text(c: Column) -> Column:
    """Text without scripts, styles, comments and tags, spaces evened out."""
    c = F.regexp_replace(c, r"(?s)<script\b.*?</script>|<style\b.*?</style>|<title\b.*?</title>|<!--.*?-->", " ")
    return F.trim(F.regexp_replace(unescaped(F.regexp_replace(c, r"<[^>]*>", " ")), r"[ \t\r\n]+", " "))


# ---------------------------------------------------------------- conversion


class _Markdown(HTMLParser):
    """One pass over the tags: blocks between blank lines, tables kept as they are."""

    def __init__(self, drop_head: bool):
        super().__init__(convert_charrefs=True)
        self.drop_head, self.blocks, self.line = drop_head, [], []
        self.silent, self.table, self.kept = 0, 0, []
        self.prefix, self.lists, self.href, self.pre = "", [], None, 0
        self.cell: list[str] | None = None

    def flush(self) -> None:
        text = "".join(self.line)
        text = text.strip("\n") if self.pre else re.sub(r"[ \t\r\f]*\n[ \t\r\f]*", "\n", re.sub(r"[ \t\r\f]+", " ", text)).strip()
        if text:
            self.blocks.append((self.prefix, text))
        self.line, self.prefix = [], ""

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if self.silent or tag in _SILENT or (tag == "head" and self.drop_head):
            self.silent += tag not in _VOID
        elif tag == "table" or self.table:
            self._table_tag(tag, attrs)
        elif re.fullmatch("h[1-6]", tag):
            self.flush()
            self.prefix = "#" * int(tag[1]) + " "
        elif tag == "li":
            self.flush()
            self.prefix = "  " * max(0, len(self.lists) - 1) + ("- " if not self.lists or self.lists[-1] is None else f"{self.lists[-1]}. ")
            if self.lists and self.lists[-1] is not None:
                self.lists[-1] += 1
        elif tag in _BLOCKS:
            if tag in ("ul", "ol"):
                self.flush()
                self.lists.append(1 if tag == "ol" else None)
            elif not self.prefix or self.line:
                self.flush()
            self.pre += tag == "pre"
        elif tag == "br":
            self.line.append("\n")
        elif tag == "hr":
            self.flush()
            self.blocks.append(("", "---"))
        elif tag == "a":
            self.href = (dict(attrs).get("href"), len(self.line))
        elif tag == "img":
            a = dict(attrs)
            self.line.append(f"![{a.get('alt') or ''}]({a.get('src') or ''})")

    def handle_endtag(self, tag: str) -> None:
        if self.silent:
            self.silent -= tag not in _VOID
        elif self.table:
            self._table_tag("/" + tag, [])
        elif tag == "a" and self.href:
            href, at = self.href
            text = "".join(self.line[at:])
            if href and text.strip():
                self.line[at:] = [f"[{text.strip()}]({href})"]
            self.href = None
        elif tag in _BLOCKS or tag == "li" or re.fullmatch("h[1-6]", tag):
            self.flush()
            if tag in ("ul", "ol") and self.lists:
                self.lists.pop()
            self.pre = max(0, self.pre - (tag == "pre"))

    def _table_tag(self, tag: str, attrs: list) -> None:
        inner = self.cell is not None and self.table == 1
        if tag == "table":
            self.table += 1
        if inner and tag not in ("/td", "/th", "td", "th", "/tr", "/table") and not tag.startswith("tr"):
            self.cell.append(f"<{tag}{''.join(f' {k}={chr(34)}{escape(v or str())}{chr(34)}' for k, v in attrs)}>")
        else:
            if self.cell is not None and self.table == 1:
                self.kept.append(escape(to_markdown("".join(self.cell)).strip(), quote=False))
                self.cell = None
            if self.table == 1 and not self.kept:
                self.flush()
            self.kept.append(f"<{tag}{''.join(f' {k}={chr(34)}{escape(v or str())}{chr(34)}' for k, v in attrs)}>")
            if tag in ("td", "th") and self.table == 1:
                self.cell = []
        if tag == "/table":
            self.table -= 1
            if not self.table:
                self.blocks.append(("", "".join(self.kept)))
                self.kept, self.cell = [], None

    def handle_data(self, data: str) -> None:
        if self.silent:
            return
        if self.table:
            (self.kept if self.cell is None else self.cell).append(escape(data, quote=False))
        else:
            self.line.append(data if self.pre else re.sub(r"\s+", " ", data) if self.blocks or "<" in self.rawdata else data)

    def text(self) -> str:
        self.close()
        self.flush()
        if self.kept:
            self.blocks.append(("", "".join(self.kept)))
        out = ""
        for k, (prefix, text) in enumerate(self.blocks):
            item = prefix.lstrip().startswith(("- ", *"0123456789"))
            before = k and self.blocks[k - 1][0].lstrip().startswith(("- ", *"0123456789"))
            out += ("" if not k else "\n" if item and before else "\n\n") + prefix + text
        return out


def to_markdown(html: str, drop_head: bool = False) -> str:
    """Markdown of an HTML text: # headings, - bullets, links and images; emphasis goes, tables stay HTML.

    Cells of tables are converted on their own.  A text without tags keeps its line feeds.
    """
    html = re.sub(_IMAGE_BLOCK, "", html)
    if "<" not in html:
        return unescape(html).strip()
    parser = _Markdown(drop_head)
    parser.feed(html)
    return parser.text()


_SEPARATOR = re.compile(r"\|[-:\s|]+\|")


def tables_to_html(markdown: str) -> str:
    """Pipe tables as HTML tables in one line; groups of pipe lines without a separator stay."""
    out, lines, i = [], markdown.split("\n"), 0
    piped = [x.startswith("|") and x.rstrip().endswith("|") and len(x.rstrip()) > 1 for x in lines]
    while i < len(lines):
        if not piped[i] or i + 1 >= len(lines) or not piped[i + 1] or not _SEPARATOR.fullmatch(lines[i + 1].strip()):
            out.append(lines[i])
            i += 1
            continue
        j = i + 2
        while j < len(lines) and piped[j]:
            j += 1
        cells = lambda line, tag: "<tr>" + "".join(f"<{tag}>{c.strip()}</{tag}>" for c in line.strip()[1:-1].split("|")) + "</tr>"
        body = "".join(cells(x, "td") for x in lines[i + 2 : j])
        out.append(f"<table><thead>{cells(lines[i], 'th')}</thead>{f'<tbody>{body}</tbody>' if body else ''}</table>")
        i = j
    return "\n".join(out)


class _Divs(HTMLParser):
    """Top-level divs with their attributes and what stands inside."""

    def __init__(self):
        super().__init__(convert_charrefs=False)
        self.depth, self.found, self.begin = 0, [], 0

    def _offset(self) -> int:
        line, column = self.getpos()
        return self.starts[line - 1] + column

    def run(self, text: str) -> list[tuple[dict, str]]:
        self.starts = [0, *(m.end() for m in re.finditer("\n", text))]
        self.feed(text)
        self.close()
        return self.found

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in _VOID:
            return
        if not self.depth:
            self.open, self.begin = (tag, dict(attrs)), self._offset() + len(self.get_starttag_text())
        self.depth += 1

    def handle_endtag(self, tag: str) -> None:
        if self.depth and tag not in _VOID:
            self.depth -= 1
            if not self.depth and self.open[0] == "div":
                self.found.append((self.open[1], self.rawdata[self.begin : self._offset()]))


def top_divs(html: str) -> list[tuple[dict, str]]:
    return _Divs().run(html)


def in_batches(f: Callable[[str], str | None]) -> Callable[[Column], Column]:
    """A Column function that applies ``f`` to the non-null values of each Arrow batch."""

    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else f(v))

    return run
