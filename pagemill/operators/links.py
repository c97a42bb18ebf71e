"""Hyperlinks of word cells carried over to items and page texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from pagemill.functions import geometry as G
from pagemill.functions.text import in_order, stripped
from pagemill.functions.uris import TOGETHER, linked

#: Characters that ``stripped`` takes away; rows and bytes of an Arrow batch of cells or pages, at most.
BLANK, BATCH_ROWS, BATCH_BYTES = " \t\n\x0b\f\r", 1 << 13, 8 << 20
#: What places a cell.
PLACE = ("t", "l", "b", "cell_pos")


def candidates(items: DataFrame, cells: DataFrame, share: float = 0.3) -> DataFrame:
    """Pairs of an item and a linked cell with that share of its area in the item: page_id, item_pos, cell_pos, cell_text, uri."""
    named = cells.where("uri is not null and uri <> ''").select("page_id", "cell_pos", F.col("text").alias("cell_text"), "uri", *(F.col(n).alias(f"c_{n}") for n in "ltrb"))
    cell = G.box("c_")
    met = items.join(named, "page_id").where(G.overlaps(G.box(), cell) & (G.over_self(cell, G.box()) >= share))
    return met.select("page_id", "item_pos", "cell_pos", "cell_text", "uri")


def phrases(cells: DataFrame) -> DataFrame:
    """page_id, uri, phrase: the texts of all cells with one uri, in reading order."""
    return _phrases(cells).drop("first")


def _phrases(cells: DataFrame) -> DataFrame:
    """With the first place that a cell of the uri has, blank ones included."""
    named = cells.where("uri is not null and uri <> ''").withColumn("_text", stripped(F.col("text")))
    text = in_order(F.when(F.col("_text") != "", F.col("_text")), F.col("t"), F.col("l"), F.col("cell_pos"), separator=" ")
    return named.groupBy("page_id", "uri").agg(text.alias("phrase"), F.min("cell_pos").alias("first")).where("phrase <> ''")


def _longest_first(text: Column, uri: Column, pos: Column) -> Column:
    rows = F.array_sort(F.collect_list(F.struct((-F.length(text)).alias("n"), pos.alias("pos"), text.alias("phrase"), uri.alias("uri"))))
    return F.transform(rows, lambda r: F.struct(stripped(r["phrase"]).alias("phrase"), r["uri"].alias("uri")))


def _splice(threshold: float, escape: bool):
    @F.pandas_udf("string")
    def run(texts: pd.Series, lists: pd.Series) -> pd.Series:
        asked = [k for k, (t, p) in enumerate(zip(texts, lists, strict=True)) if t is not None and p is not None and len(p)]
        out = texts.tolist()
        for k, text in zip(asked, linked([out[k] for k in asked], [[(x["phrase"], x["uri"]) for x in lists[k]] for k in asked], threshold, escape), strict=True):
            out[k] = text
        return pd.Series(out, dtype=object)

    return run


def annotated_items(items: DataFrame, cells: DataFrame, share: float = 0.3, threshold: float = 0.7) -> DataFrame:
    """Items with links at the places of the cells that lie in them, found by their stripped texts; blank cells don't count, uris are escaped."""
    met = candidates(items, cells, share).where(stripped(F.col("cell_text")) != "")
    found = met.groupBy("page_id", "item_pos").agg(_longest_first(F.col("cell_text"), F.col("uri"), F.col("cell_pos")).alias("_phrases"))
    joined = items.join(found, ["page_id", "item_pos"], "left")
    return joined.withColumn("text", _splice(threshold, True)("text", "_phrases")).drop("_phrases")


def annotated_pages(pages: DataFrame, cells: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Pages (page_id, text) with links at the places of the phrases; uris as they are.

    Of phrases with equal length the one whose uri the cells have first goes first.
    """
    found = _phrases(cells).groupBy("page_id").agg(_longest_first(F.col("phrase"), F.col("uri"), F.col("first")).alias("_phrases"))
    return pages.join(found, "page_id", "left").withColumn("text", _splice(threshold, False)("text", "_phrases")).drop("_phrases")


def _runs(batch: pa.RecordBatch) -> pa.RecordBatch:
    """A row for each run of cells of one page: whole numbers as steps from cell to cell, the texts as one with their lengths."""
    page, text, uri = (batch.column(n) for n in ("page_id", "text", "uri"))
    starts = np.concatenate([[True], pc.fill_null(pc.not_equal(page[1:], page[:-1]), True).to_numpy(zero_copy_only=False)])
    begin = np.flatnonzero(starts)
    offsets = np.append(begin, len(page)).astype(np.int32)

    def steps(x: np.ndarray) -> pa.ListArray:
        if np.issubdtype(x.dtype, np.integer):
            x = np.where(starts, x, x - np.concatenate([x[:1], x[:-1]]))
        return pa.ListArray.from_arrays(offsets, x)

    kept = text.cast(pa.binary())
    lengths = pc.fill_null(pc.binary_length(kept), -1).to_numpy(zero_copy_only=False).astype(np.int32)
    named = pc.fill_null(pc.not_equal(uri, ""), False).to_numpy(zero_copy_only=False)
    before = np.concatenate([[0], np.cumsum(named)])[offsets].astype(np.int32)
    at = np.flatnonzero(named)
    within = (at - np.repeat(begin, np.diff(offsets))[at]).astype(np.int32)
    values = pa.ListArray.from_arrays(offsets, pc.fill_null(kept, b""))
    columns = {n: steps(batch.column(n).to_numpy(zero_copy_only=False)) for n in PLACE}
    columns |= {"lengths": pa.ListArray.from_arrays(offsets, lengths), "texts": pc.binary_join(values, b"")}
    columns |= {"at": pa.ListArray.from_arrays(before, within), "uris": pa.ListArray.from_arrays(before, uri.take(pa.array(at)))}
    return pa.RecordBatch.from_pydict({"page_id": page.take(pa.array(begin)), **columns})


def _cells(lists: pa.ListArray) -> tuple:
    """The cells in the runs of each page: number of the page, t, l, b, cell_pos, text, uri."""
    runs = lists.flatten()
    run = dict(zip((f.name for f in runs.type), runs.flatten(), strict=True))
    count = run["lengths"].value_lengths().to_numpy()
    begin = np.cumsum(count) - count

    def whole(x: np.ndarray) -> np.ndarray:
        if not np.issubdtype(x.dtype, np.integer):
            return x
        total = np.cumsum(x)
        return total - np.repeat((total - x)[np.minimum(begin, len(x) - 1)], count)

    places = [whole(run[n].flatten().to_numpy(zero_copy_only=False)) for n in PLACE]
    lengths = run["lengths"].flatten().to_numpy()
    data = b"".join(run["texts"].to_pylist())
    ends = np.concatenate([[0], np.cumsum(np.maximum(lengths, 0))]).astype(np.int32)
    text = pc.if_else(pa.array(lengths >= 0), pa.StringArray.from_buffers(len(lengths), pa.py_buffer(ends), pa.py_buffer(data)), None)
    at = run["at"].flatten().to_numpy() + np.repeat(begin, run["at"].value_lengths().to_numpy())
    which = np.full(len(lengths), -1)
    which[at] = np.arange(len(at))
    uri = run["uris"].flatten().take(pa.array(which, mask=which < 0))
    page = np.repeat(np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy()), count)
    return page, *places, text, uri


def _page_texts(lists: pa.ListArray) -> tuple[list[str], list[list[tuple[str, str]]]]:
    """For the cells of each page the text in lines, as ``layout.lines`` has it, and the phrases, longest first."""
    pages = len(lists)
    page, t, l, b, pos, text, uri = _cells(lists)
    order = np.lexsort((pos, l, t, page))
    page, t, l, b, pos = (x[order] for x in (page, t, l, b, pos))
    text, uri = text.take(pa.array(order)), uri.take(pa.array(order))
    starts = np.concatenate([[True], page[1:] != page[:-1]])
    middle = (t.astype(np.float64) + b) / 2
    new = starts.copy()
    new[1:] |= np.abs(middle[1:] - middle[:-1]) >= 0.6 * np.maximum(b - t, 1)[1:]
    line = np.cumsum(new)
    begin, last = line[starts], line[np.concatenate([starts[1:], [True]])]

    named: list[dict[str, list]] = [{} for _ in range(pages)]
    linked_cells = np.flatnonzero(pc.fill_null(pc.not_equal(uri, ""), False).to_numpy(zero_copy_only=False))
    some = pa.array(linked_cells)
    for k, u, x, at in zip(page[linked_cells].tolist(), uri.take(some).to_pylist(), text.take(some).to_pylist(), pos[linked_cells].tolist(), strict=True):
        first = named[k].setdefault(u, [at])
        first[0] = min(first[0], at)
        if x is not None and (x := x.strip(BLANK)):
            first.append(x)
    phrases = []
    for uris in named:
        own = [(" ".join(words), at, u) for u, (at, *words) in uris.items() if words]
        phrases.append([(x, u) for x, _, u in sorted(own, key=lambda p: (-len(p[0]), p[1], p[0], p[2]))])

    within = np.lexsort((pos, t, l, line))
    within = within[text.is_valid().to_numpy(zero_copy_only=False)[within]]
    page, line = page[within], line[within]
    shown = pc.replace_substring(text.take(pa.array(within)), "\n", " ")
    counts = np.bincount(page, minlength=pages)
    ends = np.cumsum(counts)
    first = np.zeros(len(page), bool)
    first[(ends - counts)[counts > 0]] = True
    feeds = line - np.where(first, begin[page], np.concatenate([[0], line[:-1]]))
    before = pa.array(["", " ", *("\n" * k for k in range(1, int(feeds.max(initial=0)) + 1))])
    pieces = pc.binary_join_element_wise(before.take(pa.array(np.where(first & (feeds == 0), 0, feeds + 1))), shown, "")
    texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pieces), "").to_pylist()
    left = last - begin
    left[counts > 0] = last[counts > 0] - line[ends[counts > 0] - 1]
    return [x + "\n" * k for x, k in zip(texts, left.tolist(), strict=True)], phrases


def annotated_cells(cells: DataFrame, threshold: float = 0.7) -> DataFrame:
    """``annotated_pages`` of the pages that ``layout.lines`` makes of the same cells; every cell has a place.

    The cells are dealt out once, in runs of neighbours, which take little more room than their texts.
    """
    spark = cells.sparkSession
    if not 0 < int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{BATCH_BYTES}b")
    kind = cells.schema["page_id"].dataType
    numbers = {n: "bigint" if isinstance(cells.schema[n].dataType, IntegralType) else "double" for n in PLACE}
    plain = cells.select("page_id", *(F.col(n).cast(k).alias(n) for n, k in numbers.items()), "text", "uri")
    runs = plain.mapInArrow(lambda batches: (_runs(x) for x in batches if x.num_rows), f"page_id {kind.simpleString()}, {', '.join(f'{n} array<{k}>' for n, k in numbers.items())}, lengths array<int>, texts binary, at array<int>, uris array<string>")
    grouped = runs.groupBy("page_id").agg(F.collect_list(F.struct(*runs.columns[1:])).alias("_cells"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[pa.Array] = []
        texts: list[str] = []
        phrases: list[list[tuple[str, str]]] = []

        def ready() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.concat_arrays(ids), pa.array(linked(texts, phrases, threshold, False), pa.string())], ["page_id", "text"])
            for x in (ids, texts, phrases):
                x.clear()
            return out

        held = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            own, found = _page_texts(batch.column("_cells"))
            ids.append(batch.column("page_id"))
            texts += own
            phrases += found
            held += sum(map(len, own))
            if held >= TOGETHER:
                yield ready()
                held = 0
        if ids:
            yield ready()

    return grouped.mapInArrow(run, f"page_id {kind.simpleString()}, text string")
