"""Document trees and tables: reading order, captions, HTML and Markdown."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions.text import BLANK_LINE, in_order


def pointer_path(ref: str) -> str:
    """``#/texts/0`` as the path ``$.texts[0]``."""
    return "$" + "".join(f"[{p}]" if re.fullmatch(r"\d+", p) else f".{p}" for p in ref.removeprefix("#/").split("/") if p)


def ordered(nodes: DataFrame, root: int | str, depth: int = 32) -> DataFrame:
    """Nodes below ``root`` with their place in reading order: node_id, level, path.

    ``nodes`` has node_id, parent_id and child_pos.  The walk is a recursive query that carries
    the positions from the root, whose order is the reading order; ``depth`` stops a cycle.
    The session's limit on the rows of a recursion is lifted: a corpus has more nodes.
    """
    nodes.sparkSession.conf.set("spark.sql.cteRecursionRowLimit", "-1")
    query = f"""
        WITH RECURSIVE walk(node_id, level, path) MAX RECURSION LEVEL {depth} AS (
          SELECT node_id, 1, lpad(CAST(child_pos AS STRING), 8, '0') FROM {{nodes}} WHERE parent_id = {{root}}
          UNION ALL
          SELECT n.node_id, w.level + 1, concat(w.path, '.', lpad(CAST(n.child_pos AS STRING), 8, '0')) FROM walk w JOIN {{nodes}} n ON n.parent_id = w.node_id)
        SELECT node_id, level, path FROM walk"""
    return nodes.sparkSession.sql(query, nodes=nodes.select("node_id", "parent_id", "child_pos"), root=root)


def with_captions(items: DataFrame, captions: DataFrame) -> DataFrame:
    """Items in order, each caption after its owner: id, parent, category, text, item_pos, sub_pos.

    ``items`` has id, item_pos, category and text; ``captions`` has owner, caption_pos and ref.
    """
    own = items.select("id", F.lit(None).cast(items.schema["id"].dataType).alias("parent"), "category", "text", "item_pos", F.lit(0).alias("sub_pos"))
    texts = items.select(F.col("id").alias("ref"), F.col("text"))
    owners = items.select(F.col("id").alias("owner"), "item_pos")
    added = captions.join(texts, "ref").join(owners, "owner").select(F.lit(None).cast(items.schema["id"].dataType).alias("id"), F.col("owner").alias("parent"), F.lit("caption").alias("category"), "text", "item_pos", (F.col("caption_pos") + 1).alias("sub_pos"))
    return own.unionByName(added)


def table_html(tables: DataFrame, cells: DataFrame) -> DataFrame:
    """table_id and html: every row of the grid, also empty ones; spans only where they are more than one.

    ``tables`` has table_id and num_rows; ``cells`` table_id, row, col, row_span, col_span, text, header.
    """
    span = lambda name, n: F.when(F.col(n) > 1, F.concat(F.lit(f' {name}="'), F.col(n).cast("string"), F.lit('"'))).otherwise("")
    tag = F.when(F.col("header"), "th").otherwise("td")
    shown = F.concat(F.lit("<"), tag, span("rowspan", "row_span"), span("colspan", "col_span"), F.lit(">"), "text", F.lit("</"), tag, F.lit(">"))
    rows = cells.withColumn("_cell", shown).groupBy("table_id", "row").agg(in_order(F.col("_cell"), F.col("col"), separator="\n").alias("_cells"))
    grid = tables.where("num_rows > 0").select("table_id", F.explode(F.sequence(F.lit(0), F.col("num_rows") - 1)).alias("row"))
    lines = grid.join(rows, ["table_id", "row"], "left").withColumn("_row", F.concat(F.lit("<tr>\n"), F.coalesce(F.concat("_cells", F.lit("\n")), F.lit("")), F.lit("</tr>")))
    body = lines.groupBy("table_id").agg(in_order(F.col("_row"), F.col("row"), separator="\n").alias("_body"))
    return body.select("table_id", F.concat(F.lit("<table>\n"), "_body", F.lit("\n</table>")).alias("html"))


def shown(label: Column, text: Column, level: Column, marker: Column, html: Column) -> Column:
    """Markdown of a tree item; null where it shows nothing."""
    blank = F.trim(F.coalesce(text, F.lit(""))) == ""
    return (
        F.when(label == "table", F.nullif(html, F.lit("")))
        .when(label == "picture", "![image]")
        .when(blank, F.lit(None))
        .when(label == "section_header", F.concat(F.repeat(F.lit("#"), level), F.lit(" "), text))
        .when(label == "list_item", F.concat(F.coalesce(F.nullif(marker, F.lit("")), F.lit("-")), F.lit(" "), text))
        .otherwise(text)
    )


def markdown(items: DataFrame, key: str = "doc_id") -> DataFrame:
    """key and text: the shown items (path, label, text, level, marker, html) in order of their path."""
    out = shown(*(F.col(c) for c in ("label", "text", "level", "marker", "html")))
    return items.groupBy(key).agg(in_order(out, F.col("path"), separator=BLANK_LINE).alias("text"))
