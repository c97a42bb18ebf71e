"""Connected components on DataFrames by alternating large-star and small-star steps, small rests in one task."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.store import saved, scratch

#: So many edges are solved by one task (a few MB); rounds of star steps deal out more stages than that is worth.
ALONE = 1 << 18


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Rows (node, label): label is the smallest node reachable from node.  Edges are (u, v), long.

    Nodes without an edge aren't returned.  Each round's edges go to a table in the shared
    folder; the number of edges never exceeds nodes plus first edges, and no node's
    neighbours are gathered in one row.  Up to ``ALONE`` edges, those given or those of a round, are solved by one task.
    """
    with scratch(edges.sparkSession):
        return saved(_settled(edges, max_rounds), "components", keep=True)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, label) of edges that one task reads: each tree's root is its smallest node."""
    root: dict[int, int] = {}

    def top(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = x = root[up]
        return x

    for b in batches:
        for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            u, v = top(u), top(v)
            root[max(u, v)] = min(u, v)
    yield pa.RecordBatch.from_arrays([pa.array(list(root), pa.int64()), pa.array([top(x) for x in list(root)], pa.int64())], names=["node", "label"])


def _settled(edges: DataFrame, max_rounds: int) -> DataFrame:
    now = saved(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    state = _state(now)
    for _ in range(max_rounds):
        if state[0] <= ALONE:
            return now.coalesce(1).mapInArrow(_joined, "node long, label long")
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        kept = large.join(least, "u").select("u", "v", "m")
        small = kept.select("u", F.col("m").alias("v")).unionByName(kept.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct()
        now = saved(small, "edges")
        before, state = state, _state(now)
        if state == before:
            break
    else:
        raise RuntimeError("components did not settle")
    label = now.groupBy("u").agg(F.min("v").alias("label")).select(F.col("u").alias("node"), "label")
    return label.unionByName(label.select(F.col("label").alias("node"), "label").distinct())
