"""Questions from document blocks to key shards and the answers back, as packed arrays.

A *block* is a few MB of documents, dealt by a hash; a *shard* owns a range of hashed keys.
Each block asks every key once, however often the block holds it, so a key that a third of
all documents share costs each shard one entry a block.  Rows are never more than keys asked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.store import give_back
from pagemill.llm.words import mix

BLOCK_BYTES = 4 << 20


def with_blocks(docs: DataFrame, total_bytes: int, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, str]:
    """A block number before the columns of ``docs``, and the name of its column.

    The number of blocks follows the size of the input.
    """
    n, name = max(1, -(-total_bytes // block_bytes)), "_block"
    while name in docs.columns:
        name += "_"
    return docs.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int").alias(name), *(F.col(f"`{c}`") for c in docs.columns)), name


def shards_of(keys: np.ndarray, n_shards: int) -> np.ndarray:
    return (mix(keys ^ np.uint64(0x5851F42D4C957F2D)) % np.uint64(n_shards)).astype(np.int64)


def planes(values: np.ndarray) -> bytes:
    """All first bytes, then all second bytes and so on: what sorted keys, ids and counts share compresses away."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes()


def from_planes(packed: list[bytes], dtype: type) -> np.ndarray:
    """The arrays of all ``packed``, joined."""
    width = np.dtype(dtype).itemsize
    out, at = np.empty((sum(len(p) for p in packed) // width, width), dtype=np.uint8), 0
    for p in packed:
        part = np.frombuffer(p, dtype=np.uint8).reshape(width, -1)
        out[at : at + part.shape[1]] = part.T
        at += part.shape[1]
    return out.view(dtype).ravel()


def questions(block: int, keys: np.ndarray, columns: dict[str, np.ndarray], n_shards: int) -> pa.Table:
    """One row for each shard that owns some of ``keys``, with these keys and their columns packed."""
    shard = shards_of(keys, n_shards)
    order = np.argsort(shard, kind="stable")
    cut = np.searchsorted(shard[order], np.arange(n_shards + 1))
    full = np.flatnonzero(np.diff(cut))
    packed = {"key": keys[order], **{k: v[order] for k, v in columns.items()}}
    out = {"shard": pa.array(full, pa.int32()), "block": pa.array(np.full(len(full), block), pa.int32())}
    for name, values in packed.items():
        out[name] = pa.array([planes(values[cut[s] : cut[s + 1]]) for s in full], pa.binary())
    give_back()
    return pa.table(out)


def question_schema(columns: list[str]) -> str:
    return "shard int, block int, key binary" + "".join(f", {c} binary" for c in columns)


def unpacked(table: pa.Table, types: dict[str, type]) -> tuple[list[int], np.ndarray, dict[str, np.ndarray]]:
    """Of a shard's rows: the blocks, where each block's part begins, and the joined arrays.

    Rows come in order of the block, so equal inputs give equal outputs.
    """
    order = np.argsort(table.column("block").to_numpy(), kind="stable")
    blocks = table.column("block").to_numpy()[order].tolist()
    out = {}
    for name, kind in types.items():  # one column at a time, and no copy of the table in order
        rows = table.column(name)
        out[name] = from_planes([rows[int(k)].as_buffer() for k in order], kind)
        if name == "key":
            cut = np.concatenate(([0], np.cumsum([len(rows[int(k)].as_buffer()) // 8 for k in order]))).astype(np.int64)
    return blocks, cut, out


def answers(shard: int, blocks: list[int], cut: np.ndarray, values: np.ndarray) -> pa.Table:
    return pa.table({
        "block": pa.array(blocks, pa.int32()),
        "shard": pa.array([shard] * len(blocks), pa.int32()),
        "answer": pa.array([planes(values[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary()),
    })


ANSWER_SCHEMA = "block int, shard int, answer binary"


def answered(table: pa.Table, keys: np.ndarray, n_shards: int, dtype: type) -> np.ndarray:
    """The answers to ``keys``, in their order, from all shards' rows for this block."""
    shard = shards_of(keys, n_shards)
    order = np.argsort(shard, kind="stable")
    rows = sorted(zip(table.column("shard").to_pylist(), table.column("answer").to_pylist(), strict=True))
    joined = from_planes([r[1] for r in rows], dtype)
    if len(joined) != len(keys):
        raise ValueError(f"{len(keys)} keys asked, {len(joined)} answered")
    out = np.empty(len(keys), dtype=dtype)
    out[order] = joined
    give_back()
    return out


def groups(keys: np.ndarray, *more: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A sorting order by key (and further keys), and where each group of equals begins in it."""
    order = np.lexsort((*reversed(more), keys)) if more else np.argsort(keys, kind="stable")
    new = np.ones(len(keys), dtype=bool)
    if len(keys) > 1:
        new[1:] = keys[order][1:] != keys[order][:-1]
        for m in more:
            new[1:] |= m[order][1:] != m[order][:-1]
    return order, np.flatnonzero(new)


def spread(order: np.ndarray, begin: np.ndarray, per_group: np.ndarray) -> np.ndarray:
    """Give each original row its group's value."""
    out = np.empty(len(order), dtype=per_group.dtype)
    out[order] = np.repeat(per_group, np.diff(np.append(begin, len(order))))
    return out


def pieces(table: pa.Table, rows: int = 4096) -> Iterator[pa.Table]:
    for i in range(0, table.num_rows, rows):
        yield table.slice(i, rows)
