"""Tables in the cluster's shared folder, table loading and bounded label samples."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Rows and bytes of an Arrow batch, at most: also very long texts make batches that a worker holds easily.
BATCH_ROWS, BATCH_BYTES = 1024, 8 << 20


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Lower the session's limits of Arrow batches to ``BATCH_ROWS`` and ``BATCH_BYTES`` where the rows are unlimited or more."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, BATCH_ROWS)
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{BATCH_BYTES}b")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where none is set and all run on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="pagemill-")
        spark.sparkContext.setCheckpointDir(found)
    return found


#: Paths and catalog names of the tables that end with each open ``scratch``, the innermost last.
_open: ContextVar[tuple[list[tuple[str, str | None]], ...]] = ContextVar("_open", default=())


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that ``saved`` and ``bucketed`` write within are deleted at the end; one to ``keep`` lives as long as the scratch around it."""
    tables: list[tuple[str, str | None]] = []
    token = _open.set((*_open.get(), tables))
    try:
        yield
    finally:
        _open.reset(token)
        for path, name in tables:
            if name:
                spark.sql(f"DROP TABLE IF EXISTS {name}")
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)
        forget(spark)


def forget(spark: SparkSession) -> None:
    """Let the driver notice which shuffles no plan holds any more: only then their files go; its Python returns what it has freed.

    Executors return what their heaps have grown by and don't use: without a full collection a heap stays as large as it ever was.
    """
    gc.collect()
    give_back()
    spark._jvm.System.gc()
    if spark.sparkContext.master.split("[")[0] != "local":
        slots = spark.sparkContext.defaultParallelism
        spark.range(0, slots, 1, slots).select(F.reflect(F.lit("java.lang.System"), F.lit("gc"))).collect()


def give_back() -> None:
    """Return what this Python worker has freed to the system; workers live on from task to task."""
    pa.default_memory_pool().release_unused()
    trim = getattr(_C, "malloc_trim", None)
    if trim:
        trim(0)


_C = ctypes.CDLL(None)


def saved(df: DataFrame, name: str = "table", keep: bool = False) -> DataFrame:
    """Write ``df`` into the shared folder and read it back: lineage ends there, on files all executors see."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    for tables in _open.get()[: -1 if keep else None][-1:]:
        tables.append((path, None))
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str, buckets: int, name: str) -> DataFrame:
    """``df``, dealt by ``key`` into so many partitions, as a table in the shared folder: joins on ``key`` read it where it is."""
    spark, table = df.sparkSession, f"{name}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{table}"
    for tables in _open.get()[-1:]:
        tables.append((path, table))
    df.write.bucketBy(buckets, key).option("path", path).saveAsTable(table, format="parquet")
    return spark.table(table)


def crc_rest(doc_id: Column | str, divisor: int) -> Column:
    """crc32(doc_id as text) mod divisor; null for a null id."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(col.cast("string").cast("binary")) % divisor


def label_sample(keys: DataFrame, strata: str, per_stratum: int, total: int = 1 << 30) -> DataFrame:
    """At most ``per_stratum`` doc_ids of each value of ``strata``, and at most ``total`` of all, chosen by a hash of doc_id.

    ``keys`` has doc_id and the stratum.  A fixed hash makes the choice the same in every run.
    A stratum's size sets the part of the hashes that is looked at, a little more than needed;
    these few rows are ranked by the driver, so no task gets all rows of a stratum.  A doc_id
    with several values teaches nothing.
    """
    spark, span = keys.sparkSession, 1 << 40
    keys = keys.where(F.col("doc_id").isNotNull() & F.col(strata).isNotNull()).select("doc_id", strata)
    sizes = {r[0]: r[1] for r in keys.groupBy(strata).count().collect()}
    most = max(1, min(per_stratum, total // max(1, len(sizes))))
    rank = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(span))
    part = F.map_from_arrays(F.array(*map(F.lit, sizes)), F.array(*(F.lit(int(min(1.0, (1.2 * most + 200) / n) * span)).cast("long") for n in sizes.values()))) if sizes else None
    near = sorted(keys.where(rank <= part[F.col(strata)]).select(rank, "doc_id", strata).distinct().collect()) if sizes else []
    ids = spark.createDataFrame([(r[1],) for r in near], "doc_id long")
    values = {r[0]: r[1] for r in keys.join(F.broadcast(ids.distinct()), "doc_id", "left_semi").groupBy("doc_id").agg(F.countDistinct(strata)).collect()}
    taken, chosen = dict.fromkeys(sizes, 0), []
    for _, doc, value in near:
        if values[doc] == 1 and taken[value] < most:
            taken[value] += 1
            chosen.append((doc, value))
    return spark.createDataFrame(chosen, keys.schema)


def text_bytes(docs: DataFrame, column: str = "text") -> int:
    return int(docs.agg(F.coalesce(F.sum(F.octet_length(column)), F.lit(0))).first()[0])
