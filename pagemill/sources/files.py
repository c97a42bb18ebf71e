"""Files in and documents out.

Inputs are read with Spark's ``binaryFile``; saved documents are zips with one JSON member.
Files are written by the tasks into a folder that all executors mount, under a temporary name
first, so a task that runs twice leaves one whole file.
"""

from __future__ import annotations

import io
import os
import re
import uuid
import zipfile
from collections.abc import Iterator
from typing import Protocol

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, StringType

from pagemill.functions import geometry as G
from pagemill.functions.text import in_order, stem, stripped, suffix
from pagemill.operators.documents import file_kind, outcome, page_count

#: The JSON member of a saved document.
MEMBER = "data.json"


def input_files(spark: SparkSession, inputs: str | list[str], required: bool = False) -> DataFrame:
    """path, length, suffix, kind of the files that the inputs name.

    An input with * or ? is a pattern, a folder stands for its files (one level, names with a
    dot), a file for itself; what isn't there is left out, repeated files stay repeated.
    """
    jvm, found = spark.sparkContext._jvm, []
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for text in [inputs] if isinstance(inputs, str) else inputs:
        path = jvm.org.apache.hadoop.fs.Path(text)
        fs = path.getFileSystem(conf)
        if re.search(r"[*?]", text):
            states = fs.globStatus(path) or []
        elif not fs.exists(path):
            continue
        else:
            states = fs.globStatus(jvm.org.apache.hadoop.fs.Path(path, "*.*")) if fs.getFileStatus(path).isDirectory() else [fs.getFileStatus(path)]
        found += [(s.getPath().toString(), s.getLen()) for s in states if s.isFile()]
    if required and not found:
        raise FileNotFoundError(f"no files in {inputs}")
    df = spark.createDataFrame(found, "path string, length long")
    return df.withColumn("suffix", suffix(F.col("path"))).withColumn("kind", file_kind(F.col("suffix")))


@F.pandas_udf(IntegerType())
def pdf_page_marks(content: pd.Series) -> pd.Series:
    """Page objects in a PDF that isn't compressed; a stand-in for a PDF library's count."""
    return content.map(lambda c: None if c is None else len(re.findall(rb"/Type\s*/Page(?![a-zA-Z])", c))).astype("Int32")


def with_page_counts(files: DataFrame) -> DataFrame:
    """Files (path, content) with n_pages: a PDF's own count, else one."""
    kind = suffix(F.col("path"))
    return files.withColumn("n_pages", page_count(kind, pdf_page_marks("content")))


class PageReader(Protocol):
    """What reads a page of a file; a PDF library outside of this package."""

    def render(self, content: bytes, page: int, dpi: int) -> bytes:
        """The page as an encoded image."""

    def cells(self, content: bytes, page: int) -> tuple[list[dict], float, float]:
        """Word cells with their origin at the bottom left, and the page's width and height."""


def rendered(pages: DataFrame, reader: PageReader, dpi: int = 175) -> DataFrame:
    """path, page_number, image, error of pages (path, content, page_number)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            images, errors = [], []
            for r in b.to_pylist():
                try:
                    images.append(reader.render(r["content"], r["page_number"], dpi))
                    errors.append(None)
                except Exception as e:  # noqa: BLE001  a bad page is a row with an error
                    images.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield pa.RecordBatch.from_arrays([b.column("path"), b.column("page_number").cast(pa.int32()), pa.array(images, pa.binary()), pa.array(errors, pa.string())], names=["path", "page_number", "image", "error"])

    return pages.select("path", "content", "page_number").mapInArrow(run, "path string, page_number int, image binary, error string")


def page_cells(pages: DataFrame, reader: PageReader) -> DataFrame:
    """path, page_number, cell_pos, l, t, r, b, text, uri: cells with a box and a text, from the top left.

    A page that can't be read has no cells.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("path", pa.string()), ("page_number", pa.int32()), ("cell_pos", pa.int32()), *((n, pa.float64()) for n in "ltrb"), ("height", pa.float64()), ("text", pa.string()), ("uri", pa.string())])
        for b in batches:
            rows = []
            for r in b.to_pylist():
                try:
                    cells, _, height = reader.cells(r["content"], r["page_number"])
                except Exception:  # noqa: BLE001
                    continue
                rows += [{"path": r["path"], "page_number": r["page_number"], "cell_pos": k, "height": height, **c} for k, c in enumerate(cells)]
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    low = pages.select("path", "content", "page_number").mapInArrow(run, "path string, page_number int, cell_pos int, l double, t double, r double, b double, height double, text string, uri string")
    up = G.flipped(G.box(), F.col("height"))
    return low.withColumns(up._asdict()).where(G.valid(G.box()) & (stripped(F.col("text")) != "")).drop("height")


# ---------------------------------------------------------------- saved documents


@F.pandas_udf(BinaryType())
def zipped(texts: pd.Series) -> pd.Series:
    """Each JSON text as a zip with one member."""

    def one(t: str | None) -> bytes | None:
        if t is None:
            return None
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr(zipfile.ZipInfo(MEMBER), t, zipfile.ZIP_DEFLATED)
        return out.getvalue()

    return texts.map(one)


@F.pandas_udf(StringType())
def unzipped(contents: pd.Series) -> pd.Series:
    """The JSON member of each zip; one that lacks it is an error."""

    def one(c: bytes | None) -> str | None:
        if c is None:
            return None
        with zipfile.ZipFile(io.BytesIO(c)) as z:
            if MEMBER not in z.namelist():
                raise FileNotFoundError(f"{MEMBER} is not in the zip")
            return z.read(MEMBER).decode()

    return contents.map(one)


def saved_documents(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """path and document (a struct of ``schema``) of all zips below a folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").option("recursiveFileLookup", "true").load(folder)
    return files.select("path", F.from_json(unzipped("content"), schema).alias("document"))


def held(df: DataFrame, folder: str) -> tuple[DataFrame, str]:
    """``df``, written once into a run's folder and read from there, and where it is; ``delete`` it in the end."""
    path = os.path.join(folder, f"_held-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def last_run(spark: SparkSession, folder: str) -> str | None:
    """The last by name of the folder's runs."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    states = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)
    return max((s.getPath().getName() for s in states if s.isDirectory()), default=None)


def write_files(files: DataFrame, folder: str, overwrite: bool = True) -> DataFrame:
    """Write (name, content) below a mounted folder; gives name and bytes written when it is evaluated."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, sizes = b.column("name").to_pylist(), []
            for name, content in zip(names, b.column("content").to_pylist(), strict=True):
                path = os.path.join(folder, name)
                os.makedirs(os.path.dirname(path), exist_ok=True)
                if not overwrite and os.path.exists(path):
                    raise FileExistsError(path)
                part = f"{path}.{uuid.uuid4().hex}.part"
                with open(part, "wb") as f:
                    f.write(content)
                os.replace(part, path)
                sizes.append(len(content))
            yield pa.RecordBatch.from_arrays([b.column("name"), pa.array(sizes, pa.int64())], names=["name", "n_bytes"])

    return files.select("name", F.col("content").cast("binary").alias("content")).mapInArrow(run, "name string, n_bytes long")


def document_files(documents: DataFrame, failed: Column) -> DataFrame:
    """name and content of zips: errors/ or results/, the input's stem, the document (file_path and more) as JSON."""
    name = F.concat(outcome(failed), F.lit("/"), stem(F.col("file_path")), F.lit(".zip"))
    return documents.select(name.alias("name"), zipped(F.to_json(F.struct("*"))).alias("content"))


def markdown_files(pages: DataFrame, per_page: bool = False) -> DataFrame:
    """name and content of Markdown files of pages (file_path, page_pos, text): one a document or one a page.

    Pages without text count as empty; page files are numbered from 1 by place.
    """
    from pyspark.sql import Window

    name, text = stem(F.col("file_path")), F.coalesce("text", F.lit(""))
    if per_page:
        n = F.row_number().over(Window.partitionBy("file_path").orderBy("page_pos"))
        return pages.select(F.format_string("%s/page_%04d.md", name, n).alias("name"), text.alias("content"))
    return pages.groupBy("file_path").agg(in_order(text, F.col("page_pos")).alias("content")).select(F.concat(name, F.lit(".md")).alias("name"), "content")
