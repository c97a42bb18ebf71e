"""Command line: ``python -m pagemill convert INPUT... --out DIR`` and ``python -m pagemill modes``.

Files become pages, a provider answers for each page, and documents are saved as zips with JSON,
as one Markdown file each or as one a page.  Provider and page reader are ``module:Class``; the default provider
answers from the page's number, for trying things out, and without a reader it gets no image.
Boxes refer to a frame of 1000 x 1000.
"""

from __future__ import annotations

import argparse
import datetime
import importlib
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.operators.documents import outcome, selected_pages, unprocessed
from pagemill.operators.models import MODES, MockProvider, ResponseProvider
from pagemill.plans.conversion import Conversion, convert
from pagemill.sources import files as S

FRAME = 1000


def page_rows(spark: SparkSession, files: DataFrame, selection: str | None, reader: S.PageReader | None = None, dpi: int = 175) -> DataFrame:
    """file_path, page_number, page_id, width, height of the pages to process; with a ``reader`` also image and render_error."""
    paths = [r.path for r in files.select("path").distinct().collect()]
    content = spark.read.format("binaryFile").load(paths) if paths else spark.createDataFrame([], "path string, content binary")
    counted = S.with_page_counts(content.select("path", "content")).select(F.col("path").alias("file_path"), "n_pages", "content")
    every = F.sequence(F.lit(0), F.greatest(F.lit(1), "n_pages") - 1) if selection is None else selected_pages(F.lit(selection), F.col("n_pages"))
    pages = counted.select("file_path", "content", F.explode(every.cast("array<int>")).alias("page_number"))
    out = pages.select("file_path", "page_number", F.xxhash64("file_path", "page_number").alias("page_id"), F.lit(FRAME).alias("width"), F.lit(FRAME).alias("height"))
    if not reader:
        return out
    images = S.rendered(pages.withColumnRenamed("file_path", "path"), reader, dpi)
    return out.join(images.withColumnsRenamed({"path": "file_path", "error": "render_error"}), ["file_path", "page_number"])


def run(spark: SparkSession, inputs: list[str], out: str, mode: str = "ocr", save: str = "document", selection: str | None = None, retry: bool = False, provider: ResponseProvider | None = None, now: datetime.datetime | None = None, reader: S.PageReader | None = None, dpi: int = 175) -> str:
    """Convert the supported files and save the results; gives the run's folder.

    With ``retry`` the last run goes on: files that have a result in it are left out.  With a
    ``reader`` the provider gets each page's image; a page that can't be rendered is an error.
    The answers are written once, into the run's folder, and all results are made from them.
    """
    files = S.input_files(spark, inputs).where("kind <> 'unsupported'")
    last = S.last_run(spark, out) if retry else None
    if retry and not last:
        raise FileNotFoundError(f"no run in {out}")
    folder = os.path.join(out, last or (now or datetime.datetime.now()).strftime("%Y-%m-%dT%Hh%Mm%Ss"))
    if last and os.path.isdir(done := os.path.join(folder, "results")):
        there = S.input_files(spark, f"{done}/*").select(F.col("path").alias("file"))
        files = unprocessed(files.withColumnRenamed("path", "file"), there).withColumnRenamed("file", "path")
    settings = Conversion(mode, dpi)
    rows, held = S.held(page_rows(spark, files, selection, reader, settings.dpi), folder)
    good = rows.where("render_error is null").drop("render_error") if reader else rows
    answers = convert(good.drop("file_path", "page_number"), provider or MockProvider(), settings)
    if reader:
        broken = rows.where("render_error is not null").select("page_id", F.col("render_error").alias("error"))
        answers = answers.unionByName(broken, allowMissingColumns=True)
    answers, answered = S.held(answers, folder)
    rows = rows.select("page_id", "file_path", F.col("page_number").alias("page_pos")).join(answers, "page_id")
    failed = rows.groupBy("file_path").agg(F.bool_or(F.col("error").isNotNull()).alias("failed"))
    if save == "document":
        page = F.struct("page_pos", F.struct(F.col("page_pos").alias("page_number"), "text", "raw_response", "items", "error").alias("page"))
        documents = rows.groupBy("file_path").agg(F.transform(F.array_sort(F.collect_list(page)), lambda x: x["page"]).alias("pages"), F.bool_or(F.col("error").isNotNull()).alias("failed"))
        written = S.document_files(documents, F.col("failed"))
    else:
        named = rows.join(failed, "file_path").select(F.col("file_path"), "page_pos", "text", outcome(F.col("failed")).alias("part"))
        written = None
        for part in ("results", "errors"):
            one = S.markdown_files(named.where(F.col("part") == part), per_page=save == "md_page").select(F.concat(F.lit(f"{part}/"), "name").alias("name"), "content")
            written = one if written is None else written.unionByName(one)
    S.write_files(written, folder).count()
    for path in (held, answered):
        S.delete(spark, path)
    return folder


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="pagemill")
    commands = parser.add_subparsers(dest="command", required=True)
    c = commands.add_parser("convert")
    c.add_argument("inputs", nargs="+")
    c.add_argument("--out", default="out")
    c.add_argument("--mode", choices=MODES, default="ocr")
    c.add_argument("--save", choices=("document", "md", "md_page"), default="document")
    c.add_argument("--pages")
    c.add_argument("--retry", action="store_true")
    c.add_argument("--provider")
    c.add_argument("--reader")
    c.add_argument("--dpi", type=int, default=175)
    commands.add_parser("modes")
    a = parser.parse_args(args)
    if a.command == "modes":
        print("\n".join(MODES))
        return
    made = []
    for named in (a.provider, a.reader):
        module, _, name = (named or "").partition(":")
        made.append(getattr(importlib.import_module(module), name)() if named else None)
    spark = SparkSession.builder.appName("pagemill").getOrCreate()
    print(run(spark, a.inputs, a.out, a.mode, a.save, a.pages, a.retry, made[0], reader=made[1], dpi=a.dpi))


if __name__ == "__main__":
    main()
