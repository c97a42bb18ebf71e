import os

import pytest
from pyspark.sql import functions as F

from pagemill.sources import files as S
from pagemill.streaming import deltas


def test_input_files(spark, tmp_path):
    for name in ("a.pdf", "b.PNG", "c.txt", "plain"):
        (tmp_path / name).write_bytes(b"x")
    (tmp_path / "sub.d").mkdir()
    names = lambda df: sorted((os.path.basename(r.path), r.kind) for r in df.collect())
    assert names(S.input_files(spark, str(tmp_path))) == [("a.pdf", "pdf"), ("b.PNG", "image"), ("c.txt", "unsupported")]
    assert names(S.input_files(spark, [f"{tmp_path}/*.pdf", f"{tmp_path}/plain", f"{tmp_path}/none"])) == [("a.pdf", "pdf"), ("plain", "unsupported")]
    with pytest.raises(FileNotFoundError):
        S.input_files(spark, f"{tmp_path}/none", required=True)


def test_documents_round_trip(spark, tmp_path):
    docs = spark.createDataFrame([("in/one.pdf", ["a", "é"], None), ("in/two.png", [], "failed")], "file_path string, pages array<string>, error string")
    S.write_files(S.document_files(docs, F.col("error").isNotNull()), str(tmp_path)).collect()
    assert sorted(os.listdir(tmp_path / "results")) == ["one.zip"] and sorted(os.listdir(tmp_path / "errors")) == ["two.zip"]
    back = S.saved_documents(spark, str(tmp_path), "file_path string, pages array<string>, error string")
    assert sorted(tuple(r.document) for r in back.collect()) == sorted(tuple(r) for r in docs.collect())
    with pytest.raises(Exception, match="FileExistsError"):
        S.write_files(S.document_files(docs, F.lit(False)), str(tmp_path), overwrite=False).collect()


def test_markdown_files_and_runs(spark, tmp_path):
    pages = spark.createDataFrame([("x/a.pdf", 2, "two"), ("x/a.pdf", 0, "zero"), ("x/a.pdf", 1, None)], "file_path string, page_pos int, text string")
    assert [tuple(r) for r in S.markdown_files(pages).collect()] == [("a.md", "zero\n\n\n\ntwo")]
    assert sorted(tuple(r) for r in S.markdown_files(pages, per_page=True).collect()) == [("a/page_0001.md", "zero"), ("a/page_0002.md", ""), ("a/page_0003.md", "two")]
    for name in ("2024-01-01T00h00m00s", "2025-01-01T00h00m00s"):
        (tmp_path / name).mkdir()
    assert S.last_run(spark, str(tmp_path)) == "2025-01-01T00h00m00s"


def test_page_reader(spark):
    class Reader:
        def render(self, content, page, dpi):
            if page == 1:
                raise ValueError("broken")
            return content + bytes([page])

        def cells(self, content, page):
            if page == 1:
                raise ValueError("broken")
            return [{"l": 1.0, "b": 80.0, "r": 9.0, "t": 90.0, "text": "word", "uri": None}, {"l": 1.0, "b": 80.0, "r": 9.0, "t": 90.0, "text": " ", "uri": None}, {"l": 9.0, "b": 80.0, "r": 9.0, "t": 90.0, "text": "thin", "uri": None}], 50.0, 100.0

    pages = spark.createDataFrame([("f", bytearray(b"c"), 0), ("f", bytearray(b"c"), 1)], "path string, content binary, page_number int")
    assert {r.page_number: (r.image, r.error) for r in S.rendered(pages, Reader()).collect()} == {0: (b"c\x00", None), 1: (None, "ValueError: broken")}
    assert [(r.l, r.t, r.r, r.b, r.text) for r in S.page_cells(pages, Reader()).collect()] == [(1.0, 10.0, 9.0, 20.0, "word")]
    counted = spark.createDataFrame([("a.pdf", bytearray(b"/Type /Pages /Type /Page /Type/Page ")), ("b.png", bytearray(b""))], "path string, content binary")
    assert {r.path: r.n_pages for r in S.with_page_counts(counted).collect()} == {"a.pdf": 2, "b.png": 1}


def test_only_new_files_are_taken_up(spark, tmp_path):
    folder, out = tmp_path / "in", f"{tmp_path}/out"
    folder.mkdir()

    def run():
        deltas.run_on_new(deltas.new_files(spark, str(folder), "*.txt").select("path", "length"), out, f"{tmp_path}/state")
        return spark.read.parquet(out).count()

    (folder / "a.txt").write_text("a")
    (folder / "a.skip").write_text("a")
    assert run() == 1
    (folder / "b.txt").write_text("b")
    assert run() == 2
    assert run() == 2
