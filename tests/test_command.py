import datetime
import os

import pytest

from pagemill.__main__ import run

NOW = datetime.datetime(2025, 2, 3, 4, 5, 6)


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/two.pdf").write_bytes(b"%PDF /Type /Page x /Type /Page y /Type /Pages")
    (tmp_path / "in/one.png").write_bytes(b"png")
    (tmp_path / "in/no.txt").write_bytes(b"text")
    return tmp_path


def tree(root):
    return sorted(os.path.relpath(os.path.join(d, f), root) for d, _, fs in os.walk(root) for f in fs)


def test_documents_and_retry(spark, folder):
    out = run(spark, [str(folder / "in")], str(folder / "out"), now=NOW)
    assert out == f"{folder}/out/2025-02-03T04h05m06s" and tree(out) == ["results/one.zip", "results/two.zip"]
    os.remove(f"{out}/results/one.zip")
    stamp = os.stat(f"{out}/results/two.zip").st_mtime_ns
    assert run(spark, [str(folder / "in")], str(folder / "out"), retry=True) == out
    assert tree(out) == ["results/one.zip", "results/two.zip"] and os.stat(f"{out}/results/two.zip").st_mtime_ns == stamp
    with pytest.raises(FileNotFoundError):
        (folder / "none").mkdir()
        run(spark, [str(folder / "in")], str(folder / "none"), retry=True)


def test_markdown_by_page(spark, folder):
    out = run(spark, [f"{folder}/in/*.pdf"], str(folder / "out"), save="md_page", selection="2,9", now=NOW)
    assert tree(out) == ["results/two/page_0001.md"]
    out = run(spark, [f"{folder}/in/*.pdf"], str(folder / "out2"), save="md", now=NOW)
    text = open(f"{out}/results/two.md").read()
    assert text.count("# Page") == 2 and "read as ocr" in text



def counting(log):
    class Counting:
        """Notes every page that it is asked for in a file."""

        def predict(self, pages, mode):
            with open(log, "a") as f:
                f.writelines(f"{p['page_id']}\n" for p in pages)
            return [f"answer {bytes(p['image']).decode()}" if "image" in p else "answer" for p in pages]

    return Counting()


def reader():
    class Reader:
        def render(self, content, page, dpi):
            if page == 1:
                raise ValueError("broken")
            return f"{len(content)} {page} {dpi}".encode()

        def cells(self, content, page):
            return [], 1.0, 1.0

    return Reader()


@pytest.mark.parametrize("save", ["document", "md", "md_page"])
def test_one_call_a_page(spark, folder, save):
    log = f"{folder}/log"
    run(spark, [str(folder / "in")], str(folder / "out"), save=save, provider=counting(log), now=NOW)
    calls = open(log).read().split()
    assert len(calls) == len(set(calls)) == 3


def test_the_provider_sees_the_page(spark, folder):
    out = run(spark, [f"{folder}/in"], str(folder / "out"), save="md_page", provider=counting(f"{folder}/log"), reader=reader(), dpi=200, now=NOW)
    assert tree(out) == ["errors/two/page_0001.md", "errors/two/page_0002.md", "results/one/page_0001.md"]
    assert open(f"{out}/results/one/page_0001.md").read() == "answer 3 0 200"
