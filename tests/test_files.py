"""The folder source: batches and streams over files of which some are broken."""

import os

import pytest

from spindrift.sources import files
from spindrift.sources.folder import Part, _Folder

GOOD = "title: T\nsource_url: https://www.example.org/x\nunit: 'u' # which\ndocument_type: rule\nversion: \"1\"\npublished_at: 2024-01-02\n"


@pytest.fixture
def folder(tmp_path):
    def put(name, content, side=None, ending="yaml"):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(content if isinstance(content, bytes) else content.encode())
        if side is not None:
            path.with_suffix(f".{ending}").write_text(side)

    put("a/doc.md", "# Head \n\n body", GOOD)
    put("a/both.txt", "x", GOOD, "yml")
    put("a/both.txt", "x", GOOD.replace("T\n", "First\n", 1))
    put("page.HTML", "<nav>n</nav><p>hello <b>you</b>", GOOD.replace("published_at", "effective_from"), "yml")
    put("lone.txt", "x")
    put("bytes.txt", b"\xff\xfe", GOOD)
    put("paper.pdf", b"%PDF", GOOD)
    put("lacks.txt", "x", "title: P\nversion: 1\n")
    put("undated.txt", "x", GOOD.replace("published_at: 2024-01-02\n", "published_at: null\n"))
    put("baddate.txt", "x", GOOD.replace("2024-01-02", "2024-13-02"))
    put("list.txt", "x", "- a\n- b\n")
    put("off.markdown", "x", GOOD.replace("www.example.org", "other.net"))
    put("empty.txt", "", GOOD)
    put("skip.bin", b"\0", GOOD)
    os.symlink(tmp_path / "nowhere", tmp_path / "dead.txt")
    return tmp_path


def rows(df):
    return {r.path.rsplit("/", 1)[1]: r for r in df.collect()}


def test_batches(spark, folder):
    got = rows(files.documents(spark, str(folder), ["example.org"]))
    errors = {n: r.error for n, r in got.items() if r.error}
    assert {n for n, r in got.items() if not r.error} == {"doc.md", "both.txt", "page.HTML", "empty.txt"}
    assert got["doc.md"].text == "# Head\nbody" and got["doc.md"].metadata["unit"] == "u" and got["both.txt"].metadata["title"] == "First"
    assert got["page.HTML"].text == "hello\nyou" and got["empty.txt"].text == ""
    assert errors["lone.txt"] == "no metadata" and errors["bytes.txt"].startswith("UnicodeDecodeError") and errors["paper.pdf"] == "no reader for pdf"
    assert errors["lacks.txt"] == "no source_url, unit, document_type" and errors["undated.txt"] == "no published_at or effective_from" and errors["baddate.txt"] == "no date: published_at"
    assert errors["list.txt"] == "metadata is no mapping" and errors["off.markdown"] == "source_url is not allowed"
    assert "skip.bin" not in got and files.documents(spark, str(folder / "nothing")).collect() == []
    paths = [r.path for r in files.documents(spark, f"file://{folder}").collect()]
    assert paths == sorted(paths) and len(paths) == len(got)


def test_parts_hold_so_many_bytes(folder):
    own = _Folder({"path": str(folder), "partbytes": "3"})
    parts = own.parts(own.listed())
    assert len(parts) > 4 and sorted(p for part in parts for p, _ in part.files) == [p for p, _ in Part(sum((part.files for part in parts), [])).files]


def test_a_file_that_is_gone_is_a_row_with_an_error(folder):
    own = _Folder({"path": str(folder)})
    parts = own.parts(own.listed())
    (folder / "lone.txt").unlink()
    got = {r[0].rsplit("/", 1)[1]: r for part in parts for r in own.read(part)}
    assert got["lone.txt"][4].startswith("FileNotFoundError") and got["doc.md"][4] is None


def test_streams_equal_batches_and_take_each_file_once(spark, folder, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("checkpoint"))

    def drain(name):
        run = files.documents(spark, str(folder), stream=True).writeStream.format("memory").queryName(name).option("checkpointLocation", f"{at}/{name}").trigger(availableNow=True).start()
        run.awaitTermination(120)
        return rows(spark.table(name))

    assert drain("arrived") == rows(files.documents(spark, str(folder)))
    out = str(tmp_path_factory.mktemp("out"))

    def append():
        files.documents(spark, str(folder), stream=True).writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{at}/files").trigger(availableNow=True).start().awaitTermination(120)
        return spark.read.parquet(out)

    before = append().count()
    (folder / "later.yaml").write_text(GOOD)
    (folder / "later.md").write_text("new")
    after = append()
    assert after.count() == before + 1 and rows(after)["later.md"].text == "new"
