import os

import pytest

from textloom.sources.files import documents, read_files, skipped
from textloom.sources.folders import page_name, scan_folder, write_pages


def test_scan(spark, tmp_path):
    """Every file once, whatever the number of tasks; reasons for those left out; other files and folders are not read."""
    for i in range(300):
        (tmp_path / f"n{i}.txt").write_text(f" ﬁle {i}\n", encoding="utf-8")
    (tmp_path / "empty.txt").write_bytes(b"")
    (tmp_path / "blank.txt").write_text(" \n")
    (tmp_path / "odd.txt").write_bytes(b"\x81\x7f" * 3)
    (tmp_path / "sjis.txt").write_bytes("テスト".encode("cp932"))
    (tmp_path / "other.md").write_text("x")
    (tmp_path / "dir.txt").mkdir()
    os.symlink(tmp_path / "nowhere", tmp_path / "gone.txt")
    for parts in (1, 5):
        files = scan_folder(spark, str(tmp_path), parts)
        assert files.rdd.getNumPartitions() == parts
        assert {r.doc_id: r.text for r in documents(files).collect()} == {f"n{i}.txt": f"file {i}" for i in range(300)} | {"sjis.txt": "テスト"}
        assert [(os.path.basename(r.path), r.reason) for r in skipped(files).collect()] == [("blank.txt", "empty_input"), ("empty.txt", "empty_input"), ("odd.txt", "unreadable")]
    row = read_files(spark, f"file://{tmp_path}").where("doc_id = 'n7.txt'").first()
    assert row.raw == " ﬁle 7\n" and row.content == row.raw.encode() and row.path == f"file:{tmp_path}/n7.txt"


def test_a_folder_that_is_not_there(spark, tmp_path):
    with pytest.raises(Exception, match="No such file"):
        scan_folder(spark, str(tmp_path / "none")).collect()


def test_pages(spark, tmp_path):
    out = tmp_path / "out"
    out.mkdir()
    (out / "own.html").write_text("stays")
    pages = [(f"{i}_vs_{i + 1}", f"<p>é{i}</p>") for i in range(200)] + [("a/b_vs_c", "slash"), ("x" * 400, "long")]
    df = spark.createDataFrame(pages, "pair_key string, html string").repartition(7)
    for _ in range(2):  # written again, the same
        write_pages(df, str(out))
        assert {p.name: p.read_text(encoding="utf-8") for p in out.iterdir()} == {page_name(k): h for k, h in pages} | {"own.html": "stays"}
    assert page_name("a/b") != page_name("a_b") and page_name("a_b") == "a_b.html"
    write_pages(df.limit(0), str(tmp_path / "none"))
    assert list((tmp_path / "none").iterdir()) == []
