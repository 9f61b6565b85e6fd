import io

import pytest
from pyspark.sql import functions as F

from quire.sources import files
from quire.sources.settings import Config, read_prompt, read_users


def test_folder_scan(spark, tmp_path):
    for name in ("a.pdf", "b.PDF", "x/c.Pdf", "x/y/d.pdf", "e.txt", "f.pdf.bak"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(name.encode())
    got = {r.path.rsplit("/", 1)[-1]: bytes(r.content) for r in files.scan_folder(spark, str(tmp_path)).collect()}
    assert sorted(got) == ["a.pdf", "b.PDF", "c.Pdf", "d.pdf"] and got["c.Pdf"] == b"x/c.Pdf"
    with pytest.raises(NotADirectoryError):
        files.scan_folder(spark, str(tmp_path / "a.pdf"))
    assert files.scan(spark, str(tmp_path / "a.pdf"), str(tmp_path / "e.txt")).count() == 2
    assert [bytes(r.content) for r in files.from_bytes(spark, [b"1", b"2"]).orderBy("doc_id").collect()] == [b"1", b"2"]


def test_checks(tmp_path):
    (tmp_path / "a").write_text("x")
    assert files.check([str(tmp_path / "a"), "https://x/y", str(tmp_path / "b")]) == [str(tmp_path / "b")]
    with pytest.raises(ValueError, match="no files"):
        files.check([])


def test_download(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"x" * 5000)
    addresses = spark.createDataFrame([(f"file://{tmp_path}/a.bin",), ("file:///no/such",)], "path string")
    got = {r.path: r for r in files.fetch(addresses).collect()}
    assert bytes(got[f"file://{tmp_path}/a.bin"].content) == b"x" * 5000 and got["file:///no/such"].error
    limited = files.fetch(addresses, 100).where("error like 'TooLarge%'")
    assert limited.count() == 1
    assert files.read_limited(io.BytesIO(b"x" * 5000), 5000) == b"x" * 5000


def test_download_names(spark):
    rows = [("https://x/a/b.html?c=d.e", None, "b.pdf"), ("https://x/a", 'attachment; filename="r 1.PDF"', "r 1.pdf"), ("https://x/a.pdf", "inline", "a.pdf")]
    df = spark.createDataFrame(rows, "a string, d string, want string").withColumn("got", files.download_name(F.col("a"), F.col("d")))
    assert all(r.got == r.want for r in df.collect())


def test_write(spark, tmp_path):
    rows = spark.createDataFrame([("in/a.pdf", bytearray(b"m"), bytearray(b"dd"))], "path string, mono_content binary, dual_content binary")
    got = files.write(rows, str(tmp_path / "out")).collect()
    assert sorted(r.length for r in got) == [1, 2]
    assert (tmp_path / "out/a-mono.pdf").read_bytes() == b"m" and (tmp_path / "out/a-dual.pdf").read_bytes() == b"dd"
    assert len(list((tmp_path / "out").iterdir())) == 2


def test_config(tmp_path):
    c = Config(tmp_path / "c.json", {"B": "env"})
    assert c.get("A", 1) == 1
    c.set("A", "é")
    c.set("B", "file")
    assert c.get("A") == "é" and c.get("B") == "env" and "é" in (tmp_path / "c.json").read_text("utf-8")
    c.set_translator("openai", {"OPENAI_MODEL": "m"})
    c.set_translator("openai", {"OPENAI_MODEL": "n"})
    again = Config(tmp_path / "c.json", {})
    assert again.get("B") == "file" and again.translator("openai") == {"OPENAI_MODEL": "n"} and again.translator("x") == {}
    loop = {"same": True, "again": True}
    loop["self"] = loop
    again.set("loop", loop)
    assert Config(tmp_path / "c.json", {}).get("loop") == {"same": True, "again": True, "self": None}
    again.delete("A")
    assert "A" not in again.all()
    again.clear()
    assert again.all() == {}
    again.remove()
    assert not (tmp_path / "c.json").exists()


def test_prompt_and_users(tmp_path):
    (tmp_path / "p").write_text("x ${text}")
    (tmp_path / "u").write_text("ann,one\nbob, two\n\n")
    assert read_prompt(tmp_path / "p") == "x ${text}"
    with pytest.raises(ValueError, match="prompt error"):
        read_prompt(tmp_path / "none")
    assert read_users(tmp_path / "u") == ([("ann", "one"), ("bob", "two")], "")
