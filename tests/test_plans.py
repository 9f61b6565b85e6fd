import re
import time

import pytest
from pyspark.sql import functions as F

from quire.operators import memory, segment, typeset
from quire.plans import pipeline
from quire.plans.cli import main, page_numbers
from quire.plans.jobs import Jobs, NotReady
from quire.plans.options import Options
from quire.streaming import ingest

DOCS = [(1, "Take 12 of 345\n\n7\nplain"), (2, "plain\n é 9"), (3, "")]


def pseudo(lang_out="zh"):
    return memory.Engine("pseudo", "en", lang_out, "", memory.pseudo(lang_out))


def test_options():
    with pytest.raises(ValueError, match="threads"):
        Options(threads=0)
    with pytest.raises(ValueError, match="service"):
        Options(service="")


def test_plain_flow(spark, tmp_path):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    store = memory.Memory(spark, str(tmp_path / "m"))
    got = {(r.doc_id, r.para_idx): (r.result, r.status) for r in pipeline.plain(docs, pseudo(), store).collect()}
    assert got == {(1, 0): ("[zh] Take 12 of 345", "ok"), (1, 1): ("", "skipped"), (1, 2): ("7", "skipped"), (1, 3): ("[zh] plain", "ok"), (2, 0): ("[zh] plain", "ok"), (2, 1): ("[zh]  é 9", "ok"), (3, 0): ("", "skipped")}
    warm = pipeline.summary(pipeline.plain(docs, pseudo(), store)).agg(F.sum("misses"), F.sum("hits")).first()
    assert tuple(warm) == (0, 4)


def test_pages_flow(spark):
    text = "ab 12"
    n = len(text)
    lists = {"ch": list(text), "cid": [0] * n, "font": ["Times"] * n, "size": [10.0] * n, "x0": [6.0 * k for k in range(n)], "x1": [6.0 * k + 5 for k in range(n)], "y0": [100.0] * n, "y1": [110.0] * n, "a": [1.0] * n, "d": [1.0] * n, "linewidth": [0.0] * n}
    df = spark.createDataFrame([(1, p, "page", *[lists[c] for c in segment.ITEMS]) for p in (0, 1)], "doc_id long, pageno int, container string, " + ", ".join(f"{c} array<{t}>" for c, t in segment.ITEMS.items()))
    metrics = typeset.Metrics({c: 0.5 for c in range(32, 127)})

    def said(boxes):
        got = pipeline.translate_pages(df, boxes, None, pseudo(), Options(pages=(1,), service="pseudo"), metrics).collect()
        assert [(r.doc_id, r.pageno) for r in got] == [(1, 1)]
        return bytes.fromhex("".join(re.findall("<(.*?)>", got[0].ops))).decode()

    box = "doc_id long, pageno int, det_idx int, x0 double, y0 double, x1 double, y1 double, conf double, name string"
    assert said(None) == said(spark.createDataFrame([], box)) == "[zh] ab 12"
    table = spark.createDataFrame([(1, 1, 0, 0.0, 600.0, 300.0, 750.0, 0.9, "table")], box)
    assert said(table) == "\0" * n  # a table's glyphs are drawn again as they are, by their codes
    assert pipeline.bilingual(df.select("doc_id", "pageno", F.lit("x").alias("ops")), df.select("doc_id", "pageno", F.lit("y").alias("ops"))).count() == 4


def test_jobs(spark):
    jobs = Jobs(spark)
    done = jobs.submit(lambda: spark.range(5))
    assert jobs.wait(done, 60) == "SUCCESS" and jobs.fetch(done).count() == 5
    bad = jobs.submit(lambda: spark.range(1).select(F.raise_error(F.lit("no"))))
    assert jobs.wait(bad, 60) == "FAILURE"
    with pytest.raises(NotReady):
        jobs.fetch(bad)
    jobs.forget(done)
    assert not jobs.known(done)
    steps = spark.sparkContext.accumulator(0)
    counted = jobs.submit(lambda: spark.range(6).mapInPandas(lambda it: (steps.add(len(b)) or b for b in it), "id long"), total=6, done=steps)
    assert jobs.wait(counted, 60) == "SUCCESS" and steps.value == 6
    slow = jobs.submit(lambda: spark.range(4).mapInPandas(lambda it: (time.sleep(30) or b for b in it), "id long"), total=4)
    time.sleep(2)
    assert jobs.status(slow)["state"] == "PROGRESS"
    assert jobs.cancel(slow)["state"] == "REVOKED"
    began = time.time()
    jobs.wait(slow, 25)
    assert time.time() - began < 25


def test_stream(spark, tmp_path):
    land = tmp_path / "land"
    land.mkdir()
    (land / "a.txt").write_text("one 1\ntwo")

    def run():
        docs = ingest.texts(ingest.landed(spark, str(land), "*.txt"))
        query = ingest.translate_stream(docs, pseudo(), str(tmp_path / "memory"), str(tmp_path / "out"), str(tmp_path / "checkpoint"))
        query.awaitTermination(120)
        return sorted(r.result for r in spark.read.parquet(str(tmp_path / "out")).collect())

    assert run() == ["[zh] one 1", "[zh] two"]
    (land / "b.txt").write_text("three")
    assert run() == ["[zh] one 1", "[zh] three", "[zh] two"]
    assert run() == ["[zh] one 1", "[zh] three", "[zh] two"]


def test_command_line(spark, tmp_path):
    assert page_numbers("1-3,5") == [0, 1, 2, 4] and page_numbers(None) is None
    docs = tmp_path / "docs.parquet"
    spark.createDataFrame(DOCS, "doc_id long, text string").write.parquet(str(docs))
    engine = lambda spec, lang_in, lang_out, *_: pseudo(lang_out)
    assert main([str(docs), "-lo", "fr", "-o", str(tmp_path / "out")], engine) == 0
    assert "[fr] plain" in [r.result for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    with pytest.raises(FileNotFoundError):
        main([str(tmp_path / "none")], engine)


def test_distinct_texts_of_a_stream(spark, tmp_path):
    land = tmp_path / "land"
    land.mkdir()
    for name, said in (("a", "same"), ("b", "same"), ("c", "other")):
        (land / name).write_text(said)
    files = ingest.landed(spark, str(land))
    once = ingest.distinct_texts(files.select("modificationTime", F.decode("content", "UTF-8").alias("text")))
    query = once.writeStream.format("memory").queryName("once").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    query.awaitTermination(120)
    assert sorted(r.text for r in spark.table("once").collect()) == ["other", "same"]
