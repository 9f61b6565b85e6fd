"""Every operator on nulls, empty and long texts, repeats, empty tables and extra columns."""

import pytest
from pyspark.sql import types as T

import corpus_pipeline
from quire.llm import balltree, decontaminate, jaccard, language, lines, mixing, pii, quality, sharding, warc

SHAPE = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType())])
#: Columns named as operators name theirs.
CLASH = ("size", "score", "shard", "slot", "target", "taken", "lang_pred", "predicted", "statistics", "removed", "key", "block", "n", "cls", "row", "id", "value", "component_id", "version", "ranges", "lo", "hi", "ends", "first", "last", "middle", "number", "s", "salt", "mine", "copy", "__id", "__version", "__s", "__salt", "__key", "__mine", "__n", "__copy", "__middle", "want", "k", "v", "at", "a", "b", "left", "tier", "kind", "pattern", "tail", "part", "rows", "class_id", "n_lines")
PROSE = "the quick brown fox jumps over the lazy dog while rain falls on the old town "


def rows():
    plain = [(k, f"{PROSE}{k} and {k * 7} more\nline {k} of the text stands here for all to read", "en" if k % 3 else "de", f"s{k % 3}") for k in range(30)]
    odd = [(100, None, "en", "s0"), (101, "", "en", None), (102, "   \n\t", None, "s1"), (None, PROSE, "en", "s1"), (103, "word", None, None), (104, PROSE * 4000, "en", "s2"), (105, "x" * 300_000, "en", "s2"), (106, "12345 !!! ...", "en", "s0"), (107, "\n" * 5000, "de", "s0")]
    return plain + odd + [plain[3], plain[3]] + [(200 + k, plain[5][1], "en", "s2") for k in range(5)]


@pytest.fixture(scope="module")
def docs(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows(), SHAPE)
    for c in CLASH:
        df = df.withColumn(c, F.lit("clash"))
    return df


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SHAPE)


LABELS = "doc_id long, quality int"


def calls(spark, docs):
    bench = spark.createDataFrame([(1, PROSE + "and no one knows why it is so"), (2, None), (3, ""), (4, "too short")], "item_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(30)] + [(1, None), (None, 1), (2, 5)], LABELS)
    return {
        "pii": lambda: pii.extract(docs),
        "lines": lambda: lines.clean(docs),
        "sharding": lambda: sharding.reshard(docs, 4),
        "decontaminate": lambda: decontaminate.find(docs, bench),
        "decontaminated": lambda: decontaminate.drop_found(docs, bench),
        "language": lambda: language.identify(docs, language.train(docs)),
        "jaccard": lambda: jaccard.similar(docs),
        "kept": lambda: jaccard.keep_first(docs),
        "quality": lambda: quality.score(docs, quality.train(docs, labels)),
        "mixing": lambda: mixing.schedule(docs).rows,
        "mixed": lambda: mixing.apply(docs, mixing.schedule(docs)),
    }


#: Names that no operator gives a column of its result.
ASIDE = ("ranges", "ends", "first", "last", "__id", "__version", "__s", "__salt", "__key", "__mine", "__n", "__copy", "__middle")
NAMES = ("pii", "lines", "sharding", "decontaminate", "decontaminated", "language", "jaccard", "kept", "quality", "mixing", "mixed")
ONE_EACH = ("pii", "lines", "sharding", "language", "jaccard", "quality", "mixing")


@pytest.mark.parametrize("name", NAMES)
def test_odd_rows(spark, docs, name):
    got = calls(spark, docs)[name]().collect()
    if name in ONE_EACH:
        assert len(got) == len(rows())


@pytest.mark.parametrize("name", NAMES)
def test_empty_table(spark, empty, name):
    assert calls(spark, empty)[name]().collect() == []


def test_columns_stay(spark, docs):
    for name in ("decontaminated", "kept", "mixed"):
        assert calls(spark, docs)[name]().columns == docs.columns


@pytest.mark.parametrize("name", ["lines", "sharding", "decontaminated", "language", "kept", "quality", "mixed"])
def test_extra_columns_come_through(spark, docs, name):
    got = calls(spark, docs)[name]()
    kept = [c for c in ASIDE if c in got.columns]
    assert kept == [c for c in ASIDE]
    assert all(r[c] == "clash" for r in got.select(*kept).limit(20).collect() for c in kept)
    if name == "quality":
        assert "statistics" in got.columns


@pytest.mark.parametrize("rows_", [0, 1, 5])
def test_vectors_and_pages(spark, rows_):
    vectors = spark.createDataFrame([(50 * k, [1.0 * k, 2.0], "x", "y", "z") for k in range(rows_)], "vec_id long, embedding array<double>, shard string, id string, v string")
    got = balltree.top_k(vectors).collect()
    assert len(got) == rows_ * max(0, rows_ - 1)
    html = spark.createDataFrame([(k, None if k == 2 else f"u{k}", None if k == 1 else "same", "x") for k in range(rows_)], "page_id long, url string, html string, payload_digest string")
    from quire.llm.common import new_path

    path = new_path(spark, "edge")
    warc.write_archives(html, path)
    assert sorted(r.page_id for r in warc.resolved(warc.read_archives(spark, path)).collect()) == list(range(rows_))


@pytest.mark.parametrize("which", ["odd", "empty"])
def test_pipeline_on_odd_and_empty_tables(spark, docs, empty, tmp_path, which):
    (docs if which == "odd" else empty.drop("n_chars")).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, PROSE + "and no one knows why it is so"), (None, "x"), (3, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert (len(got) > 0) is (which == "odd")
    slots = {(r.shard, r.slot) for r in got}
    assert len(slots) == len(got)


def test_wordless_texts(spark, docs):
    by = {r.doc_id: r for r in language.identify(docs, language.train(docs)).collect()}
    for k in (100, 101, 102, 106, 107):
        assert (by[k].lang_pred, by[k].score) == ("und", 0.0)
    scored = {r.doc_id: r for r in calls(spark, docs)["quality"]().collect()}
    assert scored[100].score == scored[101].score == 0.0
    alone = {r.doc_id: r for r in jaccard.similar(docs).collect()}
    assert alone[100].n_shingles == 0 and alone[100].component_id == 100
    assert alone[103].n_shingles == 1 and alone[103].component_id == 103
