"""The pipeline's stages, each on its predecessor's rows, and the run as a whole."""

from collections import Counter

import pytest

import corpus_pipeline
from quire.llm.common import table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    out, docs = {}, table(spark, SF, "documents")
    out["documents"] = docs
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "rows")
        stage(spark, docs, SF).write.parquet(path)
        out[name] = docs = spark.read.parquet(path)
    return out


def test_all_but_the_last_keep_the_columns(stages):
    columns = stages["documents"].columns
    for name, _ in corpus_pipeline.STAGES[:-1]:
        assert stages[name].columns == columns


def test_decisions_take_effect(stages):
    rows = {k: v.collect() for k, v in stages.items()}
    ids = {k: Counter(r.doc_id for r in v) for k, v in rows.items()}
    text = {r.doc_id: r.text for r in rows["documents"]}
    # Every text with letters is kept by the first stage.
    assert set(ids["language"]) == {i for i, t in text.items() if any(c.isalpha() for c in t or "")}

    def shingles(t):
        w = t.lower().split()
        return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) or frozenset([tuple(w)])

    kept = {i: shingles(text[i]) for i in ids["near_duplicates"]}
    everyone = {i: shingles(text[i]) for i in ids["language"]}
    for i, a in kept.items():  # no two that stay are linked
        assert not any(i < j and 100 * len(a & b) >= 80 * len(a | b) for j, b in kept.items())
    for i in set(everyone) - set(kept):  # whatever goes is linked with a smaller one
        assert any(j != i and 100 * len(everyone[i] & b) >= 80 * len(everyone[i] | b) for j, b in everyone.items())
    leaked = {i for i in ids["near_duplicates"] for b in table_texts(stages) if b in text[i]}
    assert set(ids["decontaminate"]) == set(ids["near_duplicates"]) - leaked
    assert set(ids["mix"]) <= set(ids["decontaminate"]) and max(ids["mix"].values()) <= 3
    words = {i: len(text[i].split()) for i in text}
    budget = sum(words[i] for i in ids["decontaminate"])
    assert 0.9 * budget <= sum(words[i] * n for i, n in ids["mix"].items()) <= budget
    assert ids["shard"] == ids["mix"]
    slots = Counter((r.shard, r.slot) for r in rows["shard"])
    assert set(slots.values()) == {1} and {s for s, _ in slots} == set(range(16))


def table_texts(stages):
    spark = stages["documents"].sparkSession
    return [r.text for r in table(spark, SF, "benchmark").collect()]


def test_run(spark, stages):
    got = Counter((r.doc_id, r.shard, r.slot) for r in corpus_pipeline.run(spark, SF).collect())
    assert Counter(k for k, *_ in got.elements()) == Counter(r.doc_id for r in stages["shard"].collect())
