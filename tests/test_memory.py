import pytest

from quire.operators import memory
from quire.operators.memory import Engine, Memory, Refused, Retry, RetryPolicy


def engine(calls=None, **more):
    def factory():
        return lambda t: f"[zh] {t}"

    return Engine("pseudo", "en", "zh", "m", factory, **more)


def test_get_set_overwrite(spark, tmp_path):
    m = Memory(spark, str(tmp_path / "m"))
    assert m.get("e", {}, "a") is None
    m.put("e", {}, "a", "1")
    assert m.get("e", {}, "a") == "1"
    m.put("e", {}, "a", "2")
    assert m.get("e", {}, "a") == "2"
    m.compact()
    assert m.get("e", {}, "a") == "2" and m.rows().count() == 1


def test_engine_and_parameters_part_keys(spark, tmp_path):
    m = Memory(spark, str(tmp_path / "m"))
    m.put("e", {"k": [1, {"b": 2, "a": 1}]}, "a", "1")
    assert m.get("e", {"k": [1, {"a": 1, "b": 2}]}, "a") == "1"
    assert m.get("f", {"k": [1, {"a": 1, "b": 2}]}, "a") is None
    assert m.get("e", {"k": [{"a": 1, "b": 2}, 1]}, "a") is None


def test_canonical_parameters():
    assert memory.canonical({"b": {"y": 1, "x": [{"q": 1, "p": 2}]}, "a": "é"}) == memory.canonical({"a": "é", "b": {"x": [{"p": 2, "q": 1}], "y": 1}})
    assert memory.merged({"a": 1}, {"a": 2, "b": 3}) == {"a": 2, "b": 3}


def test_long_engine_names_are_refused(spark, tmp_path):
    with pytest.raises(ValueError, match="name"):
        Memory(spark, str(tmp_path / "m")).put("x" * 20, {}, "a", "b")


def test_translate(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, " "), (5, "{v3}"), (6, "{v3} c")], "id int, text string")
    m = Memory(spark, str(tmp_path / "m"))
    first = {r.id: r for r in memory.translate(rows, engine(), m).collect()}
    assert [first[k].translation for k in range(1, 7)] == ["[zh] a", "[zh] b", "[zh] a", " ", "{v3}", "[zh] {v3} c"]
    assert [first[k].status for k in range(1, 7)] == ["ok", "ok", "ok", "skipped", "skipped", "ok"]
    assert not any(r.hit for r in first.values()) and m.rows().count() == 3
    again = memory.translate(rows, engine(), m).collect()
    assert all(r.hit for r in again if r.status == "ok") and m.rows().count() == 3
    m.put("pseudo", {"lang_in": "en", "lang_out": "zh", "model": "m"}, "a", "old")
    assert {r.translation for r in memory.translate(rows, engine(), m).where("text = 'a'").collect()} == {"old"}
    assert {r.translation for r in memory.translate(rows, engine(), m, ignore_cache=True).where("text = 'a'").collect()} == {"[zh] a"}
    assert m.get("pseudo", {"lang_in": "en", "lang_out": "zh", "model": "m"}, "a") == "[zh] a"


def test_engines_that_are_not_cached(spark, tmp_path):
    rows = spark.createDataFrame([("a",)], "text string")
    m = Memory(spark, str(tmp_path / "m"))
    assert memory.translate(rows, engine(cacheable=False), m).first().translation == "[zh] a"
    assert m.rows().count() == 0


def test_failures_are_statuses_and_are_not_stored(spark, tmp_path):
    def factory():
        def call(t):
            if t == "bad":
                raise Refused("never")
            if t == "worse":
                raise RuntimeError("down")
            return t.upper()

        return call

    e = Engine("pseudo", "en", "zh", "", factory, retry=RetryPolicy(other_attempts=2, other_wait=0.0))
    rows = spark.createDataFrame([("bad",), ("worse",), ("good",)], "text string")
    m = Memory(spark, str(tmp_path / "m"))
    got = {r.text: r for r in memory.translate(rows, e, m).collect()}
    assert got["good"].translation == "GOOD" and got["bad"].status == "refused: never" and got["worse"].status == "failed: down"
    assert [r.original_text for r in m.rows().collect()] == ["good"]


def test_retries():
    waits, left = [], [4]

    def flaky():
        left[0] -= 1
        if left[0]:
            raise Retry("later")
        return "done"

    assert RetryPolicy().call(flaky, waits.append) == "done" and waits == [1.0, 2.0, 4.0]
    waits.clear()

    def limited():
        raise Retry("x")

    with pytest.raises(Retry):
        RetryPolicy(limited_attempts=7).call(limited, waits.append)
    assert waits == [1.0, 2.0, 4.0, 8.0, 15.0, 15.0]


def test_first_success():
    def call(m):
        if m == "c":
            return "c!"
        raise RuntimeError("no")

    assert memory.first_success(["a", "c", "b"], call) == "c!"
    with pytest.raises(RuntimeError, match="all models failed: a: no; b: no"):
        memory.first_success(["a", "b"], call)
