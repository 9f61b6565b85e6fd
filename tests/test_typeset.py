import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quire.operators import segment, typeset
from quire.operators.typeset import Metrics, Setter, line_height, set_container

METRICS = Metrics({c: 0.5 for c in range(32, 127)}, {}, 1.0)


def paragraph(**more):
    return {"y": 100.0, "x": 0.0, "x0": 0.0, "x1": 50.0, "y0": 80.0, "y1": 110.0, "size": 10.0, "brk": True, **more}


def formula(vid=0, ch="x", width=12.0, linewidth=0.5):
    return {"vid": vid, "glyphs": [{"ch": ch, "cid": 88, "font": "F1", "size": 9.0, "x0": 5.0, "y0": 101.0, "width": width}], "lines": [{"x0": 5.0, "y0": 99.0, "x1": 15.0, "y1": 99.0, "linewidth": linewidth}], "yfix": 2.0, "width": width}


def test_wraps_and_drops_the_blank_at_a_line_start():
    ops = Setter(paragraph(), {}, METRICS).run("abcdefghij klm")
    assert [(o.line, bytes.fromhex(o.codes).decode()) for o in ops] == [(0, "abcdefghij"), (1, "klm")]
    assert [o.x for o in ops] == [0.0, 0.0]


def test_no_wrap_without_a_break_in_the_source():
    ops = Setter(paragraph(brk=False), {}, METRICS).run("abcdefghijklm")
    assert {o.line for o in ops} == {0} and "".join(bytes.fromhex(o.codes).decode() for o in ops) == "abcdefghijklm"


def test_font_change_parts_the_text():
    ops = Setter(paragraph(), {}, METRICS).run("ab中c")
    assert [(o.font, o.codes, o.x) for o in ops] == [("tiro", "6162", 0.0), ("noto", "4e2d", 10.0), ("tiro", "63", 20.0)]


def test_formula_is_placed_with_its_lines():
    ops = Setter(paragraph(), {0: formula()}, METRICS).run("ab{v0}{v9}c")
    assert [(o.font, o.x, o.dy) for o in ops] == [("tiro", 0.0, 0.0), ("F1", 10.0, 2.0), (None, 10.0, 0.0), ("tiro", 22.0, 0.0)]
    first = Setter(paragraph(), {0: formula()}, METRICS).run("{v0}")
    assert first[0].dy == 0.0  # nothing stands before it
    assert len(Setter(paragraph(), {0: formula(linewidth=5.0)}, METRICS).run("{v0}")) == 1


def test_modifier_takes_no_advance():
    ops = Setter(paragraph(), {0: formula(ch="ʰ")}, METRICS).run("a{v0}b")
    assert ops[-1].x == 5.0


def test_line_height():
    assert line_height("zh", 100.0, 1, 10.0) == 1.4
    assert line_height("ru", 1.0, 9, 10.0) == 0.8
    assert 0.9 < line_height("en", 10.0, 3, 10.0) < 1.0


def test_container_text():
    said = set_container([paragraph()], ["ab"], [], [{"x0": 1.0, "y0": 2.0, "x1": 11.0, "y1": 2.0, "linewidth": 1.0}, {"x0": 0.0, "y0": 0.0, "x1": 1.0, "y1": 0.0, "linewidth": 9.0}], METRICS, "zh")
    assert said == "BT /tiro 10.000000 Tf 1 0 0 1 0.000000 100.000000 Tm [<6162>] TJ ET q 1 0 0 1 1.000000 2.000000 cm [] 0 d 0 J 1.000000 w 0 0 m 10.000000 0.000000 l S Q BT ET "


def test_wrapped_is_the_fold_for_equal_advances(spark):
    r = random.Random(5)
    said = ["".join(r.choice("ab ") for _ in range(r.randrange(60))) for _ in range(40)]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(said)], "k int, t string")
    lines = typeset.wrapped(F.col("t"), F.lit(5.0), F.lit(15.0), F.lit(0.0), F.lit(50.0), F.lit(10.0), F.lit(True))
    got = {x.k: x.lines for x in df.select("k", lines.alias("lines")).collect()}
    for k, t in enumerate(said):
        setter, want = Setter(paragraph(x=15.0), {}, METRICS), []
        for c in t:
            setter.char(c)
            want.append(setter.line)
        assert got[k] == want


def _container(r):
    metrics_sizes = (10.0, 7.0, 9.96)

    def glyph():
        x0, y0 = r.choice([5.0, 0.1, -3.3]), r.choice([101.0, 99.7])
        return {"ch": r.choice(["x", "ʰ", "", None, "xy"]), "cid": r.choice([88, 5, 300]), "font": r.choice(["F1", "F2*", "noto", "tiro", "AB+C", ""]), "size": r.choice(metrics_sizes), "x0": x0, "y0": y0, "x1": x0 + 4, "y1": y0 + 9, "width": 4.3}

    def line():
        return {"x0": r.choice([5.0, 1.7]), "y0": 99.0, "x1": 15.0, "y1": 99.0, "linewidth": r.choice([0.5, 4.999, 5.0, 9.0])}

    def paragraph_():
        return paragraph(para_idx=0, text="", x=r.choice([0.0, -0.0, 17.3, 60.0]), x0=r.choice([0.0, -0.0, 2.1]), x1=r.choice([50.0, 50.1, 4.0]), size=r.choice(metrics_sizes), brk=r.random() < 0.6, y1=r.choice([110.0, 400.0]))

    formulas = [{"vid": k, "glyphs": [glyph() for _ in range(r.randrange(1, 4))], "lines": [line() for _ in range(r.randrange(3))], "yfix": r.choice([0.0, 2.0, -1.1]), "width": r.choice([0.0, 12.0, 33.3])} for k in range(r.randrange(4))]
    paragraphs = [paragraph_() for _ in range(r.randrange(4))]
    pieces = ["a", "b", " ", " ", "é", "中", "😀", "{v0}", "{ V 1 }", "{v2}", "{v9}", "{v }", "{", "\n", "abcdefghijk"]
    return paragraphs, ["".join(r.choice(pieces) for _ in range(r.randrange(30))) for _ in paragraphs], formulas, [line() for _ in range(r.randrange(3))]


@pytest.mark.parametrize("glyph_of", [None, lambda c: c % 70000 + 1])
def test_a_batch_is_set_as_its_containers_are(glyph_of):
    r = random.Random(11)
    metrics = Metrics({**{c: 0.5 for c in range(32, 127)}, 98: 0.333, 233: 0.41}, {0x4E2D: 0.97}, 0.6, glyph_of)
    for n in (0, 1, 7, 200):
        rows = [_container(r) for _ in range(n)]
        paragraphs, formulas, lines = (pa.array([x[k] for x in rows], segment._arrow([kind])) for k, kind in ((0, segment._PARAGRAPH), (2, segment._FORMULA), (3, segment._LINE)))
        texts = pa.array([x[1] for x in rows], pa.list_(pa.string()))
        want = [typeset.set_container(*x, metrics, "zh") for x in rows]
        opened = segment.unpacked(segment.packed([paragraphs, formulas, lines]))
        assert [c.to_pylist() for c in opened[1:]] == [c.to_pylist() for c in (formulas, lines)]
        assert typeset.set_batch(opened[0], texts, *opened[1:], metrics, "zh").to_pylist() == want
        if n > 2:  # a part of a batch
            assert typeset.set_batch(paragraphs.slice(2), texts.slice(2), formulas.slice(2), lines.slice(2), metrics, "zh").to_pylist() == want[2:]
    with pytest.raises(ValueError, match="one text"):
        typeset.set_batch(paragraphs, texts.slice(1), formulas, lines, metrics, "zh")


def test_containers_are_dealt_once_and_not_sorted(spark):
    """Formulas travel as bytes: one shuffle, no sort of them, no arrays of glyphs in the JVM."""
    from quire import queries

    plan = queries.QUERIES["typeset_fold"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "glyphs" not in plan and "ShuffledHashJoin" in plan.split("== Physical Plan ==")[-1]
