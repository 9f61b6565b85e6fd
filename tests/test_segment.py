import random
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quire.operators import segment


@dataclass
class Glyph:
    ch: str | None
    x0: float
    y0: float
    x1: float
    y1: float
    size: float = 0.0
    font: str = ""
    cls: int = 1
    cid: int = 0
    a: float = 1.0
    d: float = 1.0
    linewidth: float = 0.0


def Stroke(x0, y0, x1, y1, linewidth, cls=1):
    return Glyph(None, x0, y0, x1, y1, cls=cls, linewidth=linewidth)


@dataclass
class Parts:
    paragraphs: list
    formulas: list
    lines: list


def pages_of(containers):
    kinds = {"string": pa.string(), "int": pa.int32(), "double": pa.float64()}
    lists = {c: pa.array([[getattr(g, c) for g in items] for items in containers], pa.list_(kinds[t])) for c, t in segment.ITEMS.items()}
    return lists, np.array([g.cls for items in containers for g in items], np.int64)


def fold_all(containers, width, rules=None):
    lists, classes = pages_of(containers)
    made = segment.segment_batch(lists, classes, np.full(len(containers), width), rules or segment.Rules())
    return [Parts(*x) for x in zip(*(m.to_pylist() for m in made), strict=True)]


def fold(items, width):
    return fold_all([items], width)[0]


def row(text, y=100.0, x=0.0, size=10.0, font="Times", cls=2, step=6.0):
    return [Glyph(c, x + step * k, y, x + step * k + step - 1, y + size, size, font, cls) for k, c in enumerate(text)]


def texts(state):
    return [p["text"] for p in state.paragraphs]


def test_plain_paragraph_with_a_wrapped_line():
    state = fold(row("ab cd") + row("ef", y=88.0), 600.0)
    assert texts(state) == ["ab cd ef"]
    assert state.paragraphs[0]["brk"] and state.paragraphs[0]["y0"] == 88.0 and state.paragraphs[0]["x1"] == 29.0


def test_gap_becomes_a_blank():
    assert texts(fold(row("ab") + row("cd", x=40.0), 600.0)) == ["ab cd"]


def test_class_change_starts_a_paragraph():
    assert texts(fold(row("ab", cls=2) + row("cd", cls=3, y=50.0), 600.0)) == ["ab", "cd"]


def test_formula_font_is_kept_as_a_mark():
    state = fold(row("let ") + row("xy", x=24.0, font="A+CMMI10") + row(" be", x=36.0), 600.0)
    assert texts(state) == ["let {v0} be"]
    assert [g["ch"] for g in state.formulas[0]["glyphs"]] == ["x", "y"] and state.formulas[0]["width"] == 11.0


def test_brackets_behind_a_formula_belong_to_it():
    state = fold(row("ab") + row("f", x=12.0, font="CMMI10") + row("(2)", x=18.0) + row("c", x=36.0), 600.0)
    assert texts(state) == ["ab{v0}2{v1}c"]
    assert ["".join(g["ch"] for g in v["glyphs"]) for v in state.formulas] == ["f(", ")"]


def test_small_index_is_a_formula():
    state = fold(row("abc") + row("2", x=18.0, size=7.0) + row("d", x=24.0), 600.0)
    assert texts(state) == ["abc{v0}d"]


def test_excluded_area_is_a_formula_and_is_not_continued():
    state = fold(row("xy", cls=0) + row("ab", cls=0, y=80.0) + row("cd", cls=2, y=60.0), 600.0)
    assert texts(state)[-1] == "cd"
    assert "".join(g["ch"] for v in state.formulas for g in v["glyphs"]) == "xyab"


def test_large_first_letter_sets_the_size():
    state = fold(row("A", size=20.0) + row("bc", x=12.0, size=10.0, y=100.0), 600.0)
    assert state.paragraphs[0]["size"] == 10.0 and state.paragraphs[0]["y"] == 110.0


def test_lines_follow_open_formulas():
    items = row("ab") + row("x", x=12.0, font="CMMI10") + [Stroke(12.0, 99.0, 18.0, 99.0, 0.4, cls=2)] + row("c", x=18.0) + [Stroke(0.0, 10.0, 50.0, 10.0, 0.4, cls=2)]
    state = fold(items, 600.0)
    assert len(state.formulas[0]["lines"]) == 1 and len(state.lines) == 1


def test_every_mark_once_and_bounds_hold():
    r = random.Random(3)
    for _ in range(200):
        items = [Glyph(r.choice("ab ()+xα"), r.uniform(0, 500), r.uniform(0, 700), 0, 0, r.choice([7.0, 10.0]), r.choice(["Times", "CMMI10"]), r.choice([0, 1, 2])) for _ in range(r.randrange(1, 40))]
        for g in items:
            g.x1, g.y1 = g.x0 + 5, g.y0 + g.size
        state = fold(items, 480.0)
        said = "".join(texts(state))
        assert all(said.count(f"{{v{k}}}") == 1 for k in range(len(state.formulas)))
        assert sum(len(v["glyphs"]) for v in state.formulas) + sum(len(t) for t in texts(state)) >= len(items)
        assert min(p["x0"] for p in state.paragraphs) == min(g.x0 for g in items)
        assert max(p["y1"] for p in state.paragraphs) == max(g.y1 for g in items)


def some_page(r, n):
    """Glyphs of all kinds, at whole numbers."""
    out, x, y, cls = [], 0.0, 700.0, 2
    for _ in range(n):
        cls = r.choice([0, 1, 2]) if r.random() < 0.08 else cls
        if r.random() < 0.05:
            out.append(Stroke(r.randrange(500), 1.0, 2.0, 3.0, 0.4, r.choice([1, 2])))
            continue
        x += r.choice([6, 6, 6, 6, 9, 200, -30])
        x, y = (0.0, y - 12) if not 0 <= x <= 460 else (float(x), y)
        size = r.choice([10.0, 10.0, 10.0, 7.0, 20.0])
        out.append(Glyph(r.choice(["a", "b", " ", "(", ")", "x", "α", "fi", "", "\t", "(cid:3)", "+", "."]), x, y, x + 5, y + size, size, r.choice(["Times"] * 3 + ["A+CMMI10"]), cls, r.randrange(9), r.choice([1.0] * 9 + [0.0]), r.choice([1.0] * 5 + [0.0])))
    return out


def test_containers_of_a_batch_do_not_touch():
    r = random.Random(5)
    for _ in range(60):
        some = [some_page(r, r.randrange(40)) for _ in range(r.randrange(1, 6))]
        assert fold_all(some, 480.0) == [fold(items, 480.0) for items in some]


def test_plain_runs_are_skipped_without_effect():
    r = np.random.default_rng(6)
    for _ in range(200):
        n = int(r.integers(1, 60))
        starts = r.random(n) < 0.1
        starts[0] = True
        given = (starts, starts | (r.random(n) < 0.2), r.random(n) < r.choice([0.0, 0.1]), r.choice([10.0, 10.0, 10.0, 7.0], n) if r.random() < 0.5 else np.full(n, 10.0), r.integers(0, 7, n), r.random(n) < 0.2, r.random(n) < 0.1)
        for a, b in zip(segment.roles(*given), segment.roles(*given, skip_plain=False), strict=True):
            assert a.tolist() == b.tolist()


def test_rows_give_the_same_as_arrays(spark):
    r = random.Random(4)
    glyphs = {p: row("one two ", y=100.0) + row("xy", x=48.0, font="CMMI10") + row(f" end {p}", x=60.0) for p in range(3)}
    rows = [(1, p, "page", k, *[getattr(g, c) for c in segment.ITEMS], g.cls) for p, gs in glyphs.items() for k, g in enumerate(gs)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, pageno int, container string, seq long, " + ", ".join(f"{c} {t}" for c, t in segment.ITEMS.items()) + ", cls int").repartition(4)
    classed = df.groupBy(*segment.CONTAINER).agg(F.array_sort(F.collect_list(F.struct("seq", "cls"))).alias("c")).select(*segment.CONTAINER, F.col("c.cls").alias("cls"))
    got = {x.pageno: [p.text for p in x.paragraphs] for x in segment.segment(segment.gathered(df).join(classed, list(segment.CONTAINER)), 600.0).collect()}
    assert got == {p: texts(fold(gs, 600.0)) for p, gs in glyphs.items()}
    plain = segment.segment(segment.gathered(df.where("pageno = 0")), 600.0).collect()  # no classes: all is plain text
    assert [p.text for p in plain[0].paragraphs] == ["one two {v0} end 0"]


def test_runs_are_the_windows(spark):
    r = random.Random(8)
    rows = [(d, p, k, float(r.randrange(80)), r.randrange(3)) for d in range(3) for p in range(2) for k in range(r.randrange(30))]
    df = spark.createDataFrame(rows, "doc_id long, pageno int, seq long, x0 double, cls int").selectExpr("*", "x0 + 5 as x1", "x0 * 2 as y0", "x0 * 2 + 10 as y1")
    key = ["doc_id", "pageno", "para_idx"]
    spaced = segment.spaced(segment.islands(df))
    want = segment.bounds(spaced).join(spaced.groupBy(*key).agg(F.min("seq").alias("first_seq"), F.count(F.when(F.col("space_before"), 1)).alias("spaces"), F.count(F.when(F.col("wraps"), 1)).alias("wraps")), key)
    items = F.array_sort(F.collect_list(F.struct("seq", "cls", "x0", "x1", "y0", "y1")))
    pages = df.groupBy("doc_id", "pageno").agg(items.alias("g")).select("doc_id", "pageno", "g.cls", "g.seq", "g.x0", "g.x1", "g.y0", "g.y1")
    got = segment.runs(pages)
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(map(tuple, want.collect()))


def test_window_versions_match_the_fold_on_plain_text(spark):
    items = row("ab cd", cls=2) + row("ef", y=88.0, cls=2) + row("gh", y=50.0, cls=3)
    rows = [(1, 0, k, g.ch, g.x0, g.x1, g.y0, g.y1, g.cls) for k, g in enumerate(items)]
    df = spark.createDataFrame(rows, "doc_id long, pageno int, seq long, ch string, x0 double, x1 double, y0 double, y1 double, cls int")
    spaced = segment.spaced(segment.islands(df))
    said = spaced.groupBy("para_idx").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", F.concat(F.when(F.col("space_before"), " ").otherwise(""), "ch").alias("t")))), lambda x: x["t"]), "").alias("t"))
    assert [r.t for r in said.orderBy("para_idx").collect()] == texts(fold(items, 600.0))
