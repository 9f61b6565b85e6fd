"""Typesetting: translated text and kept formulas to positioned drawing operators.

Lines break where the next advance would pass the right edge, which depends on all before
it, so a paragraph is set by a fold over its pieces. The fold gives no more than where each
stretch of text and each formula begins; places, operators and their texts are made for a
batch of containers at once (``set_batch``). ``Setter`` and ``set_container`` are the same
rules for one paragraph and one container, an operator at a time. ``wrapped`` is the greedy
rule for a fixed advance as a Column expression.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Accumulator
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import values
from quire.functions.glyphs import line_op_bytes, text_op_bytes
from quire.operators import segment
from quire.operators.layout import flat, numbers

BASE_FONT, WIDE_FONT = "tiro", "noto"
_PIECE = re.compile(r"\{\s*v([0-9\s]+)\}|(.)", re.IGNORECASE | re.DOTALL)
_MARK = re.compile(r"\{\s*v([0-9\s]+)\}", re.IGNORECASE)


@dataclass(frozen=True)
class Metrics:
    """Advances at size 1: of the base font by code point, and of the wide font for the rest."""

    base: Mapping[int, float] = field(default_factory=dict)
    wide: Mapping[int, float] = field(default_factory=dict)
    other: float = 1.0
    #: Glyph number of a code point in the wide font; the code point itself where none is given.
    glyph: Callable[[int], int] | None = None

    def font(self, ch: str) -> str:
        return BASE_FONT if ord(ch) in self.base else WIDE_FONT

    def advance(self, ch: str, size: float) -> float:
        c = ord(ch)
        return (self.base[c] if c in self.base else self.wide.get(c, self.other)) * size

    def codes(self, font: str, text: str, wide: bool = False) -> str:
        if font == WIDE_FONT:
            return "".join(f"{self.glyph(ord(c)) if self.glyph else ord(c):04x}" for c in text)
        return "".join(f"{ord(c):04x}" if wide else f"{ord(c):02x}" for c in text)


@dataclass
class Op:
    x: float
    dy: float
    line: int
    font: str | None = None  # None: a drawn line
    size: float = 0.0
    codes: str = ""
    linewidth: float = 0.0
    xlen: float = 0.0
    ylen: float = 0.0


def _modifier(formula: dict) -> float:
    last = formula["glyphs"][-1]
    return last["width"] if last["ch"] and unicodedata.category(last["ch"][0]) in values.MODIFIER_CATEGORIES else 0.0


class Setter:
    """Sets one paragraph's pieces; holds the pen, the line number and the buffer."""

    def __init__(self, paragraph: Mapping, formulas: Mapping[int, dict], metrics: Metrics) -> None:
        self.p, self.formulas, self.metrics = paragraph, formulas, metrics
        self.x, self.line, self.font = paragraph["x"], 0, None
        self.buffer, self.start = "", paragraph["x"]
        self.ops: list[Op] = []

    def _flush(self) -> None:
        if self.buffer:
            self.ops.append(Op(self.start, 0.0, self.line, self.font, self.p["size"], self.metrics.codes(self.font, self.buffer)))
        self.buffer = ""

    def _full(self, advance: float) -> bool:
        return self.x + advance > self.p["x1"] + 0.1 * self.p["size"]

    def _wrap(self, advance: float) -> None:
        if self.p["brk"] and self._full(advance):
            self.x, self.line = self.p["x0"], self.line + 1

    def char(self, ch: str) -> None:
        font, advance = self.metrics.font(ch), self.metrics.advance(ch, self.p["size"])
        if font != self.font or self._full(advance):
            self._flush()
        self._wrap(advance)
        if not self.buffer:
            self.start = self.x
        if not self.buffer and self.x == self.p["x0"] and ch == " ":
            advance = 0.0  # no blank at the start of a line
        else:
            self.buffer += ch
        self.font = font
        self.x += advance

    def formula(self, v: dict) -> None:
        self._flush()
        self._wrap(v["width"])
        first = v["glyphs"][0]
        fix = v["yfix"] if self.font is not None else 0.0
        for g in v["glyphs"]:
            font = g["font"].partition("+")[0]  # the resource's name; an asterisk: codes of two bytes
            codes = self.metrics.codes(font, chr(g["cid"]), font.endswith("*"))
            self.ops.append(Op(self.x + g["x0"] - first["x0"], fix + g["y0"] - first["y0"], self.line, font.rstrip("*"), g["size"], codes))
        for s in v["lines"]:
            if s["linewidth"] < values.THICK_LINE:
                self.ops.append(Op(s["x0"] + self.x - first["x0"], s["y0"] + fix - first["y0"], self.line, linewidth=s["linewidth"], xlen=s["x1"] - s["x0"], ylen=s["y1"] - s["y0"]))
        self.x += v["width"] - _modifier(v)

    def run(self, text: str) -> list[Op]:
        for piece in _PIECE.finditer(text):
            if piece[1] is None:
                self.char(piece[2])
                continue
            digits = re.sub(r"\s", "", piece[1])
            v = self.formulas.get(int(digits)) if digits else None
            if v is not None:  # a mark that stands for nothing is left out
                self.formula(v)
        self._flush()
        return self.ops


def line_height(lang_out: str, height: float, lines: int, size: float) -> float:
    value = values.LINE_HEIGHTS.get(lang_out.lower(), values.OTHER_LINE_HEIGHT)
    while lines * size * value > height and value >= 1:
        value -= 0.05
    return value


def set_paragraph(paragraph: Mapping, text: str, formulas: Mapping[int, dict], metrics: Metrics, lang_out: str) -> list[str]:
    """Drawing operators of one paragraph, as texts."""
    setter = Setter(paragraph, formulas, metrics)
    ops = setter.run(text)
    step = paragraph["size"] * line_height(lang_out, paragraph["y1"] - paragraph["y0"], setter.line + 1, paragraph["size"])
    out = []
    for o in ops:
        y = o.dy + paragraph["y"] - o.line * step
        out.append(line_op_bytes(o.x, y, o.xlen, o.ylen, o.linewidth) if o.font is None else text_op_bytes(o.font, o.size, o.x, y, o.codes))
    return out


def set_container(paragraphs: list[Mapping], texts: list[str], formulas: list[dict], lines: list[Mapping], metrics: Metrics, lang_out: str) -> str:
    """The whole text object of a page or form."""
    known = {v["vid"]: v for v in formulas}
    ops = [op for p, t in zip(paragraphs, texts, strict=True) for op in set_paragraph(p, t, known, metrics, lang_out)]
    ops += [line_op_bytes(s["x0"], s["y0"], s["x1"] - s["x0"], s["y1"] - s["y0"], s["linewidth"]) for s in lines if s["linewidth"] < values.THICK_LINE]
    return f"BT {''.join(ops)}ET "


class _Advances(dict):
    """Advance at one size, and font, of a character: told once, then looked up."""

    def __init__(self, metrics: Metrics, size: float) -> None:
        super().__init__()
        self.metrics, self.size = metrics, size

    def __missing__(self, ch: str) -> tuple[float, int]:
        self[ch] = said = self.metrics.advance(ch, self.size), int(self.metrics.font(ch) == WIDE_FONT)
        return said


#: A text operator before and after its place.
_HEAD, _TAIL = values.TEXT_OPERATOR.split(" %f %f ")
FONTS = (BASE_FONT, WIDE_FONT)


def _codes(metrics: Metrics, font: int, text: str) -> str:
    if font == 0 and text.isascii():
        return text.encode().hex()
    return metrics.codes(FONTS[font], text)


def _fixed(values_: np.ndarray) -> pa.Array:
    """%f of every number; each different one is written once."""
    bits = pa.array(np.ascontiguousarray(values_, np.float64).view(np.int64)).dictionary_encode()
    return pa.array(["%f" % v for v in numbers(bits.dictionary).view(np.float64).tolist()], pa.string()).take(bits.indices)


def _of_pairs(a: pa.Array, b: pa.Array, said: Callable) -> pa.Array:
    """said(a, b) of every row, called once for each different pair."""
    a, b = a.dictionary_encode(), b.dictionary_encode()
    many = max(1, len(b.dictionary))
    pair = pa.array(numbers(a.indices).astype(np.int64) * many + numbers(b.indices)).dictionary_encode()
    x, y = a.dictionary.to_pylist(), b.dictionary.to_pylist()
    return pa.array([said(x[k // many], y[k % many]) for k in pair.dictionary.to_pylist()], pa.string()).take(pair.indices)


def _within(at: np.ndarray, some: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Items of some lists, in order: item, which of ``some`` it is of, its number there."""
    many = at[some + 1] - at[some]
    of = np.repeat(np.arange(len(some)), many)
    number = np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)
    return at[some][of] + number, of, number


def _thin(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Offsets and values of lists of strokes, without thick ones."""
    at, drawn = flat(column)
    kept = numbers(drawn.field("linewidth")) < values.THICK_LINE
    return np.concatenate([[0], np.cumsum(kept)])[at], drawn.filter(pa.array(kept, pa.bool_()))


def _lines(x: np.ndarray, y: np.ndarray, drawn: pa.Array) -> pa.Array:
    a, b, c, d, w = (numbers(drawn.field(k)) for k in ("x0", "y0", "x1", "y1", "linewidth"))
    return pa.array([line_op_bytes(*r) for r in zip(x.tolist(), y.tolist(), (c - a).tolist(), (d - b).tolist(), w.tolist(), strict=True)], pa.string())


def set_batch(paragraphs: pa.Array, texts: pa.Array, formulas: pa.Array, lines: pa.Array, metrics: Metrics, lang_out: str) -> pa.Array:
    """``set_container`` of every row of a batch, from columns of lists."""
    p_at, p = flat(paragraphs)
    t_at, said = flat(texts)
    if not np.array_equal(p_at, t_at):
        raise ValueError("each paragraph has one text")
    f_at, f = flat(formulas)
    g_at, g = flat(f.field("glyphs"))
    l_at, l = _thin(f.field("lines"))  # noqa: E741
    s_at, s = _thin(lines)
    rows = len(p_at) - 1
    y, x, x0, x1, y0, y1, size = (numbers(p.field(c)).tolist() for c in ("y", "x", "x0", "x1", "y0", "y1", "size"))
    brk, said = p.field("brk").to_pylist(), said.to_pylist()
    vid, width = f.field("vid").to_pylist(), numbers(f.field("width"))
    last = pa.array(g_at[1:] - 1)
    end = g.field("ch").take(last).dictionary_encode()
    light = np.array([bool(c) and unicodedata.category(c[0]) in values.MODIFIER_CATEGORIES for c in end.dictionary.to_pylist()] + [False], bool)
    moved = (width - np.where(light[numbers(pc.fill_null(end.indices, len(light) - 1))], numbers(g.field("width").take(last)), 0.0)).tolist()
    width = width.tolist()

    # The fold: where stretches of text (formula -1) and formulas begin, and on which line.
    e_x, e_line, e_formula, e_font, tails, until, steps = [], [], [], [], [], [0], []
    sizes: dict[float, _Advances] = {}
    for row in range(rows):
        known = dict(zip(vid[f_at[row] : f_at[row + 1]], range(f_at[row], f_at[row + 1]), strict=True))
        for k in range(p_at[row], p_at[row + 1]):
            if size[k] not in sizes:
                sizes[size[k]] = _Advances(metrics, size[k])
            told = sizes[size[k]].__getitem__
            pen, left, edge, turns, line, font = x[k], x0[k], x1[k] + 0.1 * size[k], brk[k], 0, -1
            for v, text in _tokens(said[k], known):
                if v is not None:
                    if turns and pen + width[v] > edge:
                        pen, line = left, line + 1
                    e_x.append(pen)
                    e_line.append(line)
                    e_formula.append(v)
                    e_font.append(font)
                    pen += moved[v]
                    continue
                empty, begin, start = True, 0, pen
                for i, (advance, own) in enumerate(map(told, text)):
                    after = pen + advance
                    if own == font and not empty and after <= edge:
                        pen = after
                        continue
                    full = after > edge
                    if not empty and (full or own != font):
                        e_x.append(start)
                        e_line.append(line)
                        e_formula.append(-1)
                        e_font.append(font)
                        tails.append(_codes(metrics, font, text[begin:i]))
                        empty = True
                    if full and turns:
                        pen, line = left, line + 1
                        after = pen + advance
                    font = own
                    if empty:
                        if pen == left and text[i] == " ":
                            pen += 0.0  # no blank at the start of a line
                            continue
                        empty, begin, start = False, i, pen
                    pen = after
                if not empty:
                    e_x.append(start)
                    e_line.append(line)
                    e_formula.append(-1)
                    e_font.append(font)
                    tails.append(_codes(metrics, font, text[begin:]))
            until.append(len(e_x))
            steps.append(size[k] * line_height(lang_out, y1[k] - y0[k], line + 1, size[k]))

    pen, font, formula = np.array(e_x, np.float64), np.array(e_font, np.int64), np.array(e_formula, np.int64)
    until = np.array(until)
    para = np.repeat(np.arange(len(p)), np.diff(until))
    base, down = np.array(y, np.float64)[para], np.array(e_line, np.float64) * np.array(steps, np.float64)[para]
    plain, held = np.flatnonzero(formula < 0), np.flatnonzero(formula >= 0)
    glyph, of, g_number = _within(g_at, formula[held])
    stroke, of_l, l_number = _within(l_at, formula[held])
    first = g_at[formula[held]]
    fix = np.where(font[held] >= 0, numbers(f.field("yfix"))[formula[held]], 0.0)
    gx, gy = numbers(g.field("x0")), numbers(g.field("y0"))

    # Operators' texts: of stretches, of formulas' glyphs and strokes, of a container's strokes.
    said = _of_pairs(pa.array(np.array(size, np.float64)[para[plain]]), pa.array(font[plain]), lambda size, font: _HEAD % (FONTS[font], size))
    spans = _operators(said, pen[plain], 0.0 + base[plain] - down[plain], pa.array([_TAIL % c for c in tails], pa.string()))
    names, chosen = g.field("font").take(pa.array(glyph)), pa.array(glyph)
    said = _of_pairs(names, g.field("size").take(chosen), lambda font, size: _HEAD % (_resource(font).rstrip("*"), size))
    codes = _of_pairs(names, g.field("cid").take(chosen), lambda font, cid: _TAIL % metrics.codes(_resource(font), chr(cid), _resource(font).endswith("*")))
    e = held[of]
    marks = _operators(said, pen[e] + gx[glyph] - gx[first][of], fix[of] + gy[glyph] - gy[first][of] + base[e] - down[e], codes)
    drawn, e_l = l.take(pa.array(stroke)), held[of_l]
    bars = _lines(numbers(drawn.field("x0")) + pen[e_l] - gx[first][of_l], numbers(drawn.field("y0")) + fix[of_l] - gy[first][of_l] + base[e_l] - down[e_l], drawn)
    own = _lines(numbers(s.field("x0")), numbers(s.field("y0")), s)

    # Their places in one buffer, in which a container's stream is a stretch.
    many = np.ones(len(pen), np.int64)
    many[held] = np.diff(g_at)[formula[held]] + np.diff(l_at)[formula[held]]
    at = np.concatenate([[0], np.cumsum(many)])
    cut, row = at[until[p_at]], np.arange(rows)  # operators before each container, and of all
    shift = np.repeat(2 * row + 1 + s_at[:-1], np.diff(until[p_at]))
    begin = at[:-1] + shift
    s_row = np.repeat(row, np.diff(s_at))
    where = [begin[plain], begin[e] + g_number, begin[e_l] + np.diff(g_at)[formula[held]][of_l] + l_number, cut[s_row + 1] + 2 * s_row + 1 + np.arange(len(s)), cut[:-1] + 2 * row + s_at[:-1], cut[1:] + 2 * row + 1 + s_at[1:]]
    order = np.empty(sum(len(w) for w in where), np.int64)
    order[np.concatenate(where)] = np.arange(len(order))
    made = pa.concat_arrays([spans, marks, bars, own, pa.array(["BT "] * rows, pa.string()), pa.array(["ET "] * rows, pa.string())]).cast(pa.large_string()).take(pa.array(order))
    _, ends, data = made.buffers()
    ends = np.frombuffer(ends, np.int64)[: len(made) + 1][np.append(where[4], len(made))] if rows else np.zeros(1, np.int64)
    return pa.LargeStringArray.from_buffers(rows, pa.py_buffer(np.ascontiguousarray(ends)), data).cast(pa.string())


def _tokens(text: str, known: Mapping[int, int]) -> list[tuple[int | None, str]]:
    """Formulas, by their place, and the stretches of text between them."""
    if "{" not in text:
        return [(None, text)]
    parts = _MARK.split(text)
    out, held = [], parts[0]
    for digits, after in zip(parts[1::2], parts[2::2], strict=True):
        digits = re.sub(r"\s", "", digits)
        v = known.get(int(digits)) if digits else None
        if v is None:  # a mark that stands for nothing is left out
            held += after
            continue
        out += [(None, held), (v, "")]
        held = after
    return [*out, (None, held)]


def _resource(font: str) -> str:
    """The resource's name; an asterisk at its end: codes of two bytes."""
    return font.partition("+")[0]


def _operators(heads: pa.Array, x: np.ndarray, y: np.ndarray, tails: pa.Array) -> pa.Array:
    return pc.binary_join_element_wise(heads, _fixed(x), _fixed(y), tails, " ")


#: Containers that are set at once.
CONTAINERS = 64


def typeset(containers: DataFrame, metrics: Metrics, lang_out: str, done: Accumulator | None = None) -> DataFrame:
    """containers (the key, texts, and what segment.segment packs) to their new stream, ops.

    ``done`` counts pages as they are set; what runs twice counts twice.
    """
    held = containers.sparkSession.sparkContext.broadcast(metrics)  # two fonts' tables

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, CONTAINERS):
                batch = whole.slice(k, CONTAINERS)
                paragraphs, formulas, lines = segment.unpacked(batch.column("packed"))
                ops = set_batch(paragraphs, batch.column("texts"), formulas, lines, held.value, lang_out)
                if done is not None:
                    done.add(sum(c == "page" for c in batch.column("container").to_pylist()))
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in segment.CONTAINER], ops], names=["doc_id", "pageno", "container", "ops"])

    return containers.select(*segment.CONTAINER, "texts", "packed").mapInArrow(run, "doc_id long, pageno int, container string, ops string")


# Rules without feedback, as expressions.


def pieces(text: Column) -> Column:
    """A text's marks and single code points, in order."""
    return F.regexp_extract_all(text, F.lit(r"(?is)\{\s*v[0-9\s]+\}|."), F.lit(0))


def font_choice(code_point: Column, covered: Column) -> Column:
    return F.when(covered, BASE_FONT).otherwise(WIDE_FONT)


def wrapped(text: Column, advance: Column, x: Column, x0: Column, x1: Column, size: Column, brk: Column) -> Column:
    """Line number of each code point when all advance alike: greedy, blanks dropped at line starts.

    The fold notes where lines begin, so its array grows by a line and not by a code point.
    """
    none = F.array().cast("array<int>")
    state = F.struct(x.cast("double").alias("x"), F.lit(0).alias("k"), none.alias("turns"))

    def step(a: Column, ch: Column) -> Column:
        turn = brk & (a["x"] + advance > x1 + 0.1 * size)
        at = F.when(turn, x0.cast("double")).otherwise(a["x"])
        moved = F.when((at == x0) & (ch == " "), at).otherwise(at + advance)
        return F.struct(moved.alias("x"), (a["k"] + 1).alias("k"), F.when(turn, F.concat(a["turns"], F.array(a["k"]))).otherwise(a["turns"]).alias("turns"))

    letters = F.filter(F.split(text, ""), lambda c: c != "")
    cuts = F.aggregate(letters, state, step, lambda a: F.concat(F.array(F.lit(0)), a["turns"], F.array(a["k"])))
    return F.flatten(F.transform(F.slice(cuts, 2, F.size(cuts) - 1), lambda end, line: F.array_repeat(line, end - cuts[line])))
