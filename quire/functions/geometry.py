"""Geometry of pages, images and boxes as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _half_even(x: Column) -> Column:
    return F.bround(x, 0)


def page_ctm(rotate: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Matrix that takes a page's crop box, turned by a multiple of 90 degrees, to the origin."""
    n = [F.lit(float(v)) for v in (-1, 0, 1)]
    return (
        F.when(rotate == 90, F.array(n[1], n[0], n[2], n[1], -y0, x1))
        .when(rotate == 180, F.array(n[0], n[1], n[1], n[0], x1, y1))
        .when(rotate == 270, F.array(n[1], n[2], n[0], n[1], y1, -x0))
        .otherwise(F.array(n[2], n[1], n[1], n[2], -x0, -y0))
    )


def apply(m: Column, x: Column, y: Column) -> Column:
    """A point under a matrix."""
    return F.struct((m[0] * x + m[2] * y + m[4]).alias("x"), (m[1] * x + m[3] * y + m[5]).alias("y"))


def product(m1: Column, m0: Column) -> Column:
    """The matrix that applies m1, then m0."""
    return F.array(
        m0[0] * m1[0] + m0[2] * m1[1],
        m0[1] * m1[0] + m0[3] * m1[1],
        m0[0] * m1[2] + m0[2] * m1[3],
        m0[1] * m1[2] + m0[3] * m1[3],
        m0[0] * m1[4] + m0[2] * m1[5] + m0[4],
        m0[1] * m1[4] + m0[3] * m1[5] + m0[5],
    )


def inverse(m: Column) -> Column:
    """The matrix that undoes m; null where there is none."""
    det = m[0] * m[3] - m[1] * m[2]
    a, b, c, d = m[3] / det, -m[1] / det, -m[2] / det, m[0] / det
    return F.when(det != 0, F.array(a, b, c, d, -(m[4] * a + m[5] * c), -(m[4] * b + m[5] * d)))


def extent(m: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Width and height of a crop box under a matrix."""
    p, q = apply(m, x0, y0), apply(m, x1, y1)
    return F.struct(F.abs(p["x"] - q["x"]).alias("width"), F.abs(p["y"] - q["y"]).alias("height"))


def network_size(height: Column) -> Column:
    """Input size of the layout model: the height, down to a multiple of 32."""
    return (F.floor(height / 32) * 32).cast("int")


def resized(h: Column, w: Column, target: Column, stride: int) -> Column:
    """Scale, size and padding by which an image fits a square, padded to the stride only."""
    r = F.least(target / h, target / w)
    rh, rw = _half_even(h * r).cast("int"), _half_even(w * r).cast("int")
    pad_h, pad_w = F.pmod(target - rh, F.lit(stride)), F.pmod(target - rw, F.lit(stride))
    top, left = F.floor(pad_h / 2).cast("int"), F.floor(pad_w / 2).cast("int")
    return F.struct(r.alias("ratio"), rh.alias("height"), rw.alias("width"), top.alias("top"), (pad_h - top).cast("int").alias("bottom"), left.alias("left"), (pad_w - left).cast("int").alias("right"))


def unscaled(box: Column, h1: Column, w1: Column, h0: Column, w0: Column) -> Column:
    """A box of the padded image in the coordinates of the original one."""
    gain = F.least(h1 / h0, w1 / w0)
    pad_x, pad_y = _half_even((w1 - w0 * gain) / 2 - 0.1), _half_even((h1 - h0 * gain) / 2 - 0.1)
    return F.array((box[0] - pad_x) / gain, (box[1] - pad_y) / gain, (box[2] - pad_x) / gain, (box[3] - pad_y) / gain)


def painted(x0: Column, y0: Column, x1: Column, y1: Column, w: Column, h: Column) -> Column:
    """Pixels that a box covers: one wider on each side, y upward, ends exclusive."""
    clip = lambda v, top: F.greatest(F.lit(0), F.least(v.cast("int"), top - 1))
    return F.struct(clip(x0 - 1, w).alias("left"), clip(h - y1 - 1, h).alias("bottom"), clip(x1 + 1, w).alias("right"), clip(h - y0 + 1, h).alias("top"))


def shrunk_line_height(height: Column, lines: Column, size: Column, start: Column) -> Column:
    """Smaller by 0.05 while the lines do not fit and it is 1 or more."""
    steps = F.sequence(F.lit(1), F.lit(12))
    return F.aggregate(steps, start, lambda lh, _: F.when((lines * size * lh > height) & (lh >= 1.0), lh - F.lit(0.05)).otherwise(lh))
