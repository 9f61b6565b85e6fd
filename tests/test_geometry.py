import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quire.functions import geometry
from quire.operators import layout
from quire.plans.derived import CLASS_NAMES


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_rescaled_box_by_hand(spark):
    box = F.array(*[F.lit(x) for x in (512.0, 512.0, 768.0, 768.0)])
    got = one(spark, geometry.unscaled(box, F.lit(1024.0), F.lit(1024.0), F.lit(500.0), F.lit(300.0)))
    assert got == [149.90234375, 250.0, 274.90234375, 375.0]


def test_image_fit(spark):
    got = one(spark, geometry.resized(F.lit(100.0), F.lit(200.0), F.lit(1024), 32))
    assert (got.height, got.width, got.top, got.bottom, got.left, got.right) == (512, 1024, 0, 0, 0, 0)
    image = np.arange(100 * 200 * 3, dtype=np.uint8).reshape(100, 200, 3)
    assert layout.resize_and_pad(image, 1024, 32).shape == (512, 1024, 3)


@pytest.mark.parametrize("rotate", [0, 90, 180, 270])
def test_page_matrix(spark, rotate):
    m = geometry.page_ctm(F.lit(rotate), F.lit(10.0), F.lit(20.0), F.lit(110.0), F.lit(220.0))
    corners = [one(spark, geometry.apply(m, F.lit(x), F.lit(y))) for x, y in ((10.0, 20.0), (110.0, 220.0))]
    assert min(c.x for c in corners) == min(c.y for c in corners) == 0.0
    size = one(spark, geometry.extent(m, F.lit(10.0), F.lit(20.0), F.lit(110.0), F.lit(220.0)))
    assert (size.width, size.height) == ((100.0, 200.0) if rotate % 180 == 0 else (200.0, 100.0))


def test_inverse(spark):
    m = F.array(*[F.lit(x) for x in (2.0, 1.0, 0.0, 4.0, 5.0, 6.0)])
    p = geometry.apply(m, F.lit(3.0), F.lit(7.0))
    back = one(spark, geometry.apply(geometry.inverse(m), p["x"], p["y"]))
    assert (back.x, back.y) == pytest.approx((3.0, 7.0))
    assert one(spark, geometry.inverse(F.array(*[F.lit(x) for x in (1.0, 2.0, 2.0, 4.0, 0.0, 0.0)]))) is None


def test_line_height(spark):
    rows = [(h * 7.5, n, s, start) for h in range(1, 20) for n in (1, 3, 6) for s in (8.0, 10.5) for start in (1.4, 1.1, 0.8)]

    def want(h, n, s, lh):
        while n * s * lh > h and lh >= 1:
            lh -= 0.05
        return lh

    df = spark.createDataFrame(rows, "h double, n int, s double, lh double")
    got = df.select("h", "n", "s", "lh", geometry.shrunk_line_height(*[F.col(c) for c in ("h", "n", "s", "lh")]).alias("x")).collect()
    assert all(r.x == want(r.h, r.n, r.s, r.lh) for r in got)


boxes = st.lists(st.tuples(*[st.floats(-20, 120)] * 4, st.sampled_from([0.1, 0.25, 0.3, 0.5, 0.9, math.nan]), st.integers(0, 7)), max_size=8)
points = st.lists(st.tuples(st.floats(-30, 130), st.floats(-30, 130)), min_size=1, max_size=20)


@settings(max_examples=12, deadline=None)
@given(boxes, points)
def test_class_at_is_a_painted_raster(spark, found, where):
    w, h = 90, 100
    raster = np.ones((h, w), int)
    kept = sorted(((k, b) for k, b in enumerate(found) if b[4] > 0.25), key=lambda x: -x[1][4])
    for skip in (False, True):
        for i, (_, (x0, y0, x1, y1, _, c)) in enumerate(kept):
            if (CLASS_NAMES[c] in ("abandon", "figure", "table", "isolate_formula", "formula_caption")) is skip:
                a, b, d, e = (int(np.clip(int(v), 0, top - 1)) for v, top in ((x0 - 1, w), (h - y1 - 1, h), (x1 + 1, w), (h - y0 + 1, h)))
                raster[b:e, a:d] = 0 if skip else i + 2
    want = [raster[int(np.clip(int(y), 0, h - 1)), int(np.clip(int(x), 0, w - 1))] for x, y in where]
    rows = spark.createDataFrame([(1, 0, k, *map(float, b[:5]), b[5]) for k, b in enumerate(found)], "doc_id long, pageno int, det_idx int, x0 double, y0 double, x1 double, y1 double, conf double, cls int")
    spots = spark.createDataFrame([(1, 0, k, float(x), float(y)) for k, (x, y) in enumerate(where)], "doc_id long, pageno int, k int, x0 double, y0 double")
    names = spark.createDataFrame(list(CLASS_NAMES.items()), "cls int, name string")
    got = layout.classified(spots, rows, names, w, h, ch=None).orderBy("k").collect()
    assert [r.cls for r in got] == want


def test_bullet_and_models(spark):
    model = layout.TableModel(CLASS_NAMES, {(1, 0): [[0, 0, 50, 50, 0.9, 1], [0, 0, 50, 50, 0.2, 1]]})
    found = layout.detect(spark.createDataFrame([(1, 0), (2, 0)], "doc_id long, pageno int"), model)
    assert [(r.doc_id, r.det_idx, r.cls) for r in found.orderBy("det_idx").collect()] == [(1, 0, 1), (1, 1, 1)]
    spots = spark.createDataFrame([(1, 0, "a", 5.0, 60.0), (1, 0, "•", 5.0, 60.0), (2, 0, "a", 5.0, 60.0)], "doc_id long, pageno int, ch string, x0 double, y0 double")
    names = spark.createDataFrame(list(CLASS_NAMES.items()), "cls int, name string")
    assert sorted((r.doc_id, r.ch, r.cls) for r in layout.classified(spots, found, names, 100, 100).collect()) == [(1, "a", 2), (1, "•", 0), (2, "a", 1)]
    assert layout.model_metadata({"names": "{0: 'title', 1: 'text'}", "stride": "32"}) == (32, {0: "title", 1: "text"})
    assert layout.preprocess([np.full((2, 3, 3), 255, np.uint8)]).shape == (1, 3, 2, 3)


class FakeSession:
    def get_modelmeta(self):
        return type("Meta", (), {"custom_metadata_map": {"names": "{0: 'title', 1: 'plain text'}", "stride": "32"}})()

    def run(self, outputs, inputs):
        assert inputs["images"].shape == (1, 3, 512, 1024) and inputs["images"].dtype == np.float32
        rows = np.zeros((1, 300, 6))
        rows[0, :3] = [[0, 0, 512, 256, 0.5, 1], [0, 0, 1024, 512, 0.9, 0], [0, 0, 10, 10, 0.25, 1]]
        return [rows]


def test_detector_of_images():
    model = layout.OnnxModel("none", FakeSession())
    found = model.predict(np.zeros((100, 200, 3), np.uint8), 1024)
    assert model.names == {0: "title", 1: "plain text"} and found[:, 4].tolist() == [0.9, 0.5]
    assert found[:, :4].tolist() == [[0, 0, 200, 100], [0, 0, 100, 50]]
    assert layout.unscale(np.array([[512.0, 512.0, 768.0, 768.0]]), (1024, 1024), (500, 300)).tolist() == [[149.90234375, 250.0, 274.90234375, 375.0]]
