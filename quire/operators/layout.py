"""Layout: detections to ranked boxes, and the class of the spot where a glyph stands.

No raster is made. A page's boxes travel as one short array, at most a detector's worth.
Pages are rows that hold their glyphs as arrays; page and boxes meet by an equi-join of
pages, and classes are found by array. For single points there is an expression too.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import geometry, values

PAGE = ("doc_id", "pageno")
NO_BOX, EXCLUDED, FIRST_BOX = 1, 0, 2


class LayoutModel(Protocol):
    """Detects boxes on page images."""

    stride: int
    names: dict[int, str]

    def predict(self, image: np.ndarray, size: int) -> np.ndarray:
        """Rows x0, y0, x1, y1, confidence, class."""
        ...


class TableModel:
    """A model whose detections are given: by page key, as rows of six numbers."""

    stride = 32

    def __init__(self, names: dict[int, str], detections: dict[tuple, list[list[float]]]) -> None:
        self.names, self.detections = names, detections

    def predict_page(self, key: tuple) -> np.ndarray:
        return np.array(self.detections.get(key, []), np.float64).reshape(-1, 6)

    def predict(self, image: np.ndarray, size: int) -> np.ndarray:
        raise LookupError("a table of detections goes by page key, not by image")


class OnnxModel:
    """A detector in an ONNX file: one session a worker, made where it is first used.

    The file is a path that every worker can read. A session that is given is used as it is.
    """

    def __init__(self, path: str, session: object | None = None) -> None:
        self.path, self._session = path, session

    def __getstate__(self) -> dict:
        return {"path": self.path, "_session": None}  # sessions do not travel

    @property
    def session(self):
        if self._session is None:
            import onnxruntime

            self._session = onnxruntime.InferenceSession(self.path)
        return self._session

    @property
    def stride(self) -> int:
        return model_metadata(self.session.get_modelmeta().custom_metadata_map)[0]

    @property
    def names(self) -> dict[int, str]:
        return model_metadata(self.session.get_modelmeta().custom_metadata_map)[1]

    def predict(self, image: np.ndarray, size: int) -> np.ndarray:
        """Detections above the threshold, in the image's own pixels, the surest first."""
        fitted = resize_and_pad(image, size, self.stride)
        found = np.asarray(self.session.run(None, {"images": preprocess([fitted])})[0], np.float64)[0]
        found = found[found[:, 4] > values.LEAST_CONFIDENCE]
        found[:, :4] = unscale(found[:, :4], fitted.shape[:2], image.shape[:2])
        return found[np.argsort(-found[:, 4], kind="stable")]


def unscale(boxes: np.ndarray, padded: tuple[int, int], original: tuple[int, int]) -> np.ndarray:
    """The rule of geometry.unscaled for an array of boxes."""
    gain = min(padded[0] / original[0], padded[1] / original[1])
    pad_y, pad_x = (round((p - o * gain) / 2 - 0.1) for p, o in zip(padded, original, strict=True))
    return (boxes - [pad_x, pad_y, pad_x, pad_y]) / gain


def model_metadata(metadata: dict[str, str]) -> tuple[int, dict[int, str]]:
    """Stride and class names that a model file carries as literals."""
    import ast

    names = ast.literal_eval(metadata["names"])
    return int(ast.literal_eval(metadata["stride"])), {int(k): str(v) for k, v in names.items()}


def preprocess(images: list[np.ndarray]) -> np.ndarray:
    """Height, width, channel bytes to a batch of channels first, scaled to 0..1."""
    return np.stack([np.transpose(x, (2, 0, 1)) for x in images]).astype(np.float32) / np.float32(255)


def resize_and_pad(image: np.ndarray, target: int, stride: int, fill: int = 114) -> np.ndarray:
    """Bilinear fit into a square, padded evenly to the stride only."""
    h, w = image.shape[:2]
    r = min(target / h, target / w)
    rh, rw = round(h * r), round(w * r)

    def axis(n: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.clip((np.arange(m) + 0.5) * n / m - 0.5, 0, n - 1)
        low = np.floor(at).astype(int)
        return low, np.minimum(low + 1, n - 1), at - low

    (a, b, f), (c, d, g) = axis(h, rh), axis(w, rw)
    x = image.astype(np.float64)
    f, g = f[:, None, None], g[None, :, None]
    out = (x[a][:, c] * (1 - g) + x[a][:, d] * g) * (1 - f) + (x[b][:, c] * (1 - g) + x[b][:, d] * g) * f
    pad_h, pad_w = (target - rh) % stride, (target - rw) % stride
    return np.pad(np.rint(out).astype(image.dtype), ((pad_h // 2, pad_h - pad_h // 2), (pad_w // 2, pad_w - pad_w // 2), (0, 0)), constant_values=fill)


def detect(pages: DataFrame, model: TableModel | LayoutModel) -> DataFrame:
    """doc_id, pageno, det_idx, box and score of every detection; a model a worker.

    ``pages`` has doc_id, pageno and, for a model of images, image, h and w.
    """
    held = pages.sparkSession.sparkContext.broadcast(model)  # a model of a fixed size

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = held.value
        for batch in batches:
            out = []
            for row in batch.itertuples():
                if isinstance(m, TableModel):
                    found = m.predict_page((row.doc_id, row.pageno))
                else:
                    image = np.frombuffer(row.image, np.uint8).reshape(row.h, row.w, 3)
                    found = m.predict(image, int(row.h / 32) * 32)
                out += [(row.doc_id, row.pageno, k, *map(float, x[:5]), int(x[5])) for k, x in enumerate(found)]
            yield pd.DataFrame(out, columns=["doc_id", "pageno", "det_idx", "x0", "y0", "x1", "y1", "conf", "cls"])

    return pages.mapInPandas(run, "doc_id long, pageno int, det_idx int, x0 double, y0 double, x1 double, y1 double, conf double, cls int")


def confident(boxes: DataFrame, least: float = values.LEAST_CONFIDENCE) -> DataFrame:
    """Detections above the threshold; not-a-number is not above it."""
    return boxes.where((F.col("conf") > F.lit(least)) & ~F.isnan("conf"))


def ranked(boxes: DataFrame) -> DataFrame:
    """With the place in order of confidence from 0; equal ones keep the detector's order."""
    order = Window.partitionBy(*PAGE).orderBy(F.desc("conf"), "det_idx")
    return boxes.withColumn("i", F.row_number().over(order) - 1)


def excluded(name: Column) -> Column:
    return name.isin(*values.EXCLUDED_CLASSES)


def painted_boxes(boxes: DataFrame, class_names: DataFrame | None, width: Column, height: Column) -> DataFrame:
    """One row a page: its ranked boxes as pixel rectangles.

    Without ``class_names`` the boxes themselves carry the ``name`` of their class.
    """
    kept = ranked(confident(boxes))
    named = kept if class_names is None else kept.drop("name").join(F.broadcast(class_names), "cls")  # a row for each class of the model
    where = geometry.painted(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"), width, height)
    box = F.struct("i", excluded(F.col("name")).alias("excluded"), where.alias("at"))
    return named.groupBy(*PAGE).agg(F.array_sort(F.collect_list(box)).alias("boxes"))


def class_at(boxes: Column, x: Column, y: Column, width: Column, height: Column) -> Column:
    """0 inside an excluded box, else 2 + rank of the last text box there, else 1."""
    px = F.greatest(F.lit(0), F.least(x.cast("int"), width - 1))
    py = F.greatest(F.lit(0), F.least(y.cast("int"), height - 1))

    def inside(b: Column) -> Column:
        at = b["at"]
        return (px >= at["left"]) & (px < at["right"]) & (py >= at["bottom"]) & (py < at["top"])

    here = F.filter(F.coalesce(boxes, F.expr("cast(array() as array<struct<i:int,excluded:boolean,at:struct<left:int,bottom:int,right:int,top:int>>>)")), inside)
    text = F.array_max(F.transform(here, lambda b: b["i"]))
    return F.when(F.exists(here, lambda b: b["excluded"]), EXCLUDED).otherwise(F.coalesce(text + FIRST_BOX, F.lit(NO_BOX)))


def classified(points: DataFrame, boxes: DataFrame, class_names: DataFrame, width: int | Column, height: int | Column, x: str = "x0", y: str = "y0", ch: str | None = "ch") -> DataFrame:
    """Points with cls; a bullet always counts as excluded."""
    w, h = (F.lit(v) if isinstance(v, int) else v for v in (width, height))
    joined = points.join(painted_boxes(boxes, class_names, w, h), list(PAGE), "left")
    cls = class_at(F.col("boxes"), F.col(x), F.col(y), w, h)
    if ch:
        cls = F.when(F.col(ch) == values.BULLET, EXCLUDED).otherwise(cls)
    return joined.withColumn("cls", cls).drop("boxes")


# Pages that hold their items as arrays.

def flat(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Offsets and values of a list column; a null list is empty."""
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    return np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64), column.flatten()


def numbers(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False)


def _page_boxes(boxes: DataFrame, class_names: DataFrame | None, width: Column, height: Column) -> DataFrame:
    sized = "page_w" in boxes.columns
    return painted_boxes(boxes, class_names, F.col("page_w").cast("int") if sized else width, F.col("page_h").cast("int") if sized else height)


def with_boxes(pages: DataFrame, boxes: DataFrame, class_names: DataFrame | None, width: int | Column, height: int | Column) -> DataFrame:
    """Pages with their ranked boxes and the page's size in whole points."""
    w, h = (F.lit(v) if isinstance(v, int) else v for v in (width, height))
    return pages.join(_page_boxes(boxes, class_names, w, h).hint("shuffle_hash"), list(PAGE), "left").withColumn("box_w", w.cast("int")).withColumn("box_h", h.cast("int"))


def with_document_boxes(documents: DataFrame, boxes: DataFrame, class_names: DataFrame | None, width: int = 1, height: int = 1) -> DataFrame:
    """Documents with the boxes of all their pages, for a reader that makes pages of them.

    What is shuffled is a document as it is stored, not its glyphs. Boxes carry page_w and
    page_h, or all pages have the given size. Few bytes may be much work, so documents are
    dealt to as many tasks as the session has shuffle partitions, not fewer.
    """
    tasks = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    painted = _page_boxes(boxes, class_names, F.lit(width), F.lit(height))
    own = painted.groupBy("doc_id").agg(F.collect_list(F.struct("pageno", "boxes")).alias("boxes"))  # a document's own pages
    return documents.repartition(tasks, "doc_id").join(own.hint("shuffle_hash"), "doc_id", "left")


def boxes_by_page(found: list | None) -> dict[int, list]:
    """What ``with_document_boxes`` gives a document, by page."""
    return {x["pageno"]: x["boxes"] for x in found or []}


def classes_of(batch: pa.RecordBatch) -> np.ndarray:
    """Class of every item of a batch of pages, the rule of ``class_at``; a bullet is excluded.

    Beside the arrays ch, x0, y0 the batch may hold ``cls`` itself, or boxes, box_w, box_h.
    """
    names = batch.schema.names
    if "cls" in names:
        return numbers(flat(batch.column("cls"))[1])
    offsets, ch = flat(batch.column("ch"))
    out = np.full(len(ch), NO_BOX, np.int32)
    if "boxes" in names:
        x, y = (np.trunc(numbers(flat(batch.column(c))[1])) for c in ("x0", "y0"))
        boxes, width, height = (batch.column(c) for c in ("boxes", "box_w", "box_h"))
        for r in np.flatnonzero(boxes.is_valid().to_numpy(zero_copy_only=False) & (np.diff(offsets) > 0)).tolist():
            mine = slice(offsets[r], offsets[r + 1])
            px, py = np.clip(x[mine], 0, width[r].as_py() - 1), np.clip(y[mine], 0, height[r].as_py() - 1)
            found = boxes[r].as_py()
            for b in [*(b for b in found if not b["excluded"]), *(b for b in found if b["excluded"])]:
                at = b["at"]
                out[mine][(px >= at["left"]) & (px < at["right"]) & (py >= at["bottom"]) & (py < at["top"])] = EXCLUDED if b["excluded"] else b["i"] + FIRST_BOX
    out[numbers(pc.fill_null(pc.equal(ch, values.BULLET), False))] = EXCLUDED
    return out


#: Makes batches of pages of batches of documents.
Reader = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]
BOXES = pa.list_(pa.struct([("i", pa.int32()), ("excluded", pa.bool_()), ("at", pa.struct([("left", pa.int32()), ("bottom", pa.int32()), ("right", pa.int32()), ("top", pa.int32())]))]))


def spots(source: DataFrame, read: Reader | None = None) -> DataFrame:
    """doc_id, pageno, and the arrays cls and seq, of pages; ``read`` makes them of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in read(batches) if read else batches:
            cls = pa.ListArray.from_arrays(pa.array(flat(batch.column("ch"))[0], pa.int32()), pa.array(classes_of(batch), pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("pageno"), cls, batch.column("seq")], names=["doc_id", "pageno", "cls", "seq"])

    return source.mapInArrow(run, "doc_id long, pageno int, cls array<int>, seq array<long>")
