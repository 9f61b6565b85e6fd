"""Glyphs, boxes and drawing operators derived from plain tables by whole numbers.

Stand-ins for parsed documents: every value follows from a text's code points, or from
keys, by integer arithmetic, so that any engine rebuilds the same tables.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import layout

COLUMNS, ROWS, ADVANCE, LEADING = 80, 50, 6, 12
PAGE_WIDTH, PAGE_HEIGHT = COLUMNS * ADVANCE, 792
#: Classes of the derived detections.
CLASS_NAMES = {0: "title", 1: "plain text", 2: "abandon", 3: "figure", 4: "figure_caption", 5: "table", 6: "isolate_formula", 7: "formula_caption"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("para_idx", "text"))


def glyphs(documents: DataFrame) -> DataFrame:
    """A glyph for each code point but the line ends: 80 to a row, 50 lines to a page."""
    chars = lines(documents).select("doc_id", F.col("para_idx").alias("line"), F.posexplode(F.filter(F.split("text", ""), lambda c: c != "")).alias("col", "ch"))
    at = ADVANCE * (F.col("col") % COLUMNS)
    base = PAGE_HEIGHT - LEADING * (F.col("line") % ROWS) - LEADING
    return chars.select(
        "doc_id",
        F.floor(F.col("line") / ROWS).cast("int").alias("pageno"),
        F.lit("page").alias("container"),
        (F.col("line").cast("long") * 1_000_000 + F.col("col")).alias("seq"),
        "ch",
        F.lit(0).alias("cid"),
        F.when((F.col("line") + F.floor(F.col("col") / 10)) % 7 == 6, "ABCDEF+CMMI10").otherwise("Times").alias("font"),
        F.when(F.col("col") % 37 == 36, 7.0).otherwise(10.0).alias("size"),
        at.cast("double").alias("x0"),
        (at + ADVANCE - 1).cast("double").alias("x1"),
        base.cast("double").alias("y0"),
        (base + 10).cast("double").alias("y1"),
        F.lit(1.0).alias("a"),
        F.lit(1.0).alias("d"),
        F.lit(0.0).alias("linewidth"),
    )


#: Pages of a batch that ``read_pages`` makes.
PAGES_A_BATCH = 64


def _glyphs(pages_: list[list[str]], firsts: list[int]) -> tuple[np.ndarray, dict[str, pa.Array]]:
    """Where each page's glyphs end, and the glyphs of all pages, one after the other."""
    lengths = np.array([len(x) for p in pages_ for x in p], np.int64)
    of = np.repeat(np.arange(len(pages_)), [len(p) for p in pages_])
    number = np.concatenate([first + np.arange(len(p)) for p, first in zip(pages_, firsts, strict=True)])
    line = np.repeat(number, lengths)
    col = np.arange(len(line)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    at = (ADVANCE * (col % COLUMNS)).astype(np.float64)
    base = (PAGE_HEIGHT - LEADING * (line % ROWS) - LEADING).astype(np.float64)
    one, none = np.ones(len(line)), np.zeros(len(line))
    raw = np.frombuffer("".join(x for p in pages_ for x in p).encode(), np.uint8)
    heads = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw)).astype(np.int32)
    fonts = pa.array(["Times", "ABCDEF+CMMI10"])
    flat = {
        "seq": line * 1_000_000 + col, "cls": (((line * 1_000_000 + col) // 97) % 3).astype(np.int32), "ch": pa.StringArray.from_buffers(len(line), pa.py_buffer(heads), pa.py_buffer(raw)), "cid": none.astype(np.int32),
        "font": fonts.take(pa.array(((line + col // 10) % 7 == 6).astype(np.int32))), "size": np.where(col % 37 == 36, 7.0, 10.0),
        "x0": at, "x1": at + ADVANCE - 1, "y0": base, "y1": base + 10, "a": one, "d": one, "linewidth": none,
    }
    ends = np.concatenate([[0], np.cumsum(np.bincount(of, lengths, minlength=len(pages_)).astype(np.int64))])
    return ends, {c: v if isinstance(v, pa.Array) else pa.array(v) for c, v in flat.items()}


def read_pages(batches: Iterator[pa.RecordBatch], classes: bool = False) -> Iterator[pa.RecordBatch]:
    """The same glyphs as one row a page that holds them as arrays, made of documents.

    Documents may have what ``layout.with_document_boxes`` adds. With ``classes`` the rows
    have classes by number. Pages without glyphs are left out.
    """

    def made(rows: list[tuple]) -> pa.RecordBatch:
        n = len(rows)
        ends, flat = _glyphs([r[3] for r in rows], [r[1] * ROWS for r in rows])
        key = {"doc_id": pa.array([r[0] for r in rows], pa.int64()), "pageno": pa.array([r[1] for r in rows], pa.int32()), "container": pa.array(["page"] * n)}
        spots = {"boxes": pa.array([r[2] for r in rows], layout.BOXES), "box_w": pa.array([PAGE_WIDTH] * n, pa.int32()), "box_h": pa.array([PAGE_HEIGHT] * n, pa.int32())}
        return pa.RecordBatch.from_pydict(key | spots | {c: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), v) for c, v in flat.items() if classes or c != "cls"})

    rows: list[tuple] = []
    for batch in batches:
        found = batch.column("boxes") if "boxes" in batch.schema.names else [None] * batch.num_rows
        for doc, text, boxes in zip(batch.column("doc_id").to_pylist(), batch.column("text"), found, strict=True):
            lines = text.as_py().split("\n") if text.is_valid else []
            by_page = layout.boxes_by_page(boxes.as_py() if boxes is not None else None)
            for first in range(0, len(lines), ROWS):
                if any(lines[first : first + ROWS]):
                    rows.append((doc, first // ROWS, by_page.get(first // ROWS), lines[first : first + ROWS]))
                    if len(rows) == PAGES_A_BATCH:
                        yield made(rows)
                        rows = []
    if rows:
        yield made(rows)


def read_classed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return read_pages(batches, True)


def spread(documents: DataFrame) -> DataFrame:
    """Documents in as many tasks as the session has shuffle partitions: a text makes many glyphs."""
    tasks = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return documents.select("doc_id", "text").repartition(tasks, "doc_id")


GLYPHS = f"""l AS (SELECT doc_id, CAST(unnest(range(len(x))) AS INTEGER) AS line, unnest(x) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents)),
c AS (SELECT doc_id, line, CAST(unnest(range(length(text))) AS INTEGER) AS col, unnest(list_transform(range(length(text)), lambda k: substr(text, CAST(k + 1 AS BIGINT), 1))) AS ch FROM l),
glyphs AS (SELECT doc_id, CAST(line // {ROWS} AS INTEGER) AS pageno, CAST(line AS BIGINT) * 1000000 + col AS seq, ch,
  CASE WHEN (line + col // 10) % 7 = 6 THEN 'ABCDEF+CMMI10' ELSE 'Times' END AS font, CASE WHEN col % 37 = 36 THEN 7.0::DOUBLE ELSE 10.0::DOUBLE END AS size,
  CAST({ADVANCE} * (col % {COLUMNS}) AS DOUBLE) AS x0, CAST({ADVANCE} * (col % {COLUMNS}) + {ADVANCE - 1} AS DOUBLE) AS x1,
  CAST({PAGE_HEIGHT} - {LEADING} * (line % {ROWS}) - {LEADING} AS DOUBLE) AS y0, CAST({PAGE_HEIGHT} - {LEADING} * (line % {ROWS}) - {LEADING} + 10 AS DOUBLE) AS y1 FROM c)"""


def page_keys(documents: DataFrame) -> DataFrame:
    pages = F.sequence(F.lit(0), F.floor((F.size(F.split("text", "\n")) - 1) / ROWS).cast("int"))
    return documents.where("text is not null").select("doc_id", F.explode(pages).alias("pageno"))


PAGES = f"""pages_ AS (SELECT doc_id, CAST(unnest(range((len(string_split(text, chr(10))) - 1) // {ROWS} + 1)) AS INTEGER) AS pageno FROM documents WHERE text IS NOT NULL)"""


def boxes(documents: DataFrame) -> DataFrame:
    """Six detections a page, placed and scored by arithmetic on its key."""
    k = F.col("doc_id") * 31 + F.col("pageno") * 17 + F.col("det_idx") * 101
    return page_keys(documents).withColumn("det_idx", F.explode(F.sequence(F.lit(0), F.lit(5)))).select(
        "doc_id", "pageno", "det_idx",
        (k % 300).cast("double").alias("x0"), (k * 7 % 500).cast("double").alias("y0"),
        (k % 300 + 40 + k % 141).cast("double").alias("x1"), (k * 7 % 500 + 30 + k % 251).cast("double").alias("y1"),
        ((k * 13 % 100) / 100).cast("double").alias("conf"), (k % 8).cast("int").alias("cls"),
    )


BOXES = PAGES + """,
k_ AS (SELECT doc_id, pageno, d.det_idx, doc_id * 31 + pageno * 17 + d.det_idx * 101 AS k FROM pages_, (SELECT CAST(unnest(range(6)) AS INTEGER) AS det_idx) d),
boxes AS (SELECT doc_id, pageno, det_idx, CAST(k % 300 AS DOUBLE) AS x0, CAST(k * 7 % 500 AS DOUBLE) AS y0, CAST(k % 300 + 40 + k % 141 AS DOUBLE) AS x1,
  CAST(k * 7 % 500 + 30 + k % 251 AS DOUBLE) AS y1, CAST(k * 13 % 100 AS DOUBLE) / 100 AS conf, CAST(k % 8 AS INTEGER) AS cls FROM k_)"""


def class_names(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(CLASS_NAMES.items()), "cls int, name string")


def sequence():
    """An order of an object's operators: line numbers repeat, so keys decide among them."""
    return F.col("l_linenumber").cast("long") * 10**12 + F.col("l_partkey") * 10**6 + F.col("l_suppkey")


SEQUENCE = "CAST(l_linenumber AS BIGINT) * 1000000000000 + l_partkey * 1000000 + l_suppkey"


def ops(lineitem: DataFrame) -> DataFrame:
    """Drawing operators of objects, one object an order."""
    words = ["q", "Q", "re", "Tj", "cm", "S", "BT", "EMC", "Do", "BDC", "zz", "l", "m", "TJ", "w", "'"]
    k = F.col("l_orderkey") * 5 + F.col("l_linenumber") * 3
    op = F.element_at(F.array(*[F.lit(w) for w in words]), (k % len(words) + 1).cast("int"))
    return lineitem.select(
        (F.col("l_orderkey") % 97).alias("doc_id"), F.col("l_orderkey").alias("obj_id"), sequence().alias("seq"), op.alias("op"),
        F.array(F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")).alias("args"), F.lit(2).alias("nargs"), (F.col("l_linenumber") % 5 == 0).alias("stroke"),
    )


OPS = f"""ops AS (SELECT l_orderkey % 97 AS doc_id, l_orderkey AS obj_id, {SEQUENCE} AS seq,
  ['q', 'Q', 're', 'Tj', 'cm', 'S', 'BT', 'EMC', 'Do', 'BDC', 'zz', 'l', 'm', 'TJ', 'w', ''''][CAST((l_orderkey * 5 + l_linenumber * 3) % 16 + 1 AS BIGINT)] AS op,
  CAST(l_partkey AS VARCHAR) || ' ' || CAST(l_suppkey AS VARCHAR) AS said, l_linenumber % 5 = 0 AS stroke FROM lineitem)"""
