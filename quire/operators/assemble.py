"""Assembly: patches to objects, and the interleaved bilingual order of pages."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.operators.layout import Reader, flat


def last_patches(patches: DataFrame) -> DataFrame:
    """One patch for each object: the last written, as a form that pages share is written often."""
    return patches.groupBy("doc_id", "obj_id").agg(F.max_by("ops", "seq").alias("ops"))


def apply_patches(objects: DataFrame, patches: DataFrame) -> DataFrame:
    """Objects with their new stream where there is one, else the old."""
    new = last_patches(patches).withColumnRenamed("ops", "new")
    return objects.join(new, ["doc_id", "obj_id"], "left").withColumn("ops", F.coalesce("new", "ops")).withColumn("patched", F.col("new").isNotNull()).drop("new")


def blanked(contents: DataFrame) -> DataFrame:
    """Empty patches for a page's old content objects (doc_id, obj_id, seq)."""
    return contents.select("doc_id", "obj_id", F.lit("").alias("ops"), "seq")


def interleaved(originals: DataFrame, translated: DataFrame) -> DataFrame:
    """Pages of the bilingual document: original i at 2 i, translated i at 2 i + 1."""
    a = originals.withColumn("side", F.lit("original")).withColumn("position", 2 * F.col("pageno"))
    b = translated.withColumn("side", F.lit("translated")).withColumn("position", 2 * F.col("pageno") + 1)
    return a.unionByName(b)


def charset(glyphs: DataFrame, key: tuple[str, ...] = ("doc_id", "font")) -> DataFrame:
    """The distinct characters that a subset of each font must hold.

    Glyphs shrink to different characters before they are shuffled.
    """
    return glyphs.select(*key, "ch").distinct().groupBy(*key).agg(F.count("*").alias("chars"), F.array_join(F.array_sort(F.collect_list("ch")), "").alias("charset"))


def charset_of_pages(source: DataFrame, read: Reader | None = None) -> DataFrame:
    """The same for pages that hold their glyphs as arrays: a batch gives its different pairs.

    ``read`` makes pages of documents.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in read(batches) if read else batches:
            offsets, ch = flat(batch.column("ch"))
            doc = batch.column("doc_id").take(pa.array(np.repeat(np.arange(batch.num_rows), np.diff(offsets))))
            seen = pa.table({"doc_id": doc, "font": flat(batch.column("font"))[1], "ch": ch}).group_by(["doc_id", "font", "ch"]).aggregate([])
            yield from seen.filter(seen["ch"].is_valid()).combine_chunks().to_batches()

    return charset(source.mapInArrow(run, "doc_id long, font string, ch string"))


def fonts_of_pages(pages: DataFrame, fonts: tuple[str, str]) -> DataFrame:
    """Every page once for each of the two fonts that it embeds."""
    return pages.withColumn("font", F.explode(F.array(*[F.lit(f) for f in fonts])))


def document_pages(pages: DataFrame) -> DataFrame:
    """Pages of each document, in order, as one array."""
    return pages.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("position", "ops"))).alias("pages"))


def joined_paragraphs(paragraphs: DataFrame, text: str = "translation") -> DataFrame:
    """One row a container again: texts in paragraph order."""
    ordered = F.array_sort(F.collect_list(F.struct("para_idx", F.col(text).alias("t"))))
    return paragraphs.groupBy("doc_id", "pageno", "container").agg(F.transform(ordered, lambda x: x["t"]).alias("texts"))


def progress(done: DataFrame) -> DataFrame:
    """Pages done so far of each document, in order."""
    order = Window.partitionBy("doc_id").orderBy("pageno").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return done.withColumn("n", F.count("*").over(order))
