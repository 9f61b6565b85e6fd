"""The translation plan: glyphs to paragraphs to translations to a new stream a page.

Pages are chosen before anything is computed for them. A page's glyphs stay in its row, and
segmentation shuffles nothing; its result is written to the shared folder, as three steps
read it. Translation shuffles by distinct text, and its answers once more by page.
"""

from __future__ import annotations

from pyspark import Accumulator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions import text as tx
from quire.operators import assemble, layout, memory, segment, typeset
from quire.plans.options import Options
from quire.sources import pdf
from quire.staging import written


def protect(lines: DataFrame, pattern: str = "[0-9]+", text: str = "text") -> DataFrame:
    """Plain paragraphs with each run of the pattern replaced by a numbered mark, and the runs.

    The stand-in for segmentation where there is text but no layout.
    """
    runs = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    marked = F.array_join(F.transform(gaps, lambda g, k: F.when(k < F.size(gaps) - 1, F.concat(g, tx.placeholder(k))).otherwise(g)), "")
    return lines.withColumn("formulas", runs).withColumn("protected", marked)


def restore(text, formulas):
    """Marks replaced by what they stand for; marks out of range stand for nothing.

    ``\\x00`` never occurs in a paragraph and parts the pieces.
    """
    parts = F.split(F.regexp_replace(text, r"(?i)\{\s*v([0-9\s]+)\}", "\u0000$1\u0000"), "\u0000", -1)

    def piece(p, k):
        number = F.regexp_replace(p, r"\s", "").try_cast("int")
        return F.when(k % 2 == 0, p).otherwise(F.coalesce(F.try_element_at(formulas, number + 1), F.lit("")))

    return F.array_join(F.transform(parts, piece), "")


def plain(documents: DataFrame, engine: memory.Engine, store: memory.Memory | None = None, ignore_cache: bool = False, pattern: str = "[0-9]+") -> DataFrame:
    """Every line of each document translated, with its runs of the pattern untouched."""
    lines = documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("para_idx", "text"))
    done = memory.translate(protect(lines, pattern), engine, store, ignore_cache, text="protected")
    return done.withColumn("result", restore(F.col("translation"), F.col("formulas")))


def summary(translated: DataFrame) -> DataFrame:
    """Per document: paragraphs, skipped ones, hits, misses, characters of the result."""
    return translated.groupBy("doc_id").agg(
        F.count("*").alias("paragraphs"),
        F.count(F.when(F.col("status") == "skipped", 1)).alias("skipped"),
        F.count(F.when(F.col("hit"), 1)).alias("hits"),
        F.count(F.when((F.col("status") != "skipped") & ~F.col("hit"), 1)).alias("misses"),
        F.sum(F.coalesce(F.length("result"), F.lit(0))).cast("long").alias("chars"),
    )


def translate_pages(
    source: DataFrame,
    boxes: DataFrame | None,
    class_names: DataFrame | None,
    engine: memory.Engine,
    options: Options,
    metrics: typeset.Metrics,
    store: memory.Memory | None = None,
    done: Accumulator | None = None,
    read: layout.Reader | None = None,
    page_width: float | str | None = None,
) -> DataFrame:
    """doc_id, pageno, container, ops: the new text of every wanted page and form.

    ``source`` has container rows as segment.segment reads them, or documents of which
    ``read`` makes such rows. Without ``boxes`` every spot is plain text; boxes that carry a
    class's ``name`` need no ``class_names``. ``done`` counts pages as they are set.
    """
    size = int(options.page_width), int(options.page_height)
    if boxes is not None:
        source = (layout.with_document_boxes if read else layout.with_boxes)(source, boxes, class_names, *size)
    # Read by the memory's lookup, by the join with its answers and by typesetting.
    parts, _ = written(segment.segment(source, page_width or options.page_width, options.rules, read, options.pages, pack=True), "segments")
    key = ["doc_id", "pageno", "container"]
    paragraphs = parts.select(*key, F.explode("paragraphs").alias("p")).select(*key, "p.para_idx", "p.text")
    texts = assemble.joined_paragraphs(memory.translate(paragraphs, engine, store, options.ignore_cache, options.threads).withColumn("translation", F.coalesce("translation", "text")))
    # Few bytes, much work: as many tasks as the session has shuffle partitions, not fewer. The
    # join takes them as they are dealt, and sorts nothing.
    tasks = int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = parts.select(*key, "packed").repartition(tasks, *key)
    return typeset.typeset(dealt.join(texts.hint("shuffle_hash"), key), metrics, options.lang_out, done)


def translate_files(files: DataFrame, boxes: DataFrame | None, class_names: DataFrame | None, engine: memory.Engine, options: Options, store: memory.Memory | None = None, wide: pdf.WideFont | None = None, done: Accumulator | None = None) -> DataFrame:
    """doc_id, mono_content, dual_content, error of every PDF file (doc_id, content).

    ``boxes``: detections, page_w and page_h beside them; without any, all text is plain.
    """
    ops = translate_pages(files.select("doc_id", "content"), boxes, class_names, engine, options, pdf.metrics(wide), store, done, pdf.read_containers, "page_w")
    return pdf.assembled(files, ops, wide)


def bilingual(originals: DataFrame, translated: DataFrame) -> DataFrame:
    """Pages of both documents in reading order (doc_id, position, side, ops)."""
    return assemble.interleaved(originals.select("doc_id", "pageno", "ops"), translated.select("doc_id", "pageno", "ops"))
