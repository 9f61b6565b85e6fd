"""Command line: PDF files, folders or addresses, or text documents in Parquet, to translated ones."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Callable, Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import values
from quire.operators import engines, layout, memory
from quire.operators.segment import Rules
from quire.plans import pipeline
from quire.plans.options import Options
from quire.sources import files, pdf
from quire.sources.settings import Config, read_prompt
from quire.staging import written


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quire", description="Translate documents on Spark.")
    p.add_argument("files", nargs="*", help="PDF files or addresses, Parquet files with doc_id and text, or, with --dir, folders of PDF files")
    p.add_argument("--lang-in", "-li", default="en")
    p.add_argument("--lang-out", "-lo", default="zh")
    p.add_argument("--service", "-s", default="google", help="name, or name:model")
    p.add_argument("--pages", "-p", help="page ranges such as 1-3,5")
    p.add_argument("--vfont", "-f", default="", help="pattern of formula fonts")
    p.add_argument("--vchar", "-c", default="", help="pattern of formula characters")
    p.add_argument("--output", "-o", default="")
    p.add_argument("--thread", "-t", type=int, default=4)
    p.add_argument("--prompt", help="file with a prompt template")
    p.add_argument("--config", help="JSON file of settings")
    p.add_argument("--cache", help="folder of the translation memory")
    p.add_argument("--ignore-cache", action="store_true")
    p.add_argument("--font", help="TrueType file for characters that the base font lacks")
    p.add_argument("--fonts", help="folder of font files, from which the target language picks one")
    p.add_argument("--skip-subset-fonts", action="store_true", help="embed whole font files")
    p.add_argument("--boxes", help="Parquet of detections: path, pageno, det_idx, x0, y0, x1, y1, conf, name, page_w, page_h")
    p.add_argument("--onnx", help="ONNX file of a layout detector; needs --images")
    p.add_argument("--images", help="Parquet of page images for --onnx: path, pageno, image (RGB bytes), h, w, at a pixel a point")
    p.add_argument("--serverport", type=int, help="serve jobs over HTTP at this port instead")
    p.add_argument("--dir", action="store_true", help="the arguments are folders")
    p.add_argument("--debug", "-d", action="store_true")
    return p


def page_numbers(spec: str | None) -> list[int] | None:
    """The same rule as pages.parse_ranges, for one text on the driver."""
    if not spec:
        return None
    out: list[int] = []
    for part in spec.split(","):
        lo, dash, hi = part.partition("-")
        out += range(int(lo) - 1, int(hi)) if dash else [int(lo) - 1]
    return out


def _pdfs(spark: SparkSession, paths: Sequence[str], folders: bool) -> DataFrame:
    """doc_id, path, content, error of files, folders or addresses."""
    if folders:
        found = files.scan_folder(spark, *paths)
    else:
        local, far = ([p for p in paths if p.startswith(("http://", "https://")) is x] for x in (False, True))
        found = files.scan(spark, *local) if local else spark.createDataFrame([], "path string, content binary")
        if far:
            fetched = files.fetch(spark.createDataFrame([(p,) for p in far], "path string"))
            found = found.select("path", "content").unionByName(fetched.select("path", "content"))
    return found.select(F.xxhash64("path").alias("doc_id"), "path", "content")


def wide_font(lang_out: str, folder: str | None, subset: bool = True) -> pdf.WideFont | None:
    """The font file of a target language, if the folder has it."""
    if not folder:
        return None
    path = Path(folder) / values.font_file(lang_out)
    return pdf.WideFont(path.read_bytes(), path.stem, subset) if path.exists() else None


def detections(spark: SparkSession, boxes: str | None, onnx: str | None, images: str | None, conf: str = "path") -> DataFrame | None:
    """Detections of files by the hash of their path, from a table or by a detector."""
    key = F.xxhash64(conf).alias("doc_id")
    if boxes:
        return spark.read.parquet(boxes).select(key, "*").drop("path")
    if not onnx:
        return None
    if not images:
        raise ValueError("a detector needs images of the pages")
    model = layout.OnnxModel(onnx)
    pictures = spark.read.parquet(images).select(key, F.col("pageno").cast("int").alias("pageno"), "image", "h", "w")
    names = spark.createDataFrame(list(model.names.items()), "cls int, name string")
    sizes = pictures.select("doc_id", "pageno", F.col("w").cast("double").alias("page_w"), F.col("h").cast("double").alias("page_h"))
    found = layout.detect(pictures, model)
    return found.join(F.broadcast(names), "cls").join(sizes, ["doc_id", "pageno"])  # a row for each class of the model


def main(arguments: Sequence[str] | None = None, engine: Callable[..., memory.Engine] = engines.engine) -> int:
    from quire.session import local_session

    args = parser().parse_args(arguments)
    config = Config(args.config) if args.config else None
    if args.serverport:
        from quire.plans.service import server

        spark = local_session("*")
        server(spark, ("127.0.0.1", args.serverport), engine, memory.Memory(spark, args.cache) if args.cache else None, fonts=args.fonts).serve_forever()
        return 0
    template = read_prompt(args.prompt) if args.prompt else None
    if gone := files.check(args.files):
        raise FileNotFoundError(", ".join(gone))
    spark = local_session("*")
    name = args.service.partition(":")[0]
    chosen = engine(args.service, args.lang_in, args.lang_out, config.translator(name) if config else None, None, template)
    store = memory.Memory(spark, args.cache) if args.cache else None
    if args.dir or all(p.lower().endswith(".pdf") or p.startswith(("http://", "https://")) for p in args.files):
        wanted = page_numbers(args.pages)
        options = Options(args.lang_in, args.lang_out, args.service, tuple(wanted) if wanted else None, args.thread, args.ignore_cache, template, Rules(args.vfont or None, args.vchar or None))
        wide = pdf.WideFont(Path(args.font).read_bytes(), subset=not args.skip_subset_fonts) if args.font else wide_font(args.lang_out, args.fonts, not args.skip_subset_fonts)
        found = _pdfs(spark, args.files, args.dir)
        boxes = detections(spark, args.boxes, args.onnx, args.images)
        done = pipeline.translate_files(found, boxes, None, chosen, options, store, wide).join(found.select("doc_id", "path"), "doc_id")
        done, _ = written(done, "translated")  # a file is written from the same translation that its state reports
        for row in files.write(done.where("error is null"), args.output or None).toLocalIterator():
            print(row.path)
        failed = [(r.path, r.error) for r in done.where("error is not null").select("path", "error").toLocalIterator()]
        for path, error in failed:
            print(path, error, sep="\t", file=sys.stderr)
        return int(bool(failed))
    done = pipeline.plain(spark.read.parquet(*args.files), chosen, store, args.ignore_cache, args.vchar or "[0-9]+")
    done.select("doc_id", "para_idx", "text", "result", "status", "hit").write.mode("overwrite").parquet(args.output or "translated.parquet")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
