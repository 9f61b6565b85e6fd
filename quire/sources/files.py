"""Document files: scans, checks, names, downloads, results."""

from __future__ import annotations

import re
import urllib.request
import uuid
from collections.abc import Iterable, Iterator
from pathlib import Path

import pandas as pd
import pyarrow.fs as fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import text as tx

DOCUMENT = "doc_id long, path string, content binary"


def scan(spark: SparkSession, *paths: str) -> DataFrame:
    """path, length, content of the given files; one row a file, read where it is used."""
    return spark.read.format("binaryFile").load(list(paths)).select("path", "length", "content")


def scan_folder(spark: SparkSession, *folders: str) -> DataFrame:
    """All .pdf files below the folders, the suffix in any case. A file as folder is an error."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for folder in folders:
        p = jvm.org.apache.hadoop.fs.Path(folder)
        if not p.getFileSystem(conf).getFileStatus(p).isDirectory():
            raise NotADirectoryError(folder)
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[pP][dD][fF]").load(list(folders)).select("path", "length", "content")


def from_bytes(spark: SparkSession, contents: Iterable[bytes]) -> DataFrame:
    return spark.createDataFrame([(k, None, bytearray(c)) for k, c in enumerate(contents)], DOCUMENT)


def remote(path: Column) -> Column:
    return path.rlike("^https?://")


def missing(wanted: DataFrame, present: DataFrame, path: str = "path") -> DataFrame:
    """Wanted local paths that are not present; addresses are not checked."""
    return wanted.where(~remote(F.col(path))).join(present.select(path).distinct(), path, "left_anti")


def check(paths: list[str]) -> list[str]:
    """Given local paths that do not exist; no path at all is an error."""
    if not paths:
        raise ValueError("no files to translate")
    return [p for p in paths if not re.match(r"https?://", p) and not Path(p).exists()]


def download_name(address: Column, disposition: Column) -> Column:
    """File name of a download: as the answer says, else the address's last part; always .pdf."""
    said = F.regexp_extract(disposition, r"filename=\"?([^\";]+)\"?", 1)
    plain = F.element_at(F.split(F.regexp_replace(address, r"[?#].*$", ""), "/"), -1)
    name = F.when(F.coalesce(said, F.lit("")) != "", said).otherwise(plain)
    return F.concat(F.regexp_replace(name, r"(?<=.)\.[^.]*$", ""), F.lit(".pdf"))


class TooLarge(Exception):
    pass


def read_limited(stream, limit: int | None, chunk: int = 1024) -> bytes:
    """All of a stream, or an error as soon as it passes the limit."""
    out = bytearray()
    while part := stream.read(chunk):
        out += part
        if limit is not None and len(out) > limit:
            raise TooLarge(f"more than {limit} bytes")
    return bytes(out)


def fetch(addresses: DataFrame, limit: int | None = None, column: str = "path", timeout: float = 60) -> DataFrame:
    """path, content, error of each address; a failure is the row's, not the job's."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for address in batch[column]:
                try:
                    with urllib.request.urlopen(address, timeout=timeout) as answer:  # follows redirects; other states raise
                        out.append((address, read_limited(answer, limit), None))
                except Exception as failure:  # noqa: BLE001  kept as the row's error
                    out.append((address, None, f"{type(failure).__name__}: {failure}"))
            yield pd.DataFrame(out, columns=["path", "content", "error"])

    return addresses.select(column).mapInPandas(run, "path string, content binary, error string")


def with_output_names(files: DataFrame, folder: str | None = None, path: str = "path") -> DataFrame:
    """files with mono and dual: in a folder, or beside each input."""
    names = tx.output_names(F.col(path), F.lit(folder) if folder is not None else None)
    return files.withColumn("mono", names["mono"]).withColumn("dual", names["dual"])


def pick(results: DataFrame, kind: Column) -> DataFrame:
    """The translated document for "mono", the bilingual one for anything else."""
    return results.withColumn("content", F.when(kind == "mono", F.col("mono")).otherwise(F.col("dual")))


def _place(name: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a name: by its scheme, local without one."""
    if re.match(r"[A-Za-z][A-Za-z0-9+.-]+:/", name):
        return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", name))
    return fs.LocalFileSystem(), str(Path(name).absolute())


def write(results: DataFrame, folder: str | None) -> DataFrame:
    """Writes mono_content and dual_content of each row under its names; a row a file written.

    Names with a scheme go to that file system. Each file is written beside its name and
    moved into place, so that a task that runs twice leaves whole files. Executors must
    share the folder.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples():
                for name, content in ((r.mono, r.mono_content), (r.dual, r.dual_content)):
                    where, target = _place(name)
                    where.create_dir(target.rpartition("/")[0], recursive=True)
                    part = f"{target}.{uuid.uuid4().hex}.part"
                    with where.open_output_stream(part) as stream:
                        stream.write(content)
                    where.move(part, target)
                    out.append((target if isinstance(where, fs.LocalFileSystem) else name, len(content)))
            yield pd.DataFrame(out, columns=["path", "length"])

    return with_output_names(results, folder).select("mono", "mono_content", "dual", "dual_content").mapInPandas(run, "path string, length long")
