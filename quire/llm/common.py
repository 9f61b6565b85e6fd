"""Helpers that the corpus operators share: tables, the shared folder, byte buffers."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Word of the contracts: a run of bytes that are neither space nor tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_SCRATCH: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir where it is set.

    Where it is unset, a temporary folder is made and kept for the session on a local
    master only; on a cluster no executor would see it, so that is an error.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="quire-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder; what lies there goes when the driver ends."""
    path = f"{shared_dir(spark)}/quire/{name}-{uuid.uuid4().hex}"
    _SCRATCH.append((spark, path))
    return path


def delete(spark: SparkSession, path: str) -> None:
    """Removes a path of the shared folder by Hadoop's file system, wherever it lies."""
    jvm = spark.sparkContext._jvm
    if jvm is not None:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def forget(spark: SparkSession, path: str) -> None:
    """Deletes a written table that no result reads any more."""
    delete(spark, path)
    _SCRATCH[:] = [x for x in _SCRATCH if x[1] != path]


@atexit.register
def _sweep() -> None:
    for spark, path in _SCRATCH:
        try:
            delete(spark, path)
        except Exception:  # noqa: BLE001  the session may be gone
            return


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Cuts the lineage: writes df to the shared folder as Parquet and reads it again."""
    spark = df.sparkSession
    path = new_path(spark, name)
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path), path


#: Rows of an Arrow batch at most, as whole texts travel in them.
BATCH_ROWS = 512
_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def map_batches(df: DataFrame, function, schema) -> DataFrame:
    """mapInArrow in batches of a bounded number of rows.

    The bound is a setting of the session that is read when a plan runs, so it stays set; a
    lower one that the session has is kept.
    """
    spark = df.sparkSession
    if not 0 < int(spark.conf.get(_ROWS)) <= BATCH_ROWS:
        spark.conf.set(_ROWS, str(BATCH_ROWS))
    return df.mapInArrow(function, schema)


def without(df: DataFrame, *names: str) -> DataFrame:
    """df without columns that an operator is about to add (any letter case)."""
    low = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in low])


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as keep it apart from df's columns."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("") if column.null_count else column
    wide = pa.types.is_large_string(column.type)
    _, offs, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    o = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[o[0] : o[-1]], o - o[0]


def pieces(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Row ranges of at most so many bytes each, or of one longer row."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1
        j = min(n, max(j, i + 1))
        yield i, j
        i = j


def crc_mod(doc_id: str, by: int):
    """crc32 of doc_id as text, modulo by; null for a null doc_id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % by


SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def word_bounds(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word in the buffer, and the row of each word."""
    inside = np.zeros(len(buf) + 2, bool)
    inside[1:-1] = ~SPACE[buf]
    first = inside[1:-1] & ~inside[:-2]
    last = inside[1:-1] & ~inside[2:]
    cut = offs[1:-1]
    cut = cut[(cut > 0) & (cut < len(buf))]  # a row ends here: words do not run on
    first[cut] = inside[1:-1][cut]
    last[cut - 1] = inside[1:-1][cut - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(offs, start, side="right") - 1


_POWERS: list[tuple[np.ndarray, np.ndarray]] = []
_ODD = 0x9E3779B97F4A7C15
_BYTES = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number modulo 2**64 and of its inverse; up to 4 M of them are kept."""
    if _POWERS and len(_POWERS[0][0]) >= n:
        return _POWERS[0]
    size = 1 << max(16, (n - 1).bit_length())
    up, down = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, x % 2**64, np.uint64)])) for x in (_ODD, pow(_ODD, -1, 2**64)))
    if size <= 1 << 22:
        _POWERS[:] = [(up, down)]
    return up, down


def mixed(x: np.ndarray) -> np.ndarray:
    """A well-mixed 64-bit function, one to one (finalizer of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of buf[start:end] for every word, by prefix sums of a polynomial."""
    up, down = _powers(len(buf) + 1)
    sums = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_BYTES[buf] * up[: len(buf)], out=sums[1:])
    return mixed((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))
