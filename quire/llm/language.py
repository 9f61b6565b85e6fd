"""Language identification: multinomial naive Bayes over hashed character n-grams.

Texts become code points in lower case, with everything but letters as a blank; every
window of 1, 2 and 3 code points that holds a letter is hashed into a bucket. Training
sums bucket counts for each language over a bounded, hash-chosen sample of labelled rows
(``train_rows`` for each language, about); the smoothed log-probabilities form a matrix of
buckets x languages, whose size is checked before it is broadcast. Scoring gathers matrix
rows for a batch of texts at a time, in numpy, over whole texts.

The score is the posterior probability of the predicted language.

Defined results: a text that is null, empty or without a letter is ``und`` with score 0;
without any labelled text every text is; ties go to the language first in code-point
order; a null doc_id is never held out and never learned from; repeated rows are rows of
their own; very long texts are taken in slices that overlap by the n-gram length; bytes
that are no UTF-8 count as the replacement character, which is no letter; extra columns
stay, those named like an output are replaced; an empty table gives an empty result.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.common import crc_mod, map_batches, pieces, table, text_buffer, unused, without

UNKNOWN = "und"
BUCKET_BITS, ORDERS, SMOOTH = 16, (1, 2, 3), 0.5
#: Rows learned from for each language, about; all where there are fewer.
TRAIN_ROWS = 3000
MAX_MODEL_MB = 256
#: Bytes of text that one step of numpy takes.
STEP = 1 << 18

_TABLES: list[tuple[np.ndarray, np.ndarray]] = []


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """For each code point: its lower case (0x20 if no letter), and whether it is a letter."""
    if not _TABLES:
        low = np.full(0x110000, 0x20, np.uint32)
        for c in range(0x110000):
            if unicodedata.category(ch := chr(c))[0] == "L":
                low[c] = ord(x) if len(x := ch.lower()) == 1 else c
        _TABLES.append((low, low != 0x20))
    return _TABLES[0]


def windows(points: np.ndarray, letter: np.ndarray, ends: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Start and bucket of every n-gram that lies in one text and holds a letter.

    ``ends``: for each position, the end of its text.
    """
    n = len(points)
    seen = np.concatenate([[0], np.cumsum(letter)])
    code = points.astype(np.uint64) + np.uint64(1)
    h = np.zeros(n, np.uint64)
    for size in range(1, max(ORDERS) + 1):
        if n < size:
            return
        m = n - size + 1
        h = h[:m] * np.uint64(0x100000001B3) + code[size - 1 :]
        if size not in ORDERS:
            continue
        at = np.flatnonzero((seen[size:] > seen[:m]) & (np.arange(size, n + 1) <= ends[:m]))
        x = (h[at] + np.uint64(size)) * np.uint64(0x9E3779B97F4A7C15)
        yield at, (x >> np.uint64(64 - bits)).astype(np.int64)


def _batches(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Row number (ascending) and bucket of every n-gram, and which rows hold a letter, step by step."""
    buf, offs = text_buffer(column)
    low, _ = _tables()
    for i, j in pieces(offs, STEP):
        part = buf[offs[i] : offs[j]]
        try:
            raw = np.frombuffer(part.tobytes().decode().encode("utf-32-le"), np.uint32)
            # Where texts end, in code points: bytes that continue a code point do not count.
            heads = np.concatenate([[0], np.cumsum((part & 0xC0) != 0x80)])
            cuts = heads[offs[i : j + 1] - offs[i]]
        except UnicodeDecodeError:  # text by text, what is no UTF-8 replaced
            texts = [buf[offs[k] : offs[k + 1]].tobytes().decode("utf-8", "replace") for k in range(i, j)]
            raw = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
            cuts = np.concatenate([[0], np.cumsum([len(x) for x in texts])])
        for begin in range(0, max(1, len(raw)), STEP):  # more than one slice for one very long text only
            stop = min(len(raw), begin + STEP)
            over = min(len(raw), stop + max(ORDERS) - 1)
            points = low[raw[begin:over]]
            letter = points != 0x20
            row = np.searchsorted(cuts, np.arange(begin, over), side="right") - 1
            ends = cuts[row + 1] - begin if len(row) else row
            has = np.zeros(j - i, bool)
            has[row[letter]] = True
            some = np.flatnonzero(has) + i
            for at, b in windows(points, letter, ends, BUCKET_BITS):
                mine = at < stop - begin
                yield i + row[at[mine]], b[mine], some


@dataclass
class Model:
    languages: list[str]
    prior: np.ndarray  # log-probability of each language
    table: np.ndarray  # buckets x languages, log-probabilities

    def scores(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Language number (-1: none) and posterior of each text."""
        n, k = len(column), len(self.languages)
        total, has = np.zeros((n, max(1, k))), np.zeros(n, bool)
        for row, bucket, some in _batches(column):
            has[some] = True
            if not k or not len(row):
                continue
            # The batch as a sparse matrix in row order, times the table.
            first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
            for x in range(k):
                total[row[first], x] += np.add.reduceat(self.table[:, x][bucket], first, dtype=np.float64)
        if not k:
            return np.full(n, -1), np.zeros(n)
        total += self.prior
        best = total.argmax(axis=1)
        sure = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
        return np.where(has, best, -1), np.where(has, sure, 0.0)


def train(labelled: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", train_rows: int = TRAIN_ROWS) -> Model:
    """Learns from rows with a text and a language; see the module for the bound."""
    spark = labelled.sparkSession
    rows = labelled.where(F.col(text).isNotNull() & F.col(lang).isNotNull())
    counts = {r[0]: r[1] for r in rows.groupBy(lang).count().collect()}  # one row for each language
    languages = sorted(counts)
    if (mb := len(languages) * (4 << BUCKET_BITS) >> 20) > MAX_MODEL_MB:
        raise ValueError(f"{len(languages)} languages make a model of {mb} MB, over the bound of {MAX_MODEL_MB}")
    if not languages:
        return Model([], np.zeros(0), np.zeros((1 << BUCKET_BITS, 0), np.float32))
    share = F.create_map(*[x for v in languages for x in (F.lit(v), F.lit(min(1.0, train_rows / counts[v])))])
    draw = F.pmod(F.xxhash64(doc_id, F.lit("learn")), F.lit(1 << 30)) / float(1 << 30)
    sample = rows.where(draw < share[F.col(lang)]).select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    number = {v: k for k, v in enumerate(languages)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(number), 1 << BUCKET_BITS), np.int64)
        for batch in batches:
            mine = np.array([number[x] for x in batch.column(0).to_pylist()], np.int64)
            for row, bucket, _ in _batches(batch.column(1)):
                np.add.at(sums.reshape(-1), (mine[row] << BUCKET_BITS) + bucket, 1)
        which, bucket = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(which), pa.array(bucket), pa.array(sums[which, bucket])], names=["which", "bucket", "n"])

    few = sample.repartition(max(1, min(64, -(-min(sum(counts.values()), len(languages) * train_rows) // 2000))))
    found = map_batches(few, count, "which long, bucket long, n long").groupBy("which", "bucket").agg(F.sum("n").alias("n")).toArrow()  # at most languages x buckets rows
    sums = np.full((1 << BUCKET_BITS, len(languages)), SMOOTH)
    sums[found["bucket"].to_numpy(), found["which"].to_numpy()] += found["n"].to_numpy()
    prior = np.log(np.array([counts[v] for v in languages], np.float64) / sum(counts.values()))
    return Model(languages, prior, np.log(sums / sums.sum(axis=0)).astype(np.float32))


def identify(rows: DataFrame, model: Model, text: str = "text", names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """rows with the predicted language and the score."""
    rows = without(rows, *names)
    at = rows.columns.index(text)
    held = rows.sparkSession.sparkContext.broadcast(model)
    shape = T.StructType([*rows.schema.fields, T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        languages = [*m.languages, UNKNOWN]
        for batch in batches:
            best, sure = m.scores(batch.column(at))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([languages[x] for x in best], pa.string()), pa.array(sure, pa.float64())], names=[f.name for f in shape.fields])

    return map_batches(rows, score, shape)


def keep_identified(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """docs in a language that the model knows, with a score of at least ``least``.

    The declared language is learned from and not compared with: clean documents stay.
    """
    held = docs.columns
    names = tuple(unused(docs, "lang_pred", "score"))
    return identify(docs, train(docs), names=names).where((F.col(names[0]) != UNKNOWN) & (F.col(names[1]) >= least)).select(*held)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = F.coalesce(crc_mod("doc_id", 3) == 1, F.lit(False))
    model = train(docs.where(F.coalesce(crc_mod("doc_id", 3) != 1, F.lit(False))))
    digest = identify(docs.select("doc_id", out.alias("held_out"), "text"), model)
    return digest.select("doc_id", "held_out", "lang_pred", "score")
