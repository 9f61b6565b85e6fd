"""Quality by a sparse rule ensemble over text statistics.

Statistics of whole texts (shares of kinds of characters, word and line shapes,
repetition) are taken in numpy. On a bounded, hash-chosen sample of labelled rows
(``train_rows``), small boosted trees are grown; every path from a root to a node is a
rule, a conjunction of comparisons; a logistic regression with a lasso penalty keeps few
rules and weighs them. The kept rules become one Spark column expression, so scoring
leaves Python after the statistics.

Defined results: a text without words (null, empty, blank) scores 0; without labelled rows
every other text scores 0.5, and with labels of one kind their smoothed rate; labels other
than 0 and 1 and null labels are not learned from; a null doc_id is never held out and
never learned from; repeated rows are rows of their own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm import common
from quire.llm.common import LOWER, crc_mod, map_batches, pieces, table, text_buffer, unused, without

#: Labelled rows learned from, at most.
TRAIN_ROWS = 20_000
TREES, DEPTH, RATE, LEAST_ROWS = 40, 3, 0.3, 15
LASSO, ROUNDS = 0.002, 1500
CUT = 0.7
STEP = 1 << 19

_NAMES = ("upper", "digit", "stop", "mark", "symbol", "other", "blank", "high")
_KIND = np.full(256, 5, np.int64)
_KIND[[32, *range(9, 14)]] = 6
_KIND[128:] = 7
_KIND[97:123] = 8
_KIND[65:91] = 0
_KIND[48:58] = 1
_KIND[[ord(c) for c in ".?"]] = 2
_KIND[[ord(c) for c in ",;:!'\"()-"]] = 3
_KIND[[ord(c) for c in "|#$%&*=<>{}[]\\/@^~_+`"]] = 4

FEATURES = (
    *(f"share_{n}" for n in _NAMES), "exclaim", "bar", "log_words", "word_length", "long_words", "short_words", "capital_words", "marked_words",
    "repeat_next", "distinct_words", "top_word", "log_lines", "line_words", "distinct_lines", "words_a_stop",
)


def _by_row(values: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(rows, values, minlength=n).astype(np.float64)


def statistics(column: pa.Array) -> np.ndarray:
    """One row of FEATURES a text; texts without words are all zero."""
    buf, offs = text_buffer(column)
    out = np.zeros((len(offs) - 1, len(FEATURES)))
    for i, j in pieces(offs, STEP):
        part, o = buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        n = j - i
        row = np.repeat(np.arange(n), np.diff(o))
        size = np.maximum(np.diff(o), 1).astype(np.float64)
        kinds = np.bincount(row * 9 + _KIND[part], minlength=9 * n).reshape(n, 9)
        f = {f"share_{x}": kinds[:, k] / size for k, x in enumerate(_NAMES)}
        f["exclaim"] = _by_row(part == 33, row, n) / size
        f["bar"] = _by_row(part == 124, row, n) / size
        start, end, wrow = common.word_bounds(part, o)
        length = end - start
        count = np.bincount(wrow, minlength=n).astype(np.float64)
        words = np.maximum(count, 1)
        f["log_words"] = np.log1p(count)
        f["word_length"] = _by_row(length, wrow, n) / words
        f["long_words"] = _by_row(length > 14, wrow, n) / words
        f["short_words"] = _by_row(length <= 3, wrow, n) / words
        f["capital_words"] = _by_row((part[start] >= 65) & (part[start] <= 90), wrow, n) / words if len(start) else np.zeros(n)
        f["marked_words"] = _by_row((_KIND[part[end - 1]] >= 2) & (_KIND[part[end - 1]] <= 5), wrow, n) / words if len(start) else np.zeros(n)
        hashes = common.word_hashes(LOWER[part], start, end)
        same = (hashes[1:] == hashes[:-1]) & (wrow[1:] == wrow[:-1]) if len(hashes) else np.zeros(0, bool)
        f["repeat_next"] = _by_row(same, wrow[1:], n) / words
        f["distinct_words"], f["top_word"] = _variety(hashes, wrow, n, words)
        newline = np.flatnonzero(part == 10)
        ends = np.unique(np.concatenate([newline, o[1:]]))
        begins = np.unique(np.concatenate([newline + 1, o[:-1]]))
        begins = begins[begins < len(part)]
        stops = ends[np.searchsorted(ends, begins)] if len(begins) else begins
        lrow = np.searchsorted(o, begins, side="right") - 1
        full = stops > begins
        begins, stops, lrow = begins[full], stops[full], lrow[full]
        lines = np.maximum(np.bincount(lrow, minlength=n), 1).astype(np.float64)
        f["log_lines"] = np.log(lines)
        f["line_words"] = words / lines
        f["distinct_lines"], _ = _variety(common.word_hashes(part, begins, stops), lrow, n, lines)
        f["words_a_stop"] = words / np.maximum(kinds[:, 2], 1)
        block = np.stack([f[x] for x in FEATURES], axis=1)
        block[count == 0] = 0
        out[i:j] = block
    return out


def _variety(hashes: np.ndarray, rows: np.ndarray, n: int, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values as a share of all, and the share of the most frequent one."""
    if not len(hashes):
        return np.zeros(n), np.zeros(n)
    order = np.lexsort((hashes, rows))
    h, r = hashes[order], rows[order]
    first = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (r[1:] != r[:-1])]))
    runs = np.diff(np.append(first, len(h)))
    top = np.zeros(n)
    np.maximum.at(top, r[first], runs)
    return np.bincount(r[first], minlength=n) / total, top / total


#: A comparison of a statistic: its number, whether it must lie above, and the threshold.
Test = tuple[int, bool, float]


@dataclass
class Rules:
    rules: list[tuple[Test, ...]]
    weights: np.ndarray
    intercept: float

    def column(self, stats: str) -> Column:
        """Probability of label 1, as a Spark expression over the array of statistics."""
        total = F.lit(float(self.intercept))
        for rule, w in zip(self.rules, self.weights, strict=True):
            holds = F.lit(True)
            for k, above, at in rule:
                x = F.col(stats)[k]
                holds = holds & (x > at if above else x <= at)
            total = total + F.when(holds, float(w)).otherwise(0.0)
        return 1 / (1 + F.exp(-total))

    def describe(self) -> list[str]:
        return [f"{w:+.3f} if " + " and ".join(f"{FEATURES[k]} {'>' if up else '<='} {at:.4g}" for k, up, at in r) for r, w in sorted(zip(self.rules, self.weights, strict=True), key=lambda x: -abs(x[1]))]


def _tree(x: np.ndarray, bins: list[np.ndarray], codes: np.ndarray, g: np.ndarray, h: np.ndarray) -> list[tuple[tuple[Test, ...], np.ndarray, float]]:
    """Every node below the root of one boosted tree: path, rows, leaf value."""
    out = []

    def grow(rows: np.ndarray, path: tuple[Test, ...]) -> None:
        if path:
            out.append((path, rows, float(g[rows].sum() / (h[rows].sum() + 1.0))))
        if len(path) == DEPTH or len(rows) < 2 * LEAST_ROWS:
            return
        gs, hs = g[rows].sum(), h[rows].sum()
        best = (1e-6, -1, 0.0)
        for k in range(x.shape[1]):
            if not len(bins[k]):
                continue
            c = codes[rows, k]
            m = len(bins[k]) + 1
            gl, hl, nl = np.cumsum(np.bincount(c, g[rows], m))[:-1], np.cumsum(np.bincount(c, h[rows], m))[:-1], np.cumsum(np.bincount(c, minlength=m))[:-1]
            gain = gl**2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs**2 / (hs + 1)
            gain[(nl < LEAST_ROWS) | (len(rows) - nl < LEAST_ROWS)] = -1
            b = int(gain.argmax())
            if gain[b] > best[0]:
                best = (float(gain[b]), k, float(bins[k][b]))
        if best[1] < 0:
            return
        low = x[rows, best[1]] <= best[2]
        grow(rows[low], (*path, (best[1], False, best[2])))
        grow(rows[~low], (*path, (best[1], True, best[2])))

    grow(np.arange(len(x)), ())
    return out


def holds(rule: tuple[Test, ...], x: np.ndarray) -> np.ndarray:
    ok = np.ones(len(x), bool)
    for k, above, at in rule:
        ok &= x[:, k] > at if above else x[:, k] <= at
    return ok


def fit(x: np.ndarray, y: np.ndarray) -> Rules:
    """Trees, their paths as rules, lasso weights."""
    if not len(y):
        return Rules([], np.zeros(0), 0.0)
    rate = (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(rate / (1 - rate)))
    if y.min() == y.max():
        return Rules([], np.zeros(0), base)
    bins = [np.unique(np.quantile(x[:, k], np.linspace(0.01, 0.99, 48), method="nearest")) for k in range(x.shape[1])]
    codes = np.stack([np.searchsorted(b, x[:, k], side="left") for k, b in enumerate(bins)], axis=1)
    score, rules = np.full(len(y), base), {}
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-score))
        for path, rows, value in _tree(x, bins, codes, y - p, np.maximum(p * (1 - p), 1e-6)):
            rules.setdefault(tuple(sorted(path)), None)
            if len(path) == DEPTH or len(rows) < 2 * LEAST_ROWS:
                score[rows] += RATE * value
    names = list(rules)
    m = np.stack([holds(r, x) for r in names], axis=1).astype(np.float64)
    _, unique = np.unique(m, axis=1, return_index=True)  # rules that hold for the same rows count once
    names, m = [names[k] for k in sorted(unique)], m[:, sorted(unique)]
    w, b = _lasso(m, y, base, LASSO)
    keep = np.flatnonzero(np.abs(w) > 1e-4)  # the penalty alone decides which rules stay
    w, b = _lasso(m[:, keep], y, b, LASSO / 10)  # weights anew, with less shrinkage
    return Rules([names[k] for k in keep], w, b)


def _lasso(m: np.ndarray, y: np.ndarray, b: float, strength: float) -> tuple[np.ndarray, float]:
    """Logistic regression with an L1 penalty by accelerated proximal steps."""
    n, k = m.shape
    if not k:
        return np.zeros(0), b
    full = np.concatenate([m, np.ones((n, 1))], axis=1)
    v = np.ones(k + 1)
    for _ in range(30):
        v = full.T @ (full @ v)
        v /= np.linalg.norm(v)
    step = 4 * n / float(np.linalg.norm(full.T @ (full @ v)))
    w = np.append(np.zeros(k), b)
    z, t = w.copy(), 1.0
    for _ in range(ROUNDS):
        grad = full.T @ (1 / (1 + np.exp(-(full @ z))) - y) / n
        new = z - step * grad
        new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - step * strength, 0)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z = new + (t - 1) / t_new * (new - w)
        done = np.abs(new - w).max() < 1e-6
        w, t = new, t_new
        if done:
            break
    return w[:-1], float(w[-1])


def with_statistics(rows: DataFrame, text: str = "text", name: str = "statistics", keep_text: bool = True) -> DataFrame:
    rows = without(rows, name)
    at = rows.columns.index(text)
    left = [k for k in range(len(rows.columns)) if keep_text or k != at]
    shape = T.StructType([*[rows.schema.fields[k] for k in left], T.StructField(name, T.ArrayType(T.DoubleType()))])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stats = statistics(batch.column(at))
            offs = pa.array(np.arange(len(stats) + 1) * len(FEATURES), pa.int32())
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in left], pa.ListArray.from_arrays(offs, pa.array(stats.reshape(-1)))], names=shape.names)

    return map_batches(rows, add, shape)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", doc_id: str = "doc_id", text: str = "text", train_rows: int = TRAIN_ROWS) -> Rules:
    """Learns from at most ``train_rows`` labels, the first in a hashed order."""
    known = labels.where(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("label_id"), F.col(label).cast("double").alias("y"))
    sample = known.orderBy(F.xxhash64("label_id", F.lit("quality")), "label_id", "y").limit(train_rows)
    picked = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("t")).join(F.broadcast(sample), F.col("id") == F.col("label_id")).select("label_id", "y", F.xxhash64("t").alias("h"), "t")
    stated = with_statistics(picked, "t", keep_text=False).where(F.col("statistics")[FEATURES.index("log_words")] > 0)
    # Repeated ids: one row of each, so that no more rows are learned from than labels.
    rows = stated.groupBy("label_id", "y").agg(F.min_by("statistics", "h").alias("statistics")).toArrow()  # train_rows rows of few numbers
    if not rows.num_rows:
        return fit(np.zeros((0, len(FEATURES))), np.zeros(0))
    x = rows["statistics"].combine_chunks().flatten().to_numpy().reshape(-1, len(FEATURES))
    order = np.lexsort((*x.T, rows["y"].to_numpy(), rows["label_id"].to_numpy()))  # as rows arrive in any order
    return fit(x[order], rows["y"].to_numpy()[order])


def score(rows: DataFrame, rules: Rules, text: str = "text", cut: float = CUT, keep_text: bool = True) -> DataFrame:
    """rows with score and predicted."""
    rows = without(rows, "score", "predicted")
    name = unused(rows, "statistics")[0]
    stated = with_statistics(rows, text, name, keep_text)
    wordless = F.col(name)[FEATURES.index("log_words")] <= 0
    return stated.withColumn("score", F.when(wordless, 0.0).otherwise(rules.column(name))).withColumn("predicted", (F.col("score") >= cut).cast("int")).drop(name)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    rules = train(docs, labels.where(F.coalesce(crc_mod("doc_id", 4) != 2, F.lit(False))))
    out = F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False))
    return score(docs.select("doc_id", out.alias("held_out"), "text"), rules, keep_text=False)
