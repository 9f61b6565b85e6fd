"""Line deduplication by pairwise alignment.

Each document's lines become hashes. A document's overlap with earlier ones is found by
its lines, pairs of successive lines, and the whole list of lines, however many documents
hold them. Each leads to one partner, the earliest document that holds it, so what n
documents share gives n - 1 pairs and not all of them. Hash lists of each pair are
aligned with patience diff, and aligned common blocks of ``least`` characters or more are
deleted from the later document. The earliest holder of a line never loses it, so every
line stays somewhere.

Order: by doc_id (null first), then by a hash of the text, so no two documents tie. Lines
are found by 64-bit hashes; an aligned pair of lines counts only if 128 bits of SHA-256 of
the two agree as well, so a chance collision cuts nothing. Blank lines go with the block
that they stand in.

Defined results: rows equal in doc_id and text are one document, each getting its result;
a null text has no lines and stays null; an empty text is one empty line; of several
earlier documents that hold a line the first in order is the partner; a very long text is
aligned whole, by one task that holds the digests of its lines (24 bytes a line) and those
of one partner; extra columns stay (in ``clean``, whatever their names; those named like
an output are replaced) or are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.common import map_batches, table, unused, without, written

LEAST = 30
#: Bytes of a line's SHA-256 that must agree before it is cut.
PROOF = 16


def patience(a: Sequence, b: Sequence) -> list[tuple[int, int]]:
    """Pairs (i, j) of lines that a patience diff aligns, ascending.

    Equal heads and tails match; between them lines unique to both sides, in their longest
    increasing order, are anchors, and the stretches between anchors are taken the same
    way. In a stretch without such lines the k-th copy of a line on one side may meet the
    k-th copy on the other, so that repeated lines align too.
    """
    out = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        lo, hi, x, y = todo.pop()
        while lo < hi and x < y and a[lo] == b[x]:
            out.append((lo, x))
            lo, x = lo + 1, x + 1
        while lo < hi and x < y and a[hi - 1] == b[y - 1]:
            hi, y = hi - 1, y - 1
            out.append((hi, y))
        if lo == hi or x == y:
            continue
        once_a, once_b = Counter(a[lo:hi]), Counter(b[x:y])
        at = {v: j for j, v in enumerate(b[x:y], x) if once_b[v] == 1}
        both = [(i, at[v]) for i, v in enumerate(a[lo:hi], lo) if once_a[v] == 1 and v in at]
        anchors = _increasing(both) or _increasing(_by_copy(a, lo, hi, b, x, y))
        if not anchors:
            continue
        edges = [(lo - 1, x - 1), *anchors, (hi, y)]
        out += anchors
        todo += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(edges, edges[1:], strict=False)]
    return sorted(out)


def _by_copy(a: Sequence, lo: int, hi: int, b: Sequence, x: int, y: int) -> list[tuple[int, int]]:
    """Pairs of the k-th copies of each line but blank ones, ascending in the first member."""
    at, n = {}, Counter()
    for j in range(x, y):
        n[b[j]] += 1
        at[b[j], n[b[j]]] = j
    out, n = [], Counter()
    for i in range(lo, hi):
        n[a[i]] += 1
        if a[i] is not None and (a[i], n[a[i]]) in at:
            out.append((i, at[a[i], n[a[i]]]))
    return out


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """A longest run of pairs that ascends in the second member too (patience sorting)."""
    tops: list[int] = []
    ends: list[int] = []
    back = [-1] * len(pairs)
    for k, (_, j) in enumerate(pairs):
        p = bisect_left(tops, j)
        back[k] = ends[p - 1] if p else -1
        tops[p : p + 1], ends[p : p + 1] = [j], [k]
    out, k = [], ends[-1] if ends else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def blocks(pairs: list[tuple[int, int]], chars: Sequence[int], least: int = LEAST) -> list[tuple[int, int]]:
    """Ranges [from, to) of the second side's lines in aligned blocks that are long enough."""
    out = []
    k = 0
    while k < len(pairs):
        m = k + 1
        while m < len(pairs) and pairs[m] == (pairs[m - 1][0] + 1, pairs[m - 1][1] + 1):
            m += 1
        lo, hi = pairs[k][1], pairs[m - 1][1] + 1
        if sum(chars[lo:hi]) >= least:
            out.append((lo, hi))
        k = m
    return out


def hashed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, version, line hashes (null: blank), lengths and digests of each different document."""
    lines = F.split(text, "\n", -1)
    return docs.where(F.col(text).isNotNull()).select(
        F.col(doc_id).alias("id"),
        F.xxhash64(text).alias("version"),
        F.transform(lines, lambda x: F.when(F.trim(x) != "", F.xxhash64(x))).alias("lines"),
        F.transform(lines, lambda x: F.length(x)).alias("chars"),
        F.unhex(F.array_join(F.transform(lines, lambda x: F.substring(F.sha2(x, 256), 1, 2 * PROOF)), "")).alias("proof"),
    )


def partners(listed: DataFrame) -> DataFrame:
    """Distinct pairs (later, earlier) of documents, as structs of id and version."""
    key = F.struct("id", "version")
    solid = F.filter("lines", lambda x: x.isNotNull())
    whole = F.xxhash64("lines", F.lit("whole"))
    pair = F.transform("s", lambda x, k: F.when(k > 0, F.xxhash64(F.col("s")[F.greatest(k - 1, F.lit(0))], x)))
    once = listed.withColumn("s", solid).where(F.size("s") > 0).select(key.alias("doc"), F.explode(F.concat("s", pair, F.array(whole))).alias("line")).where("line is not null").distinct()
    # Written, so that the join reads both sides from shuffles of their own and can split a
    # very common line.
    holders, _ = written(once.groupBy("line").agg(F.count("*").alias("df"), F.min("doc").alias("first")).where("df > 1"), "holders")
    return once.join(holders, "line").where("first < doc").select(F.col("doc").alias("later"), F.col("first").alias("earlier")).distinct()


def common_blocks(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rare: int | None = None, least: int = LEAST) -> DataFrame:
    """id, version, ranges of lines to delete, for each document that loses some.

    ``rare`` once bounded the documents that hold a line; it is accepted and changes nothing.
    """
    listed, _ = written(hashed(docs, doc_id, text).dropDuplicates(["id", "version"]), "lines")
    pairs, _ = written(partners(listed), "partners")
    key = F.struct("id", "version")
    later = listed.select(key.alias("later"), F.col("lines").alias("b"), "chars", F.col("proof").alias("proof_b"))
    earlier = listed.select(key.alias("earlier"), F.col("lines").alias("a"), F.col("proof").alias("proof_a"))
    shape = T.StructType([*[T.StructField(f.name, f.dataType) for f in listed.schema.fields[:2]], T.StructField("ranges", T.ArrayType(T.StructType([T.StructField("lo", T.IntegerType()), T.StructField("hi", T.IntegerType())])))])

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))
        for batch in batches:
            ranges = []
            for a, b, chars, seen, mine in zip(*batch.columns[2:], strict=True):
                seen, mine = seen.as_py(), mine.as_py()
                same = [(i, j) for i, j in patience(a.as_py(), b.as_py()) if seen[PROOF * i : PROOF * (i + 1)] == mine[PROOF * j : PROOF * (j + 1)]]
                found = blocks(same, chars.as_py(), least)
                ranges.append([{"lo": lo, "hi": hi} for lo, hi in found])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ranges, kind)], names=["id", "version", "ranges"])

    aligned = map_batches(pairs.join(later, "later").join(earlier, "earlier").select("later.id", "later.version", "a", "b", "chars", "proof_a", "proof_b"), align, shape)
    return aligned.where(F.size("ranges") > 0).groupBy("id", "version").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ranges")))).alias("ranges"))


def clean(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rare: int | None = None, least: int = LEAST) -> DataFrame:
    """docs with ``text`` cleaned, and n_lines, n_removed, removed (ranges from-to, by comma)."""
    docs = without(docs, "n_lines", "n_removed", "removed")
    its_id, its_version, its_ranges = unused(docs, "id", "version", "ranges")
    found, _ = written(common_blocks(docs, doc_id, text, rare, least).toDF(its_id, its_version, its_ranges), "blocks")
    # Texts are shuffled once at any size and not sorted; the other side is short ranges.
    joined = docs.join(found.hint("shuffle_hash"), F.col(doc_id).eqNullSafe(F.col(its_id)) & (F.xxhash64(text) == F.col(its_version)), "left").drop(its_id, its_version)
    at, names = joined.columns.index(text), docs.columns
    shape = T.StructType([*docs.schema.fields, T.StructField("n_lines", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("removed", T.StringType())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, ranges = batch.column(at), batch.column(len(names)).to_pylist()
            out, lines, gone, said = [], [], [], []
            for t, found in zip(texts, ranges, strict=True):
                t = t.as_py()
                parts = t.split("\n") if t is not None else []
                drop: set[int] = set()
                for r in found or []:
                    drop.update(range(r["lo"], r["hi"]))
                out.append("\n".join(x for k, x in enumerate(parts) if k not in drop) if drop else t)
                lines.append(len(parts))
                gone.append(len(drop))
                said.append(",".join(f"{lo}-{hi}" for lo, hi in _runs(sorted(drop))))
            columns = [batch.column(k) if k != at else pa.array(out, pa.string()) for k in range(len(names))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(lines, pa.int64()), pa.array(gone, pa.int64()), pa.array(said, pa.string())], names=shape.names)

    return map_batches(joined, cut, shape)


def _runs(numbers: list[int]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for x in numbers:
        if out and out[-1][1] == x:
            out[-1] = (out[-1][0], x + 1)
        else:
            out.append((x, x + 1))
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = clean(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cleaned.select("doc_id", "n_lines", "n_removed", "removed", F.length("text").cast("long").alias("clean_chars"), F.sha2("text", 256).alias("clean_sha256"))
