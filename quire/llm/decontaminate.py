"""Benchmark decontamination: BM25 with block-max WAND, then overlap of both item parts.

Test items form an inverted index: for each term its items in ascending order, with BM25
impacts divided by the item's score for its own words, so that one threshold serves all
items; every block of postings holds its highest impact. Every training text is cut into
overlapping windows of words (twice the longest item long, half overlapping, so that a
passage as long as an item lies whole in one) and each window is a query.

Most windows cannot reach the threshold for any item, which a batch test finds first: for
each item, its terms least useful for skipping are set aside while their impacts sum to
less than half the threshold; what a window gathers from the others, which are an index of
their own, must reach the rest. The test drops no window that WAND would answer, and takes
``POSTINGS`` postings and ``CELLS`` sums at a time, whatever the number of items. Windows
that remain go through block-max WAND, which returns every item at or above the threshold.
An item is found if enough of the word triples of its question and of its answer (its last
quarter) lie in the window: the rule of the SQL. ``drop_found`` also takes an item whose
answer is edited or cut off, if a stretch of the window holds enough of the whole item by
edit distance in words.

Items of fewer than ``LEAST`` words say too little for shares of words. Such an item is
found where a line of a text consists of its words and nothing else, with score 1.

The index is built on the driver and broadcast in parts of at most ``MAX_PART_BYTES`` of
item text; usually there is one. Document frequencies, the average length and the longest
item are those of all items, so scores do not depend on the parts.

Defined results: words are runs of ASCII letters, digits and non-ASCII bytes, in lower
case; null or empty texts match nothing, nor do items without words; an item's id may be
null or of any type; repeated rows and items are found each; ties between windows go to
the first; a very long text is taken in one step of numpy (about 40 bytes a byte of it);
extra columns of the documents stay in ``drop_found``, whatever their names, and are
ignored in ``find``; empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm import common
from quire.llm.common import LOWER, forget, map_batches, pieces, table, text_buffer, written

K1, B = 1.2, 0.75
#: Share of an item's own score that a window must reach; shares of word triples to find.
THRESHOLD, QUESTION, ANSWER = 0.5, 0.6, 0.6
#: Share of an item's words that stay after the edits that turn it into a stretch of text.
WHOLE = 0.6
LEAST, BLOCK, STEP = 5, 16, 1 << 19
MAX_PART_BYTES = 32 << 20
#: Postings and sums of a window and an item that the batch test holds at a time.
POSTINGS, CELLS = 1 << 20, 1 << 22

_BREAK = np.ones(256, bool)
_BREAK[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_CLASSES = np.where(_BREAK, 0x20, LOWER).astype(np.uint8)


def words(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, row and first byte of every word."""
    low = _CLASSES[buf]
    # Capital letters of the Latin-1 block, two bytes each: C3 80 to C3 9E.
    second = np.flatnonzero((buf[:-1] == 0xC3) & (buf[1:] >= 0x80) & (buf[1:] <= 0x9E) & (buf[1:] != 0x97)) + 1
    low[second] += 0x20
    start, end, row = common.word_bounds(low, offs)
    return common.word_hashes(low, start, end), row, start


def _triples(w: np.ndarray) -> np.ndarray:
    if len(w) < 3:
        return np.unique(w)
    return np.unique(common.mixed(w[:-2] * np.uint64(0x100000001B3) ** np.uint64(2) + w[1:-1] * np.uint64(0x100000001B3) + w[2:]))


def kept_words(item: np.ndarray, text: np.ndarray) -> int:
    """Words of the item less the fewest edits that turn it into some stretch of the text."""
    at = np.arange(len(text) + 1)
    edits = np.zeros(len(text) + 1, np.int64)
    for w in item:
        step = edits + 1
        step[1:] = np.minimum(step[1:], edits[:-1] + (text != w))
        edits = np.minimum.accumulate(step - at) + at
    return len(item) - int(edits.min())


@dataclass
class Statistics:
    """Numbers of all items, of which an index may hold a part."""

    items: int
    average: float  # words of an item
    longest: int
    terms: np.ndarray  # ascending; those of the part
    df: np.ndarray


@dataclass
class Index:
    ids: pa.Array  # item ids: those of the index, then those of short items
    items: int  # how many are in the index
    terms: np.ndarray  # ascending word hashes
    maybe: np.ndarray  # which high bits any term has
    first: np.ndarray  # postings of term k: first[k] to first[k + 1]
    item: np.ndarray
    impact: np.ndarray
    most: np.ndarray  # highest impact of each term
    block_first: np.ndarray  # blocks of term k: block_first[k] to block_first[k + 1]
    block_last: np.ndarray  # last item of each block
    block_most: np.ndarray  # highest impact of each block
    essential: tuple[np.ndarray, np.ndarray, np.ndarray]  # first, item and impact of the postings of the batch test
    need: np.ndarray  # what essential postings must reach, by item
    text: np.ndarray  # word hashes of all items
    text_first: np.ndarray  # where each item's begin
    length: int  # words of the longest item
    short: dict[bytes, list[int]]  # numbers of short items by their word hashes

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Term number of each word, or -1."""
        out = np.full(len(hashes), -1, np.int32)
        at = np.flatnonzero(self.maybe[hashes >> np.uint64(44)])
        if len(at) and len(self.terms):
            k = np.minimum(np.searchsorted(self.terms, hashes[at]), len(self.terms) - 1)
            out[at] = np.where(self.terms[k] == hashes[at], k, -1)
        return out

    def words_of(self, item: int) -> np.ndarray:
        return self.text[self.text_first[item] : self.text_first[item + 1]]


def _within(first: np.ndarray, terms: np.ndarray) -> np.ndarray:
    """Positions of all postings of the terms, term by term."""
    many = first[terms + 1] - first[terms]
    return np.repeat(first[terms] - (np.cumsum(many) - many), many) + np.arange(many.sum())


def build(items: list[tuple] | pa.Table, threshold: float = THRESHOLD, known: Statistics | None = None, aside: float = 0.5) -> Index | None:
    """Index of (id, text) rows; None without usable items.

    ``known``: statistics of all items, where these are a part. ``aside``: the share of the
    threshold that terms out of the batch test may bring.
    """
    if not isinstance(items, pa.Table):
        items = pa.table({"id": pa.array([i for i, _ in items]), "text": pa.array([t for _, t in items], pa.string())})
    hashes, row, _ = words(*text_buffer(items.column(1)))
    size = np.bincount(row, minlength=items.num_rows)
    long, small = np.flatnonzero(size >= LEAST), np.flatnonzero((size > 0) & (size < LEAST))
    if not len(long) and not len(small):
        return None
    ids = items.column(0).take(pa.array(np.concatenate([long, small]))).combine_chunks()
    begin = np.concatenate([[0], np.cumsum(size)])
    short: dict[bytes, list[int]] = {}
    for k, r in enumerate(small):
        short.setdefault(hashes[begin[r] : begin[r + 1]].tobytes(), []).append(len(long) + k)
    text = hashes[np.repeat(size >= LEAST, size)]
    lengths = size[long]
    n = len(long)
    # Different words of each item, and how often they come.
    holder = np.repeat(np.arange(n), lengths)
    order = np.lexsort((text, holder))
    w, h = text[order], holder[order]
    head = np.flatnonzero(np.concatenate([[True], (w[1:] != w[:-1]) | (h[1:] != h[:-1])])) if len(w) else np.zeros(0, int)
    tf = np.diff(np.append(head, len(w)))
    item = h[head]
    terms, number = np.unique(w[head], return_inverse=True)
    own_df = np.bincount(number, minlength=len(terms))
    if known is None:
        known = Statistics(n, lengths.mean() if n else 0.0, int(lengths.max(initial=0)), terms, own_df)
    df = known.df[np.searchsorted(known.terms, terms)]
    impact = tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[item] / known.average)) if n else np.zeros(0)
    impact = impact * np.log(1 + (known.items - df + 0.5) / (df + 0.5))[number]
    impact /= np.bincount(item, impact, minlength=n)[item]
    order = np.lexsort((item, number))
    number, item, impact = number[order], item[order].astype(np.int32), impact[order]
    first = np.concatenate([[0], np.cumsum(own_df)])
    starts = np.flatnonzero((np.arange(len(item)) - first[number]) % BLOCK == 0)
    most, block_most = ((np.maximum.reduceat(impact, x) if len(item) else np.zeros(0)) for x in (first[:-1], starts))
    # Each item's frequent terms go out of the batch test first.
    order = np.lexsort((impact, -df[number], item))
    sums = np.cumsum(impact[order])
    heads = np.searchsorted(item[order], np.arange(n))
    sums -= (sums[heads] - impact[order][heads])[item[order]] if n else 0.0
    out = np.zeros(len(item), bool)
    out[order] = sums < threshold * aside
    need = threshold - np.bincount(item[out], impact[out], minlength=n) - 1e-9
    maybe = np.zeros(1 << 20, bool)
    maybe[terms >> np.uint64(44)] = True
    return Index(
        ids, n, terms, maybe, first, item, impact, most,
        np.searchsorted(starts, first), item[np.append(starts[1:], len(item)) - 1] if len(item) else item, block_most,
        (np.concatenate([[0], np.cumsum(np.bincount(number[~out], minlength=len(terms)))]), item[~out], impact[~out]), need,
        text, np.concatenate([[0], np.cumsum(lengths)]), known.longest, short,
    )


def wand(index: Index, query: np.ndarray, threshold: float = THRESHOLD) -> list[tuple[int, float]]:
    """Every item whose score for the distinct terms is at least the threshold."""
    end = index.items
    lists = []
    for t in query:
        a, z, c, e = index.first[t], index.first[t + 1], index.block_first[t], index.block_first[t + 1]
        lists.append((index.item[a:z], index.impact[a:z], float(index.most[t]), index.block_last[c:e], index.block_most[c:e]))
    at = [0] * len(lists)
    now = [int(x[0][0]) for x in lists]
    found = []
    low = threshold - 1e-9

    def seek(k: int, item: int) -> None:
        at[k] = int(np.searchsorted(lists[k][0], item))
        now[k] = int(lists[k][0][at[k]]) if at[k] < len(lists[k][0]) else end

    while True:
        order = sorted((k for k in range(len(lists)) if now[k] < end), key=now.__getitem__)
        reach, pivot = 0.0, -1
        for n, k in enumerate(order):
            reach += lists[k][2]
            if reach >= low:
                pivot = n
                break
        if pivot < 0:
            return found
        item = now[order[pivot]]
        while pivot + 1 < len(order) and now[order[pivot + 1]] == item:
            pivot += 1
        # The block of each list that would hold the item bounds what it can add.
        bound, until = 0.0, end
        for k in order[: pivot + 1]:
            lasts, highs = lists[k][3], lists[k][4]
            b = int(np.searchsorted(lasts, item))
            if b < len(lasts):
                bound += float(highs[b])
                until = min(until, int(lasts[b]) + 1)
        if bound < low:
            after = min(until, now[order[pivot + 1]] if pivot + 1 < len(order) else end)
            after = max(after, item + 1)
            for k in order[: pivot + 1]:
                seek(k, after)
        elif now[order[0]] == item:
            score = sum(float(lists[k][1][at[k]]) for k in order[: pivot + 1])
            if score >= low:
                found.append((item, score))
            for k in order[: pivot + 1]:
                seek(k, item + 1)
        else:
            for k in order[: pivot + 1]:
                if now[k] < item:
                    seek(k, item)


def _reached(index: Index, window: np.ndarray, terms: np.ndarray) -> np.ndarray:
    """Windows in which essential postings reach what some item needs.

    ``window`` and ``terms``: the different terms of each window, ascending by window.
    """
    first, item, impact = index.essential
    if not len(window) or not index.items:
        return window[:0]
    numbers, head = np.unique(window, return_index=True)
    head = np.append(head, len(window))
    out = []
    some = max(1, CELLS // index.items)
    for x in range(0, len(numbers), some):
        y = min(len(numbers), x + some)
        sums = np.zeros((y - x) * index.items)
        a = head[x]
        upto = np.cumsum(first[terms[a : head[y]] + 1] - first[terms[a : head[y]]])
        row = np.repeat(np.arange(y - x), np.diff(head[x : y + 1]))
        lo = 0
        while lo < len(upto):
            hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + POSTINGS, side="right")))
            t = terms[a + lo : a + hi]
            post = _within(first, t)
            key = np.repeat(row[lo:hi], first[t + 1] - first[t]) * index.items + item[post]
            if len(key) < len(sums) // 64:
                np.add.at(sums, key, impact[post])
            else:
                sums += np.bincount(key, impact[post], minlength=len(sums))
            lo = hi
        out.append(numbers[x:y][(sums.reshape(y - x, -1) >= index.need).any(axis=1)])
    return np.concatenate(out)


def _short_lines(index: Index, hashes: np.ndarray, row: np.ndarray, start: np.ndarray, buf: np.ndarray) -> Iterator[tuple[int, int]]:
    """Row and number of each short item whose words are those of a line."""
    line = np.searchsorted(np.flatnonzero(buf == 10), start)
    head = np.flatnonzero(np.concatenate([[True], (line[1:] != line[:-1]) | (row[1:] != row[:-1])])) if len(row) else np.zeros(0, int)
    size = np.diff(np.append(head, len(row)))
    for a, n in zip(head[size < LEAST], size[size < LEAST], strict=True):
        for item in index.short.get(hashes[a : a + n].tobytes(), ()):
            yield int(row[a]), item


def matches(index: Index, column: pa.Array, whole: bool = False) -> Iterator[tuple[int, int, float, float, float]]:
    """Row, item number, score, overlap of question and answer: each item once a row.

    With ``whole``, also items of which a window keeps the share ``WHOLE`` of all words, and
    ``LEAST`` words at least, whatever their question and answer.
    """
    buf, offs = text_buffer(column)
    step = max(1, index.length)
    for i, j in pieces(offs, STEP):
        part = buf[offs[i] : offs[j]]
        hashes, row, start = words(part, offs[i : j + 1] - offs[i])
        best: dict[tuple[int, int], tuple[float, float, float]] = {}
        if index.short:
            best |= {(i + r, item): (1.0, 1.0, 1.0) for r, item in _short_lines(index, hashes, row, start, part)}
        term = index.numbers(hashes)
        begin = np.searchsorted(row, np.arange(j - i + 1))
        at = np.flatnonzero(term >= 0)
        # Number the windows of all rows: window k of a row starts at word k * step.
        per_row = np.maximum(1, -(-np.diff(begin) // step))
        base = np.concatenate([[0], np.cumsum(per_row)])
        own = base[row[at]] + (at - begin[row[at]]) // step
        earlier = own > base[row[at]]
        window = np.concatenate([own, own[earlier] - 1])
        pair = np.unique(window * max(1, len(index.terms)) + np.concatenate([term[at], term[at[earlier]]]))
        window, terms = pair // max(1, len(index.terms)), pair % max(1, len(index.terms))
        for w in _reached(index, window, terms):
            a, z = np.searchsorted(window, [w, w + 1])
            r = int(np.searchsorted(base, w, side="right")) - 1
            lo = begin[r] + (w - base[r]) * step
            inside = hashes[lo : min(begin[r + 1], lo + 2 * step)]
            triples = _triples(inside)
            for item, score in wand(index, terms[a:z]):
                text = index.words_of(item)
                cut = len(text) - max(1, len(text) // 4)
                parts = [float(np.isin(_triples(x), triples if len(x) >= 3 else inside).mean()) for x in (text[:cut], text[cut:])]
                found = parts[0] >= QUESTION and parts[1] >= ANSWER
                if not found and whole and (i + r, item) not in best:
                    least = max(WHOLE * len(text) - 1e-9, LEAST)
                    found = np.isin(text, inside).sum() >= least and kept_words(text, inside) >= least
                if found and (score, *parts) > best.get((i + r, item), (0.0, 0.0, 0.0)):
                    best[i + r, item] = (score, *parts)
        for (r, item), x in sorted(best.items()):
            yield r, item, *x


def _statistics(items: DataFrame, parts: int, spark: SparkSession) -> tuple[Statistics, DataFrame]:
    """Numbers of all items (part, id, text), and document frequencies by part and term."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, row, _ = words(*text_buffer(batch.column(1)))
            size = np.bincount(row, minlength=batch.num_rows)
            begin = np.concatenate([[0], np.cumsum(size)])
            terms = [np.unique(hashes[a:z]).view(np.int64) for a, z in zip(begin, begin[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(terms, pa.list_(pa.int64()))], names=["part", "n", "terms"])

    counted, path = written(map_batches(items.select("part", "text"), each, "part int, n long, terms array<long>").where(F.col("n") >= LEAST), "items")
    total = counted.agg(F.count("*").alias("items"), F.coalesce(F.avg("n"), F.lit(1.0)).alias("average"), F.coalesce(F.max("n"), F.lit(0)).alias("longest")).first()
    held = counted.select("part", F.explode("terms").alias("term"))
    df = held.groupBy("term").agg(F.count("*").alias("df"))
    by_part, _ = written(held.distinct().join(df, "term"), "item-terms")
    forget(spark, path)
    return Statistics(total["items"], total["average"], total["longest"], np.zeros(0, np.uint64), np.zeros(0, np.int64)), by_part


def indexes(benchmark: DataFrame, item_id: str = "item_id", text: str = "text") -> Iterator[Index]:
    """Indexes of a bounded size that together hold all items."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col(item_id).alias("id"), F.col(text).alias("text")).where("text is not null")
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = max(1, -(-total // MAX_PART_BYTES))
    # Dealt by the text, so that equal items meet; without them a part is near its bound.
    items = items.withColumn("part", F.pmod(F.xxhash64("text"), F.lit(parts)).cast("int"))
    known = by_part = None
    if parts > 1:
        known, by_part = _statistics(items, parts, spark)
    for k in range(parts):
        rows = items.where(F.col("part") == k).select("id", "text").toArrow()
        if known is not None:
            some = by_part.where(F.col("part") == k).select("term", "df").toArrow()
            terms, df = some["term"].to_numpy().view(np.uint64), some["df"].to_numpy()
            by = np.argsort(terms)
            known = replace(known, terms=terms[by], df=df[by])
        if found := build(rows, known=known):
            yield found


def find(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id") -> DataFrame:
    """doc_id, item_id, score, question_overlap, answer_overlap of every item found."""
    spark = docs.sparkSession
    shape = T.StructType([T.StructField("doc_id", docs.schema[doc_id].dataType), T.StructField("item_id", benchmark.schema[item_id].dataType), *[T.StructField(c, T.DoubleType()) for c in ("score", "question_overlap", "answer_overlap")]])
    out = spark.createDataFrame([], shape)
    for index in indexes(benchmark, item_id):
        held = spark.sparkContext.broadcast(index)

        def search(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = list(matches(held.value, batch.column(1)))
                at, items = (pa.array([x[k] for x in found], pa.int64()) for k in (0, 1))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), held.value.ids.take(items), *[pa.array([round(x[k], 9) for x in found], pa.float64()) for k in (2, 3, 4)]], names=shape.names)

        out = out.union(map_batches(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), search, shape))
    return out


def drop_found(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """docs without those that hold an item, edited or cut too; texts are neither shuffled nor joined.

    Where the index has several parts, what each leaves is written for the next, so that a
    worker holds one part.
    """
    context, at, names = docs.sparkSession.sparkContext, docs.columns.index(text), docs.columns
    for k, index in enumerate(indexes(benchmark)):
        held = context.broadcast(index)
        docs = written(docs, "part")[0] if k else docs

        def keep(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                good = np.ones(batch.num_rows, bool)
                good[[x[0] for x in matches(held.value, batch.column(at), whole=True)]] = False
                yield batch.filter(pa.array(good)).rename_columns(names)

        docs = map_batches(docs, keep, docs.schema)
    return docs


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


def _triples_sql(words: str) -> str:
    return f"CASE WHEN len({words}) < 3 THEN list_distinct({words}) ELSE list_distinct(list_transform(range(len({words}) - 2), lambda k: {words}[k + 1] || ' ' || {words}[k + 2] || ' ' || {words}[k + 3])) END"


_WORDS = r"regexp_extract_all(lower(coalesce(text, '')), '[0-9a-z\x{80}-\x{10FFFF}]+')"

#: For tables whose letters all have the lower case that ``words`` gives them.
ORACLE = f"""
WITH items AS (SELECT item_id, row_number() OVER () AS k, w FROM (SELECT item_id, {_WORDS} AS w FROM benchmark) WHERE len(w) >= {LEAST}),
size AS (SELECT max(len(w)) AS step, avg(len(w)) AS average, count(*) AS items FROM items),
tf AS (SELECT k, term, count(*) AS tf FROM (SELECT k, unnest(w) AS term FROM items) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY ALL),
raw AS (SELECT k, term, tf * ({K1} + 1) / (tf + {K1} * (1 - {B} + {B} * len(w) / average)) * ln(1 + (items - df + 0.5) / (df + 0.5)) AS v FROM tf JOIN df USING (term) JOIN items USING (k), size),
impact AS (SELECT k, term, v / sum(v) OVER (PARTITION BY k) AS impact FROM raw),
d AS (SELECT doc_id, row_number() OVER () AS r, text, {_WORDS} AS w FROM documents),
tokens AS (SELECT r, unnest(w) AS term, unnest(range(len(w))) AS i FROM d),
win AS (SELECT DISTINCT r, i // step AS win, term FROM tokens, size UNION SELECT DISTINCT r, i // step - 1, term FROM tokens, size WHERE i >= step),
found AS (SELECT r, win, k, sum(impact) AS score FROM win JOIN impact USING (term) GROUP BY ALL HAVING sum(impact) >= {THRESHOLD} - 1e-9),
parts AS (SELECT item_id, k, {_triples_sql('q')} AS q, len(q) >= 3 AS q3, {_triples_sql('a')} AS a, len(a) >= 3 AS a3
  FROM (SELECT item_id, k, w[1 : len(w) - greatest(1, len(w) // 4)] AS q, w[len(w) - greatest(1, len(w) // 4) + 1 :] AS a FROM items)),
inside AS (SELECT doc_id, f.r, k, score, w[win * step + 1 : win * step + 2 * step] AS x FROM found f JOIN d ON d.r = f.r, size),
held AS (SELECT *, {_triples_sql('x')} AS x3 FROM inside),
overlap AS (SELECT doc_id, r, k, item_id, score, len(list_intersect(q, CASE WHEN q3 THEN x3 ELSE x END)) / CAST(len(q) AS DOUBLE) AS question_overlap,
  len(list_intersect(a, CASE WHEN a3 THEN x3 ELSE x END)) / CAST(len(a) AS DOUBLE) AS answer_overlap FROM held JOIN parts USING (k)),
best AS (SELECT *, row_number() OVER (PARTITION BY r, k ORDER BY score DESC, question_overlap DESC, answer_overlap DESC) AS n FROM overlap WHERE question_overlap >= {QUESTION} AND answer_overlap >= {ANSWER})
SELECT doc_id, item_id, round(score, 9) AS score, round(question_overlap, 9) AS question_overlap, round(answer_overlap, 9) AS answer_overlap FROM best WHERE n = 1
UNION ALL
SELECT doc_id, item_id, 1.0::DOUBLE, 1.0::DOUBLE, 1.0::DOUBLE FROM (
  SELECT DISTINCT doc_id, r, item_id, n FROM (SELECT doc_id, r, {_WORDS} AS w FROM (SELECT doc_id, r, unnest(string_split(text, chr(10))) AS text FROM d)) l
  JOIN (SELECT item_id, row_number() OVER () AS n, w FROM (SELECT item_id, {_WORDS} AS w FROM benchmark) WHERE len(w) BETWEEN 1 AND {LEAST - 1}) s USING (w))
"""
