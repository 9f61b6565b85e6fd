"""N-gram Jaccard join by prefix filters under several global token orders.

A text's tokens are its distinct word shingles, as 64-bit hashes. Texts of equal token
sets form a class; classes are compared, texts are not. For a threshold t and any total
order of all tokens, two sets of similarity t or more share at least l tokens among the
first n - ceil(t n) + l of each; l grows with n, and the lesser l of a pair holds. Three
such orders are used. All put frequent tokens last, by a bounded table of heavy tokens
found in a first pass (which tokens are in it never changes the result), and differ in how
they order the others.

Prefixes under the first order are joined by token. Tokens held by up to ``small`` classes
give pairs, kept if they share enough. A class with fewer than l tokens above that bound
cannot have a partner that it shares only such tokens with; the others (groups of near
copies) are linked by each such token to its least class. The groups so connected hold
all similar pairs.

A group's classes are dealt to hashed blocks of bounded size. A task applies the filters
of all three orders, intersects what passes, verifies the pairs that remain and are not
connected yet, and hands on a spanning forest of the links that it finds. First each block
is compared with itself and a few pivots of its group, which all blocks share; that
connects the bulk of a group of near copies, and each set is shipped once. Only classes
that are then outside the largest component of their group are compared with all blocks of
it, as two classes of one component need no link more. So no pairs of a large group become
rows, and no link between components is lost.

Defined results: words are split at ASCII white space and lower-cased A to Z only; with
fewer words than the width, the whole sequence is the one token; a text without words
(null, empty, blank) has 0 tokens and is linked with nothing, its component is its own id;
rows of the same id are documents of their own, which share that id; a null id is never
the smallest; the smallest id decides ties; a very long text is taken in one step of numpy
(about 40 bytes a byte of it); extra columns stay in ``keep_first``, whatever their names,
and are ignored in ``similar``; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.llm.common import LOWER, forget, map_batches, mixed, pieces, table, text_buffer, unused, word_bounds, word_hashes, written
from quire.llm.components import components

WIDTH, PERCENT = 4, 85
#: Entries of the table of heavy tokens at most, 12 bytes each.
HEAVY = 1 << 18
#: Largest number of classes of a token whose pairs become rows.
SMALL = 32
#: Classes and tokens of a block, about.
BLOCK_CLASSES, BLOCK_TOKENS = 256, 1 << 18
#: Classes of a group that every block of it is compared with.
PIVOTS = 4
STEP, ORDERS = 1 << 19, 3
#: Up to so many rows, a list of ids or groups is broadcast (five numbers each at most).
BROADCAST_IDS = 200_000
#: Tokens in a prefix for each one that a partner must share, beyond the least prefix.
SHARED = 12
_SEEDS = np.array([0, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)


def token_sets(column: pa.Array, width: int, salt: int = 0) -> Iterator[tuple[int, np.ndarray]]:
    """Row number and ascending distinct tokens of every text, rows in order."""
    buf, offs = text_buffer(column)
    factors = [np.uint64(pow(0x100000001B3, width - 1 - k, 2**64)) for k in range(width)]
    for i, j in pieces(offs, STEP):
        part = LOWER[buf[offs[i] : offs[j]]]
        start, end, row = word_bounds(part, offs[i : j + 1] - offs[i])
        words = word_hashes(part, start, end) ^ np.uint64(salt * 0x9E3779B97F4A7C15 % 2**64)
        m = max(0, len(words) - width + 1)
        tokens = np.zeros(m, np.uint64)
        for k, f in enumerate(factors):
            tokens += words[k : k + m] * f
        tokens = mixed(tokens)
        first = np.searchsorted(row, np.arange(j - i + 1))
        for k in range(j - i):
            a, z = first[k], first[k + 1]
            if z - a >= width:
                s = np.sort(tokens[a : z - width + 1])
                yield i + k, s[np.concatenate([[True], s[1:] != s[:-1]])] if len(s) > 1 else s
            elif z > a:
                short = np.array([z - a], np.uint64)
                for w in words[a:z]:
                    short = mixed(short * factors[0] + w)
                yield i + k, short
            else:
                yield i + k, tokens[:0]


class Orders:
    """The global orders: frequency of a heavy token, then a hash of the order's own."""

    def __init__(self, heavy: np.ndarray, counts: np.ndarray, percent: int) -> None:
        by = np.argsort(heavy)
        self.heavy, self.counts, self.percent = heavy[by], counts[by], percent
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[heavy >> np.uint64(44)] = True

    def ranks(self, tokens: np.ndarray) -> np.ndarray:
        out = np.zeros(len(tokens), np.int64)
        at = np.flatnonzero(self.maybe[tokens >> np.uint64(44)])
        if len(at):
            k = np.minimum(np.searchsorted(self.heavy, tokens[at]), len(self.heavy) - 1)
            out[at] = np.where(self.heavy[k] == tokens[at], self.counts[k], 0)
        return out

    def prefixes(self, tokens: np.ndarray, orders: int = ORDERS) -> list[np.ndarray]:
        """The prefix of a set under each order, in that order."""
        n = len(tokens)
        most = n - -(-self.percent * n // 100) + shared_least(n) if n else 0  # n - ceil(percent n / 100) + l
        rank = self.ranks(tokens)
        light = tokens[rank == 0]
        out = []
        for k in range(orders):
            own = mixed(light ^ _SEEDS[k]) if k else light
            first = light[np.argsort(own)] if k else light
            if len(first) < most:
                late = np.flatnonzero(rank)
                own = mixed(tokens[late] ^ _SEEDS[k]) if k else tokens[late]
                first = np.concatenate([first, tokens[late[np.lexsort((own, rank[late]))]]])
            out.append(first[:most])
        return out


def shared_least(n):
    """l: what a set of n tokens and a similar one of n or more share in their prefixes."""
    return 1 + n // SHARED


def digest(tokens: np.ndarray) -> tuple[int, int]:
    """Class of a set, and a second number by which equal classes of unequal sets show."""
    with np.errstate(over="ignore"):
        a = int(mixed(tokens).sum(dtype=np.uint64))
        b = int(mixed(tokens ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64))
    return int(np.uint64(a).astype(np.int64)), int(np.uint64(b).astype(np.int64))


def _longs(values: np.ndarray) -> pa.Array:
    return pa.array(np.asarray(values, np.uint64).view(np.int64), pa.int64())


def heavy_tokens(texts: DataFrame, width: int, salt: int, limit: int = HEAVY) -> tuple[np.ndarray, np.ndarray]:
    """Tokens that recur within a task's stretch of texts, with counts: the most frequent."""

    def recurring(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, seen = [], 0, set()

        def out() -> pa.RecordBatch:
            tokens, counts = np.unique(np.concatenate(held) if held else np.zeros(0, np.uint64), return_counts=True)
            some = counts > 2
            return pa.RecordBatch.from_arrays([_longs(tokens[some]), pa.array(counts[some])], names=["token", "n"])

        for batch in batches:
            for _, s in token_sets(batch.column(0), width, salt):
                if len(s) and (d := digest(s)[0]) not in seen:  # a class counts once in a stretch
                    seen.add(d)
                    held.append(s)
                    n += len(s)
                if n > 1 << 21:
                    yield out()
                    held, n, seen = [], 0, set()
        yield out()

    found = map_batches(texts, recurring, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "token").limit(limit).toArrow()
    return found["token"].to_numpy().view(np.uint64), found["n"].to_numpy()


def classify(docs: DataFrame, orders, width: int, salt: int) -> DataFrame:
    """id, version, cls, proof, n of every text; first-order prefix where a task first meets a class."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        o = orders.value
        for batch in batches:
            cls, proof, size, prefix = [], [], [], []
            for _, s in token_sets(batch.column(1), width, salt):
                c, p = digest(s) if len(s) else (None, None)
                cls.append(c)
                proof.append(p)
                size.append(len(s))
                prefix.append(o.prefixes(s, 1)[0].view(np.int64) if len(s) and c not in seen else None)
                seen.add(c)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(cls, pa.int64()), pa.array(proof, pa.int64()), pa.array(size, pa.int64()), pa.array(prefix, pa.list_(pa.int64()))], names=["id", "version", "cls", "proof", "n", "prefix"])

    return map_batches(docs, each, "id long, version long, cls long, proof long, n long, prefix array<long>")


def _products(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets of a task, by products of 0/1 matrices."""
    which = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, token = np.unique(np.concatenate(sets), return_inverse=True)
    many = np.bincount(token) > 1
    number = np.cumsum(many) - 1
    which, token = which[many[token]], number[token[many[token]]]
    if len(sets) == 2:  # what both hold, beside the sizes
        return np.array([[len(sets[0]), many.sum()], [many.sum(), len(sets[1])]], np.float32)
    wide = min(4096, int(many.sum()))
    out = np.zeros((len(sets), len(sets)), np.float32)
    order = np.argsort(token, kind="stable")
    which, token = which[order], token[order]
    for lo in range(0, int(many.sum()), max(1, wide)):
        a, z = np.searchsorted(token, [lo, lo + wide])
        m = np.zeros((len(sets), wide), np.float32)
        m[which[a:z], token[a:z] - lo] = 1
        out += m @ m.T
    return out


def block_links(cls: list[int], sets: list[np.ndarray], orders: Orders, asked: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the links among the classes of a task.

    ``asked``: which classes ask; pairs of two that do not are left out. Sets ascend.
    """
    n = np.array([len(s) for s in sets])
    fit = 100 * np.minimum.outer(n, n) >= orders.percent * np.maximum.outer(n, n)
    if asked is not None:
        fit &= np.logical_or.outer(asked, asked)
    np.fill_diagonal(fit, False)
    least = shared_least(np.minimum.outer(n, n))
    prefixes = [orders.prefixes(s) for s in sets]
    both = None
    for k in range(ORDERS):
        if not fit.any():
            return []
        both = _products([p[k] for p in prefixes])
        fit &= both >= least
    root = list(range(len(n)))

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    a, b = np.nonzero(np.triu(fit, 1))
    for k in np.argsort(-both[a, b] / np.maximum(n[a], n[b]), kind="stable"):  # the likeliest first
        i, j = int(a[k]), int(b[k])
        x, y = top(i), top(j)
        if x == y:
            continue
        shared = int(_held(sets[i], sets[j]))
        if 100 * shared >= orders.percent * (n[i] + n[j] - shared):
            root[x] = y
            out.append((cls[i], cls[j]))
    return out


def _held(a: np.ndarray, b: np.ndarray) -> int:
    """Tokens that two ascending sets share."""
    a, b = (a, b) if len(a) <= len(b) else (b, a)
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    return int((b[at] == a).sum())


def _small(listed: DataFrame) -> DataFrame:
    """Broadcast up to a bound, so that what it is joined with stays where it lies."""
    return F.broadcast(listed) if listed.count() <= BROADCAST_IDS else listed


def similar(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = WIDTH, percent: int = PERCENT, small: int = SMALL, salt: int = 0) -> DataFrame:
    """doc_id, n_shingles, component_id, class_id of every row of docs."""
    spark = docs.sparkSession
    context = spark.sparkContext
    narrow = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"), F.xxhash64(text).alias("version"))
    # A row by which the text of a class is found again: null ids spread by their texts.
    key = F.coalesce("id", F.lit(-(2**63)))
    orders = context.broadcast(Orders(*heavy_tokens(narrow.select("text"), width, salt), percent))  # at most HEAVY entries
    rows, _ = written(classify(narrow, orders, width, salt), "classes")
    classes, _ = written(rows.where("cls is not null").groupBy("cls").agg(F.min("id").alias("first"), F.max(F.struct(key.alias("id"), "version")).alias("at"), F.max("n").alias("n"), (F.min("proof") != F.max("proof")).alias("clash")), "class")
    if classes.where("clash").limit(1).count():  # two sets of one 64-bit class: hash anew
        return similar(docs, text, doc_id, width, percent, small, salt + 1)

    # Tokens that several classes hold in their prefixes. A class met in several tasks
    # comes several times, so m may count too many: then a token counts as held by more.
    by_token = Window.partitionBy("token")
    posted = rows.where("prefix is not null").select("cls", "n", F.explode("prefix").alias("token"))
    held = posted.withColumn("least", F.min("cls").over(by_token)).withColumn("most", F.max("cls").over(by_token)).withColumn("m", F.count("*").over(by_token))
    shared, postings = written(held.where("least <> most").select("token", "cls", "n", "m").distinct(), "postings")
    few, many = shared.where(F.col("m") <= small), shared.where(F.col("m") > small)
    hot = many.groupBy("cls").agg(F.count("*").alias("hot"))
    known = few.join(hot, "cls", "left").select("token", "cls", "n", F.coalesce("hot", F.lit(0)).alias("hot"))
    a, b = (known.select(*[F.col(c).alias(f"{c}_{x}") for c in known.columns]) for x in "ab")
    near = (F.col("token_a") == F.col("token_b")) & (F.col("cls_a") < F.col("cls_b")) & (100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
    found = a.join(b, near).groupBy(F.col("cls_a").alias("a"), F.col("cls_b").alias("b")).agg(F.count("*").alias("found"), F.first(F.least("n_a", "n_b")).alias("n"), F.first(F.least("hot_a", "hot_b")).alias("hot"))
    enough = F.greatest(F.lit(1), 1 + F.floor(F.col("n") / SHARED) - F.col("hot"))
    pairs = found.where(F.col("found") >= enough).select("a", "b")
    # A partner may have as few as percent of the tokens, and so a lesser l.
    dense = many.join(hot, "cls").where(F.col("hot") >= 1 + F.floor(F.floor(F.col("n") * percent / 100) / SHARED)).select("token", "cls")
    first, _ = written(dense.groupBy("token").agg(F.min("cls").alias("a")), "least")  # written, so that the join can split
    groups = components(pairs.union(dense.join(first, "token").where("a <> cls").select("a", F.col("cls").alias("b")).distinct()))
    sized = groups.join(classes, F.col("node") == F.col("cls")).select("root", "node", "n")
    blocks = sized.groupBy(F.col("root").alias("r")).agg(F.greatest(F.ceil(F.count("*") / BLOCK_CLASSES), F.ceil(F.sum("n") / BLOCK_TOKENS)).cast("int").alias("blocks"))
    placed, blocked = written(sized.join(blocks, F.col("root") == F.col("r")).select(F.col("node").alias("cls"), "root", "blocks", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block")), "blocks")

    # The sets of the classes that are compared at all, from one text of each, with group and
    # block: so sets meet their tasks without a shuffle of their own.
    wanted, asked = written(classes.join(placed.select(F.col("cls").alias("want"), "root", "block"), F.col("cls") == F.col("want")).select(F.col("at.id").alias("k"), F.col("at.version").alias("v"), "want", "root", "block"), "wanted")
    texts = narrow.join(_small(wanted), (key == F.col("k")) & (F.col("version") == F.col("v"))).select("want", "text", "root", "block")

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # rows of one id and text come once from a task
        for batch in batches:
            want, at, sets = batch.column(0).to_pylist(), [], []
            for k, s in token_sets(batch.column(1), width, salt):
                if want[k] not in seen and len(s) and digest(s)[0] == want[k]:
                    seen.add(want[k])
                    at.append(k)
                    sets.append(s.tobytes())
            kept = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([*[batch.column(c).take(kept) for c in (0, 2, 3)], pa.array(sets, pa.binary())], names=["cls", "root", "block", "tokens"])

    # Not made distinct: a class comes once from a task, and a comparison takes it once.
    sets, held_sets = written(map_batches(texts, gather, "cls long, root long, block int, tokens binary"), "sets")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        o = orders.value
        now, cls, held, asks = None, [], [], []

        def links() -> pa.RecordBatch:
            found = block_links(cls, held, o, np.array(asks)) if len(cls) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], names=["a", "b"])

        for batch in batches:
            roots, i, j, asking, names = (batch.column(k).to_pylist() for k in range(5))
            for k, (task, ask, name) in enumerate(zip(zip(roots, i, j, strict=True), asking, names, strict=True)):
                if task != now:
                    if len(cls) > 1:
                        yield links()
                    now, cls, held, asks = task, [], [], []
                if cls and cls[-1] == name:  # come twice, or one that asks in its own block
                    asks[-1] = asks[-1] or ask
                    continue
                cls.append(name)
                asks.append(ask)
                held.append(np.frombuffer(batch.column(5)[k].as_py(), np.uint64))
        yield links()

    def compared(met: DataFrame) -> DataFrame:
        """Links among the classes of each task (root, i, j) that involve one that asks."""
        task = ["root", "i", "j"]
        tasks = met.select(*task, "ask", "cls", "tokens").repartition(*task).sortWithinPartitions(*task, "cls")
        return map_batches(tasks, compare, "a long, b long")

    yes, no = F.lit(True).alias("ask"), F.lit(False).alias("ask")
    own = sets.select("root", F.col("block").alias("i"), F.col("block").alias("j"), yes, "cls", "tokens")
    wide = placed.where("blocks > 1")
    done = [postings, blocked, asked, held_sets]
    if not wide.limit(1).count():  # every group is one block, compared with itself
        roots = components(compared(own))
    else:
        # Each block with itself and the pivots of its group.
        pivots = [F.min(F.struct(F.xxhash64("cls", F.lit(f"pivot {k}")), "cls"))["cls"] for k in range(PIVOTS)]
        first_few = wide.groupBy("root").agg(F.array_distinct(F.array(*pivots)).alias("cls"), F.first("blocks").alias("blocks"))
        chosen, few_path = written(first_few.select(F.explode("cls").alias("pivot"), "blocks"), "pivots")
        spread = sets.join(_small(chosen), F.col("cls") == F.col("pivot")).select("root", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("i"), "cls", "tokens")
        inside, links_a = written(compared(own.unionByName(spread.select("root", "i", F.col("i").alias("j"), yes, "cls", "tokens"))), "links")
        # What is not in the largest component of its group then meets all blocks of the group.
        part = components(inside).select(F.col("node").alias("n"), F.col("root").alias("p"))
        parts, partly = written(wide.join(part, F.col("cls") == F.col("n"), "left").select("cls", "root", "blocks", "block", F.coalesce("p", "cls").alias("part")), "parts")
        sizes = parts.groupBy("root", "part").agg(F.count("*").alias("size"))
        largest, _ = written(sizes.groupBy(F.col("root").alias("r")).agg(F.max(F.struct("size", "part"))["part"].alias("most")), "largest")
        loose = parts.join(largest, F.col("root") == F.col("r")).where("part <> most").drop("r", "most")
        many, _ = written(loose.groupBy(F.col("root").alias("r")).agg(F.ceil(F.count("*") / BLOCK_CLASSES).cast("int").alias("asking")), "asking")
        outside, outer = written(loose.join(many, F.col("root") == F.col("r")).select("cls", "root", "blocks", F.pmod(F.xxhash64("cls", F.lit("ask")), F.col("asking")).cast("int").alias("i")), "outside")
        met = sets.join(_small(many), F.col("root") == F.col("r"))  # sets of such groups only
        asked_of = met.select("root", F.explode(F.sequence(F.lit(0), F.col("asking") - 1)).alias("i"), F.col("block").alias("j"), no, "cls", "tokens")
        asks = met.join(_small(outside.select(F.col("cls").alias("asker"), "blocks", "i")), F.col("cls") == F.col("asker"))
        asking = asks.select("root", "i", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("j"), yes, "cls", "tokens")
        roots = components(inside.unionByName(compared(asking.unionByName(asked_of))))
        done += [links_a, partly, outer, few_path]
    for path in done:  # the links are written; nothing reads these again
        forget(spark, path)
    labelled = classes.join(roots, F.col("cls") == F.col("node"), "left").select("cls", "first", F.coalesce("root", "cls").alias("root"))
    least = labelled.groupBy(F.col("root").alias("r")).agg(F.min("first").alias("component_id"))
    # Written, so that the join reads both sides from shuffles of their own and can split the
    # task of a class that very many rows share.
    named, _ = written(labelled.join(least, F.col("root") == F.col("r")).select(F.col("cls").alias("class_id"), "component_id"), "named")
    joined = rows.where("cls is not null").join(named, F.col("cls") == F.col("class_id")).select("id", "n", "component_id", "class_id")
    alone = rows.where("cls is null").select("id", "n", F.col("id").alias("component_id"), F.lit(None).cast("long").alias("class_id"))
    return joined.union(alone).select(F.col("id").alias(doc_id), F.col("n").alias("n_shingles"), "component_id", "class_id")


def keep_first(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **options: int) -> DataFrame:
    """Of each group of linked documents, the one of the smallest id, once; all columns stay.

    Rows without tokens are linked with nothing and stay, as do rows without an id.
    """
    its = unused(docs, "id")[0]
    mine = F.col(doc_id) == F.col("component_id")
    found, _ = written(similar(docs, text, doc_id, **options).where(F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias(its)).agg(F.max(mine).alias("first"), F.count("*").alias("rows")), "kept")
    # Texts are shuffled once at any size and not sorted; the other side is ids.
    rows = docs.join(found.where("not first").select(its).hint("shuffle_hash"), F.col(doc_id) == F.col(its), "left_anti")
    # Rows of one id are one document here: the first in a fixed order stays.
    doubled, _ = written(found.where("first and rows > 1").select(its), "again")
    if not doubled.limit(1).count():
        return rows
    others = [c for c in docs.columns if c not in (text, doc_id)]
    order = F.struct(F.xxhash64(text), F.col(text), *([F.to_json(F.struct(*others))] if others else []))
    several = rows.join(doubled, F.col(doc_id) == F.col(its), "left_semi").groupBy(F.col(doc_id).alias(its)).agg(F.min_by(F.struct(*docs.columns), order).alias("row"))
    return rows.join(doubled, F.col(doc_id) == F.col(its), "left_anti").unionByName(several.select(*[F.col("row")[c].alias(c) for c in docs.columns]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_shingles", "component_id")


ORACLE = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS words FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(words) >= {WIDTH} THEN list_distinct(list_transform(range(len(words) - {WIDTH - 1}), lambda k: array_to_string(words[k + 1 : k + {WIDTH}], ' ')))
    WHEN len(words) > 0 THEN [array_to_string(words, ' ') || ' '] ELSE [] END AS shingles FROM w
), t AS (SELECT doc_id, CAST(len(shingles) AS BIGINT) AS n, unnest(shingles) AS shingle FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared, any_value(a.n) AS m, any_value(b.n) AS n FROM t a JOIN t b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM p WHERE 100 * shared >= {PERCENT} * (m + n - shared)),
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT a AS node, b AS other FROM edges UNION SELECT r.node, e.b FROM reach r JOIN edges e ON r.other = e.a)
SELECT s.doc_id, CAST(len(shingles) AS BIGINT) AS n_shingles, least(s.doc_id, coalesce(min(other), s.doc_id)) AS component_id
FROM s LEFT JOIN reach ON node = s.doc_id GROUP BY s.doc_id, len(shingles)
"""
