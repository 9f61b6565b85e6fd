"""Mixing sources to target weights by weighted fair queueing; DataFrame functions only.

Every document of a source, in a shuffled (hashed) order and up to three times, gets a
virtual finish time: the source's words so far divided by the source's target. The mix
is what finishes first, cut off where it would exceed the total budget.

Rows equal in source, id and text finish together, so they are counted first and travel as
one. The words so far come in two steps, so that no source meets in one task: sums of hash
blocks of a source, running sums over these (a bounded number for each source), and a
window inside each block. The cut is found likewise. Documents that finish by time 1 hold
at most the budget, as each source then stays within its target; after time 1, words are
summed over ranges of the finish time, the range in which the budget is reached is divided
again until it is small, and an exact running sum is taken inside it.

Texts are read twice and never shuffled: ``schedule`` shuffles ids and sizes and gives,
beside each document's copies, one cut for each source; ``apply`` compares each document
with its source's cut.

Targets: sources in order of code points, null last, weigh 5, 2, 1, 5, ...; they share
all words; a target stops at three times its source's size and the excess goes to the
others by weight. That is filling by one common level: target = min(3 x size, level x
weight). Sources are numbered by a range sort and the level is raised by aggregates until
no further source is full, so no task holds all sources.

Defined results: a null or blank text has size 0, takes 0 and is not in the mix; a null
source is a source of its own; a null doc_id is hashed as a value of its own, with the
text, so that many of them spread; rows equal in doc_id and text finish together; a source
without words has target 0; a very long text is counted and hashed in place; an empty table
gives an empty result; extra columns stay in ``apply``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.llm.common import WORD, table, unused, written

WEIGHTS, REPEATS, BLOCKS, RANGES = (5, 2, 1), 3, 1024, 8192
#: Up to so many sources, the table of cuts (one short row for each) is broadcast.
BROADCAST_SOURCES = 50_000
SALTS = 64
#: Finish times that one task may sum in order; equal rows that one row becomes in a step.
NEAR, EQUAL = 1 << 16, 1024
KEY = ("key", "id", "tie")


def _numbered(sizes: DataFrame) -> DataFrame:
    """Sources with their number from 0, in order of code points, null last."""
    by = F.col("source").asc_nulls_last()
    dealt, _ = written(sizes.repartitionByRange(by).withColumn("part", F.spark_partition_id()), "sources")
    # As many rows as partitions: sources of the parts before.
    before = dealt.groupBy("part").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    inside = F.row_number().over(Window.partitionBy("part").orderBy(by)) - 1
    return dealt.join(F.broadcast(before), "part").select("source", "source_size", (F.col("before") + inside).alias("number"))


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """(source, source_size) to (source, source_size, target). One row for each source."""
    kinds = F.array(*[F.lit(float(w)) for w in weights])
    ranked, _ = written(
        _numbered(sizes)
        .withColumn("weight", F.element_at(kinds, (F.pmod("number", F.lit(len(weights))) + 1).cast("int")))
        .withColumn("cap", (F.col("source_size") * repeats).cast("double"))
        .withColumn("full_at", F.col("cap") / F.col("weight")),
        "ranked",
    )
    level, closed = None, -1
    while True:  # each step closes a source more; a level never falls
        full = F.lit(False) if level is None else F.col("full_at") < level
        x = ranked.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("all"), F.coalesce(F.sum(F.when(full, F.col("cap"))), F.lit(0.0)).alias("caps"), F.sum(F.when(~full, F.col("weight"))).alias("open"), F.count(F.when(full, 1)).alias("closed")).first()
        if x.closed == closed or not x.open:
            break
        level, closed = (x["all"] - x.caps) / x.open, x.closed
    return ranked.select("source", "source_size", F.col("cap").alias("target") if level is None else F.least("cap", F.lit(level) * F.col("weight")).alias("target"))


@dataclass(frozen=True)
class Schedule:
    #: doc_id, source, size, source_size, target, copies, taken of every document.
    rows: DataFrame
    #: source, source_size, target, epoch and key of the last document taken.
    cuts: DataFrame
    n_sources: int
    blocks: int


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.shiftright(key, 20), F.lit(blocks)).cast("int")


def _keys(doc_id: str, text: str) -> list[Column]:
    """The order in which a source's documents are drawn: a hash of id and text, then ties."""

    def number(digest: Column) -> Column:
        return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")

    said = F.md5(F.coalesce(F.col(text), F.lit("")))
    both = F.md5(F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("null")), F.lit(":"), said))
    return [number(both).alias("key"), F.col(doc_id).alias("id"), number(said).alias("tie")]


def schedule(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", weights: Sequence[int] = WEIGHTS, repeats: int = REPEATS, blocks: int = BLOCKS) -> Schedule:
    size = F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)).cast("long").alias("size")
    drawn = docs.select(F.col(source).alias("source"), size, *_keys(doc_id, text))
    narrow, _ = written(drawn.groupBy("source", *KEY, "size").agg(F.count("*").alias("n")), "mix")
    narrow = narrow.withColumn("block", _block(F.col("key"), blocks))
    words = F.col("size") * F.col("n")
    blocked = narrow.groupBy("source", "block").agg(F.sum(words).alias("block_size"))
    by_source = targets(blocked.groupBy("source").agg(F.sum("block_size").alias("source_size")), weights, repeats)
    upto = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        blocked.withColumn("before", F.coalesce(F.sum("block_size").over(upto), F.lit(0)))
        .join(by_source.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
        .select(F.col("source").alias("s"), F.col("block").alias("b"), "before", "source_size", "target")
    )
    inside = Window.partitionBy("source", "block").orderBy(*KEY).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    timed, _ = written(
        narrow.withColumn("sum", F.sum(words).over(inside))
        .join(starts, F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b")))
        .withColumn("at", F.col("before") + F.col("sum"))
        .select("source", "block", *KEY, "size", "n", "source_size", "target", "at"),
        "mix-timed",
    )
    finish = F.array(*[F.when((F.col("target") > 0) & (F.col("size") > 0), (F.col("at") + F.col("source_size") * e) / F.col("target")) for e in range(repeats)])
    timed = timed.withColumn("finish", finish)
    first = timed.agg(
        F.coalesce(F.sum(words), F.lit(0)).alias("budget"),
        F.coalesce(F.sum(words * F.size(F.filter("finish", lambda f: f <= 1))), F.lit(0)).alias("early"),
    ).first()
    last = _last_finish(timed.select(words.alias("words"), F.explode("finish").alias("f")).where("f > 1"), first.early, first.budget)
    copies = F.size(F.filter("finish", lambda f: f <= last))
    # Equal rows part again, a bounded number from one row of a step.
    parts = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / EQUAL)))
    each = F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(EQUAL), F.col("n") - F.col("part") * EQUAL)))
    rows = timed.withColumn("copies", copies).withColumn("part", parts).withColumn("one", each)
    rows = rows.select("source", "block", *KEY, "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))
    cuts, _ = written(
        timed.withColumn("copies", copies).groupBy("source").agg(F.max(F.when(F.col("copies") > 0, F.struct("copies", "block", *KEY))).alias("last"), F.first("source_size").alias("source_size"), F.first("target").alias("target")),
        "mix-cuts",
    )
    return Schedule(rows, cuts, cuts.count(), blocks)


def _last_finish(late: DataFrame, spent: int, budget: int) -> float:
    """The last finish time at which the words of all that finish by then fit the budget.

    ``late``: words and finish times f after time 1; ``spent``: words that finish before.
    """
    rows, last = late, 1.0
    ranges = F.when(F.col("f") <= 2, F.ceil((F.col("f") - 1) * RANGES)).otherwise(RANGES + F.ceil(F.log2("f") * 512))
    while True:
        reached = None
        dealt = rows.withColumn("r", ranges)
        for r in dealt.groupBy("r").agg(F.sum("words").alias("words"), F.count("*").alias("n"), F.min("f").alias("lo"), F.max("f").alias("hi")).orderBy("r").toLocalIterator():  # a bounded number of ranges
            if spent + r.words > budget:
                reached = r
                break
            spent, last = spent + r.words, r.hi
        if reached is None:
            return float("inf") if rows is late else last
        rows = dealt.where(F.col("r") == reached.r).drop("r")
        if reached.n <= NEAR or reached.lo == reached.hi:
            break
        ranges = F.floor((F.col("f") - reached.lo) / (reached.hi - reached.lo) * RANGES)
    # Few rows, or one finish time: summed by time, then in order.
    order = Window.orderBy("f").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    fits = rows.groupBy("f").agg(F.sum("words").alias("words")).withColumn("upto", F.sum("words").over(order)).where(F.col("upto") + spent <= budget)
    return max(last, fits.agg(F.max("f")).first()[0] or last)


def apply(docs: DataFrame, plan: Schedule, text: str = "text", source: str = "source", doc_id: str = "doc_id") -> DataFrame:
    """The mix: every document as often as it is taken, with the columns of docs."""
    held = docs.columns
    salts = 1 if plan.n_sources <= BROADCAST_SOURCES else SALTS
    its, last, salt, key, mine, n, copy = unused(docs, "s", "last", "salt", "key", "mine", "n", "copy")
    cuts = plan.cuts.where("last is not null").select(F.col("source").alias(its), F.col("last").alias(last), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias(salt))
    drawn = _keys(doc_id, text)
    keyed = docs.withColumn(key, F.struct(_block(drawn[0], plan.blocks).alias("block"), *drawn)).withColumn(mine, F.pmod(F.col(key)["key"], F.lit(salts)).cast("int"))
    joined = keyed.join(F.broadcast(cuts) if salts == 1 else cuts, F.col(source).eqNullSafe(F.col(its)) & (F.col(mine) == F.col(salt)))
    taken = F.col(last)["copies"] - F.when(F.col(key) <= F.struct(*[F.col(last)[k].alias(k) for k in ("block", *KEY)]), 0).otherwise(1)
    some = F.coalesce(F.col(text), F.lit("")).rlike(WORD)
    return joined.withColumn(n, F.when(some, taken).otherwise(0)).where(F.col(n) > 0).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(n)))).select(*held)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return schedule(docs).rows.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", "source", "copies")


ORACLE = f"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || md5(coalesce(text, ''))), 1, 15) AS BIGINT) AS key, CAST('0x' || substr(md5(coalesce(text, '')), 1, 15) AS BIGINT) AS tie
  FROM documents
), s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, [{', '.join(f'{x}.0::DOUBLE' for x in WEIGHTS)}][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} + 1] AS weight, CAST({REPEATS} * source_size AS DOUBLE) AS cap FROM s),
v AS (SELECT *, cap / weight AS full_at, row_number() OVER (ORDER BY cap / weight, source NULLS LAST) AS n FROM w),
l AS (SELECT *, ((SELECT CAST(sum(source_size) AS DOUBLE) FROM s) - coalesce(sum(cap) OVER (ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM v),
t AS (SELECT source, source_size, CASE WHEN (SELECT count(*) FROM l WHERE full_at >= level) = 0 THEN cap ELSE least(cap, (SELECT arg_min(level, n) FROM l WHERE full_at >= level) * weight) END AS target FROM l),
a AS (
  SELECT d.*, source_size, target, sum(size) OVER (PARTITION BY d.source ORDER BY (key >> 20) % {BLOCKS}, key, doc_id NULLS FIRST, tie) AS upto
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), e AS (SELECT *, epoch, CASE WHEN target > 0 AND size > 0 THEN CAST(upto + source_size * epoch AS DOUBLE) / target END AS f FROM a, (SELECT unnest(range({REPEATS})) AS epoch)),
c AS (SELECT f, sum(sum(size)) OVER (ORDER BY f) AS spent FROM e WHERE f IS NOT NULL GROUP BY f),
cut AS (SELECT greatest(1.0, coalesce(max(f), 0.0)) AS last FROM c WHERE spent <= (SELECT sum(size) FROM d))
SELECT doc_id, size, source_size, target, CAST(size * count(*) FILTER (f <= (SELECT last FROM cut)) AS BIGINT) AS taken, source, CAST(count(*) FILTER (f <= (SELECT last FROM cut)) AS INTEGER) AS copies
FROM e GROUP BY doc_id, key, tie, size, source_size, target, source, upto
"""
