"""Minimum-cost-flow resharding: new shard sizes with the fewest bytes moved.

Old shards are cut into hash blocks, as many as their bytes call for, whose byte sums go to
the driver (a bounded table: old shards x blocks). A minimum-cost flow from old shards to new capacities, staying
at cost 0 and moving at cost 1 a byte, says how many bytes go where. Each old shard's
blocks, laid end to end, are then cut at those byte counts: a block that holds no cut
moves or stays as a whole, a block that holds one is cut between two rows. So only rows
of blocks change place that the flow moves, and shard sizes meet their capacities up to
one row at each cut. No task ever needs more than one block's rows together: rows are
dealt to blocks by id and text, and where equal rows still crowd a block, by a number that
is written with each row first.

``rewrite`` carries a plan out: what moves goes to new files of the shards it enters.

Law ``bytes``: shard sizes in bytes are near equal, up to the longest rows at the cuts.

Defined results: a null text has size 1 and checksum 0 as an empty one has; a null
doc_id is hashed as a value of its own, with the text; equal rows are rows of their own,
each with its slot; equal texts need not share a shard; a very long text is one row, which
is never split; an empty table gives an empty result; columns of the input named like an
output column are replaced, others stay, whatever their names.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.llm.common import new_path, table, unused, without, written

OLD_SHARDS, NEW_SHARDS = 12, 16
#: Hash blocks of an old shard: one for each so many bytes, within bounds. At the upper one
#: the driver holds 12 x 65536 sums; a block is then what one task sorts.
BLOCK_BYTES, LEAST_BLOCKS, MOST_BLOCKS = 256 << 20, 256, 1 << 16
#: Rows of a block, at least, that call for numbered rows.
CROWD = 10_000
OUT = ("size", "text_crc32", "law", "shard", "slot", "grown_shard", "old_shard", "block", "moved")


def min_cost_flow(supply: Sequence[int], capacity: Sequence[int], cost: Sequence[Sequence[int]]) -> list[list[int]]:
    """Flow f[s][t] of least cost that sends all supply within the capacities.

    Successive shortest paths with potentials over the bipartite graph source -> old ->
    new -> sink. Sizes are numbers of shards, never of rows.
    """
    n, m = len(supply), len(capacity)
    if sum(supply) > sum(capacity):
        raise ValueError("the capacities hold less than the shards")
    src, snk = n + m, n + m + 1
    to: list[int] = []
    room: list[int] = []
    price: list[int] = []
    out: list[list[int]] = [[] for _ in range(n + m + 2)]

    def edge(a: int, b: int, r: int, c: int) -> int:
        for x, y, z, w in ((a, b, r, c), (b, a, 0, -c)):
            out[x].append(len(to))
            to.append(y)
            room.append(z)
            price.append(w)
        return len(to) - 2

    for s in range(n):
        edge(src, s, supply[s], 0)
    flow = [[edge(s, n + t, supply[s], cost[s][t]) for t in range(m)] for s in range(n)]
    for t in range(m):
        edge(n + t, snk, capacity[t], 0)
    height, left = [0] * (n + m + 2), sum(supply)
    while left:
        dist: dict[int, int] = {src: 0}
        by: dict[int, int] = {}
        done: set[int] = set()
        heap = [(0, src)]
        while heap:
            d, a = heapq.heappop(heap)
            if a in done:
                continue
            done.add(a)
            for e in out[a]:
                if room[e] and (x := d + price[e] + height[a] - height[to[e]]) < dist.get(to[e], x + 1):
                    dist[to[e]], by[to[e]] = x, e
                    heapq.heappush(heap, (x, to[e]))
        for a, d in dist.items():
            height[a] += d
        path, a = [], snk
        while a != src:
            path.append(by[a])
            a = to[by[a] ^ 1]
        push = min(room[e] for e in path)
        for e in path:
            room[e] -= push
            room[e ^ 1] += push
        left -= push
    return [[room[e ^ 1] for e in row] for row in flow]


def even_capacities(total: int, shards: int) -> list[int]:
    return [total // shards + (t < total % shards) for t in range(shards)]


def transfers(sizes: dict[tuple[int, int], int], old: int, blocks: int, capacity: Sequence[int]) -> list[tuple[int, int, int, int, int]]:
    """Pieces (old shard, block, from byte, to byte, new shard); bytes count within the block.

    An old shard's first bytes stay where a new shard of its number exists.
    """
    supply = [sum(sizes.get((s, b), 0) for b in range(blocks)) for s in range(old)]
    flow = min_cost_flow(supply, capacity, [[int(s != t) for t in range(len(capacity))] for s in range(old)])
    pieces = []
    for s in range(old):
        ends, at = [], 0
        for t in sorted(range(len(capacity)), key=lambda t: (t != s, t)):
            if flow[s][t]:
                at += flow[s][t]
                ends.append((at, t))
        start, k = 0, 0
        for b in range(blocks):
            begin, stop = start, start + sizes.get((s, b), 0)
            while begin < stop:
                while ends[k][0] <= begin:
                    k += 1
                cut = min(stop, ends[k][0])
                pieces.append((s, b, begin - start, cut - start, ends[k][1]))
                begin = cut
            start = stop
    return pieces


def reshard(docs: DataFrame, new_shards: int, old_shard: Column | None = None, old_shards: int = OLD_SHARDS, capacity: Sequence[int] | None = None, blocks: int | None = None, text: str = "text", doc_id: str = "doc_id", slots: bool = True) -> DataFrame:
    """docs with size, text_crc32, law, shard, slot, grown_shard, old_shard and moved.

    ``old_shard``: where each row lies now (0 up to ``old_shards``); without it the rows
    count as hashed by doc_id. ``capacity``: bytes of each new shard; even by default.
    """
    spark = docs.sparkSession
    docs = without(docs, *OUT)
    held = docs.columns
    uid = unused(docs, "row")[0]
    middle_, ends_, first_, number_ = unused(docs.withColumn(uid, F.lit(0)), "middle", "ends", "first", "number")
    filled = F.coalesce(F.col(text), F.lit(""))
    spread = F.xxhash64(F.col(doc_id), F.lit("old shard"))
    checksum = F.crc32(filled.cast("binary"))
    if blocks is None:
        whole = docs.agg(F.coalesce(F.sum(F.octet_length(filled) + 1), F.lit(0))).first()[0]
        blocks = min(MOST_BLOCKS, max(LEAST_BLOCKS, -(-whole // (old_shards * BLOCK_BYTES))))

    def dealt(source: DataFrame, *more: Column) -> tuple[DataFrame, list]:
        rows = source.select(
            *held,
            *more,
            (F.octet_length(filled) + 1).cast("long").alias("size"),
            checksum.alias("text_crc32"),
            (old_shard if old_shard is not None else F.pmod(spread, F.lit(old_shards))).cast("int").alias("old_shard"),
            F.pmod(F.xxhash64(F.col(doc_id), checksum, *more, F.lit("block")), F.lit(blocks)).cast("int").alias("block"),
        )
        return rows, rows.groupBy("old_shard", "block").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).collect()  # at most old_shards x blocks rows

    rows, sums = dealt(docs)
    order = [F.xxhash64(F.col(doc_id), F.lit("row")), F.col(doc_id), F.col("size"), F.col("text_crc32")]
    if max((r.rows for r in sums), default=0) > max(CROWD, 8 * sum(r.rows for r in sums) // (old_shards * blocks)):
        # Equal rows: told apart by a number that is fixed by writing it.
        numbered, _ = written(docs.withColumn(uid, F.monotonically_increasing_id()), "numbered")
        if old_shard is None:  # a hash of the id alone keeps them in one old shard
            spread = F.xxhash64(F.col(doc_id), F.col(uid), F.lit("old shard"))
        rows, sums = dealt(numbered, F.col(uid))
        order.append(F.col(uid))
    sizes = {(r.old_shard, r.block): r.bytes for r in sums}
    total = sum(sizes.values())
    plan = transfers(sizes, old_shards, blocks, capacity or even_capacities(total, new_shards)) if total else []
    cuts: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
    for s, b, lo, hi, t in plan:
        cuts.setdefault((s, b), []).append((lo, hi, t))
    # A bounded table again: one row for each block, with its few cuts.
    where = spark.createDataFrame([(s, b, [(hi, t) for _, hi, t in c]) for (s, b), c in sorted(cuts.items())], f"old_shard int, block int, `{ends_}` array<struct<hi:long,to:int>>")
    inside = Window.partitionBy("old_shard", "block").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # The row's middle byte, doubled to stay whole: which piece it falls into.
    middle = 2 * F.sum("size").over(inside) - F.col("size")
    placed = (
        rows.join(F.broadcast(where), ["old_shard", "block"])
        .withColumn(middle_, middle)
        .withColumn("shard", F.filter(ends_, lambda x: x["hi"] * 2 > F.col(middle_))[0]["to"].cast("int"))
        .withColumn("moved", F.col("shard") != F.col("old_shard"))
        .withColumn("law", F.lit("bytes"))
        .withColumn("grown_shard", F.lit(None).cast("int"))
    )
    if not slots:
        return placed.select(*held, "size", "text_crc32", "law", "shard", "grown_shard", "old_shard", "block", "moved")
    # Slots: rows of a (block, shard) piece are numbered there and start where the
    # pieces before it in that shard end. The pieces are few (blocks plus cuts).
    whole = {k: c[0][2] for k, c in cuts.items() if len(c) == 1}
    split = sorted(k for k, c in cuts.items() if len(c) > 1)
    counts = {(s, b, whole[s, b]): r.rows for r in sums for s, b in [(r.old_shard, r.block)] if (s, b) in whole}
    if split:
        some = spark.createDataFrame(split, "old_shard int, block int")
        narrow = rows.select(doc_id, *[c for c in rows.columns if c == uid], "size", "text_crc32", "old_shard", "block").join(F.broadcast(some), ["old_shard", "block"])
        for r in (
            narrow.join(F.broadcast(where), ["old_shard", "block"])
            .withColumn(middle_, middle)
            .withColumn("shard", F.filter(ends_, lambda x: x["hi"] * 2 > F.col(middle_))[0]["to"])
            .groupBy("old_shard", "block", "shard")
            .count()
            .collect()
        ):
            counts[r.old_shard, r.block, r.shard] = r["count"]
    at = [0] * new_shards
    starts = []
    for s, b, t in sorted(counts):
        starts.append((s, b, t, at[t]))
        at[t] += counts[s, b, t]
    first = spark.createDataFrame(starts, f"old_shard int, block int, shard int, `{first_}` long")
    number = Window.partitionBy("old_shard", "block", "shard").orderBy(*order)
    return (
        placed.withColumn(number_, F.row_number().over(number))
        .join(F.broadcast(first), ["old_shard", "block", "shard"])
        .withColumn("slot", (F.col(first_) + F.col(number_) - 1).cast("long"))
        .select(*held, "size", "text_crc32", "law", "shard", "slot", "grown_shard", "old_shard", "block", "moved")
    )


def affected(placed: DataFrame) -> list[int]:
    """Shards that win or lose a row; at most the old ones and the new ones."""
    ends = placed.where("moved").select(F.explode(F.array("shard", "old_shard")).alias("shard"))
    return sorted(r.shard for r in ends.distinct().collect())


def rewrite(placed: DataFrame, path: str) -> list[int]:
    """Carries a plan out: writes the files that change, a folder a shard; gives their shards.

    Rows that move go to new files of the shards they enter; the files of an old shard that
    loses rows are written without those rows; shards that neither win nor lose a row are left
    alone. Each task writes the blocks it holds, most of which go to one shard, so rows are
    not shuffled again.
    """
    touched = affected(placed)
    placed.where(F.col("shard").isin(touched)).write.option("maxRecordsPerFile", 1_000_000).partitionBy("shard").mode("overwrite").parquet(path)
    return touched


def after_rewrite(placed: DataFrame, shards: int) -> DataFrame:
    """The rows of all shards once the plan is carried out: those rewritten as their files hold them."""
    spark = placed.sparkSession
    path = new_path(spark, "shards")
    touched = rewrite(placed, path)
    found = spark.read.schema(placed.schema).parquet(path).select(*placed.columns)
    if set(touched) >= set(range(shards)):
        return found
    return found.unionByName(placed.where(~F.col("shard").isin(touched)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = after_rewrite(reshard(docs, NEW_SHARDS), NEW_SHARDS)
    size, checksum = (F.octet_length(F.coalesce("text", F.lit(""))) + 1).cast("long"), F.crc32(F.coalesce("text", F.lit("")).cast("binary"))
    return done.select("doc_id", size.alias("size"), checksum.alias("text_crc32"), "law", "shard", "slot", "grown_shard", "old_shard", "moved")
