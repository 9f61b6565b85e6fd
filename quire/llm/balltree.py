"""Exact top-k inner product search: ball trees per shard, branch and bound.

Vectors are dealt to shards by the nearest of a few pivots, taken from a bounded sample,
and by hash within a pivot's rows, so that a shard is a ball of bounded rows whatever the
data. Each shard becomes a ball tree, built once and written to the shared folder as one
row, with its root's centre and radius beside it.

Only roots meet all queries, in blocks. Each query first searches the shard with the highest
bound q.c + |q| r; its k-th score there is the floor that all else starts from. A tree is
then sent to those blocks alone that hold queries whose bound for its root reaches their
floor. In a tree each query takes nodes in the order of its own bounds, one leaf first, then
twice as many at each step, and drops those that its k-th score, raised as it goes, rules
out. A node whose bound equals the k-th score is still opened, so ties to smaller ids are
kept.

Scores are integer: components are floor(scale * x), products and sums exact in double
up to 2**53 and taken in Python's integers beyond that (the nearest 64-bit one is given).

Defined results: a vector that is null or holds a null or non-finite component takes no
part, nor does a row without id; shorter vectors count as padded with zeros (so an empty
one scores 0); rows of the same id are candidates each, but never of that id's query, and
such a query is the row with the smallest vector; equal scores go to the smaller id; fewer
than k candidates give fewer rows; extra columns are ignored; an empty table gives an empty
result.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.llm.common import table, written

SCALE, TOP, EVERY = 256, 5, 50
SHARD_ROWS, BLOCK_ROWS, LEAF = 8192, 1024, 128
#: Rows that the pivots are taken from, pivots, and roots of a block, at most.
SAMPLE, PIVOTS, ROOTS = 2048, 32, 4096


@dataclass
class Tree:
    ids: np.ndarray  # of all rows, in leaf order
    rows: np.ndarray  # vectors in that order
    lo: np.ndarray  # first row of each node
    hi: np.ndarray
    left: np.ndarray  # children, or -1
    right: np.ndarray
    centre: np.ndarray
    radius: np.ndarray

    @property
    def leaves(self) -> np.ndarray:
        return np.flatnonzero(self.left < 0)


def build(ids: np.ndarray, rows: np.ndarray, leaf: int = LEAF) -> Tree:
    """Splits by the axis between two far points, at the median, until leaves are small."""
    order = np.lexsort((ids,))
    ids, rows = ids[order], rows[order]
    place = np.arange(len(ids))
    lo, hi, left, right, centre, radius = [0], [len(ids)], [-1], [-1], [None], [0.0]
    todo = [0]
    while todo:
        k = todo.pop()
        part = rows[place[lo[k] : hi[k]]]
        c = part.mean(axis=0)
        far = np.sqrt(np.maximum(((part - c) ** 2).sum(axis=1), 0))
        centre[k], radius[k] = c, float(far.max())
        if hi[k] - lo[k] <= leaf:
            continue
        a = part[int(far.argmax())]
        b = part[int(((part - a) ** 2).sum(axis=1).argmax())]
        along = part @ (b - a)
        by = np.argsort(along, kind="stable")
        place[lo[k] : hi[k]] = place[lo[k] : hi[k]][by]
        mid = (lo[k] + hi[k]) // 2
        for at, (x, y) in (("l", (lo[k], mid)), ("r", (mid, hi[k]))):
            lo.append(x)
            hi.append(y)
            left.append(-1)
            right.append(-1)
            centre.append(None)
            radius.append(0.0)
            todo.append(len(lo) - 1)
            if at == "l":
                left[k] = len(lo) - 1
            else:
                right[k] = len(lo) - 1
    return Tree(ids[place], rows[place], np.array(lo), np.array(hi), np.array(left), np.array(right), np.array(centre), np.array(radius))


class Best:
    """The k best (score, id) of each query so far, and the floor they start from."""

    def __init__(self, queries: np.ndarray, ids: np.ndarray, floor: np.ndarray, k: int) -> None:
        self.q, self.own, self.k = queries, ids, k
        self.scores = np.full((len(ids), k), -np.inf)
        self.ids = np.full((len(ids), k), np.iinfo(np.int64).max)
        self.floor = floor.copy()

    def kth(self) -> np.ndarray:
        return np.maximum(self.floor, self.scores[:, -1])

    def offer(self, who: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        s = self.q[who] @ rows.T
        s[self.own[who][:, None] == ids[None, :]] = -np.inf
        # Rows of a leaf come ordered by id below; only those at or above the k-th score matter.
        useful = np.flatnonzero((s >= self.kth()[who][:, None]).any(axis=1))
        if not len(useful):
            return
        who, s = who[useful], s[useful]
        both = np.concatenate([self.scores[who], s], axis=1)
        names = np.concatenate([self.ids[who], np.broadcast_to(ids, s.shape)], axis=1)
        order = np.lexsort((names, -both), axis=1)[:, : self.k]
        self.scores[who] = np.take_along_axis(both, order, axis=1)
        self.ids[who] = np.take_along_axis(names, order, axis=1)


def bounds(tree: Tree, nodes: np.ndarray, queries: np.ndarray, norms: np.ndarray) -> np.ndarray:
    """The most that a row of each node can score for each query, with room for rounding."""
    reach = norms[:, None] * tree.radius[nodes][None, :]
    top = queries @ tree.centre[nodes].T + reach
    return top + 1e-9 * (np.abs(top) + norms[:, None] * (np.linalg.norm(tree.centre[nodes], axis=1)[None, :] + tree.radius[nodes][None, :])) + 1e-6


def search(tree: Tree, best: Best) -> int:
    """Branch and bound over the tree for all queries of a block; gives the rows scored.

    A leaf's bound is the least of those of its ancestors and its own.
    """
    norms = np.linalg.norm(best.q, axis=1)
    ub = bounds(tree, np.arange(len(tree.lo)), best.q, norms)
    for node in range(len(tree.lo)):  # children have higher numbers than their parents
        for child in (tree.left[node], tree.right[node]):
            if child >= 0:
                np.minimum(ub[:, child], ub[:, node], out=ub[:, child])
    leaves = tree.leaves
    ub = ub[:, leaves]
    order = np.argsort(-ub, axis=1, kind="stable")
    scored, start, width = 0, 0, 1
    while start < len(leaves):
        ahead = order[:, start : start + width]
        live = np.take_along_axis(ub, ahead, axis=1) >= best.kth()[:, None]
        if not live.any():
            break
        for leaf in np.unique(ahead[live]):
            who = np.flatnonzero((live & (ahead == leaf)).any(axis=1))
            who = who[ub[who, leaf] >= best.kth()[who]]
            if len(who):
                lo, hi = tree.lo[leaves[leaf]], tree.hi[leaves[leaf]]
                scored += len(who) * int(hi - lo)
                best.offer(who, tree.ids[lo:hi], tree.rows[lo:hi])
        start, width = start + width, 2 * width
    return scored


def pivots(sample: np.ndarray, most: int) -> np.ndarray:
    """Rows of the sample that lie far from each other: the farthest from all before, first."""
    if not len(sample):
        return sample
    picked = [0]
    far = ((sample - sample[0]) ** 2).sum(axis=1)
    while len(picked) < most and far.max() > 0:
        picked.append(int(far.argmax()))
        far = np.minimum(far, ((sample - sample[picked[-1]]) ** 2).sum(axis=1))
    return sample[picked]


def _matrix(column: pd.Series) -> np.ndarray:
    rows = [np.asarray(x, dtype=np.float64) for x in column]
    wide = max((len(x) for x in rows), default=0)
    out = np.zeros((len(rows), max(1, wide)))
    for k, x in enumerate(rows):
        out[k, : len(x)] = x
    return out


def _even(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    wide = max(a.shape[1], b.shape[1])
    return np.pad(a, ((0, 0), (0, wide - a.shape[1]))), np.pad(b, ((0, 0), (0, wide - b.shape[1])))


def top_k(vectors: DataFrame, every: int = EVERY, k: int = TOP, scale: int = SCALE, vec_id: str = "vec_id", embedding: str = "embedding", shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score of the k best rows for each id divisible by ``every``."""
    spark = vectors.sparkSession
    whole = F.transform(F.col(embedding), lambda x: F.floor(x.cast("double") * scale).cast("double"))
    fine = F.col(vec_id).isNotNull() & F.col(embedding).isNotNull() & ~F.exists(F.col(embedding), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.where(fine).select(F.col(vec_id).cast("long").alias("id"), whole.alias("v"))
    asked = rows.where(F.pmod("id", F.lit(every)) == 0).groupBy("id").agg(F.min("v").alias("v"))
    # A bounded sample gives the pivots; every row goes to the nearest one.
    sample = rows.orderBy(F.xxhash64("id", F.lit("sample")), "id", "v").limit(SAMPLE).toPandas()
    around = pivots(_matrix(sample["v"]), PIVOTS) if len(sample) else np.zeros((1, 1))

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            v, c = _even(_matrix(part["v"]), around)
            yield part.assign(pivot=((c**2).sum(axis=1) - 2 * v @ c.T).argmin(axis=1).astype(np.int32) if len(part) else np.zeros(0, np.int32))

    dealt, _ = written(rows.mapInPandas(near, "id long, v array<double>, pivot int"), "dealt")
    held = {r.pivot: r["count"] for r in dealt.groupBy("pivot").count().collect()}  # one row for each pivot
    parts, first = {}, 0
    for p in sorted(held):
        parts[p] = (first, max(1, -(-held[p] // shard_rows)))
        first += parts[p][1]
    shards, blocks = max(1, first), max(1, -(-asked.count() // block_rows))
    number = F.lit(0)
    for p, (at, n) in parts.items():
        number = F.when(F.col("pivot") == p, at + F.pmod(F.xxhash64("id", F.lit("shard")), F.lit(n))).otherwise(number)

    def grow(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        tree = build(part["id"].to_numpy(np.int64), _matrix(part["v"]))
        return pd.DataFrame({"shard": [key[0]], "tree": [pickle.dumps(tree)], "centre": [tree.centre[0]], "radius": [tree.radius[0]]})

    trees, _ = written(dealt.withColumn("shard", number.cast("int")).groupBy("shard").applyInPandas(grow, "shard int, tree binary, centre array<double>, radius double"), "trees")
    queries, _ = written(asked.withColumn("block", F.pmod(F.xxhash64("id", F.lit("block")), F.lit(blocks)).cast("int")), "queries")
    root_blocks = -(-shards // ROOTS)
    roots = trees.select("shard", "centre", "radius", F.floor(F.col("shard") / ROOTS).cast("int").alias("roots"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))

    def reached(asking: DataFrame, all_of_them: bool) -> DataFrame:
        """id and shard: the shard of the highest bound in a block of roots, or all at or above the floor."""

        def each(key: tuple, r: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
            if not len(r) or not len(q):
                return pd.DataFrame({"id": [], "shard": [], "bound": []}).astype({"id": "int64", "shard": "int32", "bound": "float64"})
            v, c = _even(_matrix(q["v"]), _matrix(r["centre"]))
            none = np.zeros(0, int)
            tops = bounds(Tree(none, none, none, none, none, none, c, r["radius"].to_numpy(np.float64)), np.arange(len(r)), v, np.linalg.norm(v, axis=1))
            if all_of_them:
                at, shard = np.nonzero(tops >= q["floor"].fillna(-np.inf).to_numpy(np.float64)[:, None])
            else:
                at, shard = np.arange(len(q)), tops.argmax(axis=1)
            return pd.DataFrame({"id": q["id"].to_numpy(np.int64)[at], "shard": r["shard"].to_numpy(np.int32)[shard], "bound": tops[at, shard]})

        spread = asking.withColumn("roots", F.explode(F.sequence(F.lit(0), F.lit(root_blocks - 1))))
        return roots.groupBy("roots", "block").cogroup(spread.groupBy("roots", "block")).applyInPandas(each, "id long, shard int, bound double")

    shape = "query_id long, vec_id long, score long"

    def run(key: tuple, t: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if not len(t) or not len(q):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        tree = pickle.loads(t["tree"].iloc[0])
        ids, own = q["id"].to_numpy(np.int64), _matrix(q["v"])
        own, tree.rows = _even(own, tree.rows)
        tree.centre, _ = _even(tree.centre, own)
        if np.abs(own).max(initial=0) * np.abs(tree.rows).max(initial=0) * own.shape[1] >= 2.0**53:
            return _exactly(tree, ids, own, k)
        best = Best(own, ids, q["floor"].fillna(-np.inf).to_numpy(np.float64), k)
        search(tree, best)
        at, rank = np.nonzero(np.isfinite(best.scores))
        return pd.DataFrame({"query_id": ids[at], "vec_id": best.ids[at, rank], "score": best.scores[at, rank].astype(np.int64)})

    def searched(pairs: DataFrame, asking: DataFrame) -> DataFrame:
        """The k best of each pair's shard: a tree goes to each block that asks it."""
        asks = pairs.join(asking, "id").select("shard", "block", "id", "v", "floor")
        to, _ = written(pairs.join(asking.select("id", "block"), "id").select("shard", "block").distinct(), "sent")
        sent = trees.select("shard", "tree").join(to, "shard")
        return sent.groupBy("shard", "block").cogroup(asks.groupBy("shard", "block")).applyInPandas(run, shape)

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    highest = Window.partitionBy("id").orderBy(F.desc("bound"), "shard")
    begin, _ = written(reached(queries, False).withColumn("n", F.row_number().over(highest)).where("n = 1").select("id", "shard"), "begin")
    seen, _ = written(searched(begin, queries.withColumn("floor", F.lit(None).cast("double"))), "seen")
    floors = seen.withColumn("rank", F.row_number().over(order)).where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").cast("double").alias("floor"))
    floored, _ = written(queries.join(floors, "id", "left"), "floors")
    rest, _ = written(reached(floored, True).select("id", "shard").join(begin, ["id", "shard"], "left_anti"), "pairs")
    found = seen.unionByName(searched(rest, floored))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _exactly(tree: Tree, ids: np.ndarray, queries: np.ndarray, k: int) -> pd.DataFrame:
    """Scores beyond 2**53: whole numbers of Python, row by row of the shard."""
    out, least, most = [], -(2**63), 2**63 - 1
    whole = [[int(x) for x in r] for r in tree.rows]
    for i, q in zip(ids, queries, strict=True):
        mine = [int(x) for x in q]
        s = sorted((-sum(a * b for a, b in zip(mine, r, strict=True)), int(j)) for j, r in zip(tree.ids, whole, strict=True) if j != i)[:k]
        out += [(int(i), j, min(most, max(least, -x))) for x, j in s]
    return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype("int64")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
