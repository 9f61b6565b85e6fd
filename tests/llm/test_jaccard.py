import random
import re
from collections import defaultdict

import numpy as np
import pytest

from quire.llm import jaccard
from quire.llm.components import components


def brute(rows, width=4, percent=85):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sets:
        for j in sets:
            both = len(sets[i] & sets[j])
            if i < j and both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((top(i), top(j)))
                root[b] = a
    return sorted((i, len(sets[i]), top(i)) for i in sets)


def corpus(seed, groups=12, copies=14, passage=True):
    """Near copies at all similarities around the threshold, with a passage shared by many."""
    r = random.Random(seed)
    words = [f"w{k}" for k in range(3000)]
    shared = [r.choice(words) for _ in range(60)]
    out = []
    for _ in range(groups):
        base = [r.choice(words) for _ in range(r.choice([3, 5, 30, 80, 200]))]
        if passage and r.random() < 0.5:
            base += shared
        for _ in range(copies):
            t = list(base)
            for _ in range(int(r.random() * len(t) / 12)):
                t[r.randrange(len(t))] = r.choice(words)
            out.append((" " if r.random() < 0.5 else "\n\t").join(t))
    out += [None, "", "  ", out[0], out[0], out[0].upper().replace("W", "w")]
    r.shuffle(out)
    return list(enumerate(out))


@pytest.mark.parametrize(("seed", "small", "width", "percent"), [(1, 32, 4, 85), (2, 2, 4, 85), (3, 4, 5, 80), (4, 1, 2, 90)])
def test_against_brute_force(spark, seed, small, width, percent):
    rows = corpus(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted(tuple(r)[:3] for r in jaccard.similar(docs, width=width, percent=percent, small=small).collect())
    assert got == brute(rows, width, percent)


def test_blocks_of_a_group(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_CLASSES", 8)
    rows = corpus(5, groups=3, copies=60)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(tuple(r)[:3] for r in jaccard.similar(docs, small=3).collect()) == brute(rows)


def test_bridges_between_blocks_of_a_group(spark, monkeypatch):
    """A group that shares a long passage but falls into several components, one link between two of them."""
    monkeypatch.setattr(jaccard, "BLOCK_CLASSES", 6)
    monkeypatch.setattr(jaccard, "PIVOTS", 1)
    r = random.Random(15)
    words = [f"w{k}" for k in range(4000)]
    shared = r.sample(words, 70)
    out = []
    for _ in range(12):
        own = r.sample(words, 30)
        for _ in range(6):
            t = shared + own
            t[70 + r.randrange(30)] = r.choice(words)
            out.append(" ".join(t))
    chain = shared + r.sample(words, 40)
    for k in range(40):  # each like the one before, the last unlike the first
        out.append(" ".join(chain))
        chain = chain[:70] + chain[71:] + [r.choice(words)]
    r.shuffle(out)
    rows = list(enumerate(out))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted(tuple(r)[:3] for r in jaccard.similar(docs, small=3).collect()) == brute(rows)


@pytest.mark.parametrize("block", [8, 10**6])
def test_sets_meet_their_tasks_without_a_shuffle_of_their_own(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK_CLASSES", block)
    plans, mapped = [], jaccard.map_batches

    def seen(df, function, schema):
        if schema == "a long, b long":
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return mapped(df, function, schema)

    monkeypatch.setattr(jaccard, "map_batches", seen)
    rows = corpus(18, groups=3, copies=60)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert sorted(tuple(r)[:3] for r in jaccard.similar(docs, small=3).collect()) == brute(rows)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert len(plans) == (2 if block == 8 else 1)
    assert all(p.count("Exchange hashpartitioning") == 1 and "SortMergeJoin" not in p for p in plans)


def test_links_of_a_block_are_a_spanning_forest():
    r = random.Random(16)
    orders = jaccard.Orders(np.zeros(0, np.uint64), np.zeros(0, np.int64), 85)
    base = np.array(r.sample(range(10**6), 100), np.uint64)
    sets = [np.unique(np.concatenate([base[r.randrange(8) :], np.array(r.sample(range(10**6, 2 * 10**6), r.randrange(6)), np.uint64)])) for _ in range(50)]
    links = jaccard.block_links(list(range(50)), sets, orders)
    assert len(links) == 49
    some = jaccard.block_links(list(range(50)), sets, orders, np.arange(50) < 5)
    assert 5 <= len(some) <= 49 and all(min(a, b) < 5 for a, b in some)


def test_null_and_repeated_ids(spark):
    texts = corpus(17, groups=6)
    rows = [(None if k % 3 == 0 else 7 if k % 3 == 1 else 100 + k, t) for k, (_, t) in enumerate(texts)]
    numbered = brute([(k, t) for k, (_, t) in enumerate(texts)])
    least = {}
    for k, _, c in numbered:
        if rows[k][0] is not None:
            least[c] = min(least.get(c, 10**9), rows[k][0])
    want = sorted(((rows[k][0], n, least.get(c) if n else rows[k][0]) for k, n, c in numbered), key=str)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted((tuple(r)[:3] for r in jaccard.similar(docs).collect()), key=str) == want


def test_heavy_table_never_changes_the_result(spark, monkeypatch):
    rows = corpus(6, groups=6)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(jaccard, "heavy_tokens", lambda *a, **k: (np.zeros(0, np.uint64), np.zeros(0, np.int64)))
    assert sorted(tuple(r)[:3] for r in jaccard.similar(docs).collect()) == brute(rows)


def test_keep_first(spark):
    rows = corpus(7, groups=5)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(i for i, _, c in brute(rows) if i == c)
    assert sorted(r.doc_id for r in jaccard.keep_first(docs).collect()) == want


def test_prefix_length_keeps_every_link():
    r = random.Random(8)
    orders = jaccard.Orders(np.zeros(0, np.uint64), np.zeros(0, np.int64), 85)
    for _ in range(300):
        n = r.randrange(1, 200)
        base = np.array(r.sample(range(10**6), n), np.uint64)
        more = np.unique(np.concatenate([base[r.randrange(0, 1 + n // 8) :], np.array(r.sample(range(10**6, 2 * 10**6), r.randrange(0, 1 + n // 8)), np.uint64)]))
        base = np.unique(base)
        both = len(np.intersect1d(base, more))
        if 100 * both < 85 * (len(base) + len(more) - both):
            continue
        for a, b in zip(orders.prefixes(base), orders.prefixes(more), strict=True):
            assert len(np.intersect1d(a, b)) >= jaccard.shared_least(min(len(base), len(more)))


def test_components(spark):
    r = random.Random(9)
    edges = [(r.randrange(400), r.randrange(400)) for _ in range(260)] + [(k, k + 1) for k in range(1000, 1100)] + [(2000, 2001 + k) for k in range(50)]
    got = {x.node: x.root for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    near = defaultdict(set)
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    for node in near:
        seen, todo = {node}, [node]
        while todo:
            for y in near[todo.pop()] - seen:
                seen.add(y)
                todo.append(y)
        if len(seen) > 1:
            assert got[node] == min(seen)
