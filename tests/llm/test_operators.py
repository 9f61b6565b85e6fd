"""Operators against brute force, exact round trips and held-out accuracy."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quire.llm import balltree, decontaminate, language, lines, mixing, pii, quality, sharding, warc

# Personal data

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def base_spans(text):
    def luhn(d):
        return sum(x if k % 2 == 0 else (2 * x if x < 5 else 2 * x - 9) for k, x in enumerate(map(int, reversed(d)))) % 10 == 0

    out = []
    for n, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "email" or (kind == "ip" and all(int(x) <= 255 for x in m[0].split("."))) or (kind == "card" and 14 <= len(d) <= 19 and luhn(d)) or (kind == "phone" and 10 <= len(d) <= 15):
                out.append((m.start(), n, f"{kind}:{m.start()}:{m.end()}"))
    return [x for *_, x in sorted(out)]


def test_base_spans_on_hard_texts(spark):
    r = random.Random(1)
    parts = ["a@b.c", "a@b", "@", ".", "x@y.zz.", "_", "-", "1.2.3.4", "300.1.1.1", "0001.2.3.4", "1.2.3", "4111 1111 1111 1111", "4111-1111-1111-1112", "378282246310005", "+1 (555) 123-4567", "+12", "+", "é", "😀", " ", "\n", "5", "00", "user%x@a-b.co.uk", "a" * 30, "1" * 25]
    texts = ["".join(r.choice(parts) for _ in range(r.randrange(14))) for _ in range(600)] + [None, "", "1" * 30000, "a" * 30000 + "@", "a@" * 5000, "1-" * 20000, "1." * 20000, "+1" * 5000, "a@b.c" * 3000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: x for x in pii.extract(docs).collect()}
    for k, t in enumerate(texts):
        want = base_spans(t)
        assert got[k].base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), t[:80]
        kinds = Counter(x.split(":")[0] for x in want)
        assert [got[k][f"n_{kind}"] for kind in BASE] == [kinds[kind] for kind in BASE]


def test_patterns_discover_unseen_identifiers(spark):
    known = [(k, f"some words here\nemail: user{k}@mail.example.com and more. Call me at +1 (555) 123-4{k:03d} now") for k in range(20)]
    more = [(100, "email: jane(at)hidden(dot)org was written"), (101, "please call me at 555-0199-777 today"), (102, "the version was 555-0199-777 today"), (103, "on jane(at)hidden(dot)org nothing"), (104, "clean words only")]
    got = {x.doc_id: x.spans for x in pii.extract(spark.createDataFrame(known + more, "doc_id long, text string")).collect()}
    assert got[100] == "email:7:29"
    assert got[101].startswith("phone:18:")
    assert got[102] == got[103] == got[104] == ""
    assert all(got[k].count("email") == 1 and got[k].count("phone") == 1 for k, _ in known)


def test_discovery_on_planted_identifiers(spark):
    """Recall and precision on identifiers that no base pattern finds, ordinary words in slots."""
    r = random.Random(31)
    plain = ["river", "stone", "window", "morning", "letter", "garden", "market", "paper", "winter", "story"]

    def prose(n):
        return " ".join(r.choices(plain, k=n))

    rows, want = [], {}
    for k in range(60):  # seeds
        rows.append((k, f"{prose(9)}\nwrite to user{k}@mail{k % 7}.example.com today {prose(5)}"))
        rows.append((100 + k, f"{prose(4)} account: +1 (555) 010-{1000 + k} {prose(6)}"))
    for k in range(12):  # unseen, in the slot of a pattern
        hidden = [f"ann{k} at host{k} dot org", f"ann{k}(at)host{k}(dot)org", f"ann{k}.b_{k}"][k % 3]
        text = f"{prose(5)}\nplease write to {hidden}, {prose(3)}"
        rows.append((200 + k, text))
        want[200 + k] = (text.index(hidden), text.index(hidden) + len(hidden))
    for k in range(30):  # the same shapes elsewhere
        rows.append((300 + k, f"{prose(3)} ann{k}.b_{k} {prose(2)} 555-0{k + 100}-777 {prose(2)}"))
    def card(k):
        digits = f"4111{k:011d}"
        last = next(c for c in range(10) if sum(x if j % 2 == 0 else (2 * x if x < 5 else 2 * x - 9) for j, x in enumerate(map(int, reversed(f"{digits}{c}")))) % 10 == 0)
        return f"{digits}{last}"

    for k in range(300):  # a phrase before cards and, far more often, before anything else
        rows.append((400 + k, f"see number {card(k)}" if k < 20 else f"see number {r.choice(plain)} {prose(2)}"))
    rows += [(800, "see number 9999 8888 7777 6666 now"), (801, "write to nobody in winter")]
    got = {x.doc_id: x for x in pii.extract(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    found = {d: [tuple(map(int, s.split(":")[1:])) for s in x.spans.split(",")] for d, x in got.items() if x.n_added}
    assert sum(span in found.get(d, []) for d, span in want.items()) >= 0.9 * len(want)
    assert set(found) <= set(want)  # nothing elsewhere, and not the invoice number
    for k, t in rows:
        assert got[k].base_sha256 == hashlib.sha256(",".join(base_spans(t)).encode()).hexdigest()


def test_bootstrapping_goes_on_until_nothing_is_added(spark):
    before = [f"seed{k}@b.example.com" for k in range(6)]
    said = []
    for step in range(6):  # each label's slot: six values that the step before makes known, and a new one
        new = [f"v{step}x{label}@home" for label in range(6)]
        said += [f"s{step}l{label}: {v}" for label in range(6) for v in [*before, new[label]]]
        before = new
    rows = [*enumerate(said), (9000, "s5l2: v5x2@home"), (9001, "other: v5x2@home")]
    got = {x.doc_id: x.spans for x in pii.extract(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[9000] == "email:6:15" and got[9001] == ""


def test_many_matches_take_linear_time(spark):
    import time

    took = []
    for n in (2000, 20000):
        df = spark.createDataFrame([(1, "a@b.c " * n)], "doc_id long, text string")
        pii.extract(df).collect()
        began = time.perf_counter()
        assert pii.extract(df).first().n_email == n
        took.append(time.perf_counter() - began)
    assert took[1] < 10 * took[0] + 5


# Line dedup


def test_patience_aligns_equal_lines():
    r = random.Random(2)
    for _ in range(300):
        a = [r.randrange(12) for _ in range(r.randrange(20))]
        b = [r.randrange(12) for _ in range(r.randrange(20))]
        got = lines.patience(a, b)
        assert all(a[i] == b[j] for i, j in got)
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in itertools.pairwise(got))
        assert [i for i, _ in lines.patience(a, a)] == list(range(len(a)))


def test_common_blocks_leave_the_later_document(spark):
    r = random.Random(3)

    def fresh(n):
        return ["".join(r.choice("abcdefgh ") for _ in range(40)) + str(r.random()) for _ in range(n)]

    shared, own = fresh(5), [fresh(6) for _ in range(4)]
    rows = [(1, own[0][:3] + shared + own[0][3:]), (2, own[1][:2] + shared + own[1][2:]), (3, own[2]), (4, own[0][:3] + shared + own[0][3:]), (5, shared[:2] + own[3])]
    df = spark.createDataFrame([(k, "\n".join(x)) for k, x in rows], "doc_id long, text string")
    got = {x.doc_id: x for x in lines.clean(df).collect()}
    assert got[1].n_removed == got[3].n_removed == 0 and got[1].text.split("\n") == rows[0][1]
    assert got[2].text.split("\n") == own[1] and got[2].removed == "2-7"
    assert got[4].n_removed == got[4].n_lines == 11 and got[4].text == ""
    assert got[5].text.split("\n") == own[3]


def test_passage_of_many_documents_goes_from_all_later_ones(spark):
    passage = [f"line {k} of the passage, one that very many documents hold" for k in range(5)]
    own = {d: [f"line {k} of document {d}, which no other document holds at all" for k in range(8)] for d in range(200)}
    rows = [(d, "\n".join(x[: d % 9] + passage + x[d % 9 :])) for d, x in own.items()]
    got = {x.doc_id: x for x in lines.clean(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0].text == rows[0][1] and got[0].n_removed == 0
    assert all(got[d].text.split("\n") == own[d] and got[d].n_removed == 5 for d in range(1, 200))


def test_rare_lines_do_not_hide_the_common_ones(spark):
    body = [f"line {k} of a body, one that a large group of near copies holds" for k in range(10)]
    own = {d: [f"line {k} of document {d}, which no near copy but its own holds" for k in range(2)] for d in range(100)}
    rows = {d: body[:5] + x + body[5:] for d, x in own.items()}
    rows |= {200 + d: rows[d] for d in range(10, 20)}  # later exact copies
    rows |= {300 + d: [own[d][0], f"another line of document {300 + d}, its own one"] for d in range(20, 30)}  # later, one line shared
    rows |= {-50 + d: [own[d][1], f"another line of document {-50 + d}, its own one"] for d in range(30, 40)}  # earlier, one line shared
    df = spark.createDataFrame([(d, "\n".join(x)) for d, x in rows.items()], "doc_id long, text string")
    got = {x.doc_id: x.text.split("\n") for x in lines.clean(df).collect()}
    assert got[0] == rows[0]
    assert all(got[d] == own[d][: 1 if 30 <= d < 40 else 2] for d in range(1, 100))
    assert all(got[200 + d] == [""] for d in range(10, 20))
    assert all(got[300 + d] == rows[300 + d][1:] for d in range(20, 30))


def brute_clean(docs):
    """Line deduplication by comparing every document with the first holder of each line, pair and whole."""
    order = sorted(docs, key=lambda x: x[0])
    lists = {d: t.split("\n") for d, t in order}

    def keys(ls):
        solid = [x for x in ls if x.strip(" ")]
        return {(x,) for x in solid} | set(itertools.pairwise(solid)) | {("whole", *ls)}

    first = {}
    for d, _ in order:
        for k in keys(lists[d]):
            first.setdefault(k, d)
    out = {}
    for d, _ in order:
        mine, gone = lists[d], set()
        for p in {first[k] for k in keys(mine) if any(x.strip(" ") for x in mine)} - {d}:
            a, b = ([x if x.strip(" ") else None for x in lists[e]] for e in (p, d))
            for lo, hi in lines.blocks([(i, j) for i, j in lines.patience(a, b) if lists[p][i] == mine[j]], [len(x) for x in mine]):
                gone.update(range(lo, hi))
        out[d] = "\n".join(x for k, x in enumerate(mine) if k not in gone)
    return out


@pytest.mark.parametrize("holders", [64, 65, 300])
def test_clean_against_brute_force(spark, holders):
    r = random.Random(holders)
    notice = [f"line {k} of a notice that all of them hold, word for word" for k in range(3)]
    pool = [f"line {k} of a pool, long enough to count" for k in range(40)] + ["", "  ", "short"]
    docs = []
    for d in range(holders):
        own = [r.choice(pool) if r.random() < 0.4 else f"own line {d} {r.random()}" for _ in range(r.randrange(1, 9))]
        at = r.randrange(len(own) + 1)
        docs.append((d, "\n".join(own[:at] + notice + own[at:])))
    want = brute_clean(docs)
    got = {x.doc_id: x for x in lines.clean(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()}
    assert {d: x.text for d, x in got.items()} == want
    assert all(notice[0] not in x.text for d, x in got.items() if d)


def test_repeated_lines_align():
    assert lines.patience(list("xyxy"), list("zxyxyz")) == [(0, 1), (1, 2), (2, 3), (3, 4)]
    assert lines.patience(list("aab"), list("caabbd"))[:2] == [(0, 1), (1, 2)]
    assert [i for i, _ in lines.patience(list("pqpq"), list("1pqpq2pqpq3"))] == [0, 1, 2, 3]


def test_equal_hashes_of_unequal_lines_cut_nothing(spark, monkeypatch):
    monkeypatch.setattr(lines, "LEAST", 1)
    rows = [(1, "first line of the one\nsecond line"), (2, "first line of the other\nsecond line, too")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    made = lines.hashed(df)
    monkeypatch.setattr(lines, "hashed", lambda *a: made.withColumn("lines", F.transform("lines", lambda x, k: k.cast("long"))))
    assert [x.text for x in lines.clean(df).orderBy("doc_id").collect()] == [t for _, t in rows]


def test_every_line_stays_somewhere(spark):
    r = random.Random(4)
    pool = [f"line {k} of a pool of lines that is long enough to count" for k in range(60)]
    docs = [(k, "\n".join(r.choice(pool) for _ in range(r.randrange(1, 12)))) for k in range(80)]
    docs += [(100 + k, docs[3][1]) for k in range(90)]  # a large group of copies
    got = lines.clean(spark.createDataFrame(docs, "doc_id long, text string"), rare=8).collect()
    assert {x for _, t in docs for x in t.split("\n")} == {x for g in got for x in g.text.split("\n") if x}
    assert sum(g.text == "" for g in got if g.doc_id >= 100) == 90


# Resharding


def brute_flow(supply, capacity):
    """Fewest bytes moved: all that a shard holds beyond the capacity of its number."""
    return sum(max(0, s - (capacity[k] if k < len(capacity) else 0)) for k, s in enumerate(supply))


def test_flow_moves_the_fewest_bytes():
    r = random.Random(5)
    for _ in range(60):
        n, m = r.randrange(1, 7), r.randrange(1, 7)
        supply = [r.randrange(50) for _ in range(n)]
        capacity = sharding.even_capacities(sum(supply) + r.randrange(20), m)
        flow = sharding.min_cost_flow(supply, capacity, [[int(a != b) for b in range(m)] for a in range(n)])
        assert [sum(x) for x in flow] == supply
        assert all(sum(flow[s][t] for s in range(n)) <= capacity[t] for t in range(m))
        assert sum(flow[s][t] for s in range(n) for t in range(m) if s != t) == brute_flow(supply, capacity)
    costs = [[3, 1], [1, 5]]
    assert sharding.min_cost_flow([4, 4], [4, 4], costs) == [[0, 4], [4, 0]]
    with pytest.raises(ValueError, match="capacities"):
        sharding.min_cost_flow([5], [4], [[0]])


@pytest.mark.parametrize(("old", "new"), [(12, 16), (5, 3), (4, 4)])
def test_shards(spark, old, new):
    r = random.Random(6)
    texts = ["x" * r.randrange(400) if r.random() < 0.9 else "é" * 3000 for _ in range(1500)] + [None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sharding.reshard(df, new, old_shards=old, blocks=16).collect()
    assert len(got) == len(texts)
    slots, size, moved, held = defaultdict(list), Counter(), 0, Counter()
    for x in got:
        raw = (texts[x.doc_id] or "").encode()
        assert x["size"] == len(raw) + 1 and x.text_crc32 == zlib.crc32(raw) and x.grown_shard is None
        slots[x.shard].append(x.slot)
        size[x.shard] += x["size"]
        held[x.old_shard] += x["size"]
        moved += x["size"] * x.moved
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    longest = max(x["size"] for x in got)
    assert max(size.values()) - min(size.values()) <= 2 * longest
    least = brute_flow([held[k] for k in range(old)], sharding.even_capacities(sum(held.values()), new))
    assert moved <= least + 2 * longest * (old + new)


def test_rewrite_round_trip(spark, tmp_path):
    texts = [(k, f"text {k} " * (k % 40)) for k in range(400)]
    placed = sharding.reshard(spark.createDataFrame(texts, "doc_id long, text string"), 6, old_shards=4, blocks=8)
    touched = sharding.rewrite(placed, str(tmp_path / "shards"))
    back = spark.read.parquet(str(tmp_path / "shards"))
    want = sorted((x.doc_id, x.text, x.shard, x.slot) for x in placed.collect())
    assert sorted((x.doc_id, x.text, x.shard, x.slot) for x in back.collect()) == [x for x in want if x[2] in touched]
    assert sorted((x.doc_id, x.text, x.shard, x.slot) for x in sharding.after_rewrite(placed, 6).collect()) == want


def test_untouched_shards_are_left_alone(spark, tmp_path):
    texts = [(k, "x" * 9) for k in range(60)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    placed = sharding.reshard(df, 3, old_shard=F.when(F.col("doc_id") < 20, 0).when(F.col("doc_id") < 50, 1).otherwise(2), old_shards=3, blocks=4)
    assert sharding.rewrite(placed, str(tmp_path / "s")) == [1, 2]
    done = sharding.after_rewrite(placed, 3).collect()
    assert Counter(x.shard for x in done) == {0: 20, 1: 20, 2: 20} and {x.doc_id for x in done if x.shard == 0} == set(range(20))


@pytest.mark.parametrize("kind", ["null ids", "equal rows"])
def test_hot_ids_spread_over_blocks(spark, monkeypatch, kind):
    monkeypatch.setattr(sharding, "CROWD", 50)
    rows = [(None, f"text {k}" if kind == "null ids" else "same") for k in range(3000)] + [(k, f"more {k}") for k in range(1500)]
    placed = sharding.reshard(spark.createDataFrame(rows, "doc_id long, text string"), 5, old_shards=3, blocks=32)
    got = placed.select("doc_id", "text", "size", "shard", "slot", "block", "old_shard").collect()
    assert Counter((x.doc_id, x.text) for x in got) == Counter(rows)
    held = Counter((x.old_shard, x.block) for x in got)
    assert max(held.values()) < 10 * len(rows) / (3 * 32)
    for shard in range(5):
        assert sorted(x.slot for x in got if x.shard == shard) == list(range(sum(x.shard == shard for x in got)))
    sizes = Counter()
    for x in got:
        sizes[x.shard] += x["size"]
    assert max(sizes.values()) - min(sizes.values()) <= 40


# Top k


@pytest.mark.parametrize("seed", range(3))
def test_top_k_against_brute_force(spark, seed):
    r = np.random.default_rng(seed)
    v = np.round(r.normal(size=(700, 9)), 2)
    v[100:300] = v[0]  # a very common vector
    rows = [(int(k), [float(x) for x in v[k]]) for k in range(700)]
    rows += [(700, None), (750, [1.0, None] + [0.0] * 7), (800, [float("nan")] * 9), (850, [float("inf")] * 9), (900, []), (None, [1.0] * 9)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    whole = {k: np.pad(np.floor(256 * np.array(x)), (0, 9 - len(x))) for k, x in rows if k is not None and x is not None and all(y is not None and np.isfinite(y) for y in x)}
    want = []
    for q in whole:
        if q % 50 == 0:
            best = sorted((-int(whole[q] @ whole[c]), c) for c in whole if c != q)[:5]
            want += [(q, k + 1, c, -s) for k, (s, c) in enumerate(best)]
    got = balltree.top_k(df, shard_rows=150, block_rows=4).collect()
    assert sorted(tuple(x) for x in got) == sorted(want)


def test_search_prunes():
    r = np.random.default_rng(7)
    centres = r.normal(size=(20, 16)) * 50
    rows = np.floor(256 * (centres[r.integers(0, 20, 4000)] + r.normal(size=(4000, 16))))
    tree = balltree.build(np.arange(4000), rows, leaf=32)
    best = balltree.Best(rows[:40], np.arange(40), np.full(40, -np.inf), 5)
    assert balltree.search(tree, best) < 40 * 4000 * 0.5
    for k in range(40):
        s = sorted((-int(rows[k] @ rows[c]), c) for c in range(4000) if c != k)[:5]
        assert [(-int(x), int(c)) for x, c in zip(best.scores[k], best.ids[k], strict=True)] == s


def test_trees_go_only_where_a_bound_reaches(spark, monkeypatch):
    r = np.random.default_rng(9)
    centres = r.normal(size=(12, 8)) * 100
    v = centres[r.integers(0, 12, 3000)] + r.normal(size=(3000, 8))
    rows = [(int(k), [float(x) for x in v[k]]) for k in range(3000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    whole = np.floor(256 * v)
    got = balltree.top_k(df, shard_rows=200, block_rows=16)
    want = []
    for q in range(0, 3000, 50):
        s = whole @ whole[q]
        s[q] = -np.inf
        best = np.lexsort((np.arange(3000), -s))[:5]
        want += [(q, n + 1, int(c), int(s[c])) for n, c in enumerate(best)]
    assert sorted(tuple(x) for x in got.collect()) == sorted(want)
    monkeypatch.setattr(balltree, "ROOTS", 3)
    monkeypatch.setattr(balltree, "PIVOTS", 5)
    assert sorted(tuple(x) for x in balltree.top_k(df, shard_rows=200, block_rows=16).collect()) == sorted(want)
    monkeypatch.setattr(balltree, "PIVOTS", 32)
    tables = []
    keep = balltree.written
    monkeypatch.setattr(balltree, "written", lambda d, name: (tables.append((name, keep(d, name))), tables[-1][1])[1])
    balltree.top_k(df, shard_rows=200, block_rows=16)
    made = {name: t.count() for name, (t, _) in tables}
    assert made["pairs"] < made["queries"] * made["trees"] / 4


def test_scores_beyond_doubles(spark):
    rows = [(0, [4.0e6, 1.0]), (1, [4.0e6, 2.0]), (2, [4.0e6, 3.0])]
    got = balltree.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    big = 256 * 4_000_000
    assert sorted(tuple(x) for x in got) == [(0, 1, 2, big * big + 256 * 768), (0, 2, 1, big * big + 256 * 512)]


# Decontamination


def test_wand_returns_all_above_the_threshold():
    r = random.Random(8)
    vocabulary = [f"w{k}" for k in range(80)]
    items = [(k, " ".join(r.choice(vocabulary) for _ in range(r.randrange(5, 14)))) for k in range(120)]
    index = decontaminate.build(items)
    for _ in range(200):
        query = np.unique([index.numbers(decontaminate.words(*decontaminate.text_buffer(pa.array([" ".join(r.sample(vocabulary, 12))])))[0])])
        query = query[query >= 0]
        score = np.zeros(len(index.ids))
        for t in query:
            at = slice(index.first[t], index.first[t + 1])
            score[index.item[at]] += index.impact[at]
        for threshold in (0.2, 0.5, 0.8):
            got = dict(decontaminate.wand(index, query, threshold))
            assert set(got) == set(np.flatnonzero(score >= threshold - 1e-9))
            assert all(abs(score[k] - v) < 1e-9 for k, v in got.items())


def test_found_items_against_brute_force(spark):
    r = random.Random(9)
    vocabulary = [f"wört{k}" for k in range(400)]

    def prose(n):
        return [r.choice(vocabulary) for _ in range(n)]

    items = [(k, " ".join(prose(r.randrange(8, 40)))) for k in range(30)] + [(90, None), (91, "too few words"), (93, "?"), (92, items_text := " ".join(prose(20)))]
    docs, want = [], set()
    for d in range(120):
        words = prose(r.randrange(0, 400))
        if d % 3 == 0:
            k, text = r.choice(items[:30])
            at = r.randrange(len(words) + 1)
            words[at:at] = [w.upper() + "," for w in text.split()]
            want.add((d, k))
        docs.append((d, " ".join(words)))
    docs += [(500, None), (501, ""), (502, items_text), (503, " ".join(items_text.split()[:8]))]
    want.add((502, 92))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.find(frame, bench).collect()
    assert {(x.doc_id, x.item_id) for x in got} == want and all(x.question_overlap == x.answer_overlap == 1.0 for x in got)
    assert {x.doc_id for x in decontaminate.drop_found(frame, bench).collect()} == {d for d, _ in docs} - {d for d, _ in want}


def test_edited_and_cut_items_are_dropped(spark):
    r = random.Random(12)
    vocabulary = [f"w{k}" for k in range(2000)]
    items = [(k, r.choices(vocabulary, k=r.randrange(15, 60))) for k in range(60)]

    def edited(item, share):
        out = list(item)
        for k in [len(item) - 2, *r.sample(range(len(item) - 2), max(1, round(share * len(item))) - 1)]:
            out[k] = "changed"
        return out

    kinds = [lambda x: edited(x, 0.05), lambda x: edited(x, 0.1), lambda x: x[: len(x) - len(x) // 4], lambda x: x[: len(x) // 3], lambda x: r.sample(x, len(x) // 2)]
    docs = []
    for k, item in items:
        for n, kind in enumerate(kinds):
            words = r.choices(vocabulary, k=r.randrange(300))
            at = r.randrange(len(words) + 1)
            docs.append((10 * k + n, " ".join(words[:at] + kind(item) + words[at:])))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame([(k, " ".join(x)) for k, x in items], "item_id long, text string")
    assert {x.doc_id for x in decontaminate.drop_found(frame, bench).collect()} == {d for d, _ in docs if d % 10 > 2}


def test_kept_words():
    r = random.Random(13)
    for _ in range(200):
        item, text = r.choices(range(6), k=r.randrange(1, 9)), r.choices(range(6), k=r.randrange(12))
        row = [0] * (len(text) + 1)
        for i, w in enumerate(item, 1):
            new = [i]
            for j, x in enumerate(text, 1):
                new.append(min(row[j - 1] + (w != x), row[j] + 1, new[-1] + 1))
            row = new
        assert decontaminate.kept_words(np.array(item, np.uint64), np.array(text, np.uint64)) == len(item) - min(row)


def test_batch_test_drops_no_window(monkeypatch):
    r = random.Random(10)
    vocabulary = [f"w{k}" for k in range(60)]
    items = [(k, " ".join(r.choice(vocabulary) for _ in range(12))) for k in range(40)]
    index = decontaminate.build(items)
    column = pa.array([" ".join(r.choice(vocabulary) for _ in range(200)) for _ in range(30)])
    monkeypatch.setattr(decontaminate, "QUESTION", 0.0)
    monkeypatch.setattr(decontaminate, "ANSWER", 0.0)
    got = list(decontaminate.matches(index, column))
    assert got
    everything = decontaminate.build(items, aside=0.0)
    everything.need[:] = -1.0
    assert got == list(decontaminate.matches(everything, column))
    monkeypatch.setattr(decontaminate, "POSTINGS", 3)
    monkeypatch.setattr(decontaminate, "CELLS", 100)
    assert got == list(decontaminate.matches(index, column))


def test_parts_score_as_one_index(spark, monkeypatch):
    r = random.Random(14)
    vocabulary = [f"w{k}" for k in range(300)]
    items = [(f"item {k}" if k else None, " ".join(r.choices(vocabulary, k=r.randrange(6, 30)))) for k in range(60)] + [("twice", "a b c d e f g"), ("twice", "a b c d e f g")]
    docs = [(d, " ".join([*r.choices(vocabulary, k=r.randrange(200)), r.choice(items)[1], *r.choices(vocabulary, k=r.randrange(200))])) for d in range(150)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id string, text string")
    one = sorted(map(tuple, decontaminate.find(frame, bench).collect()), key=str)
    kept = {x.doc_id for x in decontaminate.drop_found(frame, bench).collect()}
    monkeypatch.setattr(decontaminate, "MAX_PART_BYTES", 1500)
    assert sum(1 for _ in decontaminate.indexes(bench)) > 2
    assert sorted(map(tuple, decontaminate.find(frame, bench).collect()), key=str) == one and any(x[1] is None for x in one) and any(x[1] == "twice" for x in one)
    assert {x.doc_id for x in decontaminate.drop_found(frame, bench).collect()} == kept


def test_short_items_are_lines(spark):
    items = [(1, "Too short, really"), (2, "word"), (None, "no id here"), (4, " ?! "), (5, "")]
    docs = [(1, "too short really"), (2, "it was too short really"), (3, "first line\n * Word!\nlast line"), (4, "a word in a line"), (5, "No ID here."), (6, "no id\nhere"), (7, ""), (8, None)]
    frame, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(x.doc_id, x.item_id): x.score for x in decontaminate.find(frame, bench).collect()}
    assert got == {(1, 1): 1.0, (3, 2): 1.0, (5, None): 1.0}
    assert {x.doc_id for x in decontaminate.drop_found(frame, bench).collect()} == {2, 4, 6, 7, 8}


def test_many_items_in_bounded_memory():
    import resource

    r = np.random.default_rng(15)
    items = [(k, " ".join(f"w{x}" for x in r.integers(0, 3000, 40))) for k in range(16_000)]
    index = decontaminate.build(items)
    text = " ".join([*(f"w{x}" for x in r.integers(0, 3000, 60_000)), items[77][1]])
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    found = list(decontaminate.matches(index, pa.array([text])))
    assert (0, 77) in [x[:2] for x in found]
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 400_000  # kilobytes


# Language


def test_languages_held_out(spark):
    r = random.Random(11)
    kinds = {"aa": "abcdeklm", "bb": "nopqrstu", "cc": "abcvwxyz"}
    rows = [(k, " ".join("".join(r.choice(kinds[lang]) for _ in range(r.randrange(2, 9))) for _ in range(30)), lang) for k in range(600) for lang in [r.choice(sorted(kinds))]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = language.identify(df.where("doc_id % 3 = 1"), language.train(df.where("doc_id % 3 <> 1"))).collect()
    assert len(got) == 200 and sum(x.lang == x.lang_pred for x in got) >= 198
    assert all(0 < x.score <= 1 for x in got)


def test_scores_are_those_of_naive_bayes(spark):
    rows = [(1, "Ünï wörd Über", "x"), (2, "plain words", "y")]
    model = language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    counts = [Counter() for _ in model.languages]

    def grams(text):
        low = "".join(c.lower() if c.isalpha() else " " for c in text)
        return [low[k : k + n] for n in (1, 2, 3) for k in range(len(low) - n + 1) if low[k : k + n].strip()]

    for _, t, lang in rows:
        counts[model.languages.index(lang)].update(grams(t))
    total = 1 << language.BUCKET_BITS
    said = "wörds Ün"
    log = [np.log(0.5) + sum(np.log((c[g] + language.SMOOTH) / (sum(c.values()) + total * language.SMOOTH)) for g in grams(said)) for c in counts]
    best, sure = model.scores(pa.array([said]))
    assert best[0] == int(np.argmax(log)) and sure[0] == pytest.approx(1 / sum(np.exp(x - max(log)) for x in log), rel=1e-3)


def test_long_text_in_slices_scores_the_same(spark, monkeypatch):
    rows = [(1, "abc def " * 50, "x"), (2, "ghi jkl " * 50, "y")]
    model = language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    column = pa.array(["abc jkl é " * 300, "", None, "ghi"])
    whole = [x.tolist() for x in model.scores(column)]
    monkeypatch.setattr(language, "STEP", 64)
    assert [x.tolist() for x in model.scores(column)] == [whole[0], pytest.approx(whole[1])]


def test_bytes_that_are_no_text():
    model = language.Model(["x", "y"], np.log([0.5, 0.5]), np.log(np.random.default_rng(1).random((1 << language.BUCKET_BITS, 2))).astype(np.float32))
    good = ["abc def", "ghi", "é jkl"]
    raw = [x.encode() for x in good]
    broken = pa.Array.from_buffers(pa.string(), 4, pa.array([raw[0], raw[1], b"\x80\xff\xc3", raw[2]], pa.binary()).buffers())
    best, sure = model.scores(broken)
    want = model.scores(pa.array([good[0], good[1], "?", good[2]]))
    assert best.tolist() == want[0].tolist() and best[2] == -1 and sure == pytest.approx(want[1])


# Quality


def test_quality_held_out(spark):
    r = random.Random(12)

    def text(good):
        words = ["".join(r.choice("abcdefghij") for _ in range(r.randrange(2, 9))) for _ in range(r.randrange(20, 90))]
        return " ".join(words) + "." if good else r.choice([" | ".join(words), " ".join(w.upper() + "!!" for w in words), " ".join(words[:2] * 30), " ".join(w + "###" for w in words)])

    rows = [(k, text(k % 4 != 0), int(k % 4 != 0)) for k in range(1200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, y int")
    labels = df.where("doc_id % 5 <> 0").select("doc_id", F.col("y").alias("quality"))
    rules = quality.train(df, labels)
    got = quality.score(df.where("doc_id % 5 = 0"), rules).collect()
    assert sum(x.predicted == x.y for x in got) >= 0.97 * len(got) and 0 < len(rules.rules) < 200
    assert len(rules.describe()) == len(rules.rules)


def test_rules_as_columns_equal_rules_in_numpy(spark):
    r = np.random.default_rng(13)
    x = r.normal(size=(400, len(quality.FEATURES)))
    y = (x[:, 0] + x[:, 3] * x[:, 5] > 0).astype(float)
    rules = quality.fit(x, y)
    z = rules.intercept + sum(w * quality.holds(rule, x) for rule, w in zip(rules.rules, rules.weights, strict=True))
    df = spark.createDataFrame([(k, row.tolist()) for k, row in enumerate(x)], "k int, s array<double>")
    got = [v.p for v in df.select("k", rules.column("s").alias("p")).orderBy("k").collect()]
    assert got == pytest.approx((1 / (1 + np.exp(-z))).tolist())
    assert ((np.array(got) > 0.5) == y).mean() > 0.85


def test_statistics_of_a_text():
    got = dict(zip(quality.FEATURES, quality.statistics(pa.array(["Ab ab ab\n\nx|!9."]))[0], strict=True))
    assert got["log_words"] == pytest.approx(np.log(5)) and got["repeat_next"] == pytest.approx(2 / 4)
    assert got["share_digit"] == pytest.approx(1 / 15) and got["share_upper"] == pytest.approx(1 / 15) and got["log_lines"] == pytest.approx(np.log(2))
    assert not quality.statistics(pa.array([None, "", " \n "])).any()


# Archives


def test_archive_round_trip(spark, tmp_path):
    bodies = ["<p>a</p>", "", None, "<p>a</p>", "x\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n", "é" * 5000, "<p>a</p>", ""]
    pages = [(k, f"http://x/{k}" if k != 2 else None, b) for k, b in enumerate(bodies)] + [(3, "http://x/3", "other"), (None, "http://n", "nobody")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    path = f"file://{tmp_path}/w"
    warc.write_archives(df, path, file_bytes=2000)
    raw = warc.read_archives(spark, path).collect()
    assert len(raw) == len(pages)
    assert sorted(x.url or "" for x in raw) == sorted(u or "" for _, u, _ in pages)
    import base64

    last = defaultdict(list)
    for k, _, b in pages:
        last[b or ""].append(-1 if k is None else k)
    got = sorted(warc.resolved(warc.read_archives(spark, path)).collect(), key=str)
    want = []
    for k, _, b in pages:
        top = max(last[b or ""])
        revisit = k is not None and k != top
        want.append((k, len((b or "").encode()), base64.b32encode(hashlib.sha1((b or "").encode()).digest()).decode(), "revisit" if revisit else "response", top if revisit else None))
    assert sorted((tuple(x) for x in got), key=str) == sorted(want, key=str)


def members(data):
    """Records of an archive by an independent reading: a gzip member each."""
    import zlib

    out = []
    while data:
        one = zlib.decompressobj(31)
        text = one.decompress(data) + one.flush()
        assert one.eof
        data = one.unused_data
        if text:
            head, _, rest = text.partition(b"\r\n\r\n")
            version, *lines = head.decode().split("\r\n")
            fields = dict(x.split(": ", 1) for x in lines)
            assert version == "WARC/1.1" and len(rest) == int(fields["Content-Length"]) + 4 and rest.endswith(b"\r\n\r\n")
            out.append((fields, rest[:-4]))
    return out


def test_a_standard_reader_reads_member_by_member(spark, tmp_path, monkeypatch):
    rows = [(k, f"http://x/{k}", ["same", f"own {k}", "é\r\n\r\nx"][k % 3]) for k in range(60)] + [(100, None, "x" * (17 << 20))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    warc.write_archives(df, f"file://{tmp_path}/w", file_bytes=6 << 20)
    files = sorted((tmp_path / "w").glob("*.warc.gz"))
    assert len(files) > 1 and not list((tmp_path / "w").glob("part-*"))
    ids, seen = Counter(), {}
    for f in files:
        first, *rest = members(f.read_bytes())
        assert first[0]["WARC-Type"] == "warcinfo"
        for fields, block in rest:
            ids[fields["WARC-Record-ID"]] += 1
            assert fields["WARC-Date"] > "2000" and block.startswith(b"HTTP/1.1 200 OK\r\n")
            seen[fields["WARC-Record-ID"]] = (fields, block.partition(b"\r\n\r\n")[2])
    assert len(ids) == len(rows) and set(ids.values()) == {1}
    html = {k: t for k, _, t in rows}
    for urn, (fields, payload) in seen.items():
        page = int(urn.split(":")[2])
        full = payload if fields["WARC-Type"] == "response" else seen[fields["WARC-Refers-To"]][1]
        assert full.decode() == html[page] and (fields["WARC-Type"] == "response" or not payload)
    assert {x.page_id: x.payload_bytes for x in warc.resolved(warc.read_archives(spark, f"file://{tmp_path}/w")).collect()} == {k: len(t.encode()) for k, t in html.items()}


def test_small_payloads_are_all_responses(spark, tmp_path):
    df = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcdef"), (4, "u", "abcdef")], "page_id long, url string, html string")
    warc.write_archives(df, f"file://{tmp_path}/w", least=4)
    got = {x.page_id: x.record_type for x in warc.read_archives(spark, f"file://{tmp_path}/w").collect()}
    assert got == {1: "response", 2: "response", 3: "revisit", 4: "response"}


# Mixing


def brute_targets(sizes, weights=(5, 2, 1), repeats=3):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    target, open_, left = {}, set(names), float(sum(sizes.values()))
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total > repeats * sizes[s] + 1e-9}
        for s in over or open_:
            target[s] = float(repeats * sizes[s]) if over else left * weight[s] / total
        if not over:
            break
        left -= sum(target[s] for s in over)
        open_ -= over
    return target


@pytest.mark.parametrize("seed", range(4))
def test_mix(spark, seed):
    r = random.Random(seed)
    names = [f"s{k}" for k in range(r.randrange(1, 9))] + [None]
    rows = [(k, "w " * (r.randrange(60) if r.random() < 0.95 else 400), r.choice(names[: 1 + int(len(names) * r.random() ** 0.3)])) for k in range(900)] + [(2000, None, "s0"), (2001, "", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    plan = mixing.schedule(df, blocks=8)
    got = plan.rows.collect()
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    want = brute_targets(sizes)
    taken, longest = Counter(), Counter()
    for x in got:
        assert x.source_size == sizes[x.source] and x.target == pytest.approx(want[x.source])
        assert x.taken in (0, x["size"], 2 * x["size"], 3 * x["size"])
        taken[x.source] += x.taken
        longest[x.source] = max(longest[x.source], x["size"])
    most = max(longest.values())
    assert 0 <= sum(sizes.values()) - sum(taken.values()) <= most
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 2 * most + 1
    again = {x.id: x.taken for x in mixing.schedule(df.repartition(3), blocks=8).rows.collect()}
    assert again == {x.id: x.taken for x in got}
    copies = Counter(x.doc_id for x in mixing.apply(df, plan).collect())
    assert copies == Counter({x.id: x.taken // x["size"] for x in got if x.taken})
    salted = mixing.apply(df, mixing.Schedule(plan.rows, plan.cuts, mixing.BROADCAST_SOURCES + 1, plan.blocks))
    assert Counter(x.doc_id for x in salted.collect()) == copies


def test_targets_of_many_sources(spark):
    r = random.Random(21)
    sizes = {f"host{k}": int(10 ** r.uniform(0, 5)) for k in range(700)} | {None: 40}
    got = {x.source: x.target for x in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long").repartition(7)).collect()}
    want = brute_targets(sizes)
    assert got == {s: pytest.approx(v) for s, v in want.items()}


def test_hot_rows_of_a_mix(spark, monkeypatch):
    rows = [(None, f"w {k}", "a") for k in range(500)] + [(None, "same words here", "a")] * 3000 + [(k, "w " * (k % 9), "b") for k in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    plan = mixing.schedule(df, blocks=16)
    got = plan.rows.collect()
    assert len(got) == len(rows) and Counter(x["size"] for x in got)[3] >= 3000
    assert max(Counter(x.block for x in got if x.source == "a" and x["size"] == 2).values()) < 500 / 4
    assert mixing.apply(df, plan).count() == sum(x.copies for x in got if x["size"])
    monkeypatch.setattr(mixing, "NEAR", 2)
    monkeypatch.setattr(mixing, "RANGES", 4)
    assert sorted(map(tuple, mixing.schedule(df, blocks=16).rows.collect()), key=str) == sorted(map(tuple, got), key=str)


def test_mix_is_a_prefix_of_the_finish_order(spark):
    rows = [(k, "w " * (1 + k % 7), "ab"[k % 2]) for k in range(300)]
    plan = mixing.schedule(spark.createDataFrame(rows, "doc_id long, text string, source string"), blocks=4)
    got = plan.rows.collect()
    copies = {x.id: x.copies for x in got}
    finish = []
    for s in "ab":
        mine = sorted((x for x in got if x.source == s), key=lambda x: (x.block, x.key, x.id))
        at = 0
        for epoch in range(3):
            for x in mine:
                at += x["size"]
                finish.append((at / x.target, x["size"], copies[x.id] > epoch))
    finish.sort()
    budget, spent = sum(x["size"] for x in got), 0
    for _, size, taken in finish:
        spent += size
        assert taken == (spent <= budget) or not taken
        if spent > budget:
            break
