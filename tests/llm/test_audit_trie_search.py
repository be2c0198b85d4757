"""Filter audit, prefix trie and top-k search against plain Python, and on awkward input."""

import hashlib
import random
import re
import zlib
from collections import defaultdict
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from packetloom.llm import filter_audit, pivot_search, prefix_trie

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# --- filter audit


def fails(rows):
    """Per row (doc_id, text, source): part, doc_id and the letters of the filters it fails."""
    first = {}
    for d, t, _ in rows:
        if d is not None:
            first[t or ""] = min(d, first.get(t or "", d))
    for d, t, s in rows:
        t = t or ""
        w = WORD.findall(t)
        yield s or "", d, {f for f, bad in zip("ABCDE", (
            len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * len(re.findall("[A-Z]", t)) > 5 * len(t),
            bool(re.search("[#$%&*|]", t)), d is not None and d > first[t])) if bad}


def audit(rows, labels):
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    parts = defaultdict(list)
    for part, d, bad in fails(rows):
        parts[part].append((d, bad))
    out = set()
    for part, docs in parts.items():
        lines, shares = [], defaultdict(int)
        for order in permutations("ABCDE"):
            left, gone = docs, []
            for step, f in enumerate(order, 1):
                now = [x for x in left if f in x[1]]
                redundant = sum(f in bad for _, bad in gone)
                left, gone = [x for x in left if f not in x[1]], gone + now
                shares[f] += len(now)
                lines.append(("".join(order), step, f, len(left), len(now), redundant, sum(bad == {f} for _, bad in docs),
                              sum(d in good for d, _ in now), sum(d in toxic for d, _ in now)))
        out |= {(part, o, s, *rest, shares[f]) for o, s, f, *rest in lines}
    return out


def awkward_docs():
    rng = random.Random(4)
    words = [f"w{i}" for i in range(90)] + ["LOUD", "50%", "a|b"]
    rows = []
    for i in range(300):
        t = " ".join(rng.choices(words[:rng.choice([20, 93])], k=rng.choice([3, 49, 50, 70, 160])))
        rows.append((i * 1_000_003 - 7, t, rng.choice(["a", "a", "a", "b", None, ""])))
    rows += [(5, rows[k][1], "c") for k in range(5)]  # one id, several texts and parts
    rows += [rows[3], rows[3], (None, rows[4][1], "a"), (None, None, "a"), (None, None, "a"), (9, None, None), (10, "", "b"),
             (11, " \t\v", "b"), (12, "Ünï " * 60, "d"), (13, "x" * 300_000, "d"), (14, "A b " * 40_000, "d")]
    rng.shuffle(rows)
    return rows


def test_audit_equals_walking_all_orders(spark):
    rows = awkward_docs()
    rng = random.Random(6)
    labels = [(d, rng.choice([0, 1, None]), rng.choice([0, 1])) for d, _, _ in rows[::2]] + [(None, 1, 1), (5, 0, 0), (5, 1, 1)]
    docs = spark.createDataFrame([(d, t, s, 1, "p", 2) for d, t, s in rows], "doc_id long, text string, source string, id int, part string, mask int").repartition(3)
    named = spark.createDataFrame([(*x, 1) for x in labels], "doc_id long, quality int, toxic int, id int")
    lists, got = filter_audit.filter_audit(docs, named)
    assert {tuple(r) for r in got.collect()} == audit(rows, labels)
    listed = lists.collect()
    assert sum(r.documents for r in listed) == len(rows)
    for r in listed:
        assert all(list(x) == sorted(set(x)) for x in r.lists) and r.ids == sorted(r.ids, key=lambda i: (i is not None, i or 0))


def test_audit_of_nothing_and_without_labels(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.filter_audit(docs, labels)[1].count() == 0
    one = spark.createDataFrame([(1, "ok", None)], docs.schema)
    got = filter_audit.filter_audit(one, labels)[1].collect()
    assert len(got) == 600 and {tuple(r) for r in got} == audit([(1, "ok", None)], [])


def test_merge_and_gallop():
    rng = random.Random(2)
    for _ in range(200):
        n = rng.randint(1, 60)
        lists = [sorted(rng.sample(range(n), rng.randint(0, n))) for _ in range(rng.randint(1, 6))]
        weights = [rng.randint(1, 4) for _ in range(n)]
        want = defaultdict(int)
        for i in range(n):
            if held := sum(1 << k for k, x in enumerate(lists) if i in x):
                want[held] += weights[i]
        assert filter_audit.merge(lists, weights) == dict(want)
        for x in filter(None, lists):
            start = rng.randrange(len(x))
            bound = rng.randint(x[start], n)
            assert filter_audit.gallop(x, start, bound) == next((i for i in range(start, len(x)) if x[i] >= bound), len(x))


# --- prefix trie


def trie(rows):
    own = defaultdict(list)
    for c, n, role, text in rows:
        if c is not None:
            own[c].append((n, role or "", text or ""))
    md5 = lambda s: hashlib.md5(s.encode()).hexdigest()
    for c in own:
        own[c] = [(r, t) for _, r, t in sorted(own[c], key=lambda x: (x[0] is not None, x[0] or 0, md5(md5(x[1]) + md5(x[2]))))]
    whole = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        lender = c - (c - 100 * int(c / 100))
        whole[c] = own.get(lender, [])[:h] + turns[h:]
    members = defaultdict(list)
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    kids = defaultdict(list)
    for path in members:
        if path:
            kids[path[:-1]].append(path)
    leaves, saved = {}, {}
    for path in sorted(members, key=len, reverse=True):
        leaves[path] = sum(leaves[k] for k in kids[path]) if kids[path] else 1
        saved[path] = sum(saved[k] for k in kids[path]) + (len(path[-1][1]) if path else 0) * (len(members[path]) - 1)
    out = []
    for path, who in members.items():
        ends = ",".join(str(c) for c in sorted(who) if len(whole[c]) == len(path))
        out.append((min(who), len(path), min(members[path[:-1]]) if path else None, len(who), len(kids[path]), leaves[path],
                    saved[path], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def talks(seed=8):
    rng = random.Random(seed)
    texts = ["", None, "hi", "yes é", "no", "tell me", "x" * 20_000]
    rows = [(c, t, rng.choice(["user", None]), rng.choice(texts[:3] if rng.random() < 0.6 else texts))
            for c in [*range(0, 330, 3), -5, -250, 10**15] for t in range(rng.randint(1, 9))]
    rows += [(7, None, "user", "late"), (7, None, "bot", None), (7, 1, "user", "hi"), (7, 1, "user", "hi"), (None, 1, "user", "lost")]
    rows += [(c, t, "user", f"same {t}") for c in range(1000, 1090) for t in range(4)]  # many equal conversations
    rows += [(2000, t, "user", f"long {t}") for t in range(300)]  # and a long one
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("small", [prefix_trie.SMALL, 3])
def test_trie_equals_plain_python(spark, small):
    rows = talks()
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "conv_id long, turn long, role string, text string, place int, num int").repartition(4)
    got = prefix_trie.conversation_trie(df, small)
    assert sorted((tuple(r) for r in got.collect()), key=str) == trie(rows)


def test_trie_of_nothing(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert prefix_trie.conversation_trie(none).count() == 0
    lost = spark.createDataFrame([(None, 1, "user", "hi")], none.schema)
    assert prefix_trie.conversation_trie(lost).count() == 0


@pytest.mark.parametrize("small", [1, 50, 10_000])
def test_list_ranks(spark, small):
    order = list(range(700))
    random.Random(3).shuffle(order)
    arcs = spark.createDataFrame([(b, a) for a, b in zip([None, *order], order)], "id long, pred long").repartition(3)
    got = {r.id: r.rank for r in prefix_trie.list_ranks(arcs, small).collect()}
    assert got == {v: k for k, v in enumerate(order)}


# --- top-k search


def nearest(rows, every, k=10):
    def fine(v):
        return v is not None and all(x is not None and np.isfinite(x) for x in v)
    known = [(i, [int(np.floor(1024 * float(x))) for x in v]) for i, v in rows if fine(v)]
    out = []
    for i, q in {(i, tuple(v)) for i, v in known if i is not None and i % every == 0}:
        scores = [(sum(a * b for a, b in zip(q, v)), j) for j, v in known if j != i and len(v) == len(q)]
        scores.sort(key=lambda s: (-s[0], s[1] is None, s[1] or 0))
        out += [(i, r, j, s) for r, (s, j) in enumerate(scores[:k], 1)]
    return sorted(out, key=str)


def vectors(seed=5):
    rng = np.random.default_rng(seed)
    rows = [(i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(400)]
    rows += [(400 + i, rows[0][1]) for i in range(60)]  # ties
    rows += [rows[20], rows[20], (40, rows[3][1]), (None, rows[7][1]), (None, None), (60, None), (700, [None] * 8), (720, [float("nan")] * 8),
             (740, [float("inf")] + [0.0] * 7), (760, []), (780, []), (800, [0.0] * 8), (820, [1.5, 2.5]), (821, [-1.0, 0.5]), (840, [9.0] * 3)]
    return rows


@pytest.mark.parametrize("block", [pivot_search.BLOCK_VALUES, 2048])
def test_search_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(pivot_search, "BLOCK_VALUES", block)
    rows = vectors()
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<float>, label int, v int").repartition(4)
    got = pivot_search.exact_top_k(df, F.col("vec_id") % 20 == 0)
    assert sorted((tuple(r) for r in got.collect()), key=str) == nearest(rows, 20)


def test_search_of_nothing_and_huge_values(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<double>, label int")
    assert pivot_search.exact_top_k(df, F.col("vec_id") % 20 == 0).count() == 0
    rows = [(i, [float(i) * 4e4, 1e4 * (i % 3)]) for i in range(50)]
    big = spark.createDataFrame([(*r, 1) for r in rows], df.schema)
    got = pivot_search.exact_top_k(big, F.col("vec_id") % 20 == 0)
    assert sorted((tuple(r) for r in got.collect()), key=str) == nearest(rows, 20)


def test_search_skips_most_candidates():
    """Bounds do the work: on clustered vectors few candidates of other clusters are evaluated."""
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(20, 16)) * 2000
    x = (centres[rng.integers(0, 20, 4000)] + rng.normal(size=(4000, 16)) * 50).astype(np.int64)
    pivots = pivot_search._far_apart(x[:500], 24)
    xd = pivot_search._distances(x, pivots)
    seen = 0
    plain = pivot_search._products

    def counted(a, b):
        nonlocal seen
        seen += len(b)
        return plain(a, b)

    pivot_search._products = counted
    try:
        found = pivot_search._eliminate(x[0], xd[:, 0], 0, None, np.arange(4000), x, xd, xd[0] ** 2, 10)
    finally:
        pivot_search._products = plain
    want = sorted((x[1:] @ x[0]).tolist(), reverse=True)[:10]
    assert sorted((s for s, _ in found), reverse=True)[:10] == want and seen < 1200
