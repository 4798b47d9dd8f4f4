import random

import numpy as np
import pytest
from pulsegrid.llm import jaccard, links


def brute(rows, n, num, den):
    sets, parent = {}, {}
    for id_, text in rows:
        w = (text or "").lower().split()
        sets[id_] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} or ({tuple(w)} if w else set())
        parent[id_] = id_

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and den * both >= num * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return sorted((d, len(sets[d]), find(d)) for d in ids)


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice(["the", "of", "and"]) if rng.random() < 0.3 else "w%d" % rng.randint(0, 400)
    common = [word() for _ in range(40)]
    rows = [(1000, None), (1001, ""), (1002, "one"), (1003, "One"), (1004, "two words"), (1005, " \t\n ")]
    for family in range(12):
        base = [word() for _ in range(rng.choice([4, 9, 30, 120, 400]))]
        if family % 3 == 0:
            base += common
        for _ in range(rng.choice([1, 3, 15])):
            text = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 40))):
                text[rng.randrange(len(text))] = word()
            rows.append((len(rows), " ".join(text)))
    return rows


@pytest.mark.parametrize("seed,n,num,den", [(1, 3, 90, 100), (2, 5, 80, 100), (3, 3, 50, 100)])
def test_against_all_pairs(spark, monkeypatch, seed, n, num, den):
    monkeypatch.setattr(jaccard, "TILE", 4)  # tiles of many blocks
    rows = corpus(seed)
    got = jaccard.join(spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, n string"), n, num, den).collect()
    assert sorted((r.id, r.n_shingles, r.component_id) for r in got) == brute(rows, n, num, den)


def test_null_ids_and_nothing(spark):
    got = jaccard.join(spark.createDataFrame([(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (2, "a b c d e f")], "doc_id long, text string"))
    assert sorted(((r.id or -1), r.n_shingles, r.component_id or -1) for r in got.collect()) == [(-1, 2, -1), (2, 2, 2), (3, 2, 2), (3, 2, 2)]
    assert jaccard.join(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_bits_never_exceed_differences():
    rng = np.random.default_rng(3)
    for _ in range(50):
        a = np.unique(rng.integers(0, 1 << 63, 300, dtype=np.uint64))
        b = np.union1d(a[rng.random(len(a)) < 0.8], rng.integers(0, 1 << 63, 30, dtype=np.uint64))
        x, y = jaccard.folded([jaccard.signature(s, 80, 100) for s in (a, b)])
        bits = np.bitwise_count(x ^ y).sum()
        assert bits <= len(np.setxor1d(a, b))


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(45)] + [(100, i) for i in range(101, 130)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {r.id: r.root for r in links.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent if any(x in e and e[0] != e[1] for e in edges)}


def test_large_group_of_near_copies_in_several_components(spark, monkeypatch):
    """2,000 copies of three texts, each with words of its own replaced: which are linked depends on the pair."""
    monkeypatch.setattr(jaccard, "TILE", 64)
    monkeypatch.setattr(jaccard, "PARTNERS", 50)
    rng = random.Random(8)
    rows = []
    for family in range(3):
        base = ["w%d" % rng.randint(0, 5000) for _ in range(60)]
        for _ in range(2000 // 3):
            text = list(base)
            for at in rng.sample(range(60), rng.choice([0, 1, 1, 2, 2, 3])):
                text[at] = "x%d" % rng.randint(0, 10**9)
            rows.append((len(rows), " ".join(text)))
    rng.shuffle(rows)
    got = {r.id: r.component_id for r in jaccard.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(7), 3, 80, 100).collect()}
    sets = {i: frozenset(tuple(w[k : k + 3]) for k in range(len(w) - 2)) for i, w in ((i, t.split()) for i, t in rows)}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for family in range(3):
        ids = range(family * (2000 // 3), (family + 1) * (2000 // 3))
        for i in ids:
            for j in range(i + 1, ids[-1] + 1):
                if find(i) != find(j):
                    both = len(sets[i] & sets[j])
                    if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                        x, y = find(i), find(j)
                        parent[max(x, y)] = min(x, y)
    assert got == {i: find(i) for i in sets}
    assert len(set(got.values())) > 3


def test_long_texts_repeated_ids_and_first(spark):
    long = " ".join(f"w{i}" for i in range(40_000))
    rows = [(1, long), (2, long + " and some more"), (3, "one two three four five six seven"), (3, "other words than these are here now"), (4, "other words than these are here now"), (None, "one two three four five six seven"), (5, None), (5, " ")]
    got = jaccard.join(spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, mark long").repartition(3), 5, 80, 100).collect()
    assert sorted((r.id or 0, r.n_shingles, r.component_id or 0, r.first) for r in got) == [(0, 3, 0, True), (1, 39996, 1, True), (2, 39999, 1, False), (3, 3, 3, True), (3, 3, 3, True), (4, 3, 3, False), (5, 0, 5, True), (5, 0, 5, True)]


def test_forest_spans_with_the_closest():
    rng = np.random.default_rng(5)
    for _ in range(50):
        nodes = int(rng.integers(2, 30))
        edges = [(int(x), int(y)) for x, y in rng.integers(0, nodes, (60, 2)) if x != y]
        kept = jaccard.forest(*np.array(edges).T, nodes)
        up, want = list(range(nodes)), []

        def top(x):
            while up[x] != x:
                x = up[x]
            return x

        for e, (x, y) in enumerate(edges):
            if top(x) != top(y):
                up[max(top(x), top(y))] = min(top(x), top(y))
                want.append(e)
        assert kept.tolist() == want
