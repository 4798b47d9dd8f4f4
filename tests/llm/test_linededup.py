import random

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pulsegrid.llm import linededup
from pulsegrid.llm.linededup import Cuckoo, Index


def hashes(seed, n):
    return np.random.default_rng(seed).integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def test_filter_holds_what_it_was_given():
    own, others = hashes(1, 50_000), hashes(2, 50_000)
    f = Cuckoo.sized(len(own))
    for part in np.array_split(own, 7):
        f.insert(part)
    assert len(f) == 50_000 and not len(f.rest) and f.contains(own).all()
    assert f.contains(others).mean() < 0.001
    f = Cuckoo.load(f.dump())
    f.delete(own[:30_000])
    assert len(f) == 20_000 and f.contains(own[30_000:]).all() and f.contains(own[:30_000]).mean() < 0.001
    f.delete(own[30_000:])
    assert len(f) == 0


def test_full_filter_keeps_the_rest_beside_it():
    own = np.concatenate([hashes(3, 3000), np.full(40, hashes(4, 1)[0])])
    f = Cuckoo.sized(100)
    f.insert(own)
    f = Cuckoo.load(f.dump())
    assert len(f) == len(own) and len(f.rest) > 0 and f.contains(own).all()
    f.delete(own[:1500])
    assert f.contains(own[1500:]).all()
    f.delete(own[1500:])
    assert len(f) == 0


def brute(rows, least=linededup.LEAST):
    key = lambda line: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))
    name = lambda i: (i is None, i or 0)
    holders = {}
    for i, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= least:
                holders.setdefault(key(line), set()).add(name(i))
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(holders.get(key(x), ())) < 2 or min(holders[key(x)]) == name(i)]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def frame(spark, rows, parts=4):
    return spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, block int, k1 int").repartition(parts)


def read(index):
    return sorted(map(tuple, index.result().collect()), key=str)


def texts(seed, ids):
    r = random.Random(seed)
    lines = ["", "short", "exactly 10", "A Line That Many Have", "a line that many have ", "\té" + "é" * 8, "é" * 10, "Éé" * 5, "éé" * 5, "  not a blank here", "x" * 70]
    return [(i, "\n".join([r.choice([*lines, f"line {r.randrange(40)} of some text"]) + r.choice(["", " ", "\r"]) for _ in range(r.randrange(9))])) for i in ids]


def test_against_brute_force(spark):
    rows = texts(1, range(-20, 150)) + [(None, "a line that many have\nlonely line of no id"), (None, "lonely line of no id"), (7, None), (7, "a line that many have"), (500, ""), (501, "the long line " * 30_000 + "\nx\n" + "another one here\n" * 3000)]
    rows += [(1000 + i, "in all the copies\nand this too, in all") for i in range(200)]
    assert read(Index(spark).insert(frame(spark, rows))) == brute(rows)


def test_insertions_and_deletions_leave_no_trace(spark, monkeypatch):
    monkeypatch.setattr(linededup, "BLOCK_BYTES", 300)
    monkeypatch.setattr(linededup, "WAVE", 16)
    one, two, three = texts(2, range(50, 90)), texts(3, range(0, 60)), texts(4, range(200, 230))
    index = Index(spark).insert(frame(spark, one))
    before = read(index)
    assert before == brute(one)
    both = index.insert(frame(spark, two)).insert(frame(spark, three))
    assert read(both) == brute(one + two + three)
    drop = spark.createDataFrame([(i,) for i in range(0, 50)] + [(i,) for i in range(200, 230)] + [(None,), (9999,)], "doc_id long")
    left = both.delete(drop)
    stay = one + [x for x in two if x[0] >= 50]
    assert read(left) == brute(stay)
    none = left.delete(spark.createDataFrame([(i,) for i in range(50, 90)], "doc_id long"))
    assert read(none) == [] and none.references().count() == 0
    assert sum(len(Cuckoo.load(r["filter"])) for r in none.state.where("filter IS NOT NULL").collect()) == 0
    assert read(none.insert(frame(spark, one))) == before
    counts = {(r.k1, r.k2): (r.docs, r.low, r.high) for r in left.references().collect()}
    anew = {(r.k1, r.k2): (r.docs, r.low, r.high) for r in Index(spark).insert(frame(spark, stay)).references().collect()}
    assert counts == anew


def test_shards_are_dealt_anew(spark, monkeypatch):
    monkeypatch.setattr(linededup, "SHARD_CELLS", 4)
    monkeypatch.setattr(linededup, "BLOCK_BYTES", 50)
    one, two = texts(5, range(5)), texts(6, range(5, 120))
    index = Index(spark).insert(frame(spark, one))
    more = index.insert(frame(spark, two))
    assert more.shards > index.shards and read(more) == brute(one + two)


def test_empty(spark):
    assert read(Index(spark).insert(frame(spark, []))) == []
    assert linededup.deduplicated(frame(spark, [(1, None)])).first()[:3] == (1, 1, 0)


def cells(rows):
    names = ["kind", "block", "k1", "k2", "docs", "low", "high"]
    return {c: np.array([r[i] for r in rows], np.int64) for i, c in enumerate(names)}


@settings(deadline=None, max_examples=60)
@given(st.lists(st.lists(st.tuples(st.integers(0, 12), st.integers(0, 30)), max_size=12), min_size=1, max_size=6))
def test_settled_shard_against_counts(steps):
    """Blocks of (key, id) come and go in turn; a filter of few bits makes false suspects common."""
    filter_, known, live, number = None, (np.zeros(0, np.int64),) * 2, {}, 0
    for step, pairs in enumerate(steps):
        gone = [live.pop(b) for b in list(live)[:1]] if step % 3 == 2 else []
        block = {}
        for key, id_ in set(pairs):
            block.setdefault(key, []).append(id_)
        row = lambda kind, b, held: [(kind, b, k << 50, k % 3, len(i), min(i), max(i)) for k, i in held.items()]
        rows = [r for b, held in live.items() for r in row(linededup.LIVE, b, held)] + row(linededup.NEW, number, block) + [r for held in gone for r in row(linededup.GONE, -1, held)]
        live[number] = block
        number += 1
        filter_, refs, answers = linededup.settle(0, cells(rows), filter_, known)
        known = (refs["k1"], refs["k2"])
        holders = {}
        for held in live.values():
            for k, i in held.items():
                holders.setdefault(k, []).extend(i)
        want = {(k << 50, k % 3): (len(i), min(i), max(i)) for k, i in holders.items() if min(i) < max(i)}
        assert {(a, b): x for a, b, *x in zip(*(refs[c].tolist() for c in ("k1", "k2")), zip(*(refs[c].tolist() for c in ("docs", "low", "high"))))} == {k: [v] for k, v in want.items()}
        assert len(filter_) == len(holders)
        assert len(answers["k1"]) == sum((k << 50, k % 3) in want for held in live.values() for k in held)


def test_filter_bytes_are_whole():
    f = Cuckoo.sized(1)
    f.insert(np.full(300, 5, np.uint64))
    assert isinstance(pa.py_buffer(f.dump()), pa.Buffer) and len(Cuckoo.load(f.dump())) == 300
