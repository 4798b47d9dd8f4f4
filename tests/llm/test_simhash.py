import hashlib
import random
import zlib

import numpy as np
from pulsegrid.llm import simhash
from pyspark.sql import functions as F


def text(rng, n):
    return " ".join("w%d" % rng.randint(0, 3000) for _ in range(n))


def test_table(spark):
    rng = random.Random(1)
    rows = [(i * 3, text(rng, rng.randint(1, 200))) for i in range(80)] + [(1000, None), (1001, ""), (1002, "é" * 5001), (2000, "twice"), (2000, "twice")]
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, n_chars string").repartition(3)
    got = simhash.fingerprint(df).collect()
    order = sorted(rows, key=lambda r: r[0])
    want = []
    for i, (id_, t) in enumerate(order):
        t, following = t or "", order[(i + 1) % len(order)][1] or ""
        half = len(t) // 2
        want.append((id_, len(t), hashlib.sha256((t[: len(t) - half] + following[:half]).encode()).hexdigest()))
    assert sorted((r.id, r.n_chars, r.edited_sha256) for r in got) == sorted(want)
    assert len({r.fingerprint for r in got if r.id == 2000}) == 1
    long = [r for r in got if r.n_chars > 300 and r.id < 1000]
    assert np.mean([r.near_edited > r.near_next for r in long]) > 0.95
    one = simhash.fingerprint(spark.createDataFrame([(5, "abcd")], "doc_id long, text string")).first()
    assert one.edited_sha256 == hashlib.sha256(b"abab").hexdigest() and one.near_next == 1.0
    assert simhash.fingerprint(df.limit(0)).count() == 0


def test_search_is_exact(spark):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2, (20, simhash.BITS), dtype=np.uint8)
    bits = np.concatenate([base] + [base ^ (rng.random(base.shape) < p).astype(np.uint8) for p in (0.01, 0.02, 0.03, 0.05)] + [base[:5]])
    prints = [np.packbits(b).tobytes().hex() for b in bits]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(prints)], "id long, fingerprint string")
    got = {r.query: r.n_near for r in simhash.search(df, df.where(F.col("id") % 3 == 0)).collect()}
    want = {prints[i]: int(((bits[i] ^ bits).sum(1) <= simhash.RADIUS).sum()) for i in range(0, len(bits), 3)}
    assert got == want and max(want.values()) > 1


def test_near_copies_are_met(spark):
    """Copies whose five-word shingles have a Jaccard likeness of 0.8 or more; other texts are not met."""
    rng = random.Random(3)
    rows = []
    for i in range(200):
        words = ["w%d" % rng.randint(0, 30000) for _ in range(rng.choice([200, 400, 1000]))]
        copy = list(words)
        for at in rng.sample(range(len(words)), len(words) // 80):
            copy[at] = "other%d" % i
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(copy))]
    prints = simhash.fingerprints([t for _, t in rows])
    df = spark.createDataFrame([(i, p.tobytes().hex()) for (i, _), p in zip(rows, prints)], "doc_id long, fingerprint string")
    name = {p.tobytes().hex(): i for (i, _), p in zip(rows, prints)}
    got = {(name[r.query], r.doc_id) for r in simhash.neighbours(df, df.where("doc_id % 2 = 0")).collect()}
    assert {(i, i) for i in range(0, 400, 2)} <= got and all(a == b // 2 * 2 for a, b in got)
    assert sum(a != b for a, b in got) / 200 > 0.95
    counted = {name[r.query]: r.n_near for r in simhash.search(df, df.where("doc_id % 2 = 0")).collect()}
    assert counted == {i: sum(a == i for a, _ in got) for i in range(0, 400, 2)}


def test_fingerprint_against_plain_votes():
    """Each distinct pair of words votes on every bit by its hash, with weight 1 + ln n."""
    rng = random.Random(9)
    texts = ["one", "one two", "a b a b a b c", text(rng, 50), text(rng, 30) * 3, "Same SAME same"]
    got = simhash.fingerprints(texts)
    for row, t in zip(got, texts):
        hashes = simhash.tk.words(*simhash.tk.buffers(simhash.pa.array([t])))[0]
        pairs = [int(h) for h in simhash.tk.shingles(hashes, 2)]
        votes = [0.0] * simhash.BITS
        for h in set(pairs):
            weight = 1 + np.log(pairs.count(h))
            for k in range(simhash.WORDS):
                raw = simhash.tk.mix(np.array([h], np.uint64) + simhash._SEEDS[k]).view(np.uint8)
                for b, bit in enumerate(np.unpackbits(raw).tolist()):
                    votes[64 * k + b] += weight if bit else -weight
        assert np.packbits(np.array(votes) > 1e-3).view(np.uint64).tolist() == row.tolist() or np.bitwise_count(np.packbits(np.array(votes) > 0).view(np.uint64) ^ row).sum() <= 2
    assert (simhash.fingerprints(["", " "]) == 0).all()


def test_an_id_of_half_the_rows_is_dealt_over_buckets(spark):
    """Null ids, and one id of many rows, in the order of a hash of their texts."""
    rng = random.Random(10)
    rows = [(None, text(rng, 8)) for _ in range(150)] + [(7, text(rng, 8)) for _ in range(150)] + [(i, text(rng, 8)) for i in range(0, 300, 3)]
    rng.shuffle(rows)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, zlib.crc32(r[1].encode())))
    want = []
    for i, (id_, t) in enumerate(order):
        half = len(t) // 2
        want.append((id_ if id_ is not None else -1, hashlib.sha256((t[: len(t) - half] + order[(i + 1) % len(order)][1][:half]).encode()).hexdigest()))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = simhash.fingerprint(df).collect()
    assert sorted((r.id if r.id is not None else -1, r.edited_sha256) for r in got) == sorted(want)
    chain = simhash.chained(df.select(df.doc_id.alias("id"), "text"), 8)
    sizes = [r["count"] for r in chain.where("extra = 0").groupBy("bucket").count().collect()]
    assert sum(sizes) == len(rows) and max(sizes) < 100


def test_ranges_keep_the_order():
    rng = np.random.default_rng(6)
    key, tie = np.sort(rng.integers(0, 20, 500)), rng.integers(0, 1 << 32, 500)
    tie = tie[np.lexsort((tie, key))]
    order = np.lexsort((tie, key))
    for cuts in ([], [3], [3, 3, 3, 9, 12, 12], [0, 0, 19, 19, 19]):
        bucket = simhash.Ranges(cuts).bucket(key[order], tie[order])
        assert (np.diff(bucket) >= 0).all()


def test_blocks_of_many_entries_are_dealt_over_tasks(spark, monkeypatch):
    """One part that half of all entries share makes a hot block, which is cut, without losing or repeating a pair."""
    rng = np.random.default_rng(12)
    bits = rng.integers(0, 2, (300, simhash.BITS)).astype(np.uint8)
    bits[:150] = bits[0]
    for row in bits[:150]:
        row[rng.choice(np.arange(16, simhash.BITS), rng.integers(0, 45), replace=False)] ^= 1
    prints = [np.packbits(b).tobytes().hex() for b in bits]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(prints)] + [(1000, prints[3])], "doc_id long, fingerprint string")
    monkeypatch.setattr(simhash, "BLOCK_ENTRIES", 20)
    monkeypatch.setattr(simhash, "COMPARED", 64)
    everything = np.vstack([bits, bits[3]])
    near = (bits[:, None, :] ^ everything).sum(2) <= simhash.RADIUS
    assert {r.query: r.n_near for r in simhash.search(df, df).collect()} == {p: int(near[i].sum()) for i, p in enumerate(prints)}
    pairs = sorted((r.query, r.doc_id) for r in simhash.neighbours(df, df.where("doc_id % 7 = 0")).collect())
    assert pairs == sorted((prints[i], j if j < 300 else 1000) for i in range(0, 300, 7) for j in np.flatnonzero(near[i]).tolist())


def test_very_long_text(spark):
    long = "word " * 400_000
    got = {r.id: r for r in simhash.fingerprint(spark.createDataFrame([(1, long), (2, None)], "doc_id long, text string")).collect()}
    assert got[1].n_chars == 2_000_000 and got[1].edited_sha256 == hashlib.sha256(long[:1_000_000].encode()).hexdigest() and got[2].edited_sha256 == hashlib.sha256(b"").hexdigest()
