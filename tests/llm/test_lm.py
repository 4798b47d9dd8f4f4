import math
import re
import zlib
from collections import Counter

import numpy as np
from pulsegrid.llm import lm
from pulsegrid.llm import textkernel as tk
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_levels_and_their_counts():
    c = np.unique(np.concatenate([np.arange(1, 5000), 2 ** np.arange(1, 40), 2 ** np.arange(2, 40) - 1]))
    level = lm.level(c)
    assert (np.diff(level) >= 0).all() and level.max() < lm.LEVELS and lm.level(np.array([0]))[0] == 0 and lm.count_at(np.array([0]))[0] == 0
    back = lm.count_at(level)
    assert (back[c < 8] == c[c < 8]).all() and (abs(back / c - 1) <= 0.125).all()
    for one in np.unique(level[c < 4000]):  # the middle of the counts of a level
        assert back[level == one][0] == c[(level == one)].mean() or c[level == one].max() >= 4000


def test_filter_reads_back_levels():
    rng = np.random.default_rng(2)
    key = rng.integers(0, 1 << 48, 40000, dtype=np.uint64)
    level = rng.integers(1, 12, 40000)
    made = lm.Filter.of(key, level)
    got = made.levels(key)
    assert (got >= level).all() and (got == level).mean() > 0.985
    assert 0.003 < (made.levels(rng.integers(0, 1 << 48, 40000, dtype=np.uint64)) > 0).mean() < 0.007


def test_scores(spark):
    rows = [(i, "the cat sat on the Mat number%d " % (i % 7) * (i % 5), "x") for i in range(120)] + [(200, None, "x"), (201, "", "x"), (202, "zzz unseen", "x"), (7, "the cat", "y"), (7, "the cat", "y"), (None, "dog", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, score string").repartition(3)
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    got = lm.scores(df, held).collect()
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    cut = lambda t: [*map(str.lower, WORD.findall(t or "")), None]
    c = Counter(w for i, t, _ in rows if not out(i) for w in cut(t))
    n, v = sum(c.values()), len(c)
    want = sorted((out(i), len(cut(t)), sum(c[w] > 0 for w in cut(t)), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in cut(t)), 6)) for i, t, _ in rows)
    assert sorted((r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert sum(r.score for r in got) > sum(r.base_score for r in got) and all(r.score <= 0 for r in got)
    assert lm.scores(df.limit(0), held).count() == 0
    alone = lm.scores(df.where("doc_id = 202"), F.lit(True)).first()
    assert (alone.n_tokens, alone.n_known, alone.train_tokens) == (3, 0, 0)


def zipf_corpus():
    rng = np.random.default_rng(4)
    rows = [(i, "one text that stands there many times") for i in range(300)]
    return rows + [(i, " ".join("w%d x%d" % (k, k % 90) for k in rng.zipf(1.4, rng.integers(1, 30)) % 2000)) for i in range(300, 1300)]


def test_scores_follow_all_pairs_and_all_training_texts(spark, monkeypatch):
    """Against a plain model of exact counts; several shards a route, several blocks a task."""
    monkeypatch.setattr(lm, "LEAST_ROUTES", 4)
    monkeypatch.setattr(lm, "ASK_BYTES", 3000)
    rows = zipf_corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.id: r.score for r in lm.scores(df, F.col("doc_id") % 5 == 0).collect()}
    cut = lambda t: [*WORD.findall(t), None]
    ones, twos = Counter(), Counter()
    for i, t in rows:
        if i % 5:
            ones.update(cut(t))
            twos.update(zip([None, *cut(t)], cut(t)))
    middle = lambda c: float(lm.count_at(lm.level(np.array([c])))[0])
    v, mass = len(ones), sum(map(middle, ones.values()))

    def estimates(t, less, near):
        for a, b in zip([None, *cut(t)], cut(t)):
            before, count, both = ones[a], near(ones[b]), near(twos[a, b])
            yield min(1, max(min(both, count) - less, 0) / max(before - less, 1)), (max(count - less, 0) + 1) / (mass + v + 1)

    def model(near):
        two, one = map(np.array, zip(*(x for i, t in rows if i % 5 for x in estimates(t, 1, near))))
        share = 0.3
        for _ in range(30):
            share = float(np.mean(share * two / (share * two + (1 - share) * one)))
        return {i: sum(math.log10(share * p + (1 - share) * q) for p, q in estimates(t, 0, near)) for i, t in rows}

    read, exact = model(middle), model(float)
    close = lambda i, want, by: abs(got[i] - want[i]) < by * abs(want[i]) + 1e-2
    assert np.mean([close(i, read, 2e-3) for i in read]) > 0.94  # the others have an n-gram that is read a level too high
    assert all(got[i] > read[i] - 2e-3 * abs(read[i]) - 1e-2 for i in read)  # which only adds
    assert np.mean([close(i, exact, 0.02) for i in exact]) > 0.97


def test_probabilities_sum_to_one(spark):
    """Over the vocabulary and the unseen word, after each context, with what the model's shards answer."""
    model = lm.train(spark.createDataFrame([(t,) for _, t in zipf_corpus()], "text string"))
    shards = {}
    for r in model.shards.collect():
        word, c = tk.unpacked(bytes(r.words), r.n_words, 8, lm.COUNT_BYTES)
        shards[r.shard] = word, c.astype(np.int64), lm.Filter(np.frombuffer(bytes(r.filter), np.uint8))
    words, counts = (np.concatenate([s[k] for s in shards.values()]) for k in (0, 1))
    assert (len(words), counts.sum()) == (model.v, model.n)

    def levels(key, bits):
        shard = (key >> np.uint64(bits - model.shard_bits)).astype(int)
        return np.array([shards[s][2].levels(k[None])[0] if s in shards else 0 for s, k in zip(shard.tolist(), key)], np.int64)

    own = levels(words, 64)
    unseen = 1 / (model.mass + model.v + 1)
    for v in np.argsort(-counts)[[0, 1, 5, 20, 100, -1]]:
        tokens = np.stack([np.full(len(words), words[v]), words], 1).ravel()
        pair = lm.pairs(tokens, np.array([0, len(tokens)]), model.pair_bits)[1::2]
        two, one = lm.likelihood(lm.coded(levels(pair, model.pair_bits), own, np.full(len(words), counts[v])), model.mass, model.v)
        assert abs(one.sum() + unseen - 1) < 0.01
        false = 0.005 * len(words) / counts[v]  # words that the filter takes for seen once after v
        assert -0.125 < two.sum() - 1 < 0.125 + 2 * false
