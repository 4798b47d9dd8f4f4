import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pulsegrid.llm import textkernel as tk
from pulsegrid.llm import toxicity

BAD = ["idiotic", "disgusting", "worthless", "pathetic"]


def test_learns_and_sees_misspellings(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice(["ta", "ne", "ro", "si", "lu", "mi"]) for _ in range(rng.randint(1, 3)))
    rows = []
    for i in range(300):
        words = [word() for _ in range(rng.randint(10, 60))]
        if i % 3 == 0:
            for _ in range(3):
                words[rng.randrange(len(words))] = rng.choice(BAD)
        rows.append((i, " ".join(words), 1 if i % 3 == 0 else 0))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(df)
    clean = " ".join(word() for _ in range(20))
    probe = [(0, clean, 0), (1, clean + " disgustting worthles pathetik", 1), (2, None, 0), (3, "", 0), (4, clean, 0), (5, " ".join(word() for _ in range(30_000)), 0)]
    got = {r.doc_id: r.score for r in toxicity.score(spark.createDataFrame(probe, "doc_id long, text string, toxic int"), model).collect()}
    assert got[1] > 0.5 > got[0] and got[0] == got[4] and got[2] == got[3] and all(0 <= s <= 1 for s in got.values())
    right = [(r.score >= 0.5) == bool(r.toxic) for r in toxicity.score(df, model).collect()]
    assert sum(right) / len(right) > 0.97


def test_nothing_to_learn(spark):
    df = spark.createDataFrame([(1, "a", 0), (None, None, None)], "doc_id long, text string, toxic int")
    assert toxicity.fit(df) is None and {r.score for r in toxicity.score(df, None).collect()} == {0.0}
    assert toxicity.score(df.limit(0), None).count() == 0


def plain_features(text):
    """Weights of the words and of the 3- to 5-byte n-grams of each distinct word, by plain Python: a space on one side may be part of one, not both."""
    raw = bytes(32 if b < 128 and not chr(b).isalnum() else b for b in text.translate({i: i + 32 for i in range(65, 91)}).encode())
    out = Counter()
    for word, n in Counter(w for w in raw.split(b" ") if w).items():
        wide = b" " + word + b" "
        grams = {size: max(0, len(wide) - size + 1) - (len(wide) == size) for size in toxicity.ORDERS}
        out.update(grams, word=1)
        out["weight"] += (1 + math.log(n)) * (1 + sum(grams.values()))
    return out


def test_features_against_plain_python():
    texts = ["", "a", "Hello, hello world", "x y z x x", "trés long-worded  texte!", "ab", "one two three four five " * 7, "..!"]
    _, _, data, at = next(tk.blocks(pa.array(texts), 1 << 20))
    bucket, owner, weight = toxicity.features(data, at)
    for i, text in enumerate(texts):
        want = plain_features(text)
        own = owner == i
        assert own.sum() == sum(want[k] for k in ("word", *toxicity.ORDERS)), text
        assert math.isclose(weight[own].sum(), want["weight"], rel_tol=1e-5, abs_tol=1e-6)
    first, second = bucket[owner == 2], bucket[owner == 3]
    assert len(set(first)) > 20 and not set(first) & set(second)
    assert re.fullmatch(r"\d+", str(int(first[0])))


def test_gradients_against_differences():
    rng = np.random.default_rng(3)
    embed, soft, bias = rng.normal(size=(3, 10)), rng.normal(size=(3, 2)), rng.normal(size=2)
    at, text, labels = rng.integers(0, 10, 30), np.sort(rng.integers(0, 6, 30)), rng.integers(0, 2, 6)
    part = rng.random(30)
    loss = lambda: toxicity.gradients(embed, soft, bias, at, part, text, labels)[0]
    _, g_soft, g_bias, g_embed, uniq = toxicity.gradients(embed, soft, bias, at, part, text, labels)
    full = np.zeros_like(embed)
    full[:, uniq] = g_embed
    for values, gradient in ((embed, full), (soft, g_soft), (bias, g_bias)):
        for i in np.ndindex(values.shape):
            values[i] += 1e-6
            up = loss()
            values[i] -= 2e-6
            down = loss()
            values[i] += 1e-6
            assert abs((up - down) / 2e-6 - gradient[i]) < 1e-6


def test_one_toxic_label_of_several_counts(spark, monkeypatch):
    seen = {}
    monkeypatch.setattr(toxicity, "fit", lambda rows, *_: seen.update({r.doc_id: r.toxic for r in rows.collect()}))
    docs = spark.createDataFrame([(i, "t") for i in range(20)] + [(None, "n")], "doc_id long, text string")
    toxicity.train_on(docs, spark.createDataFrame([(i, 0) for i in range(20)] + [(i, 1) for i in range(0, 20, 2)] + [(3, None), (None, 1)], "doc_id long, toxic int"))
    out = {r.doc_id: r.h for r in docs.select("doc_id", toxicity.held_out(docs.doc_id).alias("h")).collect()}
    assert seen == {i: int(i % 2 == 0) for i in range(20) if not out[i]} and out[None] is False
