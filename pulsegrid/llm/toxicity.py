"""Toxicity of whole texts: averaged subword embeddings under a linear softmax.

A text is the bag of its distinct words (one said n times weighs 1 + ln n) and of their 3- to 5-byte n-grams, the
space on either side of a word included.  Every feature hashes into a bucket with an
embedding; the text's vector is their average, and a linear softmax over it says
toxic or not.  Embeddings and softmax are trained jointly, in NumPy, on a sample
of labelled rows with a documented bound.  A misspelling never seen in training
shares most n-grams with the word it hides, hence most of its vector.

Since softmax and average are linear, a trained model folds into one number a
bucket; scoring adds those up over all features of a whole text.

Defined results: null and empty texts have no features, so they get the score of
the bias alone; rows with a null label, id or text are never trained on; with no
labelled row of either class every text gets the score 0; a row labelled several times
is toxic if one label says so; repeated and tied rows are scored alike; a null id is not held out; columns other than id and text pass through untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import scratch
from . import textkernel as tk

BUCKETS = 1 << 18
DIM = 4
ORDERS = (3, 4, 5)
#: At most so many rows of each class are trained on.
SAMPLE = {1: 1600, 0: 3200}
#: At most so many bytes of text of each class, of the rows that come first.
SAMPLE_BYTES = 1 << 26
#: Bytes of text whose features are found at once; these take many times as much.
BLOCK_BYTES = 1 << 18
EPOCHS = 6
SCALE = 100.0
#: The highest bias, so the log odds of a text without known features.
SILENT = -0.2
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[[b for b in range(128) if not chr(b).isalnum()]] = 32


def features(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, text, weight) of every feature of a block of texts; a word that a text says n times weighs 1 + ln n."""
    padded = np.full(len(data) + 2 * len(at), 32, np.uint8)
    shift = at[:-1] + 2 * np.arange(len(at) - 1) + 1
    place = np.arange(len(data)) + np.repeat(shift - at[:-1], np.diff(at))
    padded[place] = _FOLD[data]
    edges = np.append(shift - 1, len(padded))
    gap = padded == 32
    hashes, counts, first = tk.words(padded, edges)
    text = np.repeat(np.arange(len(at) - 1), np.diff(counts))
    _, once, often = np.unique(tk.mix(hashes + text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True, return_counts=True)
    heavy = np.zeros(len(hashes), np.float32)
    heavy[once] = 1 + np.log(often)
    keep = heavy > 0
    found, owner, weight = [(hashes[keep] & np.uint64(BUCKETS - 1)).astype(np.int32)], [text[keep]], [heavy[keep]]
    begins = np.zeros(len(padded), np.int64)
    begins[first] = 1
    word = np.cumsum(begins) - 1
    solid = np.append(keep, False)[word] & ~gap
    heavy = np.append(heavy, 0)
    before = np.append(solid[1:], False) & gap
    wide = padded.astype(np.uint64)
    for n in ORDERS:
        size = len(padded) - n + 1
        if size <= 0:
            continue
        ok = solid[:size] | before[:size]
        for i in range(1, n - 1):
            ok &= ~gap[i : i + size]
        ok &= ~(gap[:size] & gap[n - 1 :])
        starts = np.flatnonzero(ok)
        h = np.full(len(starts), n, np.uint64)
        for i in range(n):
            h = h * np.uint64(0x100000001B3) ^ wide[starts + i]
        found.append((tk.mix(h) & np.uint64(BUCKETS - 1)).astype(np.int32))
        owner.append(np.searchsorted(edges, starts, side="right") - 1)
        weight.append(heavy[word[starts + before[starts]]])
    return np.concatenate(found), np.concatenate(owner), np.concatenate(weight)


def gradients(embed: np.ndarray, soft: np.ndarray, bias: np.ndarray, at: np.ndarray, part: np.ndarray, text: np.ndarray, labels: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(loss, of softmax, of bias, of embeddings, their buckets): mean cross entropy of bags, and its gradients.

    A bag is a text's buckets ``at`` with their shares ``part``; ``text`` numbers the bags.
    """
    n = len(labels)
    mean = np.stack([np.bincount(text, part * embed[d, at], n) for d in range(len(embed))], 1)
    z = mean @ soft + bias
    p = np.exp(z - z.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    loss = -float(np.log(np.maximum(p[np.arange(n), labels], 1e-300)).mean())
    p[np.arange(n), labels] -= 1
    p /= n
    back = p @ soft.T
    uniq, inverse = np.unique(at, return_inverse=True)
    g_embed = np.stack([np.bincount(inverse, part * back[text, d], len(uniq)) for d in range(len(embed))])
    return loss, mean.T @ p, p.sum(0), g_embed, uniq


def train(buckets: list[np.ndarray], shares: list[np.ndarray], labels: np.ndarray, prior: float, seed: int = 7) -> tuple[np.ndarray, float]:
    """(one number a bucket, bias) from bags: each text's distinct buckets and their shares of its features.

    Minibatch Adagrad on embeddings, softmax weights and biases together, on four
    fifths of the bags.  The last fifth then moves the bias to where the F1 measure is
    highest when toxic rows are ``prior`` of all.  The bias never rises above SILENT,
    neither in training nor then: a text that says nothing known is not toxic.
    """
    rng = np.random.Generator(np.random.PCG64(seed))
    embed = np.zeros((DIM, BUCKETS))  # a feature never trained on says nothing
    soft = rng.normal(0, 0.5, (DIM, 2))
    bias = np.zeros(2)
    seen_e, seen_s, seen_b = np.full((DIM, BUCKETS), 1e-12), np.full((DIM, 2), 1e-6), np.full(2, 1e-6)
    aside = np.arange(len(labels)) % 5 == 4
    order = np.flatnonzero(~aside)
    for epoch in range(EPOCHS):
        rng.shuffle(order)
        rate = 0.3 * (1 - epoch / EPOCHS)
        for lo in range(0, len(order), 64):
            rows = order[lo : lo + 64]
            at = np.concatenate([buckets[r] for r in rows])
            part = np.concatenate([shares[r] for r in rows]) * SCALE
            sizes = np.array([len(buckets[r]) for r in rows])
            text = np.repeat(np.arange(len(rows)), sizes)
            _, g_soft, g_bias, g_embed, uniq = gradients(embed, soft, bias, at, part, text, labels[rows])
            seen_e[:, uniq] += g_embed * g_embed
            embed[:, uniq] -= rate * g_embed / np.sqrt(seen_e[:, uniq])
            seen_s += g_soft**2
            seen_b += g_bias**2
            soft -= 0.1 * rate * g_soft / np.sqrt(seen_s)
            bias -= 0.1 * rate * g_bias / np.sqrt(seen_b)
            bias -= np.array([-0.5, 0.5]) * max(0.0, bias[1] - bias[0] - SILENT)
    weight = ((soft[:, 1] - soft[:, 0]) @ embed * SCALE).astype(np.float32)
    start = float(bias[1] - bias[0])
    held = np.flatnonzero(aside)
    z = np.array([float(weight[buckets[r]] @ shares[r]) for r in held]) + start
    return weight, min(SILENT, start + _shift(z, labels[held], prior))


def _shift(z: np.ndarray, labels: np.ndarray, prior: float) -> float:
    """What to add to ``z`` for the best F1 at 0, midway between the two values that it lies between."""
    if len(np.unique(labels)) < 2:
        return 0.0
    order = np.argsort(-z, kind="stable")
    hit = np.cumsum(labels[order] == 1) / np.sum(labels == 1) * prior
    wrong = np.cumsum(labels[order] == 0) / np.sum(labels == 0) * (1 - prior)
    best = int(np.argmax(2 * hit / (hit + wrong + prior)))
    low = z[order[best + 1]] if best + 1 < len(z) else z[order[best]] - 2
    return -float(z[order[best]] + low) / 2


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tk.forget()
    for batch in batches:
        for first, after, data, at in tk.blocks(batch.column("text"), BLOCK_BYTES):
            bucket, owner, weight = features(data, at)
            key, inverse = np.unique(owner.astype(np.int64) * BUCKETS + bucket, return_inverse=True)
            text, bucket = key // BUCKETS, (key % BUCKETS).astype(np.int32)
            total = np.bincount(owner, weight, after - first)
            share = (np.bincount(inverse, weight, len(key)) / total[text]).astype(np.float32)
            sizes = np.searchsorted(text, np.arange(after - first + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("label")[first:after], pa.ListArray.from_arrays(sizes, bucket), pa.ListArray.from_arrays(sizes, share)], ["label", "bucket", "share"])


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: dict[int, int] = SAMPLE) -> tuple[np.ndarray, float] | None:
    """A model from a bounded sample of ``labelled``: of each class the ``sample[class]`` rows that come first by a hash of the id, as far as SAMPLE_BYTES go.

    None when a class has no row.
    """
    rows = labelled.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(label_col).cast("int").alias("label")).where("id IS NOT NULL AND text IS NOT NULL AND label IN (0, 1)")
    scratch.lean(labelled.sparkSession)
    n = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    if not n.get(0) or not n.get(1):
        return None
    picked = None
    for label, most in sample.items():
        share = min(1.0, 1.2 * most / n[label])
        part = rows.where((F.col("label") == label) & (F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(share * (1 << 30)))).orderBy(F.xxhash64("id"), "id").limit(most)
        so_far = F.sum(F.octet_length("text").cast("long")).over(Window.orderBy(F.xxhash64("id"), "id", "text").rowsBetween(Window.unboundedPreceding, -1))  # of ``most`` rows
        part = part.withColumn("before", F.coalesce(so_far, F.lit(0))).where(F.col("before") < SAMPLE_BYTES).drop("before")
        picked = part if picked is None else picked.unionByName(part)
    prior = n[1] / (n[0] + n[1])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tk.forget()
        bags, shares, labels = [], [], []
        for batch in batches:
            bucket, share = batch.column("bucket"), batch.column("share")
            at = bucket.offsets.to_numpy()
            bags += [bucket.values.to_numpy()[x:y] for x, y in zip(at, at[1:])]
            shares += [share.values.to_numpy()[x:y] for x, y in zip(at, at[1:])]
            labels.append(batch.column("label").to_numpy())
        labels = np.concatenate(labels).astype(np.int64)
        order = np.lexsort((np.array([int(x.sum(dtype=np.int64)) for x in bags]), labels))  # not as the rows came in
        weight, bias = train([bags[i] for i in order], [shares[i] for i in order], labels[order], prior)
        yield pa.RecordBatch.from_pydict({"weight": pa.array([weight.tobytes()], pa.binary()), "bias": [bias]})

    # the sample is bounded, so one task holds it; the driver gets the model alone
    bags = picked.select("text", "label").mapInArrow(_bags, "label int, bucket array<int>, share array<float>")
    model = bags.repartition(1).mapInArrow(learn, "weight binary, bias double").first()
    return np.frombuffer(bytes(model["weight"]), np.float32), model["bias"]


def score(docs: DataFrame, model: tuple[np.ndarray, float] | None, text_col: str = "text", into: str = "score") -> DataFrame:
    """``docs`` with a column ``into``: the probability that each whole text is toxic, 0 to 1."""
    scratch.lean(docs.sparkSession)
    schema = T.StructType([*docs.schema.fields, T.StructField(into, T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS floats: 1 MB at any size of input

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tk.forget()
        known = shared.value
        for batch in batches:
            out = np.zeros(batch.num_rows)
            if known is not None:
                weight, bias = known
                for first, after, data, at in tk.blocks(batch.column(text_col), BLOCK_BYTES):
                    bucket, owner, heavy = features(data, at)
                    total = np.bincount(owner, heavy, after - first)
                    z = np.bincount(owner, weight[bucket] * heavy, after - first) / np.maximum(total, 1) + bias
                    out[first:after] = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], [*batch.schema.names, into])

    return docs.mapInArrow(scored, schema)


def held_out(doc_id: Column) -> Column:
    """Rows that no label is learned from: crc32 of the id as text is 0 modulo 5.  A null id has no label to learn."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train_on(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, float] | None:
    """The model that the labels of rows not held out give."""
    known = labels.select(F.col("doc_id").alias("_id"), "toxic").where(F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    marks = known.groupBy("_id").agg(F.max("toxic").alias("toxic"))
    return fit(docs.select("doc_id", "text").join(marks, F.col("doc_id") == F.col("_id")), "doc_id", "text", "toxic")
