import math

import numpy as np
import pytest
from pulsegrid.llm import queries, whiten
from pyspark.sql import functions as F


def exact(rows):
    x = [[math.floor(1024 * float(np.float32(c))) + 100000 for c in v] for _, v in rows]
    n, s = len(x), [sum(c) for c in zip(*x)]
    return x, n, s, [sum((n * a - t) ** 2 for a, t in zip(r, s)) for r in x]


def check(spark, rows, sound, d, components=8):
    frame = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, n int").repartition(6)
    got = whiten.whitened(frame, components).collect()
    x, n, s, deviation = exact(sound)
    centred = np.array([[(n * a - t) / n for a, t in zip(r, s)] for r in x])
    e, v = np.linalg.eigh(centred.T @ centred / n)
    e, v = e[::-1], v[:, ::-1]
    k = min(components, d)
    assert len(got) == n * k
    assert sorted((r.id is not None, r.id or 0, int(r.deviation)) for r in got) == sorted((i is not None, i or 0, w) for (i, _), w in zip(sound, deviation) for _ in range(k))
    by = {}
    for r in got:
        by.setdefault(r.component, []).append(r)
    ids = {i: j for j, (i, _) in enumerate(sound)}
    for c in range(1, k + 1):
        assert {r.n for r in by[c]} == {n}
        assert {r.explained for r in by[c]} == {by[c][0].explained} and by[c][0].identity_error <= 1e-9
        assert by[c][0].explained == pytest.approx(max(0.0, e[c - 1]) / max(1e-300, e.sum()), rel=1e-6, abs=1e-12)
        if e[c - 1] <= 1e-12 * max(e[0], 1e-300):
            assert all(r.whitened is None for r in by[c])
            continue
        want = centred @ v[:, c - 1] / np.sqrt(e[c - 1])
        has = np.array([want[ids[r.id]] for r in by[c]])
        own = np.array([r.whitened for r in by[c]])
        assert np.allclose(own * np.sign((own * has).sum()), has, rtol=1e-6, atol=1e-6)


def test_against_eigenvectors(spark):
    g = np.random.default_rng(5)
    v = (g.normal(size=(700, 12)) * np.geomspace(1, 0.01, 12)) @ np.linalg.qr(g.normal(size=(12, 12)))[0]
    rows = [(i, r) for i, r in enumerate(v.astype(np.float32).tolist())]
    bad = [(900, None), (901, [None] * 12), (902, [float("nan")] * 12), (903, [float("inf"), *[0.0] * 11]), (904, []), (905, [0.5] * 3)]
    check(spark, rows + bad, rows, 12)


def test_ties_repeats_and_flat_directions(spark):
    g = np.random.default_rng(6)
    flat = [[float(a), float(b), 0.25, float(a + b)] for a, b in g.integers(-3, 4, (60, 2))]
    rows = [(i, r) for i, r in enumerate(flat)] + [(None, flat[0])] + [(1000 + i, flat[1]) for i in range(200)]
    check(spark, rows, rows, 4)
    check(spark, [(1, [0.5, -0.5])], [(1, [0.5, -0.5])], 2)
    check(spark, [(1, [0.5]), (2, [0.75]), (3, [-1.0])], [(1, [0.5]), (2, [0.75]), (3, [-1.0])], 1, components=3)


def test_empty(spark):
    assert whiten.whitened(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    assert whiten.whitened(spark.createDataFrame([(1, None), (2, [])], "vec_id long, embedding array<float>")).count() == 0


def test_small_singular_values_are_accurate():
    g = np.random.default_rng(7)
    scales = np.geomspace(1, 1e-12, 9)
    r = np.linalg.qr(g.normal(size=(9, 9)))[0] * scales  # columns scaled: their small values are well determined
    sigma, v = whiten.jacobi(r)
    assert np.allclose(sigma, scales, rtol=1e-12) and np.allclose(v.T @ v, np.eye(9), atol=1e-13)
    for shape in (1, 2, 5, 8):
        a = g.normal(size=(shape, shape))
        sigma, v = whiten.jacobi(a)
        assert np.allclose(sigma, np.linalg.svd(a)[1], rtol=1e-10)
        assert np.allclose(np.abs(np.linalg.norm(a @ v, axis=0)), sigma, rtol=1e-10)


def test_many_tasks_stack_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(whiten, "FAN", 2)
    g = np.random.default_rng(8)
    rows = [(i, r) for i, r in enumerate(g.normal(size=(90, 3)).astype(np.float32).tolist())]
    check(spark, rows, rows, 3)


def test_numerators_beyond_64_bits():
    x = np.array([[1 << 52, 5], [3, -7]], np.int64)
    assert whiten.numerators(x, 1 << 20, [1 << 71, 9]).tolist() == [[(1 << 72) - (1 << 71), (5 << 20) - 9], [(3 << 20) - (1 << 71), -(7 << 20) - 9]]


def test_registered_query(spark, tmp_path):
    rows = [(1, [1.0, 2.0], 0), (2, [0.5, -1.0], 1), (3, None, 2)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = queries.op12_whitening(spark, str(tmp_path))
    _, _, _, deviation = exact([(1, [1.0, 2.0]), (2, [0.5, -1.0])])
    assert dict(got.dtypes)["deviation"] == "bigint"
    assert sorted((r.vec_id, r.component, r.deviation) for r in got.collect()) == [(i + 1, c, deviation[i]) for i in range(2) for c in (1, 2)]
    wide = spark.sql("SELECT cast(9223372036854775807 AS decimal(38,0)) AS a, cast(9223372036854775808 AS decimal(38,0)) AS b").select(whiten.as_long(F.col("a")), whiten.as_long(F.col("b"))).first()
    assert tuple(wide) == (2**63 - 1, None)
