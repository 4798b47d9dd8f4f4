"""Operators against plain Python, hand-made cases and each other."""

import math
import json
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid import constants as k
from pulsegrid.functions import expr, synth
from pulsegrid.operators import cache, frames, kernels, key, match, tempo, validate
from pulsegrid.sources import catalog


def series(spark, x, clip=0):
    return spark.createDataFrame([(clip, i, float(v)) for i, v in enumerate(x)], "clip long, t long, x double")


def values(df, c="x"):
    return [r[c] for r in df.orderBy("t").collect()]


@pytest.fixture(scope="module")
def env(spark):
    rng = np.random.default_rng(5)
    x = np.maximum(rng.normal(0, 0.3, 400), 0) + (np.arange(400) % 9 == 0) * 2.0
    x = (x - x.mean()) / x.std()
    return x, series(spark, x).cache()


def test_relational_tempo_is_the_kernel(spark, env):
    x, df = env
    acf = [r.acf for r in frames.autocorrelation(df, 27).orderBy("lag").collect()]
    assert np.allclose(acf, kernels.autocorrelation(x, 27))
    got = [r.bpm for r in tempo.candidates(df, 20.0).orderBy("place").collect()]
    assert np.allclose(got, kernels.tempo_candidates(x, 20.0)[0])
    bpms = [97.0, 133.333, 50.0, 900.0]
    scored = {r.bpm: (r.score, r.mean, r.sd, r.phase) for r in tempo.comb(df, spark.createDataFrame([(0, b) for b in bpms], "clip long, bpm double"), 20.0).collect()}
    for b in bpms:
        want = kernels.comb(x, 20.0, b)
        assert (want is None) == (b not in scored) and (want is None or np.allclose(scored[b], want))
    assert np.allclose(values(frames.smooth(df, 6)), kernels.smooth(x, 6))


def test_relational_envelope_is_the_kernel(spark):
    x = synth.groove(120, 2, "four_on_floor", 8000)
    n, hop = kernels.sizes(8000, "onsets")
    spec = np.concatenate([*kernels.magnitudes(x, n, hop)])
    weights = kernels.mel_weights(8000, n)
    tall = spark.createDataFrame([(0, t, b, float(v)) for t, row in enumerate(spec) for b, v in enumerate(row)], "clip long, t long, b int, mag double")
    flat = spark.createDataFrame([(m, b, float(weights[b, m])) for b in range(len(weights)) for m in range(k.N_MELS) if weights[b, m] > 0], "m int, b int, w double")
    low = int(np.argmin(np.append(kernels.mel_edges(8000)[1:-1] < k.KICK_HZ, False)))
    got = frames.onset_envelope(frames.mel_spectrum(tall, flat), 8000 / hop, low).orderBy("t").collect()
    want = kernels.onsets(x, 8000)
    assert np.allclose([r.x for r in got], want["values"], atol=1e-6) and np.allclose([r.kick for r in got], want["kick"], atol=1e-9)


def test_relational_key_is_the_kernel(spark):
    x = synth.chords(4, True, 3, 8000)
    bins, secs = kernels.chroma(x, 8000)
    chroma = spark.createDataFrame([(0, i, float(v)) for i, v in enumerate(bins)], "clip long, pc int, e double")
    for name in ("edm", "krumhansl"):
        got, want = key.estimate(key.correlations(chroma, name), key.gates(chroma), False).first(), kernels.key_of_chroma(bins, secs, name)
        assert (got.key, got.camelot, got.confidence) == (want["key"], want["camelot"], want["confidence"])
        assert [(a.value, a.label, a.relation) for a in got.alternates] == [(a["value"], a["label"], a["relation"]) for a in want["alternates"]]
    bands, secs = kernels.band_chroma(x, 8000)
    long = spark.createDataFrame([(0, b, i, float(v)) for b, row in enumerate(bands) for i, v in enumerate(row)], "clip long, band int, pc int, e double")
    got = key.estimate(key.probabilities(long), key.gates(long.groupBy("clip", "pc").agg(F.sum("e").alias("e"))), True).first()
    want = kernels.key_of_bands(bands, secs)
    assert (got.key, got.confidence) == (want["key"], want["confidence"])


def test_edges_of_frames(spark):
    flat = series(spark, [2.0] * 5)
    assert values(frames.zscore(flat)) == [0.0] * 5 and frames.pulse_strength(flat).first().pulse_strength == 0
    assert {r.acf for r in frames.autocorrelation(series(spark, [0.0] * 4), 9).collect()} == {0.0}
    stats = frames.pcm_stats(spark.createDataFrame([(0, x) for x in (0.5, -1.0, float("nan"), float("inf"), 0.0)], "clip long, x double")).first()
    assert stats.peak == 1.0 and stats.silent_fraction == 0.6 and abs(stats.rms - math.sqrt(1.25 / 5)) < 1e-12
    grid = spark.createDataFrame([([1.0, 3.0, 5.0], w) for w in (-0.1, 0.0, 0.5, 2.0, 2.5, 3.0)], "xs array<double>, w double")
    assert [r[0] for r in grid.select(frames.interpolated(F.col("xs"), F.col("w"))).collect()] == [0.0, 1.0, 2.0, 5.0, 5.0, 0.0]


def test_fold_and_bijections(spark):
    rng = random.Random(1)
    bpms = [rng.uniform(0.01, 5000) for _ in range(500)] + [90.0, 180.0, 179.999, 45.0, 0.0, -3.0, float("inf"), float("nan")]
    got = [r[0] for r in spark.createDataFrame([(b,) for b in bpms], "b double").select(expr.fold(F.col("b"))).collect()]
    assert all(90 <= g < 180 for g in got[:504]) and got[504:] == [0.0] * 4
    keys = spark.createDataFrame([(t, m) for t in range(12) for m in (True, False)], "t int, m boolean")
    names = {r[0] for r in keys.select(expr.camelot(F.col("t"), F.col("m"))).collect()}
    assert names == {f"{n}{c}" for n in range(1, 13) for c in "AB"}
    one = lambda f, *x: spark.range(1).select(f(*map(F.lit, x))).first()[0]
    assert one(expr.camelot, 0, False) == "8B" and one(expr.camelot, 9, True) == "8A"
    assert [one(expr.country, x) for x in (" US ", "usa", "1a", "de")] == ["us", None, None, "de"]
    assert [one(expr.profile, x) for x in ("KS", "shaath", "Bands", "x")] == ["krumhansl", "edm", "bands", None]
    assert one(expr.options_key, "Bands", True) == "key_profile=bands,explain_key_scoring=true"
    assert [one(expr.allowed, x) for x in ("https://a.b/c", "http://localhost:80/x", "http://a.b", "ftp://a", "http://[::1]/x")] == [True, True, False, False, True]
    assert [one(expr.plausible_audio, x) for x in ("audio/mp4; x", "text/html", "")] == [True, False, True]
    assert one(lambda t: expr.lookup_url("https://c", t, F.lit(None).cast("string")), 5) == "https://c/lookup?id=5&entity=song"


def pairs(spark, artist, title, entries):
    rows = [(1, artist, title, *e) for e in entries]
    return spark.createDataFrame(rows, "query_id long, q_artist string, q_title string, c_track_id long, c_artist string, c_title string, c_preview string")


WORLD = [(1440857781, "Daft Punk", "Around the World", "p"), (1440857999, "Daft Punk", "Around the World (Radio Edit)", "p"), (1440857800, "Daft Punk", "Around the World (Live)", None), (1500000001, "Red Hot Chili Peppers", "Around the World", "p")]


@pytest.mark.parametrize("artist,title,want", [("Daft Punk", "Around the World", 1440857781), ("Daft Punk", "Around the World (Radio Edit)", 1440857999), ("Daft Punk", "Around the World (Remastered)", 1440857781), ("Red Hot Chili Peppers", "Around the World", 1500000001)])
def test_picks(spark, artist, title, want):
    assert match.pick_best(pairs(spark, artist, title, WORLD)).first().c_track_id == want


def test_titles(spark):
    def parts(title):
        p = match.brackets(F.lit(title))
        return tuple(spark.range(1).select(match.core(p), match.qualifier(p), match.raw_qualifier_bytes(F.lit(title))).first())

    assert parts("Song (Deep (Inner) Mix) [feat. Guest]") == ("song", "deep inner mix", 31)
    assert parts("Song (Radio Edit 2011) tail") == ("song tail", "", 17)
    assert parts("Feat of Strength ft. Someone") == ("feat of strength", "", 0)
    assert parts("Open (never closed") == ("open", "never closed", 13) and parts("Odd) close") == ("odd close", "", 1)
    plain = lambda s: spark.range(1).select(match.normalize(F.lit(s))).first()[0]
    assert plain("  Röyksopp & Robyn! ") == "röyksopp and robyn" and plain("İstanbul") == "istanbul"
    moved = match.scored(pairs(spark, "Eminem/Dido", "Stan", [(1, "Eminem", "Stan (feat. Dido)", "p"), (2, "Eminem", "Stan", "p")])).orderBy("c_track_id").collect()
    assert moved[0].score > 0.9 > moved[1].score


def test_lookup_and_manifest(spark, tmp_path):
    table = spark.createDataFrame(WORLD, "c_track_id long, c_artist string, c_title string, c_preview string")
    asked = spark.createDataFrame([(1, 1440857781), (2, 1440857800), (3, 5)], "line_no long, track_id long")
    assert [r.error for r in match.lookup(asked, table).orderBy("line_no").collect()] == [None, "no_preview", "not_found"]
    (tmp_path / "m.tsv").write_text("a\t1\thttp://x\t3\tminor\nbad line\nb\t2\thttp://y\t12\tmajor\n")
    assert [r.id for r in catalog.manifest(spark, str(tmp_path / "m.tsv")).collect()] == ["1"]
    raw = spark.createDataFrame([("d", "1", "Eb minor", 2), ("d", "2", "H major", 2), ("d", "3", "C major", 1)], "dataset string, id string, label string, confidence int")
    assert [tuple(r) for r in catalog.labelled(raw).collect()] == [("d", "1", 3, "minor")]


def test_token_bucket(spark):
    rng = random.Random(2)
    times = sorted(rng.uniform(0, 120) for _ in range(80))
    tokens, last, want = 5.0, 0.0, []
    for t in times:
        tokens = min(5.0, tokens + (t - last) * 0.3) - 1
        last = t
        want.append(max(0.0, -tokens / 0.3))
    rows = spark.createDataFrame([(0, t, i) for i, t in enumerate(times)], "bucket int, secs double, tie int")
    assert np.allclose([r.wait for r in cache.waits(rows).orderBy("tie").collect()], want)


def test_cache_versions(spark):
    rows = [(1, 13, "o", '{"n": 1}', 1), (1, 13, "o", '{"n": 2}', 2), (2, 12, "o", '{"n": 3}', 1), (3, 13, "o", "broken", 1), (4, 13, "x", '{"n": 4}', 1)]
    table = spark.createDataFrame(rows, "track_id long, algorithm_version int, options string, payload string, at int").withColumn("created_at", F.timestamp_seconds("at")).drop("at")
    got = cache.hits(spark.range(1, 6).select(F.col("id").alias("track_id")), table, "o", "n BIGINT").orderBy("track_id").collect()
    assert [r.hit.n if r.hit else None for r in got] == [2, None, None, None, None]


def test_reports(spark):
    expected = spark.createDataFrame([("a", "g", 120.0, "A minor"), ("b", "g", 120.0, ""), ("c", "g", 90.0, "C"), ("d", "g", 100.0, "")], "label string, genre string, expected_bpm double, expected_key string")
    got = spark.createDataFrame([("a", 121.0, "a min", 0.9, False, [(60.0, None, "half", 1.0)]), ("b", 60.5, None, 0.4, True, [(120.0, None, "double", 1.0)]), ("c", 135.0, "C minor", 0.8, False, [])], "label string, bpm double, key string, confidence double, uncertain boolean, alternates array<struct<value: double, label: string, relation: string, score: float>>")
    rows = validate.rows(expected, got).cache()
    assert [(r.verdict, r.key_ok) for r in rows.orderBy("label").collect()] == [("ok", True), ("octave_error", None), ("metric_error", True), ("missing", None)]
    total = validate.summary(rows).first()
    assert (total.total, total.tempo_ok, total.octave_errors, total.metric_errors, total.key_ok, total.failures) == (4, 1, 1, 1, 2, 3)
    told = {r.label: r.line for r in validate.diagnostics(rows).collect()}
    assert set(told) == {"b", "c", "d"} and told["d"] == "d"
    assert told["b"] == "b\n    alternates: 120.00 double score 1.000\n    expected 120 was AMONG the alternates\n    tempo: 60.50 conf 0.40  <- DISCARDED by a consumer"
    lines = {r.label: r.line for r in validate.table(rows).collect()}
    assert lines["a"] == "| a | g | 120 | 121.00 | ok | 0.90 | A minor | a min | — | — | — |"
    assert lines["b"] == "| b | g | 120 | 60.50 | **OCTAVE** | **0.40** | — | — | — | — | — |" and "| **none** | — | — |" in lines["d"]
    by = {r.genre: r.total for r in validate.summary(rows, "genre").collect()}
    assert by == {"g": 4}


def test_key_reports(spark):
    from pulsegrid.schema import ALTERNATES, SCORING

    expected = spark.createDataFrame([("a", "g", 120.0, "A minor")], "label string, genre string, expected_bpm double, expected_key string")
    scoring = (0.8, 0.5, 0.3, 6.0, 0.9, 0.7, 1.0, 0.6)
    got = spark.createDataFrame(
        [("a", 121.0, 0.9, False, [], "C major", "8B", 0.38, True, [(8.0, "A minor (8A)", "relative_minor", 0.5)], scoring, "x", "y", 0.8, True, 29.96, 0.25, None)],
        f"label string, bpm double, confidence double, uncertain boolean, alternates {ALTERNATES}, key string, camelot string, key_confidence double, key_uncertain boolean, key_alternates {ALTERNATES}, scoring {SCORING}, artist string, title string, match_score double, match_uncertain boolean, preview_secs double, silent_fraction double, error string",
    )
    rows = validate.rows(expected, got)
    assert validate.table(rows).first().line == "| a | g | 120 | 121.00 | ok | 0.90 | A minor | **C major** | 8B | 0.38 | no |"
    told = validate.diagnostics(rows).first().line.splitlines()
    assert told[1:3] == ["    matched: x - y [0.80]  <- UNCERTAIN", "    preview: 30.0s, 25% silent"]
    assert told[4] == "    key: C major conf 0.38 (uncertain, a consumer discards this), runners-up: A minor (8A) relative_minor score 0.500"
    factors = "corr 0.800 vs runner-up 0.500 | strength 0.90 margin 0.70 structure 1.00 coverage 0.60 | salience 0.30, tonal pitch classes 6.00"
    assert told[5] == f"    key scoring: {factors}"
    assert validate.key_scoring(rows).first().line == f"{'a':<42} {'C major':<10} conf 0.38 DISCARDED {factors}"


def test_block_against_all_pairs(spark):
    """The candidates that share most words, then those whose shared words are rarest, then the smallest ids."""
    rng = random.Random(12)
    word = lambda: rng.choice(["the", "the", "the", "of", "of", *(f"w{i}" for i in range(12)), *(f"r{i}" for i in range(60))])
    phrase = lambda: " ".join(word() for _ in range(rng.randint(1, 4)))
    known = [(i, phrase(), phrase(), "p") for i in range(400)] + [(400, "The", "of", "p"), (400, "r1", "w2", "p"), (None, "the", "of", "p"), (402, None, "the", None)]
    asked = [(i, phrase(), phrase()) for i in range(60)] + [(60, "the", "the"), (61, "unheard", "words"), (62, None, ""), (63, "the", "of"), (64, "THE", "Of")]
    catalog_ = spark.createDataFrame(known, "c_track_id long, c_artist string, c_title string, c_preview string")
    got = {}
    for r in match.block(spark.createDataFrame(asked, "query_id long, q_artist string, q_title string"), catalog_).collect():
        got.setdefault(r.query_id, set()).add(r.c_track_id)
    own = {}
    for i, a, t, _ in known:
        if i is not None:
            own.setdefault(i, set()).update(f"{a or ''} {t or ''}".lower().split())
    df = Counter(w for ws in own.values() for w in ws)
    for q, a, t in asked:
        ws = set(f"{a or ''} {t or ''}".lower().split())
        scored = sorted((-len(ws & c), -sum((1 << 40) // df[w] for w in ws & c), i) for i, c in own.items() if ws & c)[:12]
        assert got.get(q, set()) == {i for *_, i in scored}, q


def test_fit_learns_rotated_keys(spark):
    rng = np.random.default_rng(3)
    weights = np.array(k.BAND_WEIGHTS)
    rows = []
    for _ in range(240):
        tonic, minor = int(rng.integers(12)), bool(rng.integers(2))
        bands = np.maximum(np.roll(weights[int(minor)] * 0.3, tonic, 1) + rng.normal(0.2, 0.05, (5, 12)), 0)
        rows.append((tonic, minor, bands.tolist()))
    w, b = validate.fit(spark.createDataFrame(rows, "tonic int, minor boolean, bands array<array<double>>"))
    x = np.array([r[2] for r in rows])

    def loss(w, b):
        z = np.stack([(w[None] * np.roll(x, -t, 2)[:, None]).sum((2, 3)) + b for t in range(12)], 1)
        right = z[np.arange(len(rows)), [r[0] for r in rows], [int(r[1]) for r in rows]]
        return (np.log(np.exp(z).sum((1, 2))) - right).mean() + 0.005 * (w**2).sum()

    least = loss(w, b)  # no step from the minimum is downhill
    assert all(loss(w + 0.02 * rng.normal(size=w.shape), b + 0.02 * rng.normal(size=2)) > least for _ in range(20))
    hit = 0
    for tonic, minor, bands in rows:
        z = np.stack([(w * np.roll(np.array(bands), -t, 1)).sum((1, 2)) + b for t in range(12)])
        hit += np.unravel_index(z.argmax(), z.shape) == (tonic, int(minor))
    assert hit / len(rows) > 0.9
    sets = spark.createDataFrame([("xy"[i % 2], *r, 0.9) for i, r in enumerate(rows)], "dataset string, tonic int, minor boolean, bands array<array<double>>, gate double")
    crossed = {r.dataset: r for r in validate.crossed(sets).collect()}
    assert set(crossed) == {"x", "y"} and all(r.exact > 0.85 and r.n == 120 and r.precision >= r.exact for r in crossed.values())
    told = json.loads(validate.emitted(w, b, 240))
    assert np.allclose(told["band_weights"], w, atol=5e-5) and np.allclose(told["mode_bias"], b, atol=5e-5) and told["rows"] == 240


def test_key_metrics(spark):
    rows = [("d", 0, False, 0, False, 0.9), ("d", 0, False, 7, False, 0.6), ("d", 0, False, 9, True, 0.2), ("d", 0, False, 1, True, 0.1)]
    got = validate.key_metrics(spark.createDataFrame(rows, "dataset string, tonic int, minor boolean, got_tonic int, got_minor boolean, confidence double")).first()
    assert (got.n, got.exact, got.coverage, got.precision) == (4, 0.25, 0.5, 0.5) and abs(got.mirex - 0.45) < 1e-12


def test_middle_and_counter(spark):
    got = spark.createDataFrame([(list(map(float, range(40))), 1)], "s array<double>, r int").select(frames.middle(F.col("s"), F.col("r"), 30.0)).first()[0]
    assert got == list(map(float, range(5, 35))) and Counter(got).most_common(1)[0][1] == 1


def test_slopes_are_the_losses(spark):
    """Slopes against differences of the loss, of which the pinned weights are moved one at a time."""
    from pulsegrid.operators import key as keys

    rng = np.random.default_rng(8)
    x = rng.random((30, 5, 12))
    truth = [(i, int(rng.integers(12)), bool(rng.integers(2))) for i in range(30)]
    bands = spark.createDataFrame([(i, b, p, float(x[i, b, p])) for i in range(30) for b in range(5) for p in range(12)], "clip int, band int, pc int, e double")
    got = {(r.minor, r.band, r.degree): r for r in keys.slopes(bands, spark.createDataFrame(truth, "clip int, tonic int, minor boolean")).collect()}

    def loss(w):
        z = np.stack([(w[None] * np.roll(x, -t, 2)[:, None]).sum((2, 3)) + np.array(k.MODE_BIAS) for t in range(12)], 1)
        right = z[np.arange(30), [t for _, t, _ in truth], [int(m) for *_, m in truth]]
        return (np.log(np.exp(z).sum((1, 2))) - right).mean() + 0.005 * (w**2).sum()

    w = np.array(k.BAND_WEIGHTS)
    assert len(got) == 120 and abs(got[False, 0, 0].loss - loss(w)) < 1e-9
    for minor, band, degree in [(False, 0, 0), (True, 4, 11), (True, 2, 7), (False, 3, 5)]:
        step = np.zeros_like(w)
        step[int(minor), band, degree] = 1e-5
        assert abs((loss(w + step) - loss(w - step)) / 2e-5 - got[minor, band, degree].slope) < 1e-6
