"""Validation: estimates against expectations, summaries, reports, comparisons, model fitting."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as k
from ..functions.expr import key_matches, mirex, verdict
from ..schema import ALTERNATES, SCORING

DASH = "—"
#: What a row may carry besides label and expectations; what an estimate lacks is null.
CARRIED = {
    "bpm": "double", "confidence": "double", "uncertain": "boolean", "alternates": ALTERNATES, "key": "string", "camelot": "string", "key_confidence": "double", "key_uncertain": "boolean", "key_alternates": ALTERNATES, "scoring": SCORING,
    "artist": "string", "title": "string", "match_score": "double", "match_uncertain": "boolean", "preview_secs": "double", "silent_fraction": "double", "error": "string",
}


def rows(expected: DataFrame, estimated: DataFrame) -> DataFrame:
    """(label, genre, expected_bpm, expected_key, CARRIED, verdict, key_ok); no key expected, no key verdict."""
    full = estimated.select("label", *[(F.col(c) if c in estimated.columns else F.lit(None)).cast(kind).alias(c) for c, kind in CARRIED.items()])
    both = expected.join(full, "label", "left")
    ok = F.when(F.coalesce(F.col("expected_key"), F.lit("")) != "", F.coalesce(key_matches(F.col("expected_key"), F.col("key")), F.lit(False)))
    return both.withColumn("verdict", verdict(F.col("expected_bpm"), F.col("bpm"))).withColumn("key_ok", ok)


def estimates(done: DataFrame, label: Column) -> DataFrame:
    """What ``rows`` takes of results (analysis)."""
    tempo, key, track, audio = (F.col(f"analysis.{x}") for x in ("features.tempo", "features.key", "track", "audio"))
    found = track.isNotNull() & audio.isNotNull()
    return done.select(
        label.alias("label"), tempo["bpm"].alias("bpm"), tempo["confidence"].alias("confidence"), tempo["uncertain"].alias("uncertain"), tempo["alternates"].alias("alternates"),
        key["key"].alias("key"), key["camelot"].alias("camelot"), key["confidence"].alias("key_confidence"), key["uncertain"].alias("key_uncertain"), key["alternates"].alias("key_alternates"), key["scoring"].alias("scoring"),
        F.when(found, track["artist"]).alias("artist"), F.when(found, track["title"]).alias("title"), F.when(found, track["match_score"]).alias("match_score"), F.when(found, track["uncertain"]).alias("match_uncertain"), F.when(found, audio["duration_secs"]).alias("preview_secs"), F.when(found, audio["silent_fraction"]).alias("silent_fraction"),
        F.concat_ws(": ", "analysis.error.kind", "analysis.error.message").alias("error"),
    ).withColumn("error", F.nullif("error", F.lit("")))


def summary(checked: DataFrame, *by: str) -> DataFrame:
    """Counts of rows (verdict, key_ok), in all or by the columns ``by``."""
    is_ = lambda v: F.count_if(F.col("verdict") == v)
    return checked.groupBy(*by).agg(F.count("*").alias("total"), is_("ok").alias("tempo_ok"), is_("octave_error").alias("octave_errors"), is_("metric_error").alias("metric_errors"), F.count_if(F.coalesce("key_ok", F.lit(False))).alias("key_ok"), F.count_if(F.col("key_ok").isNotNull()).alias("key_checked"), (F.count("*") - is_("ok")).alias("failures"))


def passed() -> Column:
    return (F.col("verdict") == "ok") & F.coalesce("key_ok", F.lit(True))


def dash(value: Column) -> Column:
    return F.coalesce(value, F.lit(DASH))


def two(value: Column) -> Column:
    return F.when(value.isNotNull(), F.format_string("%.2f", value.cast("double")))


#: The head of the table that ``table`` gives the lines of.
HEAD = ("| Track | Genre | Expected BPM | Estimated BPM | Verdict | Tempo conf. | Expected key | Estimated key | Camelot | Key conf. | Key kept |", "|---|---|---:|---:|---|---:|---|---|---|---:|---|")


def table(checked: DataFrame) -> DataFrame:
    """(label, line): a Markdown table row each; bold is what is wrong, or will be discarded."""
    bold = lambda c: F.concat(F.lit("**"), c, F.lit("**"))
    named = F.when(F.col("verdict") == "ok", "ok").when(F.col("verdict") == "octave_error", "**OCTAVE**").when(F.col("verdict") == "metric_error", "**METRIC**").when(F.col("verdict") == "missing", "**none**").otherwise("**wrong**")
    sure = dash(two(F.col("confidence")))
    missed = F.coalesce(~F.col("key_ok"), F.lit(False))
    key = F.when(missed, bold(F.coalesce("key", F.lit("none")))).otherwise(dash(F.col("key")))
    kept = dash(F.when(F.col("key_uncertain"), "no").when(~F.col("key_uncertain"), "yes"))
    cells = [
        F.col("label"), F.coalesce("genre", F.lit("")), F.format_string("%.0f", F.col("expected_bpm")), dash(two(F.col("bpm"))), named, F.when(F.col("uncertain"), bold(sure)).otherwise(sure),
        dash(F.when(F.col("expected_key") != "", F.col("expected_key"))), key, dash(F.col("camelot")), dash(two(F.col("key_confidence"))), kept,
    ]
    return checked.select("label", F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))


def described(alternates: str) -> Column:
    """Alternates in one line: what, how it relates, its score."""
    one = lambda a: F.concat(F.coalesce(a["label"], F.format_string("%.2f", a["value"])), F.lit(" "), a["relation"], F.lit(" score "), F.format_string("%.3f", a["score"].cast("double")))
    return F.array_join(F.transform(alternates, one), ", ")


def factors() -> Column:
    """The factors of a key's confidence in one line."""
    of = lambda name, form: F.format_string(form, F.col(f"scoring.{name}").cast("double"))
    parts = [F.lit("corr "), of("correlation", "%.3f"), F.lit(" vs runner-up "), of("runner_up", "%.3f"), F.lit(" | strength "), of("strength", "%.2f"), F.lit(" margin "), of("margin", "%.2f"), F.lit(" structure "), of("structure", "%.2f"), F.lit(" coverage "), of("coverage", "%.2f"), F.lit(" | salience "), of("salience", "%.2f"), F.lit(", tonal pitch classes "), of("tonal_pitch_classes", "%.2f")]
    return F.when(F.col("scoring").isNotNull(), F.concat(*parts))


def diagnostics(checked: DataFrame) -> DataFrame:
    """(label, line) of rows that fail or whose tempo is uncertain: what was matched and heard, and whether the truth was among the alternates."""
    bad = checked.where(~passed() | F.coalesce("uncertain", F.lit(False)))
    among = F.exists("alternates", lambda a: F.abs(a["value"] - F.col("expected_bpm")) <= k.BPM_NEAR)
    some = lambda c: F.coalesce(F.size(c) > 0, F.lit(False))
    heard = F.col("artist").isNotNull()
    line = lambda *parts: F.concat(F.lit("    "), *[p if isinstance(p, Column) else F.lit(p) for p in parts])
    lines = [
        F.col("label"),
        F.when(F.col("error").isNotNull(), line("failed: ", F.col("error"))),
        F.when(heard, line("matched: ", F.col("artist"), " - ", F.col("title"), " [", two(F.col("match_score")), "]", F.when(F.col("match_uncertain"), "  <- UNCERTAIN").otherwise(""))),
        F.when(heard, line("preview: ", F.format_string("%.1f", "preview_secs"), "s, ", F.format_string("%.0f", F.col("silent_fraction") * 100), "% silent")),
        F.when(some("alternates"), line("alternates: ", described("alternates"))),
        F.when(some("alternates"), line("expected ", F.format_string("%.0f", "expected_bpm"), " was ", F.when(among, "AMONG").otherwise("not among"), " the alternates")),
        F.when(F.col("bpm").isNotNull(), line("tempo: ", two(F.col("bpm")), " conf ", two(F.coalesce("confidence", F.lit(0.0))), F.when(F.col("uncertain"), "  <- DISCARDED by a consumer").otherwise(""))),
        F.when(some("key_alternates"), line("key: ", F.coalesce("key", F.lit("none")), " conf ", two(F.coalesce("key_confidence", F.lit(0.0))), F.when(F.col("key_uncertain"), " (uncertain, a consumer discards this)").otherwise(""), ", runners-up: ", described("key_alternates"))),
        F.when(some("key_alternates"), line("key scoring: ", factors())),
    ]
    return bad.select("label", F.concat_ws("\n", *lines).alias("line"))


def key_scoring(checked: DataFrame) -> DataFrame:
    """(label, line) of every row with a key breakdown: the key, whether it is kept, and the factors of its confidence."""
    kept = F.when(F.col("key_uncertain"), "DISCARDED").when(~F.col("key_uncertain"), "kept").otherwise("")
    head = F.concat(F.rpad("label", 42, " "), F.lit(" "), F.rpad(F.coalesce("key", F.lit("none")), 10, " "), F.lit(" conf "), two(F.coalesce("key_confidence", F.lit(0.0))), F.lit(" "), F.rpad(kept, 9, " "), F.lit(" "))
    return checked.where("scoring IS NOT NULL").select("label", F.concat(head, factors()).alias("line"))


def compare(before: DataFrame, after: DataFrame) -> DataFrame:
    """(label, change) of two runs (label, verdict, uncertain, key_ok, error): what got worse; a missing or failed row says nothing."""
    a, b = before.alias("a"), after.alias("b")
    both = a.join(b, F.col("a.label") == F.col("b.label"), "full_outer")
    gone = F.col("b.label").isNull() | F.col("a.label").isNull() | F.col("a.error").isNotNull() | F.col("b.error").isNotNull()
    change = (
        F.when(gone, "inconclusive")
        .when((F.col("a.verdict") == "ok") & (F.col("b.verdict") != "ok"), "tempo_lost")
        .when(~F.col("a.uncertain") & F.col("b.uncertain"), "now_uncertain")
        .when(F.col("a.key_ok") & ~F.coalesce(F.col("b.key_ok"), F.lit(False)), "key_lost")
        .otherwise("same")
    )
    return both.select(F.coalesce(F.col("a.label"), F.col("b.label")).alias("label"), change.alias("change"))


def calibration(judged: DataFrame) -> DataFrame:
    """By dataset and fifth of confidence: rows and the share that is right, where there are ten."""
    part = F.least(F.floor(F.col("confidence") / 0.2), F.lit(4)).cast("int")
    return judged.groupBy("dataset", part.alias("bin")).agg(F.count("*").alias("n"), F.avg(F.col("right").cast("double")).alias("share")).where("n >= 10")


def key_metrics(judged: DataFrame) -> DataFrame:
    """By dataset: exact share, mean MIREX score, coverage and precision above 0.5."""
    sure = F.col("confidence") > k.UNCERTAIN
    exact = ((F.col("tonic") == F.col("got_tonic")) & (F.col("minor") == F.col("got_minor"))).cast("double")
    score = mirex(F.col("tonic"), F.col("minor"), F.col("got_tonic"), F.col("got_minor"))
    return judged.groupBy("dataset").agg(F.count("*").alias("n"), F.avg(exact).alias("exact"), F.avg(score).alias("mirex"), F.avg(sure.cast("double")).alias("coverage"), F.avg(F.when(sure, exact)).alias("precision"))


def _turned(x: np.ndarray) -> np.ndarray:
    """(rows, 12 tonics, 60): each row's bands as degrees above each tonic."""
    x = x.reshape(-1, 5, 12)
    return np.stack([np.roll(x, -t, 2) for t in range(12)], 1).reshape(len(x), 12, 60)


def _shares(x: np.ndarray, theta: np.ndarray) -> np.ndarray:
    """(rows, 12 tonics, 2 modes): the model's probabilities."""
    turned = _turned(x)
    z = np.stack([turned @ theta[:60] + theta[120], turned @ theta[60:120] + theta[121]], 2)
    p = np.exp(z - z.max((1, 2), keepdims=True))
    return p / p.sum((1, 2), keepdims=True)


def fit(features: DataFrame, steps: int = 25, l2: float = 1e-2) -> tuple[np.ndarray, np.ndarray]:
    """(weights 2 x 5 x 12, bias 2) of the shared-weight softmax over 24 rotated keys, from (tonic, minor, bands).

    The loss (mean cross entropy, plus l2 / 2 times the squared weights) is convex, so
    Newton's method finds its only minimum in a few passes, however many rows: of each,
    every partition returns a loss, a gradient and a curvature, 122 x 124 numbers.
    """
    rows = features.select("tonic", F.col("minor").cast("int").alias("minor"), F.flatten("bands").alias("x")).persist()
    n = max(rows.count(), 1)
    decay = np.append(np.full(120, l2), [0, 0])

    def measured(theta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros((124, 122))
            for pdf in batches:
                for lo in range(0, len(pdf), 512):
                    some = pdf.iloc[lo : lo + 512]
                    x = np.stack(some["x"])
                    turned, p = _turned(x), _shares(x, theta)
                    right = (np.arange(len(some)), some["tonic"], some["minor"])
                    total[0, 0] -= np.log(np.maximum(p[right], 1e-300)).sum()
                    wide = np.zeros((len(some), 12, 2, 122))  # what each parameter adds to each key's score
                    wide[:, :, 0, :60] = wide[:, :, 1, 60:120] = turned
                    wide[:, :, 0, 120] = wide[:, :, 1, 121] = 1
                    wide = wide.reshape(len(some), 24, 122)
                    p = p.reshape(len(some), 24)
                    mean = np.einsum("nk,nkf->nf", p, wide)
                    truth = wide[np.arange(len(some)), 2 * some["tonic"] + some["minor"]]
                    total[1] += (mean - truth).sum(0)
                    flat = (wide * np.sqrt(p)[:, :, None]).reshape(-1, 122)
                    total[2:] += flat.T @ flat - mean.T @ mean
            yield pd.DataFrame({"i": np.arange(total.size), "v": total.ravel()})

        summed = rows.mapInPandas(part, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).toPandas()  # 122 x 124 rows, always
        total = np.zeros((124, 122))
        total.ravel()[summed["i"]] = summed["v"] / n
        return float(total[0, 0] + (decay * theta * theta).sum() / 2), total[1] + decay * theta, total[2:] + np.diag(decay)

    theta = np.zeros(122)
    loss, slope, curve = measured(theta)
    for _ in range(steps):
        step = np.linalg.pinv(curve, hermitian=True) @ slope
        size = 1.0
        while True:
            new = theta - size * step
            got = measured(new)
            if got[0] <= loss + 1e-12 or size < 1e-4:
                break
            size /= 2
        done = loss - got[0] < 1e-9
        theta, (loss, slope, curve) = new, got
        if done:
            break
    rows.unpersist()
    return theta[:120].reshape(2, 5, 12), theta[120:]


def predicted(features: DataFrame, weights: np.ndarray, bias: np.ndarray) -> DataFrame:
    """``features`` (tonic, minor, bands, ...) with the model's ``got_tonic``, ``got_minor`` and ``share`` (its probability)."""
    theta = np.append(np.ravel(weights), bias)

    @F.pandas_udf("got_tonic int, got_minor boolean, share double")
    def best(x: pd.Series) -> pd.DataFrame:
        p = _shares(np.stack(x), theta).reshape(len(x), 24) if len(x) else np.zeros((0, 24))
        top = p.argmax(1) if len(x) else np.zeros(0, int)
        return pd.DataFrame({"got_tonic": top // 2, "got_minor": top % 2 > 0, "share": p.max(1) if len(x) else []})

    return features.withColumn("_got", best(F.flatten("bands"))).select(*features.columns, "_got.*")


def crossed(features: DataFrame, gate: str = "gate") -> DataFrame:
    """``key_metrics`` of each dataset by the model of all other datasets; ``features`` (dataset, tonic, minor, bands, ``gate``).

    A confidence is the model's share times the row's gates of structure and coverage.
    """
    names = [r["dataset"] for r in features.select("dataset").distinct().orderBy("dataset").collect()]  # a few sets
    out = None
    for name in names:
        weights, bias = fit(features.where(F.col("dataset") != name))
        judged = predicted(features.where(F.col("dataset") == name), weights, bias).withColumn("confidence", F.col("share") * F.col(gate))
        one = key_metrics(judged)
        out = one if out is None else out.unionByName(one)
    return out


def emitted(weights: np.ndarray, bias: np.ndarray, n: int) -> str:
    """A fitted model as JSON text, to four places: what ``constants.BAND_WEIGHTS`` and ``MODE_BIAS`` are set from."""
    return json.dumps({"rows": n, "mode_bias": np.round(bias, 4).tolist(), "band_weights": np.round(weights, 4).tolist()})
