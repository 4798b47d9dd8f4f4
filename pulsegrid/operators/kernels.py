"""NumPy kernels for one clip: what has no relational form at a clip's length.

Pure functions of samples and rate.  Spectra are taken in blocks of frames, so a clip
costs its features, not its spectrogram.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from .. import constants as k

#: Samples of a block of frames, so that it stays in a core's cache.
BLOCK = 1 << 18


def power_of_two(n: int) -> int:
    return 1 << max(0, int(n) - 1).bit_length()


def sizes(rate: int, use: str) -> tuple[int, int]:
    """(window, hop) for ``onsets``, ``chroma`` or ``bands``."""
    if use == "onsets":
        n = power_of_two(int(k.ONSET_WINDOW * rate))
        return n, max(1, n // 8)
    if use == "chroma":
        n = power_of_two(int(k.CHROMA_WINDOW * rate))
        return n, max(1, n // 4)
    n = max(1, int(np.floor(k.BAND_WINDOW * rate / 256 + 0.5))) * 256
    return n, n // 8


def magnitudes(x: np.ndarray, n: int, hop: int):
    """Blocks of magnitude spectra, frames x bins, of periodic-Hann windows; nothing from less than a window."""
    if len(x) < n:
        return
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)
    frames = np.lib.stride_tricks.sliding_window_view(x, n)[::hop]
    many = max(1, BLOCK // n)
    for lo in range(0, len(frames), many):
        f = np.fft.rfft(frames[lo : lo + many] * window, axis=1)
        out = f.real**2
        out += f.imag**2
        yield np.sqrt(out, out=out)


def mel_edges(rate: int) -> np.ndarray:
    mel = lambda hz: 2595 * np.log10(1 + hz / 700)
    at = np.linspace(mel(k.MEL_LOW), mel(min(k.MEL_HIGH, rate / 2)), k.N_MELS + 2)
    return 700 * (10 ** (at / 2595) - 1)


@lru_cache(8)
def mel_weights(rate: int, n: int) -> np.ndarray:
    """(bins, bands) triangles between neighbouring edges."""
    edge, hz = mel_edges(rate), np.arange(n // 2 + 1)[:, None] * rate / n
    low, mid, high = edge[:-2], edge[1:-1], edge[2:]
    up, down = (hz - low) / np.maximum(mid - low, 1e-9), (high - hz) / np.maximum(high - mid, 1e-9)
    return np.where((hz >= low) & (hz <= high), np.maximum(np.where(hz <= mid, up, down), 0), 0)


def onsets(x: np.ndarray, rate: int) -> dict:
    """The onset envelope: ``values`` (z-scores), ``kick``, ``fps``, ``latency``, ``pulse``."""
    n, hop = sizes(rate, "onsets")
    fps, weights = rate / hop, mel_weights(rate, n)
    blocks = [m @ weights for m in magnitudes(x, n, hop)]
    mel = np.concatenate(blocks) if blocks else np.zeros((0, k.N_MELS))
    if len(mel) < 2:
        return {"values": np.zeros(0), "kick": np.zeros(0), "fps": fps, "latency": 0.0, "pulse": 0.0}
    energy = mel**2
    loudest = energy.sum(1).max()
    low = int(np.argmin(np.append(mel_edges(rate)[1:-1] < k.KICK_HZ, False)))
    kick = energy[:, :low].sum(1) / loudest if loudest > 0 else np.zeros(len(mel))
    floor = mel.max() * k.WHITEN_FLOOR
    if floor > 0:  # a decaying peak is a running maximum on a tilted log scale
        tilt = -np.arange(len(mel))[:, None] / (k.WHITEN_SECS * fps)
        with np.errstate(divide="ignore"):
            peak = np.exp(np.maximum.accumulate(np.log(mel) - tilt) + tilt)
        mel = mel / np.maximum(peak, floor)
    flux = np.maximum(np.diff(np.log1p(k.LOG_GAIN * mel), axis=0), 0).sum(1)
    flux = np.append(flux[0], flux)
    pulse = flux.std() / flux.mean() if flux.mean() > 1e-9 else 0.0
    half = max(3, int(k.DETREND_SECS * fps)) // 2
    total, at = np.append(0, np.cumsum(flux)), np.arange(len(flux))
    low_, high = np.maximum(at - half, 0), np.minimum(at + half + 1, len(flux))
    flat = flux - (total[high] - total[low_]) / (high - low_)
    sd = flat.std()
    values = (flat - flat.mean()) / sd if sd > 1e-9 else np.zeros(len(flat))
    return {"values": values, "kick": kick, "fps": fps, "latency": (n - hop) / rate, "pulse": float(pulse)}


def autocorrelation(x: np.ndarray, lags: int) -> np.ndarray:
    lags = min(lags, len(x) - 1)
    size = power_of_two(2 * len(x))
    power = np.abs(np.fft.rfft(x, size)) ** 2
    got = np.fft.irfft(power, size)[: lags + 1]
    return got / got[0] if got[0] > 1e-12 else np.zeros(lags + 1)


def smooth(x: np.ndarray, length: int) -> np.ndarray:
    length |= 1
    if length <= 1:
        return x
    w = 0.5 - 0.5 * np.cos(2 * np.pi * (np.arange(length) + 1) / (length + 1))
    return np.convolve(x, w / w.sum(), "same")


def at(x: np.ndarray, where: np.ndarray) -> np.ndarray:
    """Linear interpolation; 0 outside."""
    i = np.floor(where).astype(np.int64)
    part = where - i
    inside = (where >= 0) & (i < len(x))
    a = x[np.clip(i, 0, len(x) - 1)]
    b = x[np.clip(i + 1, 0, len(x) - 1)]
    return np.where(inside, a + (b - a) * part, 0.0)


def fold(bpm: float) -> float:
    return bpm * 2.0 ** -np.floor(np.log2(bpm / k.LOW_BPM)) if bpm > 0 and np.isfinite(bpm) else 0.0


def prior(bpm):
    return np.exp(-0.5 * (np.log2(bpm / k.PRIOR_BPM) / k.PRIOR_OCTAVES) ** 2)


def grids(x: np.ndarray, period: float, phases: np.ndarray):
    """(mean, sd, beats) of ``x`` on the grid of ``period`` at each phase."""
    beats = np.floor((len(x) - 1 - phases) / period).astype(np.int64) + 1
    most = max(1, int(beats.max(initial=0)))
    where = phases[:, None] + np.arange(most) * period
    i = np.minimum(where.astype(np.int32), len(x) - 1)  # all on the grid are inside
    v = np.append(np.diff(x), 0.0)[i]
    v *= where - i
    v += x[i]
    least = int(beats.min(initial=most))
    if least < most:  # phases differ by a beat at most, unless the series is short
        v[:, least:][np.arange(least, most) >= beats[:, None]] = 0
    n = np.maximum(beats, 1)
    mean = v.sum(1) / n
    return mean, np.sqrt(np.maximum(np.einsum("ij,ij->i", v, v) / n - mean**2, 0)), beats


class Series:
    """A series read on many grids: padded for reading windows of it, with the running sum of its onset energy."""

    def __init__(self, x: np.ndarray):
        self.x = np.asarray(x, float)
        up = np.maximum(self.x, 0)
        self.energy, self.total = np.append(0, np.cumsum(up)), float(up.sum())
        self.up = up
        self.padded = np.zeros(0)

    def windows(self, width: int) -> np.ndarray:
        """Every run of ``width`` values, zeros beyond the end."""
        if len(self.padded) < len(self.x) + width:
            self.padded = np.append(self.x, np.zeros(2 * width))
        return np.lib.stride_tricks.as_strided(self.padded, (len(self.x) + 1, width), (8, 8))


def half_grids(series: Series, period: float) -> tuple[np.ndarray, np.ndarray]:
    """(mean, beats) on the grid of ``period`` at every phase 0, 0.5, 1, ... below it, rounded up to a half.

    A beat's values at all whole phases are two neighbouring runs of the series, weighted by
    the beat's fraction, and so are those at the halves between: one product of a few
    weights a beat with these runs gives the sums of all phases.
    """
    x, steps = series.x, int(np.ceil(period * 2))
    phases = np.arange(steps) * 0.5
    beats = np.floor((len(x) - 1 - phases) / period).astype(np.int64) + 1
    least, most = max(0, int(beats.min())), max(0, int(beats.max()))
    whole, half = (steps + 1) // 2, steps // 2
    total = np.zeros(steps)
    if least:
        at_ = np.arange(least) * period
        first = at_.astype(np.int64)
        part = at_ - first
        later = part + 0.5
        carry = later >= 1
        later = later - carry
        runs = series.windows(whole + 3)[first]
        stay = ~carry
        weights = np.stack([1 - part, part, (1 - later) * stay, later * stay + (1 - later) * carry, later * carry])
        a, b, c, d, e = weights @ runs
        total[::2] = a[:whole] + b[1 : whole + 1]
        total[1::2] = c[:half] + d[1 : half + 1] + e[2 : half + 2]
    for beat in range(least, most):  # phases differ by a beat or two
        there = np.flatnonzero(beats > beat)
        where = phases[there] + beat * period
        i = np.minimum(where.astype(np.int64), len(x) - 1)
        after = x[np.minimum(i + 1, len(x) - 1)]
        total[there] += x[i] + (after - x[i]) * (where - i)
    return total / np.maximum(beats, 1), beats


def missed(series: Series, fps: float, period: float, phase: float) -> float:
    """Over beats, halves and quarters: the share of onset energy off these lines, summed."""
    if series.total <= 0:
        return float(len(k.LATTICE))
    wide, size, lost = k.HALF_WIDTH_SECS * fps, len(series.x), 0.0
    for d in k.LATTICE:
        gap = period / d
        if gap > 2 * wide + 1:  # lines apart: the energy around each is a difference of running sums
            line = phase + np.arange(np.floor((-phase - wide) / gap), np.ceil((size - 1 - phase + wide) / gap) + 1) * gap
            low, high = np.maximum(np.ceil(line - wide), 0).astype(np.int64), np.minimum(np.floor(line + wide), size - 1).astype(np.int64)
            there = high >= low
            near = float((series.energy[high[there] + 1] - series.energy[low[there]]).sum())
        else:
            line = (np.arange(size) - phase) / period * d
            off = np.abs(line - np.trunc(line + np.copysign(0.5, line))) * gap
            near = float(series.up[off <= wide].sum())
        lost += 1 - min(1.0, near / series.total)
    return lost


def comb(x: np.ndarray | Series, fps: float, bpm: float):
    """(score, mean, sd, phase) at ``bpm``, or None where no grid fits."""
    series = x if isinstance(x, Series) else Series(x)
    x = series.x
    if bpm <= 0 or len(x) < 2:
        return None
    period = 60 * fps / bpm
    if period < 2 or int(period) >= len(x):
        return None
    mean, beats = half_grids(series, period)
    if not (beats >= 4).any():
        return None
    best = int(np.argmax(np.where(beats >= 4, mean, -np.inf)))
    phase = best * 0.5
    where = phase + np.arange(beats[best]) * period
    i = np.minimum(where.astype(np.int64), len(x) - 1)
    v = x[i] + (x[np.minimum(i + 1, len(x) - 1)] - x[i]) * (where - i)
    sd = float(np.sqrt(max(0.0, float((v * v).mean() - v.mean() ** 2))))
    score = mean[best] - k.CONSISTENCY * sd - k.MISS * missed(series, fps, period, phase)
    return float(score), float(mean[best]), sd, phase


def tempo_candidates(values: np.ndarray, fps: float) -> tuple[list[float], np.ndarray]:
    least, most = max(2, int(60 * fps / k.SEARCH_HIGH)), int(np.ceil(60 * fps / k.SEARCH_LOW))
    acf = autocorrelation(values, most)
    if len(acf) <= least + 2:
        return [], acf
    lag = np.arange(least, min(most, len(acf) - 2) + 1)
    w = acf[lag] * prior(60 * fps / lag)
    peak = np.flatnonzero((w[1:-1] > w[:-2]) & (w[1:-1] >= w[2:]) & (w[1:-1] > 0)) + 1
    peak = peak[np.argsort(-w[peak], kind="stable")][: k.ACF_PEAKS]
    found: list[float] = []
    for bpm in 60 * fps / lag[peak]:
        for folded in (fold(bpm * r) for r in k.RATIOS):
            if folded > 0 and all(abs(b - folded) >= 0.5 for b in found):
                found.append(folded)
    return found, acf


def refine(x: Series, fps: float, bpm: float):
    """(bpm, score, mean, sd, phase) of the best tempo near ``bpm`` on a smoothed envelope."""
    first = comb(x, fps, bpm)
    best = (bpm, *first) if first else None
    beats = len(x.x) / fps * bpm / 60
    if beats < 4:
        return best
    step = k.REFINE_DRIFT / beats
    half = int(np.ceil(k.REFINE_SPAN / step))
    for near in bpm * (1 + np.arange(-half, half + 1) * step):
        if k.LOW_BPM <= near < k.HIGH_BPM and (got := comb(x, fps, near)) and (best is None or got[0] > best[1]):
            best = (float(near), *got)
    return best


def precise(x: Series, fps: float, bpm: float) -> float:
    if len(x.x) < 8:
        return bpm
    step = k.PRECISION_DRIFT / len(x.x)
    half = int(np.ceil(k.PRECISION_SPAN / step))
    best, top = bpm, -np.inf
    for near in bpm * (1 + np.arange(-half, half + 1) * step):
        period = 60 * fps / near
        if period >= 2:
            mean, beats = half_grids(x, period)
            here = np.where(beats >= 4, mean, -np.inf).max()
            if here > top:
                best, top = float(near), here
    return best


def beat_phase(env: dict, bpm: float, otherwise: float) -> float:
    """Where beats fall: the strongest onset grid shortly before or on a rise of the kick."""
    fps = env["fps"]
    period = 60 * fps / bpm
    steps = int(np.ceil(period * 2))
    phases = np.arange(steps) * 0.5 % period
    kick = grids(env["kick"], period, phases)[0]
    width = max(1, int(np.floor(k.KICK_RISE_SECS * fps * 2 + 0.5)))
    rise = sum(np.roll(kick, -i) - np.roll(kick, i) for i in range(1, width + 1)) / width
    if rise.max(initial=0) < k.KICK_LEAST:
        return otherwise
    strong = rise >= k.KICK_SHARE * rise.max()
    lead, lag = int(np.floor(k.KICK_LEAD * period * 2 + 0.5)), int(np.floor(k.KICK_LAG * period * 2 + 0.5))
    near = np.any([np.roll(strong, -i) for i in range(-lag, lead + 1)], 0)
    here = np.flatnonzero(near)
    if not len(here):
        return otherwise
    onset = grids(env["values"], period, phases[here])[0]
    return float(phases[here[len(here) - 1 - int(np.argmax(onset[::-1]))]])


def rounded(v: float, places: int) -> float:
    """Half away from zero."""
    return float(np.copysign(np.floor(abs(v) * 10**places + 0.5) / 10**places, v))


def confidence(*factors: float) -> float:
    v = float(np.prod(factors))
    return rounded(min(1.0, max(0.0, v)), 3) if np.isfinite(v) else 0.0


def clear(mean: float, sd: float, gap: float | None, periodic: float, beats: float) -> float:
    """The product of the five tempo factors, unrounded."""
    unit = lambda v: min(1.0, max(0.0, v))
    even = unit(mean / (mean + sd)) if mean > 0 else 0.0
    rest = even * (1.0 if gap is None else unit(gap / k.MARGIN_AT)) * unit(periodic / k.PERIODIC_AT) * unit(beats / k.COVERED_AT)
    return unit(mean / k.CLEAR_AT) ** 0.5 * rest**0.25


def tempo(env: dict) -> dict | None:
    """The tempo estimate of an onset envelope; None below 32 frames or without a candidate."""
    x, fps = env["values"], env["fps"]
    if len(x) < 32:
        return None
    coarse, acf = tempo_candidates(x, fps)
    soft, whole = Series(smooth(x, int(np.floor(k.SMOOTH_SECS * fps + 0.5)))), Series(x)
    tried = [c for c in (refine(soft, fps, b) for b in coarse) if c and np.isfinite(c[1])]
    tried = sorted(tried, key=lambda c: -c[1])[: k.FINALISTS]
    fine = [(b, *got) for b in (fold(precise(whole, fps, c[0])) for c in tried) if (got := comb(whole, fps, b))]
    if not fine:
        return None
    fine.sort(key=lambda c: -c[1])
    bpm, score, mean, sd, phase = fine[0]
    rival = next((c[1] for c in fine[1:] if abs(c[0] - bpm) >= 0.5), None)
    periodic = float(at(acf, np.array([60 * fps / bpm]))[0])
    sure = confidence(clear(mean, sd, None if rival is None else score - rival, periodic, len(x) / fps * bpm / 60))
    others = [(rounded(b, 2), name, rounded(got[0], 3)) for b, name in ((bpm / 2, "half"), (bpm * 2, "double")) if (got := comb(whole, fps, b))]
    for c in fine[1:]:
        value = rounded(c[0], 2)
        if len(others) < 5 and abs(value - rounded(bpm, 2)) >= 0.5 and all(abs(o[0] - value) >= 0.5 for o in others):
            others.append((value, "runner_up", rounded(c[1], 3)))
    offset = max(0.0, beat_phase(env, bpm, phase) / fps + env["latency"])
    return {
        "bpm": min(max(rounded(bpm, 2), k.LOW_BPM), k.HIGH_BPM - 0.01), "confidence": sure, "uncertain": sure <= k.UNCERTAIN, "maturity": "validated", "source": k.TEMPO_SOURCE,
        "beat_offset_secs": rounded(offset, 3), "canonical_window_bpm": [k.LOW_BPM, k.HIGH_BPM],
        "alternates": [{"value": v, "label": None, "relation": r, "score": s} for v, r, s in others],
    }


def chroma(x: np.ndarray, rate: int) -> tuple[np.ndarray, float]:
    """(12 pitch classes, seconds): means of the bins of each class, frames of equal weight; zeros where a class has no bin."""
    n, hop = sizes(rate, "chroma")
    hz = np.arange(n // 2 + 1) * rate / n
    inside = (hz >= k.CHROMA_LOW) & (hz <= k.CHROMA_HIGH)
    midi = 69 + 12 * np.log2(hz[inside] / 440)
    cls = np.floor(midi + 0.5).astype(int) % 12
    count = np.bincount(cls, minlength=12)
    out, frames = np.zeros(12), 0
    for block in magnitudes(x, n, hop):
        frames += len(block)
        if (count > 0).all():
            mean = np.stack([block[:, inside][:, cls == c].mean(1) for c in range(12)], 1)
            whole = mean.sum(1, keepdims=True)
            out += (mean / np.where(whole > 1e-9, whole, np.inf)).sum(0)
    return out, n / rate + (frames - 1) * hop / rate if frames else 0.0


def band_chroma(x: np.ndarray, rate: int) -> tuple[np.ndarray, float]:
    """(5 registers x 12 pitch classes, seconds) of a whitened log-frequency grid."""
    n, hop = sizes(rate, "bands")
    bins, df = n // 2 + 1, rate / n
    note = k.GRID_LOW + np.arange(k.GRID_BINS) / k.GRID_STEP
    hz = lambda m: 440 * 2 ** ((m - 69) / 12)
    low, high = np.ceil(hz(note - 0.5 / k.GRID_STEP) / df).astype(int), np.floor(hz(note + 0.5 / k.GRID_STEP) / df).astype(int)
    wide = high >= low
    spans = np.stack([np.minimum(low[wide], bins - 1), np.minimum(high[wide], bins - 1) + 1], 1).ravel()  # first bin, and that after the last
    place = hz(note) / df
    floor = np.floor(place).astype(int)
    grid = []
    for block in magnitudes(x, n, hop):
        got = np.empty((len(block), k.GRID_BINS), np.float32)
        a, b = np.clip(floor, 0, bins - 1), np.clip(floor + 1, 0, bins - 1)
        part = place - floor
        got[:] = np.where(floor + 1 < bins, block[:, a] * (1 - part) + block[:, b] * part, 0)
        if len(spans):
            got[:, wide] = np.maximum.reduceat(np.pad(block, ((0, 0), (0, 1))) if spans.max() == bins else block, spans, axis=1)[:, ::2]
        grid.append(got)
    out = np.zeros((len(k.BANDS), 12))
    if not grid:
        return out, 0.0
    grid = np.concatenate(grid).astype(np.float64)
    peak = grid.max()
    if peak <= 1e-9:
        return out, 0.0
    grid = np.log1p(k.GRID_GAIN * grid / peak)
    total = np.pad(np.cumsum(grid, 1), ((0, 0), (1, 0)))
    for band, (lo, hi) in enumerate(k.BANDS):
        for midi in range(lo, hi):
            j = (midi - int(k.GRID_LOW)) * k.GRID_STEP
            a, z = max(0, j - k.GRID_WHITEN // 2), min(k.GRID_BINS, j + k.GRID_WHITEN // 2)
            out[band, midi % 12] += np.maximum(grid[:, j] - (total[:, z] - total[:, a]) / (z - a), 0).sum()
    if out.sum() > 1e-9:
        out *= 12 / out.sum()
    return out, n / rate + (len(grid) - 1) * hop / rate


def ramp(v: float, low: float, high: float) -> float:
    return min(1.0, max(0.0, (v - low) / (high - low)))


def salience(bins: np.ndarray) -> float:
    return float(bins.std() / bins.mean()) if bins.mean() > 1e-9 else 0.0


def tonal_classes(bins: np.ndarray) -> float:
    p = bins - bins.min()
    return float(1 / ((p / p.sum()) ** 2).sum()) if p.sum() > 1e-9 else 0.0


def camelot(tonic: int, minor: bool) -> tuple[int, str]:
    number = (tonic + 3 * minor) * 7 % 12 + 1
    return (number + 6) % 12 + 1, "A" if minor else "B"


def relation(tonic: int, minor: bool, other: int, other_minor: bool) -> str:
    up = (other - tonic) % 12
    if minor != other_minor:
        if up == (3 if minor else 9):
            return "relative_major" if minor else "relative_minor"
        return "parallel" if up == 0 else "other"
    return {7: "dominant", 5: "subdominant"}.get(up, "other")


def finish(scores: np.ndarray, factors: dict, source: str) -> dict:
    """A key estimate of 24 scores (tonic x mode) and its confidence factors."""
    order = np.argsort(-scores.ravel(), kind="stable")
    tonic, minor = divmod(int(order[0]), 2)
    sure = confidence(factors["strength"], factors["margin"], factors["structure"], factors["coverage"])
    mode = ("major", "minor")
    name = lambda i: "%s %s (%d%s)" % (k.PITCHES[i // 2], mode[i % 2], *camelot(i // 2, bool(i % 2)))
    return {
        "key": f"{k.PITCHES[tonic]} {mode[minor]}", "tonic": k.PITCHES[tonic], "mode": mode[minor], "camelot": "%d%s" % camelot(tonic, bool(minor)), "confidence": sure, "uncertain": sure <= k.UNCERTAIN, "maturity": "provisional", "source": source,
        "alternates": [{"value": float(camelot(i // 2, bool(i % 2))[0]), "label": name(i), "relation": relation(tonic, bool(minor), i // 2, bool(i % 2)), "score": rounded(scores.ravel()[i], 3)} for i in map(int, order[1:4])],
        "scoring": factors,
    }


def key_of_chroma(bins: np.ndarray, seconds: float, profile: str) -> dict | None:
    if seconds < k.CHROMA_SECS:
        return None
    scores = np.zeros((12, 2))
    for minor, shape in enumerate(k.PROFILES[profile]):
        p = np.array(shape) - np.mean(shape)
        for tonic in range(12):
            c = np.roll(bins, -tonic) - bins.mean()
            den = np.sqrt((c**2).sum() * (p**2).sum())
            scores[tonic, minor] = (c * p).sum() / den if den >= 1e-9 else 0.0
    first, second = np.sort(scores.ravel())[::-1][:2]
    if first <= 0:
        return None
    sal, tpc = salience(bins), tonal_classes(bins)
    factors = {"correlation": first, "runner_up": second, "salience": sal, "tonal_pitch_classes": tpc, "strength": ramp(first, k.KEY_FLOOR, k.KEY_FULL), "margin": 1 - np.exp(-(first - second) / first / k.KEY_MARGIN), "structure": ramp(sal, k.SALIENCE_FLOOR, k.SALIENCE_FULL), "coverage": ramp(tpc, k.COVER_FLOOR, k.COVER_FULL)}
    return finish(scores, {n: float(v) for n, v in factors.items()}, f"pulsegrid/chroma-correlation-{profile}@{k.KEY_SCORER_VERSION}")


def key_of_bands(bands: np.ndarray, seconds: float) -> dict | None:
    if seconds < k.CHROMA_SECS or bands.sum() <= 0:
        return None
    weights = np.array(k.BAND_WEIGHTS)
    z = np.stack([(weights * np.roll(bands, -t, 1)).sum((1, 2)) + k.MODE_BIAS for t in range(12)])
    p = np.exp(z - z.max())
    p /= p.sum()
    first, second = np.sort(p.ravel())[::-1][:2]
    total = bands.sum(0)
    sal, tpc = salience(total), tonal_classes(total)
    factors = {"correlation": first, "runner_up": second, "salience": sal, "tonal_pitch_classes": tpc, "strength": first, "margin": 1.0, "structure": ramp(sal, k.SALIENCE_FLOOR, k.SALIENCE_FULL), "coverage": ramp(tpc, k.BAND_COVER_FLOOR, k.BAND_COVER_FULL)}
    return finish(p, {n: float(v) for n, v in factors.items()}, f"pulsegrid/band-profiles@{k.KEY_SCORER_VERSION}")


def key(x: np.ndarray, rate: int, profile: str = "bands") -> dict | None:
    return key_of_bands(*band_chroma(x, rate)) if profile == "bands" else key_of_chroma(*chroma(x, rate), profile)


def analyze(samples, rate: int, profile: str = "bands", explain: bool = False) -> dict:
    """``{"tempo": ..., "key": ...}`` of mono samples, each None where there is none."""
    x = np.asarray(samples, np.float64)
    x = np.where(np.isfinite(x), x, 0.0)
    if rate <= 0 or not len(x):
        return {"tempo": None, "key": None}
    found = key(x, rate, profile)
    if found and not explain:
        found["scoring"] = None
    return {"tempo": tempo(onsets(x, rate)), "key": found}
