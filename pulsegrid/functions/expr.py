"""Column expressions: the scalar rules of matching, tempo, key, validation and limits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as k

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def finite(x: Column) -> Column:
    """``x``, or 0 where it is null, NaN or infinite."""
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(x)


def unit(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def normalized_confidence(x: Column) -> Column:
    return F.round(unit(finite(x)), 3)


def uncertain(confidence: Column) -> Column:
    return confidence <= k.UNCERTAIN


def ramp(x: Column, low: float, high: float) -> Column:
    return unit((x - low) / (high - low))


def ratio(a: Column, b: Column, least: float = 1e-9) -> Column:
    """a / b, or 0 where b is no larger than ``least``."""
    return F.when(b > least, a / F.when(b > least, b)).otherwise(0.0)


def fold(bpm: Column) -> Column:
    """``bpm`` by octaves into [90, 180); 0 where it is no positive number."""
    ok = (bpm > 0) & (bpm < float("inf"))
    return F.when(ok, bpm * F.pow(F.lit(2.0), -F.floor(F.log2(F.when(ok, bpm) / k.LOW_BPM)))).otherwise(0.0)


def prior(bpm: Column) -> Column:
    z = F.log2(bpm / k.PRIOR_BPM) / k.PRIOR_OCTAVES
    return F.exp(-0.5 * z * z)


def tempo_confidence(mean: Column, sd: Column, gap: Column, periodic: Column, beats: Column) -> Column:
    even = F.when(mean > 0, unit(mean / F.when(mean > 0, mean + sd))).otherwise(0.0)
    margin = F.when(gap.isNull(), 1.0).otherwise(unit(gap / k.MARGIN_AT))
    rest = even * margin * unit(periodic / k.PERIODIC_AT) * unit(beats / k.COVERED_AT)
    return F.pow(unit(mean / k.CLEAR_AT), F.lit(0.5)) * F.pow(rest, F.lit(0.25))


def camelot_number(tonic: Column, minor: Column) -> Column:
    major = F.when(minor, F.pmod(tonic + 3, F.lit(12))).otherwise(tonic)
    return F.pmod(major * 7 + 7, F.lit(12)) + 1


def camelot(tonic: Column, minor: Column) -> Column:
    return F.concat(camelot_number(tonic, minor).cast("string"), F.when(minor, "A").otherwise("B"))


def pitch(tonic: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, k.PITCHES)), (tonic + 1).cast("int"))


def key_name(tonic: Column, minor: Column) -> Column:
    return F.concat(pitch(tonic), F.when(minor, " minor").otherwise(" major"))


def relation(tonic: Column, minor: Column, other: Column, other_minor: Column) -> Column:
    up = F.pmod(other - tonic, F.lit(12))
    across = F.when(~minor & (up == 9), "relative_minor").when(minor & (up == 3), "relative_major").when(up == 0, "parallel").otherwise("other")
    along = F.when(up == 7, "dominant").when(up == 5, "subdominant").otherwise("other")
    return F.when(minor != other_minor, across).otherwise(along)


def verdict(expected: Column, got: Column) -> Column:
    near = lambda r: F.abs(got - expected * r) <= k.BPM_NEAR * max(r, 1.0)
    octave, metric = near(0.5) | near(2.0) | near(0.25) | near(4.0), near(2 / 3) | near(1.5) | near(0.75) | near(4 / 3)
    return F.when(got.isNull(), "missing").when(near(1.0), "ok").when(octave, "octave_error").when(metric, "metric_error").otherwise("wrong")


def parsed_key(name: Column) -> tuple[Column, Column]:
    """(pitch class, minor) of a key's name; null where it has none."""
    words = F.split(F.lower(F.trim(name)), r"\s+", 2)
    classes = F.create_map(*[F.lit(x) for pair in k.SPELLINGS.items() for x in pair])
    mode = F.trim(F.try_element_at(words, F.lit(2)))
    return F.try_element_at(classes, words[0]), F.when(F.coalesce(mode, F.lit("")) != "", F.startswith(mode, F.lit("min")))


def key_matches(expected: Column, got: Column) -> Column:
    (a, a_minor), (b, b_minor) = parsed_key(expected), parsed_key(got)
    return F.coalesce(a == b, F.lit(False)) & F.coalesce(a_minor == b_minor, F.lit(True))


def mirex(tonic: Column, minor: Column, got: Column, got_minor: Column) -> Column:
    """The score of a key against the true one: 1, .5 a fifth away, .3 relative, .2 parallel, else 0."""
    up = F.pmod(got - tonic, F.lit(12))
    same = minor == got_minor
    relative = F.when(minor, up == 3).otherwise(up == 9)
    return F.when(same & (up == 0), 1.0).when(same & up.isin(5, 7), 0.5).when(~same & relative, 0.3).when(~same & (up == 0), 0.2).otherwise(0.0)


def country(code: Column) -> Column:
    """A two-letter code in lower case; null for anything else."""
    bare = F.trim(code)
    return F.when(bare.rlike("^[A-Za-z]{2}$"), F.lower(bare))


def profile(name: Column) -> Column:
    low = F.lower(name)
    return F.when(low.isin("krumhansl", "ks"), "krumhansl").when(low == "bands", "bands").when(low.isin("edm", "shaath"), "edm")


def input_error(artist: Column, title: Column, track_id: Column) -> Column:
    """``invalid_input`` where a request names neither a track nor an artist and title."""
    named = artist.isNotNull() & F.coalesce(F.trim(title) != "", F.lit(False))
    return F.when(track_id.isNotNull() | named, None).otherwise("invalid_input").cast("string")


def market(code: Column) -> Column:
    return F.when(code.isNull() | (code == "us"), "").otherwise(F.concat(F.lit("@"), code))


def resolution_key(artist: Column, title: Column, track_id: Column, code: Column) -> Column:
    """What a request's resolution is kept under; null where it cannot be resolved."""
    text = F.concat(F.lit(f"q{k.MATCHER_VERSION}"), market(code), F.lit(":"), F.lower(F.trim(artist)), F.lit("\u0001"), F.lower(F.trim(title)))
    return F.when(track_id.isNotNull(), F.concat(F.lit("id"), market(code), F.lit(":"), track_id.cast("string"))).when(F.trim(title) != "", text)


def options_key(profile_: Column, explain: Column) -> Column:
    return F.lower(F.format_string("key_profile=%s,explain_key_scoring=%s", profile_, explain.cast("string")))


def encoded(text: Column) -> Column:
    """Form encoding that keeps ``~`` and escapes ``*``."""
    return F.replace(F.replace(F.url_encode(text), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def search_url(origin: str, artist: Column, title: Column, code: Column) -> Column:
    query = F.concat(F.lit(f"{origin}/search?term="), encoded(F.trim(F.concat_ws(" ", artist, title))), F.lit(f"&media=music&entity=song&limit={k.SEARCH_LIMIT}"))
    return F.concat(query, F.when(code.isNotNull(), F.concat(F.lit("&country="), code)).otherwise(""))


def lookup_url(origin: str, track_id: Column, code: Column) -> Column:
    return F.concat(F.lit(f"{origin}/lookup?id="), track_id.cast("string"), F.lit("&entity=song"), F.when(code.isNotNull(), F.concat(F.lit("&country="), code)).otherwise(""))


def allowed(url: Column) -> Column:
    """https anywhere; http to this machine only."""
    scheme, host = F.lower(F.regexp_extract(url, "^([A-Za-z]+)://", 1)), F.lower(F.regexp_extract(url, r"^[A-Za-z]+://(\[[^\]]*\]|[^/:?#]+)", 1))
    return F.coalesce(((scheme == "https") & (host != "")) | ((scheme == "http") & host.isin("localhost", "127.0.0.1", "[::1]")), F.lit(False))


def plausible_audio(content_type: Column) -> Column:
    kind = F.lower(F.trim(F.split(F.coalesce(content_type, F.lit("")), ";")[0]))
    return kind.isin("", "video/mp4", "video/quicktime", "application/octet-stream") | F.startswith(kind, F.lit("audio/"))
