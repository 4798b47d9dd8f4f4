"""Command line: ``analyze``, ``batch``, ``validate``, ``probe`` and ``selftest``.

Standard output has JSON only; tables, details and the log go to standard error.
PULSEGRID_LOG sets the log's level.
"""

from __future__ import annotations

import argparse
import json
import logging
import os
import sys
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import constants as k
from .functions import synth
from .functions.sql import analyze_audio
from .operators import validate
from .plans import batch
from .sources import audio, clips, lines, web

PROFILES = {"bands": "bands", "edm": "edm", "shaath": "edm", "krumhansl": "krumhansl", "ks": "krumhansl"}
log = logging.getLogger("pulsegrid")


def profile(name: str) -> str:
    if name.lower() not in PROFILES:
        raise argparse.ArgumentTypeError(f"unknown key profile: {name}")
    return PROFILES[name.lower()]


def market(code: str) -> str:
    if len(code.strip()) != 2 or not (code.strip().isascii() and code.strip().isalpha()):
        raise argparse.ArgumentTypeError(f"not a two-letter country code: {code}")
    return code.strip().lower()


def cache_path(spark: SparkSession, given: str | None, off: bool) -> str | None:
    """Where the caches are: as given; else below the user's cache folder, on one machine only, since executors must reach it."""
    if off or given:
        return None if off else given
    if not spark.sparkContext.master.startswith("local"):
        raise SystemExit("on a cluster, give --cache-path (a folder that executors share) or --no-cache")
    home = os.environ.get("XDG_CACHE_HOME") or os.path.join(os.path.expanduser("~"), ".cache")
    return f"file://{home}/pulsegrid"


def selftest(spark: SparkSession, secs: float = 30.0, rate: int = synth.RATE, key_profile: str = "bands") -> DataFrame:
    """Validation rows of the synthetic signals, each analysed as a WAV file."""
    cases = [(f"{kind or 'clicks'} {bpm}", genre, float(bpm), key, bytearray(synth.wav(synth.selftest_case(i, secs, rate) * 0.5, rate))) for i, (bpm, _, _, key, kind, genre) in enumerate(synth.SELFTEST)]
    clips = spark.createDataFrame(cases, "label string, genre string, expected_bpm double, expected_key string, content binary").repartition(len(cases), "label").persist()
    got = clips.select("label", analyze_audio()("content", F.lit(key_profile), F.lit(True)).alias("a"))
    tempo, key = F.col("a.features.tempo"), F.col("a.features.key")
    estimated = got.select(
        "label", tempo["bpm"].alias("bpm"), tempo["confidence"].alias("confidence"), tempo["uncertain"].alias("uncertain"), tempo["alternates"].alias("alternates"),
        key["key"].alias("key"), key["camelot"].alias("camelot"), key["confidence"].alias("key_confidence"), key["uncertain"].alias("key_uncertain"), key["alternates"].alias("key_alternates"), key["scoring"].alias("scoring"), F.col("a.error").alias("error"),
    )
    return validate.rows(clips.drop("content"), estimated)


def validation(spark: SparkSession, catalog: DataFrame | web.Service, files: batch.Files, options: batch.Options) -> DataFrame:
    """Validation rows of the tracks of known tempo: nothing cached, key factors explained."""
    tracks = [(i, f"{artist} — {title}", genre, bpm, key, json.dumps({"artist": artist, "title": title})) for i, (artist, title, bpm, key, genre) in enumerate(k.REFERENCE_TRACKS)]
    wanted = spark.createDataFrame(tracks, "line_no long, label string, genre string, expected_bpm double, expected_key string, line string")
    fresh = batch.Options(options.key_profile, True, options.country)
    done = batch.run(wanted.select("line_no", "line"), catalog, files, options=fresh).join(wanted.select("line_no", "label"), "line_no")
    return validate.rows(wanted.drop("line_no", "line"), validate.estimates(done, F.col("label")))


def report(checked: DataFrame) -> int:
    """Rows and summary as JSON on standard output; the table and details on standard error.  1 if a tempo failed."""
    checked = checked.persist()
    print("\n".join(validate.HEAD), file=sys.stderr)
    for made in (validate.table, validate.diagnostics, validate.key_scoring):
        for r in made(checked).orderBy("label").collect():  # a row a track of a fixed set
            print(r.line, file=sys.stderr)
    total = validate.summary(checked).first()
    told = [json.loads(r.value) for r in checked.select("label", F.to_json(F.struct(*checked.columns)).alias("value")).orderBy("label").collect()]
    print(json.dumps({"rows": told, "summary": total.asDict()}, ensure_ascii=False))
    return int(total.failures > 0)


def probe(url: str) -> dict:
    """Facts of one audio URL: bytes, and statistics of its samples."""
    body, error = web.get(url, k.MAX_AUDIO_BYTES, audio=True)
    if body is None:
        raise SystemExit(error)
    try:
        pcm = audio.decode(body)
    except Exception as why:  # noqa: BLE001
        raise SystemExit(f"decoding {url}: {why}") from None
    return {"url": url, "bytes": len(body), "pcm": audio.facts(pcm) | audio.levels(pcm)}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="pulsegrid")
    top.add_argument("-v", "--verbose", action="count", default=0)
    sub = top.add_subparsers(dest="command", required=True)
    for name in ("analyze", "batch", "validate"):
        p = sub.add_parser(name)
        source = p.add_mutually_exclusive_group(required=True)
        source.add_argument("--catalog", help="Parquet: c_track_id, c_artist, c_title, c_preview, and country if there are several markets")
        source.add_argument("--api-base-url", help="origin of a search service to ask instead")
        p.add_argument("--clips", help="folder of audio files, named by c_preview; without it previews are fetched")
        p.add_argument("--key-profile", default="bands", type=profile)
        p.add_argument("--country", type=market)
        p.add_argument("--cache-path")
        p.add_argument("--no-cache", action="store_true")
        p.add_argument("--explain-key", action="store_true")
        p.add_argument("--requests-per-minute", type=float, default=k.PER_MINUTE)
        p.add_argument("--burst", type=float, default=k.BURST)
    one = sub.choices["analyze"]
    one.add_argument("--artist")
    one.add_argument("--title")
    one.add_argument("--track-id", type=int)
    one.add_argument("--client-ref")
    sub.choices["batch"].add_argument("--input", required=True)
    sub.choices["batch"].add_argument("--output", required=True)
    sub.choices["batch"].add_argument("--concurrency", type=int, help="clips analysed at a time")
    test = sub.add_parser("selftest")
    test.add_argument("--sample-rate", type=int, default=synth.RATE)
    test.add_argument("--key-profile", default="bands", type=profile)
    sub.add_parser("probe").add_argument("url")
    return top


def main(argv: list[str] | None = None) -> int:
    """Exit code 1 if ``analyze`` fails, or a tempo does in ``validate`` or ``selftest``; ``batch`` always 0."""
    args = parser().parse_args(argv)
    level = ("WARNING", "INFO", "DEBUG")[min(args.verbose, 2)]
    logging.basicConfig(stream=sys.stderr, level=os.environ.get("PULSEGRID_LOG", level).upper(), force=True)
    if args.command == "probe":
        print(json.dumps(probe(args.url)))
        return 0
    spark = SparkSession.builder.getOrCreate()
    if args.command == "selftest":
        return report(selftest(spark, rate=args.sample_rate, key_profile=args.key_profile))
    catalog = web.Service(args.api_base_url.rstrip("/"), args.requests_per_minute, args.burst) if args.api_base_url else spark.read.parquet(args.catalog)
    files = clips.Folder(args.clips) if args.clips else None
    options = batch.Options(args.key_profile, args.explain_key, args.country)
    log.info("options %s", options)
    if args.command == "validate":
        return report(validation(spark, catalog, files, options))
    kept = batch.Cache(cache_path(spark, args.cache_path, args.no_cache))
    if kept.path is not None and isinstance(catalog, web.Service):
        catalog = replace(catalog, state=f"{kept.path}/leases")
    if args.command == "batch":
        if args.concurrency:
            spark.conf.set("spark.sql.shuffle.partitions", max(1, args.concurrency))
        lines.write(kept.answer(lines.read(spark, args.input), catalog, files, options), args.output)
        return 0
    asked = {name: v for name, v in (("artist", args.artist), ("title", args.title), ("track_id", args.track_id), ("client_ref", args.client_ref)) if v is not None}
    line = spark.createDataFrame([(0, json.dumps(asked))], "line_no long, line string")
    row = lines.rendered(kept.answer(line, catalog, files, options)).first()
    print(row.value)
    return int(json.loads(row.value)["status"] != "ok")


if __name__ == "__main__":
    sys.exit(main())
