"""The whole batch: request lines to result lines, each request one result.

parse, resolve (from the resolution cache; else by id, or by blocking and matching), probe
the result cache, analyse each missing track once, and join back; whatever fails is a
result with an error.  The catalog is a table or a search service (``web.Service``).
"""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as k
from .. import scratch
from ..functions import expr
from ..functions.sql import analyze_audio, analyze_files
from ..operators import cache, match
from ..schema import AUDIO, ERROR, FEATURES, KEY, TEMPO, TRACK, analysis
from ..sources import clips, lines, web

log = logging.getLogger("pulsegrid")


@dataclass(frozen=True)
class Options:
    """``country``: a two-letter market, None for the default one; of a catalog table with a ``country`` column only its entries count."""

    key_profile: str = "bands"
    explain_key_scoring: bool = False
    country: str | None = None

    def key(self) -> str:
        return f"key_profile={self.key_profile},explain_key_scoring={str(self.explain_key_scoring).lower()}"

    def market(self) -> str | None:
        code = (self.country or "").strip().lower()
        return code or None


def resolution_key(query: Column, options: Options) -> Column:
    code = F.lit(options.market()).cast("string")
    return expr.resolution_key(query["artist"], query["title"], query["track_id"], code)


def entries(catalog: DataFrame, options: Options) -> DataFrame:
    """The rows of a catalog table that are in the market; those without a country are in the default one."""
    if "country" not in catalog.columns:
        return catalog
    mine = F.lower(F.coalesce(F.col("country"), F.lit(k.DEFAULT_MARKET))) == (options.market() or k.DEFAULT_MARKET)
    return catalog.where(mine).drop("country")


def resolved(requests: DataFrame, catalog: DataFrame | web.Service, options: Options = Options()) -> DataFrame:
    """(line_no, track, error) of requests (line_no, query) that are well formed."""
    by_id = requests.where("query.track_id IS NOT NULL").select("line_no", F.col("query.track_id").alias("track_id"))
    asked = requests.where("query.track_id IS NULL").select(F.col("line_no").alias("query_id"), F.col("query.artist").alias("q_artist"), F.col("query.title").alias("q_title"))
    down = None
    if isinstance(catalog, web.Service):
        answers = catalog.answers(requests.select(F.col("line_no").alias("key"), "query.track_id", "query.artist", "query.title"), options.market())
        columns = [c for c in answers.columns if c not in ("key", "error")]
        down = answers.where("error IS NOT NULL").select(F.col("key").alias("_down"), F.col("error").alias("_error")).distinct()
        there = answers.where("error IS NULL")
        wanted = there.join(by_id, (F.col("key") == F.col("line_no")) & (F.col("c_track_id") == F.col("track_id")), "left_semi").select(*columns)
        looked = match.lookup(by_id, wanted)
        pairs = there.join(asked, F.col("key") == F.col("query_id")).drop("key", "error")
    else:
        known = entries(catalog, options)
        columns = known.columns
        looked = match.lookup(by_id, known)
        pairs = match.block(asked, known)
    looked = looked.withColumn("uncertain", F.lit(False))
    best = match.pick_best(pairs)
    named = asked.select("query_id").join(best, "query_id", "left").withColumn("error", F.when(F.col("c_track_id").isNull(), "no_match").cast("string"))
    cell = lambda c, kind: (F.col(c) if c in columns else F.lit(None)).cast(kind)
    track = F.struct(
        F.col("c_track_id").alias("track_id"), F.coalesce("c_artist", F.lit("")).alias("artist"), F.coalesce("c_title", F.lit("")).alias("title"), cell("album", "string").alias("album"), cell("release_date", "string").alias("release_date"), cell("genre", "string").alias("genre"),
        F.col("c_preview").alias("preview_url"), cell("duration_ms", "long").alias("duration_ms"), F.col("match_score").cast("float").alias("match_score"), F.col("uncertain").alias("uncertain"),
    )
    show = lambda df, key: df.select(F.col(key).alias("line_no"), F.when(F.col("error").isNull(), track).alias("track"), "error")
    found = show(looked, "line_no").unionByName(show(named, "query_id"))
    if down is None:
        return found
    return found.join(down, F.col("line_no") == F.col("_down"), "left").select("line_no", F.when(F.col("_error").isNull(), F.col("track")).alias("track"), F.coalesce("_error", "error").alias("error"))


Files = DataFrame | clips.Folder | None


def analyzed(tracks: DataFrame, files: Files, options: Options) -> DataFrame:
    """(track_id, audio, features, failed, why) of tracks (track_id, preview_url), each analysed once.

    A folder's files are joined by name and read by the task that analyses them; so are
    previews fetched, without ``files``.  Of a table (path, content) the bytes are shuffled
    to their tracks, once.
    """
    how = F.lit(options.key_profile), F.lit(options.explain_key_scoring)
    if isinstance(files, DataFrame):
        if "message" not in files.columns:
            files = files.withColumn("message", F.lit(None).cast("string"))
        there = F.col("content").isNotNull()
        dealt = tracks.repartition("preview_url").join(files.select(F.col("path").alias("preview_url"), "content", "message"), "preview_url", "left")
        dealt = dealt.withColumn("got", F.when(there, analyze_audio()(F.coalesce("content", F.lit(b"")), *how)))
        failed, why = F.when(~there, "http").otherwise(F.col("got.error")), F.when(~there, F.coalesce("message", F.lit("no such preview")))
    else:
        named = tracks.withColumn("length", F.lit(None).cast("long")) if files is None else tracks.join(files.names(tracks.sparkSession).withColumnRenamed("path", "preview_url"), "preview_url", "left")
        there = F.col("preview_url" if files is None else "length").isNotNull()
        get = fetch if files is None else files.get
        # few clips a task: an analysis takes seconds and some 100 MB
        dealt = named.repartition("track_id").withColumn("got", analyze_files(get)(F.when(there, F.col("preview_url")), F.col("length").cast("double"), *how))
        failed, why = F.when(~there | F.col("got.why").isNotNull(), "http").otherwise(F.col("got.error")), F.when(there, F.col("got.why")).otherwise("no such preview")
    done = dealt.select("track_id", F.col("got.audio").alias("audio"), F.col("got.features").alias("features"), failed.alias("failed"), why.alias("why"))
    return scratch.written(done, "analysed") if files is None else done  # a preview is asked for once


def fetch(url: str) -> tuple[bytes | None, str | None]:
    return web.get(url, k.MAX_AUDIO_BYTES, audio=True)


#: A cache's table, or a function that gives, for a table of keys, at least its rows of these.
Kept = DataFrame | Callable[[DataFrame], DataFrame] | None


def prepared(request_lines: DataFrame, catalog: DataFrame | web.Service, results: Kept, options: Options, resolutions: Kept, twice: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Parsed lines, (line_no, track, error) of the well-formed ones, and (track_id, preview_url, hit) of their tracks."""
    parsed = lines.parsed(request_lines)
    valid = parsed.where("error IS NULL").select("line_no", "query")
    if resolutions is None:
        found = resolved(valid, catalog, options)
    else:
        keyed = valid.withColumn("query_key", resolution_key(F.col("query"), options))
        if not isinstance(resolutions, DataFrame):
            keyed = scratch.written(keyed, "keyed")
            resolutions = resolutions(keyed)
        kept = cache.resolutions(resolutions, TRACK).withColumnRenamed("query_key", "_key")
        met = scratch.written(keyed.join(kept, F.col("query_key") == F.col("_key"), "left").drop("_key"), "resolutions")
        fresh = resolved(met.where("track IS NULL").select("line_no", "query"), catalog, options)
        found = met.where("track IS NOT NULL").select("line_no", "track", F.lit(None).cast("string").alias("error")).unionByName(fresh)
    if twice:
        found = scratch.written(found, "found")
    tracks = found.where("track IS NOT NULL").select(F.col("track.track_id").alias("track_id"), F.col("track.preview_url").alias("preview_url")).dropDuplicates(["track_id"])
    if results is not None:
        known = cache.hits(tracks, results if isinstance(results, DataFrame) else results(tracks), options.key(), f"audio {AUDIO}, features {FEATURES}")
    else:
        known = tracks.withColumn("hit", F.lit(None).cast(f"struct<audio: {AUDIO}, features: {FEATURES}>"))
    return parsed, found, known


def told(rows: DataFrame, kind: Column) -> DataFrame:
    """(line_no, analysis) of rows (line_no, query, error, track, audio, features, cached, why) and what kind of failure they have, if any."""
    error = F.coalesce(F.col("error"), F.when(kind.isNotNull(), F.struct(kind.alias("kind"), F.coalesce("why", kind).alias("message"))).cast(ERROR))
    features = F.coalesce("features", F.struct(F.lit(None).cast(TEMPO).alias("tempo"), F.lit(None).cast(KEY).alias("key")))
    return rows.select("line_no", analysis(F.col("query"), F.col("track"), features, F.col("audio"), F.col("cached"), error).alias("analysis"))


def joined(rows: DataFrame, other: DataFrame, key: Column, other_key: Column, none: Column) -> DataFrame:
    """Left join by ``key``; rows without one, which meet nothing, are dealt by ``none`` instead of all to one task."""
    return rows.join(other, (F.coalesce(key, none) == other_key) & key.isNotNull(), "left")


def run(request_lines: DataFrame, catalog: DataFrame | web.Service, files: Files, results: Kept = None, options: Options = Options(), resolutions: Kept = None) -> DataFrame:
    """(line_no, analysis) of (line_no, line); ``results`` and ``resolutions`` are the caches' tables."""
    parsed, found, known = prepared(request_lines, catalog, results, options, resolutions, not isinstance(catalog, DataFrame) or files is None or callable(results))
    fresh = analyzed(known.where("hit IS NULL").select("track_id", "preview_url"), files, options)
    have = known.where("hit IS NOT NULL").select("track_id", F.col("hit.audio").alias("audio"), F.col("hit.features").alias("features"), F.lit(None).cast("string").alias("failed"), F.lit(None).cast("string").alias("why"), F.lit(True).alias("cached"))
    all_ = fresh.withColumn("cached", F.lit(False)).unionByName(have)
    rows = parsed.join(found.withColumnRenamed("error", "unresolved"), "line_no", "left")
    rows = joined(rows, all_, F.col("track.track_id"), F.col("track_id"), F.xxhash64("line_no"))
    return told(rows, F.coalesce("unresolved", "failed"))


def run_late(request_lines: DataFrame, catalog: DataFrame | web.Service, files: clips.Folder | None, tasks: int, results: Kept = None, options: Options = Options(), resolutions: Kept = None) -> DataFrame:
    """``run`` with the analysis last, in ``tasks`` tasks: a task's results are whole when it ends, whatever the others do.

    The lines of one track share a task, which analyses it once.
    """
    parsed, found, known = prepared(request_lines, catalog, results, options, resolutions, True)
    rows = parsed.join(found.withColumnRenamed("error", "unresolved"), "line_no", "left")
    rows = joined(rows, known.select("track_id", "hit"), F.col("track.track_id"), F.col("track_id"), F.xxhash64("line_no"))
    rows = rows.withColumn("url", F.when(F.col("hit").isNull() & F.col("unresolved").isNull(), F.col("track.preview_url")))
    if files is None:
        named, there = rows.withColumn("length", F.lit(None).cast("long")), F.col("url").isNotNull()
    else:
        named, there = joined(rows, files.names(rows.sparkSession).withColumnRenamed("path", "_path"), F.col("url"), F.col("_path"), F.xxhash64("line_no").cast("string")), F.col("length").isNotNull()
    dealt = named.repartition(tasks, F.coalesce(F.col("track_id"), F.xxhash64("line_no"))).sortWithinPartitions("url")
    got = analyze_files(fetch if files is None else files.get)(F.when(there, F.col("url")), F.col("length").cast("double"), F.lit(options.key_profile), F.lit(options.explain_key_scoring))
    done = dealt.withColumn("there", there).withColumn("got", got)
    failed = F.when(F.col("url").isNotNull() & (~F.col("there") | F.col("got.why").isNotNull()), "http").otherwise(F.col("got.error"))
    done = done.withColumns({"audio": F.coalesce("hit.audio", "got.audio"), "features": F.coalesce("hit.features", "got.features"), "cached": F.col("hit").isNotNull(), "why": F.when(F.col("url").isNotNull() & ~F.col("there"), "no such preview").otherwise(F.col("got.why"))})
    return told(done, F.coalesce("unresolved", failed))


def refused(request_lines: DataFrame, kind: str, message: str) -> DataFrame:
    """(line_no, analysis): every request failed for one reason, malformed ones for their own."""
    nothing = lambda schema: F.lit(None).cast(schema)
    error = F.coalesce("error", F.struct(F.lit(kind).alias("kind"), F.lit(message).alias("message")).cast(ERROR))
    return lines.parsed(request_lines).select("line_no", analysis(F.col("query"), nothing(TRACK), nothing(FEATURES), nothing(AUDIO), F.lit(False), error).alias("analysis"))


def storable(done: DataFrame, options: Options = Options()) -> DataFrame:
    """Rows for the result cache: fresh successes, one a track."""
    ok = done.where("analysis.status = 'ok' AND NOT analysis.cached").select(F.col("analysis.track.track_id").alias("track_id"), F.to_json(F.struct("analysis.audio", "analysis.features")).alias("payload"))
    return ok.dropDuplicates(["track_id"]).select("track_id", F.lit(k.ALGORITHM_VERSION).alias("algorithm_version"), F.lit(options.key()).alias("options"), "payload", F.current_timestamp().alias("created_at"))


def resolvable(done: DataFrame, known: DataFrame | None = None, options: Options = Options()) -> DataFrame:
    """Rows for the resolution cache: the track of every request that found one, but for keys in ``known``."""
    rows = done.where("analysis.track IS NOT NULL").select(resolution_key(F.col("analysis.query"), options).alias("query_key"), F.to_json("analysis.track").alias("matched")).where("query_key IS NOT NULL").dropDuplicates(["query_key"])
    if known is not None:
        rows = rows.join(known.select("query_key").distinct(), "query_key", "left_anti")
    return rows.withColumn("created_at", F.current_timestamp())


@dataclass(frozen=True)
class Cache:
    """Both caches below one folder; ``path`` None: none."""

    path: str | None

    def answer(self, request_lines: DataFrame, catalog: DataFrame | web.Service, files: Files, options: Options = Options()) -> DataFrame:
        """``run`` with what is cached, a written table; what is new is stored.

        A cache that can't be opened is an error of every request.  One that can't be
        written costs a repeated analysis next time: a warning.
        """
        spark = request_lines.sparkSession
        if self.path is None:
            return run(request_lines, catalog, files, options=options)
        try:
            for name in ("results", "resolutions"):
                cache.runs(spark, f"{self.path}/{name}")
        except Exception as error:  # noqa: BLE001  a batch never fails as a whole
            log.warning("could not open the cache at %s: %s", self.path, error)
            return refused(request_lines, "cache", f"opening {self.path}: {type(error).__name__}")
        results = lambda keys: cache.opened(spark, f"{self.path}/results", cache.RESULTS, keys)
        resolutions = lambda keys: cache.opened(spark, f"{self.path}/resolutions", cache.RESOLUTIONS, keys)
        done = scratch.written(run(request_lines, catalog, files, results, options, resolutions), "answers")
        fresh = scratch.written(resolvable(done, None, options), "fresh")
        kept = ("results", storable(done, options), cache.RESULT_KEYS), ("resolutions", resolvable(done, resolutions(fresh), options), ("query_key",))
        for name, rows, keys in kept:
            try:
                cache.put(rows, f"{self.path}/{name}", *keys)
            except Exception as error:  # noqa: BLE001
                log.warning("could not cache %s: %s", name, error)
        return done
