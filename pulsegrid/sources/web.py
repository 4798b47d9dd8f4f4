"""The web as a source: previews fetched by tasks, a search service asked at a limited rate.

A failure is a row with an error, never an exception.  Answers have side effects on the
other end, so what comes back is written once (``scratch``) before a plan uses it twice.
"""

from __future__ import annotations

import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import constants as k
from .. import scratch
from ..functions import expr
from ..operators import cache
from . import catalog

AGENT = "pulsegrid/1"


def permitted(url: str) -> bool:
    """https anywhere; http to this machine only: ``expr.allowed`` for one string."""
    try:
        parts = urllib.parse.urlsplit(url)
        host = parts.hostname
    except ValueError:
        return False
    return bool(host) and (parts.scheme == "https" or parts.scheme == "http" and host in ("localhost", "127.0.0.1", "::1"))


class Redirects(urllib.request.HTTPRedirectHandler):
    """Follows ``k.MAX_REDIRECTS`` redirects at most, and to permitted places only."""

    def redirect_request(self, req, fp, code, msg, headers, newurl):
        hops = getattr(req, "hops", 0) + 1
        if hops > k.MAX_REDIRECTS:
            raise urllib.error.URLError(f"more than {k.MAX_REDIRECTS} redirects")
        if not permitted(newurl):
            raise urllib.error.URLError(f"refused redirect to {newurl}")
        new = super().redirect_request(req, fp, code, msg, headers, newurl)
        if new is not None:
            new.hops = hops
        return new


def plausible(kind: str | None) -> bool:
    """Whether a content type may be audio: ``expr.plausible_audio`` for one string."""
    bare = (kind or "").split(";")[0].strip().lower()
    return bare in ("", "video/mp4", "video/quicktime", "application/octet-stream") or bare.startswith("audio/")


def get(url: str, limit: int, audio: bool, timeout: float = k.FETCH_SECS) -> tuple[bytes | None, str | None]:
    """(body, error) of a GET; a body over ``limit`` bytes is an error as soon as that shows."""
    if not permitted(url):
        return None, f"refused URL {url}"
    opener = urllib.request.build_opener(Redirects())
    try:
        with opener.open(urllib.request.Request(url, headers={"User-Agent": AGENT}), timeout=timeout) as answer:
            if audio and not plausible(answer.headers.get("Content-Type")):
                return None, f"GET {url}: not audio, served {answer.headers.get('Content-Type')}"
            if int(answer.headers.get("Content-Length") or 0) > limit:
                return None, f"GET {url}: too large, over {limit} bytes"
            body = answer.read(limit + 1)
    except urllib.error.HTTPError as error:
        return None, f"GET {url}: status {error.code}"
    except (OSError, ValueError) as error:
        return None, f"GET {url}: {getattr(error, 'reason', None) or error}"
    return (None, f"GET {url}: too large, over {limit} bytes") if len(body) > limit else (body, None)


def fetched(urls: DataFrame, url_col: str = "preview_url") -> DataFrame:
    """(path, content, length, message) of the distinct ``url_col``: the bytes of each, or why there are none."""

    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for url in pdf["path"]:
                body, error = get(url, k.MAX_AUDIO_BYTES, audio=True)
                yield pd.DataFrame({"path": [url], "content": [body], "length": [len(body) if body is not None else None], "message": [error]})

    rows = urls.select(F.col(url_col).alias("path")).where("path IS NOT NULL").distinct()
    return rows.mapInPandas(made, "path string, content binary, length long, message string")


class Bucket:
    """A token bucket.  ``wait`` takes a token and says how long to wait for it, ``lease`` takes many; it may go into debt."""

    def __init__(self, per_minute: float, burst: float, now: Callable[[], float] = time.time, tokens: float | None = None, at: float | None = None):
        self.rate, self.cap, self.now = max(per_minute, 0.01) / 60.0, max(burst, 1.0), now
        self.tokens, self.at = self.cap if tokens is None else tokens, now() if at is None else at

    def lease(self, n: int) -> float:
        """The tokens there were before ``n`` were taken: the i-th is there (i + 1 - tokens) / rate seconds from now, or at once."""
        now = self.now()
        had = min(self.cap, self.tokens + max(0.0, now - self.at) * self.rate)
        self.tokens, self.at = had - n, now
        return had

    def wait(self) -> float:
        return max(0.0, (1 - self.lease(1)) / self.rate)


class Pace:
    """Sleeps until times that were dealt out beforehand.  A task that begins late is late by as much all along, so it never catches up in a rush."""

    def __init__(self, now: Callable[[], float] = time.time, sleep: Callable[[float], None] = time.sleep):
        self.now, self.sleep, self.late = now, sleep, 0.0

    def until(self, due: float) -> None:
        left = due + self.late - self.now()
        if left > 0:
            self.sleep(left)
        else:
            self.late -= left


LEASES = "origin STRING, at DOUBLE, tokens DOUBLE"


@dataclass(frozen=True)
class Service:
    """A search service at ``origin``, asked ``per_minute`` times after a burst.

    The rate is the service's, not a task's: a batch leases a token for each of its
    requests at once, and ``tasks`` (no more than the burst) ask at the times of their
    tokens.  Leases are stored below ``state``, if given, before anything is asked, so the
    next batch starts with what this one owes, even if this one died.  Batches that run at
    the same time need states, and shares of the rate, of their own.
    """

    origin: str
    per_minute: float = k.PER_MINUTE
    burst: float = k.BURST
    state: str | None = None
    tasks: int = 1

    def leased(self, spark: SparkSession, n: int, now: Callable[[], float] = time.time) -> tuple[float, float, float]:
        """(time, tokens there were, tokens a second) for ``n`` requests, which are taken."""
        kept = None
        if self.state is not None:
            kept = cache.opened(spark, self.state, LEASES).where(F.col("origin") == self.origin).agg(F.max(F.struct("at", (-F.col("tokens")).alias("owed"))).alias("last")).first()["last"]
        bucket = Bucket(self.per_minute, self.burst, now, *((-kept["owed"], kept["at"]) if kept else ()))
        had = bucket.lease(n)
        if self.state is not None:
            cache.put(spark.createDataFrame([(self.origin, float(bucket.at), float(bucket.tokens))], LEASES), self.state)
        return bucket.at, had, bucket.rate

    def answers(self, requests: DataFrame, country: str | None) -> DataFrame:
        """(key, entries as ``catalog.responses`` gives them) of (key, track_id, artist, title), a written table; equal requests are asked once."""
        spark = requests.sparkSession
        code = F.lit(country).cast("string")
        url = F.when(F.col("track_id").isNotNull(), expr.lookup_url(self.origin, F.col("track_id"), code)).otherwise(expr.search_url(self.origin, F.col("artist"), F.col("title"), code))

        def asked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            pace = Pace()
            for pdf in batches:
                for at, due in zip(pdf["url"], pdf["due"]):
                    pace.until(due)
                    body, error = get(at, k.MAX_SEARCH_BYTES, audio=False)
                    yield pd.DataFrame({"url": [at], "body": [body.decode("utf-8", "replace") if body is not None else None], "message": [error]})

        wanted = scratch.written(requests.select("key", url.alias("url")), "asked")
        slot = F.row_number().over(Window.orderBy("first", "url"))  # a rate bounds what is asked, by far
        once = scratch.written(wanted.groupBy("url").agg(F.min("key").alias("first")).select("url", slot.alias("slot")), "slots")
        now, had, rate = self.leased(spark, once.count())
        due = F.lit(now) + F.greatest(F.lit(0.0), (F.col("slot") - had) / rate)
        tasks = max(1, min(self.tasks, int(self.burst)))
        dealt = once.select("url", "slot", due.alias("due")).repartition(tasks, F.col("slot") % tasks).sortWithinPartitions("slot")
        bodies = scratch.written(dealt.mapInPandas(asked, "url string, body string, message string"), "bodies")
        return scratch.written(catalog.responses(wanted.join(bodies, "url").select("key", "body", "message")), "answers")
