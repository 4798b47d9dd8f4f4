"""Search service and previews over HTTP, against a server of this machine; the command line on top."""

import http.server
import json
import threading
import urllib.parse

import pytest

from pulsegrid import cli, constants as k
from pulsegrid.functions import synth
from pulsegrid.operators import cache
from pulsegrid.plans import batch
from pulsegrid.sources import lines, web

SONGS = [(1, "Daft Punk", "Around the World", "a.wav"), (2, "Daft Punk", "Around the World (Radio Edit)", "a.wav"), (3, "Red Hot Chili Peppers", "Around the World", "b.wav"), (8, "A", "Without preview", None), (9, "A", "Broken", "text.html"), (10, "A", "Large", "large.wav"), (11, "A", "Lost", "none.wav")]


@pytest.fixture(scope="module")
def server():
    asked = []
    clips = {"a.wav": synth.wav(synth.groove(124, 12, "four_on_floor") * 0.5), "b.wav": synth.wav(synth.chords(9, True, 4) * 0.5)}

    class Handler(http.server.BaseHTTPRequestHandler):
        def log_message(self, *_):
            pass

        def answer(self, code, body=b"", kind="audio/wav", **headers):
            self.send_response(code)
            for name, value in {"Content_Type": kind, "Content_Length": str(len(body)), **headers}.items():
                self.send_header(name.replace("_", "-"), value)
            self.end_headers()
            self.wfile.write(body)

        def do_GET(self):
            url = urllib.parse.urlsplit(self.path)
            asked.append(self.path)
            query = urllib.parse.parse_qs(url.query)
            name = url.path.lstrip("/")
            entry = lambda s: {"trackId": s[0], "artistName": s[1], "trackName": s[2]} | ({"previewUrl": f"{at}/{s[3]}"} if s[3] else {})
            if name == "search":
                words = set(query["term"][0].lower().split())
                found = [] if query.get("country") == ["jp"] else [entry(s) for s in SONGS if words & set(f"{s[1]} {s[2]}".lower().split())]
                self.answer(200, json.dumps({"resultCount": len(found), "results": found}).encode(), "text/javascript")
            elif name == "lookup":
                self.answer(200, json.dumps({"results": [entry(s) for s in SONGS if str(s[0]) == query["id"][0]]}).encode())
            elif name in clips:
                self.answer(200, clips[name])
            elif name == "text.html":
                self.answer(200, b"<html>", "text/html; charset=utf-8")
            elif name == "large.wav":
                self.answer(200, b"", Content_Length=str(k.MAX_AUDIO_BYTES + 1))
            elif name.startswith("hop"):
                n = int(name[3:])
                self.answer(302, Location="/a.wav" if n == 1 else f"/hop{n - 1}")
            elif name == "away":
                self.answer(302, Location="http://example.invalid/a.wav")
            else:
                self.answer(404)

    httpd = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    at = f"http://127.0.0.1:{httpd.server_port}"
    threading.Thread(target=httpd.serve_forever, daemon=True).start()
    yield at, asked, clips
    httpd.shutdown()


def test_get(server):
    at, _, clips = server
    assert web.get(f"{at}/a.wav", 1 << 23, True) == (clips["a.wav"], None)
    assert web.get(f"{at}/hop2", 1 << 23, True)[0] == clips["a.wav"]
    for path, why in (("hop3", "redirects"), ("away", "refused redirect"), ("none", "404"), ("text.html", "not audio"), ("large.wav", "too large")):
        body, error = web.get(f"{at}/{path}", k.MAX_AUDIO_BYTES, True)
        assert body is None and why in error, (path, error)
    assert web.get(f"{at}/a.wav", 1000, True)[0] is None and web.get(f"{at}/text.html", 1 << 20, False)[0] == b"<html>"
    assert "refused URL" in web.get("http://example.com/a", 1, True)[1] and "refused URL" in web.get("file:///etc/hosts", 1, True)[1]
    assert web.permitted("https://example.com/x") and web.permitted("http://[::1]:80/") and not web.permitted("ftp://localhost/") and not web.permitted("http://[")


def test_bucket_waits():
    now = [0.0]
    bucket = web.Bucket(18, 5, lambda: now[0])
    assert [round(bucket.wait(), 3) for _ in range(7)] == [0, 0, 0, 0, 0, 3.333, 6.667]
    now[0] = 60.0
    assert bucket.wait() == 0 and bucket.tokens <= 5


def conforms(times, per_second, burst):
    """Whether requests at these times never outrun a token bucket."""
    tokens, last = burst, min(times)
    for t in sorted(times):
        tokens, last = min(burst, tokens + (t - last) * per_second) - 1, t
        if tokens < -1e-6:
            return False
    return True


@pytest.mark.parametrize("late", [0.0, 7.0, 100.0])
def test_tasks_together_keep_the_rate(spark, tmp_path, late):
    """Each task has a clock of its own; the second starts ``late``; a second batch after a crash owes what the first leased."""
    service, begun, times = web.Service("http://x", 60, 4, f"file:{tmp_path}/leases", 2), 1000.0, []
    for batch_, (n, start) in enumerate([(20, begun), (10, begun + 3)]):
        at, had, rate = service.leased(spark, n, lambda: start)  # noqa: B023
        assert at == start and had == pytest.approx(4.0 if batch_ == 0 else -16.0 + 3.0)
        dues = [at + max(0.0, (slot - had) / rate) for slot in range(1, n + 1)]
        for task in range(2):
            clock = [at + (late if task and batch_ else 0.0)]
            pace = web.Pace(lambda: clock[0], lambda secs: clock.__setitem__(0, clock[0] + secs))  # noqa: B023
            for due in dues[task::2]:
                pace.until(due)
                assert clock[0] >= due - 1e-9
                times.append(clock[0])
    assert len(times) == 30 and conforms(times, 1.0, 4 + 2)
    assert web.Service("http://other", 60, 4, f"file:{tmp_path}/leases").leased(spark, 1, lambda: begun)[1] == 4.0


def test_equal_requests_are_asked_once(spark, server):
    at, asked, _ = server
    asked.clear()
    rows = spark.createDataFrame([(i, None, "Daft Punk", "Around the World") for i in range(3)] + [(i, 3, None, None) for i in range(3, 7)], "key long, track_id long, artist string, title string").repartition(4)
    got = web.Service(at, per_minute=60_000, tasks=3).answers(rows, None)
    assert {r.key for r in got.where("error IS NULL").collect()} == set(range(7)) and len(asked) == 2


LINES = ['{"artist": "Daft Punk", "title": "Around the World"}', '{"artist": "nobody", "title": "zzzz"}', '{"track_id": 3}', '{"track_id": 8}', '{"track_id": 77}', '{"track_id": 9}', '{"track_id": 10}', '{"track_id": 11}', "{"]
WANT = ["ok", "no_match", "ok", "no_preview", "not_found", "http", "http", "http", "invalid_input"]


def test_service_and_caches(spark, server, tmp_path):
    at, asked, _ = server
    asked.clear()
    service, options = web.Service(at, per_minute=60_000), batch.Options(country="gb", explain_key_scoring=True)
    numbered = spark.createDataFrame([*enumerate(LINES)], "line_no long, line string")
    kept = batch.Cache(f"file:{tmp_path}/cache")
    kinds = lambda done: [json.loads(r.value) for r in lines.rendered(done).orderBy("line_no").collect()]
    first = kinds(kept.answer(numbered, service, None, options))
    assert [g["error"]["kind"] if g["status"] == "error" else "ok" for g in first] == WANT
    assert abs(first[0]["features"]["tempo"]["bpm"] - 124) < 1 and first[2]["features"]["key"]["scoring"]["strength"] > 0
    assert "too large" in first[6]["error"]["message"] and "404" in first[7]["error"]["message"] and "not audio" in first[5]["error"]["message"]
    assert sum("search" in x for x in asked) == 2 and sum("lookup" in x for x in asked) == 6 and all("country=gb" in x for x in asked if "?" in x)
    assert sum("a.wav" in x for x in asked) == 1
    asked.clear()
    again = kinds(kept.answer(numbered, service, None, options))
    assert [g.get("cached") for g in again if g["status"] == "ok"] == [True, True] and again[0]["features"] == first[0]["features"]
    assert sum("search" in x for x in asked) == 1 and sum("lookup" in x for x in asked) == 2  # what failed to resolve is asked again
    plain = kinds(kept.answer(numbered, service, None, batch.Options(country="gb")))
    assert plain[2]["cached"] is False and "scoring" not in plain[2]["features"]["key"]
    other = kinds(kept.answer(numbered, service, None, batch.Options(country="jp")))
    assert other[0]["error"]["kind"] == "no_match"
    stored = cache.opened(spark, f"file:{tmp_path}/cache/results", cache.RESULTS)
    assert {r.options for r in stored.select("options").distinct().collect()} == {"key_profile=bands,explain_key_scoring=true", "key_profile=bands,explain_key_scoring=false"}
    assert not cache.is_empty(stored) and cache.is_empty(cache.opened(spark, f"file:{tmp_path}/nowhere", cache.RESULTS))


def test_country_of_a_catalog_table(spark):
    table = spark.createDataFrame([(1, "A", "B", None, "us"), (2, "A", "B", None, "de"), (3, "A", "B", None, None)], "c_track_id long, c_artist string, c_title string, c_preview string, country string")
    ids = lambda code: sorted(r.c_track_id for r in batch.entries(table, batch.Options(country=code)).collect())
    assert ids(None) == ids("US") == [1, 3] and ids("de") == [2] and ids("fr") == []


def test_command_line(spark, server, tmp_path, capsys, monkeypatch):
    at, _, _ = server
    table = spark.createDataFrame([(1, "Daft Punk", "Around the World", f"{at}/a.wav")], "c_track_id long, c_artist string, c_title string, c_preview string")
    table.write.parquet(f"file:{tmp_path}/catalog")
    base = ["--catalog", f"file:{tmp_path}/catalog", "--cache-path", f"file:{tmp_path}/kept"]
    ask = ["analyze", "--artist", "Daft Punk", "--title", "Around the World", "--client-ref", "x", *base]
    told = lambda: json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert cli.main([*ask, "--explain-key"]) == 0
    one = told()
    assert one["status"] == "ok" and one["query"]["client_ref"] == "x" and "scoring" in one["features"]["key"] and not one["cached"]
    assert cli.main([*ask, "--explain-key"]) == 0 and told()["cached"]
    assert cli.main([*ask, "--no-cache", "--key-profile", "ks"]) == 0
    one = told()
    assert not one["cached"] and "scoring" not in one["features"]["key"] and "krumhansl" in one["features"]["key"]["source"]
    assert cli.main(["analyze", "--track-id", "5", *base]) == 1 and told()["error"]["kind"] == "not_found"
    assert cli.main(["probe", f"{at}/a.wav"]) == 0
    facts = told()
    assert facts["bytes"] > 1000 and facts["pcm"]["sample_rate"] == 44100 and 0 < facts["pcm"]["rms"] < facts["pcm"]["peak"] <= 1
    with pytest.raises(SystemExit):
        cli.main(["probe", f"{at}/none"])
    for bad in (["--country", "usa"], ["--key-profile", "x"]):
        with pytest.raises(SystemExit):
            cli.main([*ask, *bad])
    capsys.readouterr()
    (tmp_path / "in.jsonl").write_text("\n".join(LINES[:3]) + "\n")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    assert cli.main(["batch", "--input", f"file:{tmp_path}/in.jsonl", "--output", f"file:{tmp_path}/out", "--concurrency", "2", *base]) == 0
    spark.conf.set("spark.sql.shuffle.partitions", before)
    got = [json.loads(x)["status"] for p in sorted((tmp_path / "out").glob("part*")) for x in p.read_text().splitlines()]
    assert got == ["ok", "error", "error"]
    monkeypatch.setattr(k, "REFERENCE_TRACKS", (("Daft Punk", "Around the World", 124.0, "", "house"), ("Nobody", "Zzzz", 100.0, "", "none")))
    assert cli.main(["validate", "--catalog", f"file:{tmp_path}/catalog"]) == 1
    said = capsys.readouterr()
    report = json.loads(said.out)
    assert report["summary"]["total"] == 2 and report["summary"]["tempo_ok"] == 1
    assert "| Daft Punk — Around the World | house | 124 |" in said.err and "failed: no_match" in said.err and "strength" in said.err


def test_cache_path(spark, monkeypatch):
    monkeypatch.setenv("XDG_CACHE_HOME", "/somewhere")
    assert cli.cache_path(spark, None, False) == "file:///somewhere/pulsegrid"
    assert cli.cache_path(spark, "x", False) == "x" and cli.cache_path(spark, "x", True) is None
