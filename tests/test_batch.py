"""Requests to results: ordered, failures as rows, one analysis a track, cache hits, streams."""

import datetime
import json
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pulsegrid.functions import sql, synth
from pulsegrid.operators import cache
from pulsegrid.plans import batch
from pulsegrid.sources import audio, catalog, clips, lines
from pulsegrid.streaming import batch as stream

LINES = [
    '{"artist": "Daft Punk", "title": "Around the World", "client_ref": "a"}',
    "this is not json",
    "   ",
    '{"artist": "Nobody", "title": "Zzzz"}',
    '{"track_id": 7, "unknown": 1}',
    '{"track_id": 8}',
    '{"track_id": 99}',
    '{"track_id": 9}',
    '{"artist": "Daft Punk", "title": "Around the World (Radio Edit)"}',
    '{"artist": "x"}',
    '{"track_id": 10}',
]
WANT = ["ok", "invalid_input", "no_match", "ok", "no_preview", "not_found", "decode", "ok", "invalid_input", "http"]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    at = tmp_path_factory.mktemp("clips")
    (at / "a.wav").write_bytes(synth.wav(synth.groove(124, 12, "four_on_floor") * 0.5))
    (at / "b.wav").write_bytes(synth.wav(synth.chords(9, True, 4) * 0.5))
    (at / "bad.wav").write_bytes(b"RIFF0000WAVEnothing")
    return at


@pytest.fixture(scope="module")
def world(spark, folder):
    at = lambda name: f"file:{folder}/{name}"
    rows = [(1, "Daft Punk", "Around the World", at("a.wav")), (2, "Daft Punk", "Around the World (Radio Edit)", at("a.wav")), (3, "Red Hot Chili Peppers", "Around the World", at("b.wav")), (7, "A", "B", at("b.wav")), (8, "A", "C", None), (9, "A", "D", at("bad.wav")), (10, "A", "E", at("gone.wav"))]
    table = spark.createDataFrame(rows, "c_track_id long, c_artist string, c_title string, c_preview string")
    return table, clips.Folder(str(folder))


def numbered(spark):
    return spark.createDataFrame([*enumerate(LINES)], "line_no long, line string")


def test_batch_and_cache(spark, world, tmp_path):
    done = batch.run(numbered(spark), *world).cache()
    got = [json.loads(r.value) for r in lines.rendered(done).orderBy("line_no").collect()]
    assert [g["error"]["kind"] if g["status"] == "error" else "ok" for g in got] == WANT
    assert got[0]["query"] == {"artist": "Daft Punk", "title": "Around the World", "client_ref": "a"} and got[0]["track"]["track_id"] == 1
    assert abs(got[0]["features"]["tempo"]["bpm"] - 124) < 1 and got[3]["features"]["key"]["key"] == "A minor"
    assert got[1]["query"] == {} and "track" not in got[1] and got[4]["features"] == {} and "audio" not in got[4] and "truncated" not in got[0]["audio"]
    cache.put(batch.storable(done), str(tmp_path / "results"))
    table = cache.opened(spark, str(tmp_path / "results"), cache.RESULTS)
    assert cache.size(table, "track_id", "algorithm_version", "options") == table.count() == 3
    again = [r.analysis for r in batch.run(numbered(spark), *world, results=table).orderBy("line_no").collect()]
    assert [a.cached for a in again if a.status == "ok"] == [True, True, True]
    assert abs(again[0].features.tempo.bpm - got[0]["features"]["tempo"]["bpm"]) < 1e-4
    assert cache.opened(spark, str(tmp_path / "none"), cache.RESOLUTIONS).count() == 0


def told(done):
    return [r.analysis.error.kind if r.analysis.error else "ok" for r in done.orderBy("line_no").collect()]


def test_only_asked_files_are_opened_and_no_bytes_are_shuffled(spark, world, folder, tmp_path):
    log = tmp_path / "opened"

    def get(path):
        with open(log, "a") as out:
            out.write(path + "\n")
        return clips.opened(path)

    for i in range(30):
        (folder / f"unasked{i}.wav").write_bytes(b"never read")
    done = batch.run(numbered(spark), world[0], clips.Folder(str(folder), get))
    plan = done._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan and "BinaryFileFormat" not in plan.replace("binaryFile", "")
    assert told(done) == WANT
    # a track is opened once: two share a.wav, whose tasks may be one; one file is broken
    opened = log.read_text().split()
    assert set(opened) == {f"file:{folder}/{n}" for n in ("a.wav", "b.wav", "bad.wav")} and opened.count(f"file:{folder}/a.wav") <= 2 and len(opened) <= 5


def test_analysis_last_gives_the_same(spark, world):
    lines_ = numbered(spark)
    read = lambda done: sorted((r.line_no, r.value) for r in lines.rendered(done).collect())
    first = batch.run(lines_, *world)
    late = read(batch.run_late(lines_, *world, tasks=5))
    assert late == read(first)
    stored = batch.storable(first).cache()
    assert sorted(read(batch.run(lines_, *world, results=stored))) == sorted(read(batch.run_late(lines_, *world, 3, results=stored)))


def test_table_of_bytes(spark, world, folder):
    assert told(batch.run(numbered(spark), world[0], audio.read(spark, str(folder)))) == WANT


def test_large_and_missing_files_are_not_opened(spark, folder, monkeypatch):
    monkeypatch.setattr("pulsegrid.constants.MAX_AUDIO_BYTES", 10)
    tracks = spark.createDataFrame([(1, f"file:{folder}/a.wav"), (2, f"file:{folder}/none.wav"), (3, None)], "track_id long, preview_url string")
    got = {r.track_id: (r.failed, r.why) for r in batch.analyzed(tracks, clips.Folder(str(folder), lambda path: (None, "opened after all")), batch.Options()).collect()}
    assert got[1][0] == "http" and got[2] == got[3] == ("http", "no such preview")


def test_clip_source_drops_files_before_opening_them(spark, tmp_path, monkeypatch):
    for i in range(12):
        (tmp_path / f"c{i:02d}.wav").write_bytes(b"x" * (i + 1))
    (tmp_path / "c05.wav").chmod(0o600)
    reader = clips.ClipReader(f"file:{tmp_path}")
    keep = clips.EqualTo(("other",), 1)
    left = list(reader.pushFilters([clips.In(("path",), tuple(f"file:{tmp_path}/c{i:02d}.wav" for i in (3, 5, 7))), clips.GreaterThan(("length",), 4), keep]))
    assert left == [keep]
    parts = reader.partitions()
    assert [n for p in parts for n in p.files] == [(f"file:{tmp_path}/c05.wav", 6), (f"file:{tmp_path}/c07.wav", 8)]
    assert [b.to_pylist()[0]["content"] for p in parts for b in reader.read(p)] == [b"x" * 6, b"x" * 8]
    monkeypatch.setattr(clips, "PART_FILES", 5)
    assert [len(p.files) for p in clips.ClipReader(str(tmp_path)).partitions()] == [5, 5, 2]
    clips.register(spark)
    before = spark.conf.get("spark.sql.python.filterPushdown.enabled")
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        got = spark.read.format("clips").load(f"file:{tmp_path}").where(f"path = 'file:{tmp_path}/c02.wav'")
        assert "path" not in got._jdf.queryExecution().optimizedPlan().toString().split("Filter", 1)[-1].split("\n")[0] or got.count() == 1
        assert [(r.length, bytes(r.content), r.message) for r in got.collect()] == [(3, b"xxx", None)]
    finally:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", before)
    assert clips.opened(f"{tmp_path}/none.wav")[0] is None and "too large" in clips.opened(f"{tmp_path}/c11.wav", 3)[1]


def test_lines_of_several_files_are_numbered_in_order(spark, tmp_path):
    (tmp_path / "a.txt").write_text("first\n")
    (tmp_path / "b.txt").write_text("second, longer than first\nx\n")
    (tmp_path / "c.txt").write_text("".join(f"line {i}\n" for i in range(50_000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100000")
    try:
        got = [r.line for r in lines.read(spark, str(tmp_path)).orderBy("line_no").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == ["first", "second, longer than first", "x", *(f"line {i}" for i in range(50_000))]


def test_cache_that_fails(spark, world, tmp_path, caplog, monkeypatch):
    kept = batch.Cache(str(tmp_path / "kept"))

    def full(rows, path, *keys):
        raise OSError("disk full")

    monkeypatch.setattr(cache, "put", full)
    assert told(kept.answer(numbered(spark), *world)) == WANT
    assert "could not cache results: disk full" in caplog.text and "could not cache resolutions" in caplog.text
    broken = tmp_path / "broken" / "results"
    broken.mkdir(parents=True)
    monkeypatch.setattr(cache, "runs", lambda *a: full(*a[:2]))
    assert told(batch.Cache(str(tmp_path / "broken")).answer(numbered(spark), *world)) == ["cache" if w != "invalid_input" else w for w in WANT]


def test_lookups_read_a_bounded_part_of_a_cache(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(cache, "RUNS", 4)
    monkeypatch.setattr(cache, "BUCKETS", 8)
    at = f"file:{tmp_path}/kept"
    row = lambda key, n: (f"key{key}", f"value{n}", datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=n))
    for n in range(21):  # every key again and again
        cache.put(spark.createDataFrame([row((n + i) % 30, n) for i in range(10)], cache.RESOLUTIONS).coalesce(1), at, "query_key")
    known = cache.runs(spark, at)
    assert sorted((r.tier, r.buckets is None) for r in known) == [(0, True), (1, False), (2, False)]
    assert len(cache.generations(spark, at)) == cache.KEPT
    table = cache.opened(spark, at, cache.RESOLUTIONS)
    want = {f"key{(n + i) % 30}": f"value{n}" for n in range(21) for i in range(10)}
    assert {r.query_key: r.matched for r in cache.latest(table, "query_key").collect()} == want
    asked = spark.createDataFrame([("key3",), ("none",)], "query_key string")
    few = cache.opened(spark, at, cache.RESOLUTIONS, asked)
    assert len(few.inputFiles()) <= 1 + 2 * 2 < len(table.inputFiles())
    assert cache.latest(few, "query_key").where("query_key = 'key3'").first().matched == want["key3"]
    # a merge that fails loses nothing
    monkeypatch.setattr(cache, "publish", lambda *a: (_ for _ in ()).throw(OSError("gone")))
    monkeypatch.setattr(cache, "RUNS", 1)
    with pytest.raises(OSError):
        cache.compact(spark, at, cache.RESOLUTIONS, "query_key")
    assert {r.query_key: r.matched for r in cache.latest(cache.opened(spark, at, cache.RESOLUTIONS), "query_key").collect()} == want


def test_stream(spark, world, tmp_path):
    inbox, outbox = tmp_path / "in", tmp_path / "out"
    inbox.mkdir()
    (inbox / "1.jsonl").write_text("\n".join(LINES[1:4]) + "\n")
    time.sleep(0.05)
    (inbox / "0.jsonl").write_text("\n".join([LINES[5], *["no request"] * 30]) + "\n")  # larger, and later
    stream.start(spark, str(inbox), str(outbox), str(tmp_path / "c"), *world, once=True).awaitTermination()
    (inbox / "2.jsonl").write_text(LINES[5] + "\n")
    stream.start(spark, str(inbox), str(outbox), str(tmp_path / "c"), *world, once=True).awaitTermination()
    kinds = [[json.loads(x)["error"]["kind"] for x in "".join(p.read_text() for p in sorted(d.glob("part*"))).splitlines()] for d in sorted(outbox.glob("batch=*"))]
    assert kinds == [["invalid_input", "no_match", "no_preview", *["invalid_input"] * 30], ["no_preview"]]


@pytest.mark.parametrize("bits", [8, 16, 24, 32, "f"])
def test_wav_layouts(bits):
    import struct

    import numpy as np

    half = {8: np.uint8(192).tobytes(), 16: np.int16(1 << 14).tobytes(), 24: (1 << 22).to_bytes(3, "little"), 32: np.int32(1 << 30).tobytes(), "f": np.float32(0.5).tobytes()}[bits]
    width = len(half)
    data = half * 2 * 100
    raw = b"RIFF" + struct.pack("<I", 36 + len(data)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 3 if bits == "f" else 1, 2, 8000, 8000 * width * 2, width * 2, width * 8) + b"data" + struct.pack("<I", len(data)) + data
    got = audio.decode(raw)
    assert got["source_channels"] == 2 and len(got["samples"]) == 100 and abs(got["samples"] - 0.5).max() < 1e-6 and not got["truncated"]


def test_sql_functions(spark):
    before = dict(spark.conf.getAll)
    sql.register(spark)
    assert dict(spark.conf.getAll) == before
    x = synth.chords(0, False, 4).tolist()
    spark.createDataFrame([(x, 44100), ([], 44100)], "samples array<float>, rate int").createOrReplaceTempView("clips")
    got = [r.f for r in spark.sql("SELECT analyze_pcm(samples, rate) AS f FROM clips").collect()]
    assert got[0].key.key == "C major" and got[1].key is None
    n = spark.sql("SELECT count(*) AS n FROM (SELECT * FROM clips WHERE size(samples) > 0), LATERAL tempo_candidates(samples, rate)").first().n
    assert n > 0
    frames = spark.sql("SELECT max(frame) AS f, min(size(magnitudes)) AS n, max(size(magnitudes)) AS m FROM clips, LATERAL spectrogram(slice(samples, 1, 4096), rate)").first()
    assert frames.f == 8 and frames.n == frames.m > 1000
    raw = spark.createDataFrame([(bytearray(synth.wav(synth.chords(0, False, 1))),), (bytearray(b"no"),)], "content binary")
    raw.createOrReplaceTempView("files")
    got = [r.d for r in spark.sql("SELECT decode_audio(content) AS d FROM files").collect()]
    assert got[0].sample_rate == 44100 and len(got[0].samples) == 44100 and got[1].error == "decode" and got[1].samples is None


def test_search_responses(spark):
    bodies = [("a", json.dumps({"resultCount": 1, "results": [{"trackId": 5, "trackName": "T", "more": 1}]})), ("b", "{}"), ("c", "<html>")]
    got = {r.key: (r.c_track_id, r.error) for r in catalog.responses(spark.createDataFrame(bodies, "key string, body string")).collect()}
    assert got == {"a": (5, None), "b": (None, None), "c": (None, "http")}


def test_key_bench(spark, tmp_path):
    at = lambda name: f"file:{tmp_path}/{name}"
    (tmp_path / "a.wav").write_bytes(synth.wav(synth.chords(9, True, 40) * 0.5))
    (tmp_path / "b.wav").write_bytes(b"no audio")
    rows = spark.createDataFrame([("d", "1", at("a.wav"), 9, "minor"), ("d", "2", at("b.wav"), 0, "major"), ("d", "3", at("none.wav"), 0, "major")], "dataset string, id string, url string, tonic_pc int, mode string")
    got = {r.id: json.loads(r.value) for r in audio.benched(rows, clips.Folder(str(tmp_path))).collect()}
    assert got == {r.id: json.loads(r.value) for r in audio.benched(rows, audio.read(spark, str(tmp_path))).collect()}
    assert got["1"]["tonic"] == 9 and set(got["1"]["estimates"]) == {"bands", "edm", "krumhansl"} and got["1"]["estimates"]["bands"]["key"] == "A minor"
    assert len(got["1"]["bands"]) == 5 and got["1"]["estimates"]["edm"]["scoring"]["strength"] >= 0
    assert set(got["2"]) == set(got["3"]) == {"dataset", "id", "error"}


def test_oversize_file_is_told(spark, tmp_path, monkeypatch):
    from pulsegrid import constants as k

    monkeypatch.setattr(k, "MAX_AUDIO_BYTES", 10)
    (tmp_path / "a.wav").write_bytes(b"0123456789x")
    row = audio.read(spark, str(tmp_path)).first()
    assert row.content is None and row.length == 11 and "too large" in row.message


def test_parsed_stream_numbers_equal_lines(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    (inbox / "1.jsonl").write_text('{"track_id": 1}\n{"track_id": 1}\n\n{"track_id": 2}\n')
    stream.parsed_stream(spark, str(inbox)).writeStream.format("memory").queryName("parsed").trigger(availableNow=True).start().awaitTermination()
    rows = spark.sql("SELECT line_no, query.track_id AS id FROM parsed ORDER BY line_no").collect()
    assert [r.id for r in rows] == [1, 1, 2] and len({r.line_no for r in rows}) == 3


def test_lines_stay_in_their_splits(spark, tmp_path):
    """Lines are numbered without a shuffle, by which a task would get whole splits."""
    (tmp_path / "in").mkdir()
    for name in "ab":
        (tmp_path / "in" / name).write_text("".join(f"{name}{i}\n" for i in range(500)))
    got = lines.read(spark, str(tmp_path / "in"))
    assert [r.line for r in got.orderBy("line_no").collect()] == [f"{n}{i}" for n in "ab" for i in range(500)]
    assert "hashpartitioning(file" not in got._jdf.queryExecution().executedPlan().toString()


def test_requests_without_a_track_are_spread(spark):
    """A join by track deals requests that have none over the partitions."""
    rows = spark.range(2000).selectExpr("id AS line_no", "IF(id % 100 = 0, id, NULL) AS track_id")
    other = spark.range(0, 2000, 200).selectExpr("id AS other_id", "'met' AS said")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    got = batch.joined(rows, other.hint("merge"), F.col("track_id"), F.col("other_id"), F.xxhash64("line_no")).withColumn("part", F.spark_partition_id()).collect()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(got) == 2000 and {r.line_no for r in got if r.said} == set(range(0, 2000, 200))
    assert max(Counter(r.part for r in got).values()) < 1000
