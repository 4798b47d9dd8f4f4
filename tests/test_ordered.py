"""Line by line emission: a slow clip holds back the lines after it in its input, and nothing else."""

import glob
import json
import time

from pulsegrid.functions import synth
from pulsegrid.sources import clips
from pulsegrid.streaming import ordered


def wait_for(what, secs=90.0):
    end = time.monotonic() + secs
    while time.monotonic() < end:
        if got := what():
            return got
        time.sleep(0.2)
    raise TimeoutError("it did not come about")


def read(outbox):
    rows = [json.loads(x) for path in sorted(glob.glob(f"{outbox}/batch=*/part*")) for x in open(path) if x.strip()]
    return [(r["input"].rsplit("/", 1)[-1], r["place"], r.get("value"), r["given_up"]) for r in rows]


def test_lines_come_in_order_before_a_slow_one_is_done(spark, tmp_path):
    for name, tempo in (("a", 124), ("b", 128), ("c", 132)):
        (tmp_path / f"{name}.wav").write_bytes(synth.wav(synth.groove(tempo, 8, "four_on_floor") * 0.5))
    at = lambda name: f"file:{tmp_path}/{name}.wav"
    # ids of tracks that go to different tasks
    ids = [r.id for r in spark.range(200).selectExpr("id", "pmod(hash(id), 64) AS task").groupBy("task").agg({"id": "min"}).withColumnRenamed("min(id)", "id").orderBy("id").limit(3).collect()]
    catalog = spark.createDataFrame([(i, "A", t, at(t)) for i, t in zip(ids, "abc")], "c_track_id long, c_artist string, c_title string, c_preview string")
    gate, inbox, finished, outbox = tmp_path / "open", tmp_path / "in", tmp_path / "done", tmp_path / "out"
    inbox.mkdir()
    finished.mkdir()

    def get(path):
        while path.endswith("b.wav") and not gate.exists():
            time.sleep(0.1)
        return clips.opened(path)

    ask = [json.dumps({"track_id": i}) for i in ids]
    (inbox / "1.jsonl").write_text("\n\n".join(ask) + "\n")
    (inbox / "2.jsonl").write_text(ask[2] + "\nno request\n")
    queries = ordered.start(spark, str(inbox), str(finished), str(outbox), str(tmp_path / "check"), catalog, clips.Folder(f"{tmp_path}/*.wav", get))
    try:
        before = wait_for(lambda: {("1.jsonl", 0), ("2.jsonl", 0)} <= {r[:2] for r in read(outbox)} and sorted(read(outbox)))
        assert [r[1] for r in before if r[0] == "1.jsonl"] == [0]  # line 1 is out, lines 2 and 3 are not, though 3 is done
        assert json.loads(before[0][2])["status"] == "ok"
        gate.touch()
        after = wait_for(lambda: len(read(outbox)) >= 5 and read(outbox))
        assert [r[1] for r in after if r[0] == "1.jsonl"] == [0, 1, 2] and not any(r[3] for r in after)
        assert [json.loads(r[2])["track"]["track_id"] for r in after if r[0] == "1.jsonl"] == ids
        assert json.loads(next(r[2] for r in after if r[:2] == ("2.jsonl", 1)))["error"]["kind"] == "invalid_input"
    finally:
        for q in queries:
            q.stop()
    assert spark.conf.get(ordered.stored.NAME) != ordered.STORE


def test_what_never_comes_is_given_up_and_what_comes_twice_goes(spark, tmp_path):
    source, out = tmp_path / "source", tmp_path / "out"
    source.mkdir()

    def come(name, rows):
        spark.createDataFrame([("x", p, f"v{p}") for p in rows], ordered.RESULT).coalesce(1).write.parquet(f"{source}/{name}")

    come("1", [2, 0, 4])
    stream = spark.readStream.schema(ordered.RESULT).option("recursiveFileLookup", "true").parquet(str(source))

    def emit(rows, number):
        rows.repartition("input").sortWithinPartitions("place").write.mode("overwrite").json(f"{out}/batch={number:09d}")

    with ordered.stored(spark):
        q = ordered.in_order(stream, 4.0).writeStream.foreachBatch(emit).option("checkpointLocation", str(tmp_path / "check")).trigger(processingTime="0 seconds").start()
    try:
        first = wait_for(lambda: read(out))
        assert first == [("x", 0, "v0", False)]
        got = wait_for(lambda: len(read(out)) >= 5 and read(out))
        assert got == [("x", 0, "v0", False), ("x", 1, None, True), ("x", 2, "v2", False), ("x", 3, None, True), ("x", 4, "v4", False)]
        come("2", [1, 2, 3, 5])
        assert wait_for(lambda: len(read(out)) >= 6 and read(out))[5:] == [("x", 5, "v5", False)]
    finally:
        q.stop()
