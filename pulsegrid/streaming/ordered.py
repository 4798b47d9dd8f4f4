"""Results line by line, in the order of their input, while other lines are still being worked on.

Two queries.  The first answers requests and writes each task's results as soon as the task
ends, not when the batch does, in any order.  The second holds results back until all lines
before them have come, in state keyed by input; a timer gives up a line that keeps others
waiting too long.  A slow clip so holds back the lines after it in its own input, and
nothing else.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..plans import batch
from ..sources import clips, lines, web

RESULT = "input STRING, place BIGINT, value STRING"
EMITTED = "input STRING, place BIGINT, value STRING, given_up BOOLEAN"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class InOrder(StatefulProcessor):
    """Rows (input, place, value) leave in the order of ``place``, which counts from 0, each place once.

    If the next place has not come ``hold_secs`` after a later one did, the places up to
    the first that has are given up: rows without a value.  What comes for them later is
    dropped, as is what comes twice.
    """

    def __init__(self, hold_secs: float):
        self.hold = int(hold_secs * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.next = handle.getValueState("next", "place BIGINT")
        self.held = handle.getMapState("held", "place BIGINT", "value STRING")

    def expected(self) -> int:
        return self.next.get()[0] if self.next.exists() else 0

    def released(self, name: str, upto: int) -> pd.DataFrame:
        """All from the next place up to ``upto``, given up where they have not come, and what follows without a gap."""
        place, rows = self.expected(), []
        while True:
            there = self.held.containsKey((place,))
            if not there and place >= upto:
                break
            rows.append((name, place, self.held.getValue((place,))[0] if there else None, not there))
            if there:
                self.held.removeKey((place,))
            place += 1
        self.next.update((place,))
        return pd.DataFrame(rows, columns=["input", "place", "value", "given_up"])

    def timed(self, now: int) -> None:
        """One timer while anything is held."""
        waiting = any(True for _ in self.held.keys())
        if waiting and not any(True for _ in self.handle.listTimers()):
            self.handle.registerTimer(now + self.hold)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = self.expected()
        for pdf in rows:
            for place, value in zip(pdf["place"].tolist(), pdf["value"].tolist()):
                if place >= first and not self.held.containsKey((place,)):
                    self.held.updateValue((place,), (value,))
        out = self.released(key[0], first)
        if len(out):  # what is waited for now is another line
            for at in [*self.handle.listTimers()]:
                self.handle.deleteTimer(at if isinstance(at, int) else at[0])
        self.timed(timerValues.getCurrentProcessingTimeInMs())
        yield out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        places = [p[0] if isinstance(p, tuple) else int(p) for p in self.held.keys()]
        out = self.released(key[0], min(places)) if places else pd.DataFrame([], columns=["input", "place", "value", "given_up"])
        now = timerValues.getCurrentProcessingTimeInMs()
        if any(True for _ in self.held.keys()):
            self.handle.registerTimer(now + self.hold)
        yield out

    def close(self) -> None:
        pass


def in_order(results: DataFrame, hold_secs: float) -> DataFrame:
    """A stream of RESULT rows as a stream of EMITTED rows; start it with ``stored``."""
    return results.groupBy("input").transformWithStateInPandas(statefulProcessor=InOrder(hold_secs), outputStructType=EMITTED, outputMode="Append", timeMode="ProcessingTime")


class stored:
    """The session with a state store that such state needs; as before afterwards.  A query keeps the settings it was started with."""

    NAME = "spark.sql.streaming.stateStore.providerClass"

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def __enter__(self) -> None:
        self.before = self.spark.conf.get(self.NAME, None)
        self.spark.conf.set(self.NAME, STORE)

    def __exit__(self, *_) -> None:
        self.spark.conf.set(self.NAME, self.before) if self.before else self.spark.conf.unset(self.NAME)


def requests(spark: SparkSession, inbox: str) -> DataFrame:
    """(input, place, line) of the lines that are not blank, of every file that comes to ``inbox``."""
    files = spark.readStream.text(inbox, wholetext=True).select("value", F.col("_metadata.file_path").alias("input"))
    told = F.filter(F.split("value", "\\r?\\n"), lambda x: F.trim(x) != "")
    return files.select("input", F.posexplode(told).alias("place", "line")).select("input", F.col("place").cast("long").alias("place"), "line")


def start(spark: SparkSession, inbox: str, finished: str, outbox: str, checkpoint: str, catalog: DataFrame | web.Service, files: clips.Folder | None, options: batch.Options = batch.Options(), hold_secs: float = 600.0, tasks: int = 64) -> tuple[StreamingQuery, StreamingQuery]:
    """The two queries: results go to ``finished`` as tasks end, and from there in order to ``outbox``, a folder of JSON (EMITTED) a micro-batch, an input's lines in order in one file."""

    def answer(rows: DataFrame, number: int) -> None:
        named = rows.select(F.struct("input", "place").alias("line_no"), "line")
        done = lines.rendered(batch.run_late(named, catalog, files, tasks, options=options)).select("line_no.input", "line_no.place", "value")
        # this version of the committer shows a task's file when the task ends; a task that is run again replaces its own
        done.write.mode("overwrite").option("mapreduce.fileoutputcommitter.algorithm.version", "2").parquet(f"{finished}/batch={number}")

    def emit(rows: DataFrame, number: int) -> None:
        # one job, for the state is brought on by it: a global order would run it twice, to sample first
        rows.repartition("input").sortWithinPartitions("input", "place").write.mode("overwrite").json(f"{outbox}/batch={number:09d}")

    first = requests(spark, inbox).writeStream.foreachBatch(answer).option("checkpointLocation", f"{checkpoint}/answers").trigger(processingTime="0 seconds").start()
    with stored(spark):
        results = spark.readStream.schema(RESULT).option("recursiveFileLookup", "true").parquet(finished)
        second = in_order(results, hold_secs).writeStream.foreachBatch(emit).option("checkpointLocation", f"{checkpoint}/order").trigger(processingTime="0 seconds").start()
    return first, second
