"""The version-keyed result cache, of which the latest row of a key counts.

A cache is a folder of runs.  An append is a run; RUNS of one tier are merged into one of
the next, of which only the latest rows of each key stay, dealt into BUCKETS by a hash of
the key, sorted by it and with a Bloom filter on it.  So a row is written again a
logarithmic number of times, and a lookup reads the buckets of its keys in a logarithmic
number of runs and a few small runs, not all that was ever appended.  A generation of the
manifest names the runs that count; it is written after the runs it names, so a write or
merge that fails changes nothing.  One writer at a time.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import constants as k

RESULTS = "track_id BIGINT, algorithm_version INT, options STRING, payload STRING, created_at TIMESTAMP"
RESOLUTIONS = "query_key STRING, matched STRING, created_at TIMESTAMP"
RESULT_KEYS = ("track_id", "algorithm_version", "options")
#: Runs of a tier before they are merged, buckets of a merged run, generations that stay for readers of them.
RUNS, BUCKETS, KEPT = 16, 32, 4
MANIFEST = "run STRING, tier INT, buckets ARRAY<INT>"


def _files(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def generations(spark: SparkSession, path: str) -> list[int]:
    """The numbers of whole manifests, rising."""
    fs, at = _files(spark, f"{path}/manifest")
    if not fs.exists(at):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(at)]
    return sorted(int(n[4:]) for n in names if n.startswith("gen=") and fs.exists(_files(spark, f"{path}/manifest/{n}/_SUCCESS")[1]))


def runs(spark: SparkSession, path: str, generation: int | None = None) -> list:
    """(run, tier, buckets) of a generation, the last if none is named: RUNS a tier at most."""
    known = generations(spark, path) if generation is None else [generation]
    return spark.read.schema(MANIFEST).parquet(f"{path}/manifest/gen={known[-1]}").collect() if known else []


def publish(spark: SparkSession, path: str, names: list[tuple]) -> None:
    """A new generation of these runs; older ones, and runs that only they name, go after a while."""
    known = generations(spark, path)
    spark.createDataFrame(names, MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/gen={(known[-1] if known else 0) + 1}")
    old, stay = known[: 1 - KEPT], known[1 - KEPT :]
    if old:
        needed = {r.run for g in stay for r in runs(spark, path, g)} | {n[0] for n in names}
        for g in old:
            gone = {r.run for r in runs(spark, path, g)} - needed
            for name in (*gone, f"manifest/gen={g}"):
                fs, at = _files(spark, f"{path}/{name}")
                fs.delete(at, True)


def opened(spark: SparkSession, path: str, schema: str, keys: DataFrame | None = None) -> DataFrame:
    """The table at ``path``; an empty one where nothing was stored yet.  With ``keys``, a table of the first column's values, at least the rows that have one of them."""
    first = schema.split()[0]
    wanted = None if keys is None else {r[0] for r in keys.select(F.pmod(F.hash(first), F.lit(BUCKETS))).distinct().collect()}  # BUCKETS numbers at most
    paths = []
    for r in runs(spark, path):
        paths += [f"{path}/{r.run}"] if r.buckets is None else [f"{path}/{r.run}/bucket={b}" for b in r.buckets if wanted is None or b in wanted]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def put(rows: DataFrame, path: str, *keys: str) -> None:
    """Appends ``rows``; of rows with equal ``keys``, if given, the one created last need be kept only."""
    spark, run = rows.sparkSession, f"run-{uuid.uuid4().hex}"
    rows.write.parquet(f"{path}/{run}")
    if spark.read.schema(rows.schema).parquet(f"{path}/{run}").isEmpty():
        return
    publish(spark, path, [*map(tuple, runs(spark, path)), (run, 0, None)])
    compact(spark, path, rows.schema.simpleString()[7:-1].replace(":", " "), *keys)


def compact(spark: SparkSession, path: str, schema: str, *keys: str) -> None:
    """Merges tiers that have RUNS runs, from the lowest up."""
    first = schema.split()[0]
    while True:
        known = runs(spark, path)
        full = [t for t in sorted({r.tier for r in known}) if sum(r.tier == t for r in known) >= RUNS]
        if not full:
            return
        merged = [r for r in known if r.tier == full[0]]
        paths = [f"{path}/{r.run}" if r.buckets is None else f"{path}/{r.run}/bucket={b}" for r in merged for b in (r.buckets or [None])]
        rows = spark.read.schema(schema).parquet(*paths)
        rows = (latest(rows, *keys) if keys else rows).withColumn("bucket", F.pmod(F.hash(first), F.lit(BUCKETS)))
        run = f"run-{uuid.uuid4().hex}"
        ordered = rows.repartition("bucket").sortWithinPartitions("bucket", first)
        ordered.write.option(f"parquet.bloom.filter.enabled#{first}", "true").partitionBy("bucket").parquet(f"{path}/{run}")
        buckets = sorted(r[0] for r in spark.read.parquet(f"{path}/{run}").select("bucket").distinct().collect())
        publish(spark, path, [*(tuple(r) for r in known if r not in merged), (run, full[0] + 1, buckets)])


def latest(table: DataFrame, *keys: str, by: str = "created_at") -> DataFrame:
    """One row a key: the last written; equal times are told apart by the whole row."""
    rest = [c for c in table.columns if c not in (*keys, by)]
    best = table.groupBy(*keys).agg(F.max(F.struct(by, *rest)).alias("_best"))
    return best.select(*keys, F.col(f"_best.{by}").alias(by), *[F.col(f"_best.{c}").alias(c) for c in rest])


def hits(queries: DataFrame, results: DataFrame, options: str, payload: str, version: int = k.ALGORITHM_VERSION) -> DataFrame:
    """``queries`` (track_id, ...) with ``hit``: the stored payload parsed by schema ``payload``, null where none fits."""
    kept = latest(results.where((F.col("algorithm_version") == version) & (F.col("options") == options)), "track_id")
    parsed = kept.select("track_id", F.from_json("payload", payload, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("hit"), F.try_parse_json("payload").isNotNull().alias("_ok"))
    return queries.join(parsed.select("track_id", F.when(F.col("_ok"), F.col("hit")).alias("hit")), "track_id", "left")


def resolutions(table: DataFrame, schema: str) -> DataFrame:
    """(query_key, track): the latest resolution of each key, parsed by ``schema``; rows that don't parse are misses."""
    kept = latest(table, "query_key").withColumn("track", F.from_json("matched", schema))
    return kept.where(F.try_parse_json("matched").isNotNull() & F.col("track.track_id").isNotNull()).select("query_key", "track")


def once(queries: DataFrame, key: str = "track_id") -> DataFrame:
    """The distinct keys to analyse: requests that share a track share its analysis."""
    return queries.where(F.col(key).isNotNull()).select(key).distinct()


def size(table: DataFrame, *keys: str) -> int:
    return latest(table, *keys).count()


def is_empty(table: DataFrame) -> bool:
    return table.isEmpty()


def waits(arrivals: DataFrame, rate: float = k.PER_MINUTE, burst: float = k.BURST, key: str = "bucket", at: str = "secs") -> DataFrame:
    """A token bucket over all arrivals (bucket, secs, tie): how long each must wait, in seconds.

    With r tokens a second and n arrivals so far, n - r t + max over k of (r t_k - k + 1) tokens
    are owed; what exceeds the burst is waited for.
    """
    r, cap = max(rate, 0.01) / 60.0, max(burst, 1.0)
    order = Window.partitionBy(key).orderBy(at, "tie")
    rows = arrivals.withColumn("_n", F.row_number().over(order).cast("double"))
    owed = F.col("_n") - r * F.col(at) + F.max(r * F.col(at) - F.col("_n") + 1).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("wait", F.greatest((owed - cap) / r, F.lit(0.0))).drop("_n")
