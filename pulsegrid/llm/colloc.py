"""Phrase collocations: word sequences that stand together more often than their parts let expect.

1. **Pieces.**  Texts are lower-cased (A-Z) and split at punctuation and line ends.
   Identical pieces of a language become one row with a multiplicity, by a grouping that
   Spark combines in each task first, so copied texts and boilerplate are cut into words once.
2. **Counts.**  Each task cuts its pieces into n-grams weighted by multiplicity and adds
   them up in DuckDB, RUN of them at a time; sums leave it as one packed block for each
   hash bucket of n-grams.  A bucket's task adds its blocks up in DuckDB.  DuckDB works
   within MEMORY and goes out of core beyond it, to a folder of the task's own that ends
   with it and that nothing else reads, as Spark's sorts do.  A frequent n-gram is a row a
   run.  A task takes its buckets one after the other.
3. **Parts.**  No part of a candidate is rarer than the candidate, so only n-grams with
   the least count go on.  A candidate asks for the counts of its parts: requests are made
   distinct within each of HOMES groups of candidates, go to the counts by hash, and come
   back to their group, so the most common word of all gets HOMES requests, not one a phrase.
4. **Ranks.**  The first of each language are found by rounds over ever fewer groups.

Arithmetic is exact: counts are longs, products decimals of 38 digits.

Defined results: a null text counts as empty, a null language as ``und``; rows are counted
each, whatever their ids; columns other than text and language are not read; a piece of
any length is taken whole; ties of score go to the larger count, then to the phrase by
bytes; an empty table, or one without candidates, gives an empty result.
"""

from __future__ import annotations

import itertools
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import scratch

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PIECE_ENDS = r"[.,;:!?\x0A-\x0D]"
#: What DuckDB holds in memory in a task; Arrow rows that are cut into n-grams at once.
MEMORY, CUT_ROWS = "160MB", 2048
#: N-grams that a task adds up at once, at least; of few buckets' worth, blocks would be small.
RUN, RUN_A_BUCKET = 1 << 20, 64
#: Tasks that count, beside the session's shuffle partitions, and buckets at least.
SPREAD, LEAST_BUCKETS = 8, 256
#: Groups of candidates that ask together.
HOMES = 256
GRAMS = pa.schema([("lang", pa.string()), ("gram", pa.string()), ("n", pa.int64())])
COUNTS = "lang string, gram string, words int, n long"


def pieces(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, piece, n): distinct pieces that have words, and how often each stands in ``docs``."""
    text = F.translate(F.coalesce(F.col(text_col), F.lit("")), UPPER, LOWER)
    cut = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.explode(F.split(text, PIECE_ENDS)).alias("piece"))
    bare = cut.select("lang", F.btrim("piece", F.lit(" \t")).alias("piece")).where("piece <> ''")
    return bare.groupBy("lang", "piece").agg(F.count("*").alias("n"))


def grams(batch: pa.RecordBatch, longest: int) -> Iterator[pa.RecordBatch]:
    """The n-grams of up to ``longest`` words of a batch of (lang, piece, n), one row an occurrence in a distinct piece."""
    for lo in range(0, batch.num_rows, CUT_ROWS):
        part = batch.slice(lo, CUT_ROWS)
        listed = pc.split_pattern(pc.replace_substring(part.column("piece"), "\t", " "), " ")
        words, owner = listed.flatten(), pc.list_parent_indices(listed)
        solid = pc.not_equal(words, "")
        words, owner = words.filter(solid), owner.filter(solid).to_numpy()
        many = part.column("n").to_numpy()
        for k in range(1, longest + 1):
            n = len(words) - k + 1
            if n <= 0:
                break
            at = np.flatnonzero(owner[:n] == owner[k - 1 :])
            if not len(at):
                break
            run = words if k == 1 else pc.binary_join_element_wise(*(words.slice(i, n) for i in range(k)), " ")
            own = owner[at]
            if k == 1:  # a language's words in all are a row without n-gram
                every = pa.table({"lang": part.column("lang"), "n": pa.array(many * np.bincount(own, minlength=part.num_rows))}).group_by("lang").aggregate([("n", "sum")])
                yield pa.RecordBatch.from_arrays([every["lang"].combine_chunks(), pa.nulls(len(every), pa.string()), every["n_sum"].combine_chunks()], schema=GRAMS)
            yield pa.RecordBatch.from_arrays([part.column("lang").take(pa.array(own)), run.take(pa.array(at)), pa.array(many[own])], schema=GRAMS)


def summed(batches: Iterator[pa.RecordBatch], sql: str) -> Iterator[pa.RecordBatch]:
    """``sql`` over ``batches`` of GRAMS as the table ``grams``, in DuckDB within MEMORY, out of core beyond it."""
    import duckdb

    with tempfile.TemporaryDirectory() as own:
        with duckdb.connect(config={"threads": 1, "memory_limit": MEMORY, "temp_directory": own, "preserve_insertion_order": False}) as db:
            db.register("grams", pa.RecordBatchReader.from_batches(GRAMS, batches))
            yield from db.sql(sql).to_arrow_reader(1 << 16)


#: A block of counts: n-grams in a row, by language; one without n-gram is an empty line.
BLOCK = "bucket int, langs array<string>, many array<long>, size long, grams binary, n binary"
_BLOCK = pa.schema([("bucket", pa.int32()), ("langs", pa.list_(pa.string())), ("many", pa.list_(pa.int64())), ("size", pa.int64()), ("grams", pa.binary()), ("n", pa.binary())])
_ZSTD = pa.Codec("zstd", 3)


def pack(bucket: int, rows: list[pa.RecordBatch]) -> pa.RecordBatch:
    """One block of counts that are sorted by language and n-gram; no n-gram has a line end."""
    table = pa.Table.from_batches(rows).cast(GRAMS).combine_chunks()
    lang, gram = (table.column(c).combine_chunks() for c in ("lang", "gram"))
    codes = lang.dictionary_encode()
    cuts = np.flatnonzero(np.diff(codes.indices.to_numpy(), prepend=-1))
    text = pc.binary_join(pa.LargeListArray.from_arrays(pa.array([0, len(gram)], pa.int64()), pc.fill_null(gram, "")), "\n")[0].as_buffer()
    held = [bucket], [lang.take(pa.array(cuts)).to_pylist()], [np.diff(cuts, append=len(lang)).tolist()], [text.size], [_ZSTD.compress(text).to_pybytes()], [_ZSTD.compress(table.column("n").to_numpy().tobytes()).to_pybytes()]
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(held, _BLOCK)], schema=_BLOCK)


def unpack(row: dict) -> pa.RecordBatch:
    """The counts that ``pack`` was given."""
    rows = sum(row["many"])
    gram = pc.split_pattern(pa.array([_ZSTD.decompress(row["grams"], row["size"]).to_pybytes()], pa.binary()).cast(pa.string()), "\n").flatten()
    n = np.frombuffer(_ZSTD.decompress(row["n"], 8 * rows), np.int64)
    lang = pa.array(row["langs"], pa.string()).take(pa.array(np.repeat(np.arange(len(row["many"])), row["many"])))
    return pa.RecordBatch.from_arrays([lang, pc.if_else(pc.equal(gram, ""), pa.scalar(None, pa.string()), gram), pa.array(n)], schema=GRAMS)


def counted(distinct: DataFrame, longest: int, least: int) -> DataFrame:
    """(lang, gram, words, n) of the n-grams that stand at least ``least`` times, and (lang, null, 0, n) with a language's words in all."""
    tasks = SPREAD * int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(tasks, LEAST_BUCKETS)
    by_bucket = f"SELECT (hash(lang, gram) % {buckets})::INTEGER AS bucket, * FROM (SELECT lang, gram, sum(n)::BIGINT AS n FROM grams GROUP BY lang, gram) ORDER BY bucket, lang, gram"

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
        run, size = [], 0
        for batch in batches:
            for part in grams(batch, longest):
                run.append(part)
                size += part.num_rows
                if size >= max(RUN, RUN_A_BUCKET * buckets):
                    yield run
                    run, size = [], 0
        if run:
            yield run

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in runs(batches):
            yield from blocks_of(run)

    def blocks_of(run: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        here = None

        for rows in summed(iter(run), by_bucket):
            bucket = rows.column("bucket").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(bucket)]
            for lo, hi in zip(cuts, cuts[1:]):
                if lo == hi:
                    continue
                if held and bucket[lo] != here:
                    yield pack(here, held)
                    held = []
                here = int(bucket[lo])
                held.append(rows.slice(lo, hi - lo).select(GRAMS.names))
        if held:
            yield pack(here, held)

    totals = f"SELECT lang, gram, coalesce(1 + length(gram) - length(replace(gram, ' ', '')), 0)::INTEGER AS words, sum(n)::BIGINT AS n FROM grams GROUP BY lang, gram HAVING sum(n) >= {least} OR gram IS NULL"

    def totalled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wide = pa.schema([*list(GRAMS)[:2], ("words", pa.int32()), GRAMS.field("n")])
        rows = (row for b in batches for i in range(b.num_rows) for row in b.slice(i, 1).to_pylist())
        for _, own in itertools.groupby(rows, key=lambda row: row["bucket"]):
            for got in summed(map(unpack, own), totals):
                if got.num_rows:
                    yield pa.Table.from_batches([got]).cast(wide).combine_chunks().to_batches()[0]

    blocks = distinct.mapInArrow(sums, BLOCK).repartition(tasks, "bucket").sortWithinPartitions("bucket")
    return blocks.mapInArrow(totalled, COUNTS)


def joined(words: Column, first: int | Column, size: int | Column) -> Column:
    return F.array_join(F.slice(words, first, size), " ")


def inner(words: Column, length: Column, longest: int) -> Column:
    """All phrases of two words or more that lie inside a longer one."""
    spans = [(k, i) for k in range(2, longest) for i in range(1, longest - k + 2)]
    found = [F.when(length - k + 1 >= i, F.when(length > k, joined(words, i, k))) for k, i in spans]
    return F.array_compact(F.array(*found)) if found else F.array().cast("array<string>")


def scored(counts: DataFrame, longest: int, share: tuple[int, int] | None) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of the candidates among ``counts``, a written table; those inside a longer one with ``share`` of their count are left out."""
    known = counts.where("gram IS NOT NULL")
    words, length = F.split("phrase", " "), F.col("words")
    home = F.pmod(F.hash("lang", "phrase"), F.lit(HOMES)).alias("home")
    candidates = known.where("words >= 2").select("lang", F.col("gram").alias("phrase"), "words", F.col("n").alias("a"))
    cuts = F.filter(F.sequence(F.lit(1), F.lit(longest - 1)), lambda k: k < length)
    asking = candidates.select("lang", "phrase", "a", home, F.explode(F.transform(cuts, lambda k: F.struct(k.alias("cut"), joined(words, F.lit(1), k).alias("left"), joined(words, k + 1, length - k).alias("right")))).alias("c")).select("lang", "phrase", "a", "home", "c.*")
    requests = asking.select("home", "lang", F.explode(F.array("left", "right")).alias("part")).distinct()
    answers = scratch.written(requests.join(known.select("lang", F.col("gram").alias("part"), "n"), ["lang", "part"]), "answers")
    left = answers.select("home", "lang", F.col("part").alias("left"), F.col("n").alias("l"))
    right = answers.select("home", "lang", F.col("part").alias("right"), F.col("n").alias("r"))
    told = asking.join(left, ["home", "lang", "left"]).join(right, ["home", "lang", "right"])
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    told = told.withColumn("over", (F.lit(1_000_000).cast("decimal(38,0)") * (wide("a") * wide("a")))).withColumn("score", F.expr("over div (cast(l AS decimal(19,0)) * cast(r AS decimal(19,0)))"))
    best = told.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("b"))
    if share:
        held = candidates.select("lang", F.col("a").alias("longer"), F.explode(inner(words, length, longest)).alias("phrase"))
        held = held.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
        best = best.join(held, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (share[1] * wide("longer") < share[0] * wide("a"))).drop("longer")
    totals = counts.where("gram IS NULL").groupBy("lang").agg(F.sum("n").alias("n"))
    return best.join(totals, "lang").select("lang", "phrase", "a", "b.l", "b.r", "n", "b.score")


def ranked(phrases: DataFrame, first: int) -> DataFrame:
    """``phrases`` with their rank in their language, the ``first`` of each: found among groups of it, then among what these leave."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    for groups in (HOMES * HOMES, HOMES, 1):
        group = F.pmod(F.hash("lang", "phrase"), F.lit(groups))
        place = F.row_number().over(Window.partitionBy("lang", "_group").orderBy(*order))
        phrases = phrases.withColumn("_group", group).withColumn("rank", place).where(F.col("rank") <= first).drop("_group", *([] if groups == 1 else ["rank"]))
    return phrases


def collocations(docs: DataFrame, longest: int = 3, least: int = 10, share: tuple[int, int] | None = (50, 100), first: int = 2000, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``first`` phrases of each language.

    Candidates have 2 to ``longest`` words and stand ``least`` times or more.  A phrase's
    score is floor(1000000 a a / (l r)), a its count, l and r those of the two parts of the
    cut that scores lowest; a candidate goes if a longer candidate that has it inside is as
    frequent as ``share`` of it.
    """
    if longest < 2 or least < 1:
        raise ValueError("phrases have two words or more, and stand once or more")
    scratch.lean(docs.sparkSession)
    counts = scratch.written(counted(pieces(docs, text_col, lang_col), longest, least), "counts")
    told = ranked(scored(counts, longest, share), first)
    return told.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
