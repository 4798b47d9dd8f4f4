"""Fuzzy matching of requests to catalog entries, as expressions over candidate pairs.

Brackets are read by a fold over a title's characters, so nesting and missing brackets
need no Python.  A block step of ours (an inverted index of title and artist words)
finds each request's candidates at any catalog size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as k
from .. import scratch


def normalize(text: Column) -> Column:
    """Words of letters and digits in lower case, one space between; ``&`` reads "and"."""
    spelled = F.regexp_replace(F.replace(text, F.lit("&"), F.lit(" and ")), r"[^\p{IsAlphabetic}\p{N}]+", " ")
    return F.replace(F.lower(F.trim(spelled)), F.lit("̇"), F.lit(""))


def words(text: Column) -> Column:
    return F.filter(F.split(text, " "), lambda x: x != "")


def without_credit(text: Column, whole: bool) -> Column:
    """Normalised words before the first credit word; unless ``whole``, the first word always stays."""
    parts = words(normalize(text))
    marks = F.transform(parts, lambda x, i: x.isin(*k.CREDIT_WORDS) & (i >= (0 if whole else 1)))
    at = F.array_position(marks, True)
    return F.array_join(F.when(at > 0, F.slice(parts, F.lit(1), (at - 1).cast("int"))).otherwise(parts), " ")


def brackets(title: Column) -> Column:
    """(outside, inside) of a title: brackets nest and may be missing; inside, each becomes a space."""
    start = F.struct(F.lit(0).alias("depth"), F.lit("").alias("outside"), F.lit("").alias("inside"))

    def step(acc: Column, c: Column) -> Column:
        opens, closes = c.isin("(", "["), c.isin(")", "]")
        depth = F.when(opens, acc["depth"] + 1).when(closes, F.greatest(acc["depth"] - 1, F.lit(0))).otherwise(acc["depth"])
        outside = F.when(opens | closes | (acc["depth"] > 0), acc["outside"]).otherwise(F.concat(acc["outside"], c))
        inside = F.when(opens | closes, F.concat(acc["inside"], F.lit(" "))).when(acc["depth"] > 0, F.concat(acc["inside"], c)).otherwise(acc["inside"])
        return F.struct(depth.alias("depth"), outside.alias("outside"), inside.alias("inside"))

    return F.aggregate(F.split(title, ""), start, step)


def core(parts: Column) -> Column:
    return without_credit(parts["outside"], whole=False)


def qualifier(parts: Column) -> Column:
    """What tells recordings apart: no credits, neutral phrases or bare years."""
    text = without_credit(parts["inside"], whole=True)
    for phrase in k.NEUTRAL:
        text = F.replace(text, F.lit(phrase), F.lit(" "))
    return F.array_join(F.filter(words(text), lambda x: ~x.rlike("^[0-9]{4}$")), " ")


def raw_qualifier_bytes(title: Column) -> Column:
    """UTF-8 bytes of a title within brackets, these included."""
    return F.octet_length(title) - F.octet_length(brackets(title)["outside"])


def lev_ratio(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / F.when(longest > 0, longest))


def token_ratio(a: Column, b: Column) -> Column:
    x, y = F.array_distinct(words(a)), F.array_distinct(words(b))
    both = F.size(F.array_union(x, y))
    return F.when(both == 0, 1.0).otherwise(F.size(F.array_intersect(x, y)) / F.when(both > 0, both))


def similarity(a: Column, b: Column) -> Column:
    return F.when(a == b, 1.0).otherwise(0.5 * lev_ratio(a, b) + 0.5 * token_ratio(a, b))


def credited(parts: Column) -> Column:
    """Names that a title credits: after a credit word in brackets, or after one but the first word outside ("with" not counted)."""
    inside, outside = words(normalize(parts["inside"])), words(normalize(parts["outside"]))
    bare = [w for w in k.CREDIT_WORDS if w != "with"]
    at = F.array_position(F.transform(inside, lambda x: x.isin(*k.CREDIT_WORDS)), True)
    off = F.array_position(F.transform(outside, lambda x, i: x.isin(*bare) & (i >= 1)), True)
    rest = lambda a, p: F.when(p > 0, F.slice(a, (p + 1).cast("int"), F.size(a) + 1)).otherwise(F.array().cast("array<string>"))
    return F.concat(rest(inside, at), rest(outside, off))


def read_requests(rows: DataFrame) -> DataFrame:
    """``rows`` (q_artist, q_title, ...) with what ``scored`` reads of a request, once a row and not once a pair."""
    title = F.coalesce("q_title", F.lit(""))
    rows = rows.withColumn("_q", brackets(title))
    read = {"_q_core": core(F.col("_q")), "_q_qual": qualifier(F.col("_q")), "_q_act": without_credit(F.coalesce("q_artist", F.lit("")), False), "_q_plain": normalize(title)}
    return rows.withColumns(read).drop("_q")


def read_entries(rows: DataFrame) -> DataFrame:
    """``rows`` (c_artist, c_title, ...) with what ``scored`` reads of a catalog entry."""
    title = F.coalesce("c_title", F.lit(""))
    rows = rows.withColumn("_c", brackets(title))
    read = {"_c_core": core(F.col("_c")), "_c_qual": qualifier(F.col("_c")), "_c_act": without_credit(F.coalesce("c_artist", F.lit("")), False), "_c_plain": normalize(title), "_c_named": credited(F.col("_c")), "qualifier_bytes": raw_qualifier_bytes(title)}
    return rows.withColumns(read).drop("_c")


def scored(pairs: DataFrame) -> DataFrame:
    """``pairs`` (q_artist, q_title, c_artist, c_title, ...) with ``score`` and ``qualifier_bytes``; either side may have been read before."""
    rows = pairs if "_q_core" in pairs.columns else read_requests(pairs)
    rows = rows if "_c_core" in rows.columns else read_entries(rows)
    title = (1 - k.QUALIFIER_WEIGHT) * similarity(F.col("_q_core"), F.col("_c_core")) + k.QUALIFIER_WEIGHT * similarity(F.col("_q_qual"), F.col("_c_qual"))
    title = title * F.when(F.col("_q_plain") != F.col("_c_plain"), k.INEXACT).otherwise(1.0)
    asked, has, named = words(F.col("_q_act")), words(F.col("_c_act")), F.col("_c_named")
    within = (F.size(asked) > 0) & F.forall(asked, lambda t: F.array_contains(has, t))
    moved = (F.size(has) > 0) & F.forall(has, lambda t: F.array_contains(asked, t)) & F.forall(F.filter(asked, lambda t: (t != "and") & ~F.array_contains(has, t)), lambda t: F.array_contains(named, t))
    artist = similarity(F.col("_q_act"), F.col("_c_act"))
    artist = F.when(within | moved, F.greatest(artist, F.lit(k.CREDIT_FLOOR))).otherwise(artist)
    rows = rows.withColumn("score", k.TITLE_WEIGHT * title + (1 - k.TITLE_WEIGHT) * artist)
    return rows.drop("_q_core", "_q_qual", "_q_act", "_q_plain", "_c_core", "_c_qual", "_c_act", "_c_plain", "_c_named")


def pick_best(pairs: DataFrame, key: str = "query_id") -> DataFrame:
    """The best candidate of each query: score, then fewest bytes in brackets, then smallest id; a candidate needs an id and a preview."""
    rows = scored(pairs.where("c_track_id IS NOT NULL AND c_preview IS NOT NULL"))
    order = Window.partitionBy(key).orderBy(F.desc("score"), "qualifier_bytes", "c_track_id")
    best = rows.withColumn("_rank", F.row_number().over(order)).where("_rank = 1").drop("_rank")
    return best.withColumn("match_score", F.round("score", 3)).withColumn("uncertain", F.col("score") < k.MATCH_SURE)


#: Keys of one row of ``bundled``: a pair of such rows is read and scored once, and stands for the square of this in pairs at most.
BUNDLE = 256


def bundled(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` that are equal but for ``key`` as one row, numbered by ``part``, for each BUNDLE of their keys: ``held``, an array."""
    rest = [c for c in rows.columns if c != key]
    place = F.row_number().over(Window.partitionBy(*rest).orderBy(key)) - 1
    parts = rows.withColumn("part", F.floor(place / BUNDLE)).groupBy(*rest, "part")
    return parts.agg(F.collect_list(F.struct(key)).alias("held"))  # structures, as lists of plain keys leave nulls out


def spread(rows: DataFrame, *by: str) -> DataFrame:
    """``rows`` in as many partitions as a shuffle has, few bytes though they be: what a join makes of them is large."""
    session = rows.sparkSession
    tasks = max(int(session.conf.get("spark.sql.shuffle.partitions")), 4 * session.sparkContext.defaultParallelism)
    return rows.repartition(tasks, *by)


#: A word's weight is this by the number of entries that have it, in whole numbers: sums are the same in any order.
UNIT = 1 << 40


def indexed(catalog: DataFrame) -> DataFrame:
    """(words, n, ids) of the distinct word sets of a catalog: entries, and the smallest ids, as many as a search gives at most."""
    own = words(normalize(F.concat_ws(" ", "c_artist", "c_title")))
    entries = catalog.where("c_track_id IS NOT NULL").groupBy("c_track_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set(own)))).alias("words"))
    counted = entries.groupBy("words").agg(F.count("*").alias("n"))
    order = Window.partitionBy("words").orderBy("c_track_id")
    first = entries.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= k.SEARCH_LIMIT)
    ids = first.groupBy("words").agg(F.array_sort(F.collect_list("c_track_id")).alias("ids"))
    return counted.join(ids, "words")


def block(queries: DataFrame, catalog: DataFrame, limit: int = k.SEARCH_LIMIT) -> DataFrame:
    """Up to ``limit`` (k.SEARCH_LIMIT at most) candidates a query: those sharing most distinct words of artist and title, then by weight, then by id.

    ``queries`` (query_id, q_artist, q_title), ``catalog`` (c_track_id, c_artist, c_title,
    c_preview).  A word's weight falls with the number of entries that have it.

    Queries and entries with the same words are one.  A query looks its words up rarest
    first, in rounds of one, one, two, four words, ...  After r of its m words, an entry not
    met yet shares at most m - r words, and if so many, then just the others; as soon as
    ``limit`` entries are above that, the query is done.  So a word that many entries have
    is looked up only by queries that no rarer word decides.
    """
    known = scratch.written(indexed(catalog), "catalog")
    weighed = known.select("n", F.explode("words").alias("word")).groupBy("word").agg(F.sum("n").alias("df"))
    weighed = weighed.select("word", "df", F.expr(f"{UNIT} div df").alias("weight"))
    named = queries.select("query_id", F.array_sort(F.array_distinct(words(normalize(F.concat_ws(" ", "q_artist", "q_title"))))).alias("asked"))
    named = scratch.written(named, "named")
    asked = named.select("asked").distinct().select("asked", F.explode("asked").alias("word")).join(weighed, "word")
    asked = asked.groupBy("asked").agg(F.array_sort(F.collect_list(F.struct("df", "word", "weight"))).alias("ws"))
    active = scratch.written(asked, "asked")
    posted = known.select(F.explode("words").alias("word"), "words", "n", F.element_at("ids", 1).alias("least"))
    best, done, step = None, 0, 1
    while not active.isEmpty():
        near = active.select("asked", "ws", F.posexplode(F.slice("ws", done + 1, step)).alias("_at", "_w")).select("asked", "ws", (F.col("_at") + done).alias("at"), "_w.word")
        hit = near.join(posted, "word").where(~F.exists(F.slice("ws", F.lit(1), F.col("at").cast("int")), lambda w: F.array_contains("words", w["word"])))
        both = F.filter("ws", lambda w: F.array_contains("words", w["word"]))
        hit = hit.select("asked", "words", "n", "least", F.size(both).alias("shared"), F.aggregate(both, F.lit(0).cast("long"), lambda a, w: a + w["weight"]).alias("weight"))
        order = Window.partitionBy("asked").orderBy(F.desc("shared"), F.desc("weight"), "least")
        found = (hit if best is None else best.select(*hit.columns).unionByName(hit)).withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= limit)
        best = scratch.written(found.withColumn("upto", F.sum("n").over(order)), "best")
        done, step = done + step, step if done == 0 else done + step
        full = best.where(F.col("upto") >= limit).groupBy("asked").agg(F.max(F.struct("shared", "weight")).alias("last"))
        left = F.greatest(F.size("ws") - done, F.lit(0))
        rest = F.aggregate(F.slice("ws", done + 1, 1 << 20), F.lit(0).cast("long"), lambda a, w: a + w["weight"])
        settled = (left == 0) | F.coalesce((F.col("last.shared") > left) | ((F.col("last.shared") == left) & (F.col("last.weight") > rest)), F.lit(False))
        active = scratch.written(active.join(full, "asked", "left").where(~settled).select("asked", "ws"), "asked")
    if best is None:
        best = known.limit(0).select(F.col("words").alias("asked"), "words", F.lit(0).alias("shared"), F.lit(0).cast("long").alias("weight"))
    rows = best.join(known.select("words", "ids"), "words").select("asked", "shared", "weight", F.explode("ids").alias("c_track_id"))
    order = Window.partitionBy("asked").orderBy(F.desc("shared"), F.desc("weight"), "c_track_id")
    top = rows.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= limit).select("asked", "c_track_id")
    return named.join(top, "asked").select("query_id", "c_track_id").join(read_requests(queries), "query_id").join(read_entries(catalog), "c_track_id")


def lookup(queries: DataFrame, catalog: DataFrame) -> DataFrame:
    """Requests by track id: the entry with just that id (of several the greatest row); ``not_found`` without one, ``no_preview`` without its preview."""
    rest = [c for c in catalog.columns if c != "c_track_id"]
    one = catalog.groupBy("c_track_id").agg(F.max(F.struct(*rest)).alias("_one")).select("c_track_id", *[F.col(f"_one.{c}").alias(c) for c in rest])
    found = queries.join(one.withColumn("_there", F.lit(True)), queries["track_id"] == one["c_track_id"], "left")
    kind = F.when(F.col("_there").isNull(), "not_found").when(F.col("c_preview").isNull(), "no_preview")
    return found.withColumn("error", kind.cast("string")).withColumn("match_score", F.when(kind.isNull(), 1.0)).drop("_there")
