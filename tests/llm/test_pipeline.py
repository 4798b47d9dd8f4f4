"""The pipeline's stages on a small fixture, against plain Python."""

import random

import corpus_pipeline
import pyarrow as pa
import public_tokenizers
import pytest
from pulsegrid.llm import packing, scratch, tokens

BARE = str.maketrans("", "", " \t\n\x0b\x0c\r")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice(["ta", "ne", "ro", "si", "lu", "mi", "ka"]) for _ in range(rng.randint(1, 4)))
    rows = []
    for i in range(150):
        words = [word() for _ in range(rng.randint(12, 80))]
        if i % 4 == 0:
            words[5:5] = ["idiotic", "worthless", "pathetic"]
        rows.append((i, " ".join(words), "en", f"s{i % 3}", 0))
    clean = [r for r in rows if r[0] % 4]
    rows += [(200 + i, clean[i][1] + " " * (i % 3), "en", "s0", 0) for i in range(20)]
    rows += [(300 + i, clean[30 + i][1].replace(" ", "  ") + " extra", "en", "s1", 0) for i in range(20)]
    rows += [(400, None, None, None, None), (401, "", "en", "s2", 0), (500, "same row twice", "en", "s2", 14), (500, "same row twice", "en", "s2", 14)]
    at = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"file:{at}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(150)], "doc_id long, quality int, toxic int").write.parquet(f"file:{at}/labels.parquet")
    return f"file:{at}"


def brute_near(rows):
    kept, sets = [], {}
    for id_, text in rows:
        w = (text or "").lower().split()
        sets[id_] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] & sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    kept = [i for i in sets if find(i) == i]
    return sorted(kept)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "exact_dedup", "jaccard_join", "packing"]
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        seen.append(scratch.written(stage(spark, seen[-1], folder), name))
        assert seen[-1].columns == columns
    rows = [[(r.doc_id, r.text) for r in df.collect()] for df in seen]
    gone = {i for i, _ in rows[0]} - {i for i, _ in rows[1]}
    assert len(gone & {i for i in range(0, 150, 4)}) >= 36 and not [i for i in gone if i >= 150 or i % 4]
    best = {}
    for i, t in rows[1]:
        k = (t or "").translate(BARE)
        best[k] = min(best.get(k, (0, 1 << 60)), (-len(t or ""), i))
    assert sorted(i for i, _ in rows[2]) == sorted(i for _, i in best.values())
    assert sorted(i for i, _ in rows[3]) == brute_near(rows[2])
    assert len(rows[3]) < len(rows[2]) < len(rows[1]) < len(rows[0])
    packed = corpus_pipeline.STAGES[-1][1](spark, seen[-1], folder).collect()
    library = tokens._library(public_tokenizers.path("byte_bpe_50k.json"))
    want = {i: len(library.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in rows[3]}
    got = {}
    for r in packed:
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
    assert got == want
    again = corpus_pipeline.run(spark, folder).collect()
    assert sum(r.length for r in again) == sum(want.values()) and {r.doc_id for r in again} == set(want)


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("small")
    spark.createDataFrame([(i, 1, 0) for i in range(4)], "doc_id long, quality int, toxic int").write.parquet(f"file:{at}/labels.parquet")  # nothing is toxic
    return f"file:{at}"


def through(spark, docs, folder):
    out = [docs]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out.append(scratch.written(stage(spark, out[-1], folder), name))
    return out, corpus_pipeline.STAGES[-1][1](spark, out[-1], folder)


def test_empty_table(spark, small):
    seen, packed = through(spark, spark.createDataFrame([], SCHEMA), small)
    assert all(df.columns == seen[0].columns and df.count() == 0 for df in seen) and packed.count() == 0


def test_nulls_ties_repeats_and_clashing_columns(spark, small):
    words = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [
        (1, words), (1, words), (2, words + "  "), (2, "a text of its own that shares an id with a copy"), (None, None), (3, ""), (None, "a lone text without any id"),
        (None, "a lone text without any id"), (4, words + " extra"), (4, "kept though its id is shared with a near copy of another"), (5, long), (6, long + " end"), (7, "tie text here"), (8, "tie text here"),
    ]
    wide = spark.createDataFrame([(i, t, None, None, None, "a", "b", 1, 2, "c") for i, t in rows], SCHEMA + ", _id string, toxicity string, mark long, kept int, `_docs` string").repartition(3)
    seen, packed = through(spark, wide, small)
    assert all(df.columns == wide.columns for df in seen)
    left = sorted(((r.doc_id or 0), r.text or "") for r in seen[-1].collect())
    want = [(0, "a lone text without any id"), (2, "a text of its own that shares an id with a copy"), (4, "kept though its id is shared with a near copy of another"), (5, long), (7, "tie text here")]
    assert [x for x in left if x[1] and not x[1].startswith(words)] == want
    assert [x for x in left if x[1].startswith(words)] == [(2, words + "  ")] and sum(not t for _, t in left) == 1
    assert {(r.doc_id or 0) for r in packed.collect()} == {i for i, _ in left}
    one = [r for r in packed.collect() if r.doc_id == 7]
    assert len(one) == 1 and one[0].ids_crc32 == packing.crc32(packing.unpack(bytes(one[0].ids)))


def test_batches_of_texts_are_small(spark, small, tmp_path):
    """What a worker and its JVM hold at once of a table of whole texts, and what is encoded of it at once."""
    at = f"file:{tmp_path}/documents.parquet"
    spark.range(0, 4000, 1, 1).selectExpr("id AS doc_id", "repeat(concat('word', id, ' '), 400) AS text").write.parquet(at)
    scratch.lean(spark)
    sizes = spark.read.parquet(at).coalesce(1).mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.num_rows], "size": [b.nbytes]}) for b in batches), "n long, size long").collect()
    assert sum(r.n for r in sizes) == 4000 and max(r.size for r in sizes) < 3 << 20
    assert int(spark.conf.get("spark.sql.parquet.columnarReaderBatchSize")) <= 512
    texts = ["word " * 800] * 1000
    parts = [*tokens.runs(pa.array(texts))]
    assert [t for *_, x in parts for t in x] == texts and max(sum(map(len, x)) for *_, x in parts) <= 1 << 19
