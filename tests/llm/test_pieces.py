import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pulsegrid.llm import pieces
from sentencepiece import sentencepiece_model_pb2

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def bpe():
    return pieces.Model(PATH)


@pytest.fixture(scope="module")
def unigram(tmp_path_factory):
    """The public vocabulary read as a unigram model: its scores, another search."""
    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(open(PATH, "rb").read())
    proto.trainer_spec.model_type = 1
    for p in proto.pieces:
        p.score = max(p.score, -40000) / 4000 - 5 if p.type == 1 else p.score
    at = tmp_path_factory.mktemp("model") / "unigram.model"
    at.write_bytes(proto.SerializeToString())
    return pieces.Model(str(at))


TEXTS = st.lists(st.sampled_from([*"abethinors  \n", " ", "the", "ing", "tion", "    ", "▁", "é", "漢", "字", "\U0001f600", "<s>", "<0x0A>", "zz", "aaaa"]), max_size=60).map("".join)


@settings(max_examples=200, deadline=None)
@given(TEXTS, st.sampled_from([17, 23, 40]))
def test_scan_is_the_library_bpe(bpe, text, chunk):
    assert pieces.scan(bpe, text, chunk) == bpe.library.encode(text)


@settings(max_examples=100, deadline=None)
@given(TEXTS, st.sampled_from([17, 40]))
def test_scan_is_the_library_unigram(unigram, text, chunk):
    ids = pieces.scan(unigram, text, chunk)
    value = lambda x: sum(unigram.score.get(p, 0) for p in x)
    want = unigram.library.encode(text)
    name = unigram.library.id_to_piece
    assert ids == want or abs(value(map(name, ids)) - value(map(name, want))) < 1e-4 * max(1, len(ids))
    assert unigram.library.decode(ids) == unigram.library.decode(want)


def test_matrices_combine_in_any_order():
    rng = np.random.default_rng(1)
    a, b, c = (rng.normal(size=(4, 4)) for _ in range(3))
    left, right = pieces.product(pieces.product(a, b), c), pieces.product(a, pieces.product(b, c))
    assert np.allclose(left, right)


def test_table(spark, bpe):
    rng = random.Random(5)
    long = " ".join("".join(rng.choice(["tion", "er", "th", "x", "ö", "漢"]) for _ in range(rng.randint(1, 5))) for _ in range(600))
    rows = [(1, long, "a"), (1, long, "a"), (2, "short one", "b"), (3, "", "c"), (4, None, "d"), (None, "x" * 700, "e")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    done = pieces.decode(pieces.encode(df, PATH, giant=500, chunk=100), PATH)
    got = sorted(((r.id or 0), np.frombuffer(bytes(r.ids), "<u4").tolist(), r.text) for r in done.collect())
    assert got == sorted(((i or 0), bpe.library.encode(t or ""), t or "") for i, t, _ in rows)
    assert pieces.encode(df.limit(0), PATH).count() == 0


def test_registered_query_through_the_scan(spark, bpe, tmp_path, monkeypatch):
    """op4 with every text of more than 200 characters scanned, over many tasks."""
    import zlib

    from pulsegrid.llm import queries

    monkeypatch.setattr(pieces, "GIANT", 200)
    monkeypatch.setattr(pieces, "CHUNK", 90)
    monkeypatch.setattr(pieces, "CHUNKS_A_TASK", 2)
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(["nation", "erthe", "漢字", "ing", "x"]) for _ in range(rng.randint(1, 120)))) for i in range(40)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"file:{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.op4_sentencepiece(spark, f"file:{tmp_path}").collect()}
    for i, t in rows:
        ids = bpe.library.encode(t)
        assert (got[i].n_ids, got[i].ids_crc32) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
    assert sum(r.n_chunks > 1 for r in got.values()) > 20
