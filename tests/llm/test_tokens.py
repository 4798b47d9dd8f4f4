import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pulsegrid.llm import tokens

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def counter():
    return tokens.Counter(WORD, tokens.whole_tokens(WORD))


@pytest.fixture(scope="module")
def encoder():
    return tokens.Encoder(BYTE)


def count(text):
    return len(tokens._library(WORD).encode(text, add_special_tokens=False).ids)


def ids(text):
    return tokens._library(BYTE).encode(text, add_special_tokens=False).ids


PROVEN = [chr(c) for c in [*range(0x130), *range(0x131, 0x180), *range(0x2010, 0x2028), *range(0x2030, 0x203B), 0x20AC, 0x2122]]


@pytest.mark.parametrize("frame", ["a{}b", " {} ", "1{}{}2", "'{}s", "  {}", "{}\n{}", "!{}'s", "{}"])
def test_every_proven_code_point(counter, encoder, frame):
    texts = [frame.replace("{}", c) for c in PROVEN]
    assert not any(tokens.UNPROVEN.search(t) for t in texts)
    assert counter.count(texts).tolist() == [count(t) for t in texts]
    got = [list(memoryview(x).cast("H")) for x in encoder.encode(texts)]
    assert got == [ids(t) for t in texts]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from([*"abeIZ'st lld  \n\t\r 19.,!?éÉßİ’—|<>", "<|endoftext|>", "<|startoftext|>", "漢", "e\u0301", "Σ", "\U0001f600"]), max_size=60).map("".join))
def test_any_text(counter, encoder, text):
    assert counter.count([text])[0] == count(text)
    assert list(memoryview(encoder.encode([text])[0]).cast("H")) == ids(text)


def test_table_emptied_between(monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED", 3)
    texts = ["zxqv blorf grumpf", "zxqv blorf again", None, "", "grumpf snarf"]
    assert tokens.Counter(WORD, ["again"]).count(texts).tolist() == [count(t or "") for t in texts]
    assert [list(memoryview(x).cast("H")) for x in tokens.Encoder(BYTE).encode(texts)] == [ids(t or "") for t in texts]


def test_counts_of_a_table(spark):
    rows = [(1, "Hello world", "x"), (1, "Hello world", "x"), (2, None, None), (3, "", "y"), (None, "a <|endoftext|> b", "z"), (5, "wordy " * 5000, "n_tokens")]
    got = tokens.counts(spark.createDataFrame(rows, "doc_id long, text string, n_tokens string"), WORD).collect()
    assert sorted((r.id or 0, r.n_bytes, r.n_tokens) for r in got) == sorted((a or 0, len((t or "").encode()), count(t or "")) for a, t, _ in rows)
    assert tokens.counts(spark.createDataFrame([], "doc_id long, text string"), WORD).count() == 0
