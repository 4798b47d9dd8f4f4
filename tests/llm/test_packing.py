from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pulsegrid.llm import packing, tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")


def served(stream):
    """(queue, quantum) in the order of a plain deficit loop: visit each queue in turn, add its gain, serve while it holds a quantum."""
    deficit, done, out = stream.first.tolist(), [0] * len(stream.sizes), []
    whole, quanta = int(stream.weights.sum()), [-(-int(n) // packing.QUANTUM) for n in stream.sizes]
    while any(d < n for d, n in zip(done, quanta)):
        for q, w in enumerate(stream.weights.tolist()):
            deficit[q] += w * packing.WINDOW // packing.QUANTUM
            while deficit[q] >= whole and done[q] < quanta[q]:
                deficit[q] -= whole
                out.append((q, done[q]))
                done[q] += 1
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 9000), st.integers(1, 64)), min_size=1, max_size=9))
def test_closed_form_is_the_deficit_loop(queues):
    sizes, shares = (np.array(x) for x in zip(*queues))
    stream = packing.Stream.of(shares.astype(float), sizes)
    order = served(stream)
    at = 0
    for q, i in order:
        assert stream.place(np.array([i]), np.array([q]))[0] == at
        at += min(packing.QUANTUM, int(sizes[q]) - i * packing.QUANTUM)
    assert at == sizes.sum()


def test_deficits_are_carried_over_windows():
    """No queue is ever more than a quantum from its target, however long the stream."""
    shares = np.array([0.31, 0.27, 0.2, 0.1, 0.07, 0.03, 0.02])
    stream = packing.Stream.of(shares, np.full(7, 1 << 30))
    quanta = np.arange(4000)
    turn = {}
    for q in range(7):
        for at in stream.place(quanta, np.full(4000, q)).tolist():
            turn[at] = q
    order = [turn[k] for k in sorted(turn)][:6000]
    whole = int(stream.weights.sum())
    count = np.zeros(7)
    for at, q in enumerate(order, 1):
        count[q] += 1
        assert (abs(count - at * stream.weights / whole) < 4).all()
    assert abs(count / 6000 - shares).max() < 0.001


def test_a_tree_of_streams_gives_every_token_one_place():
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 2000, 700)
    levels = packing.streams(sizes.astype(float), sizes)
    assert [len(x) for x in levels] == [3, 1]
    total = int(sizes.sum())
    text, first, length, seq, offset = packing.cut(np.zeros(700, np.int64), sizes, np.arange(700), levels, total)
    at = packing.begin(seq, packing.edges(total)) + offset
    order = np.argsort(at)
    assert at[order[0]] == 0 and (at[order][1:] == (at + length)[order][:-1]).all() and length.sum() == total
    for t in range(700):
        own = text == t
        assert (np.sort(first[own])[1:] == np.sort((first + length)[own])[:-1]).all() and length[own].sum() == sizes[t]


def test_many_sources_keep_their_names_and_targets(spark):
    rows = [(i, "a b c d " * 40, f"s{i % 300:03}") for i in range(1200)]
    targets = {f"s{i:03}": 3.0 if i < 150 else 1.0 for i in range(300)}
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string, source string"), PATH, targets=targets).collect()
    assert {r.source for r in got} == {s for *_, s in rows} and all(int(r.source[1:]) == r.id % 300 for r in got)
    half = max(r.sequence_id for r in got) // 2
    early = [r for r in got if r.sequence_id < half]
    assert 0.7 < sum(r.length for r in early if r.source < "s150") / sum(r.length for r in early) < 0.8
    with pytest.raises(ValueError, match="targets"):
        packing.pack(spark.createDataFrame(rows[:3], "doc_id long, text string, source string"), PATH, targets={"other": 1.0})


def test_whole_texts_gapless_sequences_and_mixture(spark):
    rows = [(i, "word%d and more of it " % i * (20 + i % 90), f"s{min(i % 6, 2)}") for i in range(240)]
    rows += [(900, None, None), (901, "", ""), (902, "long text " * 9000, "s2"), (902, "same id", "s2"), (None, "<|endoftext|> no id", "s1")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, source string, ids string").repartition(4)
    got = packing.pack(df, PATH).collect()
    library = tokens._library(PATH)
    want = Counter(tuple(library.encode(t or "", add_special_tokens=False).ids) + (1,) for _, t, _ in rows)
    docs, sequences = {}, {}
    for r in got:
        docs.setdefault((r.id, r.doc_tokens), []).append((r.start, packing.unpack(bytes(r.ids))))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length, r.source))
    texts = Counter(tuple(x for _, ids in sorted(parts) for x in ids) for parts in docs.values())
    assert texts == want
    total = sum(n * len(ids) for ids, n in want.items())
    for parts in sequences.values():
        at = 0
        for offset, length, _ in sorted(parts):
            assert offset == at
            at += length
        assert at == packing.WINDOW or at & (at - 1) == 0
    assert sum(length for p in sequences.values() for _, length, _ in p) == total and sorted(sequences) == list(range(len(sequences)))
    share = lambda p, s: sum(n for _, n, q in p if q == s) / sum(n for _, n, _ in p)
    whole = [x for p in sequences.values() for x in p]
    for p in sequences.values():
        if sum(n for _, n, _ in p) == packing.WINDOW:
            assert all(abs(share(p, s) - share(whole, s)) < 2 * packing.QUANTUM / packing.WINDOW for s in ("s0", "s1", "s2"))


def test_targets_and_nothing(spark):
    df = spark.createDataFrame([(i, "a b c d " * 200, "x" if i % 2 else "y") for i in range(40)], "doc_id long, text string, source string")
    got = packing.pack(df, PATH, targets={"x": 0.75, "y": 0.25}).where("sequence_id = 2").groupBy("source").sum("length").collect()
    assert {r[0]: r[1] for r in got} == {"x": 1536, "y": 512}
    assert packing.pack(df.limit(0), PATH).count() == 0
