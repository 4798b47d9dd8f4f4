import numpy as np
from hypothesis import given
from hypothesis import strategies as st
from pulsegrid.llm import dedup

BARE = str.maketrans("", "", " \t\n\x0b\x0c\r")


@given(st.sets(st.integers(0, (1 << 40) - 1), max_size=200))
def test_code_round_trip(values):
    x = np.array(sorted(values), np.int64)
    assert dedup.decode(len(x), *dedup.encode(x, 40)).tolist() == x.tolist()


def test_code_is_small():
    x = np.unique(np.random.default_rng(1).integers(0, 1 << 30, 5000))
    assert len(dedup.encode(x, 30)[1]) * 8 / len(x) < np.log2((1 << 30) / len(x)) + 2


def brute(rows):
    groups = {}
    for i, (id_, text, *_) in enumerate(rows):
        groups.setdefault((text or "").translate(BARE), []).append((-len(text or ""), id_ is None, id_ or 0, i, id_))
    return sorted(((m[4], min(g)[4], len(g)) for g in groups.values() for m in g), key=str), sum(1 for _ in groups)


def test_groups(spark):
    rows = [(1, "a b", "x"), (2, "a  b", "y"), (3, "ab", "z"), (4, None, None), (5, "", "w"), (6, " \n", "v"), (7, "other", "u"), (7, "other", "u"), (None, "lone", "t"), (None, "twin", "t"), (9, "tw in", "s"), (10, "é" * 3000 + " ", "r"), (11, "é" * 3000 + "  ", "q")]
    rows += [(100 + i, "copied text", "hot") for i in range(300)]
    got = dedup.groups(spark.createDataFrame(rows, "doc_id long, text string, kept string").repartition(5)).collect()
    want, groups = brute(rows)
    assert sorted(((r.id, r.keep_id, r.group_size) for r in got), key=str) == want
    assert sum(r.kept for r in got) == groups
    assert dedup.groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_ids_at_the_ends_of_their_range_and_long_texts(spark):
    low, high = -(1 << 63), (1 << 63) - 1
    rows = [(low, "same"), (high, "s ame"), (0, "sa me"), (low + 1, "x" * 3_000_000), (5, "x" * 3_000_000 + " ")]
    got = {r.id: (r.keep_id, r.group_size, r.kept) for r in dedup.groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    # of the two with five code points the smaller id stays
    assert got == {low: (0, 3, False), high: (0, 3, False), 0: (0, 3, True), low + 1: (5, 2, False), 5: (5, 2, True)}
    tied = dedup.groups(spark.createDataFrame([(low, "a b"), (high, "ab ")], "doc_id long, text string")).collect()
    assert {r.keep_id for r in tied} == {low}
