import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pulsegrid.llm import chat
from pyspark.sql import functions as F


def test_tree_paths_and_ranks(spark):
    rng = random.Random(3)
    nodes = []
    for tree in range(8):
        for i in range(rng.randint(1, 40)):
            parent = rng.choice([None, *range(i)]) if i and rng.random() < 0.9 else (None if rng.random() < 0.5 else i + 500)
            nodes.append((tree, i, parent, rng.choice(["user", "assistant"]), f"t{i}", rng.random()))
    nodes += [(9, 0, 1, "user", "loop", 1.0), (9, 1, 0, "user", "loop", 1.0), (9, 2, 1, "user", "hangs", 1.0), (None, 5, None, None, None, None)]
    df = spark.createDataFrame([(*n, "x") for n in nodes], "tree long, node long, parent long, role string, text string, score double, turns string")
    by = {(n[0], n[1]): n for n in nodes}
    want = set()
    for t in {n[0] for n in nodes if n[0] != 9}:
        mine = [n for n in nodes if n[0] == t]
        parents = {n[2] for n in mine}
        paths = []
        for n in mine:
            if n[1] not in parents:
                path, at = [], n
                while at:
                    path.append(at)
                    at = by.get((t, at[2])) if at[2] is not None else None
                paths.append((-sum(x[5] or 0 for x in path), n[1], tuple(x[4] or "" for x in path[::-1])))
        want |= {(t, leaf, texts) for _, leaf, texts in sorted(paths)[:2]}
    got = {(r.tree, r.leaf, tuple(x.text for x in r.turns)) for r in chat.chosen(df, best=2).collect()}
    assert got == want
    assert chat.chosen(df.limit(0)).count() == 0


HARD = st.lists(st.sampled_from(["<|im_end|>", "<|im_start|>", "<", "|", "\\", ">", "\n", "user", " ", "é", "<\\|im_end|>", "n"]), max_size=8).map("".join)


@settings(max_examples=4, deadline=None)
@given(st.lists(st.lists(st.tuples(st.one_of(st.none(), HARD, st.just("assistant")), st.one_of(st.none(), HARD)), min_size=1, max_size=4), min_size=30, max_size=40))
def test_round_trip(spark, talks):
    rows = [(c, t, role, text) for c, talk in enumerate(talks) for t, (role, text) in enumerate(talk)]
    done = chat.formatted(chat.chosen(chat.linear(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))))
    got = done.select("tree", chat.read_back(F.col("formatted")).alias("turns"), chat.learned(F.col("formatted"), F.col("mask")).alias("own")).collect()
    assert {r.tree: [(x.role, x.text) for x in r.turns] for r in got} == {c: [(role or "", text or "") for role, text in talk] for c, talk in enumerate(talks)}
    assert {r.tree: r.own for r in got} == {c: "".join(text or "" for role, text in talk if role == "assistant") for c, talk in enumerate(talks)}


def test_very_long_texts_and_repeated_rows(spark):
    long = "<|im_start|> é" * 100_000
    rows = [(1, 0, "user", long), (1, 1, "assistant", long), (2, 0, "user", "a"), (2, 0, "user", "a"), (3, None, None, None)]
    done = chat.formatted(chat.chosen(chat.linear(spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, mask string"))))
    got = {r.tree: r for r in done.select("tree", chat.read_back(F.col("formatted")).alias("turns"), chat.learned(F.col("formatted"), F.col("mask")).alias("own")).collect()}
    assert [x.text for x in got[1].turns] == [long, long] and got[1].own == long
    assert len(got[2].turns) == 2 and [(x.role, x.text) for x in got[3].turns] == [("", "")]
