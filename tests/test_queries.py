"""Every registered query against its SQL at the smallest scale."""

import math
import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry
from pulsegrid import oracles, queries

DATA = "/root/testdata/sf0.001"
TABLES = [t[:-8] for t in sorted(os.listdir(DATA))] if os.path.isdir(DATA) else []


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(v):
    return round(v, 5) + 0.0 if isinstance(v, float) and not math.isnan(v) else v


@pytest.mark.skipif(not TABLES, reason="no test tables here")
@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, name):
    got = queries.QUERIES[name](spark, DATA)
    rows = Counter(tuple(plain(r[c]) for c in sorted(got.columns)) for r in got.collect())
    if name not in oracles.SQL:
        assert rows
        return
    cols = [r[0] for r in duck.execute("DESCRIBE " + oracles.SQL[name]).fetchall()]
    assert sorted(cols) == sorted(got.columns)
    picked = ", ".join(f'"{c}"' for c in sorted(cols))
    want = Counter(tuple(map(plain, r)) for r in duck.execute(f"SELECT {picked} FROM ({oracles.SQL[name]})").fetchall())
    assert rows == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["match_scores", "pick_best", "similarity_pairs"])
def test_copies_are_scored_once(spark, tmp_path, monkeypatch, name):
    """Many parts of few kinds, some without a name, some ids twice: the SQL's rows, from no more scores than pairs of kinds."""
    from pulsegrid.operators import match

    kinds = [("hot bolt", "Brand#1", "LARGE", 1), ("hot bolt", "Brand#1", "ECONOMY", 1), ("old  plate", "Brand#1", "SMALL", 1), (None, "Brand#1", "SMALL", 1), ("hot", "Brand#1", "SMALL", 2)]
    rows = [(i, *kinds[i // 84 % 5]) for i in range(840)] + [(3, *kinds[0]), (3, *kinds[2])]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string, p_size int").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    monkeypatch.setattr(match, "BUNDLE", 7, raising=False)
    met, plain_scored, plain_bundled = [], match.scored, getattr(match, "bundled", None)
    monkeypatch.setattr(match, "scored", lambda pairs: met.append(pairs.count()) or plain_scored(pairs))
    monkeypatch.setattr(match, "bundled", lambda r, key: met.append(plain_bundled(r, key).count()) or plain_bundled(r, key), raising=False)
    got = queries.QUERIES[name](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    picked = ", ".join(sorted(got.columns))
    want = Counter(tuple(map(plain, r)) for r in con.execute(f"SELECT {picked} FROM ({oracles.SQL[name]})").fetchall())
    rows = Counter(tuple(plain(r[c]) for c in sorted(got.columns)) for r in got.collect())
    assert rows == want and met and max(met) < 10_000  # pairs of parts are some 140,000


def test_every_signal_is_analysed(spark, tmp_path):
    """Tempo and key of all self-test signals are in the result, also of those whose number no label has."""
    from pulsegrid.functions.synth import SELFTEST

    spark.createDataFrame([(0, [0.5] * 64, 3), (1, [-0.25] * 64, 12)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r.clip: r for r in queries.QUERIES["wav_decode_analyze"](spark, str(tmp_path)).collect()}
    assert sorted(got) == [*range(len(SELFTEST)), 12] and got[12].n == got[3].n == 64 and got[12].bpm is None
    assert all(got[i].bpm == bpm and got[i].expected_key == name and got[i].key_right and got[i].signal_secs == 30 for i, (bpm, _, _, name, *_) in enumerate(SELFTEST))
