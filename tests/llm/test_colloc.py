import random
import re
from collections import Counter
from fractions import Fraction

import pyarrow as pa
import pytest
from pulsegrid.llm import colloc

UPPER = str.maketrans(colloc.UPPER, colloc.LOWER)


def brute(rows, longest=3, least=10, share=(50, 100), first=2000):
    counts, total = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(UPPER)):
            words = re.findall("[^ \t]+", piece)
            total[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    counts[lang, tuple(words[i : i + k])] += 1
    candidates = {g: n for g, n in counts.items() if len(g[1]) >= 2 and n >= least}
    dropped = set()
    for (lang, g), n in candidates.items():
        for k in range(2, len(g)):
            for i in range(len(g) - k + 1):
                if share[1] * n >= share[0] * counts[lang, g[i : i + k]]:
                    dropped.add((lang, g[i : i + k]))
    out = {}
    for (lang, g), a in candidates.items():
        if (lang, g) not in dropped:
            score, k = min((Fraction(10**6 * a * a, counts[lang, g[:k]] * counts[lang, g[k:]]) // 1, k) for k in range(1, len(g)))
            out.setdefault(lang, []).append((-score, -a, " ".join(g).encode(), counts[lang, g[:k]], counts[lang, g[k:]], total[lang]))
    return sorted((lang, i + 1, x[2].decode(), -x[1], x[3], x[4], x[5], -x[0]) for lang, own in out.items() for i, x in enumerate(sorted(own)[:first]))


def texts(seed, n):
    r = random.Random(seed)
    vocabulary = ["the", "The", "of", "new", "york", "city", "état", "ünder", "x", "zé"]
    return [(r.choice(["", " ", "\t"]) + "".join(r.choice(vocabulary) + r.choice([" ", " ", "  ", "\t", ". ", ",", "\n", " ?", "\r\n"]) for _ in range(r.randrange(40))), r.choice(["en", "en", "fr", None, "und"])) for _ in range(n)]


def check(spark, rows, **how):
    docs = spark.createDataFrame([(t, lang, 1, 2) for t, lang in rows], "text string, lang string, gram int, n int").repartition(5)
    assert sorted(map(tuple, colloc.collocations(docs, **how).collect())) == brute(rows, **how)


def test_against_brute_force(spark):
    rows = texts(1, 400)
    check(spark, rows + [(None, "en"), ("", None), (" . ", "xx"), *[("the new york city of the x " * 30, "en")] * 40, ("word " * 30000, "long"), ("a b", "few")])


def test_longer_phrases_and_few_ranks(spark):
    check(spark, texts(2, 300), longest=4, least=5, share=(80, 100), first=7)
    check(spark, texts(3, 200), longest=2, least=3)


def test_empty(spark):
    check(spark, [])
    check(spark, [(None, None), ("once only", "en")])
    with pytest.raises(ValueError):
        colloc.collocations(spark.createDataFrame([], "text string, lang string"), longest=1)


def test_products_beyond_64_bits(spark):
    rows = [("en", "a b", 2, 6_000_000_001), ("en", "a", 1, 6_000_000_007), ("en", "b", 1, 90_000_000_011), ("en", None, 0, 10**12), ("en", None, 0, 5)]
    got = colloc.scored(spark.createDataFrame(rows, colloc.COUNTS), 3, (50, 100)).first()
    assert (got.score, got.l, got.r, got.n) == (10**6 * 6_000_000_001**2 // (6_000_000_007 * 90_000_000_011), 6_000_000_007, 90_000_000_011, 10**12 + 5)


def test_sums_go_out_of_core(monkeypatch):
    monkeypatch.setattr(colloc, "MEMORY", "24MB")
    batches = [pa.RecordBatch.from_arrays([pa.array(["en"] * 50_000), pa.array([f"a rather long phrase, number {i}" for i in range(lo, lo + 50_000)]), pa.array([1] * 50_000, pa.int64())], schema=colloc.GRAMS) for lo in (*range(0, 500_000, 50_000), 0)]
    got = list(colloc.summed(iter(batches), "SELECT n, count(*) AS rows FROM (SELECT gram, sum(n)::BIGINT AS n FROM grams GROUP BY gram) GROUP BY n ORDER BY n"))
    assert [tuple(r.values()) for b in got for r in b.to_pylist()] == [(1, 450_000), (2, 50_000)]


def test_blocks_hold_what_they_were_given():
    rows = pa.table({"lang": ["a\nb", "a\nb", "c", "c"], "gram": [None, "é x", "q", "r s t"], "n": [3, 1, 2**40, 7]}, schema=colloc.GRAMS).to_batches()
    block = colloc.pack(9, [rows[0].slice(0, 1), rows[0].slice(1)])
    assert block.column("bucket").to_pylist() == [9] and colloc.unpack(block.to_pylist()[0]).equals(rows[0])
