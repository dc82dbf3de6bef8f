import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

pytest.importorskip("cordage.llm")
from cordage.llm import importance as M

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def features(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return len(words), [zlib.crc32(x.encode()) % 10000 for x in [*words, *map(" ".join, zip(words, words[1:]))]]


def plain(docs, target, least=20, percent=25):
    """By the definition, sorting all."""
    made = [(d, *features(t)) for d, t in docs]
    s, t = Counter(b for *_, f in made for b in f), Counter(b for x in target for b in features(x)[1])
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (big_s + 10000) / ((s[b] + 1) * (big_t + 10000))))
    rows = []
    for d, n, f in made:
        weight = sum(map(gain, f)) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        rows.append([d, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    eligible = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], math.inf if r[0] is None else r[0]))
    rank = {id(r): i for i, r in enumerate(eligible[: percent * len(eligible) // 100], 1)}
    return sorted(((r[0], *r[2:], rank.get(id(r))) for r in rows), key=str)


def drawn(spark, docs, target, **options):
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS run", "2 AS at", "3 AS score", "4 AS `range`").repartition(7)
    t = spark.createDataFrame([(x,) for x in target], "text string")
    return sorted((tuple(r) for r in M.resample(spark, d, t, **options).collect()), key=str)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(11)
    text = lambda n: " ".join(rng.choice("the Of and é1 x2 Y3 long word".split()) + rng.choice(["", ",", str(rng.randrange(9))]) for _ in range(n))
    docs = [(i, text(rng.randrange(0, 60))) for i in range(400)]
    docs += [(500, None), (501, ""), (502, "?!"), (503, text(30_000)), (504, "a" * 200_000), (None, text(50)), (None, text(3))]
    docs += [(600 + i, docs[9][1]) for i in range(30)]
    return docs, [text(30) for _ in range(20)] + [None, "", "the of"]


def test_equals_definition(spark, corpus):
    got, want = drawn(spark, *corpus), plain(*corpus)
    assert got == want
    ranks = sorted(r[4] for r in got if r[4])
    assert ranks == list(range(1, len(ranks) + 1)) and len(ranks) > 50


def test_small_ranges(spark, corpus):
    assert drawn(spark, *corpus, range_rows=3) == plain(*corpus)


def test_repeated_rows_and_ties(spark):
    """Rows alike in all take successive ranks, and the draw ends inside a score."""
    docs = [(1, "word " * 25)] * 8
    assert sorted(r[4] or 0 for r in drawn(spark, docs, ["word"])) == [0, 0, 0, 0, 0, 0, 1, 2]


def test_empty(spark):
    assert drawn(spark, [], ["a"]) == []
    assert drawn(spark, [(1, "w " * 30)] * 3, []) == plain([(1, "w " * 30)] * 3, [])
    assert all(r[4] is None for r in drawn(spark, [(1, "too short")] * 9, ["a b"]))


def test_tournament():
    rng = random.Random(2)
    for k in (0, 1, 2, 3, 5, 8, 33):
        runs = [sorted((rng.randrange(40), i, j) for j in range(rng.randrange(9))) for i in range(k)]
        assert list(M.Tournament(runs)) == sorted(x for r in runs for x in r)
