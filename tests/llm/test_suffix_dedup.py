import random
from collections import defaultdict

import numpy as np
import pytest

pytest.importorskip("cordage.llm")
from cordage.llm import suffix_dedup as M


def plain(rows, passage):
    """doc_id -> (repeated words, later words) from the definition, over all windows."""
    first, places = {}, defaultdict(list)
    texts = sorted((-1 if d is None else d, (t or "").split()) for d, t in rows)
    for d, w in texts:
        for s in range(len(w) - passage + 1):
            key = tuple(w[s : s + passage])
            first.setdefault(key, (d, s))
            places[key].append((d, s))
    out = defaultdict(lambda: (set(), set()))
    for key, at in places.items():
        if len(at) > 1:
            for d, s in at:
                out[d][0].update(range(s, s + passage))
                if (d, s) != first[key]:
                    out[d][1].update(range(s, s + passage))
    return {d if d >= 0 else None: v for d, v in out.items()}


def words(text):
    return {i for s in text.split(",") if s for i in range(*map(int, s.split(":")))}


def compare(spark, rows, **options):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (words(r.spans), words(r.later)) for r in M.repeated_passages(spark, df, **options).collect()}
    assert got == plain(rows, options.get("passage", M.PASSAGE))


def test_hashes_by_doubling():
    values = np.arange(1, 200, dtype=np.uint64) ** np.uint64(3)
    for length in (1, 2, 7, 10, 41, 50):
        h = M._joined(values, length)
        assert len(h) == 200 - length and len(set(h.tolist())) == len(h)
        again = M._joined(np.concatenate([np.uint64([9, 9]), values]), length)
        assert (again[2:] == h).all()
        assert M._slid(values[::-1].copy(), length, np.minimum).tolist() == [int(values[::-1][i : i + length].min()) for i in range(200 - length)]


def test_equals_definition_small(spark):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    pool = [[rng.choice(vocabulary) for _ in range(rng.randrange(8, 40))] for _ in range(12)]
    for d in range(80):
        text = []
        for _ in range(rng.randrange(6)):
            part = list(rng.choice(pool)) if rng.random() < 0.6 else [rng.choice(vocabulary) for _ in range(rng.randrange(30))]
            if rng.random() < 0.3 and part:
                part[rng.randrange(len(part))] = "edited"
            text += part[rng.randrange(3) :]
        rows.append((d, " ".join(text)))
    rows += [(200, rows[5][1]), (201, rows[5][1]), (202, "a b " * 60), (203, "same " * 100), (204, None), (205, ""), (None, rows[7][1])]
    compare(spark, rows, passage=12, gram=4)


def test_planted_in_production_size(spark):
    rng = random.Random(8)
    fresh = lambda n: [f"x{rng.random()}" for _ in range(n)]
    shared, short = fresh(61), fresh(49)
    rows = [(d, " ".join(fresh(rng.randrange(60)) + (shared if d % 3 == 0 else short) + fresh(rng.randrange(60)))) for d in range(30)]
    compare(spark, rows)
    df = spark.createDataFrame([(d, t, "n") for d, t in rows], "doc_id long, text string, key string")
    assert {r.doc_id for r in M.repeated_passages(spark, df).collect()} == set(range(0, 30, 3))


def test_empty(spark):
    assert M.repeated_passages(spark, spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_copied_periodic_text(spark):
    line = [f"p{i}" for i in range(12)]
    rows = [(1, " ".join(line * 12)), (2, " ".join(line * 12))]
    compare(spark, rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.later_words for r in M.repeated_passages(spark, df).collect()} == {1: 132, 2: 144}


def test_neighbours_across_ranges(spark):
    """Keys of one suffix to hundreds, dealt to more ranges than some have suffixes: those that stand twice are found, and no other."""
    rng = np.random.default_rng(6)
    rows = []
    for key in range(60):
        for doc in range(int(rng.choice([1, 1, 1, 2, 3, 300 if key == 7 else 1]))):
            rows.append((key - 30, bytes([key // 8, key]) * 10, doc, 2 if key == 11 else 1))
    total = {}
    for key, _, _, n in rows:
        total[key] = total.get(key, 0) + n
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for parts in ("1", "3", "23"):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            kept = M.staged(spark.createDataFrame(rows, "key long, suffix binary, doc long, n long"), "kept")
            got = sorted((r.key, r.doc) for r in M.shared_suffixes(spark, kept).collect())
            assert got == sorted((k, d) for k, _, d, _ in rows if total[k] > 1)
            assert M.shared_suffixes(spark, kept.limit(0)).count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
