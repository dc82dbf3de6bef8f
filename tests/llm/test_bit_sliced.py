import math
import random
import re
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("cordage.llm")
from cordage.llm import bit_sliced as M

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, top=10):
    """Every score of every pair, by the definition."""
    held = [(d, Counter(terms(t))) for d, t in docs]
    sizes = [sum(c.values()) for _, c in held]
    n, words = sum(s > 0 for s in sizes), sum(sizes)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in dict.fromkeys(items):
        rows = []
        for (d, c), size in zip(held, sizes):
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * (25 + 75 * size * n // words))) for t in terms(text) if c[t])
            if score > 0:
                rows.append((-score, math.inf if d is None else d, d))
        out += [(item, r, d, -s) for r, (s, _, d) in enumerate(sorted(rows, key=lambda x: x[:2])[:top], 1)]
    return sorted(out, key=str)


def ranked(spark, docs, items, **options):
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS item", "2 AS rank", "3 AS score")
    i = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS item", "2 AS block", "3 AS before")
    return sorted((tuple(r) for r in M.rank(spark, d, i, **options).select("item_id", "rank", "doc_id", "score").collect()), key=str)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    words = [f"{rng.choice('aBéZ')}{i}" for i in range(60)]
    text = lambda n: " ".join(rng.choices(words, [1 / (i + 1) for i in range(60)], k=n))
    docs = [(i, text(rng.randrange(0, 60))) for i in range(300)]
    docs += [(400 + i, docs[7][1]) for i in range(40)]  # ties beyond the places to give
    docs += [(500, None), (501, ""), (502, " -- "), (None, docs[3][1]), (7, docs[9][1]), (503, text(20_000)), (504, "b0 " * 5000)]
    items = [(i, text(rng.randrange(1, 30))) for i in range(40)] + [(50, docs[7][1]), (51, None), (52, "..."), (53, "never seen"), (54, "B0 b0 B0 " * 9), (None, "B0 é9"), (1, "another text a4"), (2, text(3000)), (50, docs[7][1])]
    rng.shuffle(docs)
    return docs, items


def test_equals_definition(spark, corpus):
    want = plain(*corpus)
    assert ranked(spark, *corpus) == want and len(want) > 300


def test_small_segments_and_blocks(spark, corpus):
    """Segments of few documents or postings and blocks of one item give the same rows."""
    docs, items = corpus
    want = plain(docs, items, 3)
    assert ranked(spark, docs, items, top=3, segment_docs=5, block_words=40) == want
    assert ranked(spark, docs, items[:20], top=3, postings=30) == plain(docs, items[:20], 3)


def test_empty(spark, corpus):
    docs, items = corpus
    assert ranked(spark, [], items) == [] and ranked(spark, docs, []) == [] and ranked(spark, [(1, None)], items) == []


def test_slices_hold_the_impacts_and_add_with_carries():
    rng = np.random.default_rng(1)
    table = rng.integers(0, 1 << 34, (7, 130)) * (rng.random((7, 130)) < 0.4)  # of 7 terms and 130 documents
    t, s = np.nonzero(table)
    segment = M.Segment(list(range(130)), t, s, table[t, s])
    laid = segment.layout(np.arange(7))
    bits = np.unpackbits(laid[:, :7].astype("<u8").view(np.uint8), axis=2, bitorder="little")[:, :, :130]
    assert ((bits.astype(np.int64) << np.arange(segment.height)[:, None, None]).sum(axis=0) == table).all()
    total = segment.scores([(0, np.array([0, 3])), (0, np.array([1, -1])), (2, np.array([6, 6]))], 2)
    bits = np.unpackbits(total.astype("<u8").view(np.uint8), axis=2, bitorder="little")[:, :, :130]
    got = (bits.astype(np.int64) << np.arange(len(total))[:, None, None]).sum(axis=0)
    assert (got == [table[0] + table[1] + 4 * table[6], table[3] + 4 * table[6]]).all()
    want = sorted(((-v, d) for d, v in enumerate(got[1].tolist()) if v))[:10]
    assert sorted((-v, d) for q, d, v in segment.best(total, 10) if q == 1) == want
