import random
import re
from collections import Counter

import pytest

pytest.importorskip("cordage.llm")
from pyspark.sql import functions as F

from cordage.llm import decontaminate as M


def words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def plain(docs, items, threshold=0.8):
    """(doc, item) -> best similarity over all windows of the item's size, by counting shingles."""
    out, read = {}, [(d, words(text)) for d, text in docs]
    for k in range(1, 6):
        shingles = lambda w, k=k: [tuple(w[j : j + k]) for j in range(len(w) - k + 1)]
        cut = [(d, dw, shingles(dw)) for d, dw in read]
        for i, t in items:
            iw = words(t)
            if not iw or min(5, len(iw)) != k:
                continue
            want = Counter(shingles(iw))
            for d, dw, every in cut:
                held = sum(x in want for x in every)
                for s in range(max(1, len(dw) - len(iw) + 1)) if held else []:
                    have = Counter(every[s : s + len(iw) - k + 1])
                    # As many in common as the text holds of the item, at most.
                    if have and (held >= want.total() or held / (have.total() + want.total() - held) >= threshold):
                        sim = sum((have & want).values()) / sum((have | want).values())
                        if sim >= threshold:
                            out[d, i] = max(out.get((d, i), 0), sim)
    return out


def test_equals_all_windows(spark):
    rng = random.Random(3)
    fresh = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    items = [(i, " ".join(fresh(rng.choice([2, 4, 5, 9, 20, 45])))) for i in range(25)] + [(100, "a b a b a b a b a b a b"), (101, ""), (102, None), (103, "...")]
    docs = []
    for d in range(120):
        text = fresh(rng.randrange(30))
        for _ in range(rng.randrange(3)):
            part = (rng.choice(items[:26])[1] or "").split()
            for _ in range(rng.randrange(4)):
                at = rng.randrange(len(part))
                part[at : at + rng.randrange(2)] = fresh(rng.randrange(2))
                part = part or ["x"]
            text += part + fresh(rng.randrange(20))
        docs.append((d, " ".join(t.upper() + "," if rng.random() < 0.2 else t for t in text)))
    docs += [(500, None), (501, ""), (502, items[3][1]), (502, "another " + items[4][1]), (503, "a b " * 30)]
    got = {(r.doc_id, r.item_id): r.similarity for r in M.contaminated(spark, spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = plain(docs, items)
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k]) for k in want)
    assert len(want) > 40


def test_blocks_meet_within_radius(spark):
    rng = random.Random(9)
    rows = []
    for _ in range(400):
        a, b = rng.getrandbits(64), 0
        for p in rng.sample(range(64), M.RADIUS):
            b |= 1 << p
        rows.append(tuple(x - (1 << 64) if x >> 63 else x for x in (a, a ^ b)))
    df = spark.createDataFrame(rows, "a long, b long")
    assert df.filter(F.size(F.array_intersect(M.blocks(F.col("a")), M.blocks(F.col("b")))) == 0).count() == 0


def test_table(spark, sf):
    docs, items = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    got = {(r.doc_id, r.item_id) for r in M.contaminated(spark, docs, items).collect()}
    assert got == set(plain([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()]))
    kept = M.without_contaminated(spark, docs, items)
    assert kept.columns == docs.columns and kept.count() == docs.count() - len({d for d, _ in got})


def test_empty(spark):
    docs, items = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string"), spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert M.contaminated(spark, docs.limit(0), items).count() == 0 and M.contaminated(spark, docs, items.limit(0)).count() == 0
    both = docs.withColumn("item_id", F.lit(7)).withColumn("h", F.lit(1))
    assert M.contaminated(spark, both, items.withColumn("doc_id", F.lit(3))).first().item_id == 1
    null = spark.createDataFrame([(None, "a b c d e f"), (2, "x")], "doc_id long, text string")
    assert [r.doc_id for r in M.without_contaminated(spark, null, items).collect()] == [2]


def test_recall_of_the_blocks(spark):
    """Windows at 0.8 to 0.85 that share a block with their item, of those that the exact similarity would find."""
    rng = random.Random(12)
    rows = []
    for _ in range(1200):
        n = rng.randrange(30, 80)
        item = [rng.getrandbits(63) for _ in range(n)]
        lost = next(k for k in range(n, -1, -1) if (n - k) / (n + k) >= 0.8)  # as many of n as 0.8 allows
        rows.append((item, rng.sample(item, n - lost)))
    df = spark.createDataFrame(rows, "a array<long>, b array<long>").select(M.all_blocks(F.col("a")).alias("a"), M.all_blocks(F.col("b")).alias("b"))
    met = df.filter(F.size(F.array_intersect("a", "b")) > 0).count()
    assert met >= 0.995 * len(rows)


def test_clashing_columns_and_long_text(spark):
    rng = random.Random(5)
    item = " ".join(f"q{i}" for i in range(30))
    text = " ".join(f"w{rng.randrange(10**6)}" for _ in range(30000)) + " " + item
    names = ["hit", "block", "bits", "window", "length", "item_id", "span", "n", "at", "h", "_hit"]
    docs = spark.createDataFrame([(1, text), (2, "nothing here"), (3, item + " " + item)], "doc_id long, text string").select("*", *[F.lit("x").alias(n) for n in names])
    items = spark.createDataFrame([(7, item)], "item_id long, text string").withColumns({"doc_id": F.lit(9), "words": F.lit(1), "blocks": F.lit(1)})
    assert sorted((r.doc_id, r.item_id, r.first_word) for r in M.contaminated(spark, docs, items).collect()) == [(1, 7, 30000), (3, 7, 0)]
    left = M.without_contaminated(spark, docs, items)
    assert left.columns == docs.columns and [r.doc_id for r in left.collect()] == [2]
