import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("cordage.llm")
from cordage.llm import near_copies
from cordage.llm import odd_sketch as M
from cordage.llm.common import cleared
from cordage.llm.components import components

WORDS = re.compile("[^\x20\x09-\x0d]+")


def plain_set(text):
    words = WORDS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + 4]) for i in range(max(1, len(words) - 3))} if words else set()


def plain(docs):
    sets, root = [plain_set(t) for _, t in docs], list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                root[find(i)] = find(j)
    groups = {}
    for i in range(len(docs)):
        groups.setdefault(find(i), []).append(docs[i][0])
    least = {r: min((d for d in g if d is not None), default=None) for r, g in groups.items()}
    return sorted(((d, len(s), least[find(i)], d == least[find(i)]) for i, ((d, _), s) in enumerate(zip(docs, sets))), key=str)


def linked(spark, docs):
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS cls", "2 AS row", "3 AS least", "4 AS key")
    return sorted((tuple(r) for r in M.near_duplicates(spark, df).collect()), key=str)


def changed(words, share, rng):
    """A copy of which so many words in a row are others: shingles change by as much, and three more."""
    words = list(words)
    at, n = rng.randrange(max(1, int(len(words) * (1 - share)))), int(len(words) * share)
    words[at : at + n] = [f"n{rng.random()}" for _ in range(n)]
    return words


def test_equals_all_pairs(spark):
    rng = random.Random(4)
    docs = []
    for _ in range(25):
        words = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice([1, 3, 4, 9, 40, 120, 400]))]
        for _ in range(rng.randrange(1, 9)):
            docs.append((len(docs), rng.choice([" ", "\t", " \n"]).join(words)))
            words = changed(words, rng.choice([0.0, 0.03, 0.08, 0.1, 0.12]), rng)
    docs += [(900, None), (901, ""), (902, "  "), (903, "The same Four words"), (904, "the same four words"), (905, "two words"), (906, "Two words")]
    docs += [(None, "a text that has no id but is long enough to count"), (None, docs[5][1]), (3, docs[50][1]), (3, docs[3][1]), (907, "x y z a " * 30_000), (908, "x y z a " * 30_000)]
    rng.shuffle(docs)
    assert linked(spark, docs) == plain(docs)


def test_frequent_passage(spark):
    """Texts that share two thirds or nine tenths of their words with many others; copies among them are found."""
    rng = random.Random(8)
    passage = [f"p{i}" for i in range(90)]
    texts = [" ".join(passage + [f"q{rng.random()}" for _ in range(rng.choice([18, 20, 24, 40]))]) for _ in range(150)]
    texts += [t + " more" for t in texts[:30:3]]
    docs = list(enumerate(texts))
    assert linked(spark, docs) == plain(docs)


def test_prefix_filter_makes_few_rows_of_a_frequent_passage(spark):
    """Texts alike in a passage alone meet in none of its shingles, ten times as many make ten times the rows at most."""
    found = []
    for n in (60, 600):
        sets = [(i, [*range(80), *range(1000 * (i + 1), 1000 * (i + 1) + 20)]) for i in range(n)] + [(n + i, [*range(80), *range(1000 * (i + 1), 1000 * (i + 1) + 20), 7_000_000 + i]) for i in range(n // 10)]
        frame = spark.createDataFrame(sets, "cls long, grams array<long>")
        classes = frame.select("cls", F.col("cls").alias("root"), F.lit(True).alias("apart"))
        pairs = sorted(tuple(r) for r in near_copies._by_prefix(classes, frame, 0.8).collect())
        assert pairs == [(n + i, i) for i in range(n // 10)]
        found.append(len(pairs))
    assert found == [6, 60]


def test_empty(spark):
    assert linked(spark, []) == [] and linked(spark, [(1, None), (2, " ")]) == [(1, 0, 1, True), (2, 0, 2, True)]


def test_sketch_is_the_parity_of_its_samples():
    factors, terms = M.draws(200)
    samples = M.minima(np.arange(50, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), factors, terms)
    assert sum(int(w).bit_count() for w in M.sketch(samples)) % 2 == 0  # as many bits as samples, less pairs
    other = samples.copy()
    other[7] += 1
    assert sum(int(a ^ b).bit_count() for a, b in zip(M.sketch(samples), M.sketch(other))) in (0, 2)


def test_estimates(spark):
    """Unbiased near 0.8 and above; none of 4,000 pairs at 0.8 comes near the least estimate."""
    rng = np.random.default_rng(6)
    factors, terms = M.draws(M.BANDS * M.ROWS)
    for s, spread in ((0.8, 0.06), (0.9, 0.04), (0.98, 0.02)):
        got = []
        for _ in range(4000 if s == 0.8 else 300):
            common, n = int(900 * s), 900
            grams = rng.integers(0, 1 << 63, n + (n - common), np.uint64)
            rest = (n - common) // 2
            a, b = grams[: common + rest], np.concatenate((grams[:common], grams[common + rest : n]))
            x, y = (M.sketch(M.minima(g, factors, terms)) for g in (a, b))
            m = sum(int(v).bit_count() for v in x ^ y)
            got.append(1 + M.BITS / (4 * M.BANDS * M.ROWS) * math.log(1 - 2 * m / M.BITS))
        assert abs(np.mean(got) - s) < 0.01 and np.std(got) < spread and (s > 0.8 or min(got) > M.LEAST_ESTIMATE)
    frame = spark.createDataFrame([(0,), (70,), (256,), (400,)], "m int").select(M.estimate(F.col("m"), 200))
    assert [round(r[0], 6) for r in frame.collect()] == [1.0, round(1 + 0.64 * math.log(1 - 140 / 512), 6), 0.0, 0.0]


def test_ends_where_nothing_is_apart(spark):
    """Where every link is one to a band's hub, no task of the prefix filter runs; ids that are null, 0 or repeated are told apart when texts are read again."""
    rng = random.Random(4)
    texts = [" ".join(f"w{rng.randrange(10**7)}" for _ in range(60)) for _ in range(12)]
    docs = [(i + 1, t) for i, t in enumerate(texts)] + [(i + 101, t + " more") for i, t in enumerate(texts[:6])] + [(None, texts[7]), (0, texts[7]), (0, texts[7]), (None, texts[8] + " end"), (0, texts[8])]
    with cleared(spark) as written:
        assert linked(spark, docs) == plain(docs)
        tables = [path.rsplit("/", 1)[1].rsplit("-", 1)[0] for path in written]
    assert "members" in tables and "question" not in tables


def test_components_shuffle_little(spark):
    """A round of components computes each of its tables once."""
    stars = [(100 * k, 100 * k + i) for k in range(8) for i in range(1, 12)] + [(100 * k, 100 * k + 105) for k in range(7)]
    context, names = spark.sparkContext, ["spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold"]
    before = [spark.conf.get(name) for name in names]
    for name, value in zip(names, ["false", "-1"]):
        spark.conf.set(name, value)
    context.setJobGroup("components", "components")
    try:
        with cleared(spark) as written:
            found = components(spark.createDataFrame(stars, "u long, v long"))
            status = context.statusTracker()
            stages = {s for j in status.getJobIdsForGroup("components") for s in status.getJobInfo(j).stageIds}
            ran = sum(1 for s in stages if (i := status.getStageInfo(s)) and i.numCompletedTasks)
            rounds = sum("/edges-" in path for path in written) - 1
            assert sorted(map(tuple, found.collect())) == sorted({(v, 0) for e in stars for v in e if v})
    finally:
        for name, value in zip(names, before):
            spark.conf.set(name, value)
        context.setLocalProperty("spark.jobGroup.id", None)
    assert rounds and ran <= 8 + 13 * rounds, (ran, rounds)
