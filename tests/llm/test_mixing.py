import re
from collections import Counter

import pytest

pytest.importorskip("cordage.llm")
from pyspark.sql import functions as F

from cordage.llm import mixing as M


def plain_targets(sizes, weights=(3, 1, 2), share=1.5):
    """By repeated resharing until none is above twice its size."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    total, done = share * sum(sizes.values()), {}
    while True:
        left = [s for s in names if s not in done]
        rest = total - sum(done.values())
        target = {s: rest * weight[s] / sum(weight[t] for t in left) for s in left}
        above = [s for s in left if target[s] >= 2 * sizes[s]]
        if not above:
            return done | target
        done |= {s: 2.0 * sizes[s] for s in above}


def check(spark, docs):
    rows = M.taken_words(spark, docs).collect()
    plain = Counter()
    for r in docs.collect():
        plain[r.source] += len(re.findall("[^\x20\x09-\x0d]+", r.text or ""))
    targets, taken = plain_targets(plain), Counter()
    for r in rows:
        assert r.source_size == plain[r.source] and r.target == pytest.approx(targets[r.source])
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    for s, t in targets.items():
        assert abs(taken[s] - t) <= M.BLOCK_WORDS, s
    return rows


def test_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "source")
    rows = check(spark, docs)
    assert len(rows) == docs.count()
    assert sorted(rows) == sorted(M.taken_words(spark, docs.repartition(3)).collect())


def test_hot_source_and_odd_rows(spark):
    text = F.array_join(F.transform(F.sequence(F.lit(1), (F.col("id") % 90 + 1).cast("int")), lambda i: F.lit("w")), " ")
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), text.alias("text"), F.when(F.col("id") % 3 > 0, "hot").when(F.col("id") % 50 == 0, F.lit(None)).otherwise(F.concat(F.lit("é"), F.col("id") % 7)).alias("source"))
    odd = spark.createDataFrame([(1, None, "hot"), (1, "", "none"), (None, "a b", None), (None, "a b", None), (7, "x " * 5000, "hot")], "doc_id long, text string, source string")
    rows = check(spark, docs.unionByName(odd))
    assert len(rows) == 3005


def test_empty(spark):
    assert M.taken_words(spark, spark.createDataFrame([], "doc_id long, text string, source string, size int")).count() == 0
    rows = M.taken_words(spark, spark.createDataFrame([(1, "", "a"), (2, None, None)], "doc_id long, text string, source string")).collect()
    assert [(r.size, r.target, r.taken) for r in rows] == [(0, 0.0, 0)] * 2


def test_permutations(spark):
    for n in (1, 2, 7, 64, 1000, 1000003):
        df = spark.range(n).select(M.permuted(F.col("id"), F.lit(n), F.lit(3)).alias("b"))
        assert df.agg(F.countDistinct("b"), F.min("b"), F.max("b")).first()[:] == (n, 0, n - 1)


def test_shards_draw_by_share(spark, sf):
    placed, quotas, slots = M.mix(spark, spark.read.parquet(f"{sf}/documents.parquet"), shard_slots=64, block_words=8)
    assert slots.groupBy("sid", "slot").count().filter("count > 1").count() == 0
    quota = {r.sid: r.quota for r in quotas.collect()}
    assert {r.sid: r["count"] for r in slots.groupBy("sid").count().collect()} == {s: q for s, q in quota.items() if q}
    sizes = [r["count"] for r in slots.groupBy("shard").count().orderBy("shard").collect()]
    assert all(abs(n - 64) <= 2 for n in sizes[:-1])


def test_clashing_columns_come_back(spark):
    names = ["size", "copy", "turns", "_h", "_copy", "id", "hash", "row", "number", "t", "words", "whole", "sid"]
    docs = spark.createDataFrame([(i, "a b c " * (i % 7 + 1), f"s{i % 3}") for i in range(60)] + [(None, "x y", "s1"), (None, "x y", "s1"), (3, None, None)], "doc_id long, text string, source string")
    docs = docs.select("*", *[F.concat(F.lit(n), F.coalesce(F.col("doc_id"), F.lit(-1)).cast("string")).alias(n) for n in names])
    rows = M.mixed_documents(spark, docs).collect()
    assert rows and all(r[n] == f"{n}{-1 if r.doc_id is None else r.doc_id}" for r in rows for n in names)
    assert M.mixed_documents(spark, docs.limit(0)).count() == 0


def test_many_sources(spark):
    docs = spark.range(900).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 40 + 1).cast("int")).alias("text"), F.concat(F.lit("host"), (F.col("id") % 300).cast("string")).alias("source"))
    rows = M.taken_words(spark, docs).collect()
    targets = plain_targets({f"host{k}": sum(i % 40 + 1 for i in range(900) if i % 300 == k) for k in range(300)})
    assert len(rows) == 900 and all(r.target == pytest.approx(targets[r.source]) for r in rows)


def test_permutations_differ_by_key(spark):
    df = spark.range(1000).select(*[M.permuted(F.col("id"), F.lit(1000), F.lit(k)).alias(f"k{k}") for k in range(3)])
    rows = df.collect()
    steps = {(b.k0 - a.k0) % 1000 for a, b in zip(rows, rows[1:], strict=False)}
    assert len(steps) > 400 and sum(r.k0 == r.k1 for r in rows) < 20  # no stride, and another order for another key


def test_slots_stay_on_the_executors(spark, capsys):
    """The slots of the mix grow with its words: of the two sides of their draw, the sources' cells are the one that is sent; many sources are not sent either."""
    quotas = spark.createDataFrame([(1, 40_000, 0.0, 0.4), (2, 60_000, 0.4, 1.0)], "sid long, quota long, low double, high double")
    drawn = M._drawn(spark, quotas, 100_000, 2, 20, 16384)
    drawn.explain()
    assert "BuildRight" in (plan := capsys.readouterr().out) and "BuildLeft" not in plan
    assert drawn.count() == 100_000
    M._drawn(spark, quotas, 100_000, M.CELLS + 1, 20, 16384).explain()
    assert "SortMergeJoin" in capsys.readouterr().out
