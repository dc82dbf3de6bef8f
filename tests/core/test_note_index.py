"""The index on disk against the full search of every text, its upserts against a new build, and its commits."""

import random
import uuid

import pytest
from pyspark.sql import functions as F

from cordage.operators import note_index as N
from cordage.operators import search as S
from cordage.plans.iterate import shared_folder
from cordage.plans.versions import Conflict, commit, current, manifest

COLUMNS = "id string, type string, title string, body string"


def place(spark):
    return f"{shared_folder(spark)}/test-notes-{uuid.uuid4().hex}"


def made(spark, n, seed=1, least=3, most=60):
    r = random.Random(seed)
    word = lambda: f"w{min(int(r.paretovariate(0.7)), 400)}"
    rows = [(f"n{i}", r.choice("ab"), " ".join(word() for _ in range(3)), " ".join(word() for _ in range(r.randint(least, most)))) for i in range(n)]
    return spark.createDataFrame(rows, COLUMNS)


def scores(df):
    return {r.id: round(r.score, 9) for r in df.collect()}


@pytest.fixture(scope="module")
def index(spark):
    notes, path = made(spark, 3000).persist(), place(spark)
    N.upsert(spark, path, notes, buckets=8)
    return notes, path


@pytest.mark.parametrize("query, every", [("w3 w40", False), ("w3 w40", True), ("w1", False), ("nowhere", False), ("w7 W7", False)])
def test_ranking_is_that_of_all_texts(spark, index, query, every):
    notes, path = index
    words = N.parsed(query, "and" if every else "or")
    assert scores(N.ranking(spark, path, words)) == scores(S.bm25(notes, query.split(), require_all=every))
    assert scores(N.ranking(spark, path, words, kind="a")) == scores(S.bm25(notes, query.split(), kind="a", require_all=every))


@pytest.mark.parametrize("query, mode", [("w3 w40", "or"), ("w2 w5 w9", "and"), ("w1", "or"), ("w39*", "or"), ("w300 w11", "or")])
def test_best_are_the_first_of_the_ranking(spark, index, query, mode):
    _, path = index
    words = N.parsed(query, mode)
    whole = N.ranking(spark, path, words).orderBy("score", "id").limit(20).collect()
    found = N.best(spark, path, words)
    assert [(r.id, round(r.score, 9)) for r in found.rows.orderBy("rank").collect()] == [(r.id, round(r.score, 9)) for r in whole]


def test_best_reads_fewer_blocks(spark):
    path = place(spark)
    N.upsert(spark, path, made(spark, 20000, seed=5, most=600), buckets=4)
    found = N.best(spark, path, N.parsed("w3"), limit=5)
    assert found.rows.count() == 5 and found.blocks > 60 and found.blocks_read < found.blocks / 2


def test_beginnings(spark, index):
    notes, path = index
    held = {r.id for r in notes.filter(F.concat_ws(" ", "title", "body").rlike(r"\bw39\w*")).collect()}
    assert set(scores(N.ranking(spark, path, N.parsed("w39*")))) == held and held
    assert len(scores(N.ranking(spark, path, N.parsed("w*")))) == notes.count()


def test_phrase(spark, index):
    notes, path = index
    held = {r.id for r in S.phrase_search(notes, ["w3", "w1"]).collect()}
    assert set(scores(N.ranking(spark, path, N.parsed("w3 w1", "phrase")))) == held and held


def test_only_buckets_of_the_words_are_read(spark, index):
    _, path = index
    plan = N.ranking(spark, path, N.parsed("w3"))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "xxhash64" not in plan
    assert "PushedFilters: [IsNotNull(term), EqualTo(term,w3)" in plan


def test_upserts_equal_a_new_build(spark):
    notes, path = made(spark, 400, seed=2), place(spark)
    first = N.upsert(spark, path, notes, buckets=8)
    changed = made(spark, 60, seed=3).withColumn("id", F.concat(F.lit("n"), (F.substring("id", 2, 9).cast("int") * 11).cast("string")))
    N.upsert(spark, path, changed, removed=spark.createDataFrame([("n1",), ("n2",), ("n0",), (None,), ("never",)], "id string").filter("id <> 'n0' OR id IS NULL"))
    again = changed.limit(5).withColumn("body", F.lit("w1 other words"))
    again = spark.createDataFrame(again.collect(), COLUMNS)
    N.upsert(spark, path, again)
    now = S.upsert(S.upsert(notes.filter("id NOT IN ('n1', 'n2')"), changed, "id"), again, "id").persist()
    assert {tuple(r) for r in N.notes_of(spark, path).collect()} == {tuple(r) for r in now.collect()}
    for q in ("w1 w30", "other"):
        assert scores(N.ranking(spark, path, N.parsed(q))) == scores(S.bm25(now, q.split()))
    assert scores(N.ranking(spark, path, N.parsed("w1 w30"), version=first)) == scores(S.bm25(notes, ["w1", "w30"]))
    fresh = place(spark)
    N.upsert(spark, fresh, now, buckets=8)
    assert {tuple(r) for r in N.vocabulary(spark, path).collect()} == {tuple(r) for r in N.vocabulary(spark, fresh).collect()}
    before = scores(N.ranking(spark, path, N.parsed("w1 w30")))
    N.compact(spark, path)
    assert len(manifest(spark, path)["segments"]) == 1 and scores(N.ranking(spark, path, N.parsed("w1 w30"))) == before


def test_of_two_writers_one_wins(spark):
    path = place(spark)
    base = N.upsert(spark, path, made(spark, 10))
    N.upsert(spark, path, made(spark, 3, seed=8), base=base)
    with pytest.raises(Conflict):
        N.upsert(spark, path, made(spark, 5, seed=9), base=base)
    assert current(spark, path) == base + 1 and {tuple(r) for r in N.notes_of(spark, path).collect()} >= {tuple(r) for r in made(spark, 3, seed=8).collect()}
    assert N.notes_of(spark, path, base).count() == 10
    with pytest.raises(Conflict):
        commit(spark, path, base, {})


def test_names_are_found_by_their_words(spark):
    path = place(spark)
    rows = [("1", None, "Uses AbilitySystem", None), ("2", "a", None, "plain ability"), ("3", "a", "", ""), (None, "a", "ability", ""), ("2", "a", "", "")]
    N.upsert(spark, path, spark.createDataFrame(rows, COLUMNS).withColumn("score", F.lit(1)))
    found = lambda q, mode="or": set(scores(N.ranking(spark, path, N.parsed(q, mode))))
    assert found("ability") == {"1", "2"} and found("AbilitySystem") == {"1", "2"} and found("AbilitySystem", "and") == {"1"} and found("abil*") == {"1", "2"}
    best = N.best(spark, path, N.parsed("plain"), limit=1).rows.first()
    assert (best.rank, best.id, best.snippet) == (1, "2", "**plain** ability")
    assert N.notes_of(spark, path).count() == 3


def test_empty(spark):
    path = place(spark)
    assert N.ranking(spark, path, N.parsed("a")).count() == 0 and N.notes_of(spark, path).count() == 0
    N.upsert(spark, path, spark.createDataFrame([], COLUMNS))
    assert N.ranking(spark, path, N.parsed("a b*")).count() == 0 and N.best(spark, path, N.parsed("a")).rows.count() == 0 and N.best(spark, path, N.parsed("?")).rows.count() == 0
    with pytest.raises(ValueError):
        N.best(spark, path, N.parsed("a"), limit=0)
