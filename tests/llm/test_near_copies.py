import random

import pytest

pytest.importorskip("cordage.llm")
import corpus_pipeline

from cordage.llm import near_copies as M
from cordage.llm.common import cleared
from cordage.llm.components import components


def plain_shingles(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", low) if w]
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_groups(texts, least=0.8):
    """By all pairs: least position reachable over similarities of ``least`` or more."""
    sets, root = [plain_shingles(t) for t in texts], list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or len(a & b) / len(a | b) >= least:
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return [find(i) for i in range(len(texts))]


def kept(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted((tuple(r) for r in corpus_pipeline.near_duplicates(spark, df, "").collect()), key=str)


def test_shingles():
    text = "A b C d e f a B c d e\x0bg"
    assert len(M.shingles(text)) == len(plain_shingles(text)) and len(M.shingles("a b")) == 1 and len(M.shingles(" ")) == 0
    assert (M.shingles(text) == M.shingles(text.lower())).all()


def test_stage_on_table(spark, sf):
    docs = sorted(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    roots = plain_groups([r.text for r in docs])
    got = kept(spark, [tuple(r) for r in docs])
    assert sorted(d for d, _ in got) == [docs[i].doc_id for i in sorted(set(roots))]
    assert not {145, 177} & {d for d, _ in got}  # near copies of 6 and 1, at 0.833 and 0.830


def test_drifting_copies(spark):
    rng = random.Random(3)
    texts = []
    for g in range(12):
        words = [f"g{g}w{i}" for i in range(rng.choice([8, 20, 60, 150]))]
        for _ in range(rng.randrange(1, 25)):
            texts.append(" ".join(words))
            if rng.random() < 0.7:  # copies of copies, so that the ends of a group are far apart
                words = list(words)
                for _ in range(rng.randrange(1, 4)):
                    words[rng.randrange(len(words))] = f"e{rng.random()}"
    rng.shuffle(texts)
    got = kept(spark, list(enumerate(texts)))
    assert [d for d, _ in sorted(got)] == sorted(set(plain_groups(texts)))


def test_empty(spark):
    assert kept(spark, []) == []


def test_frequent_passage_makes_few_pairs(spark):
    """Texts that share a passage of two thirds of their words meet in bands, but are not compared with each other; true copies among them are found."""
    rng = random.Random(9)
    word = lambda: f"w{rng.randrange(10**7)}"
    passage, texts = [word() for _ in range(80)], []
    for _ in range(150):
        texts.append(" ".join(passage + [word() for _ in range(rng.randrange(8, 40))]))
    for t in texts[:40:4]:
        texts.append(t + " " + word())
    rows = list(enumerate(texts))
    roots = plain_groups(texts)
    assert sorted(d for d, _ in kept(spark, rows)) == sorted(set(roots))


def test_stage_writes_few_tables(spark):
    """Every table that a stage writes is an action with jobs and plans that the driver holds: their number is bounded where texts are left apart from their hub, too."""
    rng = random.Random(9)
    word = lambda: f"w{rng.randrange(10**7)}"
    passage = [word() for _ in range(80)]
    texts = [" ".join(passage + [word() for _ in range(rng.randrange(8, 40))]) for _ in range(60)]
    texts += [t + " " + word() for t in texts[:40:4]]
    with cleared(spark) as written:
        found = kept(spark, list(enumerate(texts)))
        tables = [path.rsplit("/", 1)[1].rsplit("-", 1)[0] for path in written]
    assert sorted(d for d, _ in found) == sorted(set(plain_groups(texts)))
    assert "others" in tables and "larger" in tables  # hubs among those apart, and the prefix filter, have had their turn
    assert len(tables) <= 50 and tables.count("members") <= 2


def test_components_end_at_stars(spark):
    """Stars are seen to be done without another round, whatever the links' direction and repeats; chains, rings and loops come to their least nodes."""
    star = [(5, i) for i in range(6, 20)] + [(7, 5), (5, 7), (5, 5)]
    with cleared(spark) as written:
        assert sorted(map(tuple, components(spark.createDataFrame(star, "u long, v long")).collect())) == [(i, 5) for i in range(6, 20)]
        assert len(written) == 2
    chain = [(i * 37 % 101, (i + 1) * 37 % 101) for i in range(100)]
    ring = [(200 + i, 200 + (i + 1) % 9) for i in range(9)]
    want = [(i, 0) for i in range(1, 101)] + [(i, 200) for i in range(201, 209)]
    assert sorted(map(tuple, components(spark.createDataFrame([*chain, *ring, (300, 300)], "u long, v long")).collect())) == want
    assert components(spark.createDataFrame([], "u long, v long")).collect() == []
