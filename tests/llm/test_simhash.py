import random

import pytest
import xxhash

pytest.importorskip("cordage.llm")
from pyspark.sql import functions as F

from cordage.llm import simhash as M


def plain_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", low) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def plain_components(prints):
    """By all pairs: least id reachable."""
    ids = list(range(len(prints)))
    root = ids[:]

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in ids:
        for j in ids[:i]:
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in ids]


def test_fingerprints():
    rng = random.Random(1)
    parts = ["A", "b", "É", "Zz", " ", "\t", "\x0b", "\x1c", " ", "one", "Two", ""]
    for _ in range(300):
        text = "".join(rng.choice(parts) + rng.choice([" ", ""]) for _ in range(rng.randrange(30)))
        assert M.fingerprint(text) == plain_fingerprint(text), text
    assert M.fingerprint(None) == M.fingerprint(" \n") == 0


def test_long_text_in_stretches(monkeypatch):
    text = " ".join(str(i * i) for i in range(1000))
    whole = M.fingerprint(text)
    monkeypatch.setattr(M, "_STRETCH", 7)
    assert M.fingerprint(text) == whole


def linked(spark, prints):
    """Components by the operator's links, as least position."""
    from cordage.llm.components import components

    df = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in set(prints)], "fp long")
    roots = {r.node: r.root for r in components(M.links(df)).collect()}
    first: dict = {}
    out = []
    for i, p in enumerate(prints):
        s = p - (1 << 64) if p >> 63 else p
        out.append(first.setdefault(roots.get(s, s), i))
    return out


def test_links_equal_all_pairs(spark):
    rng = random.Random(2)
    seeds = [0, (1 << 64) - 1, 1 << 63] + [rng.getrandbits(64) for _ in range(40)]
    prints = []
    for s in seeds:
        p = s
        for _ in range(rng.randrange(1, 14)):  # chains that drift, with steps of 0 to 4 bits
            prints.append(p)
            for _ in range(rng.randrange(5)):
                p ^= 1 << rng.randrange(64)
    rng.shuffle(prints)
    assert linked(spark, prints) == plain_components(prints)


def test_near_duplicates_on_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = sorted(M.near_duplicates(spark, docs).collect(), key=lambda r: r.doc_id)
    texts = [r.text for r in docs.orderBy("doc_id").collect()]
    prints = [plain_fingerprint(t) for t in texts]
    assert [r.fp % (1 << 64) for r in rows] == prints
    ids = [r.doc_id for r in rows]
    assert [r.component_id for r in rows] == [ids[i] for i in plain_components(prints)]


def test_odd_rows(spark):
    rows = [(5, None, 1), (3, "", 2), (3, " ", 3), (None, "a b c d", 4), (9, "A  B c\nd", 5), (9, "A  B c\nd", 5), (None, "lone words here", 6)]
    got = M.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string, fp long"))
    named = sorted(((r.doc_id, r.component_id) for r in got.collect()), key=str)
    assert named == sorted([(5, 3), (3, 3), (3, 3), (None, 9), (9, 9), (9, 9), (None, None)], key=str)
    assert M.near_duplicates(spark, spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert spark.range(1).select(M.hex_fingerprint(F.lit(-1).cast("long"))).first()[0] == "f" * 16
