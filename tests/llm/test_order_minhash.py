import hashlib
import random
import re
from collections import Counter

import pytest
import xxhash

pytest.importorskip("cordage.llm")
from pyspark.sql import functions as F

from cordage.llm import order_minhash as M


def prints(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    return [r.f for r in M.with_fingerprint(rows, "text", "f").orderBy("i").collect()]


def likeness(a, b):
    either = {x >> 16 for x in a} | {x >> 16 for x in b}
    return len(set(a) & set(b)) / len(either) if either else 1.0


def test_occurrence_numbers(spark):
    values = sorted(random.Random(1).choice([5, 7, 7 << 20, -3]) << 24 | i for i in range(300))
    df = spark.createDataFrame([(values,)], "k array<long>")
    got = df.select(F.transform("k", lambda x, i: M._occurrence(F.col("k"), x, i))).first()[0]
    assert got == [sum(v >> 24 == x >> 24 for v in values[:i]) for i, x in enumerate(values)]


def test_order_counts_and_equal_texts_agree(spark):
    rng = random.Random(2)
    words = [f"w{rng.random()}" for _ in range(600)]
    a = " ".join(words)
    moved = " ".join(words[300:] + words[:300])
    edited = " ".join(words[:550] + [f"v{i}" for i in range(50)])
    other = " ".join(f"x{i}" for i in range(600))
    p = prints(spark, [a, a, moved, edited, other, "", "one", "one", "z" * 100])
    assert p[0] == p[1] and len(p[0]) == 64 and p[5] == [] and p[6] == p[7] and len(p[6]) == 1 and p[8]
    assert likeness(p[0], p[3]) > 0.6 > likeness(p[0], p[2]) > likeness(p[0], p[4]) == 0


def test_repeats_differ(spark):
    p = prints(spark, ["a b c " * 10, "a b c " * 40])
    assert 0 < likeness(*p) < 1


def expected(docs):
    """(doc_id, n_chars, edited text) by the contract; docs have distinct ids."""
    docs = sorted(docs)
    out = {}
    for i, (d, t) in enumerate(docs):
        t, following = t or "", docs[(i + 1) % len(docs)][1] or ""
        half = len(t) // 2
        out[d] = (len(t), t[: len(t) - half] + following[:half])
    return out


def test_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    rows = {r.doc_id: r for r in M.fingerprint_documents(spark, docs).collect()}
    want = expected([(r.doc_id, r.text) for r in docs.collect()])
    assert rows.keys() == want.keys()
    ids = sorted(rows)
    whole = dict(zip(ids, prints(spark, [r.text for r in docs.orderBy("doc_id").collect()]), strict=True))
    edited = dict(zip(ids, prints(spark, [want[d][1] for d in ids]), strict=True))
    for i, d in enumerate(ids):
        r = rows[d]
        assert (r.n_chars, r.edited_sha256) == (want[d][0], hashlib.sha256(want[d][1].encode()).hexdigest())
        assert r.fp == whole[d] and r.edited_fp == edited[d]
        assert r.near_edited == likeness(whole[d], edited[d]) and r.near_next == likeness(whole[d], whole[ids[(i + 1) % len(ids)]])
    assert sum(r.near_edited for r in rows.values()) > 3 * sum(r.near_next for r in rows.values())


def test_odd_rows(spark):
    rows = [(1, None, 1), (2, "é b c d e f", 2), (2, "a b", 2), (None, "first one", 3)]
    got = sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in M.fingerprint_documents(spark, spark.createDataFrame(rows, "doc_id long, text string, next long")).collect()), key=str)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    # After the null id comes 1 (empty); after 1 the least text of 2; after 2 the null id again.
    want = [(None, 9, sha("first")), (1, 0, sha("")), (2, 11, sha("é b c first")), (2, 3, sha("a f"))]
    assert got == sorted(want, key=str)
    assert M.fingerprint_documents(spark, spark.createDataFrame([], "doc_id long, text string")).count() == 0
    one = M.fingerprint_documents(spark, spark.createDataFrame([(4, "abcd")], "doc_id long, text string")).first()
    assert one.edited_sha256 == sha("abab") and one.near_next == 1


def test_order_counts_in_short_texts(spark):
    rng = random.Random(5)
    texts = [[f"w{rng.random()}" for _ in range(rng.randrange(12, 100))] for _ in range(60)]
    p = prints(spark, [" ".join(t) for t in texts] + [" ".join(t[len(t) // 2 :] + t[: len(t) // 2]) for t in texts])
    assert all(len({c >> 16 for c in f}) == len(f) == 64 for f in p)
    assert sum(likeness(a, b) for a, b in zip(p[:60], p[60:], strict=True)) / 60 < 0.55


def plain_fingerprint(text):
    """Order MinHash word by word: numbered k-mers, dealt to 64 buckets in a circle; from each bucket on the two least, in text order."""
    signed = lambda x: x - (1 << 64) if x >> 63 else x

    def chained(values, size=8):
        x = 42
        for v in values:
            x = xxhash.xxh64_intdigest((v % (1 << 8 * size)).to_bytes(size, "little"), x)
        return x

    words = [xxhash.xxh64_intdigest(w.encode(), 42) for w in re.findall("[^\x20\x09-\x0d]{1,16}", text or "")]
    kmers = [chained(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [chained(words)] if words else []
    seen, elements = Counter(), []
    for at, k in enumerate(kmers):
        name = signed(k) >> 24
        numbered = xxhash.xxh64_intdigest(seen[name].to_bytes(4, "little"), xxhash.xxh64_intdigest((name % (1 << 64)).to_bytes(8, "little"), 42))
        seen[name] += 1
        elements.append((signed(numbered) >> 24, at))
    elements.sort()
    out = []
    if len(elements) == 1:  # a text of one k-mer has one component
        return [(elements[0][0] >> 34) % 64 * 65536 + chained([elements[0][0] << 24]) % 65536]
    for place in range(-32, 32) if elements else []:
        circle = [e for e in elements if e[0] >> 34 >= place] + [e for e in elements if e[0] >> 34 < place]
        # The two least of each bucket on the way.
        pair = sorted(circle[:2], key=lambda e: e[1])
        out.append(place % 64 * 65536 + chained([e[0] << 24 for e in pair]) % 65536)
    return sorted(out)


def test_equals_plain_order_minhash(spark):
    rng = random.Random(8)
    texts = [" ".join(f"w{rng.randrange(rng.choice([3, 40, 5000]))}" for _ in range(n)) for n in [0, 1, 2, 3, 4, 5, 9, 30, 70, 200, 900, 3000]]
    texts += ["x" * 100, "a b c " * 500, "é ü\tñ\x0bö a"]
    assert prints(spark, texts) == [plain_fingerprint(t) for t in texts]


def test_very_long_text(spark):
    text = " ".join(f"w{i % 50000}" for i in range(120000))
    a, b = prints(spark, [text, text])
    assert a == b and len(a) == 64
