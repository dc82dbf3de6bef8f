import zlib

import numpy as np
import pytest

pytest.importorskip("cordage.llm")
from cordage.llm import language_id as L
from cordage.llm import line_crf as C
from cordage.llm import quality as Q
from cordage.llm.byte_cnn import WINDOW, ByteCNN, windows_of

LARGER = "/root/testdata/sf0.01"


def fold(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 3 == 1


def test_gradients_by_differences():
    rng = np.random.default_rng(1)
    net = ByteCNN(["a", "b", "c"])
    net._parameters()
    for name in ("embed", "out", "out_bias"):
        setattr(net, name, getattr(net, name).astype(np.float64))
    net.filters, net.bias = [f.astype(np.float64) for f in net.filters], [b.astype(np.float64) for b in net.bias]
    rows, labels = rng.integers(0, 256, (4, WINDOW)).astype(np.uint8), np.array([0, 1, 2, 1])
    weight = np.ones(4)

    def loss():
        net._tables = None
        p = net.probabilities(rows)
        return -np.log(p[np.arange(4), labels].astype(np.float64)).mean()

    for p, g in zip(net._parameters(), net._gradients(rows, labels, weight), strict=True):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        old = p[at]
        step = 1e-3
        p[at] = old + step
        up = loss()
        p[at] = old - step
        down = loss()
        p[at] = old
        assert (up - down) / (2 * step) == pytest.approx(g[at], rel=0.08, abs=1e-4)


def test_windows_cover_whole_text():
    data = np.arange(600, dtype=np.uint16).astype(np.uint8)
    assert windows_of(data).ravel()[:600].tolist() == data.tolist() and len(windows_of(data)) == 3 and len(windows_of(data[:0])) == 1


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{LARGER}/documents.parquet")
    langs = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    rows = L.identify(spark, docs).collect()
    assert len(rows) == len(langs) and all(r.held_out == fold(r.doc_id) for r in rows)
    out = [r for r in rows if r.held_out]
    assert np.mean([r.lang_pred == langs[r.doc_id] for r in out]) > 0.97 and all(0 <= r.score <= 1 for r in rows)


def test_language_odd_rows(spark):
    docs = spark.createDataFrame([(i, f"the cat and the dog number {i} ran on", "en") for i in range(40)] + [(i, f"le chat et le chien de la maison {i} est", "fr") for i in range(40, 80)], "doc_id long, text string, lang string")
    odd = spark.createDataFrame([(100, None, "en"), (101, "123 ... !", None), (102, "", "fr"), (None, "le chat et la maison " * 3000, None), (103, "the cat and the dog", None), (103, "the cat and the dog", None)], "doc_id long, text string, lang string")
    got = [(r.doc_id, r.lang_pred, r.held_out) for r in L.identify(spark, docs.unionByName(odd)).collect() if r.doc_id is None or r.doc_id >= 100]
    assert sorted(got, key=str) == sorted([(100, "und", fold(100)), (101, "und", fold(101)), (102, "und", fold(102)), (None, "fr", True), (103, "en", fold(103)), (103, "en", fold(103))], key=str)
    kept = L.in_known_language(spark, docs.unionByName(odd))
    assert kept.columns == docs.columns and kept.count() == 83
    none = L.identify(spark, spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")).first()
    assert (none.lang_pred, none.score) == ("und", 0.0)
    assert L.identify(spark, docs.limit(0)).count() == 0 and L.in_known_language(spark, docs.limit(0)).count() == 0


def brute(field, texts):
    """Document scores by summing over all labelings."""
    from itertools import product

    out = []
    a = field.steps
    for t in texts:
        bins, size, counts = C.measures([t])
        s = field._scores(field._features(bins, counts))
        weights = {y: np.exp(sum(s[i] for i in range(len(s)) if y[i]) + sum(a[p, q] for p, q in zip(y, y[1:], strict=False))) for y in product((0, 1), repeat=len(s))}
        total = sum(weights.values())
        good = [sum(w for y, w in weights.items() if y[i]) / total for i in range(len(s))]
        out.append(np.average(good, weights=size + 1.0))
    return out


def test_steps_gradient_by_differences():
    """Of the log-likelihood by all labelings of two short texts."""
    rng = np.random.default_rng(4)
    bins, counts, labels = rng.integers(0, C.BINS, (7, C.MEASURES)).astype(np.uint8), np.array([4, 3]), np.array([1, 0])
    field = C.LineCRF()
    field.weights, field.bias, field.steps = rng.normal(0, 0.3, field.weights.shape), 0.2, rng.normal(0, 1, (2, 2))
    line_label, line_weight = np.repeat(labels, counts).astype(float), np.repeat([0.6, 0.4], counts)
    features = field._features(bins, counts)
    flat = (np.arange(3)[None, :, None] * C.MEASURES + np.arange(C.MEASURES)[None, None]) * (C.BINS + 1) + features

    def likelihood():
        scores, total, at = field._scores(features), 0.0, 0
        for n, label, w in zip(counts, labels, (0.6, 0.4), strict=True):
            value = lambda y, at=at, n=n: sum(scores[at + t] * y[t] for t in range(n)) + sum(field.steps[y[t - 1], y[t]] for t in range(1, n))
            every = [value([k >> t & 1 for t in range(n)]) for k in range(1 << n)]
            total += w * (value([label] * n) - np.log(np.exp(every).sum()))
            at += n
        return total - C.STEP_KEEP / 2 * (field.steps**2).sum()

    g = field._gradient(bins, counts, line_label, line_weight, flat, 0.0)[-4:].reshape(2, 2)
    for i in range(2):
        for j in range(2):
            found = []
            for sign in (1, -1):
                field.steps[i, j] += sign * 1e-4
                found.append(likelihood())
                field.steps[i, j] -= sign * 1e-4
            assert (found[0] - found[1]) / 2e-4 == pytest.approx(g[i, j], abs=1e-5)


def test_marginals_by_all_labelings():
    rng = np.random.default_rng(2)
    field = C.LineCRF()
    field.weights = rng.normal(0, 0.3, field.weights.shape)
    field.steps = rng.normal(0, 1, (2, 2))
    texts = [b"", b"One line.", b"a\nA\nB!!\nb | c\n\n123", b"x\n" * 9, b"THE END!!\nthe end, said she."]
    assert field.documents(texts) == pytest.approx(brute(field, texts))


def test_quality_held_out(spark):
    docs, labels = (spark.read.parquet(f"{LARGER}/{t}.parquet") for t in ("documents", "labels"))
    rows = {r.doc_id: r for r in Q.score(spark, docs, labels).collect()}
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) and r.held_out == fold(d) for d, r in rows.items())
    out = [(rows[r.doc_id].predicted, r.quality) for r in labels.collect() if fold(r.doc_id)]
    assert np.mean([p == q for p, q in out]) > 0.93


def test_quality_odd_rows(spark):
    docs = spark.createDataFrame([(i, "Good words, well put.\nAnd more." if i % 2 else "BAD!! BAD!!\n### ***") for i in range(60)] + [(100, None), (101, ""), (None, "Good words, well put."), (102, "x" * 200000), (102, "y\n" * 3000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, None) for i in range(60)] + [(None, 1, 1), (5, None, 0), (7, 1, 0), (7, 1, 0), (900, 1, 0)], "doc_id long, quality int, toxic int")
    rows = Q.score(spark, docs, labels).collect()
    assert len(rows) == 65 and all(0 <= r.score <= 1 for r in rows)
    assert all(r.predicted == r.doc_id % 2 for r in rows if r.doc_id is not None and r.doc_id < 60)
    none = Q.score(spark, docs, labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5} and Q.score(spark, docs.limit(0), labels).count() == 0


def test_language_gives_training_memory_back(spark, monkeypatch):
    """The driver goes on to other stages, so what training took goes back."""
    freed = []
    monkeypatch.setattr(L, "release", lambda: freed.append(1))
    docs = spark.createDataFrame([(i, f"the cat and the dog number {i} ran on", "en") for i in range(20)], "doc_id long, text string, lang string")
    assert L.learn(spark, docs) is not None and freed
