"""Every stage on its own input against brute force, on the smallest tables."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

pytest.importorskip("cordage.llm")
corpus_pipeline = pytest.importorskip("corpus_pipeline")
import test_decontaminate
import test_mixing
import test_near_copies

from cordage.llm import mixing
from cordage.llm.common import staged
from cordage.llm.queries import tokenizer_path

WORD = re.compile("[^\x20\x09-\x0d]+")


@pytest.fixture(scope="module")
def results(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = spark.createDataFrame([(9000, None, "en", "src1", 0), (9001, "123 !!", "en", None, 6), (9002, "", None, "src1", 0)], docs.schema)
    out = [docs.unionByName(odd).unionByName(docs.limit(2))]
    for name, stage in corpus_pipeline.STAGES:
        out.append(staged(stage(spark, out[-1], sf), name))
    return out


def test_columns(results):
    assert [r.columns for r in results[1:5]] == [results[0].columns] * 4
    assert results[5].columns == ["doc_id", "start", "n_tokens", "ids_crc32"]


def test_language_keeps_what_has_letters(results):
    ids = lambda df: Counter(r.doc_id for r in df.select("doc_id").collect())
    assert ids(results[0]) - ids(results[1]) == Counter({9000: 1, 9001: 1, 9002: 1})


def test_one_of_each_group_stays(results):
    """Of each group linked by a similarity of 0.8 over 5-word shingles, the least id."""
    rows = sorted(results[1].collect(), key=lambda r: r.doc_id)
    roots = test_near_copies.plain_groups([r.text for r in rows])
    assert sorted(r.doc_id for r in results[2].collect()) == sorted(rows[i].doc_id for i in set(roots))


def test_contaminated_documents_go(results, spark, sf):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    before = results[2].collect()
    hit = {d for d, _ in test_decontaminate.plain([(r.doc_id, r.text) for r in before], items)}
    assert hit and {r.doc_id for r in results[3].collect()} == {r.doc_id for r in before} - hit


def test_mix_reaches_targets(results):
    sizes, whole = Counter(), {}
    for r in results[3].collect():
        sizes[r.source] += len(WORD.findall(r.text))
        whole[r.doc_id] = r
    taken, rows = Counter(), defaultdict(list)
    for r in results[4].collect():
        taken[r.source] += len(WORD.findall(r.text))
        rows[r.doc_id].append(r)
        assert r.n_chars == len(r.text)
    targets = test_mixing.plain_targets(sizes)
    assert all(abs(taken[s] - t) <= mixing.BLOCK_WORDS for s, t in targets.items())
    for d, parts in rows.items():
        words = WORD.findall(whole[d].text)
        assert len(parts) <= 2
        for p in parts:
            if p.text != whole[d].text:
                rest = iter(words)
                assert all(w in rest for w in WORD.findall(p.text))  # in order


def test_tokens_are_those_of_the_texts(results):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    texts = sorted((r.doc_id, r.text) for r in results[4].collect())
    start = 0
    for r, (d, t) in zip(results[5].orderBy("start").collect(), texts, strict=True):
        ids = np.asarray([*tokenizer.encode(t, add_special_tokens=False).ids, 1], "<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (d, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_run(spark, sf):
    assert corpus_pipeline.run(spark, sf).count() > 0 and corpus_pipeline.ORACLE_SQL is None


def test_stages_take_empty_tables_and_odd_rows(spark, sf):
    """Null ids and texts, repeated rows and clashing columns reach every stage by itself."""
    odd = [(1, "the first of two texts that are the same in all its words", "a"), (1, "the first of two texts that are the same in all its words", "a"), (None, None, None), (None, "", "b"), (2, "another text of words that no other one has", None)]
    docs = spark.createDataFrame(odd, "doc_id long, text string, source string").selectExpr("*", "'en' AS lang", "7 AS _nth", "8 AS _hit", "9 AS _kept", "10 AS size", "11 AS cls", "12 AS start")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf).count() == 0, name
        rows = stage(spark, docs, sf)
        if name != "tokens":
            assert rows.columns == docs.columns
            assert all((r._nth, r._hit, r._kept, r.size, r.cls, r.start) == (7, 8, 9, 10, 11, 12) for r in rows.collect()), name
        else:
            assert rows.count() == 5


def test_decontamination_goes_by_id_and_text(spark, sf):
    """A clean text stays, though another one under its id, or under no id, holds an item."""
    item = spark.read.parquet(f"{sf}/benchmark.parquet").orderBy("item_id").first().text
    clean = "words that are in no item of any kind and that nobody asks for"
    docs = spark.createDataFrame([(1, item), (1, clean), (2, clean), (None, f"before {item} after"), (None, clean)], "doc_id long, text string")
    rows = corpus_pipeline.decontaminate(spark, docs, sf).collect()
    assert sorted((str(r.doc_id), r.text) for r in rows) == sorted([("1", clean), ("2", clean), ("None", clean)])


def test_mix_keeps_white_space(spark):
    """What is taken of a text in part is as it stands there: line breaks, indentation and runs of spaces."""
    gaps = ["\n", "\n\n    ", "  ", "\t", " "]
    docs = []
    for d in range(6):
        words = [f"d{d}w{i}" for i in range(700 + 50 * d)]
        docs.append((d, "  " + "".join(w + gaps[i % 5] for i, w in enumerate(words)), f"s{d % 2}"))
    texts = dict((d, t) for d, t, _ in docs)
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string")
    parts = [r for r in corpus_pipeline.mix(spark, frame, "").collect() if r.text != texts[r.doc_id]]
    assert parts
    for r in parts:
        found = [(int(m[2]), m[1]) for m in re.finditer(r"(\s*)d\d+w(\d+)", r.text)]
        assert "".join(f"{g}d{r.doc_id}w{i}" for i, g in found) == r.text
        assert all(g == ("  " if i == 0 else gaps[(i - 1) % 5]) for i, g in found)
