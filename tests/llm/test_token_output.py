import hashlib
import random
import zlib

import numpy as np
import pytest

pytest.importorskip("cordage.llm")
from cordage.llm import token_output as M
from cordage.llm.queries import tokenizer_path


@pytest.fixture(scope="module")
def definition():
    return open(tokenizer_path(), encoding="utf-8").read()


def whole(encoder, text):
    return encoder.tokenizer.encode(text, add_special_tokens=False).ids


PARTS = ["The", "don't", "we'll", "naïve", "ÉCOLE.", "a,b", "x...", "!?.,", "1,234.5", "“quoted,”", "été,", "İstanbul.", "ΣΟΦΟΣ,", "\x1c", " ", " ", "日本語。", "<|endoftext|>", "<|ENDOFTEXT|>", "'s", "s'd,", "한.", ".", ",,", "ß", "the<|startoftext|>,end", "😀,", "taiĺ."]


def test_pieces_equal_whole_texts(definition, monkeypatch):
    encoder, rng = M.WordEncoder(definition), random.Random(3)
    texts = ["".join(rng.choice(PARTS) + rng.choice([" ", "\n", "", "\t", "\r\n", " "]) for _ in range(rng.randrange(25))) for _ in range(600)]
    for text, ids in zip(texts, encoder.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == whole(encoder, text), text
    monkeypatch.setattr(M, "KEPT_WORDS", 5)
    small = M.WordEncoder(definition)
    assert [small.encode([t])[0] for t in texts[:50]] == encoder.encode(texts[:50])


def test_round_trip(spark, definition, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    manifest, dictionary = M.write_tokens(spark, docs, definition, 1)
    rows = sorted(M.read_tokens(spark, manifest, dictionary).collect(), key=lambda r: r.doc_id)
    encoder, start = M.WordEncoder(definition), 0
    texts = docs.orderBy("doc_id").collect()
    assert [r.doc_id for r in rows] == [t.doc_id for t in texts]
    for r, t in zip(rows, texts, strict=True):
        ids = np.asarray([*whole(encoder, t.text or ""), 1], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    first = manifest.orderBy("start").first()
    shard = M.Shard(first.path, dictionary)
    assert shard.document(texts[3].doc_id).tolist() == [*whole(encoder, texts[3].text), 1]
    assert len(dictionary) > 0
    with pytest.raises(ValueError, match="another dictionary"):
        M.Shard(first.path, dictionary + b"x")
    assert len(hashlib.sha256(dictionary).digest()) == 32


def test_odd_rows(spark, definition):
    rows = [(1, None, "x"), (1, "b", "y"), (1, "a", "z"), (None, "null id", "w"), (0, "", "v")]
    manifest, dictionary = M.write_tokens(spark, spark.createDataFrame(rows, "doc_id long, text string, start string"), definition, 1)
    got = M.read_tokens(spark, manifest, dictionary).orderBy("start").collect()
    assert [(r.doc_id, r.start, r.n_tokens) for r in got] == [(None, 0, 3), (0, 3, 1), (1, 4, 1), (1, 5, 2), (1, 7, 2)]
    none = M.write_tokens(spark, spark.createDataFrame([], "doc_id long, text string"), definition, 1)
    assert M.read_tokens(spark, *none).count() == 0


def test_driver_keeps_no_encoder(spark, definition, monkeypatch):
    """The driver encodes the dictionary's samples only: neither the encoder nor the memory it took stay with it."""
    freed = []
    monkeypatch.setattr(M, "_encoders", {})
    monkeypatch.setattr(M, "release", lambda: freed.append(1))
    docs = spark.createDataFrame([(i, f"the words of document {i} and what follows them " * 40) for i in range(60)], "doc_id long, text string")
    assert M.train_dictionary(spark, docs, definition)
    assert not M._encoders and freed
