"""Language ID with a byte convolutional network (see byte_cnn.py).

Learned from labelled documents outside the held-out fold; of every language the LEARN_DOCUMENTS with the least id hash (fewer where there are so many
languages that the sample would exceed LEARN_SAMPLE documents, one at least), and of each of those LEARN_WINDOWS windows spread over the text. Prediction reads whole texts.

Defined cases: a text that is null or has no letter is `und` with score 0; without anything to learn from, all are; rows
that repeat a doc_id each get a row; a null doc_id counts as held out; filtering rejects `und` and scores below LEAST_SCORE; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cordage.llm.byte_cnn import WINDOW, ByteCNN, windows_of
from cordage.llm.common import held_out, release, trimmed

#: Documents that are learned from of each language and of all together, windows of a document.
LEARN_DOCUMENTS, LEARN_SAMPLE, LEARN_WINDOWS = 500, 100_000, 6
UNKNOWN = "und"
#: Below this score a language counts as not recognised: no language has the greater part of the probability.
LEAST_SCORE = 0.5
#: Bytes of text that the network reads at a time.
STRETCH = 1 << 18
_LETTER = regex.compile(r"\p{L}")


def learn(spark: SparkSession, docs: DataFrame, documents: int = LEARN_DOCUMENTS, windows: int = LEARN_WINDOWS) -> ByteCNN | None:
    """The network, or None where nothing is labelled."""
    known = docs.filter(F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    # Ids are drawn before any text is read. By a language's count, a hash threshold leaves about twice as many as are wanted, and of
    # those the least hashes are taken, so no task orders a whole language.
    counts = known.groupBy("lang").agg(F.count("*").alias("count"))
    documents = max(1, min(documents, LEARN_SAMPLE // max(1, counts.count())))
    chance = F.shiftrightunsigned(F.xxhash64("doc_id"), 11) / F.lit(float(1 << 53))
    drawn = known.select("doc_id", "lang", chance.alias("chance")).join(counts, "lang").filter(F.col("chance") * F.col("count") < 2 * documents + 50)
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("chance", "doc_id"))
    ids = drawn.withColumn("n", nth).filter(F.col("n") <= documents).select("doc_id", "lang", "n").dropDuplicates(["doc_id", "lang"])
    # At most LEARN_SAMPLE ids, or one per language.
    picked = docs.filter(F.length("text") > 0).join(F.broadcast(ids), ["doc_id", "lang"])
    # As many rows as languages times ``documents``, each cut to the few stretches that are learned from.
    step = F.greatest(F.floor(F.length("text") / windows), F.lit(WINDOW))
    cuts = F.transform(F.sequence(F.lit(0), F.lit(windows - 1)), lambda i: F.substring(F.col("text"), (i * step + 1).cast("int"), F.lit(WINDOW)))
    rows = picked.select("lang", F.filter(cuts, lambda c: F.length(c) > 0).alias("cuts"), "n").orderBy("lang", "n", "cuts").collect()
    if not rows:
        return None
    classes = sorted({r["lang"] for r in rows})
    data, labels = [], []
    for r in rows:
        for cut in r["cuts"]:
            if _LETTER.search(cut):
                data.append(windows_of(np.frombuffer(cut.encode("utf-8", "replace")[:WINDOW], np.uint8))[0])
                labels.append(classes.index(r["lang"]))
    if not data:
        return None
    network = ByteCNN(classes)
    network.fit(np.stack(data), np.array(labels))
    # The driver goes on to later stages: what training took does not stay with it.
    del rows, data, labels
    release()
    return network


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])


def _predicted(network: ByteCNN | None, texts: pa.Array) -> tuple[list[str], list[float]]:
    names, scores, todo, size = [UNKNOWN] * len(texts), [0.0] * len(texts), [], 0
    for k in range(len(texts)):
        text = texts[k].as_py()
        if network is not None and text is not None and _LETTER.search(text):
            todo.append((k, text.encode("utf-8", "replace")))
            size += len(todo[-1][1])
        if todo and (size >= STRETCH or k == len(texts) - 1):
            p = network.documents([t for _, t in todo])
            for (i, _), c, s in zip(todo, p.argmax(axis=1).tolist(), p.max(axis=1).tolist(), strict=True):
                names[i], scores[i] = network.classes[c], min(1.0, s)
            todo, size = [], 0
    return names, scores


def _predictor(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = _predicted(model.value, batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], schema=_SCHEMA)

    return trimmed(run)


def _filter(model, column: int, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = _predicted(model.value, batch.column(column))
            yield batch.filter(pa.array([n != UNKNOWN and s >= least for n, s in zip(names, scores, strict=True)], pa.bool_()))

    return trimmed(run)


def predict(spark: SparkSession, docs: DataFrame, network: ByteCNN | None) -> DataFrame:
    """doc_id, lang_pred, score of every document."""
    columns = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return columns.mapInArrow(_predictor(spark.sparkContext.broadcast(network)), "doc_id long, lang_pred string, score double")


def identify(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document."""
    network = learn(spark, docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")))
    return predict(spark, docs, network).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def in_known_language(spark: SparkSession, docs: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """The rows of ``docs``, all columns, whose language is predicted with a score of ``least`` or more."""
    network = learn(spark, docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")))
    return docs.mapInArrow(_filter(spark.sparkContext.broadcast(network), docs.columns.index("text"), least), docs.schema)
