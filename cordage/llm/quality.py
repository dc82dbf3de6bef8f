"""Quality classifier: a conditional random field over lines (see line_crf.py).

Learned from documents whose label is not in the held-out fold: of each label the LEARN_DOCUMENTS with the least id hash. Only
their lines' measures come to the driver. Scores read whole texts and nothing else.

Defined cases: a null text counts as empty, and an empty text is scored by its one empty line; without labels of both kinds
every score is 0.5; rows that repeat a doc_id each get a row; a document with both labels is learned with both; a null doc_id
counts as held out; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cordage.llm.common import held_out, trimmed
from cordage.llm.line_crf import MEASURES, LineCRF, measures

LEARN_DOCUMENTS = 2000
#: Bytes of text measured at a time.
STRETCH = 1_000_000


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [(t.as_py() or "").encode("utf-8", "replace") for t in batch.column(1)]
        if not texts:
            continue
        bins, _, counts = measures(texts)
        ends = np.cumsum(counts)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([bins[a:b].tobytes() for a, b in zip(ends - counts, ends, strict=True)], pa.binary())], ["quality", "bins"])


def learn(spark: SparkSession, docs: DataFrame, labels: DataFrame, documents: int = LEARN_DOCUMENTS) -> LineCRF | None:
    """The field, or None unless both labels are there."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).filter(F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id"))).distinct()
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    picked = known.filter("quality = 0").orderBy(*order).limit(documents).unionAll(known.filter("quality = 1").orderBy(*order).limit(documents))
    # At most twice ``documents`` ids.
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(picked), "doc_id")
    found = rows.select("quality", "text").mapInArrow(_measured, "quality int, bins binary").orderBy("bins", "quality").collect()
    if len({r["quality"] for r in found}) < 2:
        return None
    bins = [np.frombuffer(r["bins"], np.uint8).reshape(-1, MEASURES) for r in found]
    field = LineCRF()
    field.fit(np.concatenate(bins), np.array([len(b) for b in bins]), np.array([r["quality"] for r in found]))
    return field


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])


def _scorer(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = model.value
        for batch in batches:
            scores: list[float] = []
            texts, size = [], 0
            for k in range(batch.num_rows):
                texts.append((batch.column(1)[k].as_py() or "").encode("utf-8", "replace"))
                size += len(texts[-1])
                if size >= STRETCH or k == batch.num_rows - 1:
                    scores += [0.5] * len(texts) if field is None else field.documents(texts).tolist()
                    texts, size = [], 0
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], schema=_SCHEMA)

    return trimmed(run)


def score(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    field = learn(spark, docs, labels)
    columns = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = columns.mapInArrow(_scorer(spark.sparkContext.broadcast(field)), "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
