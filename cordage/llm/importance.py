"""Importance resampling of documents towards a target: scores of hashed word features, then an exact draw of the best.

* Features are runs of 1 and 2 words, counted in 10,000 buckets over all documents and over the target. What a bucket is worth is one array of
  integers; a document's weight is the mean over its features, gathered from that array. Random ids' Gumbel noise makes the draw one without
  replacement in proportion to the weights.
* Every partition writes its scored documents as a sorted run. How often each score occurs gives the score at which the draw ends, so that no run is read
  further than that, and cuts the order into ranges whose first ranks are known.
* A range's task merges its pieces of all runs in a tournament tree, numbers the winners, and stops when the draw is complete. Runs are files
  in the shared folder, and a task holds one range: about ``RANGE_ROWS`` rows, or those of a single score.

Scores are whole numbers: noise lies in -3,136 .. 22,873, and a weight within 1,000 times the logarithm of the counts, so there are at most some
100,000 scores at any size, the rows that reach the driver. The array of gains is 10,000 numbers.

Defined cases: null and wordless texts have no features, weight 0 and are never drawn; a null doc_id counts as the empty id and comes after all others
of its score; rows that repeat a doc_id are documents of their own; an empty target or table is one of 0 features; an empty table gives no rows;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cordage.llm.common import plain_terms, staged, trimmed, whole_parts

BUCKETS, RUN, LEAST_WORDS, PERCENT, SEED = 10_000, 2, 20, 25, 7
#: Rows of a range, which one task merges.
RANGE_ROWS = 1 << 17


def feature_buckets(words: list[bytes], run: int = RUN, buckets: int = BUCKETS) -> np.ndarray:
    """The bucket of every run of 1 to ``run`` words, repeats included."""
    spaced = [b" " + w for w in words]
    level = list(map(zlib.crc32, words))
    found = [np.array(level, np.int64)]
    for n in range(1, min(run, len(words))):
        # The checksum of a longer run goes on from the shorter one's.
        level = list(map(zlib.crc32, spaced[n:], level))
        found.append(np.array(level, np.int64))
    return np.concatenate(found) % buckets


def _counts(run: int, buckets: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for text in batch.column(0):
                total += np.bincount(feature_buckets(plain_terms(text.as_py()), run, buckets), minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["bucket", "n"])

    return trimmed(count)


def bucket_counts(texts: DataFrame, run: int = RUN, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all rows fall in each bucket: every task sums its own, one row per bucket comes to the driver."""
    parts = texts.select(F.col("text").cast("string").alias("text")).mapInArrow(_counts(run, buckets), "bucket long, n long")
    out = np.zeros(buckets, np.int64)
    for r in parts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(own: np.ndarray, target: np.ndarray) -> np.ndarray:
    """What a feature of each bucket is worth: 1,000 times the log of its smoothed share in the target by that in the documents, rounded down."""
    n = len(own)
    all_own, all_target = float(own.sum() + n), float(target.sum() + n)
    worth = lambda s, t: math.floor(1000 * math.log((t + 1.0) * all_own / ((s + 1.0) * all_target)))
    return np.array([worth(s, t) for s, t in zip(own.tolist(), target.tolist(), strict=True)], np.int64)


def _weights(worth: np.ndarray, run: int):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = 0
        for batch in batches:
            words, features, weights = [], [], []
            for text in batch.column(1):
                terms = plain_terms(text.as_py())
                found = feature_buckets(terms, run, len(worth))
                words.append(len(terms))
                features.append(len(found))
                weights.append(int(worth[found].sum()) // len(found) if len(found) else 0)
            rows = range(at, at := at + batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (words, features, weights, rows))], ["doc_id", "n_words", "n_features", "weight", "at"])

    return trimmed(score)


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, of a hash of the seed and the id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def sorted_runs(docs: DataFrame, worth: np.ndarray, run: int = RUN, seed: int = SEED) -> DataFrame:
    """run, at, doc_id, n_words, n_features, weight, score: each partition's documents by falling score, as files."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.mapInArrow(_weights(worth, run), "doc_id long, n_words long, n_features long, weight long, at long")
    rows = rows.withColumns({"score": F.col("weight") + noise(F.col("doc_id"), seed), "run": F.spark_partition_id()})
    return staged(rows.sortWithinPartitions(F.desc("score"), F.asc_nulls_last("doc_id"), "at"), "runs")


class Tournament:
    """A tree of matches between the heads of sorted runs. When a winner leaves, its run's next head plays again along one path."""

    _LAST = (math.inf,)

    def __init__(self, runs: list[list[tuple]]):
        self.runs, self.next = runs, [1] * len(runs)
        self.size = 1 << max(0, len(runs) - 1).bit_length()
        self.heads = [r[0] if r else self._LAST for r in runs] + [self._LAST] * (self.size - len(runs))
        self.won = list(range(self.size)) * 2
        for i in range(self.size - 1, 0, -1):
            self._play(i)

    def _play(self, i: int) -> None:
        a, b = self.won[2 * i], self.won[2 * i + 1]
        self.won[i] = a if self.heads[a] <= self.heads[b] else b

    def __iter__(self) -> Iterator[tuple]:
        while self.runs:
            best = self.won[1] if self.size > 1 else 0
            if self.heads[best] is self._LAST:
                return
            yield self.heads[best]
            at = self.next[best]
            self.next[best] = at + 1
            self.heads[best] = self.runs[best][at] if at < len(self.runs[best]) else self._LAST
            i = (best + self.size) // 2
            while i:
                self._play(i)
                i //= 2


def _placed(lows: np.ndarray):
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # ``lows`` falls; the range of a score is the first whose least score is not above it.
            at = np.searchsorted(-lows, -batch.column("score").to_numpy())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at.astype(np.int64))], [*batch.schema.names, "range"])

    return place


_RUNS = ["run", "at", "doc_id", "n_features", "weight", "score"]


def _merged(before: np.ndarray, draw: int):
    """Ranks one range: what stands before it is known."""
    no_id = 1 << 63

    def merge(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        first = int(before[table.column("range")[0].as_py()])
        number, at, ids, score = (table.column(c).to_pylist() for c in ("run", "at", "doc_id", "score"))
        runs: dict[int, list[tuple]] = {}
        for row, r in enumerate(number):
            runs.setdefault(r, []).append((-score[row], no_id if ids[row] is None else ids[row], r, at[row], row))
        for keys in runs.values():
            # Pieces of a run come in its order, but a shuffle does not promise it.
            if any(a > b for a, b in zip(keys, keys[1:], strict=False)):
                keys.sort()
        ranks: list[int | None] = [None] * len(number)
        for rank, key in enumerate(Tournament([runs[r] for r in sorted(runs)]), first + 1):
            if rank > draw:
                break
            ranks[key[-1]] = rank
        return pa.table({c: table.column(c) for c in ("doc_id", "n_features", "weight", "score")} | {"rank": pa.array(ranks, pa.int64())})

    return merge


def resample(spark: SparkSession, docs: DataFrame, target: DataFrame, run: int = RUN, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED, range_rows: int = RANGE_ROWS) -> DataFrame:
    """doc_id, n_features, weight, score of every document (doc_id, text), and rank: 1, 2, 3 ... for those drawn towards ``target`` (text), else null."""
    worth = gains(bucket_counts(docs, run, buckets), bucket_counts(target, run, buckets))
    runs = sorted_runs(docs, worth, run, seed)
    eligible = F.col("n_words") >= least_words
    held = sorted(((r["score"], r["n"]) for r in runs.filter(eligible).groupBy("score").agg(F.count("*").alias("n")).collect()), reverse=True)
    draw = percent * sum(n for _, n in held) // 100
    result = ["doc_id", "n_features", "weight", "score"]
    if not draw:
        return runs.select(*result, F.lit(None).cast("long").alias("rank"))
    # Ranges of whole scores down to the one at which the draw ends: the least score of each, and the rows before it.
    most = max(1, min(range_rows, draw // (4 * whole_parts(spark))))
    lows, before, inside, done = [], [], 0, 0
    for score, n in held:
        if not inside:
            before.append(done)
        inside, done = inside + n, done + n
        if inside >= most or done >= draw:
            lows.append(score)
            inside = 0
        if done >= draw:
            break
    drawn = eligible & (F.col("score") >= lows[-1])
    kinds = dict(runs.dtypes)
    placed = runs.filter(drawn).select(*_RUNS).mapInArrow(_placed(np.array(lows)), ", ".join(f"{c} {kinds[c]}" for c in _RUNS) + ", range long")
    ranked = placed.groupBy("range").applyInArrow(_merged(np.array(before), draw), "doc_id long, n_features long, weight long, score long, rank long")
    return ranked.unionByName(runs.filter(~drawn).select(*result, F.lit(None).cast("long").alias("rank")))
