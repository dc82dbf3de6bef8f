"""Repeated passages by a sparse suffix array over words.

Kept positions. Every run of 10 words has a hash; of the 41 such runs in a window of 50 words the least is the window's
minimiser. Equal windows have equal minimisers, so only suffixes at minimiser positions are kept (about 1 word in 21), and a
passage of 50 words or more that stands in two places has a kept position in both, with the same minimiser.

Sort and compare. Kept suffixes are sorted by their words, over all documents: dealt by ranges and sorted there. Each is compared with the
suffixes before and after it, and those that have fewer than 10 words in common with either are dropped. The order is that of the words' hashes, of
which 16 bits are kept (the minimiser's 64 bits decide between suffixes equal by these), then of the documents, so that a suffix that
a third of all texts hold is dealt to many tasks; where two ranges meet, their last and first suffix are compared apart.

Extend. From a kept position that has neighbours, windows reach left as far as it stays their minimiser, and right over the
50 words of each: those windows, in order, are the position's block. Blocks that are equal as a whole are one class with a count, so copies
are never expanded; only where a minimiser has blocks that differ, or a block repeats windows of its own, the classes' windows are compared one by one. Windows
that match and overlap make up the whole passage, to its first and last equal word.

A passage's first place, by (doc_id, word), stays; the others are for removal.

Defined cases: null and empty texts and texts below 50 words have no passage; a passage may repeat inside one text, and may
overlap itself; rows that repeat a doc_id are reported together, spans of all their texts; identical rows repeat each other, but
both count as the first place; a null doc_id comes first and is reported as null, and so is the id -2 ** 63; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cordage.llm.common import staged, trimmed, whole_parts

PASSAGE, GRAM = 50, 10
_NO_ID = -(1 << 63)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _hashes(text: str) -> np.ndarray:
    words = text.encode("utf-8", "replace").split()
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def _joined(values: np.ndarray, length: int) -> np.ndarray:
    """A polynomial hash of every run of ``length`` values, by doubling."""
    whole, size, power = values, 1, _BASE
    out, done = None, 0
    while True:
        if length & size:
            if out is None:
                out, done, scale = whole, size, power
            else:  # what is done goes on to the right of ``whole``
                n = len(values) - (done + size) + 1
                out, done, scale = whole[:n] * scale + out[size : size + n], done + size, scale * power
        if size * 2 > length:
            return out
        whole = whole[: len(whole) - size] * power + whole[size:]
        size, power = size * 2, power * power


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(29))


def _slid(values: np.ndarray, length: int, pick) -> np.ndarray:
    """The least (or greatest, by ``pick``) of every run of ``length`` values."""
    whole, size = values, 1
    while size * 2 <= length:
        whole = pick(whole[: len(whole) - size], whole[size:])
        size *= 2
    n = len(values) - length + 1
    return pick(whole[:n], whole[length - size : length - size + n])


def minimisers(words: np.ndarray, passage: int = PASSAGE, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """(the minimiser of every window, the hash of every window); the words' hashes are given, at least ``passage`` of them."""
    with np.errstate(over="ignore"):
        grams = _mixed(_joined(words, gram))
        return _slid(grams, passage - gram + 1, np.minimum), _mixed(_joined(words, passage))


_SUFFIX = pa.schema([("key", pa.int64()), ("suffix", pa.binary()), ("doc", pa.int64()), ("n", pa.int64())])


def _kept(passage: int, gram: int):
    """key (the minimiser), suffix (its words), doc, n (how often the text has it) of every kept suffix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys, counts, suffixes = [], [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = _hashes(text.as_py() or "")
                if len(words) < passage:
                    continue
                least, _ = minimisers(words, passage, gram)
                with np.errstate(over="ignore"):
                    grams = _mixed(_joined(words, gram))
                # Positions that are the minimiser of some window: the greatest minimum over the windows around them is theirs.
                width = passage - gram + 1
                padded = np.concatenate([np.zeros(width - 1, np.uint64), least, np.zeros(width - 1, np.uint64)])
                at = np.flatnonzero(_slid(padded, width, np.maximum) == grams)
                key, first, count = np.unique(grams[at], return_index=True, return_counts=True)
                suffixes.append((words >> np.uint64(48)).astype(">u2")[at[first][:, None] + np.arange(gram)])
                ids.append(np.full(len(key), doc_id, np.int64))
                keys.append(key.view(np.int64))
                counts.append(count)
            if ids:
                total = sum(map(len, keys))
                raw = pa.FixedSizeBinaryArray.from_buffers(pa.binary(2 * gram), total, [None, pa.py_buffer(np.concatenate(suffixes).tobytes())])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), raw.cast(pa.binary()), pa.array(np.concatenate(ids)), pa.array(np.concatenate(counts).astype(np.int64))], schema=_SUFFIX)

    return trimmed(run)


_NEAR = pa.schema([("key", pa.int64()), ("doc", pa.int64()), ("shared", pa.bool_()), ("edge", pa.bool_())])


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the sorted suffixes of a range: those equal to the one before or after, or met twice in their text (shared), and the first and the
    last (edge), whose neighbour may be in another range."""

    def found(batch: pa.RecordBatch, alike: np.ndarray, first: bool, last: bool) -> pa.RecordBatch:
        shared, edge = alike | (batch.column("n").to_numpy() > 1), np.zeros(batch.num_rows, bool)
        edge[0], edge[-1] = first or (last and batch.num_rows == 1), last or (first and batch.num_rows == 1)
        return pa.RecordBatch.from_arrays([batch.column("key"), batch.column("doc"), pa.array(shared), pa.array(edge)], schema=_NEAR).filter(pa.array(shared | edge))

    held, before, first = None, None, True
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column("key").to_numpy()
        words = np.frombuffer(b"".join(batch.column("suffix").to_pylist()), ">u2").reshape(len(key), -1)
        same = (key[1:] == key[:-1]) & (words[1:] == words[:-1]).all(axis=1)
        alike = np.concatenate([[False], same]) | np.concatenate([same, [False]])
        if held is not None:
            meets = bool(key[0] == before[0] and (words[0] == before[1]).all())
            alike[0] |= meets
            held[1][-1] |= meets
            yield found(*held, first, False)
            first = False
        held, before = (batch, alike), (key[-1], words[-1])
    if held is not None:
        yield found(*held, first, True)


def shared_suffixes(spark: SparkSession, kept: DataFrame) -> DataFrame:
    """key, doc of the kept suffixes that have a neighbour with as many words in common as a minimiser has. ``kept`` should be staged."""
    order = ["suffix", "key", "doc"]
    ranges = kept.repartitionByRange(whole_parts(spark), *order).sortWithinPartitions(*order)
    near = staged(ranges.mapInArrow(trimmed(_neighbours), "key long, doc long, shared boolean, edge boolean"), "neighbours")
    # Two rows per range: those of one key stand on both sides of a seam.
    seams = near.filter("edge").groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key")
    across = near.filter("edge AND NOT shared").join(F.broadcast(seams), "key", "left_semi").select("key", "doc")
    return near.filter("shared").select("key", "doc").unionAll(across)


_BLOCK = pa.schema([("key", pa.int64()), ("block", pa.int64()), ("doc", pa.int64()), ("low", pa.int64()), ("windows", pa.list_(pa.int64()))])


def _blocks(passage: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            size = 0
            for doc_id, text, shared in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                words = _hashes(text.as_py() or "")
                if len(words) < passage:
                    continue
                least, windows = minimisers(words, passage, gram)
                keys = np.asarray(shared.values, np.int64).view(np.uint64)
                inside = np.isin(least, keys)
                if not inside.any():
                    continue
                new = np.ones(len(least), bool)
                new[1:] = least[1:] != least[:-1]
                starts = np.flatnonzero(new)
                ends = np.append(starts[1:], len(least))
                for a, b in zip(starts[inside[starts]].tolist(), ends[inside[starts]].tolist(), strict=True):
                    raw = windows[a:b].tobytes()
                    out.append((int(least[a].view(np.int64)), int(np.uint64(xxhash.xxh64_intdigest(raw)).view(np.int64)), doc_id, a, windows[a:b].view(np.int64)))
                    size += b - a
                if size > 500_000:
                    yield _written(out)
                    out, size = [], 0
            if out:
                yield _written(out)

    return trimmed(run)


def _written(rows: list[tuple]) -> pa.RecordBatch:
    key, block, doc, low, windows = zip(*rows, strict=True)
    offsets = np.concatenate(([0], np.cumsum([len(w) for w in windows]))).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(windows)))
    return pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(block, pa.int64()), pa.array(doc, pa.int64()), pa.array(low, pa.int64()), lists], schema=_BLOCK)


def repeated_spans(spark: SparkSession, docs: DataFrame, passage: int = PASSAGE, gram: int = GRAM) -> DataFrame:
    """doc, start, end (words, end exclusive), later: stretches of windows that repeat, those of a document overlapping where they do."""
    base = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("doc"), F.col("text").cast("string").alias("text"))
    kept = staged(base.mapInArrow(_kept(passage, gram), "key long, suffix binary, doc long, n long"), "kept")
    per_text = staged(shared_suffixes(spark, kept).groupBy("doc").agg(F.collect_set("key").alias("keys")), "shared")
    texts = base.join(per_text.hint("merge"), "doc").select("doc", "text", "keys")
    blocks = staged(texts.mapInArrow(_blocks(passage, gram), "key long, block long, doc long, low long, windows array<long>"), "blocks")

    place = F.struct("doc", "low", "windows")
    # What is joined back is staged first: a join of two plain exchanges is one whose hot keys Spark can split.
    classes = staged(blocks.groupBy("key", "block").agg(F.count("*").alias("n"), F.min(place).alias("p")).select("key", "block", "n", "p.*"), "classes")
    differ = staged(classes.groupBy("key").agg(F.count("*").alias("kinds")), "kinds")
    marked = classes.join(differ.hint("merge"), "key")
    # A block that repeats windows of its own has later ones inside even its first place.
    whole = (F.col("kinds") == 1) & (F.col("n") > 1) & (F.size(F.array_distinct("windows")) == F.size("windows"))
    plain = marked.filter(whole).select("block", F.lit(0).cast("long").alias("from"), (F.size("windows") - 1).cast("long").alias("to"), F.col("doc").alias("first_doc"), F.col("low").alias("first_at"))
    opened = staged(marked.filter(~whole).select("block", "n", "doc", "low", F.posexplode("windows").alias("at", "window")), "windows")
    first = staged(opened.groupBy("window").agg(F.sum("n").alias("n"), F.min(F.struct("doc", (F.col("low") + F.col("at")).alias("pos"))).alias("f")).filter("n > 1").select("window", "f.*"), "first")
    matched = opened.select("block", F.col("at").cast("long").alias("at"), "window").join(first.withColumnsRenamed({"doc": "first_doc", "pos": "first_pos"}).hint("merge"), "window").select("block", "at", "first_doc", (F.col("first_pos") - F.col("at")).alias("first_at"))
    # Windows in a row whose first places are in a row too: one stretch. A block has as many windows as a text has words, at most.
    in_row = F.row_number().over(Window.partitionBy("block", "first_doc", "first_at").orderBy("at"))
    stretches = matched.withColumn("run", F.col("at") - in_row).groupBy("block", "first_doc", "first_at", "run").agg(F.min("at").alias("from"), F.max("at").alias("to"))
    every = staged(plain.unionByName(stretches.select("block", "from", "to", "first_doc", "first_at")), "stretches")
    placed = blocks.select("block", "doc", "low").join(every.hint("merge"), "block")
    later = (F.col("doc") != F.col("first_doc")) | (F.col("low") != F.col("first_at"))
    return placed.select("doc", (F.col("low") + F.col("from")).alias("start"), (F.col("low") + F.col("to") + passage).alias("end"), later.alias("later"))


def _merged(spans: DataFrame, out: str) -> DataFrame:
    """doc, ``out``: the document's spans, those that overlap or touch as one, as start:end joined by commas; and their words."""
    order = Window.partitionBy("doc").orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = spans.withColumn("new", F.when(F.col("start") <= F.coalesce(reach, F.lit(-1)), 0).otherwise(1))
    islands = new.withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0))).groupBy("doc", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    lists = islands.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("s"), F.sum(F.col("end") - F.col("start")).alias(f"{out}_words"))
    text = F.array_join(F.transform("s", lambda x: F.concat_ws(":", x["start"].cast("string"), x["end"].cast("string"))), ",")
    return lists.select("doc", F.size("s").cast("long").alias(f"n_{out}"), f"{out}_words", text.alias(out))


def repeated_passages(spark: SparkSession, docs: DataFrame, passage: int = PASSAGE, gram: int = GRAM) -> DataFrame:
    """doc_id, n_spans, spans_words, spans (every repeated passage), later_words, later (those that stood earlier) of the documents that have any."""
    spans = staged(repeated_spans(spark, docs, passage, gram), "spans")
    found, removed = _merged(spans, "spans"), _merged(spans.filter("later"), "later")
    rows = found.join(removed, "doc", "left")
    doc_id = F.when(F.col("doc") != _NO_ID, F.col("doc"))
    return rows.select(doc_id.alias("doc_id"), "n_spans", "spans_words", "spans", F.coalesce("later_words", F.lit(0)).cast("long").alias("later_words"), F.coalesce("later", F.lit("")).alias("later"))
