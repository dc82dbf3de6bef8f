"""SimHash near-duplicates: 64-bit fingerprints of whole texts, linked within a Hamming radius of 2.

A fingerprint is embedded as the bit counts of its sixteen 4-bit segments. The Manhattan distance
of two embeddings is a lower bound of the fingerprints' Hamming distance, so fingerprints within
radius 2 lie in cells that share a neighbour at Manhattan distance 1 or less from either: the
range join puts every fingerprint into its own cell and the up to 32 next to it. Where a cell has
two or more, the exact test follows: fingerprints are within 2 bits just if some 64-bit word is within
1 bit of both, and that word's embedding is the cell's. So those in such a cell list such words of that
cell (4 at most) and equal words are links. A word's fingerprints are linked to the least of them, which
keeps the components and makes as many links as fingerprints, never their pairs.

Defined cases: a null or wordless text has fingerprint 0, which links like any other; equal fingerprints
are one class; rows that repeat a doc_id each get a row; a null doc_id gets a fingerprint, but names no
component (component_id null if no other id is in it); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cordage.llm.common import staged, trimmed
from cordage.llm.components import components

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Shingles whose bits are counted at a time.
_STRETCH = 1 << 14


def folded(hashes: np.ndarray) -> int:
    """The fingerprint of shingles given by their hashes; 0 without any."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _STRETCH):
        counts += np.unpackbits(hashes[at : at + _STRETCH].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes)).tobytes(), "big")


def fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    """The unsigned fingerprint: a bit is 1 if set in over half of the shingles' hashes."""
    words = (text or "").encode("utf-8", "replace").translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(words) > width:
        starts, ends = starts[: len(words) - width + 1], ends[width - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest = xxhash.xxh64_intdigest
    return folded(np.fromiter((digest(joined[i:j], seed) for i, j in zip(starts.tolist(), ends.tolist(), strict=True)), np.uint64, len(starts)))


def _fingerprints(width: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.fromiter((fingerprint(t.as_py(), width, seed) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], ["doc_id", "fp"])

    return trimmed(run)


def fingerprints(docs: DataFrame, width: int = 3, seed: int = 42) -> DataFrame:
    """doc_id, fp (the fingerprint's bits as a long)."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_fingerprints(width, seed), "doc_id long, fp long")


def embedding(fp: Column) -> Column:
    """Bit counts of the sixteen 4-bit segments, 4 bits each."""
    ones = F.lit(0x1111111111111111)
    return sum((F.shiftrightunsigned(fp, i).bitwiseAND(ones) for i in (1, 2, 3)), fp.bitwiseAND(ones))


def _cells(fp: Column) -> Column:
    """The fingerprint's own cell and those at distance 1."""
    own = embedding(fp)

    def step(sign: int):
        def one(s: Column) -> Column:
            count = F.call_function("shiftrightunsigned", own, s * 4).bitwiseAND(F.lit(15))
            return F.when(count > 0 if sign < 0 else count < 4, own + F.lit(sign) * F.call_function("shiftleft", F.lit(1).cast("long"), s * 4))

        return F.transform(F.sequence(F.lit(0), F.lit(15)), one)

    return F.filter(F.concat(F.array(own), step(1), step(-1)), lambda c: c.isNotNull())


def _middles(fp: Column, cell: Column) -> Column:
    """The words within one bit of ``fp`` whose embedding is ``cell``, one of its cells."""
    moved = cell - embedding(fp)
    segment = F.shiftright((F.bit_count(F.abs(moved) - 1)).cast("int"), 2)

    def flip(b: Column) -> Column:
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), segment * 4 + b)
        return F.when((fp.bitwiseAND(bit) == 0) == (moved > 0), fp.bitwiseXOR(bit))

    flips = F.filter(F.transform(F.sequence(F.lit(0), F.lit(3)), flip), lambda m: m.isNotNull())
    return F.when(moved == 0, F.array(fp)).otherwise(flips)


def links(classes: DataFrame) -> DataFrame:
    """(u, v): links between distinct fingerprints ``fp`` whose components are those of all pairs within 2 bits."""
    placed = classes.select("fp", F.explode(_cells(F.col("fp"))).alias("cell"))
    # What is joined back is staged first: a join of two plain exchanges is one whose hot keys Spark can split.
    shared = staged(placed.groupBy("cell").agg(F.count("*").alias("n")).filter("n > 1").select("cell"), "cells")
    # Merged at any size: sending the shared cells to every task would hold for small tables only.
    near = placed.join(shared.hint("merge"), "cell")
    middles = staged(near.select("fp", F.explode(_middles(F.col("fp"), F.col("cell"))).alias("middle")), "middles")
    hub = staged(middles.groupBy("middle").agg(F.min("fp").alias("v"), F.max("fp").alias("w")).filter("v != w").select("middle", "v"), "hubs")
    return middles.join(hub, "middle").filter("fp != v").select(F.col("fp").alias("u"), "v")


def near_duplicates(spark: SparkSession, docs: DataFrame, width: int = 3, seed: int = 42) -> DataFrame:
    """doc_id, fp, component_id (the smallest doc_id reachable over links) of every document."""
    prints = staged(fingerprints(docs, width, seed), "fingerprints")
    classes = staged(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    roots = components(links(classes))
    member = classes.join(roots, classes.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    member = staged(member, "members")
    named = staged(member.groupBy("root").agg(F.min("least").alias("component_id")), "roots")
    named = staged(member.join(named, "root").select("fp", "component_id"), "named")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def hex_fingerprint(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
