"""MinHash near-duplicates by odd sketches: texts whose sets of 4-word shingles have a Jaccard similarity of 0.8 or more.

A text's set has 200 MinHash samples. They serve twice. In 40 bands of 5 they bring texts together: a pair of similarity s shares a band with probability
1 - (1 - s^5)^40, which misses one pair in 7 million at 0.8 and fewer above. And they are folded into an odd sketch: 512 bits, each the parity of the samples that fall
on it. Samples that two texts have in common cancel out where two sketches are combined by XOR, so with m bits left of n, and k samples, the
similarity is about 1 + n / 4k * ln(1 - 2m / n), the more precise the nearer to 1. Candidates estimated below 0.6 (at 0.8 that is 5 deviations off, see the tests)
go; all others are confirmed on their whole sets, so that estimates never make a link.

The members of a band are never paired with each other at large: each is compared with the band's hub. Where the links leave members
out of their hub's component, those are compared by the exact prefix filter of near_copies.py, and by sketches, before whole sets are.
Equal sets are one class from the start, known by 128 bits of hash.

Defined cases: letters A-Z count as a-z; a text of fewer than 4 words is one shingle; null and wordless texts have none and are linked with
nothing; a null doc_id names no component (component_id null if no other id is in it; kept, if so); rows that repeat a doc_id each get a row;
an empty table gives no rows; other columns are ignored, whatever their names.
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
from cordage.llm.near_copies import _by_prefix, _confirmed, _merged, _sets, _slices, shingles

WIDTH, SIMILARITY, BANDS, ROWS, BITS = 4, 0.8, 40, 5, 512
#: Candidates whose sketches estimate less than this are not looked at.
LEAST_ESTIMATE = 0.6
#: Shingles whose samples are taken at a time.
_STRETCH = 1 << 11


def draws(samples: int) -> tuple[np.ndarray, np.ndarray]:
    """Factor and term of each sample's hash function."""
    rng = np.random.default_rng(13)
    return rng.integers(0, 1 << 31, samples, np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 1 << 32, samples, np.uint32)


def minima(grams: np.ndarray, factors: np.ndarray, terms: np.ndarray) -> np.ndarray:
    """The MinHash samples of a set: 32 bits of each shingle's hash, under each hash function."""
    short = (grams >> np.uint64(32)).astype(np.uint32)
    least = np.full(len(factors), np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(short), _STRETCH):
        np.minimum(least, (short[at : at + _STRETCH, None] * factors + terms).min(axis=0), out=least)
    return least


def sketch(samples: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The parity, for every bit, of the samples that fall on it; as 64-bit words. Equal values of two samples are different elements."""
    places = [xxhash.xxh64_intdigest(s.tobytes(), i) % bits for i, s in enumerate(samples)]
    return np.packbits(np.bincount(places, minlength=bits) & 1).astype(np.uint8).view(">u8").astype(np.uint64)


def estimate(differing: Column, samples: int, bits: int = BITS) -> Column:
    """The similarity that so many differing bits speak for; 0 from half of all bits on, where nothing can be told."""
    full = F.lit(1.0) - F.lit(2.0 / bits) * differing
    return F.when(full > 0, F.greatest(F.lit(0.0), F.lit(1.0) + F.lit(bits / (4.0 * samples)) * F.log(full))).otherwise(0.0)


def _signatures(width: int, bands: int, rows: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors, terms = draws(bands * rows)
        for batch in _slices(batches):
            sizes, keys, banded, sketches = [], [], [], []
            for text in batch.column(2):
                grams = shingles(text.as_py(), width)
                sizes.append(len(grams))
                if not len(grams):
                    for column in (keys, banded, sketches):
                        column.append(None)
                    continue
                keys.append(xxhash.xxh3_128_digest(grams.tobytes()))
                samples = minima(grams, factors, terms)
                banded.append(np.array([xxhash.xxh64_intdigest(row.tobytes(), i) for i, row in enumerate(samples.reshape(bands, rows))], np.uint64).view(np.int64))
                sketches.append(sketch(samples, bits).view(np.int64))
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(banded, longs), pa.array(sketches, longs)], ["doc_id", "text_hash", "n_shingles", "key", "bands", "sketch"])

    return trimmed(run)


def _near(pairs: DataFrame, classes: DataFrame, samples: int, bits: int) -> DataFrame:
    """The pairs (u, v) whose sketches let them be similar enough."""
    of = lambda name, out: classes.select(F.col("cls").alias(name), F.col("sketch").alias(out)).hint("merge")
    both = pairs.join(of("u", "a"), "u").join(of("v", "b"), "v")
    differing = F.aggregate(F.zip_with("a", "b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
    return staged(both.filter(estimate(differing, samples, bits) >= LEAST_ESTIMATE).select("u", "v"), "near")


def _place() -> tuple[Column, Column, Column]:
    """What a text is read again by: its id, whether that is null, and its hash."""
    return F.coalesce("doc_id", F.lit(0)).alias("id"), F.isnull("doc_id").alias("no_id"), F.col("text_hash")


def near_duplicates(spark: SparkSession, docs: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, bits: int = BITS) -> DataFrame:
    """doc_id, n_shingles, component_id (the least doc_id reachable over links), kept (whether that is its own) of every document (doc_id, text)."""
    text = F.col("text").cast("string")
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    prints = base.mapInArrow(_signatures(width, bands, rows, bits), "doc_id long, text_hash long, n_shingles long, key binary, bands array<long>, sketch array<long>")
    # A class is known by the number of one of its rows, which lasts as the rows are files.
    prints = staged(prints.withColumn("row", F.monotonically_increasing_id()), "signatures")
    first = F.min(F.struct("row", "doc_id", "text_hash")).alias("first")
    # Equal sets have equal bands and sketches.
    heads = prints.filter("n_shingles > 0").groupBy("key").agg(first, F.min("doc_id").alias("least"), F.any_value("bands").alias("bands"), F.any_value("sketch").alias("sketch"))
    heads = staged(heads.select("key", F.col("first.row").alias("cls"), "least", F.col("first.doc_id").alias("doc_id"), F.col("first.text_hash").alias("text_hash"), "bands", "sketch"), "heads")

    placed = heads.select("cls", F.explode("bands").alias("band"))
    # One order for all bands, so that the texts of a group meet few hubs. What is joined back is staged first: a join of two plain exchanges is one whose hot keys Spark can split.
    hubs = staged(placed.groupBy("band").agg(F.count("*").alias("n"), F.min("cls").alias("hub")).filter("n > 1"), "hubs")
    # Merged at any size: sending the shared bands to every task would hold for small tables only.
    met = staged(placed.join(hubs.hint("merge"), "band").filter("cls != hub"), "met")
    pairs = staged(met.select(F.least("cls", "hub").alias("u"), F.greatest("cls", "hub").alias("v")).distinct(), "pairs")
    near = _near(pairs, heads, bands * rows, bits)
    # The texts of all classes that met are read again, once for both comparisons.
    named = staged(met.select("cls").unionAll(met.select("hub")).distinct(), "named")
    wanted = staged(heads.select("cls", "doc_id", "text_hash").join(named.hint("merge"), "cls").select("cls", *_place()), "wanted")
    # Repeated rows meet where the join has brought them together: the texts do not move again.
    place = ["id", "no_id", "text_hash"]
    texts = base.select(*_place(), "text").join(wanted.hint("merge"), place).dropDuplicates([*place, "cls"]).select("cls", "text")
    sets = staged(texts.mapInArrow(_sets(width), "cls long, grams array<long>"), "sets")
    roots = components(_confirmed(near, sets, similarity))

    own = met.filter("n > 2").join(roots.withColumnsRenamed({"node": "cls", "root": "own"}).hint("merge"), "cls", "left")
    both = own.join(roots.withColumnsRenamed({"node": "hub", "root": "hubs"}).hint("merge"), "hub", "left")
    members = staged(both.select("band", "cls", F.coalesce("own", "cls").alias("root"), (F.coalesce("own", "cls") != F.coalesce("hubs", "hub")).alias("apart")), "members")
    open_bands = staged(members.filter("apart").select("band").distinct(), "bands")
    if not open_bands.isEmpty():
        second = members.join(open_bands.hint("merge"), "band", "left_semi").groupBy("cls").agg(F.min("root").alias("root"), F.max("apart").alias("apart"))
        more = _near(_by_prefix(second, sets, similarity), heads, bands * rows, bits)
        if not more.isEmpty():
            roots = _merged(roots, _confirmed(more, sets, similarity))

    rooted = staged(heads.join(roots.hint("merge"), heads.cls == roots.node, "left").select("key", "least", F.coalesce("root", "cls").alias("root")), "rooted")
    named = staged(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "components")
    named = staged(rooted.join(named.hint("merge"), "root").select("key", "component_id"), "named")
    linked = prints.filter("n_shingles > 0").join(named.hint("merge"), "key").select("doc_id", "n_shingles", "component_id")
    alone = prints.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"
#: Pairs of texts by what they share. Texts are told apart by their sets first, so that copies are not paired.
ORACLE_SQL = f"""
WITH RECURSIVE word AS (SELECT doc_id, {_WORDS} AS w FROM documents),
own AS (SELECT doc_id, CASE WHEN w IS NULL OR len(w) = 0 THEN [] ELSE list_sort(list_distinct(list_transform(range(1, greatest(len(w) - 3, 1) + 1), lambda i: array_to_string(w[i:i + 3], ' ')))) END AS grams FROM word),
kind AS (SELECT min(doc_id) AS cls, grams FROM own WHERE len(grams) > 0 GROUP BY grams),
gram AS (SELECT cls, len(grams) AS n, unnest(grams) AS g FROM kind),
pair AS (SELECT a.cls AS u, b.cls AS v FROM gram a JOIN gram b ON a.g = b.g AND a.cls < b.cls GROUP BY a.cls, b.cls, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
link AS (SELECT u, v FROM pair UNION SELECT v, u FROM pair),
reach AS (SELECT cls AS u, cls AS v FROM kind UNION SELECT reach.u, link.v FROM reach JOIN link ON reach.v = link.u),
root AS (SELECT u AS cls, min(v) AS root FROM reach GROUP BY u)
SELECT doc_id, CAST(len(own.grams) AS BIGINT) AS n_shingles, coalesce(root, doc_id) AS component_id, coalesce(root, doc_id) = doc_id AS kept
FROM own LEFT JOIN kind ON own.grams = kind.grams LEFT JOIN root USING (cls)
"""
