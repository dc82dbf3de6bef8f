"""Near copies: texts whose sets of 5-word shingles have a Jaccard similarity of 0.8 or more.

This is the form of the SimHash operator that works to a similarity instead of a radius. SimHash fingerprints of the shingle sets, linked by the
popcount range join of simhash.py, give the first candidates. A radius alone cannot bring all such texts together: at 0.8 fingerprints differ in 10 of 64 bits
on average, and a radius that covers that meets every other text in any index of its blocks. What lies beyond is found by MinHash: 25 bands of 5 minima of the
same hashes, where a pair of similarity s shares a band with probability 1 - (1 - s^5)^25: 0.99995 at 0.8, more above. Candidates of either kind are
links only if their whole shingle sets (as 64-bit hashes) confirm it; texts of equal sets are one class from the start.

The members of a band are never paired with each other at large. First each is compared with the band's hub (the least by an
order of its own), and the links' components are made. Where a member is in the hub's component, nothing
is left to find between it and others there. The other members of a band choose a few hubs among themselves, all at once. For those that are
still apart, exact candidates take the band's place. The shingles of the texts in question
are ordered by how many of those texts hold them, the rarest first; two texts of similarity 0.8 or more have one in common among the first fifth of the larger's and the
first ninth of the smaller's (prefix filter), with enough left after it in both. So texts that share a frequent passage and too little beside it make no pairs,
and none is lost.

Defined cases: letters A-Z count as a-z; a text of fewer than 5 words is one shingle; null and wordless texts are one class; a null doc_id
comes after all others; rows that repeat a doc_id with another text are documents of their own, identical rows are one; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cordage.llm.common import staged, trimmed
from cordage.llm.components import components
from cordage.llm.simhash import _LOWER, folded, links
from cordage.llm.suffix_dedup import _joined, _mixed

WIDTH, SIMILARITY, BANDS, ROWS = 5, 0.8, 25, 5
_NO_ID = (1 << 63) - 1
#: How many hubs those apart from a band's hub choose among themselves.
HUBS = 3
#: A size class of the prefix filter reaches from a power of this to the next.
SIZE_STEP = 1.05
#: Shingles whose minima are taken at a time.
_STRETCH = 1 << 12


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """The hashes of the text's distinct shingles, ascending."""
    words = (text or "").encode("utf-8", "replace").translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    with np.errstate(over="ignore"):
        return np.unique(_mixed(_joined(hashes, min(width, len(words)))))


def _bands(grams: np.ndarray, factors: np.ndarray, terms: np.ndarray, bands: int) -> list[int]:
    """A hash of each band's minima; none for a text without shingles."""
    if not len(grams):
        return []
    least = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(grams), _STRETCH):
        np.minimum(least, (grams[at : at + _STRETCH, None] * factors + terms).min(axis=0), out=least)
    return [xxhash.xxh64_intdigest(row.tobytes(), i) for i, row in enumerate(least.reshape(bands, -1))]


def _signed(values) -> np.ndarray:
    return np.array(values, np.uint64).view(np.int64)


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """Batches of few rows: what a worker held at its peak stays with it in later stages."""
    return (batch.slice(at, rows) for batch in batches for at in range(0, batch.num_rows, rows))


def _signatures(width: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng(7)
        factors = rng.integers(0, 1 << 63, bands * rows, np.uint64) * np.uint64(2) + np.uint64(1)
        terms = rng.integers(0, 1 << 63, bands * rows, np.uint64)
        for batch in _slices(batches):
            found, offsets, classes, prints = [], [0], [], []
            for text in batch.column(2):
                grams = shingles(text.as_py(), width)
                classes.append(xxhash.xxh64_intdigest(grams.tobytes()))
                prints.append(folded(grams))
                found += _bands(grams, factors, terms, bands)
                offsets.append(len(found))
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(_signed(found)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(_signed(classes)), pa.array(_signed(prints)), lists], ["doc", "text_hash", "cls", "fp", "bands"])

    return trimmed(run)


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            grams = [shingles(text.as_py(), width).view(np.int64) for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(grams, pa.list_(pa.int64()))], ["cls", "grams"])

    return trimmed(run)


def _place() -> tuple[Column, Column]:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("doc"), F.xxhash64(F.col("text").cast("string")).alias("text_hash")


def _by_prefix(classes: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(u, v): pairs of ``classes`` (cls, root, apart) that may be as similar, of different roots and with one apart at least; no such pair is missing.

    Texts meet in a shingle and a size class. The larger text of a pair looks into the classes within reach, with as much of it as must be
    left after the shingle for the smallest text of that class. So texts that share a frequent passage only do not meet in its
    shingles, and a frequent shingle is as many keys as there are sizes.
    """
    rows = staged(sets.join(classes.hint("merge"), "cls").select("cls", "root", "apart", "grams"), "question")
    every = rows.select("cls", F.explode("grams").alias("gram"))
    shared = staged(every.groupBy("gram").agg(F.count("*").alias("n")).filter("n > 1"), "shared")
    # A text's shingles that others hold too, the rarest first; those that it holds alone stand before them.
    held = every.join(shared.hint("merge"), "gram").groupBy("cls").agg(F.array_sort(F.collect_list(F.struct("n", "gram"))).alias("held"))
    rows = rows.withColumn("size", F.size("grams")).join(held.hint("merge"), "cls").withColumn("alone", F.col("size") - F.size("held"))
    first = (F.col("size") - F.ceil(F.col("size") * similarity - 1e-9) + 1 - F.col("alone")).cast("int")
    placed = rows.select("cls", "root", "apart", "size", "alone", F.posexplode(F.slice("held", F.lit(1), F.greatest(first, F.lit(0)))).alias("at", "h"))
    # How many shingles are left from here on, and the least that a pair of two sizes must have in common.
    placed = staged(placed.select("cls", "root", "apart", "size", (F.col("size") - F.col("alone") - F.col("at")).alias("left"), F.col("h.gram").alias("gram")), "prefixes")
    needed = lambda a, b: (a + b) * F.lit(similarity / (1 + similarity)) - 1e-9
    of = lambda size: F.floor(F.log(size.cast("double")) / F.lit(float(np.log(SIZE_STEP))) + 1e-9).cast("int")
    size, left = F.col("size"), F.col("left")
    v = placed.filter(left >= needed(size, size)).select("gram", of(size).alias("among"), *[F.col(c).alias(f"v_{c}") for c in ("cls", "root", "apart", "size", "left")])
    smallest = F.ceil(size * similarity - 1e-9)
    u = placed.withColumn("among", F.explode(F.sequence(of(smallest), of(size))))
    least = F.greatest(smallest.cast("double"), F.pow(F.lit(SIZE_STEP), F.col("among")) * (1 - 1e-6))
    u = u.filter(left >= needed(size, least)).select("gram", "among", *[F.col(c).alias(f"u_{c}") for c in ("cls", "root", "apart", "size", "left")])
    smaller = (F.col("v_size") < F.col("u_size")) | ((F.col("v_size") == F.col("u_size")) & (F.col("v_cls") < F.col("u_cls")))
    reach = F.least("u_left", "v_left") >= needed(F.col("u_size"), F.col("v_size"))
    fit = (F.col("u_root") != F.col("v_root")) & (F.col("u_apart") | F.col("v_apart")) & smaller & (F.col("v_size") >= F.col("u_size") * similarity - 1e-9) & reach
    # Both sides are files: a hot shingle of one size is one that Spark can split.
    met = staged(u, "larger").join(staged(v, "smaller").hint("merge"), ["gram", "among"]).filter(fit)
    return staged(met.select(F.col("u_cls").alias("u"), F.col("v_cls").alias("v")).distinct(), "pairs")


def _confirmed(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(u, v): the pairs whose shingle sets are as similar."""
    one = pairs.join(sets.select(F.col("cls").alias("u"), F.col("grams").alias("a")), "u")
    both = one.join(sets.select(F.col("cls").alias("v"), F.col("grams").alias("b")), "v")
    common = F.size(F.array_intersect("a", "b"))
    fit = F.least(F.size("a"), F.size("b")) >= F.greatest(F.size("a"), F.size("b")) * similarity
    return both.filter(fit).filter(common / (F.size("a") + F.size("b") - common) >= similarity).select("u", "v")


def _merged(roots: DataFrame, links: DataFrame) -> DataFrame:
    """(node, root) of the components ``roots`` with more links."""
    return components(roots.select(F.col("node").alias("u"), F.col("root").alias("v")).unionAll(links))


def _by_fingerprint(classes: DataFrame) -> DataFrame:
    """(cls, other): classes of one SimHash fingerprint with the least of them, and those least ones of fingerprints within 2 bits."""
    heads = staged(classes.groupBy("fp").agg(F.min("cls").alias("head")), "heads")
    of = lambda fp, head: heads.select(F.col("fp").alias(fp), F.col("head").alias(head)).hint("merge")
    across = links(heads).join(of("u", "cls"), "u").join(of("v", "other"), "v").select("cls", "other")
    return classes.join(of("fp", "other"), "fp").filter("cls != other").select("cls", "other").unionAll(across)


def _members(near: DataFrame, roots: DataFrame) -> DataFrame:
    """band, cls, root, apart (from the hub's component) of the members of bands of three or more, but for the hubs."""
    own = near.filter("n > 2").join(roots.withColumnsRenamed({"node": "cls", "root": "own"}).hint("merge"), "cls", "left")
    both = own.join(roots.withColumnsRenamed({"node": "hub", "root": "hubs"}).hint("merge"), "hub", "left")
    return staged(both.select("band", "cls", F.coalesce("own", "cls").alias("root"), (F.coalesce("own", "cls") != F.coalesce("hubs", "hub")).alias("apart")), "members")


def groups(spark: SparkSession, docs: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """cls, doc, text_hash (its least row's), root: the classes of equal shingle sets and the component of each."""
    base = docs.select(*_place(), F.col("text").cast("string").alias("text"))
    prints = staged(base.mapInArrow(_signatures(width, bands, rows), "doc long, text_hash long, cls long, fp long, bands array<long>"), "signatures")
    classes = staged(prints.groupBy("cls").agg(F.min(F.struct("doc", "text_hash")).alias("p"), F.any_value("fp").alias("fp"), F.any_value("bands").alias("bands")).select("cls", "p.*", "fp", "bands"), "classes")
    placed = classes.select("cls", F.explode("bands").alias("band"))
    # What is joined back is staged first: a join of two plain exchanges is one whose hot keys Spark can split.
    order = F.col("cls").bitwiseXOR(F.col("band"))
    hubs = staged(placed.groupBy("band").agg(F.count("*").alias("n"), F.min(order).alias("least")).filter("n > 1").select("band", "n", F.col("least").bitwiseXOR(F.col("band")).alias("hub")), "hubs")
    # Merged at any size: sending the shared bands to every task would hold for small tables only.
    near = staged(placed.join(hubs.hint("merge"), "band").filter("cls != hub"), "near")
    pairs = near.select("cls", F.col("hub").alias("other")).unionAll(_by_fingerprint(classes))
    pairs = staged(pairs.select(F.least("cls", "other").alias("u"), F.greatest("cls", "other").alias("v")).distinct(), "pairs")
    # Only the texts of classes that are in a pair are read again, once for both comparisons.
    named = staged(pairs.select(F.col("u").alias("cls")).unionAll(pairs.select("v")).distinct(), "named")
    wanted = staged(classes.select("cls", "doc", "text_hash").join(named.hint("merge"), "cls"), "wanted")
    # Repeated rows meet where the join has brought them together: the texts do not move again.
    texts = base.join(wanted.hint("merge"), ["doc", "text_hash"]).dropDuplicates(["doc", "text_hash", "cls"]).select("cls", "text")
    sets = staged(texts.mapInArrow(_sets(width), "cls long, grams array<long>"), "sets")
    roots = components(_confirmed(pairs, sets, similarity))

    members = _members(near, roots)
    # Those apart from their hub meet a few others of their own, so that what belongs together becomes one component before it is compared at large. All
    # in one go: a turn for each would cost the driver the plans and jobs of all components anew.
    apart = members.filter("apart")
    drawn = F.array_distinct(F.array(*[F.min_by(F.struct(F.col("cls").alias("other"), F.col("root").alias("theirs")), F.xxhash64("cls", "band", F.lit(i))) for i in range(HUBS)]))
    others = staged(apart.groupBy("band").agg(drawn.alias("drawn"), F.count("*").alias("m")).filter("m > 1").select("band", F.inline("drawn")), "others")
    again = apart.join(others.hint("merge"), "band").filter("root != theirs").select(F.least("cls", "other").alias("u"), F.greatest("cls", "other").alias("v")).distinct()
    again = staged(again, "pairs")
    if not again.isEmpty():
        roots = _merged(roots, _confirmed(again, sets, similarity))
        members = _members(near, roots)
    open_bands = staged(members.filter("apart").select("band").distinct(), "bands")
    if not open_bands.isEmpty():
        second = members.join(open_bands.hint("merge"), "band", "left_semi").groupBy("cls").agg(F.min("root").alias("root"), F.max("apart").alias("apart"))
        more = _by_prefix(second, sets, similarity)
        if not more.isEmpty():
            roots = _merged(roots, _confirmed(more, sets, similarity))
    return classes.join(roots.hint("merge"), classes.cls == roots.node, "left").select("cls", "doc", "text_hash", F.coalesce("root", "cls").alias("root"))


def without_near_copies(spark: SparkSession, docs: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """The rows of ``docs``, all columns, of one document per group of near copies: the one with the least id, by its text where ids are repeated."""
    found = groups(spark, docs, width, similarity, bands, rows)
    kept = staged(found.groupBy("root").agg(F.min(F.struct("doc", "text_hash")).alias("p")).select("p.doc", "p.text_hash"), "kept")
    # The caller's columns stay together under one name, so that none can clash.
    rows_kept = docs.select(*_place(), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).join(kept.hint("merge"), ["doc", "text_hash"], "left_semi")
    nth = F.row_number().over(Window.partitionBy("doc", "text_hash").orderBy(*[F.col(f"row.`{c}`") for c in ("source", "lang") if c in docs.columns] or ["doc"]))
    return rows_kept.withColumn("nth", nth).filter("nth = 1").select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
