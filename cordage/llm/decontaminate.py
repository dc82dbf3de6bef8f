"""Benchmark decontamination, with DataFrame functions only.

Words are runs of letters and digits, lower-cased; a shingle is 5 words (an item with fewer words is one
shingle). A window has as many words as the item. The share of shingles that window and item have in common, repeats
counted (sum of lesser counts by sum of greater counts), must reach 0.8.

* Places: positions of a text whose shingle stands in some item of that size, found by a join of shingle hashes that knows sizes, but no items.
  A best window can start at such a place (moved on to the next one it loses nothing; a window that would pass the text's end is
  moved back to it), and must hold as many of them as 0.8 needs.
* SimHash: a window's shingles at places, and an item's shingles, give 128 bits, two words of 64. What stands in no item says nothing of
  which item it is and is left out. At 0.8 a pair so differs in 14 bits on average.
* Multi-index Hamming blocks: 16 blocks of 8 bits. Windows and items of a size meet where a block is equal, and nowhere else.
  Any pair that differs in 7 bits of one of the words or fewer is met for certain; of pairs just at 0.8 at least 995 in 1,000 are met (see the tests).
* The exact similarity of those pairs decides.

Defined cases: items and texts that are null or wordless match nothing; rows that repeat a doc_id with other texts are looked at apart
and reported together; a null doc_id is reported as such; an empty table on either side gives no rows; of windows as similar
the first is reported; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cordage.llm.common import staged

#: Words of a shingle; least similarity; bits of one word of a fingerprint within which its blocks must meet; words of a fingerprint.
SHINGLE, SIMILARITY, RADIUS, PARTS = 5, 0.8, 7, 2
#: Shingle rows of the benchmark up to which they are sent to every executor (24 bytes a row).
SENT_ROWS = 500_000


def _word_hashes(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), lambda w: F.xxhash64(w))


def _shingles(words: Column, width: int) -> Column:
    """Hashes of all runs of ``width`` words; none where there are fewer words."""
    at = lambda i: [F.get(words, i + j) for j in range(width)]
    return F.when(F.size(words) >= width, F.transform(F.sequence(F.lit(0), F.size(words) - width), lambda i: F.xxhash64(*at(i)))).otherwise(F.array().cast("array<long>"))


def simhash(shingles: Column) -> Column:
    """64 bits; a bit is set where over half of the shingles have it set."""
    def bit(b: Column) -> Column:
        one = F.aggregate(shingles, F.lit(0), lambda n, h: n + F.call_function("shiftrightunsigned", h, b).bitwiseAND(F.lit(1)).cast("int"))
        return F.when(one * 2 > F.size(shingles), F.call_function("shiftleft", F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long"))

    bits = F.transform(F.sequence(F.lit(0), F.lit(63)), bit)
    return F.aggregate(bits, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))


def blocks(fp: Column, radius: int = RADIUS, part: int = 0) -> Column:
    """(block, its bits): radius + 1 blocks of a word, one of which is equal in any two words within the radius."""
    n = radius + 1
    edges = [round(64 * i / n) for i in range(n + 1)]
    return F.array(*[F.struct(F.lit(part * n + i).alias("block"), F.shiftrightunsigned(fp, a).bitwiseAND(F.lit((1 << (b - a)) - 1)).alias("bits")) for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False))])


def all_blocks(shingles: Column, radius: int = RADIUS, parts: int = PARTS) -> Column:
    """The blocks of all words of a fingerprint; each word hashes the shingles anew."""
    def part(p: int) -> Column:
        return blocks(simhash(F.transform(shingles, lambda h: F.xxhash64(h, F.lit(p)))), radius, p)

    return F.concat(*[part(p) for p in range(parts)])


def common(a: Column, b: Column) -> Column:
    """Sum of lesser counts over two arrays of hashes."""
    plain = (F.size(F.array_distinct(a)) == F.size(a)) & (F.size(F.array_distinct(b)) == F.size(b))
    count = lambda x, h: F.size(F.filter(x, lambda y: y == h))
    counted = F.aggregate(F.array_intersect(a, b), F.lit(0), lambda n, h: n + F.least(count(a, h), count(b, h)))
    return F.when(plain, F.size(F.array_intersect(a, b))).otherwise(counted)


def _items(items: DataFrame) -> DataFrame:
    """item_id, length (words), width (of a shingle), shingles."""
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), _word_hashes(F.col("text").cast("string")).alias("words"))
    width = F.least(F.size("words"), F.lit(SHINGLE))
    made = reduce(lambda e, k: e.when(F.col("width") == k, _shingles(F.col("words"), k)), range(2, SHINGLE + 1), F.when(F.col("width") == 1, _shingles(F.col("words"), 1)))
    return rows.withColumn("width", width).select("item_id", F.size("words").alias("length"), "width", made.alias("shingles"))


def _places(docs: DataFrame, known: DataFrame, sizes: dict[int, int]) -> DataFrame:
    """doc_id, text_hash, length, span (shingles of an item), n (shingles of the text), at, h: the shingles of a text that some item of ``length`` words has."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter(F.length("text") > 0)
    base = base.select("doc_id", F.xxhash64("text").alias("text_hash"), _word_hashes(F.col("text")).alias("words"))
    found = []
    for width in sorted(sizes):
        wanted = known.filter(F.col("width") == width).select("length", F.explode("shingles").alias("h")).distinct()
        wanted = F.broadcast(wanted) if sizes[width] <= SENT_ROWS else wanted
        # The outer form, as the other one also filters by the array's size, which would compute the array twice.
        every = base.select("doc_id", "text_hash", F.greatest(F.size("words") - width + 1, F.lit(0)).alias("n"), F.posexplode_outer(_shingles(F.col("words"), width)).alias("at", "h"))
        found.append(every.join(wanted, "h").select("doc_id", "text_hash", "length", (F.col("length") - width + 1).alias("span"), "n", "at", "h"))
    return reduce(DataFrame.unionAll, found)


def windows(places: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """doc_id, text_hash, length, span, first (shingle of the window), size (its shingles), window (those of them at places): windows with enough places."""
    rows = places.groupBy("doc_id", "text_hash", "length", "span", "n").agg(F.array_sort(F.collect_set(F.struct("at", "h"))).alias("places"))
    size, held = F.least("n", "span"), F.size("places")
    rows = rows.withColumns({"size": size, "needed": F.greatest(F.ceil(F.lit(threshold / (1 + threshold)) * (size + F.col("span")) - 1e-9), F.lit(1)).cast("int"), "last": F.col("n") - size})
    place = lambda i: F.get(F.col("places"), i)["at"]
    # From a place on: whether the place that completes the number needed is still inside.
    enough = lambda p, i: F.when(p["at"] <= F.col("last"), place(i + F.col("needed") - 1) - p["at"] < F.col("span")).otherwise(held - i >= F.col("needed"))
    starts = F.transform(F.filter("places", lambda p, i: F.coalesce(enough(p, i), F.lit(False))), lambda p: F.least(p["at"], F.col("last")))
    rows = rows.select("*", F.explode(F.array_distinct(starts)).alias("first"))
    inside = F.filter("places", lambda p: (p["at"] >= F.col("first")) & (p["at"] < F.col("first") + F.col("size")))
    return rows.select("doc_id", "text_hash", "length", "span", "first", "size", F.transform(inside, lambda p: p["h"]).alias("window"))


def matches(spark: SparkSession, docs: DataFrame, items: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """doc_id, text_hash, item_id, similarity, first, length of every window and item that reach the threshold."""
    known = staged(_items(items).filter("length > 0").withColumn("blocks", all_blocks(F.col("shingles"))), "items")
    sizes = {r["width"]: r["n"] for r in known.groupBy("width").agg(F.sum(F.size("shingles")).alias("n")).collect()}  # 5 rows at most
    if not sizes:
        return spark.createDataFrame([], "doc_id long, text_hash long, item_id long, similarity double, first int, length int")
    sent = F.broadcast if sum(sizes.values()) <= SENT_ROWS else (lambda df: df)
    close = staged(windows(_places(docs, known, sizes), threshold).withColumn("blocks", all_blocks(F.col("window"))), "windows")
    met = close.select("doc_id", "text_hash", "length", "first", F.explode("blocks").alias("b")).select("*", "b.*").drop("b")
    theirs = known.select("item_id", "length", F.explode("blocks").alias("b")).select("item_id", "length", "b.*")
    pairs = met.join(sent(theirs), ["length", "block", "bits"]).select("doc_id", "text_hash", "length", "first", "item_id").distinct()
    same = [F.col(f"p.{c}").eqNullSafe(F.col(f"c.{c}")) for c in ("doc_id", "text_hash", "length", "first")]
    exact = pairs.alias("p").join(close.alias("c"), reduce(lambda a, b: a & b, same)).select("p.item_id", "c.doc_id", "c.text_hash", "c.first", "c.size", "c.window")
    exact = exact.join(sent(known.select("item_id", "length", "shingles")), "item_id")
    exact = exact.withColumn("common", common(F.col("window"), F.col("shingles")))
    exact = exact.withColumn("similarity", F.col("common") / (F.col("size") + F.size("shingles") - F.col("common"))).filter(F.col("similarity") >= threshold)
    return exact.select("doc_id", "text_hash", "item_id", "similarity", "first", "length")


def contaminated(spark: SparkSession, docs: DataFrame, items: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """doc_id, item_id, similarity, first_word, n_words: the best window of every document and item that reach the threshold."""
    best = matches(spark, docs, items, threshold).groupBy("doc_id", "item_id").agg(F.max(F.struct("similarity", (-F.col("first")).alias("back"), "length")).alias("m"))
    return best.select("doc_id", "item_id", F.col("m.similarity").alias("similarity"), (-F.col("m.back")).alias("first_word"), F.col("m.length").alias("n_words"))


def without_contaminated(spark: SparkSession, docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, whose text holds no item; another text under the same id stays."""
    found = staged(matches(spark, docs, items).select("doc_id", "text_hash").distinct(), "contaminated").alias("found")
    same = F.col("docs.doc_id").cast("long").eqNullSafe(F.col("found.doc_id")) & (F.xxhash64(F.col("docs.text").cast("string")) == F.col("found.text_hash"))
    return docs.alias("docs").join(found.hint("merge"), same, "left_anti")
