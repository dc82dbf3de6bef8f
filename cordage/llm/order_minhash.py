"""Document fingerprints by Order MinHash, with DataFrame functions only.

A text is read as words (pieces of at most 16 characters where white space is further apart). Every
run of 3 words is a k-mer, and a k-mer's repeats in a text are told apart by occurrence numbers.
The hash of (k-mer, occurrence) deals it to one of 64 buckets and orders it there. The 2 least of
a bucket, put back into the order they have in the text, are hashed together: 16 bits and the bucket's
number are one component of the fingerprint. A bucket that holds fewer than 2 goes on with the least of the buckets after it, in a circle
(rotation): each bucket so has an order over all k-mers of the text, at every size, and its 2 least by it. Only a text of one k-mer has one component. The likeness of two fingerprints is the share of components
that both have among the buckets that either has: blocks of a text that change places keep k-mers but lose their order.

Occurrence numbers come from the sorted k-mers: an element's number is how far back the same k-mer reaches,
found by doubling steps, so a text of n words costs n log n at most.

Defined cases: a null text counts as empty; a text without words has an empty fingerprint, and two empty ones
have likeness 1; rows that repeat a doc_id share the next document, and where that is repeated its least text counts; a
null doc_id comes before all others; positions beyond 16.7 million words of one text order alike; an empty table gives no rows;
the id -2 ** 63 counts as null; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cordage.llm.common import SPACE, staged, whole_parts

WORDS, KEPT, PIECE = 3, 2, 16
#: Low bits of a packed k-mer: its position. The top 6 bits of an ordered one: its bucket.
POSITION_BITS, BUCKET_BITS = 24, 6
_FIRST_KEY = -(1 << 63)


def _with_kmers(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds ``out``: the text's k-mers, each a hash whose low bits are replaced by its position."""
    low = F.lit((1 << POSITION_BITS) - 1)
    high = F.lit(-(1 << POSITION_BITS))
    hashes, n = F.col("_h"), F.size("_h")
    df = df.withColumn("_h", F.transform(F.regexp_extract_all(F.col(text), F.lit(f"[^{SPACE}]{{1,{PIECE}}}"), F.lit(0)), lambda w: F.xxhash64(w)))
    at = lambda i: F.get(hashes, i)
    kmer = F.transform(F.sequence(F.lit(0), n - WORDS), lambda i: F.xxhash64(*[at(i + j) for j in range(WORDS)]).bitwiseAND(high).bitwiseOR(F.least(i.cast("long"), low)))
    few = F.when(n > 0, F.array(F.xxhash64(hashes).bitwiseAND(high))).otherwise(F.array().cast("array<long>"))
    return df.withColumn(out, F.sort_array(F.when(n >= WORDS, kmer).otherwise(few))).drop("_h")


def _occurrence(sorted_kmers: Column, x: Column, i: Column) -> Column:
    """How many elements before ``i`` hold the same k-mer as ``x``."""
    name = F.shiftright(x, POSITION_BITS)
    same = lambda j: (j >= 0) & (F.shiftright(F.get(sorted_kmers, F.greatest(j, F.lit(0))), POSITION_BITS) == name)
    steps = F.array(*[F.lit(1 << t) for t in range(POSITION_BITS - 1, -1, -1)])
    found = F.aggregate(steps, F.lit(0), lambda back, step: back + F.when(same(i - back - step), step).otherwise(F.lit(0)))
    return F.when(same(i - 1), found).otherwise(F.lit(0))


def with_fingerprint(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds ``out``: the fingerprint of the column ``text`` as an array of (bucket, 16 bits) in ints."""
    low, high = F.lit((1 << POSITION_BITS) - 1), F.lit(-(1 << POSITION_BITS))
    df = _with_kmers(df, text, "_k")
    k = F.col("_k")
    placed = F.transform(k, lambda x, i: F.xxhash64(F.shiftright(x, POSITION_BITS), _occurrence(k, x, i)).bitwiseAND(high).bitwiseOR(x.bitwiseAND(low)))
    df = df.withColumn("_e", F.sort_array(placed)).drop("_k")
    bucket = lambda x: F.shiftrightunsigned(x, 64 - BUCKET_BITS)
    e = F.col("_e")
    df = df.withColumn("_s", F.filter(e, lambda x, i: (i < KEPT) | (bucket(x) != bucket(F.get(e, F.greatest(i - KEPT, F.lit(0))))))).drop("_e")
    s = F.col("_s")

    # Buckets in the order of the sorted longs, and how many buckets end at x: its own and the empty ones before it, in a circle.
    place = lambda x: F.shiftright(x, 64 - BUCKET_BITS)
    every = 1 << BUCKET_BITS

    def component(x: Column, i: Column) -> Column:
        fresh = (i == 0) | (bucket(x) != bucket(F.get(s, F.greatest(i - 1, F.lit(0)))))
        before = F.get(s, F.when(i == 0, F.size(s) - 1).otherwise(i - 1))
        gap = F.when(F.size(s) == 1, F.lit(1)).otherwise(F.lit(every) - F.pmod(place(before) - place(x), F.lit(every))).cast("int")
        y = F.coalesce(F.get(s, i + 1), F.get(s, F.lit(0)))
        a, b = x.bitwiseAND(high), y.bitwiseAND(high)
        pair = F.when(x.bitwiseAND(low) <= y.bitwiseAND(low), F.xxhash64(a, b)).otherwise(F.xxhash64(b, a))
        whole = F.when(F.size(s) > 1, pair).otherwise(F.xxhash64(a)).bitwiseAND(F.lit(65535))
        filled = F.transform(F.sequence(F.lit(0), gap - 1), lambda k: ((bucket(x) - k).bitwiseAND(F.lit(every - 1)) * 65536 + whole).cast("int"))
        return F.when(fresh, filled)

    return df.withColumn(out, F.sort_array(F.flatten(F.filter(F.transform(s, component), lambda c: c.isNotNull())))).drop("_s")


def likeness(a: Column, b: Column) -> Column:
    buckets = lambda c: F.transform(c, lambda x: F.shiftright(x, 16))
    either = F.size(F.array_union(buckets(a), buckets(b)))
    return F.when(either == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / either)


def written(fingerprint: Column) -> Column:
    """Six hex digits per component: two of the bucket, four of the hash."""
    return F.array_join(F.transform(fingerprint, lambda c: F.lower(F.lpad(F.hex(c), 6, "0"))), "")


def next_keys(keys: DataFrame) -> DataFrame:
    """(key, need, next) for distinct ``key``: the next greater key, after the greatest the least.

    Keys are dealt by ranges; a range's last key gets the next range's first, from one row per range.
    """
    spark = keys.sparkSession
    ranged = staged(keys.repartitionByRange(whole_parts(spark), "key").withColumn("part", F.spark_partition_id()), "ranges")
    heads = ranged.groupBy("part").agg(F.min("key").alias("head"))
    order = Window.orderBy("part")
    heads = heads.select("part", F.coalesce(F.lead("head").over(order), F.min("head").over(Window.partitionBy())).alias("onward"))
    inside = F.lead("key").over(Window.partitionBy("part").orderBy("key"))
    return ranged.withColumn("inside", inside).join(heads, "part").select("key", "need", F.coalesce("inside", "onward").alias("next"))


def fingerprint_documents(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fp, edited_fp, near_edited, near_next of every document.

    Whole texts are dealt by id once; from there both a text and its donor's beginning are taken.
    """
    base = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_FIRST_KEY)).alias("key"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    keys = staged(base.groupBy("key").agg(F.max(F.floor(F.length("text") / 2)).cast("long").alias("need"), F.count("*").alias("n")), "keys")
    repeated = keys.filter("n > 1").limit(1).count() > 0
    following = staged(next_keys(keys.select("key", "need")), "following")

    # Both uses read the same two columns, so that the texts are dealt once and read twice.
    dealt = base.repartition(whole_parts(spark), "key")
    donors = dealt.groupBy("key").agg(F.min("text").alias("text")) if repeated else dealt
    gifts = donors.select(F.col("key").alias("next"), F.col("text").alias("donor")).join(following, "next").select("key", "next", F.left("donor", F.col("need").cast("int")).alias("gift"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    rows = dealt.join(gifts, "key").withColumn("n_chars", F.length("text"))
    rows = rows.select("key", "next", "n_chars", "text", F.concat(F.left("text", F.col("n_chars") - half), F.left("gift", half)).alias("edited"))
    rows = with_fingerprint(with_fingerprint(rows, "text", "fp"), "edited", "edited_fp")
    rows = staged(rows.select("key", "next", F.col("n_chars").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "fp", "edited_fp"), "prints")
    # Where ids are repeated, the fingerprint of the least text, as that text was the donor.
    onward = with_fingerprint(donors, "text", "next_fp").select("key", "next_fp") if repeated else rows.select("key", F.col("fp").alias("next_fp"))
    paired = rows.join(onward.withColumnRenamed("key", "next"), "next")
    return paired.select(F.when(F.col("key") != _FIRST_KEY, F.col("key")).alias("doc_id"), "n_chars", "edited_sha256", "fp", "edited_fp", likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"))
