"""Mixing sources to target weights, with DataFrame functions only.

Each source's words form one stream, cut into blocks of a fixed number of words (the last may
be shorter). The mix has output shards of a fixed number of slots. Every slot of a shard draws
its source, so a shard's counts per source are a multinomial draw; what a source drew beyond
its quota over all shards goes to the sources that stayed below theirs, so the draw is one
conditioned on the quotas. A source's slots are numbered through all shards, and each pass over
the source maps slot numbers to block numbers by a pseudorandom permutation of its own, a keyed Feistel network. Blocks join by number.

Defined cases: a null source is a source of its own, ranked last; a null or empty text has size 0 and
is taken 0 times; rows that repeat a doc_id are documents of their own; a table without words has targets of 0;
an empty one gives no rows; other columns are ignored, whatever their names, and returned as they are by the form that returns documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cordage.llm.common import SPACE, WORD, staged, word_count
from cordage.llm.prefix_sums import exclusive_sums, table_sums

BLOCK_WORDS, SHARD_SLOTS, BUCKETS = 64, 16384, 1024
#: Weights by rank of the source, repeating; the mix's share of all words; passes over a source at most.
WEIGHTS, SHARE, PASSES = (3, 1, 2), 1.5, 2
#: Rounds of a permutation, and how often a number outside its range is sent on: enough for each below 1024 blocks, beyond in all but 2 ** -160 cases.
ROUNDS, WALKS = 4, 32
#: Cells of the unit interval in which a draw looks for its source: this many, or as many for each source.
CELLS, CELLS_A_SOURCE = 4096, 4


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, and the place in the source's stream: bucket, then hash."""
    key = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit("place"))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("text_hash")).withColumns({"place": key, "bucket": F.pmod(key, F.lit(BUCKETS))})


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, passes: int = PASSES) -> DataFrame:
    """sid, source, weight, source_size, target per source: one row each.

    A source whose share by weight is above ``passes`` times its size keeps just that. Sources stop in
    order of limit by weight, so the level at which the rest share is found in one pass over them. Any number of
    sources: ranks and running sums are made by ranges.
    """
    per = staged(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    per = table_sums(per, [F.col("source").isNull(), F.col("source")], {"sid": F.lit(1).cast("long")})
    per = per.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("sid") % len(weights) + 1).cast("int")))
    per = per.withColumn("limit", F.col("source_size") * F.lit(float(passes))).withColumn("ratio", F.col("limit") / F.col("weight"))
    per = table_sums(per, ["ratio", "sid"], {"limit_before": F.col("limit"), "weight_before": F.col("weight")})
    whole = per.agg((F.sum("source_size") * F.lit(float(share))).alias("total"), F.sum("weight").alias("all_weight"))
    # One row of totals, and one with the level.
    level = (F.col("total") - F.col("limit_before")) / (F.col("all_weight") - F.col("weight_before"))
    per = per.join(F.broadcast(whole)).withColumn("level", level).withColumn("full", F.col("level") * F.col("weight") >= F.col("limit"))
    shared = per.agg(F.max(F.when(~F.col("full"), F.col("level"))).alias("shared"))
    return per.join(F.broadcast(shared)).select("sid", "source", "weight", "source_size", F.when(F.col("full"), F.col("limit")).otherwise(F.col("shared") * F.col("weight")).alias("target"))


def with_quotas(targets: DataFrame, block_words: int = BLOCK_WORDS, passes: int = PASSES) -> DataFrame:
    """Adds blocks and quota (slots) of each source, and its part of the unit interval for the draw: [low, high)."""
    blocks = F.ceil(F.col("source_size") / F.lit(block_words)).cast("long")
    q = targets.withColumn("blocks", blocks)
    quota = F.when(F.col("blocks") > 0, F.least(F.round(F.col("target") * F.col("blocks") / F.col("source_size")).cast("long"), F.col("blocks") * passes)).otherwise(F.lit(0))
    q = staged(q.withColumn("quota", quota.cast("long")), "quotas")
    q = table_sums(q, ["sid"], {"before": F.col("quota")}).join(F.broadcast(q.agg(F.sum("quota").alias("slots"))))
    total = F.greatest(F.col("slots"), F.lit(1))
    return q.withColumns({"low": F.col("before") / total, "high": (F.col("before") + F.col("quota")) / total}).drop("before")


def _uniform(*cols: Column | str) -> Column:
    """From 0, below 1, by hash of the columns."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11) / F.lit(float(1 << 53))


def _drawn(spark: SparkSession, quotas: DataFrame, slots: int, sources: int, seed: int, shard_slots: int) -> DataFrame:
    """shard, i (number within the shard), sid of every slot: its source by a draw of its own."""
    shards, fine = -(-slots // shard_slots), max(CELLS, CELLS_A_SOURCE * sources)
    drawn = spark.range(shards).select(F.col("id").alias("shard"), F.explode(F.sequence(F.lit(0), F.least(F.lit(shard_slots), F.lit(slots) - F.col("id") * shard_slots).cast("int") - 1)).alias("i"))
    drawn = drawn.withColumn("u", _uniform(F.lit(seed), "shard", "i")).withColumn("cell", F.floor(F.col("u") * fine).cast("long"))
    # The part of a source covers whole cells and two parts of cells: as many rows as cells and sources together.
    cells = quotas.filter("quota > 0").select("sid", "low", "high", F.explode(F.sequence(F.floor(F.col("low") * fine).cast("long"), F.least(F.floor(F.col("high") * fine), F.lit(fine - 1)).cast("long"))).alias("cell"))
    # Said by the join, as Spark takes the slots for few rows, one per shard, and would send all of them to every task.
    drawn = drawn.join(F.broadcast(cells) if sources <= CELLS else cells.hint("merge"), "cell")
    return drawn.filter((F.col("u") >= F.col("low")) & (F.col("u") < F.col("high"))).select("shard", "i", "sid")


def draw_slots(spark: SparkSession, quotas: DataFrame, seed: int, shard_slots: int = SHARD_SLOTS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """shard, sid, slot (number within the source, through all shards), pass, block of every slot of the mix."""
    head = quotas.agg(F.coalesce(F.max("slots"), F.lit(0)), F.count("*")).first()
    slots = int(head[0])
    shards = -(-slots // shard_slots)
    drawn = staged(_drawn(spark, quotas, slots, int(head[1]), seed, shard_slots), "draws")
    counts = drawn.groupBy("shard", "sid").agg(F.count("*").alias("n")).withColumn("span", F.floor(F.col("shard") / 64))
    counts = exclusive_sums(counts, ["sid"], "span", ["shard"], "n", "base").select("shard", "sid", "base")
    inside = F.row_number().over(Window.partitionBy("shard", "sid").orderBy("i")) - 1
    numbered = drawn.withColumn("at", inside).join(counts, ["shard", "sid"]).select("shard", "sid", (F.col("base") + F.col("at")).alias("slot"))
    numbered = staged(numbered, "slots")

    # Beyond a quota: as many slots as others miss; both are numbered by source and meet by number.
    total = drawn.groupBy("sid").agg(F.count("*").alias("drawn"))
    book = staged(quotas.select("sid", "quota", "blocks").join(total, "sid", "left").withColumn("drawn", F.coalesce("drawn", F.lit(0))), "drawn")
    more = lambda a, b: F.greatest(F.col(a) - F.col(b), F.lit(0))
    book = staged(table_sums(book, ["sid"], {"over": more("drawn", "quota"), "under": more("quota", "drawn")}), "book")
    kept = numbered.join(book.select("sid", "quota", "over", "blocks"), "sid")
    excess = kept.filter("slot >= quota").select("shard", (F.col("over") + F.col("slot") - F.col("quota")).alias("r"))
    missing = book.filter("drawn < quota").select("sid", "blocks", "under", "drawn", F.explode(F.sequence("drawn", F.col("quota") - 1)).alias("slot")).select("sid", "blocks", "slot", (F.col("under") + F.col("slot") - F.col("drawn")).alias("r"))
    # A rounding gap between two cells may draw no source, so a missing slot may meet no excess one: it goes to the last shard.
    refill = missing.join(excess.hint("merge"), "r", "left").select(F.coalesce("shard", F.lit(max(0, shards - 1))).alias("shard"), "sid", "slot", "blocks")
    every = kept.filter("slot < quota").select("shard", "sid", "slot", "blocks").unionByName(refill)
    every = every.withColumns({"turn": F.floor(F.col("slot") / F.col("blocks")).cast("long"), "at": F.col("slot") % F.col("blocks")})
    return every.select("shard", "sid", "slot", "turn", permuted(F.col("at"), F.col("blocks"), F.lit(seed), F.col("sid"), F.col("turn")).alias("block"))


def permuted(at: Column, n: Column, *key: Column) -> Column:
    """A pseudorandom permutation of 0 .. n-1 chosen by the key: a Feistel network over pairs of digits, of which there are ``wide`` and
    ``high``, so less than ``wide`` numbers more than n; what lands on one of those is sent on until it doesn't (cycle walking)."""
    n = n.cast("long")
    whole = lambda x, y: F.call_function("div", x, y)
    wide = F.ceil(F.sqrt(n.cast("double"))).cast("long")
    high = whole(n + wide - 1, wide)

    def once(x: Column) -> Column:
        digits, sizes = [x % wide, whole(x, wide)], [wide, high]
        for r in range(ROUNDS):
            i = r % 2
            digits[i] = (digits[i] + F.pmod(F.xxhash64(*key, F.lit(r), digits[1 - i]), sizes[i])) % sizes[i]
        return digits[0] + wide * digits[1]

    first = once(at.cast("long"))
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(WALKS)), first, lambda x, _: F.when(x < n, x).otherwise(once(x)))
    return F.when(first < n, first).otherwise(walked)


def pieces(placed: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per document and block that it has words in: block, first (word of the document) and words."""
    b = F.lit(block_words)
    start, end = F.col("start"), F.col("start") + F.col("size")
    cut = placed.filter("size > 0").withColumn("block", F.explode(F.sequence(F.floor(start / b).cast("long"), F.floor((end - 1) / b).cast("long"))))
    low, high = F.greatest(start, F.col("block") * b), F.least(end, (F.col("block") + 1) * b)
    return cut.withColumns({"first": low - start, "words": high - low})


def mix(spark: SparkSession, docs: DataFrame, seed: int = 20, block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, weights=WEIGHTS, share: float = SHARE, passes: int = PASSES):
    """(placed documents, quotas, slots): what the mix is made of. See the module's text."""
    sizes = staged(sized(docs), "sizes")
    quotas = staged(with_quotas(source_targets(sizes, weights, share, passes), block_words, passes), "targets")
    known = sizes.join(quotas.select("sid", F.col("source").alias("named"), "source_size", "target"), F.col("source").eqNullSafe(F.col("named"))).drop("named")
    order = ["place", "doc_id", "text_hash", "size"]
    known = staged(known, "known")
    placed = exclusive_sums(known, ["sid"], "bucket", order, "size", "start")
    nth = F.row_number().over(Window.partitionBy("sid", "bucket").orderBy(*order))
    placed = staged(placed.withColumn("nth", nth), "placed")
    return placed, quotas, draw_slots(spark, quotas, seed, shard_slots, block_words)


def taken_words(spark: SparkSession, docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source, source_size, target, taken of every document."""
    placed, _, slots = mix(spark, docs, **options)
    times = slots.groupBy("sid", "block").agg(F.count("*").alias("times"))
    # Merged at any size: sending one side to every task would hold for small tables only.
    used = pieces(placed, options.get("block_words", BLOCK_WORDS)).join(times.hint("merge"), ["sid", "block"]).groupBy("sid", "bucket", "nth").agg(F.sum(F.col("words") * F.col("times")).alias("taken"))
    return placed.join(used.hint("merge"), ["sid", "bucket", "nth"], "left").select("doc_id", "size", "source", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed_documents(spark: SparkSession, docs: DataFrame, **options) -> DataFrame:
    """What the mix takes of every document, one row per pass over its source that takes anything, with the columns of ``docs``.

    A pass that takes the whole document keeps its text as it is; one that takes some of its blocks has their parts of the text, in order,
    each with the white space before its words as it was. ``n_chars`` is that of the new text.
    """
    placed, _, slots = mix(spark, docs, **options)
    row = ["doc_id", "text_hash", "sid", "bucket", "nth"]
    used = pieces(placed, options.get("block_words", BLOCK_WORDS)).join(slots.select("sid", "block", "turn").hint("merge"), ["sid", "block"])
    # As many pieces as the document has blocks, at most.
    cuts = used.groupBy(*row, "size", "turn").agg(F.sort_array(F.collect_list(F.struct("first", "words"))).alias("cuts"), F.sum("words").alias("taken"))
    cuts = cuts.groupBy(*row, "size").agg(F.sort_array(F.collect_list(F.struct("turn", "taken", "cuts"))).alias("turns"))
    copy = F.row_number().over(Window.partitionBy("doc_id", "text_hash").orderBy("sid", "bucket", "nth"))
    cuts = staged(cuts.withColumn("copy", copy).select("doc_id", "text_hash", "copy", "size", "turns"), "cuts")
    # The caller's columns stay together under one name, so that none can clash. Rows alike in id and text are told apart by their number.
    own = lambda c: F.col(f"row.`{c}`")
    named = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("hash"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    named = named.withColumn("number", F.row_number().over(Window.partitionBy("id", "hash").orderBy(own("source"))))
    rows = named.join(cuts.hint("merge"), F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("hash") == F.col("text_hash")) & (F.col("number") == F.col("copy")))
    rows = rows.select("row", "size", F.explode("turns").alias("t")).withColumn("whole", F.col("t.taken") == F.col("size"))
    rows = rows.withColumn("words", F.when(~F.col("whole"), F.regexp_extract_all(own("text"), F.lit(rf"[{SPACE}]*{WORD}"), F.lit(0))))
    some = F.array_join(F.flatten(F.transform("t.cuts", lambda c: F.slice(F.col("words"), (c["first"] + 1).cast("int"), c["words"].cast("int")))), "")
    rows = rows.select("row", F.when(F.col("whole"), own("text")).otherwise(some).alias("text"))
    new = {"text": F.col("text")} | ({"n_chars": F.length("text").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return rows.select(*[new.get(c, own(c)).alias(c) for c in docs.columns])
