"""An inverted index of notes on disk: written once, changed by segments, searched by reading the buckets of the query's words only.

A segment is a folder of Parquet files that never change:

* ``notes/nb=``: id, type, title, body, length (words), block, terms (term, f), dealt by a hash of the id;
* ``postings/bucket=``: one row per term and block: n, most (largest f), least (smallest length), hits (id, type, f, length), dealt by a hash of
  the term's first two letters, so that a beginning of two letters or more finds its bucket too, and sorted by term inside;
* ``stats/bucket=``: term, d, the signed change of the term's number of notes;
* ``dead``: id, seg of the notes that this segment replaces or removes.

f counts title words tenfold. A block holds notes of nearly equal length, the same notes for all terms, so that its terms' largest counts and
smallest lengths give an upper bound of its notes' scores. A commit names the segments of a version (``plans.versions``); an upsert writes a
segment of its own notes and touches no other file.

Nulls: a null id is left out, a null title or body is empty, a null type is kept and matches no wanted type. Of several notes of one id in a
write one stays (greatest title, then body). Empty notes count in the statistics and are never found. An empty index finds nothing.
"""

from __future__ import annotations

import math
import re
import uuid
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cordage.functions.text import split_camel_text
from cordage.operators.search import B, BODY_WEIGHT, K1, TITLE_WEIGHT, augmented, phrase_search, snippet, terms_of
from cordage.plans.versions import Conflict, commit, current, delete, manifest

#: Notes in a block, on average; blocks read at first by a search for the best; the longest list of best notes.
BLOCK, SEED, MOST = 128, 8, 10_000
#: Classes of note lengths: eight for each doubling.
PER_DOUBLING = 8


class Token(NamedTuple):
    text: str
    beginning: bool = False


class Words(NamedTuple):
    """A query: tokens any or all of which a note holds, or stands next to each other."""

    tokens: list[Token]
    mode: str


def parsed(query: str, mode: str = "or") -> Words:
    """Words of the query in lower case, names split at capitals (but in a phrase); a trailing star makes beginnings of a word's parts.
    Characters other than letters and digits part words, as in the texts."""
    tokens: list[Token] = []
    for raw in query.split():
        text = raw if mode == "phrase" else split_camel_text(raw)
        star = raw.endswith("*") and mode != "phrase"
        tokens += [Token(p.lower(), star) for p in re.findall(r"[^\W_]+", text)]
    return Words(tokens if mode == "phrase" else list(dict.fromkeys(tokens)), mode)


def _bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.substring(term, 1, 2)), F.lit(buckets)).cast("int")


def _nb(note: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(note), F.lit(buckets)).cast("int")


def _with_counts(rows: DataFrame, words: Column) -> DataFrame:
    """Adds terms, the array of (term, f) of an array of words: sorted, and cut where runs begin. Each step is a column of its own, as a lambda
    evaluates what it captures for every element."""
    o = F.col("_o")
    rows = rows.withColumn("_o", F.array_sort(words))
    rows = rows.withColumn("_at", F.filter(F.sequence(F.lit(1), F.greatest(F.size(o), F.lit(1))), lambda i: (i > 1) & (F.element_at(o, i) != F.element_at(o, F.greatest(i - 1, F.lit(1))))))
    rows = rows.withColumn("_from", F.concat(F.array(F.lit(1)), "_at")).withColumn("_to", F.concat("_at", F.array(F.size(o) + 1)))
    runs = F.zip_with("_from", "_to", lambda a, b: F.struct(F.element_at(o, a).alias("term"), (b - a).cast("long").alias("f")))
    none = F.array().cast("array<struct<term:string,f:bigint>>")
    return rows.withColumn("terms", F.when(F.size(o) > 0, runs).otherwise(none)).drop("_o", "_at", "_from", "_to")


def _prepared(notes: DataFrame, buckets: int, spread: int, names: bool) -> DataFrame:
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    rows = notes.filter(F.col("id").isNotNull()).select(F.col("id").cast("string").alias("id"), F.col("type").cast("string").alias("type"), text("title").alias("title"), text("body").alias("body"))
    rows = rows.withColumn("nb", _nb(F.col("id"), buckets)).repartition("nb")
    nth = F.row_number().over(Window.partitionBy("nb", "id").orderBy(F.desc("title"), F.desc("body")))
    rows = rows.withColumn("_n", nth).filter("_n = 1").drop("_n")
    form = augmented if names else (lambda c: c)
    in_title, in_body = terms_of(form(F.col("title"))), terms_of(form(F.col("body")))
    rows = rows.withColumn("_t", in_title).withColumn("_b", in_body).withColumn("length", (F.size("_t") + F.size("_b")).cast("long"))
    times = F.flatten(F.transform("_t", lambda w: F.array_repeat(w, int(TITLE_WEIGHT / BODY_WEIGHT))))
    kind = F.floor(F.log2(F.col("length") + 1) * PER_DOUBLING)
    block = kind * spread + F.pmod(F.xxhash64("id", F.lit(1)), F.lit(spread))
    rows = _with_counts(rows.withColumn("block", block.cast("long")), F.concat("_b", times))
    return rows.select("id", "type", "title", "body", "length", "block", "terms", "nb")


def _write(rows: DataFrame, path: str, by: str) -> None:
    rows.write.partitionBy(by).parquet(path)


def upsert(spark: SparkSession, path: str, notes: DataFrame, removed: DataFrame | None = None, base: int | None = None, buckets: int = 64, names: bool = True) -> int:
    """The notes (id, type, title, body) put into the index at ``path``, in place of notes of their ids; the ids in ``removed`` taken out.

    Returns the new version. ``base`` is the version that the caller has read (the newest if not given); Conflict, and nothing changed, if
    another writer has committed since. ``buckets`` and ``names`` (names of several words also count as their words) hold from the first write on.
    Only folders of the written ids are read of older segments.
    """
    base = current(spark, path) if base is None else base
    old = manifest(spark, path, base)
    buckets, names = old.get("buckets", buckets), old.get("names", names)
    name = uuid.uuid4().hex
    here = f"{path}/segments/{name}"
    spread = max(1, math.ceil(notes.count() / BLOCK / 64))
    _write(_prepared(notes, buckets, spread, names), f"{here}/notes", "nb")
    mine = _read(spark, f"{here}/notes", NOTES)
    put = mine.select("length", "block", "id", "type", F.explode("terms").alias("t")).select("*", "t.term", "t.f").drop("t")
    put = put.withColumn("bucket", _bucket(F.col("term"), buckets)).repartitionByRange("bucket", "term", "block")
    postings = put.groupBy("bucket", "term", "block").agg(F.count("*").alias("n"), F.max("f").alias("most"), F.min("length").alias("least"), F.collect_list(F.struct("id", "type", "f", "length")).alias("hits"))
    _write(postings.sortWithinPartitions("bucket", "term", "block"), f"{here}/postings", "bucket")
    gone = _superseded(spark, path, old, mine, removed, buckets)
    if gone is not None:
        gone.select("id", "seg", "length", "terms").write.parquet(f"{here}/gone")
        gone = spark.read.schema(f"id string, seg int, length long, {TERMS}").parquet(f"{here}/gone")
    gains = _read(spark, f"{here}/postings", POSTINGS).select("bucket", "term", "n")
    if gone is not None:
        losses = gone.select(F.explode("terms.term").alias("term")).select(_bucket(F.col("term"), buckets).alias("bucket"), "term", F.lit(-1).cast("long").alias("n"))
        gains = gains.unionByName(losses)
    stats = gains.groupBy("bucket", "term").agg(F.sum("n").alias("d")).filter("d != 0")
    _write(stats.repartition("bucket").sortWithinPartitions("bucket", "term"), f"{here}/stats", "bucket")
    more = mine.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
    less = gone.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first() if gone is not None else (0, 0)
    content = {
        "buckets": buckets, "names": names, "notes": old.get("notes", 0) + more[0] - less[0], "length": old.get("length", 0) + more[1] - less[1],
        "segments": old.get("segments", []) + [{"name": name, "dead": less[0]}],
    }
    try:
        return commit(spark, path, base, content)
    except Conflict:
        delete(spark, here)
        raise


TERMS = "terms array<struct<term:string,f:bigint>>"
NOTES = f"id string, type string, title string, body string, length long, block long, {TERMS}, nb int"
POSTINGS = "term string, block long, n long, most long, least long, hits array<struct<id:string,type:string,f:bigint,length:bigint>>, bucket int"
STATS = "term string, d long, bucket int"
DEAD = "id string, seg int"


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def _all(spark: SparkSession, path: str, content: dict, what: str, schema: str) -> DataFrame:
    """The tables of all segments, with seg, the segment's number."""
    found = None
    for k, s in enumerate(content.get("segments", [])):
        rows = _read(spark, f"{path}/segments/{s['name']}/{what}", schema).withColumn("seg", F.lit(k))
        found = rows if found is None else found.unionByName(rows)
    return spark.createDataFrame([], schema).withColumn("seg", F.lit(0)) if found is None else found


def _alive(spark: SparkSession, path: str, content: dict, rows: DataFrame) -> DataFrame:
    """Without the rows (id, seg) whose note a later segment replaces or removes."""
    dead = [_read(spark, f"{path}/segments/{s['name']}/gone", DEAD) for s in content.get("segments", []) if s["dead"]]
    if not dead:
        return rows
    together = dead[0]
    for d in dead[1:]:
        together = together.unionByName(d)
    return rows.join(together, ["id", "seg"], "left_anti")


def _superseded(spark, path: str, old: dict, mine: DataFrame, removed: DataFrame | None, buckets: int) -> DataFrame | None:
    if not old.get("segments"):
        return None
    ids = mine.select("nb", "id")
    if removed is not None:
        out = removed.filter(F.col("id").isNotNull()).select(F.col("id").cast("string").alias("id"))
        ids = ids.unionByName(out.select(_nb(F.col("id"), buckets).alias("nb"), "id"))
    held = _all(spark, path, old, "notes", NOTES).join(ids.distinct(), ["nb", "id"], "left_semi")
    return _alive(spark, path, old, held)


def notes_of(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """id, type, title, body of all notes of the version."""
    content = manifest(spark, path, version)
    return _alive(spark, path, content, _all(spark, path, content, "notes", NOTES)).select("id", "type", "title", "body")


def vocabulary(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """term, notes: every word with the number of notes that hold it."""
    content = manifest(spark, path, version)
    return _all(spark, path, content, "stats", STATS).groupBy("term").agg(F.sum("d").alias("notes")).filter("notes > 0")


def compact(spark: SparkSession, path: str) -> int:
    """All notes in one segment, as a new version; older versions stay readable. Conflict as in ``upsert``."""
    base = current(spark, path)
    content = manifest(spark, path, base)
    draft = f"{path}/drafts/{uuid.uuid4().hex}"
    upsert(spark, draft, notes_of(spark, path, base), buckets=content["buckets"], names=content["names"])
    new = manifest(spark, draft)
    for s in new["segments"]:
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{draft}/segments/{s['name']}")
        fs = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        fs.rename(place, spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/segments/{s['name']}"))
    delete(spark, draft)
    return commit(spark, path, base, new)


class _Search:
    """The postings of a query's tokens at one version, and what scores them."""

    def __init__(self, spark: SparkSession, path: str, words: Words, version: int | None):
        self.spark, self.path, self.words = spark, path, words
        self.content = manifest(spark, path, version)
        self.tokens = list(dict.fromkeys(words.tokens))
        self.average = self.content.get("length", 0) / max(self.content.get("notes", 0), 1) or 1.0
        self.postings = self._of(_all(spark, path, self.content, "postings", POSTINGS))
        self.idf = self._idf() if self.tokens and self.content else []

    def _of(self, rows: DataFrame) -> DataFrame:
        """Rows of the tokens' terms, once for each token, as token (its number)."""
        if not self.tokens:
            return rows.withColumn("token", F.lit(0)).filter(F.lit(False))
        term, buckets = F.col("term"), self.content.get("buckets", 1)
        if all(len(t.text) > 1 or not t.beginning for t in self.tokens):
            where = F.lit(False)
            for t in self.tokens:
                where = where | (F.col("bucket") == _bucket(F.lit(t.text), buckets))
            rows = rows.filter(where)
        hit = [term.startswith(t.text) if t.beginning else term == t.text for t in self.tokens]
        any_hit = hit[0]
        for h in hit[1:]:
            any_hit = any_hit | h
        return rows.filter(any_hit).withColumn("token", F.explode(F.array_compact(F.array(*[F.when(h, F.lit(i)) for i, h in enumerate(hit)]))))

    def _idf(self) -> list[float]:
        exact = [i for i, t in enumerate(self.tokens) if not t.beginning]
        stats = self._of(_all(self.spark, self.path, self.content, "stats", STATS)).groupBy("token").agg(F.sum("d").alias("d"))
        found = {r.token: r.d for r in stats.filter(F.col("token").isin(exact)).collect()}
        if len(exact) < len(self.tokens):  # a note may hold several words of one beginning: it counts once
            notes = self.hits(self.postings.filter(~F.col("token").isin(exact))).groupBy("token").agg(F.count("*").alias("d"))
            found |= {r.token: r.d for r in notes.collect()}
        n = self.content["notes"]
        idf = [math.log((n - d + 0.5) / (d + 0.5)) for d in (found.get(i, 0) for i in range(len(self.tokens)))]
        return [v if v > 0 else 1e-6 for v in idf]

    def hits(self, postings: DataFrame) -> DataFrame:
        """id, seg, type, token, f, length of living notes, one row per note and token."""
        rows = postings.select("token", "seg", F.explode("hits").alias("h")).select("token", "seg", "h.*")
        rows = _alive(self.spark, self.path, self.content, rows)
        return rows.groupBy("id", "seg", "type", "length", "token").agg(F.sum("f").alias("f")) if any(t.beginning for t in self.tokens) else rows

    def part(self, f: str, length: str) -> Column:
        """What a token adds to a score: it grows with f and falls with the length."""
        idf = F.element_at(F.array(*[F.lit(v) for v in self.idf]), F.col("token") + 1)
        return idf * F.col(f) * (K1 + 1) / (F.col(f) + K1 * (1 - B + B * F.col(length) / self.average))

    def scored(self, postings: DataFrame, kind: str | None) -> DataFrame:
        """id, score (lower is better)."""
        if not self.idf:
            return self.spark.createDataFrame([], "id string, score double")
        rows = self.hits(postings)
        rows = rows.filter(F.col("type") == kind) if kind is not None else rows
        found = rows.groupBy("id").agg((-F.sum(self.part("f", "length"))).alias("score"), F.count("*").alias("n"))
        found = (found if self.words.mode == "or" else found.filter(F.col("n") == len(self.tokens))).select("id", "score")
        return self._next_to_each_other(found) if self.words.mode == "phrase" and len(self.words.tokens) > 1 else found

    def _next_to_each_other(self, found: DataFrame) -> DataFrame:
        notes = _alive(self.spark, self.path, self.content, _all(self.spark, self.path, self.content, "notes", NOTES)).select("nb", "id", "title", "body")
        held = found.withColumn("nb", _nb(F.col("id"), self.content["buckets"])).join(notes, ["nb", "id"])
        return found.join(phrase_search(held, [t.text for t in self.words.tokens]), "id", "left_semi")

    def bounds(self) -> DataFrame:
        """seg, block, bound: no note of the block scores better than its bound. Reads no hits."""
        rows = self.postings.groupBy("seg", "block", "token").agg(F.sum("most").alias("most"), F.min("least").alias("least"))
        rows = rows.groupBy("seg", "block").agg((-F.sum(self.part("most", "least"))).alias("bound"), F.count("*").alias("n"))
        return (rows if self.words.mode == "or" else rows.filter(F.col("n") == len(self.tokens))).select("seg", "block", "bound")


def ranking(spark: SparkSession, path: str, words: Words, kind: str | None = None, version: int | None = None) -> DataFrame:
    """id, score of all notes that the query finds. Reads the postings of its words' buckets."""
    s = _Search(spark, path, words, version)
    return s.scored(s.postings, kind)


class Best(NamedTuple):
    rows: DataFrame
    blocks_read: int
    blocks: int


def best(spark: SparkSession, path: str, words: Words, limit: int = 20, kind: str | None = None, version: int | None = None) -> Best:
    """rank, id, title, score, snippet of the ``limit`` best notes, equal scores by id, and how many blocks were read of those that hold a word.

    The blocks of the best bounds are scored first, doubling their number until ``limit`` notes are found; then only blocks whose bound reaches
    the last of these. The result is that of ``ranking``. The driver holds ``limit`` rows and the first blocks' numbers.
    """
    if not 0 < limit <= MOST:
        raise ValueError(f"limit is 1 to {MOST}; ranking() gives all notes")
    s = _Search(spark, path, words, version)
    if not s.idf:
        return Best(spark.createDataFrame([], "rank int, id string, title string, score double, snippet string"), 0, 0)
    bounds = s.bounds().persist()
    try:
        total, seed = bounds.count(), max(SEED, math.ceil(limit / BLOCK))
        while True:
            first = [(r.seg, r.block, r.bound) for r in bounds.orderBy("bound", "seg", "block").limit(seed).collect()]
            top = s.scored(_within(s.postings, first), kind).orderBy("score", "id").limit(limit).collect()
            if len(top) == limit or len(first) == total:
                break
            seed *= 4
        read = len(first)
        if len(first) < total:
            reach = top[-1].score * (1 - 1e-12)
            open_blocks = bounds.filter(F.col("bound") <= reach)
            read = max(read, open_blocks.count())
            if read > len(first):
                top = s.scored(s.postings.join(open_blocks.select("seg", "block"), ["seg", "block"], "left_semi"), kind).orderBy("score", "id").limit(limit).collect()
    finally:
        bounds.unpersist()
    ranked = spark.createDataFrame([(k, r.id, r.score) for k, r in enumerate(top, 1)], "rank int, id string, score double")
    ids = [r.id for r in top]
    notes = _all(spark, path, s.content, "notes", NOTES)
    if ids:
        where = F.lit(False)
        for b in (_nb(F.lit(i), s.content["buckets"]) for i in ids):
            where = where | (F.col("nb") == b)
        notes = notes.filter(where & F.col("id").isin(ids))
    notes = _alive(spark, path, s.content, notes).select("id", "title", "body")
    cut = F.lit("")
    for t in reversed(s.tokens):
        cut = F.when(F.lower("body").contains(t.text), snippet(F.col("body"), t.text)).otherwise(cut)
    return Best(ranked.join(notes, "id").select("rank", "id", "title", "score", cut.alias("snippet")), read, total)


def _within(postings: DataFrame, blocks: list[tuple]) -> DataFrame:
    """The postings of a few blocks, by a filter that reaches the files."""
    by_seg: dict[int, list[int]] = {}
    for seg, block, _ in blocks:
        by_seg.setdefault(seg, []).append(block)
    where = F.lit(False)
    for seg, numbers in by_seg.items():
        where = where | ((F.col("seg") == seg) & F.col("block").isin(numbers))
    return postings.filter(where)
