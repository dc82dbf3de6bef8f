"""Ranked search over notes, and changes to them without a table format: union, rank, anti join."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cordage.functions.text import split_camel
from cordage.plans.iterate import cut

TITLE_WEIGHT, BODY_WEIGHT, K1, B = 10.0, 1.0, 1.2, 0.75
regex_word = re.compile(r"[^\W_]+")


def terms_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def bm25(notes: DataFrame, terms: list[str], kind: str | None = None, require_all: bool = False) -> DataFrame:
    """id, score (lower is better) of the notes (id, title, body) that hold a term, or all terms.

    Each text is read once: its words are counted, and its words that are a term. Only those counts go on, and only matching notes reach
    the join with the terms' document counts, one row per term. Statistics cover all notes, whatever their kind.
    """
    words = sorted({t.lower() for t in terms})
    word = r"[\p{L}\p{N}]+"
    counted = lambda c, p: F.coalesce(F.regexp_count(F.lower(c), F.lit(p)), F.lit(0)).cast("double")

    def of(t: str) -> Column:
        if not regex_word.fullmatch(t):
            return F.lit(0.0)  # no word of a text is equal to it
        p = rf"(?<![\p{{L}}\p{{N}}]){t}(?![\p{{L}}\p{{N}}])"
        return counted("title", p) * TITLE_WEIGHT + counted("body", p) * BODY_WEIGHT

    rows = notes.select("id", *(["type"] if kind else []), (counted("title", word) + counted("body", word)).alias("length"), F.array(*[F.struct(F.lit(t).alias("term"), of(t).alias("f")) for t in words]).alias("counts"))
    held = cut(rows).select("id", *(["type"] if kind else []), "length", F.explode("counts").alias("c")).select("*", "c.*").drop("c")
    stats = held.groupBy("term").agg(F.count("*").alias("n"), F.sum("length").alias("total"), F.count_if(F.col("f") > 0).alias("d"))
    idf = F.ln((F.col("n") - F.col("d") + 0.5) / (F.col("d") + 0.5))
    stats = stats.select("term", F.when(idf <= 0, 1e-6).otherwise(idf).alias("idf"), (F.col("total") / F.col("n")).alias("average"))
    hits = held.filter("f > 0")
    hits = hits.filter(F.col("type") == kind) if kind else hits
    part = F.col("idf") * F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("length") / F.col("average")))
    found = hits.join(F.broadcast(stats), "term").groupBy("id").agg((-F.sum(part)).alias("score"), F.count("*").alias("n"))
    return (found.filter(F.col("n") == len(words)) if require_all else found).select("id", "score")


def phrase_search(notes: DataFrame, words: list[str]) -> DataFrame:
    """id of the notes whose title or body holds the words next to each other."""
    pattern = r"(?iu)(?<![\p{L}\p{N}])" + r"[^\p{L}\p{N}]+".join(re.escape(w) for w in words) + r"(?![\p{L}\p{N}])"
    return notes.filter(F.col("title").rlike(pattern) | F.col("body").rlike(pattern)).select("id")


def match_expression(query: str, mode: str = "or") -> str:
    """The query as a full-text expression: a phrase as it is, else its words (names split at capitals) joined by the mode; a trailing star stays."""
    from cordage.functions.text import split_camel_text

    if mode == "phrase":
        return '"' + " ".join(re.findall(r"[\w*]+", query)).replace("*", "") + '"'
    words = []
    for raw in query.split():
        star = "*" if raw.endswith("*") else ""
        parts = re.findall(r"\w+", split_camel_text(raw))
        words += [f'"{p}"' for p in parts]
        if star and words:
            words[-1] += "*"
    return f" {mode.upper()} ".join(words)


def like_search(notes: DataFrame, query: str, around: int = 60) -> DataFrame:
    """id, score, found_in, snippet: notes that hold the query, raw or split at capitals, in the title or else the body."""
    from cordage.functions.text import split_camel_text

    low, parted = query.lower(), split_camel_text(query).lower()
    t, b = F.lower("title"), F.lower("body")
    in_title, in_body = t.contains(low) | t.contains(parted), b.contains(low)
    at = F.greatest(F.instr(b, low) - around, F.lit(1))
    cut = F.when(in_title & ~in_body, F.substring("body", 1, 2 * around)).otherwise(F.substring(F.col("body"), at, F.lit(2 * around + len(query))))
    return notes.filter(in_title | in_body).select("id", F.lit(-1.0).alias("score"), F.when(in_title, "title").otherwise("body").alias("found_in"), cut.alias("snippet"))


def search(notes: DataFrame, terms: list[str], query: str, limit: int = 20) -> DataFrame:
    """The best by bm25; where that finds nothing, the plain search. The limit is the feature."""
    best = bm25(notes, terms)
    plain = like_search(notes, query).select("id", "score").join(F.broadcast(best.limit(1).select(F.lit(1).alias("x"))), how="left_anti")
    return best.unionByName(plain).orderBy("score", "id").limit(limit)


def snippet(body: Column, term: str, words: int = 15) -> Column:
    """About ``words`` words around the term, which is marked."""
    pattern = rf"(?i)((?:\S+\s+){{0,{words // 2}}}\S*{re.escape(term)}\S*(?:\s+\S+){{0,{words // 2}}})"
    return F.regexp_replace(F.regexp_extract(body, pattern, 1), rf"(?i)({re.escape(term)})", "**$1**")


def augmented(body: Column) -> Column:
    """Names of several words get their words appended; single words and acronyms stay as they are."""
    pieces = F.regexp_extract_all(body, F.lit(r"(?s)(\w+|\W+)"), F.lit(1))
    several = r"^[A-Za-z0-9]*[a-z][A-Z][A-Za-z0-9]*$|^[A-Z]+[A-Z][a-z][A-Za-z0-9]*$"
    return F.array_join(F.transform(pieces, lambda w: F.when(w.rlike(several), F.concat(w, F.lit(" "), split_camel(w))).otherwise(w)), "")


def api_score(text: Column, query: str) -> Column:
    """100 for the query itself, 80 for a beginning, 60 for a part (10 more for queries above 3 letters), else 0; letters in either case."""
    t, q = F.lower(text), query.lower()
    return F.when(t == q, 100).when(t.startswith(q), 80).when(t.contains(q), 70 if len(q) > 3 else 60).otherwise(0)


def api_search(rows: DataFrame, query: str, weaker: str | None = None) -> DataFrame:
    """The rows with a score above 0; a match of the column ``weaker`` (a type or parameters) counts half."""
    score = api_score(F.col("text"), query)
    if weaker:
        score = F.greatest(score, F.floor(api_score(F.col(weaker), query) / 2).cast("int"))
    return rows.withColumn("score", score).filter("score > 0")


def with_staleness(notes: DataFrame, current: DataFrame, never: Column) -> DataFrame:
    """Adds stale: a note's fingerprint or the current one is missing, or they differ."""
    rows = notes.join(current, "id", "left")
    a, b = F.coalesce("fingerprint", F.lit("")), F.coalesce("current", F.lit(""))
    return rows.withColumn("stale", F.when(never, False).otherwise((a == "") | (b == "") | (a != b)))


def expand_hits(hits: DataFrame, edges: DataFrame, notes: DataFrame) -> DataFrame:
    """hit, target, type, title, stub: what the hits point to, with a stub made from the id for targets that are no notes."""
    rows = hits.select(F.col("id").alias("hit")).join(edges.select(F.col("source").alias("hit"), "target"), "hit", "left")
    found = rows.join(notes.select(F.col("id").alias("target"), "type", "title", F.lit(True).alias("_known")), "target", "left")
    part = F.split("target", ":")
    return found.select("hit", "target", F.coalesce("type", F.get(part, 0)).alias("type"), F.coalesce("title", F.get(part, 1)).alias("title"), F.col("_known").isNull().alias("stub"))


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Old rows whose key is not in ``new``, and ``new``."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def replace_edges(old: DataFrame, new: DataFrame) -> DataFrame:
    """The edges of every source in ``new`` replaced; a source without new edges keeps its old ones."""
    return upsert(old, new.distinct(), "source")


def mark_stale(notes: DataFrame, ids: DataFrame) -> DataFrame:
    """Sets stale for the given ids."""
    marked = notes.join(ids.select("id").distinct().withColumn("_m", F.lit(True)), "id", "left")
    return marked.withColumn("stale", F.coalesce("_m", F.col("stale"))).drop("_m")


def cache_lookup(wanted: DataFrame, cached: DataFrame, key: str) -> DataFrame:
    """Adds outcome: hit where a note is there, not stale, and of the same fingerprint; else miss."""
    good = cached.filter("NOT stale").select(key, "fingerprint").distinct().withColumn("_hit", F.lit(True))
    return wanted.join(good, [key, "fingerprint"], "left").withColumn("outcome", F.when(F.col("_hit").isNotNull(), "hit").otherwise("miss")).drop("_hit")


def extract_edges(reports: DataFrame, sections: dict[str, str]) -> DataFrame:
    """source, target, relation from report texts (id, body): names in the section that a heading opens, by the heading's relation.

    A name is a capital and letters, digits or underscores, 2 to 100 in all, and not the note's own.
    """
    found = None
    for heading, relation in sections.items():
        body = F.regexp_extract("body", rf"(?ims)^#+\s*{re.escape(heading)}[^\n]*\n(.*?)(?=^#+\s|\z)", 1)
        names = F.array_distinct(F.regexp_extract_all(body, F.lit(r"(?m)^\s*[-*]\s*`?([A-Z][A-Za-z0-9_]{1,99})\b"), F.lit(1)))
        rows = reports.select(F.col("id").alias("source"), F.explode(names).alias("target"), F.lit(relation).alias("relation"))
        found = rows if found is None else found.unionByName(rows)
    return found.filter(F.col("target") != F.element_at(F.split("source", ":"), -1)).distinct()


def latest(rows: DataFrame, key: str, order: Column) -> DataFrame:
    nth = F.row_number().over(Window.partitionBy(key).orderBy(order))
    return rows.withColumn("_n", nth).filter("_n = 1").drop("_n")
