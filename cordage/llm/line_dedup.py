"""Line dedup by winnowing, with DataFrame functions only.

A text's lines (split at line feeds) are hashed. A passage that counts as repeated has 3 lines, or fewer if they hold 50 words
or more: the window that starts at a line is as short as that allows. Of every window the least line hash is selected (of equal
ones the last), so equal windows select the same line of theirs: the selected lines, each emitted once a text, are the text's fingerprints, and
two texts can only share a passage where they share one. Fingerprints join by hash; those that no other place has need no
further look. From each shared one the match is extended to the left and to the right over the windows that selected it,
compared as wholes. Windows that match and overlap make up the whole repeated run. A run's first place, by (doc_id, text, line), stays, and
its lines are deleted everywhere later.

Defined cases: a null text counts as empty and has no lines; empty lines are lines like any other; a text below 3 lines and
50 words is kept whole; rows that repeat a doc_id with another text are documents of their own, identical rows are one and
fare alike; a null doc_id comes first; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cordage.llm.common import WORD, staged

#: Lines of the longest window; words that make a window of fewer lines.
RUN, PASSAGE = 3, 50


def _hashed(docs: DataFrame) -> DataFrame:
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return base.withColumn("text_hash", F.xxhash64("text"))


def _window(lines: Column, i: Column, run: int, passage: int) -> Column:
    """The window that starts at line i: its lines, the selected one and the hash of all; null where the text ends before."""
    hashes, words = [F.get(lines, i + j)["hash"] for j in range(run)], [F.get(lines, i + j)["words"] for j in range(run)]

    def made(m: int) -> Column:
        least = F.least(*hashes[:m]) if m > 1 else hashes[0]
        last = F.coalesce(*[F.when(hashes[j] == least, F.lit(j)) for j in reversed(range(m))])
        return F.struct(i.alias("line"), F.lit(m).alias("lines"), (i + last).alias("at"), F.xxhash64(*hashes[:m]).alias("whole"))

    out = F.when(hashes[run - 1].isNotNull(), made(run))
    for m in reversed(range(1, run)):
        out = F.when(hashes[m - 1].isNotNull() & (sum(words[1:m], words[0]) >= passage), made(m)).otherwise(out)
    return out


def fingerprints(docs: DataFrame, run: int = RUN, passage: int = PASSAGE) -> DataFrame:
    """doc_id, text_hash, at (a selected line), selected (its hash), windows (line, lines, whole of each window that selected it)."""
    line = lambda s: F.struct(F.xxhash64(s).alias("hash"), F.regexp_count(s, F.lit(WORD)).alias("words"))
    rows = docs.withColumn("_lines", F.transform(F.split("text", "\n"), line))
    every = F.transform(F.sequence(F.lit(0), F.size("_lines") - 1), lambda i: _window(F.col("_lines"), i, run, passage))
    rows = rows.withColumn("_windows", every)
    near = lambda i: F.filter(F.slice(F.col("_windows"), F.greatest(i - (run - 1), F.lit(0)) + 1, F.lit(run)), lambda w: w["at"] == i)
    placed = F.transform("_lines", lambda x, i: F.struct(i.alias("at"), x["hash"].alias("selected"), near(i).alias("windows")))
    rows = rows.select("doc_id", "text_hash", F.explode(F.filter(placed, lambda p: F.size(p["windows"]) > 0)).alias("p"))
    return rows.select("doc_id", "text_hash", "p.*").dropDuplicates(["doc_id", "text_hash", "at"])


def repeated_lines(docs: DataFrame, run: int = RUN, passage: int = PASSAGE) -> DataFrame:
    """doc_id, text_hash, removed (the lines to delete, ascending) of the documents that have any."""
    every = staged(fingerprints(docs, run, passage), "fingerprints")
    # Counts that are joined back are staged first: a join of two plain exchanges is one whose hot keys Spark can split.
    shared = staged(every.groupBy("selected").agg(F.count("*").alias("n")).filter("n > 1").select("selected"), "shared")
    meeting = every.join(shared.hint("merge"), "selected").select("doc_id", "text_hash", F.explode("windows").alias("w"))
    meeting = staged(meeting.select("doc_id", "text_hash", "w.line", "w.lines", "w.whole"), "meeting")
    place = F.struct("doc_id", "text_hash", "line")
    first = staged(meeting.groupBy("whole").agg(F.count("*").alias("n"), F.min(place).alias("first")).filter("n > 1").select("whole", "first"), "first")
    later = meeting.join(first.hint("merge"), "whole").filter(place != F.col("first"))
    found = later.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("line", "lines")).alias("starts"))
    lines = F.flatten(F.transform("starts", lambda w: F.sequence(w["line"], w["line"] + w["lines"] - 1)))
    return found.select("doc_id", "text_hash", F.array_sort(F.array_distinct(lines)).alias("removed"))


def dedup_lines(spark: SparkSession, docs: DataFrame, run: int = RUN, passage: int = PASSAGE) -> DataFrame:
    """doc_id, n_lines, removed, text (what is left) of every document."""
    base = _hashed(docs)
    found = staged(repeated_lines(base, run, passage).withColumnsRenamed({"doc_id": "id", "text_hash": "hash"}), "removed")
    # Merged at any size: sending what was found to every task would hold for small tables only.
    rows = base.join(found.hint("merge"), F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_hash") == F.col("hash")), "left")
    removed = F.coalesce("removed", F.array().cast("array<int>"))
    lines = F.when(F.col("text") == "", F.array().cast("array<string>")).otherwise(F.split("text", "\n"))
    left = F.when(F.size(removed) == 0, F.col("text")).otherwise(F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), removed), lambda i: F.get(lines, i)), "\n"))
    return rows.select("doc_id", F.size(lines).cast("long").alias("n_lines"), removed.alias("removed"), left.alias("text"))


#: The same result from the definition: a window of one line or two with 50 words, else of three lines, that stood earlier takes its lines away.
ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) - 1 AS i FROM d),
c AS (SELECT *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words FROM l),
w AS (SELECT doc_id, i, line, words, lead(line, 1) OVER o AS b, lead(words, 1) OVER o AS b_words, lead(line, 2) OVER o AS c FROM c WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
m AS (SELECT doc_id, i, line, b, c, CASE WHEN words >= 50 THEN 1 WHEN words + b_words >= 50 THEN 2 WHEN c IS NOT NULL THEN 3 END AS m FROM w),
f AS (SELECT doc_id, i, m, row_number() OVER (PARTITION BY m, line, CASE WHEN m > 1 THEN b END, CASE WHEN m > 2 THEN c END ORDER BY doc_id, i) AS nth FROM m WHERE m IS NOT NULL),
r AS (SELECT DISTINCT doc_id, i + k AS i FROM f, (VALUES (0), (1), (2)) AS t(k) WHERE nth > 1 AND k < m),
k AS (SELECT l.doc_id, count(r.i) AS n_removed, string_agg(l.line, chr(10) ORDER BY l.i) FILTER (r.i IS NULL) AS kept
      FROM l LEFT JOIN r ON l.doc_id = r.doc_id AND l.i = r.i GROUP BY l.doc_id)
SELECT d.doc_id, CAST(CASE WHEN d.text = '' THEN 0 ELSE len(d.lines) END AS BIGINT) AS n_lines, CAST(k.n_removed AS BIGINT) AS n_removed,
       CAST(length(coalesce(k.kept, '')) AS BIGINT) AS kept_chars, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM d JOIN k USING (doc_id)
"""
