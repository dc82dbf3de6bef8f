"""Aggregations, reference joins and reports over the model relations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def namespace_distribution(nodes: DataFrame, most: int = 60) -> DataFrame:
    """namespace ("(None)" where empty), types, names: sorted names, cut to ``most`` characters with dots."""
    ns = F.when(F.coalesce("namespace", F.lit("")) == "", "(None)").otherwise(F.col("namespace")).alias("namespace")
    rows = nodes.select(ns, "name")
    # No more names than characters are shown.
    first = rows.withColumn("nth", F.row_number().over(Window.partitionBy("namespace").orderBy("name"))).filter(F.col("nth") <= most)
    first = first.groupBy("namespace").agg(F.array_join(F.array_sort(F.collect_list("name")), ", ").alias("names"))
    counts = rows.groupBy("namespace").agg(F.count("*").alias("types"))
    return counts.join(first, "namespace").select("namespace", "types", truncated(F.col("names"), most).alias("names"))


def truncated(text: Column, most: int) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 3), F.lit("..."))).otherwise(text)


def with_reference_totals(scores: DataFrame, refs: DataFrame) -> DataFrame:
    """Adds the reference counts (refs: name, total) to the scores: name, score, engine_ref."""
    rows = scores.join(refs, "name", "left").withColumn("engine_ref", F.coalesce("total", F.lit(0)).cast("long"))
    return rows.select("name", (F.col("score") + F.col("engine_ref")).alias("score"), "engine_ref")


def without_referenced(dead: DataFrame, refs: DataFrame) -> DataFrame:
    return dead.join(refs.select("name"), "name", "left_anti")


def unused(assets: DataFrame, references: list[DataFrame], key: str, excluded: Column | None = None) -> DataFrame:
    """Assets whose key is in none of the reference sets, those for which ``excluded`` holds left out."""
    every = reduce(DataFrame.union, [r.select(key) for r in references])
    rows = assets.join(every, key, "left_anti")
    return rows if excluded is None else rows.filter(~excluded)


def sizes_by(df: DataFrame, group: str, size: str) -> DataFrame:
    """group, files, bytes."""
    return df.groupBy(group).agg(F.count("*").alias("files"), F.sum(size).alias("bytes"))


def usage_index(refs: DataFrame, names: DataFrame, key: str) -> DataFrame:
    """name, usages (sorted), total: reference rows (key, asset) under the name that the key stands for (names: key, name)."""
    rows = refs.join(names, key).groupBy("name").agg(F.array_sort(F.collect_set("asset")).alias("usages"))
    return rows.withColumn("total", F.size("usages").cast("long"))


def broken_references(refs: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """References (key, asset) whose key is unknown, each key once, under the least asset."""
    # Grouped first: references to a key meet the known ones as one row.
    return refs.groupBy(key).agg(F.min("asset").alias("asset")).join(known.select(key), key, "left_anti")


def first_role(assets: DataFrame, roles: DataFrame) -> DataFrame:
    """asset, role: that of the first class reference that has one (assets: asset, class_refs; roles: cls, role)."""
    rows = assets.select("asset", F.posexplode("class_refs").alias("pos", "cls")).join(roles, "cls")
    return rows.groupBy("asset").agg(F.min_by("role", "pos").alias("role"))


def _contained(short: DataFrame, long: DataFrame) -> DataFrame:
    """a, b: where a (of ``short``) is part of b (of ``long``), by the beginning of a, three letters at most, among all such pieces of b."""
    width = 3
    pieces = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(width)), lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length("b") - n + 1, F.lit(1))), lambda i: F.substring(F.col("b"), i, n))))
    keyed = short.withColumn("piece", F.left("a", F.lit(width)))
    return keyed.join(long.withColumn("piece", F.explode(F.array_distinct(pieces))), "piece").filter(F.contains("b", "a")).select("a", "b")


def name_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """stem, cls: names of which one contains the other, letters in either case. Names meet by their first letters, so no two tables are
    compared as wholes. An empty name matches nothing."""
    stems, names = left.select("stem").distinct().withColumn("s", F.lower("stem")).filter("s != ''"), right.select("cls").distinct().withColumn("c", F.lower("cls")).filter("c != ''")
    s, c = stems.select("s").distinct(), names.select("c").distinct()
    down = _contained(c.select(F.col("c").alias("a")), s.select(F.col("s").alias("b"))).select(F.col("b").alias("s"), F.col("a").alias("c"))
    up = _contained(s.select(F.col("s").alias("a")), c.select(F.col("c").alias("b"))).select(F.col("a").alias("s"), F.col("b").alias("c"))
    return stems.join(down.union(up).distinct(), "s").join(names, "c").select("stem", "cls")


def name_matches(left: DataFrame, right: DataFrame) -> DataFrame:
    """stem, matched: the least right name (column cls) that contains the stem or is contained in it, letters in either case; "" where none."""
    found = name_pairs(left, right).groupBy("stem").agg(F.min("cls").alias("cls"))
    return left.select("stem").distinct().join(found, "stem", "left").select("stem", F.coalesce("cls", F.lit("")).alias("matched"))


def argmax(df: DataFrame, group: str, what: str, weight: str) -> DataFrame:
    """group, what, weight of the row with the greatest weight, of equal ones the least ``what``."""
    best = df.groupBy(group).agg(F.max_by(F.struct(what, weight), F.struct(F.col(weight), -F.col("ord"))).alias("m"))
    return best.select(group, f"m.{what}", f"m.{weight}")


def coverage(parsed: Column, scanned: Column) -> Column:
    """Percent, one decimal; 0 where nothing was scanned."""
    return F.when(scanned == 0, F.lit(0.0)).otherwise(F.round(100.0 * parsed / scanned, 1))


def human_size(size: Column) -> Column:
    """B to TB by 1024, one decimal, halves to the even digit."""
    units = ["B", "KB", "MB", "GB", "TB"]
    out = F.format_string("%.1f TB", F.bround(size / F.lit(1024.0**4), 1))
    for i in range(3, -1, -1):
        out = F.when(size < F.lit(1024.0 ** (i + 1)), F.format_string(f"%.1f {units[i]}", F.bround(size / F.lit(1024.0**i), 1))).otherwise(out)
    return out


def group_fingerprint(df: DataFrame, group: str, line: Column) -> DataFrame:
    """group, fingerprint: md5 of the group's lines in order."""
    return df.groupBy(group).agg(F.md5(F.array_join(F.array_sort(F.collect_list(line)), "\n").cast("binary")).alias("fingerprint"))


def severity_rank(severity: Column) -> Column:
    return F.when(severity == "Error", 0).when(severity == "Warning", 1).when(severity == "Info", 2).otherwise(3)


def capped_sections(df: DataFrame, section: str, order: list[Column], cap: int) -> DataFrame:
    """section, shown, omitted: how many rows of a section a report shows and how many it leaves out. The cap is the feature."""
    return df.groupBy(section).agg(F.least(F.count("*"), F.lit(cap)).cast("long").alias("shown"), F.greatest(F.count("*") - cap, F.lit(0)).cast("long").alias("omitted"))


def last_label_before(rows: DataFrame, group: str, at: str, label: str) -> DataFrame:
    """Adds ``active``: the last label (not null) at or before the row."""
    seen = Window.partitionBy(group).orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("active", F.last(label, ignorenulls=True).over(seen))


def fragments(df: DataFrame, group: str, order: str) -> DataFrame:
    """Adds part_index (from 1) and total_parts."""
    return df.withColumn("part_index", F.row_number().over(Window.partitionBy(group).orderBy(order)).cast("long")).withColumn("total_parts", F.count("*").over(Window.partitionBy(group)))


def variants(name: Column, letters: str = "UAFI") -> Column:
    """The name, the name with each letter before it, and without its first letter if that is one of them: in order of preference."""
    cut = F.when(F.substring(name, 1, 1).isin(*letters), F.array(F.substring(name, 2, 1 << 30))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(F.array(name), F.array(*[F.concat(F.lit(x), name) for x in letters]), cut))


def lookup(names: DataFrame, wanted: DataFrame, letters: str = "UAFI") -> DataFrame:
    """wanted, name: the first variant of each wanted name that exists, letters in either case."""
    tried = wanted.select("wanted", F.posexplode(variants(F.col("wanted"), letters)).alias("pos", "variant"))
    found = tried.join(names.select("name", F.lower("name").alias("low")), F.lower("variant") == F.col("low"))
    return found.groupBy("wanted").agg(F.min(F.struct("pos", "name")).alias("m")).select("wanted", F.col("m.name").alias("name"))


def exact_or_unique(names: DataFrame, wanted: str) -> DataFrame:
    """name: the exact match, letters in either case; else the only one that contains it; nothing if several do."""
    low = F.lower("name")
    rows = names.filter(low.contains(wanted.lower())).withColumn("rank", F.when(low == wanted.lower(), 0).otherwise(1))
    every = Window.partitionBy()
    rows = rows.withColumn("best", F.min("rank").over(every)).filter("rank = best").withColumn("n", F.count("*").over(every))
    return rows.filter("n = 1").select("name")


def related_or_all(rows: DataFrame, related: Column) -> DataFrame:
    """The rows for which ``related`` holds, or all if none does."""
    marked = rows.withColumn("_r", related)
    some = marked.agg(F.coalesce(F.max("_r"), F.lit(False)).alias("_any"))
    return marked.join(F.broadcast(some)).filter(F.col("_r") | ~F.col("_any")).drop("_r", "_any")
