"""Sinks: diagrams, pages and trees from small results, JSON and Parquet from any."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cordage.functions.text import escaped, file_safe, safe_id


def mermaid(edges: DataFrame, direction: str = "TD") -> DataFrame:
    """line: a flow chart of the edges (src, dst, optional label), one row per line, ordered by pos."""
    src, dst = F.col("src").cast("string"), F.col("dst").cast("string")
    label = F.col("label") if "label" in edges.columns else F.lit("")
    arrow = F.when(F.coalesce(label, F.lit("")) == "", " --> ").otherwise(F.concat(F.lit(" -->|"), label, F.lit("| ")))
    body = edges.select(F.concat(F.lit("    "), safe_id(src), F.lit('["'), escaped(src), F.lit('"]'), arrow, safe_id(dst), F.lit('["'), escaped(dst), F.lit('"]')).alias("line")).distinct().withColumn("pos", F.lit(1))
    head = edges.sparkSession.createDataFrame([(f"graph {direction}", 0)], "line string, pos int")
    return head.unionByName(body).orderBy("pos", "line")


def _lines(spark: SparkSession, head: str, body: DataFrame) -> DataFrame:
    """line, pos: the head, then the body's lines, each once."""
    first = spark.createDataFrame([(head, 0)], "line string, pos int")
    return first.unionByName(body.select("line").distinct().withColumn("pos", F.lit(1))).orderBy("pos", "line")


def call_label(cls: Column, method: Column, own: Column, dynamic: Column) -> Column:
    """A call's node: the method alone within the caller's class, else with its class; ? where that is unknown, and an arrow before a dynamic call."""
    name = F.when(cls.isNull(), F.concat(F.lit("?."), method)).when(cls == own, method).otherwise(F.concat_ws(".", cls, method))
    return F.concat(F.when(dynamic, F.lit("⇢ ")).otherwise(F.lit("")), name)


def flow_chart(calls: DataFrame) -> DataFrame:
    """line: a flow chart of calls (caller_cls, caller_method, callee_cls, callee_method, condition, is_dynamic), conditions on the arrows."""
    src, dst = F.concat_ws(".", "caller_cls", "caller_method"), F.concat_ws(".", F.coalesce("callee_cls", F.lit("?")), "callee_method")
    label = call_label(F.col("callee_cls"), F.col("callee_method"), F.col("caller_cls"), F.col("is_dynamic"))
    arrow = F.when(F.coalesce("condition", F.lit("")) == "", " --> ").otherwise(F.concat(F.lit(' -->|"'), escaped(F.col("condition")), F.lit('"| ')))
    body = calls.select(F.concat(F.lit("    "), safe_id(src), F.lit('["'), escaped(src), F.lit('"]'), arrow, safe_id(dst), F.lit('["'), escaped(label), F.lit('"]')).alias("line"))
    return _lines(calls.sparkSession, "flowchart TD", body)


def class_diagram(edges: DataFrame) -> DataFrame:
    """line: a class diagram of edges (src, dst, kind, member): inheritance points at the base, other kinds name their member."""
    src, dst = safe_id(F.col("src").cast("string")), safe_id(F.col("dst").cast("string"))
    other = F.concat(src, F.lit(" --> "), dst, F.when(F.coalesce("member", F.lit("")) == "", "").otherwise(F.concat(F.lit(" : "), F.col("member"))))
    body = edges.select(F.concat(F.lit("    "), F.when(F.col("kind") == "Inheritance", F.concat(dst, F.lit(" <|-- "), src)).otherwise(other)).alias("line"))
    return _lines(edges.sparkSession, "classDiagram", body)


def dot(edges: DataFrame, name: str = "G") -> DataFrame:
    """line: the same as a Graphviz digraph."""
    src, dst = F.col("src").cast("string"), F.col("dst").cast("string")
    body = edges.select(F.concat(F.lit('    "'), escaped(src), F.lit('" -> "'), escaped(dst), F.lit('";')).alias("line")).distinct().withColumn("pos", F.lit(1))
    ends = edges.sparkSession.createDataFrame([(f"digraph {name} {{", 0), ("}", 2)], "line string, pos int")
    return ends.unionByName(body).orderBy("pos", "line")


def as_json(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns)).alias("json"))


def tree(paths: list[list[str]], indent: str = "  ") -> str:
    """Indented text of a small result's paths, driver-side."""
    lines, seen = [], set()
    for p in sorted(paths):
        for i in range(len(p)):
            if (key := tuple(p[: i + 1])) not in seen:
                seen.add(key)
                lines.append(indent * i + p[i])
    return "\n".join(lines)


def pages(notes: DataFrame) -> DataFrame:
    """path, text of a Markdown page per note (id, type, title, body, fingerprint)."""
    head = F.concat(F.lit("---\ntitle: "), "title", F.lit("\ntype: "), "type", F.lit("\nsource_fingerprint: "), F.coalesce("fingerprint", F.lit("")), F.lit("\n---\n\n"))
    return notes.select(F.concat_ws("/", "type", F.concat(file_safe(F.col("title")), F.lit(".md"))).alias("path"), F.concat(head, "body").alias("text"))


def index(notes: DataFrame) -> DataFrame:
    """type, text: a list of links per type, by title."""
    entry = F.struct("title", F.concat(F.lit("- [["), "title", F.lit("]]")).alias("l"))
    return notes.groupBy("type").agg(F.array_sort(F.collect_list(entry)).alias("e")).select("type", F.array_join(F.col("e.l"), "\n").alias("text"))


def cached(spark: SparkSession, path: str, fingerprint: str, make) -> DataFrame:
    """The Parquet cache at ``path`` for this fingerprint, made by ``make()`` where it is not there yet."""
    place = f"{path}/{fingerprint}"
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(f"{place}/_SUCCESS")
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        make().write.mode("overwrite").parquet(place)
    return spark.read.parquet(place)
