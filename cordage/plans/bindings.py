"""The model relations, bound to tables of orders, customers, documents and pages, and the same in SQL.

The graph: customers are types, and the orders of one day and priority follow each other, each leading from its customer to the next
one's. All orders count. A customer has about ten, so the graph stays sparse at every size without a limit on its edges.
The SQL texts are common table expressions for DuckDB; each query's SQL starts with those that it needs.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CUTOFF = "1998-06-15"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def type_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers: name, namespace (nation), file_path (region)."""
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    rows = c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return rows.select(F.col("c_custkey").alias("name"), F.col("n_name").alias("namespace"), F.col("r_name").alias("file_path"))


def successor_edges(orders: DataFrame, kinds: bool = False) -> DataFrame:
    """src, dst, w: customers whose orders follow each other on a day, within a priority; with ``kinds`` also kind by that priority."""
    after = F.lead("o_custkey").over(Window.partitionBy("o_orderpriority", "o_orderdate").orderBy("o_orderkey"))
    kind = F.coalesce(F.create_map(*[F.lit(x) for x in ("1", "Field", "2", "Property", "3", "Parameter", "4", "Inheritance")])[F.substring("o_orderpriority", 1, 1)], F.lit("Field"))
    rows = orders.select(F.col("o_custkey").alias("src"), after.alias("dst"), kind.alias("kind")).filter("dst IS NOT NULL AND src != dst")
    return rows.groupBy(*(["src", "dst", "kind"] if kinds else ["src", "dst"])).agg(F.count("*").alias("w"))


def ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderdate")


def type_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return successor_edges(ordered(spark, sf_dir))


def kind_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, dst, kind, member, ord."""
    own = successor_edges(ordered(spark, sf_dir), kinds=True).select("src", "dst", "kind")
    return own.withColumn("member", F.concat_ws("_", F.lower("kind"), F.col("dst").cast("string"))).withColumn("ord", F.col("src") * 1000000 + F.col("dst"))


def hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """name, parent: customer, nation, region."""
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    text = lambda p, k: F.concat(F.lit(p), F.col(k).cast("string"))
    return c.select(text("c:", "c_custkey").alias("name"), text("n:", "c_nationkey").alias("parent")).unionByName(n.select(text("n:", "n_nationkey").alias("name"), text("r:", "n_regionkey").alias("parent")))


def call_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Successive events of a user: src, dst, condition (bucket of the value), ord."""
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    after = F.lead("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    bucket = F.floor(F.col("value") / 50).cast("long")
    condition = F.when(bucket % 2 == 0, F.concat(F.lit("switch: v"), bucket.cast("string"))).otherwise(F.concat(F.lit("if v"), bucket.cast("string")))
    return e.select(F.col("event_type").alias("src"), after.alias("dst"), condition.alias("condition"), F.col("event_id").alias("ord"), "user_id").filter("dst IS NOT NULL")


def wiki_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as notes: id, type (language), title (first 30 characters), body, fingerprint."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return d.select(F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("id"), F.col("lang").alias("type"), F.substring("text", 1, 30).alias("title"), F.col("text").alias("body"), F.md5(F.col("text").cast("binary")).alias("fingerprint"), "doc_id", "source")


_indexes: dict[tuple[str, str], str] = {}


def note_index(spark: SparkSession, sf_dir: str) -> str:
    """Path of the index of all notes as its version 1, built by the application's first query that asks for it; later versions may follow."""
    from cordage.operators.note_index import upsert
    from cordage.plans.iterate import shared_folder

    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _indexes:
        path = f"{shared_folder(spark)}/cordage/notes-{uuid.uuid4().hex}"
        upsert(spark, path, wiki_nodes(spark, sf_dir), names=False)
        _indexes[key] = path
    return _indexes[key]


NODES = "node AS (SELECT c_custkey AS name, n_name AS namespace, r_name AS file_path FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"


def edges_sql(name: str = "edge", where: str = "TRUE", kinds: bool = False) -> str:
    k = ", kind" if kinds else ""
    kind = ", CASE substring(o_orderpriority, 1, 1) WHEN '2' THEN 'Property' WHEN '3' THEN 'Parameter' WHEN '4' THEN 'Inheritance' ELSE 'Field' END AS kind" if kinds else ""
    return (
        f"{name}_0 AS (SELECT o_custkey AS src, lead(o_custkey) OVER (PARTITION BY o_orderpriority, o_orderdate ORDER BY o_orderkey) AS dst{kind} FROM orders WHERE {where}), "
        f"{name} AS (SELECT src, dst{k}, count(*) AS w FROM {name}_0 WHERE dst IS NOT NULL AND src <> dst GROUP BY src, dst{k})"
    )


EDGES = edges_sql()
KIND_EDGES = NODES + ", " + edges_sql("own", kinds=True) + ", kedge AS (SELECT src, dst, kind, lower(kind) || '_' || dst AS member, src * 1000000 + dst AS ord FROM own)"
HIERARCHY = "hier AS (SELECT 'c:' || c_custkey AS name, 'n:' || c_nationkey AS parent FROM customer UNION ALL SELECT 'n:' || n_nationkey, 'r:' || n_regionkey FROM nation)"
CALLS = (
    "call AS (SELECT event_type AS src, dst, CASE WHEN b % 2 = 0 THEN 'switch: v' || b ELSE 'if v' || b END AS condition, event_id AS ord, user_id FROM "
    "(SELECT *, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst, CAST(floor(value / 50) AS BIGINT) AS b FROM events) WHERE dst IS NOT NULL)"
)
WIKI = "wiki AS (SELECT 'doc:' || doc_id AS id, lang AS type, substring(text, 1, 30) AS title, text AS body, md5(text) AS fingerprint, doc_id, source FROM documents)"
