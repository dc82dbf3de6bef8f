"""Cutting the lineage of loops, and numbering whole tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_own_folder: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset on one machine (a local master) a temporary folder, on a cluster an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if spark.sparkContext.master.partition("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return _own_folder.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="cordage-"))


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is written inside go when it is written; else they stay until the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, was)


def cut(df: DataFrame) -> DataFrame:
    """``df`` written into the shared folder and read again: a loop's plan starts anew, with the sizes known to the optimizer."""
    return placed(df)[0]


def placed(df: DataFrame) -> tuple[DataFrame, str]:
    """The same, and the folder it is in, for those who delete it when it is read no more."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/cordage/round-{uuid.uuid4().hex}"
    with tidy(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def numbered(df: DataFrame, order: list[Column | str], out: str) -> DataFrame:
    """Adds ``out``: the row's number from 1 in the order of the whole table. Rows are dealt and numbered by ranges; one count per range comes together."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = ranged.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return ranged.withColumn("_inside", inside).join(counts, "_part").select(*df.columns, (F.col("_before") + F.col("_inside")).cast("long").alias(out))
