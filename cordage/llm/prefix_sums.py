"""Running sums over groups of any size, and over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cordage.llm.common import staged, whole_parts


def exclusive_sums(df: DataFrame, group: list[str], bucket: str, order: list[str | Column], value: str, out: str) -> DataFrame:
    """Adds ``out``: within ``group``, the sum of ``value`` over all rows before this one, by
    (``bucket``, ``order``). ``df`` is read twice, so it should be staged.

    No task orders a whole group: each sums one bucket of it, and the buckets' totals, as many
    rows as there are buckets, are summed apart.
    """
    totals = df.groupBy(*group, bucket).agg(F.sum(value).alias("_total"))
    before = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*group, bucket, F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(*group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = df.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return rows.join(totals, [*group, bucket]).withColumn(out, F.col("_base") + F.col("_inside")).drop("_base", "_inside")


def table_sums(df: DataFrame, order: list[str | Column], values: dict[str, Column]) -> DataFrame:
    """Adds, for every name in ``values``, the sum of its column over all rows of the table before this one, by ``order``.

    Rows are dealt by ranges of ``order`` and summed there; only one row of totals per range comes together.
    """
    kinds = dict(df.select(*[F.sum(v).alias(k) for k, v in values.items()]).dtypes)
    ranged = staged(df.repartitionByRange(whole_parts(df.sparkSession), *order).withColumn("_part", F.spark_partition_id()), "ranges")
    nothing = {k: F.lit(0).cast(kinds[k]) for k in values}
    totals = ranged.groupBy("_part").agg(*[F.sum(v).alias(f"_total_{k}") for k, v in values.items()])
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("_part", *[F.coalesce(F.sum(f"_total_{k}").over(before), nothing[k]).alias(f"_base_{k}") for k in values])
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = ranged.select("*", *[F.coalesce(F.sum(v).over(inside), nothing[k]).alias(f"_inside_{k}") for k, v in values.items()])
    return rows.join(totals, "_part").select(*df.columns, *[(F.col(f"_base_{k}") + F.col(f"_inside_{k}")).alias(k) for k in values])
