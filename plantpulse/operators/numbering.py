"""Consecutive numbers and ranks over a whole frame without a one-task window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from plantpulse.operators.durable import durable


def number_rows(df: DataFrame, order: Sequence[Column], name: str = "row_number") -> DataFrame:
    """Row numbers 1..n in the given order, which must not have ties.

    The rows are range-partitioned on the whole order, and that layout is made
    durable: partition numbers read twice must come from the same split. The
    counts to add up are one per partition.
    """
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = durable(
        df.repartitionByRange(tasks, *order).withColumn("_part", F.spark_partition_id())
    )
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_size"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset")
    )
    inside = Window.partitionBy("_part").orderBy(*order)
    return (
        placed.withColumn("_rn", F.row_number().over(inside))
        .join(F.broadcast(offsets), "_part")
        .withColumn(name, (F.col("_rn") + F.col("_offset")).cast("long"))
        .drop("_part", "_rn", "_offset")
    )


def number_by_bucket(
    df: DataFrame, bucket: str, order: Sequence[Column], name: str
) -> DataFrame:
    """Row numbers in (bucket, order) where the buckets are few and even.

    Nothing is materialised: bucket sizes are counted, added up, and joined to
    the numbers inside each bucket.
    """
    sizes = df.groupBy(bucket).agg(F.count("*").alias("_size"))
    before = Window.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        bucket, F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset")
    )
    inside = Window.partitionBy(bucket).orderBy(*order)
    return (
        df.withColumn("_rn", F.row_number().over(inside))
        .join(offsets, bucket)
        .withColumn(name, (F.col("_rn") + F.col("_offset")).cast("long"))
        .drop("_rn", "_offset")
    )


def rank_ascending(df: DataFrame, value: str, name: str) -> DataFrame:
    """RANK over the whole frame by a column with few distinct values, NULLs last.

    Equal values are counted before anything is ordered, so the ordered frame
    holds one row per distinct value.
    """
    counts = df.groupBy(value).agg(F.count("*").alias("_size"))
    before = Window.orderBy(F.asc_nulls_last(value)).rowsBetween(Window.unboundedPreceding, -1)
    ranks = counts.select(
        F.col(value).alias("_value"),
        (F.coalesce(F.sum("_size").over(before), F.lit(0)) + 1).cast("long").alias(name),
    )
    return df.join(ranks, F.col(value).eqNullSafe(F.col("_value"))).drop("_value")
