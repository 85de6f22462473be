"""Work-order decisions over a stream of commands.

Orders are a table in steps, by buckets of their number: one snapshot and the
orders that later batches changed. A batch reads the buckets its commands name
and is applied as a whole by the same operator that serves a batch of commands:
however many commands one order receives, they are reduced to the deciding one
before they meet the order.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from plantpulse.operators.work_orders import apply_approvals
from plantpulse.sources.snapshots import SnapshotTable, bucket_of
from plantpulse.streaming.refresh import put_batch

#: Orders in a bucket, about, when a table is laid down.
BUCKET_ROWS = 1_000_000


def orders_table(spark: SparkSession, root: str, buckets: int | None = None) -> SnapshotTable:
    """Orders by buckets; without a number as many as the table was laid down with."""
    if buckets is None:
        buckets = int(spark.read.text(f"{root}/buckets").first()[0])
    return SnapshotTable(spark, f"{root}/orders", key=["work_order_id"], part=bucket_of("work_order_id", buckets))


def open_orders(work_orders: DataFrame, root: str, buckets: int | None = None) -> None:
    """Lay down the first snapshot, which later batches change."""
    spark = work_orders.sparkSession
    buckets = buckets or max(1, work_orders.count() // BUCKET_ROWS)
    spark.createDataFrame([(str(buckets),)], "value string").coalesce(1).write.mode("overwrite").text(f"{root}/buckets")
    orders_table(spark, root, buckets).replace(work_orders, batch=-1)


def current_orders(spark: SparkSession, root: str) -> DataFrame:
    """The orders as the last batch left them."""
    return orders_table(spark, root).read()


def decide_batch(
    batch: DataFrame, batch_id: int, *, root: str, as_of: datetime, compact_every: int | None = None
) -> None:
    """Write the outcome of a batch of commands and the orders it changed.

    A repeated batch meets the orders as they were before its first attempt.
    With ``compact_every`` every so many batches end with a new snapshot.
    """
    table = orders_table(batch.sparkSession, root)
    before = table.step(batch_id)
    named = batch.select("work_order_id").distinct().withColumn("_part", table.part)
    parts = [r._part for r in named.select("_part").distinct().collect() if r._part]  # at most all buckets
    orders = table.read(parts=parts, step=before).join(named.drop("_part"), "work_order_id", "left_semi")
    applied = apply_approvals(orders, batch, as_of=as_of)
    put_batch(applied.results, f"{root}/decisions", batch_id)
    drafts = orders.where(F.col("status") == "DRAFT").select("work_order_id")
    changed = applied.orders.join(drafts, "work_order_id", "left_semi").where(F.col("status") != "DRAFT")
    table.change(changed.select(*orders.columns), batch=batch_id)
    if compact_every and batch_id % compact_every == compact_every - 1:
        table.compact()
        table.vacuum()
