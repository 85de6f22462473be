"""Newest row per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def newest(df: DataFrame, key: str | Sequence[str], *order: Column, keep: int = 1) -> DataFrame:
    """The first ``keep`` rows of each key in the given order.

    Written as a row number with a filter: Spark then keeps at most ``keep``
    rows per key in every task before it shuffles, whatever the key's size.
    """
    keys = [key] if isinstance(key, str) else key
    ranked = Window.partitionBy(*keys).orderBy(*order)
    return (
        df.withColumn("_rn", F.row_number().over(ranked)).where(F.col("_rn") <= keep).drop("_rn")
    )
