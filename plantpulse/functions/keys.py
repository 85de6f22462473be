"""Readable keys built from numbers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def padded(number: Column, width: int) -> Column:
    """Zero-padded text that never cuts off digits."""
    text = number.cast("string")
    return F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, "0"))


def order_key(number: Column) -> Column:
    return F.concat(F.lit("WO-"), padded(number, 4))


def incident_key(number: Column) -> Column:
    return F.concat(F.lit("INC-"), padded(number, 3))
