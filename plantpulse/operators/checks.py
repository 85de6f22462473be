"""End-to-end checks: each gives figures and says whether they are as expected."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from plantpulse.functions import half_up, moment
from plantpulse.operators.production import last_days


def trend_early_late(
    readings: DataFrame, *, early_before: datetime, late_after: datetime, min_rise: float = 0.0
) -> DataFrame:
    """Mean of each series before one moment and after another."""
    when, value = F.col("reading_timestamp"), F.col("reading_value")
    return (
        readings.groupBy("machine_id", "signal_type")
        .agg(
            half_up(F.avg(F.when(when < moment(early_before), value)), 2).alias("early_avg"),
            half_up(F.avg(F.when(when > moment(late_after), value)), 2).alias("late_avg"),
        )
        .withColumn(
            "passed",
            F.coalesce(F.col("late_avg") - F.col("early_avg") >= min_rise, F.lit(False)),
        )
    )


def quality_counts(clean: DataFrame, *, expected: Mapping[str, int] | None = None) -> DataFrame:
    """Readings per series and quality flag; ``expected`` gives the least per flag."""
    least = F.lit(0)
    for flag, count in (expected or {}).items():
        least = F.when(F.col("quality_flag") == flag, F.lit(count)).otherwise(least)
    return (
        clean.groupBy("machine_id", "signal_type", "quality_flag")
        .agg(F.count("*").alias("readings"))
        .withColumn("passed", F.col("readings") >= least)
    )


def row_counts(datasets: Mapping[str, DataFrame], *, at_least: int = 1) -> DataFrame:
    """Rows of every dataset. Only counts meet in the union."""
    counts = [
        df.agg(F.count("*").alias("rows_ct")).withColumn("tbl", F.lit(name))
        for name, df in datasets.items()
    ]
    return (
        reduce(DataFrame.unionByName, counts)
        .withColumn("passed", F.col("rows_ct") >= at_least)
        .orderBy("tbl")
    )


def priority_check(incidents: DataFrame) -> DataFrame:
    """Every priority lies within its range and has the figures it is made of."""
    score = F.col("priority_score")
    return incidents.select(
        "incident_id", "priority_score",
        (score.between(0, 100) & F.col("criticality").isNotNull()).alias("passed"),
    )


def oee_check(oee: DataFrame, *, days: int = 7) -> DataFrame:
    """Means per machine over the last days; they must be above zero."""
    return (
        last_days(oee, days)
        .groupBy("machine_id", "machine_name")
        .agg(
            half_up(F.avg("oee_pct"), 1).alias("avg_oee"),
            half_up(F.avg("availability_pct"), 1).alias("avg_avail"),
            half_up(F.avg("quality_pct"), 1).alias("avg_quality"),
        )
        .withColumn("passed", F.coalesce(F.col("avg_oee") > 0, F.lit(False)))
        .orderBy(F.desc("avg_oee"), F.asc("machine_id"))
    )
