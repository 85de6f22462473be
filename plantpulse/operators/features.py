"""Hourly statistics and rolling features per machine and signal."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from plantpulse import rules
from plantpulse.functions import epoch_seconds, half_up, hour_floor, ratio

SERIES = ["machine_id", "signal_type"]


def hourly_stats(clean: DataFrame) -> DataFrame:
    """One row per machine, signal and hour. Aggregated before the shuffle, so a
    machine with very many readings sends no more rows than hours."""
    value = F.col("normalized_value")
    return clean.groupBy(
        *SERIES, hour_floor(F.col("reading_timestamp")).alias("hour_bucket")
    ).agg(
        half_up(F.avg(value), 4).alias("avg_value"),
        half_up(F.max(value), 4).alias("max_value"),
        half_up(F.min(value), 4).alias("min_value"),
        half_up(F.stddev_samp(value), 4).alias("std_value"),
        F.count("*").alias("reading_count"),
        F.count_if(F.col("threshold_status") == "WARNING").alias("warning_count"),
        F.count_if(F.col("threshold_status") == "CRITICAL").alias("critical_count"),
        F.count_if("is_spike").alias("spike_count"),
        F.count_if(F.col("quality_flag") != "GOOD").alias("bad_quality_count"),
    )


def rolling_features(hourly: DataFrame, *, frame: str = "rows") -> DataFrame:
    """Trailing means, change, deviation and variability of each series.

    ``frame="rows"`` counts hourly rows (as established); ``"time"`` counts
    hours, which differs where a series has gaps.
    """
    if frame == "rows":
        series = Window.partitionBy(*SERIES).orderBy("hour_bucket")
        recent = series.rowsBetween(1 - rules.DAY_FRAME, 0)
        earlier = F.lag("avg_value", rules.SHORT_FRAME).over(series)
        hourly, mean = _running_means(hourly, series)
    else:
        hour = F.floor(epoch_seconds(F.col("hour_bucket")) / 3600)
        series = Window.partitionBy(*SERIES).orderBy(hour)
        recent = series.rangeBetween(1 - rules.DAY_FRAME, 0)
        earlier = F.first("avg_value").over(
            series.rangeBetween(-rules.SHORT_FRAME, -rules.SHORT_FRAME)
        )

        def mean(n):
            return F.avg("avg_value").over(series.rangeBetween(1 - n, 0))

    avg = F.col("avg_value")
    return hourly.select(
        "*",
        half_up(mean(rules.SHORT_FRAME), 4).alias("rolling_6h_avg"),
        half_up(mean(rules.DAY_FRAME), 4).alias("rolling_24h_avg"),
        half_up(avg - earlier, 4).alias("rate_of_change_6h"),
        half_up(avg - mean(rules.WEEK_FRAME), 4).alias("baseline_deviation_7d"),
        half_up(F.stddev_samp("std_value").over(recent), 4).alias("variability_trend_24h"),
    ).drop("_total", "_count")


def _running_means(hourly: DataFrame, series):
    """Means over the last n rows from running totals.

    A frame of 168 rows is added up anew for every row; a running total less
    the total n rows earlier costs the same for any n. Hourly means have four
    decimals, so totals of ten-thousandths are whole numbers and exact.
    """
    so_far = series.rowsBetween(Window.unboundedPreceding, 0)
    units = F.round(F.col("avg_value") * 10_000).cast("long")
    totals = hourly.withColumns({
        "_total": F.coalesce(F.sum(units).over(so_far), F.lit(0).cast("long")),
        "_count": F.count("avg_value").over(so_far),
    })

    def mean(n):
        def within(column):
            return F.col(column) - F.lag(column, n, 0).over(series)

        return ratio(within("_total"), within("_count")) / 10_000

    return totals, mean


def signal_correlations(hourly: DataFrame, *, signals=rules.SIGNALS) -> DataFrame:
    """Correlation of every two signals of a machine, hour by hour: a row for each pair.

    Signals become columns and all pairs above the diagonal are one aggregation
    of co-moments, which each task adds up before the shuffle; no signal is
    joined with another. A pair without common hours, or of which one signal
    does not change, has no correlation.
    """
    wide = hourly.groupBy("machine_id", "hour_bucket").agg(
        *[F.max(F.when(F.col("signal_type") == s, F.col("avg_value"))).alias(s) for s in signals]
    )
    pairs = [(a, b) for i, a in enumerate(signals) for b in signals[i + 1:]]
    both = wide.groupBy("machine_id").agg(*[
        F.struct(
            F.lit(a).alias("signal_a"), F.lit(b).alias("signal_b"), half_up(F.corr(a, b), 6).alias("correlation"),
            F.count_if(F.col(a).isNotNull() & F.col(b).isNotNull()).alias("hours"),
        ).alias(f"_{i}")
        for i, (a, b) in enumerate(pairs)
    ])
    each = F.explode(F.array(*[F.col(f"_{i}") for i in range(len(pairs))]))
    return both.select("machine_id", each.alias("_pair")).select("machine_id", "_pair.*")


def signal_correlation(hourly: DataFrame) -> DataFrame:
    """Correlation of vibration with each other signal of a machine, hour by hour."""
    wide = hourly.groupBy("machine_id", "hour_bucket").agg(
        *[
            F.max(F.when(F.col("signal_type") == s, F.col("avg_value"))).alias(s.lower())
            for s in rules.SIGNALS
        ]
    )
    lead = rules.SIGNALS[0].lower()
    both = {
        s: F.count_if(F.col(lead).isNotNull() & F.col(s.lower()).isNotNull())
        for s in rules.SIGNALS[1:]
    }
    return wide.groupBy("machine_id").agg(
        *[c for s, n in both.items() for c in (
            half_up(F.corr(lead, s.lower()), 6).alias(f"corr_{s.lower()}"),
            n.alias(f"hours_{s.lower()}"),
        )]
    )
