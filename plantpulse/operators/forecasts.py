"""Daily trends and days until a signal reaches its critical limit."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from plantpulse import rules
from plantpulse.functions import day_floor, half_up, moment, ratio
from plantpulse.operators.features import SERIES
from plantpulse.operators.numbering import number_rows


def daily_trends(features: DataFrame) -> DataFrame:
    """Unweighted mean of the hourly means, and daily totals."""
    return features.groupBy(*SERIES, day_floor(F.col("hour_bucket")).alias("day_bucket")).agg(
        half_up(F.avg("avg_value"), 4).alias("daily_avg"),
        half_up(F.max("max_value"), 4).alias("daily_max"),
        F.sum("warning_count").alias("daily_warnings"),
        F.sum("critical_count").alias("daily_criticals"),
    )


def trend_slope(
    daily: DataFrame,
    *,
    recent: int = rules.TREND_RECENT_DAYS,
    prior: Sequence[int] = rules.TREND_PRIOR_DAYS,
    divisor: int = rules.TREND_DIVISOR,
) -> DataFrame:
    """Mean of the last days less the mean of earlier days, per day.

    All series are measured from the last day of the whole fleet, so a silent
    sensor has no slope. The slope is settled at ten decimals.
    """
    anchor = daily.select(F.max("day_bucket").cast("date")).scalar()
    age = F.datediff(anchor, F.col("day_bucket").cast("date"))
    value = F.col("daily_avg")
    change = F.avg(F.when(age <= recent, value)) - F.avg(
        F.when((age <= prior[0]) & (age >= prior[1]), value)
    )
    return (
        daily.withColumn("_age", age)
        .groupBy(*SERIES)
        .agg(
            F.max("day_bucket").alias("latest_day"),
            F.max_by("daily_avg", "day_bucket").alias("latest_avg"),
            F.max_by("daily_max", "day_bucket").alias("latest_max"),
            half_up(change / divisor, 10).alias("trend_slope_7d"),
        )
    )


def _mode(failure_rules) -> Column:
    slope = F.col("trend_slope_7d")
    mode = F.lit(rules.NO_PREDICTION)
    for signal, direction, limit, name in reversed(failure_rules):
        beyond = slope > limit if direction == "rising" else slope < limit
        mode = F.when((F.col("signal_type") == signal) & beyond, F.lit(name)).otherwise(mode)
    return mode


def failure_mode(slopes: DataFrame, *, failure_rules=rules.FAILURE_RULES) -> DataFrame:
    return slopes.withColumn("predicted_failure_mode", _mode(failure_rules))


def _days_left(low_side: bool) -> Column:
    """Days at the present slope; only a rising signal approaches an upper limit."""
    slope = F.col("trend_slope_7d")
    rising = F.when(
        slope > 0, ratio(F.col("critical_threshold") - F.col("latest_avg"), slope)
    )
    if not low_side:
        return rising
    falling = F.when(slope < 0, ratio(F.col("min_threshold") - F.col("latest_avg"), slope))
    return F.coalesce(rising, falling)


def risk_horizon(slopes: DataFrame, *, low_side: bool = False) -> DataFrame:
    """Days to the limit and the horizon they fall into.

    ``low_side`` also predicts when a falling signal meets its lower limit.
    """
    days = _days_left(low_side)
    moving = F.col("trend_slope_7d") > 0
    if low_side:
        moving = moving | days.isNotNull()
    horizon = F.when(moving, F.lit(rules.FAR_HORIZON)).otherwise(F.lit(rules.NO_HORIZON))
    for limit, name in reversed(rules.RISK_HORIZONS):
        horizon = F.when(days <= limit, F.lit(name)).otherwise(horizon)
    return slopes.withColumns(
        {"risk_horizon": horizon, "estimated_days_to_threshold": half_up(days, 1)}
    )


def forecast_confidence(slopes: DataFrame) -> DataFrame:
    steepness = F.abs(F.coalesce("trend_slope_7d", F.lit(0.0)))
    warned = F.col("latest_max") > F.coalesce("warning_threshold", F.lit(rules.UNSET_WARNING))
    confidence = F.lit(rules.NO_CONFIDENCE)
    for limit, name in reversed(rules.CONFIDENCE_STEPS):
        confidence = F.when(steepness > limit, F.lit(name)).otherwise(confidence)
    high = (steepness > rules.HIGH_CONFIDENCE_SLOPE) & warned
    return slopes.withColumn(
        "confidence_level", F.when(high, F.lit("HIGH")).otherwise(confidence)
    )


def slopes_with_limits(daily: DataFrame, sensors: DataFrame) -> DataFrame:
    """Slopes with the limits of the series' sensor.

    Where a machine has several sensors of one signal, the one named after machine
    and signal counts, or else the first by id: a series has one forecast.
    """
    limits = [c for c in ("warning_threshold", "critical_threshold", "min_threshold")
              if c in sensors.columns]
    if not limits:
        return trend_slope(daily).join(sensors.select(*SERIES).distinct(), SERIES)
    named = F.col("sensor_id") != F.concat_ws("-", *SERIES)
    one = sensors.groupBy(*SERIES).agg(
        F.min_by(F.struct(*limits), F.struct(named, "sensor_id")).alias("_limits")
    )
    return trend_slope(daily).join(one.select(*SERIES, "_limits.*"), SERIES)


def failure_forecasts(
    daily: DataFrame, sensors: DataFrame, *, as_of: datetime,
    failure_rules=rules.FAILURE_RULES, low_side: bool = False, numbered: bool = False,
) -> DataFrame:
    """One forecast per sensor. ``numbered`` adds forecast_id in series order."""
    judged = forecast_confidence(
        risk_horizon(
            failure_mode(slopes_with_limits(daily, sensors), failure_rules=failure_rules),
            low_side=low_side,
        )
    )
    out = judged.select(
        *SERIES,
        F.col("latest_day").alias("prediction_date"),
        "predicted_failure_mode", "risk_horizon", "estimated_days_to_threshold",
        F.col("latest_avg").alias("current_value"),
        "critical_threshold",
        half_up(F.col("trend_slope_7d"), 4).alias("trend_slope_7d"),
        "confidence_level",
        F.lit(rules.FORECAST_MODEL).alias("model_version"),
        moment(as_of).alias("prediction_timestamp"),
    )
    if not numbered:
        return out
    return number_rows(out, [F.col(c) for c in SERIES], "forecast_id").select(
        "forecast_id", *out.columns
    )
