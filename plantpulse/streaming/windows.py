"""Event-time windows over clean readings and anomalies.

Watermarks need a zoned timestamp: event time is cast to one and back, so run
with ``spark.sql.session.timeZone=UTC``. A row later than the delay is dropped
here; the batch operators remain the way to reconcile.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from plantpulse import rules
from plantpulse.functions import half_up
from plantpulse.operators.readings import attach_sensors, normalize_units, quality_flag, threshold_status


def event_time(stream: DataFrame, column: str, delay: str) -> DataFrame:
    return stream.withColumn("event_time", F.col(column).cast("timestamp")).withWatermark(
        "event_time", delay
    )


def stateless_clean(readings: DataFrame, sensors: DataFrame) -> DataFrame:
    """Normalised value, threshold status and quality of each reading as it arrives."""
    joined = attach_sensors(readings, sensors)
    return threshold_status(normalize_units(quality_flag(joined))).select(
        "reading_id", "sensor_id", "machine_id", "signal_type", "reading_timestamp",
        F.col("reading_value").alias("raw_value"), "quality_flag", "normalized_value",
        "threshold_status", "warning_threshold", "critical_threshold", "unit",
    )


def _bounds(start: str, end: str | None = None) -> list[Column]:
    out = [F.col("window.start").cast("timestamp_ntz").alias(start)]
    if end:
        out.append(F.col("window.end").cast("timestamp_ntz").alias(end))
    return out


def hourly_stats_stream(clean: DataFrame, *, delay: str = "2 hours") -> DataFrame:
    """Tumbling hourly statistics; an hour is final once the watermark passes it."""
    value = F.col("normalized_value")
    return (
        event_time(clean, "reading_timestamp", delay)
        .groupBy("machine_id", "signal_type", F.window("event_time", "1 hour"))
        .agg(
            half_up(F.avg(value), 4).alias("avg_value"),
            half_up(F.max(value), 4).alias("max_value"),
            half_up(F.min(value), 4).alias("min_value"),
            half_up(F.stddev_samp(value), 4).alias("std_value"),
            F.count("*").alias("reading_count"),
            F.count_if(F.col("threshold_status") == "WARNING").alias("warning_count"),
            F.count_if(F.col("threshold_status") == "CRITICAL").alias("critical_count"),
            F.count_if(F.col("quality_flag") != "GOOD").alias("bad_quality_count"),
        )
        .select("machine_id", "signal_type", *_bounds("hour_bucket"), "avg_value", "max_value",
                "min_value", "std_value", "reading_count", "warning_count", "critical_count",
                "bad_quality_count")
    )


def sliding_mean_stream(
    clean: DataFrame, *, length: str = "6 hours", slide: str = "1 hour", delay: str = "2 hours"
) -> DataFrame:
    """Mean of all readings of the last hours, moved on every hour."""
    return (
        event_time(clean, "reading_timestamp", delay)
        .groupBy("machine_id", "signal_type", F.window("event_time", length, slide))
        .agg(
            half_up(F.avg("normalized_value"), 4).alias("mean_value"),
            F.count("*").alias("reading_count"),
        )
        .select("machine_id", "signal_type", *_bounds("window_start", "window_end"),
                "mean_value", "reading_count")
    )


def breach_sessions_stream(
    clean: DataFrame, *, gap: str = "6 hours", delay: str = "2 hours"
) -> DataFrame:
    """Runs of threshold breaches of one machine with pauses shorter than ``gap``."""
    breaches = clean.where(F.col("threshold_status") != "NORMAL")
    return (
        event_time(breaches, "reading_timestamp", delay)
        .groupBy("machine_id", F.session_window("event_time", gap).alias("window"))
        .agg(
            F.count("*").alias("breaches"),
            F.count_if(F.col("threshold_status") == "CRITICAL").alias("critical_breaches"),
        )
        .select("machine_id", *_bounds("session_start", "session_end"), "breaches",
                "critical_breaches")
    )


def notification_stream(
    incidents: DataFrame, *, event_column: str = "updated_at", delay: str = "1 hour"
) -> DataFrame:
    """One message per incident and severity within the delay, however often it is seen."""
    due = incidents.where(
        (F.col("status") == "NEW") & F.col("severity").isin(*rules.NOTIFIED_SEVERITIES)
    )
    once = event_time(due, event_column, delay).dropDuplicatesWithinWatermark(
        ["incident_id", "severity"]
    )
    from plantpulse.operators.incidents import incident_notifications

    return incident_notifications(once)
