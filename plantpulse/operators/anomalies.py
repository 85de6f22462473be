"""Rule-based anomalies over hourly features."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, Window, functions as F

from plantpulse import rules
from plantpulse.functions import as_moment, between_moments, clamp, epoch_seconds, level, moment, step_points
from plantpulse.operators.numbering import number_by_bucket


def anomaly_score(features: DataFrame, *, points=rules.ANOMALY_POINTS) -> DataFrame:
    gained = sum((step_points(F.col(measure), steps) for measure, steps in points), F.lit(0))
    return features.withColumn("anomaly_score", clamp(gained).cast("long"))


def detect_anomalies(
    features: DataFrame, *, as_of: datetime, days: int = 7, min_score: int = rules.ANOMALY_KEEP
) -> DataFrame:
    """Scored hours of the last days, numbered by time, machine and signal.

    The rows of one hour are one numbering bucket: there are as many buckets as
    hours in the window, each with at most one row per sensor.
    """
    end = as_moment(as_of)
    recent = features.where(
        between_moments(F.col("hour_bucket"), end - timedelta(days=days), end)
    )
    kept = (
        anomaly_score(recent)
        .where(F.col("anomaly_score") >= min_score)
        .select(
            "machine_id",
            F.col("hour_bucket").alias("detection_timestamp"),
            F.col("signal_type").alias("affected_signal"),
            "anomaly_score",
            level(F.col("anomaly_score"), rules.ANOMALY_BANDS, None).alias("severity"),
            F.col("avg_value").alias("signal_value"),
            "rolling_24h_avg", "baseline_deviation_7d", "rate_of_change_6h",
            F.lit(rules.ANOMALY_MODEL).alias("model_id"),
            F.lit(rules.ANOMALY_MODEL_TEXT).alias("model_description"),
            moment(as_of).alias("created_at"),
        )
    )
    numbered = number_by_bucket(
        kept, "detection_timestamp", [F.col("machine_id"), F.col("affected_signal")], "anomaly_id"
    )
    return numbered.select("anomaly_id", *kept.columns)


def anomaly_rollup(anomalies: DataFrame, *, as_of: datetime, days: int = 7) -> DataFrame:
    """Serious anomalies of the last days per machine."""
    end = as_moment(as_of)
    when = F.col("detection_timestamp")
    return (
        anomalies.where(
            F.col("severity").isin("HIGH", "MEDIUM")
            & between_moments(when, end - timedelta(days=days), end)
        )
        .groupBy("machine_id")
        .agg(
            F.count("*").alias("anomaly_count"),
            F.min(when).alias("first_anomaly_time"),
            F.max(when).alias("latest_anomaly_time"),
            F.array_join(F.array_sort(F.collect_set("affected_signal")), ", ")
            .alias("affected_signals"),
        )
    )


def anomaly_groups(anomalies: DataFrame, *, gap_hours: int = 6) -> DataFrame:
    """Runs of anomalies of one machine that are at most ``gap_hours`` apart.

    Hours are counted per machine first: the window that finds the gaps sees
    one row per machine and hour.
    """
    hourly = anomalies.groupBy("machine_id", "detection_timestamp").agg(
        F.count("*").alias("_n"),
        F.max("anomaly_score").alias("_score"),
        F.collect_set("affected_signal").alias("_signals"),
    )
    by_time = Window.partitionBy("machine_id").orderBy("detection_timestamp")
    at = epoch_seconds(F.col("detection_timestamp"))
    starts = F.coalesce(at - F.lag(at).over(by_time) > gap_hours * 3600, F.lit(True))
    return (
        hourly.withColumn("_starts", starts.cast("int"))
        .withColumn("group_no", F.sum("_starts").over(by_time))
        .groupBy("machine_id", "group_no")
        .agg(
            F.min("detection_timestamp").alias("group_start"),
            F.max("detection_timestamp").alias("group_end"),
            F.sum("_n").alias("anomaly_count"),
            F.max("_score").alias("max_score"),
            F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("_signals")))), ", ")
            .alias("affected_signals"),
        )
    )
