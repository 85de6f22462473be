"""Health scores of signals and machines."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, functions as F

from plantpulse import rules
from plantpulse.functions import as_moment, between_moments, clamp, half_up, level, moment, step_points
from plantpulse.operators.features import SERIES
from plantpulse.operators.numbering import rank_ascending


def latest_signal_features(
    features: DataFrame, *, as_of: datetime, hours: int = 24
) -> DataFrame:
    """Values of each series' last hour and totals over the last hours."""
    end = as_moment(as_of)

    def last(column):
        return F.max_by(column, "hour_bucket")

    return (
        features.where(between_moments(F.col("hour_bucket"), end - timedelta(hours=hours), end))
        .groupBy(*SERIES)
        .agg(
            F.max("hour_bucket").alias("latest_hour"),
            last("avg_value").alias("latest_avg"),
            last("rolling_24h_avg").alias("latest_24h_avg"),
            last("baseline_deviation_7d").alias("latest_baseline_dev"),
            last("rate_of_change_6h").alias("latest_roc"),
            F.sum("warning_count").alias("total_warnings_24h"),
            F.sum("critical_count").alias("total_criticals_24h"),
            F.sum("spike_count").alias("total_spikes_24h"),
            F.sum("bad_quality_count").alias("total_bad_quality_24h"),
        )
    )


def signal_health_score(latest: DataFrame, *, penalties=rules.HEALTH_PENALTIES) -> DataFrame:
    lost = sum((step_points(F.col(measure), steps) for measure, steps in penalties), F.lit(0))
    return latest.select(*SERIES, clamp(100 - lost).cast("long").alias("signal_health_score"))


def fleet_health(
    machines: DataFrame, context: DataFrame, scores: DataFrame, *, as_of: datetime,
    name_unknown: bool = False,
) -> DataFrame:
    """One row per machine: mean signal score, status, rank and worst signal.

    A machine without recent data gets the lowest status (as established);
    ``name_unknown`` calls it UNKNOWN instead.
    """
    score = F.col("signal_health_score")
    per_machine = scores.groupBy("machine_id").agg(
        F.avg(score).alias("_mean"),
        F.count_if(score < rules.AT_RISK_BELOW).alias("_at_risk"),
        F.min(F.struct(score.alias("score"), F.col("signal_type").alias("signal"))).alias("_worst"),
    )
    named = machines.select("machine_id", "machine_name", "machine_type", "line", "criticality")
    # Ranked before the context is joined, which so is read once.
    ranked = rank_ascending(named.join(per_machine, "machine_id", "left"), "_mean", "concern_rank")
    rows = ranked.join(
        context.select("machine_id", "current_state", "load_pct", "suppress_signals"),
        "machine_id", "left",
    )
    status = level(F.col("_mean"), rules.HEALTH_BANDS, rules.HEALTH_FLOOR)
    if name_unknown:
        status = F.when(F.col("_mean").isNull(), F.lit("UNKNOWN")).otherwise(status)
    return rows.select(
        "machine_id", "machine_name", "machine_type", "line", "criticality",
        "current_state", "load_pct", "suppress_signals",
        half_up(F.col("_mean"), 1).alias("health_score"),
        status.alias("health_status"),
        "concern_rank",
        F.coalesce("_at_risk", F.lit(0)).alias("signals_at_risk"),
        F.col("_worst.score").alias("worst_signal_score"),
        F.col("_worst.signal").alias("worst_signal_type"),
        moment(as_of).alias("computed_at"),
    )
