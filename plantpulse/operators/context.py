"""Operating state and maintenance background of each machine."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, functions as F

from plantpulse import rules
from plantpulse.functions import (
    as_moment, between_moments, days_between, epoch_seconds, half_up, moment, rank_of, ratio,
)
from plantpulse.operators.latest import newest


def latest_state_event(
    events: DataFrame, *, types: Sequence[str] = rules.STATE_EVENTS
) -> DataFrame:
    return newest(
        events.where(F.col("event_type").isin(*types)),
        "machine_id", F.desc("event_timestamp"), F.desc("event_id"),
    ).select("machine_id", "event_type", "event_code", "event_timestamp")


def recent_load(readings: DataFrame, *, as_of: datetime, hours: int = 6) -> DataFrame:
    """Mean speed and current of the last hours, both from one pass."""
    end = as_moment(as_of)

    def mean_of(signal):
        return half_up(F.avg(F.when(F.col("signal_type") == signal, F.col("reading_value"))), 2)

    return (
        readings.where(
            F.col("signal_type").isin("RPM", "CURRENT")
            & between_moments(F.col("reading_timestamp"), end - timedelta(hours=hours), end)
        )
        .groupBy("machine_id")
        .agg(mean_of("RPM").alias("avg_rpm"), mean_of("CURRENT").alias("avg_current"))
    )


def _percent_of(value: str, rating: str) -> Column:
    return F.when(
        F.col(rating) > 0, half_up(ratio(F.col(value), F.col(rating)) * 100, 1)
    )


def operating_context(
    machines: DataFrame, events: DataFrame, readings: DataFrame, *, as_of: datetime, hours: int = 6
) -> DataFrame:
    """Current state, load and suppression flag of every machine."""
    last = latest_state_event(events)
    load = recent_load(readings, as_of=as_of, hours=hours)
    joined = machines.join(last, "machine_id", "left").join(load, "machine_id", "left")
    kind = F.col("event_type")
    state = (
        F.when(kind == "SHUTDOWN", F.lit("OFFLINE"))
        .when(kind == "FAULT", F.lit("FAULT"))
        .when(F.col("event_code") == rules.HIGH_LOAD_CODE, F.lit("HIGH_LOAD"))
        .otherwise(F.col("operating_state"))
    )
    down = (kind == "SHUTDOWN") | F.col("operating_state").isin(*rules.SUPPRESSED_STATES)
    return joined.select(
        "machine_id", "machine_name", "machine_type", "line", "criticality",
        "rated_rpm", "rated_current",
        state.alias("current_state"),
        "avg_rpm",
        _percent_of("avg_rpm", "rated_rpm").alias("load_pct"),
        "avg_current",
        _percent_of("avg_current", "rated_current").alias("current_pct"),
        F.coalesce(down, F.lit(False)).alias("suppress_signals"),
        F.col("event_timestamp").alias("last_state_change"),
    )


def last_maintenance(history: DataFrame, *, as_of: datetime) -> DataFrame:
    """Latest maintenance per machine; one still open counts as the latest."""
    return newest(
        history, "machine_id", F.desc_nulls_first("completed_at"), F.desc("maintenance_id")
    ).select(
        "machine_id",
        F.col("maintenance_id").alias("last_maint_id"),
        F.col("failure_mode").alias("last_failure_mode"),
        F.col("root_cause").alias("last_root_cause"),
        F.col("completed_at").alias("last_maint_date"),
        days_between(F.col("completed_at"), moment(as_of)).alias("days_since_last_maint"),
    )


def maintenance_totals(history: DataFrame, *, failures_only: bool = False) -> DataFrame:
    """Count and cost per machine. ``failures_only`` leaves out preventive work."""
    if failures_only:
        history = history.where(F.coalesce(F.col("failure_mode"), F.lit("NONE")) != "NONE")
    return history.groupBy("machine_id").agg(
        F.count("*").alias("failure_count"), F.sum("cost").alias("total_maint_cost")
    )


def last_observation(shift_logs: DataFrame) -> DataFrame:
    return newest(
        shift_logs, "machine_id", F.desc("observed_at"), F.desc("log_id")
    ).select(
        "machine_id",
        F.col("observation_type").alias("latest_obs_type"),
        F.col("observation_detail").alias("latest_obs_detail"),
        F.col("severity").alias("latest_obs_severity"),
        F.col("observed_at").alias("latest_obs_time"),
    )


def latest_production(production: DataFrame, *, shift_order: str = "lexical") -> DataFrame:
    """Last production row per machine.

    Within a day the shift that sorts last by name is taken (as established);
    ``shift_order="ordinal"`` takes the one that runs last.
    """
    shift = F.col("shift")
    if shift_order == "ordinal":
        shift = rank_of(shift, rules.SHIFT_ORDER, 0)
    rate = F.when(
        F.col("actual_units") > 0,
        half_up(ratio(F.col("rejected_units"), F.col("actual_units")) * 100, 2),
    ).otherwise(0.0)
    return newest(
        production, "machine_id", F.desc("production_date"), F.desc(shift)
    ).select(
        "machine_id",
        F.col("production_status").alias("latest_prod_status"),
        F.col("actual_units").alias("latest_actual_units"),
        F.col("rejected_units").alias("latest_rejected_units"),
        rate.alias("latest_reject_rate"),
    )


def recent_events(events: DataFrame, *, as_of: datetime, days: int = 7) -> DataFrame:
    end = as_moment(as_of)
    return (
        events.where(between_moments(F.col("event_timestamp"), end - timedelta(days=days), end))
        .groupBy("machine_id")
        .agg(
            F.count("*").alias("recent_event_count"),
            F.count_if(F.col("severity") == "CRITICAL").alias("recent_critical_events"),
        )
    )


def parts_availability(machines: DataFrame, parts: DataFrame) -> DataFrame:
    """Parts in stock and shortest lead time per machine.

    The comma list is exploded and counted per machine type first, so the join
    with the machines has one row per type on its right side.
    """
    per_type = (
        parts.where(F.col("quantity_on_hand") > 0)
        .select(
            "part_id", "lead_time_days",
            F.explode(F.array_distinct(F.split("compatible_machine_types", r"\s*,\s*")))
            .alias("machine_type"),
        )
        .groupBy("machine_type")
        .agg(
            F.count_distinct("part_id").alias("parts_available"),
            F.min("lead_time_days").alias("min_lead_time_days"),
        )
    )
    return machines.select("machine_id", "machine_type").join(per_type, "machine_type").select(
        "machine_id", "parts_available", "min_lead_time_days"
    )


def maintenance_context(
    fleet: DataFrame,
    history: DataFrame,
    shift_logs: DataFrame,
    production: DataFrame,
    events: DataFrame,
    machines: DataFrame,
    parts: DataFrame,
    *,
    as_of: datetime,
) -> DataFrame:
    """Fleet health with each machine's maintenance, observation, output and parts.

    Every side is reduced to one row per machine before it is joined.
    """
    sides = (
        last_maintenance(history, as_of=as_of),
        maintenance_totals(history),
        last_observation(shift_logs),
        latest_production(production),
        recent_events(events, as_of=as_of),
        parts_availability(machines, parts),
    )
    out = fleet.select(
        "machine_id", "machine_name", "machine_type", "line", "criticality", "current_state",
        "health_score", "health_status", "concern_rank", "worst_signal_type",
        "worst_signal_score", "signals_at_risk", "computed_at",
    )
    for side in sides:
        out = out.join(side, "machine_id", "left")
    return out


def repair_effect(
    features: DataFrame, history: DataFrame, *, hours: int = 72
) -> DataFrame:
    """Mean signal value in the hours before and after each completed repair.

    Repair moments and hours are cut into blocks of ``hours``; a moment looks
    at the block before, its own and the next, so the join is on equal blocks
    and a repair meets only the hours around it. Repairs of a machine at the
    same moment are compared once.
    """
    span = hours * 3600
    at = F.col("_at")
    block = F.floor(at / span)
    repairs = history.where(F.col("completed_at").isNotNull()).select(
        "maintenance_id", "machine_id", epoch_seconds(F.col("completed_at")).alias("_at")
    )
    moments = repairs.select("machine_id", "_at").distinct().withColumn(
        "_block", F.explode(F.array(block - 1, block, block + 1))
    )
    hour = epoch_seconds(F.col("hour_bucket"))
    hourly = features.select(
        "machine_id", "signal_type", "avg_value", hour.alias("_hour"),
        F.floor(hour / span).alias("_block"),
    )
    gap = F.col("_hour") - F.col("_at")
    value = F.col("avg_value")
    before = F.avg(F.when((gap >= -span) & (gap < 0), value))
    after = F.avg(F.when((gap >= 0) & (gap < span), value))
    effects = (
        moments.join(hourly, ["machine_id", "_block"])
        .groupBy("machine_id", "_at", "signal_type")
        .agg(half_up(before, 4).alias("before_avg"), half_up(after, 4).alias("after_avg"),
             half_up(after - before, 4).alias("change"))
        .where(F.col("before_avg").isNotNull() | F.col("after_avg").isNotNull())
    )
    return repairs.join(effects, ["machine_id", "_at"]).select(
        "maintenance_id", "machine_id", "signal_type", "before_avg", "after_avg", "change"
    )
