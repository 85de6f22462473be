"""What the control room looks at: overviews, lists, trends and trust figures.

Functions that take ``machine_id`` show one machine; without it they cover the
fleet in one job. Lists are ordered at the end; ``limit`` turns the order into
a top-k.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window, functions as F

from plantpulse import rules
from plantpulse.functions import (
    as_moment, between_moments, half_up, minutes_between, moment, rank_of, ratio,
)
from plantpulse.operators.latest import newest
from plantpulse.operators.production import last_days

OEE_MEASURES = (
    ("availability_pct", "availability"),
    ("performance_pct", "performance"),
    ("quality_pct", "quality"),
    ("oee_pct", "oee"),
)


def _one(df: DataFrame, machine_id: str | None) -> DataFrame:
    return df if machine_id is None else df.where(F.col("machine_id") == machine_id)


def _listed(df: DataFrame, *order: Column, limit: int | None = None) -> DataFrame:
    ordered = df.orderBy(*order)
    return ordered if limit is None else ordered.limit(limit)


def _means(digits: int, prefix: str = "") -> list[Column]:
    return [half_up(F.avg(c), digits).alias(prefix + name) for c, name in OEE_MEASURES]


# --- command centre ---------------------------------------------------------

def command_center(
    incidents: DataFrame, machines: DataFrame, context: DataFrame, work_orders: DataFrame,
    *, one_order: bool = False,
) -> DataFrame:
    """Incidents with their machine, its background and its active orders.

    Every active order of the machine gives a row (as established);
    ``one_order`` keeps the first by number.
    """
    orders = work_orders.where(~F.col("status").isin(*rules.CLOSED_ORDER_STATES))
    if one_order:
        orders = newest(orders, "machine_id", F.asc("work_order_id"))
    orders = orders.select(
        "machine_id", "work_order_id",
        F.col("status").alias("work_order_status"),
        F.col("problem_description").alias("wo_problem"),
        F.col("recommended_actions").alias("wo_actions"),
        "estimated_repair_hrs", "assigned_technician",
    )
    background = context.select(
        "machine_id", "last_failure_mode", "last_root_cause", "days_since_last_maint",
        "failure_count", "total_maint_cost", "latest_obs_type", "latest_obs_detail",
        "latest_obs_severity",
    )
    shown = incidents.select(
        "incident_id", "machine_id", "machine_name", "machine_type", "criticality",
        "suspected_failure_mode", "all_predicted_modes",
        F.col("severity").alias("incident_severity"), "priority_score",
        F.col("status").alias("incident_status"), "incident_start", "latest_activity",
        "incident_age_hours", "related_anomaly_count", "affected_signals",
        "health_score", "health_status", "risk_horizon", "rul_days", "confidence_level",
        "evidence_narrative", "production_impact", "reject_rate_pct", "parts_available",
        "min_lead_time_days", F.col("created_at").alias("incident_created_at"),
    )
    return (
        shown.join(machines.select("machine_id", "line", "station", "location"), "machine_id")
        .join(background, "machine_id", "left")
        .join(orders, "machine_id", "left")
    )


def fleet_overlay(fleet: DataFrame, incidents: DataFrame) -> DataFrame:
    return fleet.select(
        "machine_id", "machine_name", "machine_type", "line", "criticality", "current_state",
        "health_score", "health_status", "concern_rank", "worst_signal_score",
        "worst_signal_type", "computed_at",
    ).join(
        incidents.select(
            "machine_id", "incident_id", F.col("severity").alias("incident_severity"),
            "priority_score", "rul_days", "suspected_failure_mode",
        ),
        "machine_id", "left",
    ).orderBy(F.asc_nulls_last("health_score"), "machine_id")


def station_summary(fleet: DataFrame, incidents: DataFrame, oee: DataFrame) -> DataFrame:
    """Counts of the overview page in one row."""
    severe = incidents.agg(
        F.count_if(F.col("severity") == "CRITICAL").alias("critical"),
        F.count_if(F.col("severity") == "HIGH").alias("high"),
    )
    quality = newest_day(oee).agg(half_up(F.avg("quality_pct"), 1))
    return fleet.agg(
        F.count("*").alias("total_machines"),
        F.count_if(F.col("current_state") == "RUNNING").alias("running"),
        F.count_if(F.col("health_status").isin("CRITICAL", "DEGRADED", "WARNING"))
        .alias("machines_at_risk"),
    ).withColumns({
        "critical_incidents": severe.select("critical").scalar(),
        "high_incidents": severe.select("high").scalar(),
        "avg_quality": quality.scalar(),
    })


def newest_day(oee: DataFrame) -> DataFrame:
    return oee.where(F.col("production_date") == oee.select(F.max("production_date")).scalar())


# --- incidents --------------------------------------------------------------

def incident_triage(
    incidents: DataFrame, work_orders: DataFrame, *,
    severities: Sequence[str] | None = None, statuses: Sequence[str] | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Incidents by priority with the state of their orders; no filter shows all."""
    if severities is not None:
        incidents = incidents.where(F.col("severity").isin(*severities))
    if statuses is not None:
        incidents = incidents.where(F.col("status").isin(*statuses))
    orders = work_orders.select(
        "incident_id", "work_order_id", F.col("status").alias("wo_status")
    )
    return _listed(
        incidents.join(orders, "incident_id", "left"),
        F.desc("priority_score"), F.asc("incident_id"), F.asc_nulls_last("work_order_id"),
        limit=limit,
    )


def priority_list(incidents: DataFrame, *, limit: int | None = None) -> DataFrame:
    return _listed(
        incidents.select(
            "incident_id", "machine_id", "severity", "priority_score", "health_score",
            "criticality", "production_impact", "rul_days", "confidence_level",
        ),
        F.desc("priority_score"), F.asc("incident_id"), limit=limit,
    )


def work_order_queue(
    work_orders: DataFrame, incidents: DataFrame, *, status: str | None = None
) -> DataFrame:
    """Orders by stage of life with the evidence of their incident."""
    if status is not None:
        work_orders = work_orders.where(F.col("status") == status)
    evidence = incidents.select(
        "incident_id", "evidence_narrative", F.col("health_score").alias("incident_health_score")
    )
    stage = rank_of(F.col("status"), rules.ORDER_STAGES, len(rules.ORDER_STAGES) + 1)
    return _listed(
        work_orders.join(evidence, "incident_id", "left").withColumn("stage_rank", stage),
        F.asc("stage_rank"), F.asc("work_order_id"),
    )


# --- one machine ------------------------------------------------------------

def machine_detail(fleet: DataFrame, *, machine_id: str | None = None) -> DataFrame:
    return _listed(_one(fleet, machine_id), F.asc("machine_id"))


def sensor_trend(features: DataFrame, *, machine_id: str | None = None) -> DataFrame:
    return _listed(
        _one(features, machine_id).select(
            "machine_id", "signal_type", "hour_bucket", "avg_value", "rolling_24h_avg"
        ),
        F.asc("machine_id"), F.asc("hour_bucket"), F.asc("signal_type"),
    )


def active_forecasts(forecasts: DataFrame, *, machine_id: str | None = None) -> DataFrame:
    return (
        _one(forecasts, machine_id)
        .where(F.col("predicted_failure_mode") != rules.NO_PREDICTION)
        .select(
            "machine_id", "signal_type", "predicted_failure_mode", "risk_horizon",
            "estimated_days_to_threshold", "confidence_level", "trend_slope_7d",
        )
    )


def assessment_lookup(assessments: DataFrame, *, machine_id: str | None = None) -> DataFrame:
    return _one(assessments, machine_id).select(
        "machine_id", "primary_failure_mode", "confidence_level", "recommendation",
        "evidence_narrative", "assessment_state",
    )


def recent_deviation(
    features: DataFrame, *, as_of: datetime, days: int = 7, machine_id: str | None = None
) -> DataFrame:
    """Latest deviation of each signal within the last days."""
    end = as_moment(as_of)
    recent = _one(features, machine_id).where(
        between_moments(F.col("hour_bucket"), end - timedelta(days=days), end)
    )
    return recent.groupBy("machine_id", "signal_type").agg(
        F.count("*").alias("hours"),
        F.max("hour_bucket").alias("latest_hour"),
        F.max_by("avg_value", "hour_bucket").alias("latest_avg"),
        F.max_by(F.coalesce("baseline_deviation_7d", F.lit(0.0)), "hour_bucket")
        .alias("latest_deviation"),
        F.max_by("rate_of_change_6h", "hour_bucket").alias("latest_rate_of_change"),
    )


# --- maintenance ------------------------------------------------------------

_CASE = ["maintenance_id", "machine_id", "failure_mode", "root_cause", "action_taken",
         "parts_replaced", "completed_at"]


def similar_cases(incidents: DataFrame, history: DataFrame, *, keep: int = 10) -> DataFrame:
    """Newest repairs with the incident's failure mode or on its machine.

    The best of each machine and the best of each failure mode are found once
    and then looked up, so no incident is paired with a whole history.
    """
    order = [F.desc_nulls_first("completed_at"), F.desc("maintenance_id")]
    cases = history.select(*_CASE)
    asked = incidents.select(
        "incident_id", F.col("machine_id").alias("_machine"), "suspected_failure_mode"
    )
    same_machine = asked.join(
        newest(cases, "machine_id", *order, keep=keep), F.col("machine_id") == F.col("_machine")
    )
    same_mode = asked.join(
        newest(cases, "failure_mode", *order, keep=keep),
        F.col("failure_mode") == F.col("suspected_failure_mode"),
    )
    both = same_machine.unionByName(same_mode).select("incident_id", *_CASE).distinct()
    ranked = Window.partitionBy("incident_id").orderBy(*order)
    return both.withColumn("case_rank", F.row_number().over(ranked).cast("long")).where(
        F.col("case_rank") <= keep
    )


def grounding_context(
    incidents: DataFrame, history: DataFrame, *, repairs: int = 3
) -> DataFrame:
    """Evidence and the last repairs of each incident's machine as text."""
    line = F.concat_ws(
        " | ", F.coalesce("failure_mode", F.lit("N/A")), F.coalesce("root_cause", F.lit("N/A")),
        F.coalesce("action_taken", F.lit("N/A")),
        F.coalesce(F.date_format("completed_at", "yyyy-MM-dd"), F.lit("open")),
    )
    order = [F.desc_nulls_first("completed_at"), F.desc("maintenance_id")]
    by_age = Window.partitionBy("machine_id").orderBy(*order)
    last = (
        newest(history, "machine_id", *order, keep=repairs)
        .select("machine_id", F.row_number().over(by_age).alias("_n"), line.alias("_line"))
        .groupBy("machine_id")
        .agg(F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("_n", "_line"))), lambda r: r["_line"]),
            "; ",
        ).alias("_lines"))
    )
    history_text = F.coalesce("_lines", F.lit("No prior maintenance records."))
    return incidents.join(last, "machine_id", "left").select(
        "incident_id", "machine_id",
        F.concat(
            F.lit("Machine: "), F.col("machine_id"), F.lit(" ("), F.col("machine_name"),
            F.lit("). Predicted failure: "), F.col("suspected_failure_mode"),
            F.lit(". Evidence: "), F.col("evidence_narrative"),
            F.lit(" Maintenance history: "), history_text, F.lit("."),
        ).alias("context"),
        F.to_json("evidence_json").alias("evidence_json"),
    )


def maintenance_log(
    history: DataFrame, machines: DataFrame, *, machine_id: str | None = None,
    limit: int | None = None,
) -> DataFrame:
    joined = _one(history, machine_id).join(
        machines.select("machine_id", "machine_name", "machine_type", "line"), "machine_id"
    )
    return _listed(
        joined.select(
            "maintenance_id", "machine_id", "machine_name", "machine_type", "line",
            "failure_mode", "root_cause", "action_taken", "parts_replaced",
            "repair_duration_hrs", "downtime_hrs", "cost", "maintenance_type", "completed_at",
        ),
        F.desc_nulls_first("completed_at"), F.desc("maintenance_id"), limit=limit,
    )


def failure_mode_distribution(history: DataFrame) -> DataFrame:
    return history.where(F.col("failure_mode") != "NONE").groupBy("failure_mode").agg(
        F.count("*").alias("repairs")
    )


def maintenance_cost(history: DataFrame, machines: DataFrame) -> DataFrame:
    """Cost per machine name, added up per machine before the names are joined."""
    per_machine = history.groupBy("machine_id").agg(F.sum("cost").alias("_cost"))
    return (
        per_machine.join(machines.select("machine_id", "machine_name"), "machine_id")
        .groupBy("machine_name")
        .agg(F.sum("_cost").cast("double").alias("total_cost"))
    )


def repeat_failures(history: DataFrame, machines: DataFrame) -> DataFrame:
    """Failure modes a machine had more than once."""
    repeated = (
        history.where(F.col("failure_mode").isNotNull())
        .groupBy("machine_id", "failure_mode")
        .agg(
            F.count("maintenance_id").alias("repairs"),
            F.sum("cost").cast("double").alias("total_cost"),
            half_up(F.sum("downtime_hrs"), 2).alias("total_downtime"),
        )
        .where(F.col("repairs") > 1)
    )
    return repeated.join(machines.select("machine_id", "machine_name"), "machine_id")


# --- production -------------------------------------------------------------

def oee_daily_trend(oee: DataFrame, *, days: int = rules.OEE_DAYS) -> DataFrame:
    """Fleet means of the last days with the change from the day before."""
    daily = last_days(oee, days).groupBy("production_date").agg(*_means(1))
    # One row per day of a window of fixed length, so this order needs no partition.
    by_day = Window.orderBy("production_date")
    previous = F.lag("oee").over(by_day)
    return daily.withColumn(
        "oee_delta", half_up(F.col("oee") - F.coalesce(previous, F.col("oee")), 1)
    ).orderBy("production_date")


def oee_by_machine(oee: DataFrame, *, days: int = rules.OEE_DAYS) -> DataFrame:
    return last_days(oee, days).groupBy("machine_id", "machine_name").agg(*_means(1))


def oee_summary(oee: DataFrame, *, days: int = rules.OEE_DAYS) -> DataFrame:
    """Means per machine with rejects and downtime, lowest effectiveness first."""
    return _listed(
        last_days(oee, days)
        .groupBy("machine_id", "machine_name", "line")
        .agg(
            *_means(1, "avg_"),
            F.sum("rejected_units").alias("total_rejects"),
            half_up(F.sum("downtime_hrs"), 2).alias("total_downtime"),
        ),
        F.asc_nulls_last("avg_oee"), F.asc("machine_id"),
    )


def oee_overall(summary: DataFrame) -> DataFrame:
    """Mean over machines of their means."""
    return summary.agg(
        *[half_up(F.avg(f"avg_{name}"), 1).alias(f"avg_{name}") for _, name in OEE_MEASURES]
    )


def oee_daily(oee: DataFrame) -> DataFrame:
    return (
        oee.groupBy("production_date")
        .agg(half_up(F.avg("oee_pct"), 2).alias("daily_oee"))
        .orderBy("production_date")
    )


# --- trust ------------------------------------------------------------------

def sensor_freshness(clean: DataFrame, *, as_of: datetime, days: int = 1) -> DataFrame:
    """Age of each sensor's last reading and its share of poor readings."""
    end = as_moment(as_of)
    when = F.col("reading_timestamp")
    bad = F.count_if(F.col("quality_flag") != "GOOD")
    out = (
        clean.where(between_moments(when, end - timedelta(days=days), end))
        .groupBy("machine_id", "signal_type")
        .agg(
            F.max(when).alias("latest_reading"),
            half_up(ratio(bad, F.count("*")) * 100, 2).alias("bad_quality_pct"),
        )
        .withColumn("minutes_since_last", minutes_between(F.col("latest_reading"), moment(end)))
    )
    return _listed(out, F.desc("minutes_since_last"), F.asc("machine_id"), F.asc("signal_type"))


def pipeline_status(refresh_log: DataFrame, *, as_of: datetime) -> DataFrame:
    """Last refresh of each dataset and whether its data are within the target lag."""
    last = refresh_log.groupBy("layer", "dataset").agg(
        F.max_by("state", "refreshed_at").alias("last_refresh_state"),
        F.max("refreshed_at").alias("last_refresh"),
        F.max("latest_data").alias("latest_data"),
        F.max_by("target_lag_sec", "refreshed_at").alias("target_lag_sec"),
        F.count("*").alias("refreshes"),
    )
    late = minutes_between(F.col("latest_data"), moment(as_of))
    return _listed(
        last.withColumn("minutes_behind", late).withColumn(
            "within_target", F.coalesce(late * 60 <= F.col("target_lag_sec"), F.lit(False))
        ),
        F.asc("layer"), F.asc("dataset"),
    )


def model_versions(forecasts: DataFrame, anomalies: DataFrame) -> DataFrame:
    def counted(df, version, kind):
        return df.groupBy(F.col(version).alias("version")).agg(
            F.lit(kind).alias("model_type"), F.count("*").alias("predictions")
        )

    return counted(forecasts, "model_version", "FAILURE_FORECAST").unionByName(
        counted(anomalies, "model_id", "ANOMALY_DETECTION")
    )


def confidence_distribution(forecasts: DataFrame) -> DataFrame:
    return forecasts.groupBy("confidence_level").agg(F.count("*").alias("forecasts"))


def fallback_cases(assessments: DataFrame) -> DataFrame:
    weak = F.col("confidence_level").isin("LOW", "INSUFFICIENT_DATA")
    return assessments.where((F.col("assessment_state") != "AUTOMATED_ASSESSMENT") | weak).select(
        "machine_id", "machine_name", "assessment_state", "confidence_level", "recommendation"
    )
