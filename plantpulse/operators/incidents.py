"""Incidents: built from assessments, ranked by priority, triaged and announced."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from plantpulse import rules
from plantpulse.functions import clamp, half_up, hours_between, moment, rank_of
from plantpulse.functions.keys import incident_key
from plantpulse.operators.numbering import number_rows

PRIORITY_PARTS = [
    "health_points", "criticality_points", "production_points", "urgency_points",
    "confidence_points",
]


def _lookup(column: str, points: dict[str, int], other: int) -> Column:
    value = F.lit(other)
    for code, gain in points.items():
        value = F.when(F.col(column) == code, F.lit(gain)).otherwise(value)
    return value


def priority_score(source: DataFrame) -> DataFrame:
    """Adds the five parts of the priority and their sum, held within 0 to 100."""
    days = F.col("estimated_days_to_failure")
    urgency = F.lit(0)
    for limit, gain in reversed(rules.URGENCY_STEPS):
        urgency = F.when(days <= limit, F.lit(gain)).otherwise(urgency)
    rejects = F.lit(0)
    for limit, gain in reversed(rules.REJECT_STEPS):
        rejects = F.when(F.col("latest_reject_rate") > limit, F.lit(gain)).otherwise(rejects)
    health = F.coalesce("health_score", F.lit(float(rules.UNKNOWN_HEALTH)))
    parts = {
        "health_points": half_up((100 - health) * rules.HEALTH_WEIGHT, 2),
        "criticality_points": _lookup(
            "criticality", rules.CRITICALITY_POINTS, rules.OTHER_CRITICALITY_POINTS
        ),
        "production_points": F.when(
            F.col("latest_prod_status") == "DEGRADED", F.lit(rules.DEGRADED_POINTS)
        ).otherwise(rejects),
        "urgency_points": urgency,
        "confidence_points": _lookup("confidence_level", rules.CONFIDENCE_POINTS, 0),
    }
    scored = source.withColumns({name: part.cast("double") for name, part in parts.items()})
    total = sum((F.col(name) for name in PRIORITY_PARTS), F.lit(0.0))
    return scored.withColumn("priority_score", half_up(clamp(total), 2))


def incident_source(
    assessments: DataFrame, context: DataFrame, rollup: DataFrame
) -> DataFrame:
    """Assessments that call for action, with recent anomalies and production."""
    background = context.select(
        "machine_id", "latest_prod_status", "latest_reject_rate", "latest_actual_units",
        "parts_available", "min_lead_time_days",
    )
    return (
        assessments.where(F.col("recommendation").isin(*rules.RECOMMENDATIONS[:3]))
        .join(background, "machine_id")
        .join(rollup, "machine_id", "left")
    )


def build_incidents(
    assessments: DataFrame, context: DataFrame, rollup: DataFrame, *, as_of: datetime
) -> DataFrame:
    """One incident per machine that needs attention, numbered by urgency."""
    scored = priority_score(incident_source(assessments, context, rollup))
    urgency = rank_of(F.col("recommendation"), rules.RECOMMENDATIONS[:2], 3)
    severity = F.element_at(F.array(*[F.lit(s) for s in rules.INCIDENT_SEVERITIES]), urgency)
    now = moment(as_of)
    no_text = F.lit(None).cast("string")
    out = scored.select(
        urgency.alias("_urgency"),
        "machine_id", "machine_name", "machine_type", "criticality",
        F.col("first_anomaly_time").alias("incident_start"),
        F.col("latest_anomaly_time").alias("latest_activity"),
        hours_between(F.col("first_anomaly_time"), now).alias("incident_age_hours"),
        F.col("primary_failure_mode").alias("suspected_failure_mode"),
        "all_predicted_modes", "affected_signals",
        F.col("anomaly_count").alias("related_anomaly_count"),
        severity.alias("severity"),
        "health_score", "health_status", "risk_horizon",
        F.col("estimated_days_to_failure").alias("rul_days"),
        "confidence_level",
        F.col("latest_prod_status").alias("production_impact"),
        F.col("latest_reject_rate").alias("reject_rate_pct"),
        "evidence_narrative", "evidence_json", "priority_score",
        F.lit("NEW").alias("status"),
        no_text.alias("owner"),
        F.lit(None).cast("timestamp_ntz").alias("acknowledged_at"),
        no_text.alias("snooze_reason"),
        no_text.alias("escalation_status"),
        no_text.alias("resolution_reason"),
        no_text.alias("false_positive_reason"),
        "parts_available", "min_lead_time_days",
        now.alias("created_at"), now.alias("updated_at"),
    )
    order = [F.asc("_urgency"), F.asc_nulls_last("rul_days"), F.asc("machine_id")]
    numbered = number_rows(out, order, "_number")
    return numbered.select(
        incident_key(F.col("_number")).alias("incident_id"),
        *[c for c in out.columns if c != "_urgency"],
    )


def latest_command(commands: DataFrame, key: str) -> DataFrame:
    """The last command given for each key."""
    return commands.groupBy(key).agg(F.max_by("action", "command_seq").alias("action"))


def triage_update(incidents: DataFrame, commands: DataFrame, *, as_of: datetime) -> DataFrame:
    """Incidents after acknowledging or dismissing some; the last command counts."""
    valid = commands.where(F.col("action").isin("ACKNOWLEDGE", "FALSE_POSITIVE"))
    joined = incidents.join(latest_command(valid, "incident_id"), "incident_id", "left")
    status = (
        F.when(F.col("action") == "ACKNOWLEDGE", F.lit("ACKNOWLEDGED"))
        .when(F.col("action") == "FALSE_POSITIVE", F.lit("FALSE_POSITIVE"))
        .otherwise(F.col("status"))
    )
    changed = F.when(F.col("action").isNotNull(), moment(as_of)).otherwise(F.col("updated_at"))
    return joined.withColumns({"status": status, "updated_at": changed}).select(*incidents.columns)


def incident_notifications(
    incidents: DataFrame, log: DataFrame | None = None
) -> DataFrame:
    """A message for every new serious incident that the log does not hold yet."""
    message = F.concat(
        F.col("severity"), F.lit(" incident "), F.col("reference_id"), F.lit(" on "),
        F.col("machine_id"), F.lit(": "), F.col("suspected_failure_mode"), F.lit(". "),
        F.left(F.col("evidence_narrative"), F.lit(rules.NOTICE_LENGTH)),
    )
    due = incidents.where(
        (F.col("status") == "NEW") & F.col("severity").isin(*rules.NOTIFIED_SEVERITIES)
    ).withColumnRenamed("incident_id", "reference_id")
    if log is not None:
        due = due.join(log.select("reference_id", "severity"), ["reference_id", "severity"], "left_anti")
    return due.select(
        F.lit("INCIDENT_CREATED").alias("notification_type"),
        "reference_id", "machine_id", "severity", message.alias("message"),
    )


def cycle_summary(incidents: DataFrame, notifications: DataFrame) -> DataFrame:
    """How many incidents are new and how many messages went out."""
    sent = notifications.select(F.count("*")).scalar()
    counts = incidents.agg(F.count_if(F.col("status") == "NEW").alias("new_incidents"))
    return counts.withColumn("notifications", sent).withColumn(
        "message",
        F.concat(
            F.lit("Maintenance cycle complete. Incidents: "), F.col("new_incidents").cast("string"),
            F.lit(" new. Notifications: "), F.col("notifications").cast("string"),
        ),
    )


def carry_over(previous: DataFrame, current: DataFrame) -> DataFrame:
    """New incidents merged with the last snapshot.

    An incident that was still open for the same machine and failure mode keeps
    its number, state, owner and creation time; an open one that no longer
    appears is kept as it was.
    """
    closed = F.col("status").isin("RESOLVED", "FALSE_POSITIVE")
    key = ["machine_id", "suspected_failure_mode"]
    kept = [
        "incident_id", "status", "owner", "acknowledged_at", "snooze_reason",
        "escalation_status", "resolution_reason", "false_positive_reason", "created_at",
    ]
    open_before = previous.where(~closed)
    old = open_before.select(*key, F.lit(True).alias("_old"), *[F.col(c).alias(f"_old_{c}") for c in kept])
    merged = current.join(old, key, "left").withColumns(
        {c: F.when(F.col("_old"), F.col(f"_old_{c}")).otherwise(F.col(c)) for c in kept}
    ).select(*current.columns)
    return merged.unionByName(open_before.join(current.select(*key), key, "left_anti").select(*current.columns))


def incident_sla(
    incidents: DataFrame, *, as_of: datetime, hours: dict[str, int]
) -> DataFrame:
    """Age of each incident against the hours its severity allows."""
    allowed = F.lit(None).cast("int")
    for severity, limit in hours.items():
        allowed = F.when(F.col("severity") == severity, F.lit(limit)).otherwise(allowed)
    age = hours_between(F.col("incident_start"), moment(as_of))
    waiting = F.col("status").isin("NEW", "ACKNOWLEDGED")
    return incidents.select(
        "incident_id", "machine_id", "severity", "status",
        age.alias("age_hours"), allowed.alias("allowed_hours"),
        F.coalesce(waiting & (age > allowed), F.lit(False)).alias("overdue"),
    )
