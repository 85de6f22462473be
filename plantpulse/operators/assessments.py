"""Evidence per machine and the recommendation drawn from it."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from plantpulse import rules
from plantpulse.functions import moment, rank_of, scaled_text
from plantpulse.operators.numbering import number_rows

BACKGROUND = [
    "last_failure_mode", "last_root_cause", "days_since_last_maint", "failure_count",
    "latest_obs_type", "latest_obs_detail", "latest_obs_severity",
    "latest_prod_status", "latest_reject_rate",
]
MACHINE = ["machine_name", "machine_type", "criticality", "health_score", "health_status"]


def _by_severity(column: str, order, kept: Column) -> Column:
    """The most severe code of a fixed order among the kept rows."""
    ranked = F.struct(rank_of(F.col(column), order, len(order) + 1).alias("r"), F.col(column).alias("v"))
    return F.min(F.when(kept & F.col(column).isNotNull(), ranked))["v"]


def machine_evidence(
    forecasts: DataFrame, context: DataFrame, *,
    ordering: str = "lexical", confidence_scope: str = "predicted",
) -> DataFrame:
    """Forecasts of a machine in one row, with its background.

    ``ordering="lexical"`` compares horizons and confidences as text (as
    established: the smallest horizon and the largest confidence); ``"ordinal"``
    compares what they mean. ``confidence_scope`` is ``"predicted"`` for
    forecasts with a failure mode or ``"all"``.
    """
    predicted = F.col("predicted_failure_mode") != rules.NO_PREDICTION
    trusted = predicted if confidence_scope == "predicted" else F.lit(True)
    if ordering == "lexical":
        horizon = F.min(F.when(predicted, F.col("risk_horizon")))
        confidence = F.max(F.when(trusted, F.col("confidence_level")))
    else:
        horizon = _by_severity("risk_horizon", rules.HORIZON_ORDER, predicted)
        confidence = _by_severity("confidence_level", rules.CONFIDENCE_ORDER, trusted)
    modes = F.array_sort(F.collect_set(F.when(predicted, F.col("predicted_failure_mode"))))
    signals = []
    for short, signal in rules.EVIDENCE_SIGNALS:
        this = F.col("signal_type") == signal
        signals += [
            F.max(F.when(this, F.col("current_value"))).alias(f"{short}_current"),
            F.max(F.when(this, F.col("trend_slope_7d"))).alias(f"{short}_slope"),
        ]
    per_machine = forecasts.groupBy("machine_id").agg(
        F.when(F.size(modes) > 0, F.array_join(modes, ", ")).alias("predicted_modes"),
        F.min(F.when(predicted, F.col("estimated_days_to_threshold")))
        .alias("min_days_to_threshold"),
        horizon.alias("worst_risk_horizon"),
        confidence.alias("max_confidence"),
        *signals,
    )
    return per_machine.join(context.select("machine_id", *MACHINE, *BACKGROUND), "machine_id")


def evidence_object(evidence: DataFrame) -> DataFrame:
    """Evidence as one nested value; ``to_json`` turns it into text at the edge."""

    def signal(short):
        return F.struct(
            F.col(f"{short}_current").alias("value"), F.col(f"{short}_slope").alias("trend_per_day")
        )

    names = ("vibration", "temperature", "current", "pressure")
    parts = [
        signal(short).alias(name) for (short, _), name in zip(rules.EVIDENCE_SIGNALS, names)
    ]
    parts += [
        F.struct(
            F.col("last_failure_mode"), F.col("last_root_cause"),
            F.col("days_since_last_maint").alias("days_since_last"),
            F.col("failure_count").alias("total_failures"),
        ).alias("maintenance_history"),
        F.struct(
            F.col("latest_obs_type").alias("type"), F.col("latest_obs_detail").alias("detail"),
            F.col("latest_obs_severity").alias("severity"),
        ).alias("operator_observation"),
        F.struct(
            F.col("latest_prod_status").alias("status"),
            F.col("latest_reject_rate").alias("reject_rate_pct"),
        ).alias("production"),
    ]
    return evidence.withColumn("evidence_json", F.struct(*parts))


def evidence_narrative(evidence: DataFrame) -> DataFrame:
    """The evidence as a sentence per finding."""

    def said(condition: Column, *pieces) -> Column:
        text = F.concat(*[F.lit(p) if isinstance(p, str) else p for p in pieces])
        return F.when(condition, text).otherwise(F.lit(""))

    def number(name, digits):
        return scaled_text(F.col(name), digits)

    drop = scaled_text(F.abs(F.col("press_slope")), 1)
    sentences = [
        said(F.col("vib_slope") > 0.1, "Vibration trending up at ", number("vib_slope", 2),
             " mm/s per day (current: ", number("vib_current", 1), " mm/s). "),
        said(F.col("temp_slope") > 0.5, "Temperature rising at ", number("temp_slope", 1),
             " C/day (current: ", number("temp_current", 1), " C). "),
        said(F.col("curr_slope") > 0.3, "Current draw increasing at ", number("curr_slope", 2),
             " A/day. "),
        said(F.col("press_slope") < -1.0, "Pressure dropping at ", drop, " bar/day. "),
        said(F.col("last_failure_mode").isNotNull(), "Prior failure: ",
             F.col("last_failure_mode"), ". "),
        said(F.col("latest_obs_severity").isin(*rules.REPORTED_SEVERITIES),
             "Operator reported: ", F.col("latest_obs_detail"), ". "),
        said(F.col("latest_prod_status") == "DEGRADED", "Production status: DEGRADED. "),
    ]
    head = F.concat(
        F.col("machine_name"), F.lit(" ("), F.col("machine_type"), F.lit(", "),
        F.col("criticality"), F.lit(" criticality): "),
    )
    return evidence.withColumn("evidence_narrative", F.concat(head, *sentences))


def recommendation(evidence: DataFrame) -> DataFrame:
    immediate, schedule, watch, routine = rules.RECOMMENDATIONS
    days = F.col("min_days_to_threshold")
    urgent = (days <= rules.IMMEDIATE_DAYS) & (F.col("max_confidence") == "HIGH")
    return evidence.withColumn(
        "recommendation",
        F.when(urgent, F.lit(immediate))
        .when(days <= rules.SCHEDULE_DAYS, F.lit(schedule))
        .when(F.col("predicted_modes").isNotNull(), F.lit(watch))
        .otherwise(F.lit(routine)),
    )


def assessment_state(evidence: DataFrame) -> DataFrame:
    return evidence.withColumn(
        "assessment_state",
        F.when(F.col("max_confidence") == rules.NO_CONFIDENCE,
               F.lit("MANUAL_INSPECTION_RECOMMENDED"))
        .when(F.col("health_score").isNull(), F.lit("MISSING_DATA"))
        .otherwise(F.lit("AUTOMATED_ASSESSMENT")),
    )


def failure_assessments(
    forecasts: DataFrame, context: DataFrame, *, as_of: datetime,
    ordering: str = "lexical", confidence_scope: str = "predicted", numbered: bool = False,
) -> DataFrame:
    """One assessment per machine. ``numbered`` adds assessment_id by urgency."""
    evidence = machine_evidence(
        forecasts, context, ordering=ordering, confidence_scope=confidence_scope
    )
    judged = assessment_state(recommendation(evidence_narrative(evidence_object(evidence))))
    out = judged.select(
        "machine_id", *MACHINE,
        F.coalesce(F.split_part("predicted_modes", F.lit(","), F.lit(1)), F.lit(rules.NO_MODE))
        .alias("primary_failure_mode"),
        F.col("predicted_modes").alias("all_predicted_modes"),
        F.col("worst_risk_horizon").alias("risk_horizon"),
        F.col("min_days_to_threshold").alias("estimated_days_to_failure"),
        F.col("max_confidence").alias("confidence_level"),
        "evidence_json", "evidence_narrative", "recommendation", "assessment_state",
        moment(as_of).alias("assessed_at"),
    )
    if not numbered:
        return out
    order = [
        F.asc_nulls_last("estimated_days_to_failure"), F.asc_nulls_last("health_score"),
        F.asc("machine_id"),
    ]
    return number_rows(out, order, "assessment_id").select("assessment_id", *out.columns)
