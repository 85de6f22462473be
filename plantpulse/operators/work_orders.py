"""Work orders: drafted from incidents, approved or rejected, and resolved.

Commands come as rows and are applied to a whole snapshot at once. What each
command finds is what it would find if they were given one after another.
"""

from __future__ import annotations

from datetime import datetime
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from plantpulse import rules
from plantpulse.functions import moment, plain_number
from plantpulse.functions.keys import order_key
from plantpulse.operators.latest import newest
from plantpulse.operators.numbering import number_rows
from plantpulse.sources.store import patch


class Drafts(NamedTuple):
    orders: DataFrame
    rejected: DataFrame
    incidents: DataFrame


class Applied(NamedTuple):
    orders: DataFrame
    results: DataFrame
    incidents: DataFrame | None


def is_active(status: Column) -> Column:
    return ~status.isin(*rules.CLOSED_ORDER_STATES)


def active_order_duplicates(incidents: DataFrame, work_orders: DataFrame) -> DataFrame:
    """Incidents whose machine and failure mode already have an active order."""
    active = work_orders.where(is_active(F.col("status"))).select(
        "machine_id", F.col("predicted_failure_mode").alias("suspected_failure_mode")
    )
    return incidents.join(active, ["machine_id", "suspected_failure_mode"], "left_semi")


def _template(part: int) -> Column:
    value = F.lit(rules.ACTION_TEMPLATES[-1][part])
    for row in reversed(rules.ACTION_TEMPLATES[:-1]):
        value = F.when(F.col("suspected_failure_mode") == row[0], F.lit(row[part])).otherwise(value)
    return value


def action_template(incidents: DataFrame) -> DataFrame:
    """What to do about the suspected failure, and how long it takes."""
    return incidents.withColumns({
        "recommended_actions": _template(1),
        "estimated_repair_hrs": _template(2),
        "estimated_downtime_hrs": _template(3),
    })


def maintenance_window(incidents: DataFrame) -> DataFrame:
    window = F.lit(rules.ORDER_WINDOWS[-1][1])
    for severity, text in reversed(rules.ORDER_WINDOWS[:-1]):
        window = F.when(F.col("severity") == severity, F.lit(text)).otherwise(window)
    return incidents.withColumn("recommended_window", window)


def allocate_order_ids(accepted: DataFrame, work_orders: DataFrame) -> DataFrame:
    """Order numbers that follow the highest one in use, by priority."""
    number = F.expr("substring(work_order_id, 4)").try_cast("decimal(38,0)")
    highest = work_orders.select(F.coalesce(F.max(number), F.lit(0).cast("decimal(38,0)"))).scalar()
    order = [F.desc("priority_score"), F.asc("incident_id")]
    return (
        number_rows(accepted, order, "_number")
        .withColumn("work_order_id", order_key(F.col("_number") + highest))
        .drop("_number")
    )


def draft_work_orders(
    incidents: DataFrame, work_orders: DataFrame, requested: DataFrame, *, as_of: datetime
) -> Drafts:
    """Drafts for the requested incidents.

    ``requested`` has one column, incident_id. Of several incidents with the
    same machine and failure mode the most urgent gets the order.
    """
    asked = requested.select("incident_id").distinct()
    known = incidents.join(asked, "incident_id", "left_semi")
    unknown = asked.join(incidents.select("incident_id"), "incident_id", "left_anti").select(
        "incident_id", F.concat(F.lit("ERROR: Unknown incident "), F.col("incident_id")).alias("reason")
    )
    pair = ["machine_id", "suspected_failure_mode"]
    free = known.join(active_order_duplicates(known, work_orders).select("incident_id"),
                      "incident_id", "left_anti")
    first = newest(free, pair, F.desc("priority_score"), F.asc("incident_id"))
    accepted = maintenance_window(action_template(allocate_order_ids(first, work_orders)))
    duplicates = known.join(accepted.select("incident_id"), "incident_id", "left_anti").select(
        "incident_id",
        F.concat(F.lit("DUPLICATE: Active WO exists for "), F.col("machine_id"), F.lit(" - "),
                 F.col("suspected_failure_mode")).alias("reason"),
    )
    problem = F.concat(
        F.lit("Predicted "), F.col("suspected_failure_mode"), F.lit(" on "), F.col("machine_id"),
        F.lit(". Health: "), plain_number(F.col("health_score"), 1),
        F.lit("/100. Confidence: "), F.col("confidence_level"),
    )
    orders = accepted.select(
        "work_order_id", "incident_id", "machine_id", F.lit("DRAFT").alias("status"),
        F.col("severity").alias("priority"),
        problem.alias("problem_description"),
        F.col("evidence_narrative").alias("evidence_summary"),
        F.col("suspected_failure_mode").alias("predicted_failure_mode"),
        "recommended_actions", "estimated_repair_hrs", "estimated_downtime_hrs",
        "recommended_window",
        moment(as_of).alias("created_at"), moment(as_of).alias("updated_at"),
    )
    changes = orders.select(
        "incident_id", F.lit("WORK_ORDER_PENDING").alias("status"), "updated_at"
    )
    return Drafts(
        orders, duplicates.unionByName(unknown),
        patch(incidents, changes, "incident_id", ["status", "updated_at"]),
    )


def draft_results(drafts: Drafts) -> DataFrame:
    """What became of each requested incident: its order's number, or why it has none."""
    done = drafts.orders.select(
        "incident_id",
        F.concat(F.lit("SUCCESS: Work order "), F.col("work_order_id"),
                 F.lit(" drafted for incident "), F.col("incident_id")).alias("result"),
    )
    return done.unionByName(drafts.rejected.select("incident_id", F.col("reason").alias("result")))


def _with_order_states(
    incidents: DataFrame | None, orders: DataFrame, states: Column, *, as_of: datetime
) -> DataFrame | None:
    """Incidents with the last state their orders give them."""
    if incidents is None:
        return None
    changes = (
        orders.where(F.col("incident_id").isNotNull())
        .groupBy("incident_id")
        .agg(F.max_by(states, "_seq").alias("status"))
        .withColumn("updated_at", moment(as_of))
    )
    return patch(incidents, changes, "incident_id", ["status", "updated_at"])


def apply_approvals(
    work_orders: DataFrame, commands: DataFrame, incidents: DataFrame | None = None, *,
    as_of: datetime,
) -> Applied:
    """Decisions on draft orders.

    ``commands`` has command_seq, work_order_id, approver and action. The first
    valid action on a draft decides; every command gets a result message.
    """
    valid = F.col("action").isin("APPROVE", "REJECT")
    decisive = (
        commands.where(valid)
        .groupBy("work_order_id")
        .agg(F.min("command_seq").alias("_seq"), F.min_by("action", "command_seq").alias("_action"),
             F.min_by("approver", "command_seq").alias("_approver"))
    )
    now = moment(as_of)
    drafts = work_orders.where(F.col("status") == "DRAFT")
    decided = drafts.select("work_order_id", "incident_id", "approved_at").join(
        decisive, "work_order_id"
    )
    approved = F.col("_action") == "APPROVE"
    new_status = F.when(approved, F.lit("APPROVED")).otherwise(F.lit("REJECTED"))
    orders = patch(
        work_orders,
        decided.select(
            "work_order_id", new_status.alias("status"), F.col("_approver").alias("approved_by"),
            F.when(approved, now).otherwise(F.col("approved_at")).alias("approved_at"),
            now.alias("updated_at"),
        ),
        "work_order_id", ["status", "approved_by", "approved_at", "updated_at"],
    )
    who = F.col("work_order_id")
    seen = commands.join(
        work_orders.select("work_order_id", F.col("status").alias("_before")), "work_order_id", "left"
    ).join(decisive.select("work_order_id", "_seq", "_action"), "work_order_id", "left")
    current = F.when(
        (F.col("_before") == "DRAFT") & (F.col("command_seq") > F.col("_seq")), new_status
    ).otherwise(F.col("_before"))
    results = seen.withColumn("_current", current).select(
        "command_seq", "work_order_id",
        F.when(F.col("_current").isNull(),
               F.concat(F.lit("ERROR: Unknown work order "), who))
        .when(F.col("_current") != "DRAFT",
              F.concat(F.lit("ERROR: Work order "), who, F.lit(" is not in DRAFT status (current: "),
                       F.col("_current"), F.lit(")")))
        .when(F.col("action") == "APPROVE",
              F.concat(F.lit("APPROVED: Work order "), who, F.lit(" approved by "), F.col("approver")))
        .when(F.col("action") == "REJECT",
              F.concat(F.lit("REJECTED: Work order "), who, F.lit(" rejected by "), F.col("approver")))
        .otherwise(F.lit("ERROR: Action must be APPROVE or REJECT"))
        .alias("result"),
    )
    states = F.when(approved, F.lit("ASSIGNED")).otherwise(F.lit("NEW"))
    return Applied(orders, results, _with_order_states(incidents, decided, states, as_of=as_of))


def apply_resolutions(
    work_orders: DataFrame, commands: DataFrame, incidents: DataFrame | None = None, *,
    as_of: datetime,
) -> Applied:
    """Feedback after the repair; the last report on an order stays.

    ``commands`` has command_seq, work_order_id, root_cause, parts, hours and
    findings. Orders in any state can be resolved.
    """
    report = ["root_cause", "parts", "hours", "findings"]
    last = commands.groupBy("work_order_id").agg(
        F.max("command_seq").alias("_seq"),
        F.max_by(F.struct(*report), "command_seq").alias("_report"),
    )
    hit = work_orders.select("work_order_id", "incident_id").join(last, "work_order_id")
    now = moment(as_of)
    orders = patch(
        work_orders,
        hit.select(
            "work_order_id", F.lit("RESOLVED").alias("status"),
            F.col("_report.root_cause").alias("actual_root_cause"),
            F.col("_report.parts").alias("actual_parts_replaced"),
            F.col("_report.hours").alias("actual_repair_hrs"),
            F.col("_report.findings").alias("technician_findings"),
            now.alias("resolved_at"), now.alias("updated_at"),
        ),
        "work_order_id",
        ["status", "actual_root_cause", "actual_parts_replaced", "actual_repair_hrs",
         "technician_findings", "resolved_at", "updated_at"],
    )
    known = work_orders.select("work_order_id", F.lit(True).alias("_known"))
    who = F.col("work_order_id")
    results = commands.join(known, "work_order_id", "left").select(
        "command_seq", "work_order_id",
        F.when(F.col("_known"),
               F.concat(F.lit("RESOLVED: Work order "), who, F.lit(" completed. Root cause: "),
                        F.col("root_cause")))
        .otherwise(F.concat(F.lit("ERROR: Unknown work order "), who)).alias("result"),
    )
    resolved = F.lit("RESOLVED")
    return Applied(orders, results, _with_order_states(incidents, hit, resolved, as_of=as_of))
