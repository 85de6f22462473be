"""Production baselines, equipment effectiveness and what incidents put at risk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from plantpulse import rules
from plantpulse.functions import half_up, ratio


def _percent(part: Column, whole: Column) -> Column:
    return ratio(part, whole) * 100


def performance_baseline(production: DataFrame) -> DataFrame:
    """Output against the previous row and the last seven of the machine and shift."""
    shift = Window.partitionBy("machine_id", "shift").orderBy("production_date")
    week = shift.rowsBetween(-6, 0)
    units = F.col("actual_units")
    previous = F.lag(units, 1).over(shift)
    usual = F.avg(units).over(week)
    rejects = F.when(units > 0, _percent(F.col("rejected_units"), units)).otherwise(F.lit(0.0))
    wide = production.select(
        "machine_id", "shift", "production_date",
        "actual_units", "good_units", "rejected_units",
        "cycle_time_sec", "ideal_cycle_time_sec", "actual_runtime_hrs", "downtime_hrs",
        "production_status",
        previous.alias("prev_day_units"),
        usual.alias("_usual"),
        F.avg(rejects).over(week).alias("_rejects"),
    )
    before, mean = F.col("prev_day_units"), F.col("_usual")
    return wide.select(
        *[c for c in wide.columns if not c.startswith("_")],
        F.when(before > 0, half_up(_percent(units - before, before), 2))
        .alias("shift_over_shift_pct"),
        half_up(mean, 1).alias("rolling_7d_avg_units"),
        half_up(F.col("_rejects"), 2).alias("rolling_7d_reject_rate"),
        F.when(mean > 0, half_up(_percent(units - mean, mean), 2)).alias("perf_degradation_vs_7d"),
    )


def oee_metrics(production: DataFrame, machines: DataFrame) -> DataFrame:
    """Availability, performance and quality of each row, and their product."""
    units, runtime = F.col("actual_units"), F.col("actual_runtime_hrs")
    planned, ideal = F.col("planned_runtime_hrs"), F.col("ideal_cycle_time_sec")
    available = F.when(planned > 0, ratio(runtime, planned)).otherwise(F.lit(0.0))
    performing = F.when(
        (runtime > 0) & (ideal > 0), ratio(units * ideal, runtime * 3600)
    ).otherwise(F.lit(0.0))
    good = F.when(units > 0, ratio(F.col("good_units"), units)).otherwise(F.lit(0.0))
    joined = production.join(
        machines.select("machine_id", "machine_name", "machine_type", "line", "criticality"),
        "machine_id",
    )
    return joined.select(
        "machine_id", "machine_name", "machine_type", "line", "criticality",
        "production_date", "shift",
        half_up(available * 100, 2).alias("availability_pct"),
        half_up(performing * 100, 2).alias("performance_pct"),
        half_up(good * 100, 2).alias("quality_pct"),
        half_up(available * performing * good * 100, 2).alias("oee_pct"),
        "actual_units", "good_units", "rejected_units", "downtime_hrs",
        "cycle_time_sec", "ideal_cycle_time_sec", "production_status",
    )


def last_days(oee: DataFrame, days: int = rules.OEE_DAYS) -> DataFrame:
    """Rows within ``days`` of the last production date, that date's row age included."""
    last = oee.select(F.max("production_date")).scalar()
    return oee.where(F.col("production_date") >= F.date_sub(last, days)).withColumn(
        "_age", F.datediff(last, F.col("production_date"))
    )


def recent_effectiveness(oee: DataFrame, *, days: int = rules.OEE_DAYS) -> DataFrame:
    """Last day against the last days, per machine."""
    today = F.col("_age") == 0
    earlier = (F.col("_age") >= 1) & (F.col("_age") <= days)
    reject = _percent(F.col("rejected_units"), F.col("actual_units"))

    def mean(value, when=None):
        return F.avg(value if when is None else F.when(when, value))

    good = mean(F.col("good_units"), today)
    return (
        last_days(oee, days)
        .groupBy("machine_id")
        .agg(
            half_up(mean(F.col("oee_pct"), today), 2).alias("current_oee"),
            half_up(mean(F.col("availability_pct"), today), 2).alias("current_availability"),
            half_up(mean(F.col("quality_pct"), today), 2).alias("current_quality"),
            half_up(mean(F.col("oee_pct")), 2).alias("oee_7d_avg"),
            half_up(good, 0).alias("daily_good_units"),
            half_up(good / rules.SHIFT_HOURS, 1).alias("units_per_hour"),
            half_up(mean(reject, today), 2).alias("current_reject_rate"),
            half_up(mean(reject, today) - mean(reject, earlier), 2).alias("reject_rate_trend"),
        )
    )


def production_impact(
    incidents: DataFrame, oee: DataFrame, work_orders: DataFrame, *, days: int = rules.OEE_DAYS,
    one_order: bool = False,
) -> DataFrame:
    """Units an incident puts at risk, and those its repair costs.

    Each order of an incident that was not rejected gives a row (as
    established); ``one_order`` keeps the first by number.
    """
    orders = work_orders.where(F.col("status") != "REJECTED")
    if one_order:
        orders = orders.groupBy("incident_id").agg(
            F.min_by("estimated_downtime_hrs", "work_order_id").alias("estimated_downtime_hrs")
        )
    joined = incidents.join(recent_effectiveness(oee, days=days), "machine_id", "left").join(
        orders.select("incident_id", "estimated_downtime_hrs"), "incident_id", "left"
    )
    left = F.coalesce("rul_days", F.lit(float(rules.DEFAULT_RUL_DAYS)))
    lost = F.col("estimated_downtime_hrs") * F.col("units_per_hour")
    return joined.select(
        "incident_id", "machine_id", "machine_name", "severity", "priority_score",
        "suspected_failure_mode", "rul_days",
        "current_oee", "current_availability", "current_quality", "oee_7d_avg",
        half_up(F.col("current_oee") - F.col("oee_7d_avg"), 2).alias("oee_trend"),
        half_up(F.col("daily_good_units") * left, 0).alias("units_at_risk_if_failure"),
        half_up(lost, 0).alias("units_lost_during_repair"),
        F.col("estimated_downtime_hrs").alias("downtime_hrs_at_risk"),
        "current_reject_rate", "reject_rate_trend",
    )


def line_rollup(oee: DataFrame, *, cost_per_hour: float, cost_per_reject: float) -> DataFrame:
    """Downtime and reject cost per machine, per line and for the whole site."""
    return (
        oee.rollup("line", "machine_id")
        .agg(
            half_up(F.avg("oee_pct"), 2).alias("avg_oee"),
            half_up(F.sum("downtime_hrs"), 2).alias("downtime_hrs"),
            F.sum("rejected_units").alias("rejected_units"),
            half_up(F.sum("downtime_hrs") * cost_per_hour, 2).alias("downtime_cost"),
            half_up(F.sum("rejected_units") * cost_per_reject, 2).alias("reject_cost"),
        )
    )
