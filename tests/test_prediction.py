from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from plantpulse import rules
from plantpulse.operators import assessments, forecasts, incidents

NOW = datetime(2024, 1, 31)
DAILY = "machine_id string, signal_type string, day_bucket timestamp_ntz, daily_avg double, daily_max double"
SLOPE = ("machine_id string, signal_type string, latest_avg double, latest_max double, trend_slope_7d double, "
         "warning_threshold double, critical_threshold double")


def days(machine, value, last=30, signal="VIBRATION", count=12):
    return [(machine, signal, datetime(2024, 1, last) - timedelta(days=i), value(count - i), value(count - i))
            for i in range(count)]


def test_trend_slope_uses_the_fleets_last_day(frame):
    rows = days("A", lambda d: float(d)) + days("B", float, last=20)
    out = {r.machine_id: r for r in forecasts.trend_slope(frame(DAILY, *rows)).collect()}
    assert out["A"].trend_slope_7d == 1.0 and out["A"].latest_avg == 12.0
    assert out["B"].trend_slope_7d is None


@pytest.mark.parametrize("signal,slope,mode", [
    ("VIBRATION", 0.21, "BEARING_DEGRADATION"), ("VIBRATION", 0.2, "MISALIGNMENT"),
    ("VIBRATION", 0.1, "MONITORING"), ("TEMPERATURE", 1.1, "OVERHEATING"), ("CURRENT", 0.6, "MOTOR_OVERLOAD"),
    ("PRESSURE", -1.1, "HYDRAULIC_SEAL_FAILURE"), ("PRESSURE", 5.0, "MONITORING"), ("RPM", 9.0, "MONITORING"),
    ("VIBRATION", None, "MONITORING"),
])
def test_failure_mode(frame, signal, slope, mode):
    out = forecasts.failure_mode(frame(SLOPE, ("A", signal, 1.0, 1.0, slope, 7.0, 12.0))).first()
    assert out.predicted_failure_mode == mode


@pytest.mark.parametrize("slope,latest,limit,horizon,days_left", [
    (1.0, 9.0, 12.0, "24_HOUR", 3.0), (1.0, 5.0, 12.0, "7_DAY", 7.0), (1.0, 4.9, 12.0, "30_DAY", 7.1),
    (0.1, 5.0, 12.0, "BEYOND_30_DAY", 70.0), (1.0, 5.0, None, "BEYOND_30_DAY", None),
    (0.0, 5.0, 12.0, "STABLE", None), (-1.0, 5.0, 12.0, "STABLE", None), (None, 5.0, 12.0, "STABLE", None),
    (1.0, 15.0, 12.0, "24_HOUR", -3.0),
])
def test_risk_horizon(frame, slope, latest, limit, horizon, days_left):
    out = forecasts.risk_horizon(frame(SLOPE, ("A", "VIBRATION", latest, 1.0, slope, 7.0, limit))).first()
    assert (out.risk_horizon, out.estimated_days_to_threshold) == (horizon, days_left)


@pytest.mark.parametrize("slope,high,warning,level", [
    (0.31, 8.0, 7.0, "HIGH"), (0.31, 7.0, 7.0, "MEDIUM"), (-0.31, 8.0, 7.0, "HIGH"), (0.31, 8.0, None, "MEDIUM"),
    (0.1, 8.0, 7.0, "LOW"), (0.05, 8.0, 7.0, "INSUFFICIENT_DATA"), (None, 8.0, 7.0, "INSUFFICIENT_DATA"),
])
def test_forecast_confidence(frame, slope, high, warning, level):
    out = forecasts.forecast_confidence(frame(SLOPE, ("A", "VIBRATION", 1.0, high, slope, warning, 12.0))).first()
    assert out.confidence_level == level


def test_two_sensors_of_a_signal_give_one_forecast(frame):
    sensors = frame(
        "sensor_id string, machine_id string, signal_type string, warning_threshold double, critical_threshold double",
        ("A-1", "A", "VIBRATION", 1.0, 2.0), ("A-VIBRATION", "A", "VIBRATION", 7.0, 12.0), ("A-0", "A", "RPM", 3.0, 4.0),
        ("A-2", "A", "RPM", 5.0, 6.0),
    )
    daily = frame(DAILY, *days("A", float), *days("A", float, signal="RPM"))
    out = {r.signal_type: r.critical_threshold for r in forecasts.failure_forecasts(daily, sensors, as_of=NOW).collect()}
    assert forecasts.failure_forecasts(daily, sensors, as_of=NOW).count() == 2
    assert out == {"VIBRATION": 12.0, "RPM": 4.0}


FORECAST = ("machine_id string, signal_type string, predicted_failure_mode string, risk_horizon string, "
            "estimated_days_to_threshold double, current_value double, trend_slope_7d double, confidence_level string")
CONTEXT = ("machine_id string, machine_name string, machine_type string, criticality string, health_score double, "
           "health_status string, last_failure_mode string, last_root_cause string, days_since_last_maint long, "
           "failure_count long, latest_obs_type string, latest_obs_detail string, latest_obs_severity string, "
           "latest_prod_status string, latest_reject_rate double, latest_actual_units long, parts_available long, "
           "min_lead_time_days long")


def context(machine="A", criticality="HIGH", health=77.0, severity="HIGH", status="DEGRADED", rate=4.0, mode="WEAR"):
    return (machine, f"Mill {machine}", "CNC", criticality, health, "WARNING", mode, "age", 9, 2, "NOISE",
            "grinding", severity, status, rate, 90, 3, 2)


TWO = [
    ("A", "VIBRATION", "BEARING_DEGRADATION", "7_DAY", 5.0, 9.96, 0.296, "HIGH"),
    ("A", "TEMPERATURE", "OVERHEATING", "30_DAY", 20.0, 80.0, 1.25, "MEDIUM"),
    ("A", "PRESSURE", "MONITORING", "STABLE", None, 100.0, -0.5, "LOW"),
]


def test_evidence_compares_text_or_meaning(frame):
    f, c = frame(FORECAST, *TWO), frame(CONTEXT, context())
    text = assessments.machine_evidence(f, c).first()
    assert text.predicted_modes == "BEARING_DEGRADATION, OVERHEATING"
    assert (text.worst_risk_horizon, text.max_confidence) == ("30_DAY", "MEDIUM")
    assert text.min_days_to_threshold == 5.0 and text.press_slope == -0.5 and text.curr_slope is None
    meant = assessments.machine_evidence(f, c, ordering="ordinal").first()
    assert (meant.worst_risk_horizon, meant.max_confidence) == ("7_DAY", "HIGH")


def test_assessment_text_and_recommendation(frame):
    out = assessments.failure_assessments(
        frame(FORECAST, *TWO), frame(CONTEXT, context()), as_of=NOW, numbered=True
    ).first()
    assert out.evidence_narrative == (
        "Mill A (CNC, HIGH criticality): Vibration trending up at 0.30 mm/s per day (current: 10.0 mm/s). "
        "Temperature rising at 1.3 C/day (current: 80.0 C). Prior failure: WEAR. Operator reported: grinding. "
        "Production status: DEGRADED. "
    )
    assert out.recommendation == "SCHEDULE_MAINTENANCE"
    assert out.primary_failure_mode == "BEARING_DEGRADATION" and out.assessment_id == 1
    assert out.evidence_json.vibration.value == 9.96
    assert out.evidence_json.maintenance_history.total_failures == 2


def test_no_prediction(frame):
    out = assessments.failure_assessments(
        frame(FORECAST, ("A", "RPM", "MONITORING", "STABLE", None, 1.0, 0.01, "INSUFFICIENT_DATA")),
        frame(CONTEXT, context(health=None)), as_of=NOW,
    ).first()
    assert out.all_predicted_modes is None and out.primary_failure_mode == "NONE_DETECTED"
    assert out.recommendation == "ROUTINE_MONITORING" and out.assessment_state == "MISSING_DATA"


def test_confidence_over_all_forecasts_asks_for_inspection(frame):
    out = assessments.failure_assessments(
        frame(FORECAST, ("A", "RPM", "MONITORING", "STABLE", None, 1.0, 0.01, "INSUFFICIENT_DATA")),
        frame(CONTEXT, context()), as_of=NOW, confidence_scope="all",
    ).first()
    assert out.assessment_state == "MANUAL_INSPECTION_RECOMMENDED"


PRIORITY = ("health_score double, criticality string, latest_prod_status string, latest_reject_rate double, "
            "estimated_days_to_failure double, confidence_level string")


@pytest.mark.parametrize("row,score", [
    ((77.0, "HIGH", "DEGRADED", 1.0, 1.0, "HIGH"), 76.9),
    ((83.0, "HIGH", "DEGRADED", 1.0, 2.5, "MEDIUM"), 65.1),
    ((82.5, "HIGH", "DEGRADED", 1.0, None, "MEDIUM"), 50.25),
    ((None, "LOW", "NORMAL", 5.1, 7.0, None), 45.0),
    ((100.0, "MEDIUM", "NORMAL", 3.1, 7.1, "LOW"), 20.0),
    ((0.0, "HIGH", "DEGRADED", 9.0, 0.5, "HIGH"), 100.0),
])
def test_priority_score(frame, row, score):
    out = incidents.priority_score(frame(PRIORITY, row)).first()
    assert out.priority_score == score
    assert abs(sum(out[p] for p in incidents.PRIORITY_PARTS) - score) < 0.01


ROLLUP = ("machine_id string, anomaly_count long, first_anomaly_time timestamp_ntz, latest_anomaly_time timestamp_ntz, "
          "affected_signals string")


def built(frame):
    f = frame(
        FORECAST,
        ("A", "VIBRATION", "BEARING_DEGRADATION", "24_HOUR", 2.0, 9.0, 0.3, "HIGH"),
        ("B", "VIBRATION", "MISALIGNMENT", "7_DAY", 6.0, 9.0, 0.15, "MEDIUM"),
        ("C", "PRESSURE", "HYDRAULIC_SEAL_FAILURE", "STABLE", None, 9.0, -2.0, "HIGH"),
        ("D", "RPM", "MONITORING", "STABLE", None, 9.0, 0.0, "LOW"),
    )
    c = frame(CONTEXT, *[context(m) for m in "ABCD"])
    rollup = frame(ROLLUP, ("A", 4, "2024-01-30 20:59:00", "2024-01-30 23:00:00", "VIBRATION"))
    return incidents.build_incidents(assessments.failure_assessments(f, c, as_of=NOW), c, rollup, as_of=NOW)


def test_incidents(frame):
    out = {r.machine_id: r for r in built(frame).collect()}
    assert {m: (r.incident_id, r.severity) for m, r in out.items()} == {
        "A": ("INC-001", "CRITICAL"), "B": ("INC-002", "HIGH"), "C": ("INC-003", "MEDIUM"),
    }
    assert out["A"].incident_age_hours == 4 and out["A"].related_anomaly_count == 4
    assert out["B"].incident_start is None and out["B"].status == "NEW"


def test_triage_and_carry_over(frame):
    now = built(frame)
    commands = frame(
        "command_seq long, incident_id string, action string",
        (1, "INC-001", "FALSE_POSITIVE"), (2, "INC-001", "ACKNOWLEDGE"), (3, "INC-002", "FALSE_POSITIVE"),
        (4, "INC-003", "DANCE"),
    )
    triaged = incidents.triage_update(now, commands, as_of=NOW)
    assert {r.incident_id: r.status for r in triaged.collect()} == {
        "INC-001": "ACKNOWLEDGED", "INC-002": "FALSE_POSITIVE", "INC-003": "NEW",
    }
    fresh = now.where("machine_id <> 'C'").withColumn("incident_id", F.concat("incident_id", F.lit("X")))
    merged = incidents.carry_over(triaged, fresh).collect()
    assert {r.machine_id: (r.incident_id, r.status) for r in merged} == {
        "A": ("INC-001", "ACKNOWLEDGED"), "B": ("INC-002X", "NEW"), "C": ("INC-003", "NEW"),
    }


def test_notifications_are_sent_once(frame):
    now = built(frame)
    first = incidents.incident_notifications(now)
    assert {r.reference_id for r in first.collect()} == {"INC-001", "INC-002"}
    message = first.where("reference_id = 'INC-001'").first().message
    assert message.startswith("CRITICAL incident INC-001 on A: BEARING_DEGRADATION. Mill A (CNC")
    assert incidents.incident_notifications(now, first).count() == 0
    assert incidents.cycle_summary(now, first).first().message == (
        "Maintenance cycle complete. Incidents: 3 new. Notifications: 2"
    )


def test_incident_sla(frame):
    out = incidents.incident_sla(built(frame), as_of=NOW, hours={"CRITICAL": 3, "HIGH": 24})
    assert {r.incident_id: r.overdue for r in out.collect()} == {
        "INC-001": True, "INC-002": False, "INC-003": False,
    }


def test_rule_tables_are_complete():
    assert {m for *_, m in rules.FAILURE_RULES} == {
        "BEARING_DEGRADATION", "MISALIGNMENT", "OVERHEATING", "MOTOR_OVERLOAD", "HYDRAULIC_SEAL_FAILURE",
    }
