from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from plantpulse import rules
from plantpulse.operators import checks, preparation as P, production, reports

ROW = ("machine_id string, shift string, production_date date, actual_units long, good_units long, rejected_units long, "
       "cycle_time_sec double, ideal_cycle_time_sec double, planned_runtime_hrs double, actual_runtime_hrs double, "
       "downtime_hrs double, production_status string")
MACHINE = "machine_id string, machine_name string, machine_type string, line string, criticality string"


def made(day, units, rejected=0, machine="A", planned=8.0, runtime=8.0, ideal=60.0, shift="DAY"):
    return (machine, shift, date(2024, 1, day), units, units - rejected, rejected, 66.0, ideal, planned, runtime, 0.5, "NORMAL")


def machines(frame):
    return frame(MACHINE, ("A", "Mill", "CNC", "L1", "HIGH"), ("B", "Lathe", "CNC", "L1", "LOW"))


def test_performance_baseline(frame):
    out = production.performance_baseline(
        frame(ROW, made(1, 100, 10), made(2, 150, 0), made(3, 0, 0), made(4, 50, 5))
    ).orderBy("production_date").collect()
    assert [r.prev_day_units for r in out] == [None, 100, 150, 0]
    assert [r.shift_over_shift_pct for r in out] == [None, 50.0, -100.0, None]
    assert [r.rolling_7d_avg_units for r in out] == [100.0, 125.0, 83.3, 75.0]
    assert [r.rolling_7d_reject_rate for r in out] == [10.0, 5.0, 3.33, 5.0]
    assert out[3].perf_degradation_vs_7d == -33.33


def test_oee_and_zero_guards(frame):
    out = production.oee_metrics(
        frame(ROW, made(1, 240, 24, runtime=6.0), made(2, 0, planned=0.0, runtime=0.0)), machines(frame)
    ).orderBy("production_date").collect()
    assert (out[0].availability_pct, out[0].performance_pct, out[0].quality_pct, out[0].oee_pct) == (75.0, 66.67, 90.0, 45.0)
    assert (out[1].availability_pct, out[1].performance_pct, out[1].quality_pct, out[1].oee_pct) == (0.0, 0.0, 0.0, 0.0)


INCIDENT = ("incident_id string, machine_id string, machine_name string, severity string, priority_score double, "
            "suspected_failure_mode string, rul_days double")


def test_production_impact(frame):
    oee = production.oee_metrics(
        frame(ROW, made(10, 400, 40), made(3, 200, 0), made(2, 480, 480), made(10, 10, 1, machine="B")), machines(frame)
    )
    incidents = frame(INCIDENT, ("INC-001", "A", "Mill", "HIGH", 9.0, "X", 2.5), ("INC-002", "B", "Lathe", "HIGH", 9.0, "X", None))
    orders = frame("work_order_id string, incident_id string, status string, estimated_downtime_hrs double",
                   ("W1", "INC-001", "DRAFT", 8.0), ("W2", "INC-001", "REJECTED", 9.0), ("W3", "INC-001", "RESOLVED", 4.0))
    rows = production.production_impact(incidents, oee, orders).collect()
    assert len(rows) == 3
    first = next(r for r in rows if r.downtime_hrs_at_risk == 8.0)
    assert (first.current_oee, first.oee_7d_avg, first.oee_trend) == (75.0, 58.34, 16.66)
    assert (first.units_at_risk_if_failure, first.units_lost_during_repair) == (900.0, 360.0)
    assert (first.current_reject_rate, first.reject_rate_trend) == (10.0, 10.0)
    other = next(r for r in rows if r.machine_id == "B")
    assert other.units_at_risk_if_failure == 63.0 and other.units_lost_during_repair is None
    assert production.production_impact(incidents, oee, orders, one_order=True).count() == 2


def test_daily_trend_has_delta(frame):
    oee = production.oee_metrics(frame(ROW, made(9, 240), made(10, 480)), machines(frame))
    out = reports.oee_daily_trend(oee).collect()
    assert [(r.oee, r.oee_delta) for r in out] == [(50.0, 0.0), (100.0, 50.0)]
    overall = reports.oee_overall(reports.oee_summary(oee)).first()
    assert overall.avg_oee == 75.0
    assert checks.oee_check(oee).first().passed


def test_line_rollup_totals(frame):
    oee = production.oee_metrics(frame(ROW, made(9, 240, 2), made(9, 240, 4, machine="B")), machines(frame))
    out = {(r.line, r.machine_id): r for r in production.line_rollup(oee, cost_per_hour=10.0, cost_per_reject=2.0).collect()}
    assert out[(None, None)].rejected_units == 6 and out[("L1", None)].downtime_cost == 10.0
    assert out[("L1", "B")].reject_cost == 8.0


HISTORY = ("maintenance_id string, machine_id string, failure_mode string, root_cause string, action_taken string, "
           "parts_replaced string, downtime_hrs double, cost decimal(12,2), completed_at timestamp_ntz")


def case(n, machine, mode, cost="1.00", downtime=1.0, at="2024-01-01 00:00:00"):
    return (f"M{n:02}", machine, mode, "cause", "action", "part", downtime, Decimal(cost), at)


def test_repeat_failures(frame):
    history = frame(HISTORY, case(1, "A", "BEARING", "3200.00", 6.0), case(2, "A", "BEARING", "4500.00", 8.0),
                    case(3, "A", "NONE"), case(4, "B", "BEARING"))
    out = reports.repeat_failures(history, machines(frame)).collect()
    assert [(r.machine_name, r.repairs, r.total_cost, r.total_downtime) for r in out] == [("Mill", 2, 7700.0, 14.0)]
    assert {r.failure_mode: r.repairs for r in reports.failure_mode_distribution(history).collect()} == {"BEARING": 3}
    assert {r.machine_name: r.total_cost for r in reports.maintenance_cost(history, machines(frame)).collect()} == {
        "Mill": 7701.0, "Lathe": 1.0,
    }


def test_similar_cases_equal_the_or_join(frame):
    rows = [case(n, "AB"[n % 2], ("X", "Y", None)[n % 3], at=None if n == 7 else f"2024-01-{1 + n % 5:02} 00:00:00") for n in range(30)]
    history = frame(HISTORY, *rows)
    incidents = frame("incident_id string, machine_id string, suspected_failure_mode string", ("I1", "A", "Y"), ("I2", "C", "X"), ("I3", "C", "Z"))
    got = {(r.incident_id, r.case_rank, r.maintenance_id) for r in reports.similar_cases(incidents, history, keep=4).collect()}
    expected = set()
    for inc, machine, mode in (("I1", "A", "Y"), ("I2", "C", "X"), ("I3", "C", "Z")):
        hits = [r for r in rows if r[1] == machine or r[2] == mode]
        hits.sort(key=lambda r: (r[8] is None, r[8] or "", r[0]), reverse=True)
        expected |= {(inc, i, r[0]) for i, r in enumerate(hits[:4], 1)}
    assert got == expected


def test_sensor_registry(frame):
    fleet = frame(MACHINE, ("A", "a", "CNC", "L", "HIGH"), ("B", "b", "HYDRAULIC_PRESS", "L", "LOW"), ("C", "c", "FURNACE", "L", "LOW"))
    no_rpm = ("HYDRAULIC_PRESS", "ROBOTIC_WELDER", "ASSEMBLY_ROBOT", "FURNACE", "PACKAGING")
    out = P.sensor_registry(
        fleet, exclusions=[(t, "RPM") for t in no_rpm],
        extras=[(rules.PRESSURE_SIGNAL, F.col("machine_type") == "HYDRAULIC_PRESS"), (rules.ACOUSTIC_SIGNAL, F.col("machine_id").isin("A"))],
    )
    ids = {r.sensor_id for r in out.collect()}
    assert ids == {
        "A-VIBRATION", "A-TEMPERATURE", "A-CURRENT", "A-RPM", "A-ACOUSTIC",
        "B-VIBRATION", "B-TEMPERATURE", "B-CURRENT", "B-PRESSURE", "C-VIBRATION", "C-TEMPERATURE", "C-CURRENT",
    }
    current = out.where("sensor_id = 'A-CURRENT'").first()
    assert current.warning_threshold is None and current.sampling_interval_sec == 60


def test_densify(frame):
    sensors = frame("sensor_id string, machine_id string, signal_type string", ("A-RPM", "A", "RPM"), ("B-RPM", "B", "RPM"))
    readings = frame(
        "sensor_id string, reading_value double, reading_timestamp timestamp_ntz",
        ("A-RPM", 1.0, "2024-01-01 00:00:00"), ("A-RPM", 3.0, "2024-01-01 00:14:59"),
        ("A-RPM", None, "2024-01-01 00:30:00"), ("B-RPM", 5.0, "2024-01-01 01:00:00"), ("X-RPM", 5.0, "2024-01-01 00:00:00"),
    )
    out = P.densify(sensors, readings, start=datetime(2024, 1, 1), end=datetime(2024, 1, 1, 1), step_minutes=15).collect()
    assert len(out) == 8
    a = {r.slot.minute: (r.readings, r.slot_avg, r.is_missing) for r in out if r.sensor_id == "A-RPM"}
    assert a == {0: (2, 2.0, False), 15: (0, None, True), 30: (1, None, False), 45: (0, None, True)}
    assert all(r.is_missing for r in out if r.sensor_id == "B-RPM")


def test_densify_keeps_a_shorter_last_slot(frame):
    sensors = frame("sensor_id string, machine_id string, signal_type string", ("A-RPM", "A", "RPM"))
    readings = frame(
        "sensor_id string, reading_value double, reading_timestamp timestamp_ntz",
        ("A-RPM", 1.0, "2024-01-01 00:10:00"), ("A-RPM", 3.0, "2024-01-01 01:10:00"), ("A-RPM", 9.0, "2024-01-01 01:30:00"),
    )
    out = P.densify(sensors, readings, start=datetime(2024, 1, 1), end=datetime(2024, 1, 1, 1, 30), step_minutes=60)
    assert {(r.slot.hour, r.readings, r.slot_avg) for r in out.collect()} == {(0, 1, 1.0), (1, 1, 3.0)}


@pytest.mark.parametrize("hour,shift", [(5, "NIGHT"), (6, "DAY"), (14, "DAY"), (15, "SWING"), (22, "SWING"), (23, "NIGHT")])
def test_classify_shift(frame, hour, shift):
    assert P.classify_shift(frame("ts timestamp_ntz", (f"2024-01-01 {hour:02}:59:00",)), "ts").first().shift == shift


def test_calendar_and_quality(frame):
    fleet = frame(MACHINE, ("A", "a", "CNC", "L", "HIGH"), ("B", "b", "FURNACE", "L", "LOW"))
    assert P.production_calendar(fleet, start=date(2024, 2, 1), days=30, exclude_types=["FURNACE"]).count() == 90
    out = P.derive_quality(frame("actual_units long, rejected_units long", (3, 1), (0, 0))).collect()
    assert [(r.good_units, r.quality_deviation) for r in out] == [(2, 0.3333), (0, None)]


def test_key_checks(frame):
    machines_ = frame("machine_id string", ("A",), ("A",), ("B",))
    sensors = frame("sensor_id string, machine_id string", ("1", "A"), ("2", "Z"))
    bad = P.key_checks(machines_, ["machine_id"], name="machines").first()
    assert (bad.row_count, bad.duplicate_keys, bad.passed) == (3, 1, False)
    lost = P.key_checks(sensors, ["sensor_id"], name="sensors", parent=("machine_id", machines_, "machine_id")).first()
    assert (lost.orphan_rows, lost.passed) == (1, False)
