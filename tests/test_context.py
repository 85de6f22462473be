from datetime import datetime
from decimal import Decimal

from pyspark.sql import functions as F

from plantpulse.operators import context as C

NOW = datetime(2024, 1, 31)
MACHINE = ("machine_id string, machine_name string, machine_type string, line string, criticality string, "
           "rated_rpm double, rated_current double, operating_state string")
EVENT = "event_id long, machine_id string, event_type string, event_code string, severity string, event_timestamp timestamp_ntz"
READING = "machine_id string, signal_type string, reading_value double, reading_timestamp timestamp_ntz"
HISTORY = ("maintenance_id string, machine_id string, failure_mode string, root_cause string, cost decimal(12,2), "
           "completed_at timestamp_ntz")


def machine(name, state="RUNNING", rpm=100.0, current=50.0, kind="CNC"):
    return (name, name, kind, "L1", "HIGH", rpm, current, state)


def test_operating_context(frame):
    machines = frame(MACHINE, machine("A"), machine("B", rpm=0.0), machine("C"), machine("D", "MAINTENANCE", None), machine("E"))
    events = frame(
        EVENT,
        (1, "A", "STARTUP", None, "INFO", "2024-01-30 10:00:00"), (2, "A", "SHUTDOWN", None, "INFO", "2024-01-30 11:00:00"),
        (3, "A", "ALARM", None, "INFO", "2024-01-30 12:00:00"),
        (4, "B", "STATE_CHANGE", "SC-HIGHLOAD", "INFO", "2024-01-30 12:00:00"),
        (5, "C", "FAULT", "X", "INFO", "2024-01-30 12:00:00"), (6, "C", "FAULT", "Y", "INFO", "2024-01-30 12:00:00"),
    )
    readings = frame(
        READING, ("A", "RPM", 50.0, "2024-01-30 18:00:00"), ("A", "RPM", 60.1, "2024-01-30 19:00:00"),
        ("A", "RPM", 9.0, "2024-01-30 17:59:59"), ("B", "RPM", 50.0, "2024-01-30 20:00:00"),
        ("A", "CURRENT", 25.0, "2024-01-30 20:00:00"),
    )
    out = {r.machine_id: r for r in C.operating_context(machines, events, readings, as_of=NOW).collect()}
    assert {m: out[m].current_state for m in "ABCDE"} == {
        "A": "OFFLINE", "B": "HIGH_LOAD", "C": "FAULT", "D": "MAINTENANCE", "E": "RUNNING",
    }
    assert (out["A"].avg_rpm, out["A"].load_pct, out["A"].current_pct) == (55.05, 55.1, 50.0)
    assert out["B"].load_pct is None and out["E"].avg_rpm is None
    assert {m for m in out if out[m].suppress_signals} == {"A", "D"}


def test_open_maintenance_is_the_latest(frame):
    history = frame(
        HISTORY, ("M1", "A", "WEAR", "x", Decimal("10.00"), "2024-01-30 23:00:00"),
        ("M2", "A", "NONE", "y", Decimal("5.50"), None), ("M3", "B", "WEAR", "z", Decimal("1.00"), "2024-01-29 23:59:59"),
    )
    out = {r.machine_id: r for r in C.last_maintenance(history, as_of=NOW).collect()}
    assert (out["A"].last_maint_id, out["A"].days_since_last_maint) == ("M2", None)
    assert (out["B"].last_maint_id, out["B"].days_since_last_maint) == ("M3", 2)
    totals = {r.machine_id: (r.failure_count, r.total_maint_cost) for r in C.maintenance_totals(history).collect()}
    assert totals == {"A": (2, Decimal("15.50")), "B": (1, Decimal("1.00"))}
    failures = {r.machine_id: r.failure_count for r in C.maintenance_totals(history, failures_only=True).collect()}
    assert failures == {"A": 1, "B": 1}


def test_latest_shift_by_name_or_by_order(frame):
    production = frame(
        "machine_id string, shift string, production_date date, production_status string, actual_units long, rejected_units long",
        ("A", "NIGHT", "2024-01-30", "N", 0, 3), ("A", "SWING", "2024-01-30", "S", 30, 1), ("A", "DAY", "2024-01-29", "D", 1, 1),
    )
    by_name = C.latest_production(production).first()
    assert (by_name.latest_prod_status, by_name.latest_reject_rate) == ("S", 3.33)
    in_order = C.latest_production(production, shift_order="ordinal").first()
    assert (in_order.latest_prod_status, in_order.latest_reject_rate) == ("N", 0.0)


def test_parts_are_counted_like_a_substring_match(frame):
    machines = frame(MACHINE, machine("A", kind="CNC"), machine("B", kind="PRESS"), machine("C", kind="ROBOT"))
    parts = frame(
        "part_id string, compatible_machine_types string, quantity_on_hand long, lead_time_days long",
        ("P1", "CNC,PRESS", 1, 9), ("P2", "CNC, CNC", 2, 4), ("P3", "PRESS", 0, 1), ("P4", None, 5, 1),
    )
    got = {tuple(r) for r in C.parts_availability(machines, parts).collect()}
    matched = (
        machines.join(parts, F.col("compatible_machine_types").contains(F.col("machine_type")))
        .where("quantity_on_hand > 0").groupBy("machine_id")
        .agg(F.count_distinct("part_id"), F.min("lead_time_days"))
    )
    assert got == {tuple(r) for r in matched.collect()} == {("A", 2, 4), ("B", 1, 9)}


def test_parts_join_is_an_equality_join(frame, plan_of):
    machines = frame(MACHINE, machine("A"))
    parts = frame("part_id string, compatible_machine_types string, quantity_on_hand long, lead_time_days long",
                  ("P1", "CNC", 1, 9))
    text = plan_of(C.parts_availability(machines, parts))
    assert "NestedLoop" not in text and "Cartesian" not in text


def test_newest_is_cut_before_the_shuffle(frame, plan_of):
    events = frame(EVENT, (1, "A", "FAULT", None, "INFO", "2024-01-30 10:00:00"))
    lines = plan_of(C.latest_state_event(events)).splitlines()
    exchange = next(i for i, line in enumerate(lines) if "Exchange" in line)
    assert any("WindowGroupLimit" in line for line in lines[exchange + 1:])


def test_repair_effect(frame):
    features = frame(
        "machine_id string, signal_type string, hour_bucket timestamp_ntz, avg_value double",
        ("A", "RPM", "2024-01-09 23:00:00", 10.0), ("A", "RPM", "2024-01-10 00:00:00", 4.0),
        ("A", "RPM", "2024-01-12 23:00:00", 6.0), ("A", "RPM", "2024-01-13 00:00:00", 99.0),
        ("A", "RPM", "2024-01-06 23:00:00", 99.0), ("B", "RPM", "2024-01-10 00:00:00", 1.0),
    )
    history = frame("maintenance_id string, machine_id string, completed_at timestamp_ntz",
                    ("M1", "A", "2024-01-10 00:00:00"), ("M2", "A", None), ("M3", "C", "2024-01-10 00:00:00"))
    out = [tuple(r) for r in C.repair_effect(features, history).collect()]
    assert out == [("M1", "A", "RPM", 10.0, 5.0, -5.0)]
