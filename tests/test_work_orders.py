from datetime import datetime

from pyspark.sql import functions as F

from plantpulse.operators import work_orders as W

NOW = datetime(2024, 1, 31)
INCIDENT = ("incident_id string, machine_id string, suspected_failure_mode string, evidence_narrative string, "
            "severity string, health_score double, confidence_level string, priority_score double, status string, "
            "updated_at timestamp_ntz")
ORDER = ("work_order_id string, incident_id string, machine_id string, status string, predicted_failure_mode string, "
         "approved_by string, approved_at timestamp_ntz, updated_at timestamp_ntz, actual_root_cause string, "
         "actual_parts_replaced string, actual_repair_hrs double, technician_findings string, resolved_at timestamp_ntz")
OLD = "2024-01-01 00:00:00"


def incident(n, machine, mode, priority, severity="CRITICAL", health=77.0, confidence="HIGH"):
    return (f"INC-{n:03}", machine, mode, "text", severity, health, confidence, priority, "NEW", OLD)


def order(n, machine, mode, status, inc=None):
    return (f"WO-{n:04}", inc, machine, status, mode, None, None, OLD, None, None, None, None, None)


def test_drafting(frame):
    incidents = frame(
        INCIDENT,
        incident(1, "A", "BEARING_DEGRADATION", 50.0), incident(2, "A", "BEARING_DEGRADATION", 60.0),
        incident(3, "B", "MISALIGNMENT", 40.0, "HIGH"), incident(4, "C", "MOTOR_OVERLOAD", 90.0, "MEDIUM"),
        incident(5, "D", "OVERHEATING", 10.0), incident(6, "E", "OVERHEATING", 10.0, confidence=None),
    )
    orders = frame(
        ORDER, order(7, "B", "MISALIGNMENT", "APPROVED"), order(41, "C", "MOTOR_OVERLOAD", "RESOLVED"),
        order(9999, "X", "OVERHEATING", "REJECTED"), order(3, "D", "MISALIGNMENT", "DRAFT"),
    )
    asked = frame("incident_id string", *[(f"INC-{n:03}",) for n in (1, 2, 2, 3, 4, 6, 99)])
    drafts = W.draft_work_orders(incidents, orders, asked, as_of=NOW)
    new = {r.incident_id: r for r in drafts.orders.collect()}
    assert {i: r.work_order_id for i, r in new.items()} == {
        "INC-004": "WO-10000", "INC-002": "WO-10001", "INC-006": "WO-10002",
    }
    assert new["INC-002"].problem_description == (
        "Predicted BEARING_DEGRADATION on A. Health: 77/100. Confidence: HIGH"
    )
    assert new["INC-006"].problem_description is None
    assert (new["INC-002"].estimated_repair_hrs, new["INC-002"].estimated_downtime_hrs) == (6.0, 8.0)
    assert new["INC-002"].recommended_window == "IMMEDIATE - Next shift"
    assert new["INC-004"].recommended_actions == "1. Inspect 2. Document 3. Determine corrective action"
    assert {r.incident_id: r.reason for r in drafts.rejected.collect()} == {
        "INC-001": "DUPLICATE: Active WO exists for A - BEARING_DEGRADATION",
        "INC-003": "DUPLICATE: Active WO exists for B - MISALIGNMENT",
        "INC-099": "ERROR: Unknown incident INC-099",
    }
    results = {r.incident_id: r.result for r in W.draft_results(drafts).collect()}
    assert results["INC-004"] == "SUCCESS: Work order WO-10000 drafted for incident INC-004"
    assert len(results) == 6 and results["INC-099"].startswith("ERROR")
    states = {r.incident_id: r.status for r in drafts.incidents.collect()}
    assert {i for i, s in states.items() if s == "WORK_ORDER_PENDING"} == {"INC-002", "INC-004", "INC-006"}


def test_numbers_follow_very_long_ones(frame):
    accepted = frame(INCIDENT, incident(1, "A", "OVERHEATING", 50.0))
    orders = frame("work_order_id string", ("WO-12345678901234567890123",), ("WO-99",), ("WO-X7",))
    assert W.allocate_order_ids(accepted, orders).first().work_order_id == "WO-12345678901234567890124"


def test_drafting_again_is_a_duplicate(frame):
    incidents = frame(INCIDENT, incident(1, "A", "OVERHEATING", 50.0))
    asked = frame("incident_id string", ("INC-001",))
    first = W.draft_work_orders(incidents, frame(ORDER), asked, as_of=NOW)
    assert [r.work_order_id for r in first.orders.collect()] == ["WO-0001"]
    again = W.draft_work_orders(first.incidents, first.orders, asked, as_of=NOW)
    assert again.orders.count() == 0
    assert again.rejected.first().reason == "DUPLICATE: Active WO exists for A - OVERHEATING"


def one_by_one(statuses, commands):
    """What the commands find when they are given in turn."""
    out = {}
    for seq, who, approver, action in sorted(commands):
        status = statuses.get(who)
        if status is None:
            out[seq] = f"ERROR: Unknown work order {who}"
        elif status != "DRAFT":
            out[seq] = f"ERROR: Work order {who} is not in DRAFT status (current: {status})"
        elif action in ("APPROVE", "REJECT"):
            statuses[who] = action.rstrip("E") + ("ED" if action.endswith("E") else "ED")
            out[seq] = f"{statuses[who]}: Work order {who} {statuses[who].lower()} by {approver}"
        else:
            out[seq] = "ERROR: Action must be APPROVE or REJECT"
    return out


def test_approvals_equal_one_by_one(frame):
    orders = [order(n, "A", "M", s, f"INC-{n:03}") for n, s in enumerate(("DRAFT", "DRAFT", "APPROVED", "DRAFT", "DRAFT"), 1)]
    actions = ("ESCALATE", "APPROVE", "REJECT", "APPROVE", "DANCE", "REJECT")
    commands = [(i, f"WO-{1 + i * 5 % 7:04}", f"P{i}", actions[i % 6]) for i in range(24)]
    incidents = frame(INCIDENT, *[incident(n, "A", "M", 1.0) for n in range(1, 6)])
    applied = W.apply_approvals(
        frame(ORDER, *orders),
        frame("command_seq long, work_order_id string, approver string, action string", *commands),
        incidents, as_of=NOW,
    )
    statuses = {o[0]: o[3] for o in orders}
    expected = one_by_one(statuses, commands)
    assert {r.command_seq: r.result for r in applied.results.collect()} == expected
    assert {r.work_order_id: r.status for r in applied.orders.collect()} == statuses
    for r in applied.orders.collect():
        assert (r.approved_at == NOW) == (r.status == "APPROVED" and r.work_order_id != "WO-0003")
    got = {r.incident_id: r.status for r in applied.incidents.collect()}
    assert got["INC-003"] == "NEW"
    for n in (1, 2, 4, 5):
        assert got[f"INC-{n:03}"] == ("ASSIGNED" if statuses[f"WO-{n:04}"] == "APPROVED" else "NEW")


def test_resolutions(frame):
    applied = W.apply_resolutions(
        frame(ORDER, order(1, "A", "M", "APPROVED", "INC-001"), order(2, "A", "M", "DRAFT", None)),
        frame("command_seq long, work_order_id string, root_cause string, parts string, hours double, findings string",
              (1, "WO-0001", "wear", "p", 2.0, "f"), (2, "WO-0001", "age", "q", 3.0, "g"), (3, "WO-0009", "x", "x", 1.0, "x")),
        frame(INCIDENT, incident(1, "A", "M", 1.0)), as_of=NOW,
    )
    out = {r.work_order_id: r for r in applied.orders.collect()}
    assert (out["WO-0001"].status, out["WO-0001"].actual_root_cause, out["WO-0001"].actual_repair_hrs) == ("RESOLVED", "age", 3.0)
    assert out["WO-0002"].status == "DRAFT" and out["WO-0002"].resolved_at is None
    assert {r.command_seq: r.result for r in applied.results.collect()} == {
        1: "RESOLVED: Work order WO-0001 completed. Root cause: wear",
        2: "RESOLVED: Work order WO-0001 completed. Root cause: age",
        3: "ERROR: Unknown work order WO-0009",
    }
    assert applied.incidents.first().status == "RESOLVED"
