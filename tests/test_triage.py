"""The fold of commands against one command after the other."""

import random
from datetime import datetime, timedelta

import pytest

from plantpulse import rules
from plantpulse.operators import triage

NOW = datetime(2024, 1, 31)
INCIDENT = ("incident_id string, severity string, incident_start timestamp_ntz, status string, owner string, acknowledged_at timestamp_ntz, "
            "snooze_reason string, escalation_status string, resolution_reason string, false_positive_reason string, updated_at timestamp_ntz")
COMMAND = ("command_seq long, incident_id string, action string, given_at timestamp_ntz, owner string, reason string, snooze_hours int")
HOURS = {"HIGH": 48, "LOW": 10_000}


def incident(name, status="NEW", severity="HIGH", start="2024-01-01 00:00:00"):
    return (name, severity, start, status, None, None, None, None, None, None, "2024-01-01 00:00:00")


def one_by_one(incidents, commands):
    states, results = {i[0]: i[3] for i in incidents}, {}
    for seq, name, action, *_ in sorted(commands):
        if name not in states:
            results[seq] = (False, f"ERROR: Unknown incident {name}")
        elif action not in rules.INCIDENT_MOVES:
            results[seq] = (False, f"ERROR: Unknown action {action}")
        elif states[name] not in rules.INCIDENT_MOVES[action]:
            results[seq] = (False, f"ERROR: {action} not allowed for {name} in {states[name]}")
        else:
            after = rules.INCIDENT_MOVES[action][states[name]]
            results[seq] = (True, f"OK: {name} {states[name]} -> {after}")
            states[name] = after
    return states, results


@pytest.mark.parametrize("chunk, most", [(256, 400), (3, 400), (2, 9)])
def test_fold_equals_one_by_one(frame, monkeypatch, chunk, most):
    """One incident has nearly all commands; chunks of chunks of chunks."""
    monkeypatch.setattr(triage, "CHUNK", chunk)
    rng = random.Random(chunk)
    incidents = [incident("A"), incident("B", "ASSIGNED"), incident("C", "RESOLVED"), incident("D")]
    actions = [*rules.INCIDENT_MOVES, "DANCE"]
    commands = [
        (seq, rng.choice("AAAAAABCX"), rng.choice(actions), NOW - timedelta(hours=most - seq), f"T{seq}", f"r{seq}", 5)
        for seq in rng.sample(range(most * 3), most)
    ]
    states, results = one_by_one(incidents, commands)
    out = triage.incident_lifecycle(frame(INCIDENT, *incidents), frame(COMMAND, *commands), as_of=NOW, hours=HOURS)
    assert {r.command_seq: (r.accepted, r.result) for r in out.results.collect()} == results
    assert {r.incident_id: r.status for r in out.incidents.collect()} == states


def command(seq, name, action, hours_ago, reason=None, snooze=0, owner=None):
    return (seq, name, action, NOW - timedelta(hours=hours_ago), owner, reason, snooze)


def test_what_an_incident_shows(frame):
    incidents = [incident(n) for n in "ABCDEF"] + [incident("G", start="2024-01-30 12:00:00"), incident("H", severity="LOW")]
    commands = [
        command(1, "A", "ACKNOWLEDGE", 30), command(2, "A", "ASSIGN", 20, owner="T1"), command(3, "A", "ASSIGN", 10, owner="T2"),
        command(4, "B", "SNOOZE", 30, "waiting for parts", 31), command(5, "C", "SNOOZE", 30, "ended", 29),
        command(6, "D", "ACKNOWLEDGE", 30), command(7, "D", "RESOLVE", 5, "mended"), command(8, "E", "FALSE_POSITIVE", 5, "sensor"),
        command(9, "E", "REOPEN", 4), command(10, "F", "ESCALATE", 3), command(11, "F", "RESOLVE", 2, "too early"),
    ]
    out = triage.incident_lifecycle(frame(INCIDENT, *incidents), frame(COMMAND, *commands), as_of=NOW, hours=HOURS)
    got = {r.incident_id: r for r in out.incidents.collect()}
    assert (got["A"].status, got["A"].owner, got["A"].acknowledged_at) == ("ASSIGNED", "T2", NOW - timedelta(hours=30))
    assert got["A"].escalation_status == "OVERDUE" and got["A"].updated_at == NOW - timedelta(hours=10)
    assert (got["B"].status, got["B"].snooze_reason, got["B"].escalation_status) == ("NEW", "waiting for parts", None)
    assert got["B"].snoozed_until == NOW + timedelta(hours=1)
    assert (got["C"].snooze_reason, got["C"].snoozed_until, got["C"].escalation_status) == (None, None, "OVERDUE")
    assert (got["D"].status, got["D"].resolution_reason, got["D"].escalation_status) == ("RESOLVED", "mended", None)
    assert (got["E"].status, got["E"].false_positive_reason) == ("NEW", None)
    assert (got["F"].status, got["F"].escalation_status, got["F"].resolution_reason) == ("NEW", "ESCALATED", None)
    assert got["G"].escalation_status is None and got["H"].escalation_status is None


def test_no_commands(frame):
    out = triage.incident_lifecycle(frame(INCIDENT, incident("A", "ASSIGNED")), frame(COMMAND), as_of=NOW, hours=HOURS)
    assert [r.status for r in out.incidents.collect()] == ["ASSIGNED"] and out.results.collect() == []
