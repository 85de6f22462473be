"""The life of incidents: an ordered fold of commands through a table of moves.

The state before a command depends on all commands before it. A command is a
map from states to states, and maps can be put together in any grouping that
keeps their order: commands are folded in chunks of consecutive numbers, chunks
in chunks of chunks, and the states at the start of every chunk are handed back
down. However many commands an incident has, a task sees CHUNK of them.
"""

from __future__ import annotations

from datetime import datetime
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from plantpulse import rules
from plantpulse.functions import epoch_seconds, moment

CHUNK = 256


class Lifecycle(NamedTuple):
    incidents: DataFrame
    results: DataFrame


def _state(name: Column, states=rules.INCIDENT_STATES) -> Column:
    """Place of a state in the table; the first for one it does not know."""
    out = F.lit(0)
    for place, state in enumerate(states):
        out = F.when(name == state, F.lit(place)).otherwise(out)
    return out


def _moves(action: Column, moves=rules.INCIDENT_MOVES, states=rules.INCIDENT_STATES) -> Column:
    """For each state the one the action leads to, -1 where it is not allowed."""
    out = F.array(*[F.lit(-1)] * len(states))
    for name, steps in moves.items():
        leads = [states.index(steps[s]) if s in steps else -1 for s in states]
        out = F.when(action == name, F.array(*map(F.lit, leads))).otherwise(out)
    return out


def _after(state: Column, moves: Column) -> Column:
    to = F.element_at(moves, state + 1)
    return F.when(to >= 0, to).otherwise(state)


def _chunk(column: str) -> Column:
    return F.floor(F.col(column) / CHUNK).cast("long")


def command_states(commands: DataFrame, start: DataFrame) -> tuple[DataFrame, DataFrame]:
    """incident_id, command_seq, before, after of every command on a known incident, and its state in the end.

    ``commands`` has incident_id, command_seq (not negative, once per incident)
    and moves; ``start`` has incident_id and state.
    """
    count = len(rules.INCIDENT_STATES)
    same = F.array(*map(F.lit, range(count)))
    largest = commands.agg(F.max("command_seq")).first()[0]
    rows = commands.select("incident_id", F.col("command_seq").alias("at"), "moves")
    rows = rows.withColumn("moves", F.transform(same, lambda s: _after(s, F.col("moves"))))
    levels = []
    while True:
        folded = (
            rows.withColumn("chunk", _chunk("at")).groupBy("incident_id", "chunk")
            .agg(F.array_sort(F.collect_list(F.struct("at", "moves"))).alias("held"))
        )
        levels.append(folded)
        rows = folded.select(
            "incident_id", F.col("chunk").alias("at"),
            F.aggregate("held", same, lambda m, h: F.transform(m, lambda s: F.element_at(h["moves"], s + 1))).alias("moves"),
        )
        largest = (largest or 0) // CHUNK
        if largest == 0:
            break
    top = start.join(rows.select("incident_id", "moves"), "incident_id", "left")
    ended = top.select("incident_id", F.coalesce(F.element_at("moves", F.col("state") + 1), "state").alias("state"))
    states = top.where(F.col("moves").isNotNull()).select("incident_id", F.lit(0).cast("long").alias("chunk"), "state")
    for folded in reversed(levels):
        empty = F.array().cast("array<struct<at:bigint,before:int,after:int>>")

        def step(acc, h):
            to = F.element_at(h["moves"], acc["state"] + 1)
            line = F.struct(h["at"].alias("at"), acc["state"].alias("before"), to.alias("after"))
            return F.struct(to.alias("state"), F.concat(acc["lines"], F.array(line)).alias("lines"))

        run = F.aggregate("held", F.struct(F.col("state").alias("state"), empty.alias("lines")), step)["lines"]
        lines = folded.join(states, ["incident_id", "chunk"]).select("incident_id", F.explode(run).alias("line"))
        states = lines.select("incident_id", F.col("line.at").alias("chunk"), F.col("line.before").alias("state"))
    return lines.select("incident_id", F.col("line.at").alias("command_seq"), "line.before", "line.after"), ended


def incident_lifecycle(
    incidents: DataFrame, commands: DataFrame, *, as_of: datetime, hours: dict[str, int]
) -> Lifecycle:
    """Incidents after a history of commands, and a result for every command.

    ``commands`` has command_seq, incident_id, action, given_at, owner, reason
    and snooze_hours; they count in order of their number. An action the table
    of moves does not allow in the state at that point gives an error row and
    changes nothing, as does an unknown action or incident. What an incident
    shows comes from its accepted commands: the last acknowledgement, owner,
    snooze and escalation, and the reason that closed it.

    Time does the rest: a snooze ends by itself, and an open incident older than
    the ``hours`` of its severity is OVERDUE, unless it was escalated by hand or
    is snoozed.
    """
    known = incidents.select("incident_id", _state(F.col("status")).alias("state"))
    named = commands.join(known.select("incident_id", F.lit(True).alias("_known")), "incident_id", "left").withColumn(
        "moves", _moves(F.col("action"))
    )
    steps, ended = command_states(named.where("_known").select("incident_id", "command_seq", "moves"), known)
    names = F.array(*map(F.lit, rules.INCIDENT_STATES))
    judged = named.join(steps, ["incident_id", "command_seq"], "left").withColumns({
        "_before": F.element_at(names, F.col("before") + 1), "_after": F.element_at(names, F.col("after") + 1),
        "accepted": F.when(F.col("before").isNotNull(), F.element_at("moves", F.col("before") + 1) >= 0).otherwise(F.lit(False)),
    })
    who = F.col("incident_id")
    result = (
        F.when(F.col("_known").isNull(), F.concat(F.lit("ERROR: Unknown incident "), who))
        .when(~F.col("action").isin(*rules.INCIDENT_MOVES), F.concat(F.lit("ERROR: Unknown action "), F.col("action")))
        .when(~F.col("accepted"), F.concat(F.lit("ERROR: "), F.col("action"), F.lit(" not allowed for "), who, F.lit(" in "), F.col("_before")))
        .otherwise(F.concat(F.lit("OK: "), who, F.lit(" "), F.col("_before"), F.lit(" -> "), F.col("_after")))
    )

    def last(action: str, value: str | Column) -> Column:
        return F.max_by(value, F.when(F.col("action") == action, F.col("command_seq")))

    shown = judged.where("accepted").groupBy("incident_id").agg(
        F.max("given_at").alias("_changed"),
        last("ACKNOWLEDGE", "given_at").alias("_acknowledged"), last("ASSIGN", "owner").alias("_owner"),
        last("SNOOZE", F.struct("given_at", "snooze_hours", "reason")).alias("_snooze"),
        F.max(F.when(F.col("action") == "ESCALATE", F.lit("ESCALATED"))).alias("_escalated"),
        last("RESOLVE", "reason").alias("_resolved"), last("FALSE_POSITIVE", "reason").alias("_false"),
    )
    now = moment(as_of)
    status = F.element_at(names, F.col("state") + 1)
    is_open = ~status.isin(*rules.CLOSED_INCIDENT_STATES)
    until = F.col("_snooze.given_at") + F.make_dt_interval(F.lit(0), F.col("_snooze.snooze_hours"))
    snoozed = F.coalesce(is_open & (until > now), F.lit(False))
    allowed = F.lit(None).cast("int")
    for severity, limit in hours.items():
        allowed = F.when(F.col("severity") == severity, F.lit(limit)).otherwise(allowed)
    late = epoch_seconds(now) - epoch_seconds(F.col("incident_start")) > allowed * 3600
    escalation = F.when(is_open, F.when(F.col("_escalated").isNotNull(), F.col("_escalated")).when(late & ~snoozed, F.lit("OVERDUE")))
    changed = incidents.drop("state").join(ended, "incident_id").join(shown, "incident_id", "left").withColumns({
        "status": status,
        "acknowledged_at": F.coalesce("_acknowledged", "acknowledged_at"), "owner": F.coalesce("_owner", "owner"),
        "snooze_reason": F.when(snoozed, F.col("_snooze.reason")),
        "snoozed_until": F.when(snoozed, until),
        "escalation_status": escalation,
        "resolution_reason": F.when(status == "RESOLVED", F.col("_resolved")),
        "false_positive_reason": F.when(status == "FALSE_POSITIVE", F.col("_false")),
        "updated_at": F.coalesce("_changed", "updated_at"),
    })
    return Lifecycle(
        changed.select(*incidents.columns, *([] if "snoozed_until" in incidents.columns else ["snoozed_until"])),
        judged.select("command_seq", "incident_id", "action", "accepted", result.alias("result")),
    )
