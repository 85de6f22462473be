"""The same results in ANSI SQL for an independent engine.

Steps are named subqueries; a query pulls in the ones it mentions. Constants
come from the rule tables, everything else is written out here.
"""

from __future__ import annotations

import re

from plantpulse import rules
from plantpulse.sources import shared

NOW = "timestamp '2024-01-31 00:00:00'"
# When little telemetry is recent enough, so that machines lack a health score
LATER = "timestamp '2024-01-31 23:00:00'"


# --- text helpers -----------------------------------------------------------

def r(x, n):
    return f"cast(round(cast({x} as decimal(38,10)), {n}) as double)"


def text(x, n):
    return f"cast(cast(round(cast({x} as decimal(38,10)), {n}) as decimal(28,{n})) as varchar)"


def pick(values, index):
    listed = ", ".join(f"'{v}'" for v in values)
    return f"([{listed}])[cast({index} as integer) + 1]"


def recode(x, pairs, other="null"):
    arms = " ".join(f"when '{a}' then '{b}'" for a, b in pairs)
    return f"(case {x} {arms} else {other} end)"


def steps(x, limits, sign=">"):
    arms = " ".join(f"when {x} {sign} {limit} then {gain}" for limit, gain in limits)
    return f"(case {arms} else 0 end)"


def points(table):
    return " + ".join(steps(f"abs(coalesce({c}, 0))", limits) for c, limits in table)


def bands(x, table, other):
    arms = " ".join(f"when {x} >= {floor} then '{name}'" for floor, name in table)
    return f"(case {arms} else {other} end)"


def place(x, order, other):
    arms = " ".join(f"when '{code}' then {i}" for i, code in enumerate(order, 1))
    return f"(case {x} {arms} else {other} end)"


def inside(values):
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def machine(x):
    return f"('M' || lpad(cast({x} % {shared.FLEET_SIZE} as varchar), 3, '0'))"


def padded(x, n):
    t = f"cast({x} as varchar)"
    return f"(case when length({t}) >= {n} then {t} else lpad({t}, {n}, '0') end)"


def order_id(x):
    return f"('WO-' || {padded(x, 4)})"


def incident_id(x):
    return f"('INC-' || {padded(x, 3)})"


def since(ts, amount):
    return f"{ts} between {NOW} - interval {amount} and {NOW}"


K = "cast(regexp_extract(props, '([0-9]+)', 1) as integer)"
MODES = shared.MODE_OF_PRIORITY
FOLLOWING = tuple(zip(shared.TYPES, shared.TYPES[1:] + shared.TYPES[:1]))
PREDICTED = f"predicted_failure_mode <> '{rules.NO_PREDICTION}'"

S: dict[str, str] = {}

# --- stored tables ----------------------------------------------------------

S["machines"] = f"""
select {machine('n_nationkey')} as machine_id, n_name as machine_name,
  {pick(shared.TYPES, 'n_nationkey % 6')} as machine_type, r_name as line,
  'ST-' || cast(n_nationkey % 7 as varchar) as station,
  'HALL-' || cast(n_nationkey % 3 as varchar) as location,
  case when n_nationkey % 8 <> 7 then 80.0::double end as rated_rpm,
  case when n_nationkey % 9 = 8 then 0.0::double else 60.0::double end as rated_current,
  {pick(shared.CRITICALITIES, 'n_nationkey % 3')} as criticality,
  case when n_nationkey % 10 = 9 then 'MAINTENANCE' else 'RUNNING' end as operating_state
from nation join region on r_regionkey = n_regionkey"""

S["supplier_machines"] = f"""
select 'S' || {padded('s_suppkey', 8)} as machine_id, s_name as machine_name,
  {pick(shared.TYPES, 's_suppkey % 6')} as machine_type, r_name as line,
  {pick(shared.CRITICALITIES, 's_suppkey % 3')} as criticality
from supplier join nation on n_nationkey = s_nationkey join region on r_regionkey = n_regionkey"""

S["sensors"] = """
select machine_id || '-' || signal_type as sensor_id, machine_id, signal_type,
  case signal_type when 'VIBRATION' then 'mm/s' when 'CURRENT' then 'A' when 'RPM' then 'rpm'
    when 'PRESSURE' then 'bar'
    else case when cast(substr(machine_id, 2) as integer) % 2 = 0 then 'F' else 'C' end
  end as unit,
  case when signal_type <> 'RPM' then 80.0::double end as warning_threshold,
  case when signal_type <> 'RPM' then 150.0::double end as critical_threshold,
  43200::bigint as sampling_interval_sec
from machines, (values ('VIBRATION'), ('TEMPERATURE'), ('CURRENT'), ('RPM'), ('PRESSURE')) v(signal_type)"""

S["readings"] = f"""
select event_id as reading_id, machine_id || '-' || signal_type as sensor_id, machine_id,
  signal_type, case when k <> 99 then value end as reading_value, ts as reading_timestamp,
  case when k < 2 then 'SUSPECT' when k = 2 then 'STALE' else 'GOOD' end as quality_flag
from (select *, {K} as k, {machine('user_id')} as machine_id,
        {recode('event_type', shared.SIGNAL_OF_EVENT)} as signal_type from events)"""

S["machine_events"] = f"""
select event_id, {machine('user_id')} as machine_id, kind as event_type,
  case when kind <> 'STATE_CHANGE' then 'EV-' || cast(k % 7 as varchar)
    when k % 2 = 0 then 'SC-HIGHLOAD' else 'SC-NORMAL' end as event_code,
  {bands('value', ((150, 'CRITICAL'), (80, 'WARNING')), "'INFO'")} as severity,
  ts as event_timestamp
from (select *, {pick(shared.EVENT_TYPES, 'k % 5')} as kind
      from (select *, {K} as k from events where event_type = 'error'))"""

S["shift_logs"] = f"""
select event_id as log_id, {machine('user_id')} as machine_id,
  {pick(shared.OBSERVATIONS, 'k % 6')} as observation_type,
  'Observation number ' || cast(k as varchar) as observation_detail,
  {bands('value', ((150, 'HIGH'), (80, 'MEDIUM')), "'LOW'")} as severity, ts as observed_at
from (select *, {K} as k from events where event_type = 'signup')"""

S["history"] = f"""
select 'MH-' || {padded('o_orderkey', 9)} as maintenance_id, {machine('o_custkey')} as machine_id,
  {recode('o_orderpriority', MODES)} as failure_mode,
  'Cause ' || cast(o_orderkey % 11 as varchar) as root_cause,
  'Action ' || cast(o_orderkey % 7 as varchar) as action_taken,
  'Part ' || cast(o_orderkey % 5 as varchar) as parts_replaced,
  cast(o_orderkey % 8 as double) + 0.5 as repair_duration_hrs,
  cast(o_orderkey % 12 as double) as downtime_hrs,
  cast(o_totalprice as decimal(12,2)) as cost,
  case o_orderstatus when 'F' then 'CORRECTIVE' when 'O' then 'PREVENTIVE' else 'INSPECTION' end
    as maintenance_type,
  case when not (o_orderstatus = 'P' and o_orderkey % 400 = 0) then o_orderdate end as completed_at
from orders"""

S["parts"] = f"""
select 'P' || {padded('p_partkey', 9)} as part_id,
  p_type || ',' || {recode('p_type', FOLLOWING)} as compatible_machine_types,
  p_size % 4 as quantity_on_hand, cast(p_size as bigint) as lead_time_days
from part"""

S["counts"] = f"""
select {machine('m')} as machine_id, {pick(shared.SHIFTS, 's')} as shift, production_date,
  cast(units as bigint) as actual_units, cast(floor(lost + 1e-6) as bigint) as rejected_units,
  {r('28800.0 / (n * 50)', 2)} as ideal_cycle_time_sec, 8.0::double as planned_runtime_hrs,
  {r('idle * 8', 2)} as downtime_hrs
from (select l_suppkey % 25 as m, l_linenumber % 3 as s,
        cast(date_trunc('week', l_shipdate) as date) as production_date, count(*) as n,
        sum(l_quantity) as units, sum(l_quantity * l_discount) as lost, avg(l_tax) as idle
      from lineitem group by 1, 2, 3)"""

S["production"] = f"""
select *, actual_units - rejected_units as good_units,
  {r('ideal_cycle_time_sec * 1.1', 2)} as cycle_time_sec,
  {r('8 - downtime_hrs', 2)} as actual_runtime_hrs,
  case when rejected_units * 100 > actual_units * 6 then 'DEGRADED' else 'NORMAL' end
    as production_status
from counts"""

S["work_orders"] = f"""
select {order_id('o_orderkey')} as work_order_id, {incident_id('(o_orderkey % 200 + 1)')} as incident_id,
  {machine('o_custkey')} as machine_id,
  case o_orderkey % 100 when 0 then 'DRAFT' when 1 then 'APPROVED' when 2 then 'ASSIGNED'
    when 3 then 'REJECTED' else 'RESOLVED' end as status,
  {pick(('CRITICAL', 'HIGH', 'MEDIUM'), 'o_orderkey % 3')} as priority,
  'Problem ' || cast(o_orderkey % 13 as varchar) as problem_description,
  {recode('o_orderpriority', MODES)} as predicted_failure_mode,
  'Step ' || cast(o_orderkey % 7 as varchar) as recommended_actions,
  cast(o_orderkey % 9 as double) + 0.5 as estimated_repair_hrs,
  cast(o_orderkey % 14 as double) + 1.0 as estimated_downtime_hrs,
  'TECH-' || cast(o_orderkey % 6 as varchar) as assigned_technician,
  o_orderkey as order_no, o_orderdate as created_at
from orders"""

S["approval_commands"] = f"""
select o_orderkey * 2 + turn as command_seq,
  case when o_orderkey % 97 = 5 then 'WO-X' || cast(o_orderkey as varchar)
    else {order_id('o_orderkey')} end as work_order_id,
  'APPROVER-' || cast(o_custkey % 5 as varchar) as approver,
  case when turn = 1 then 'APPROVE'
    else {pick(('APPROVE', 'REJECT', 'ESCALATE'), '(o_orderkey // 100) % 3')} end as action
from orders, (values (0), (1)) v(turn)
where turn = 0 or o_orderkey % 200 = 0"""

S["resolution_commands"] = f"""
select o_orderkey as command_seq,
  case when o_orderkey % 97 = 5 then 'WO-X' || cast(o_orderkey as varchar)
    else {order_id('o_orderkey')} end as work_order_id,
  'Cause ' || cast(o_orderkey % 11 as varchar) as root_cause,
  'Part ' || cast(o_orderkey % 5 as varchar) as parts,
  cast(o_orderkey % 8 as double) + 0.5 as hours,
  'Finding ' || cast(o_orderkey % 4 as varchar) as findings
from orders"""

S["triage_commands"] = f"""
select o_orderkey as command_seq, {incident_id('((o_orderkey // 3) % 50 + 1)')} as incident_id,
  case when o_orderstatus = 'F' then 'ACKNOWLEDGE' else 'FALSE_POSITIVE' end as action
from orders"""

# --- telemetry --------------------------------------------------------------

S["timeline"] = f"""
select *, date_diff('second', lag(reading_timestamp) over w, reading_timestamp) as gap_seconds,
  avg(reading_value) over (w rows between {rules.SPIKE_LOOKBACK} preceding and 1 preceding) as usual,
  stddev_samp(reading_value) over (w rows between {rules.SPIKE_LOOKBACK} preceding and 1 preceding) as swing
from readings join sensors using (sensor_id, machine_id, signal_type)
window w as (partition by sensor_id order by reading_timestamp, reading_id)"""

S["clean"] = f"""
select reading_id, sensor_id, machine_id, signal_type, reading_timestamp,
  reading_value as raw_value, if(reading_value is null, 'MISSING', quality_flag) as quality_flag,
  if(signal_type = 'TEMPERATURE' and unit = 'F', {r('(reading_value - 32) * 5.0 / 9.0', 2)},
     reading_value) as normalized_value,
  {bands('reading_value', (('critical_threshold', 'CRITICAL'), ('warning_threshold', 'WARNING')), "'NORMAL'")}
    as threshold_status,
  coalesce(gap_seconds > sampling_interval_sec * {rules.STALE_FACTOR}, false) as is_stale,
  coalesce(abs(reading_value - usual) > swing * {rules.SPIKE_SIGMA} + 1e-9, false) as is_spike,
  warning_threshold, critical_threshold, unit
from timeline"""

S["hourly"] = f"""
select machine_id, signal_type, date_trunc('hour', reading_timestamp) as hour_bucket,
  {r('avg(normalized_value)', 4)} as avg_value, {r('max(normalized_value)', 4)} as max_value,
  {r('min(normalized_value)', 4)} as min_value,
  {r('stddev_samp(normalized_value)', 4)} as std_value, count(*) as reading_count,
  count(*) filter (threshold_status = 'WARNING') as warning_count,
  count(*) filter (threshold_status = 'CRITICAL') as critical_count,
  count(*) filter (is_spike) as spike_count,
  count(*) filter (quality_flag <> 'GOOD') as bad_quality_count
from clean group by all"""


def rolling(last, earlier, window):
    return f"""
select *, {r(f'avg(avg_value) over (w {last(rules.SHORT_FRAME)})', 4)} as rolling_6h_avg,
  {r(f'avg(avg_value) over (w {last(rules.DAY_FRAME)})', 4)} as rolling_24h_avg,
  {r(f'avg_value - {earlier}', 4)} as rate_of_change_6h,
  {r(f'avg_value - avg(avg_value) over (w {last(rules.WEEK_FRAME)})', 4)} as baseline_deviation_7d,
  {r(f'stddev_samp(std_value) over (w {last(rules.DAY_FRAME)})', 4)} as variability_trend_24h
from hourly window w as (partition by machine_id, signal_type order by {window})"""


S["features"] = rolling(
    lambda n: f"rows between {n - 1} preceding and current row",
    f"lag(avg_value, {rules.SHORT_FRAME}) over w", "hour_bucket",
)

S["operating"] = f"""
select m.machine_id, machine_name, machine_type, line, criticality, rated_rpm, rated_current,
  case when event_type = 'SHUTDOWN' then 'OFFLINE' when event_type = 'FAULT' then 'FAULT'
    when event_code = '{rules.HIGH_LOAD_CODE}' then 'HIGH_LOAD' else operating_state end as current_state,
  avg_rpm, case when rated_rpm > 0 then {r('avg_rpm / nullif(rated_rpm, 0) * 100', 1)} end as load_pct,
  avg_current,
  case when rated_current > 0 then {r('avg_current / nullif(rated_current, 0) * 100', 1)} end as current_pct,
  coalesce(event_type = 'SHUTDOWN', false) or operating_state in {inside(rules.SUPPRESSED_STATES)}
    as suppress_signals,
  event_timestamp as last_state_change
from machines m
left join state_event using (machine_id)
left join (select machine_id, {r("avg(reading_value) filter (signal_type = 'RPM')", 2)} as avg_rpm,
             {r("avg(reading_value) filter (signal_type = 'CURRENT')", 2)} as avg_current
           from readings where {since('reading_timestamp', '6 hours')} group by 1) using (machine_id)"""

S["state_event"] = f"""
select machine_id, event_type, event_code, event_timestamp from machine_events
where event_type in {inside(rules.STATE_EVENTS)}
qualify row_number() over (partition by machine_id order by event_timestamp desc, event_id desc) = 1"""

S["latest"] = f"""
select machine_id, signal_type, max(hour_bucket) as latest_hour,
  arg_max_null(avg_value, hour_bucket) as latest_avg,
  arg_max_null(rolling_24h_avg, hour_bucket) as latest_24h_avg,
  arg_max_null(baseline_deviation_7d, hour_bucket) as latest_baseline_dev,
  arg_max_null(rate_of_change_6h, hour_bucket) as latest_roc,
  cast(sum(warning_count) as bigint) as total_warnings_24h,
  cast(sum(critical_count) as bigint) as total_criticals_24h,
  cast(sum(spike_count) as bigint) as total_spikes_24h,
  cast(sum(bad_quality_count) as bigint) as total_bad_quality_24h
from features where {since('hour_bucket', '24 hours')} group by all"""

S["scores"] = f"""
select machine_id, signal_type,
  cast(greatest(0, least(100, 100 - ({points(rules.HEALTH_PENALTIES)}))) as bigint) as signal_health_score
from latest"""

S["fleet"] = f"""
select m.machine_id, m.machine_name, m.machine_type, m.line, m.criticality, o.current_state,
  o.load_pct, o.suppress_signals, {r('mean', 1)} as health_score,
  {bands('mean', rules.HEALTH_BANDS, f"'{rules.HEALTH_FLOOR}'")} as health_status,
  rank() over (order by mean asc nulls last) as concern_rank,
  coalesce(risky, 0) as signals_at_risk, lowest as worst_signal_score,
  lowest_signal as worst_signal_type, {NOW} as computed_at
from machines m left join operating o using (machine_id)
left join (select machine_id, avg(signal_health_score) as mean,
             count(*) filter (signal_health_score < {rules.AT_RISK_BELOW}) as risky,
             min(signal_health_score) as lowest,
             first(signal_type order by signal_health_score, signal_type) as lowest_signal
           from scores group by 1) using (machine_id)"""

# --- maintenance background -------------------------------------------------

S["last_repair"] = f"""
select machine_id, maintenance_id as last_maint_id, failure_mode as last_failure_mode,
  root_cause as last_root_cause, completed_at as last_maint_date,
  date_diff('day', completed_at, {NOW}) as days_since_last_maint
from history
qualify row_number() over (partition by machine_id order by completed_at desc nulls first, maintenance_id desc) = 1"""

S["repair_totals"] = """
select machine_id, count(*) as failure_count, sum(cost) as total_maint_cost from history group by 1"""

S["observation"] = """
select machine_id, observation_type as latest_obs_type, observation_detail as latest_obs_detail,
  severity as latest_obs_severity, observed_at as latest_obs_time from shift_logs
qualify row_number() over (partition by machine_id order by observed_at desc, log_id desc) = 1"""


def last_output(shift):
    return f"""
select machine_id, production_status as latest_prod_status, actual_units as latest_actual_units,
  rejected_units as latest_rejected_units,
  coalesce({r('rejected_units / nullif(actual_units, 0)::double * 100', 2)}, 0) as latest_reject_rate
from production
qualify row_number() over (partition by machine_id order by production_date desc, {shift} desc) = 1"""


S["output"] = last_output("shift")

S["event_counts"] = f"""
select machine_id, count(*) as recent_event_count,
  count(*) filter (severity = 'CRITICAL') as recent_critical_events
from machine_events where {since('event_timestamp', '7 days')} group by 1"""

S["stock"] = """
select m.machine_id, count(distinct part_id) as parts_available, min(lead_time_days) as min_lead_time_days
from machines m join parts on quantity_on_hand > 0
  and position(m.machine_type in compatible_machine_types) > 0
group by 1"""

S["background"] = """
select f.machine_id, machine_name, machine_type, line, criticality, current_state, health_score,
  health_status, concern_rank, worst_signal_type, worst_signal_score, signals_at_risk, computed_at,
  a.* exclude (machine_id), b.* exclude (machine_id), c.* exclude (machine_id),
  d.* exclude (machine_id), e.* exclude (machine_id), g.* exclude (machine_id)
from fleet f left join last_repair a using (machine_id) left join repair_totals b using (machine_id)
left join observation c using (machine_id) left join output d using (machine_id)
left join event_counts e using (machine_id) left join stock g using (machine_id)"""

# --- prediction -------------------------------------------------------------

S["scored"] = f"""
select *, cast(greatest(0, least(100, {points(rules.ANOMALY_POINTS)})) as bigint) as anomaly_score
from features"""

S["anomalies"] = f"""
select row_number() over (order by hour_bucket, machine_id, signal_type) as anomaly_id, machine_id,
  hour_bucket as detection_timestamp, signal_type as affected_signal, anomaly_score,
  {bands('anomaly_score', rules.ANOMALY_BANDS, 'null')} as severity, avg_value as signal_value,
  rolling_24h_avg, baseline_deviation_7d, rate_of_change_6h, '{rules.ANOMALY_MODEL}' as model_id,
  '{rules.ANOMALY_MODEL_TEXT}' as model_description, {NOW} as created_at
from scored where {since('hour_bucket', '7 days')} and anomaly_score >= {rules.ANOMALY_KEEP}"""

S["rollup_"] = f"""
select machine_id, count(*) as anomaly_count, min(detection_timestamp) as first_anomaly_time,
  max(detection_timestamp) as latest_anomaly_time,
  string_agg(distinct affected_signal, ', ' order by affected_signal) as affected_signals
from anomalies
where severity in ('HIGH', 'MEDIUM') and {since('detection_timestamp', '7 days')} group by 1"""

S["daily"] = f"""
select machine_id, signal_type, date_trunc('day', hour_bucket)::timestamp as day_bucket,
  {r('avg(avg_value)', 4)} as daily_avg, {r('max(max_value)', 4)} as daily_max,
  cast(sum(warning_count) as bigint) as daily_warnings,
  cast(sum(critical_count) as bigint) as daily_criticals
from features group by all"""

S["slopes"] = f"""
select machine_id, signal_type, max(day_bucket) as latest_day,
  arg_max_null(daily_avg, day_bucket) as latest_avg, arg_max_null(daily_max, day_bucket) as latest_max,
  {r(f"(avg(daily_avg) filter (age <= {rules.TREND_RECENT_DAYS}) - avg(daily_avg) filter (age between {rules.TREND_PRIOR_DAYS[1]} and {rules.TREND_PRIOR_DAYS[0]})) / {rules.TREND_DIVISOR}", 10)}
    as trend_slope_7d
from (select *, date_diff('day', day_bucket, (select max(day_bucket) from daily)) as age from daily)
group by 1, 2"""

_mode_arms = " ".join(
    f"when signal_type = '{signal}' and trend_slope_7d {'>' if way == 'rising' else '<'} {limit} then '{mode}'"
    for signal, way, limit, mode in rules.FAILURE_RULES
)
_horizon_arms = " ".join(f"when days <= {d} then '{h}'" for d, h in rules.RISK_HORIZONS)
_confidence_arms = " ".join(f"when steep > {s} then '{c}'" for s, c in rules.CONFIDENCE_STEPS)

S["judged"] = f"""
select *, case {_mode_arms} else '{rules.NO_PREDICTION}' end as predicted_failure_mode,
  case {_horizon_arms} when trend_slope_7d > 0 then '{rules.FAR_HORIZON}' else '{rules.NO_HORIZON}' end
    as risk_horizon,
  {r('days', 1)} as estimated_days_to_threshold,
  case when steep > {rules.HIGH_CONFIDENCE_SLOPE} and latest_max > coalesce(warning_threshold, {rules.UNSET_WARNING})
    then 'HIGH' {_confidence_arms} else '{rules.NO_CONFIDENCE}' end as confidence_level
from (select *, abs(coalesce(trend_slope_7d, 0)) as steep,
        case when trend_slope_7d > 0 then (critical_threshold - latest_avg) / trend_slope_7d end as days
      from slopes join (select machine_id, signal_type, warning_threshold, critical_threshold from sensors)
        using (machine_id, signal_type))"""

S["forecasts"] = f"""
select row_number() over (order by machine_id, signal_type) as forecast_id, machine_id, signal_type,
  latest_day as prediction_date, predicted_failure_mode, risk_horizon, estimated_days_to_threshold,
  latest_avg as current_value, critical_threshold, {r('trend_slope_7d', 4)} as trend_slope_7d,
  confidence_level, '{rules.FORECAST_MODEL}' as model_version, {NOW} as prediction_timestamp
from judged"""


def evidence(horizon, confidence):
    seen = ", ".join(
        f"max({value}) filter (signal_type = '{signal}') as {short}_{name}"
        for short, signal in rules.EVIDENCE_SIGNALS
        for value, name in (("current_value", "current"), ("trend_slope_7d", "slope"))
    )
    return f"""
select f.*, machine_name, machine_type, criticality, health_score, health_status, last_failure_mode,
  last_root_cause, days_since_last_maint, failure_count, latest_obs_type, latest_obs_detail,
  latest_obs_severity, latest_prod_status, latest_reject_rate
from (select machine_id,
        string_agg(distinct predicted_failure_mode, ', ' order by predicted_failure_mode)
          filter ({PREDICTED}) as predicted_modes,
        min(estimated_days_to_threshold) filter ({PREDICTED}) as min_days_to_threshold,
        {horizon} as worst_risk_horizon, {confidence} as max_confidence, {seen}
      from forecasts group by 1) f join background using (machine_id)"""


S["evidence"] = evidence(
    f"min(risk_horizon) filter ({PREDICTED})", f"max(confidence_level) filter ({PREDICTED})"
)


def said(condition, *pieces):
    return f"(case when {condition} then {' || '.join(pieces)} else '' end)"


_story = " || ".join([
    "machine_name || ' (' || machine_type || ', ' || criticality || ' criticality): '",
    said("vib_slope > 0.1", "'Vibration trending up at '", text("vib_slope", 2),
         "' mm/s per day (current: '", text("vib_current", 1), "' mm/s). '"),
    said("temp_slope > 0.5", "'Temperature rising at '", text("temp_slope", 1),
         "' C/day (current: '", text("temp_current", 1), "' C). '"),
    said("curr_slope > 0.3", "'Current draw increasing at '", text("curr_slope", 2), "' A/day. '"),
    said("press_slope < -1.0", "'Pressure dropping at '", text("abs(press_slope)", 1), "' bar/day. '"),
    said("last_failure_mode is not null", "'Prior failure: '", "last_failure_mode", "'. '"),
    said(f"latest_obs_severity in {inside(rules.REPORTED_SEVERITIES)}", "'Operator reported: '",
         "latest_obs_detail", "'. '"),
    said("latest_prod_status = 'DEGRADED'", "'Production status: DEGRADED. '"),
])

S["assessed"] = f"""
select *, {_story} as evidence_narrative,
  case when min_days_to_threshold <= {rules.IMMEDIATE_DAYS} and max_confidence = 'HIGH' then '{rules.RECOMMENDATIONS[0]}'
    when min_days_to_threshold <= {rules.SCHEDULE_DAYS} then '{rules.RECOMMENDATIONS[1]}'
    when predicted_modes is not null then '{rules.RECOMMENDATIONS[2]}'
    else '{rules.RECOMMENDATIONS[3]}' end as recommendation,
  case when max_confidence = '{rules.NO_CONFIDENCE}' then 'MANUAL_INSPECTION_RECOMMENDED'
    when health_score is null then 'MISSING_DATA' else 'AUTOMATED_ASSESSMENT' end as assessment_state,
  coalesce(split_part(predicted_modes, ',', 1), '{rules.NO_MODE}') as primary_failure_mode
from evidence"""

S["assessments"] = f"""
select row_number() over (order by min_days_to_threshold nulls last, health_score nulls last, machine_id)
    as assessment_id,
  machine_id, machine_name, machine_type, criticality, health_score, health_status,
  primary_failure_mode, predicted_modes as all_predicted_modes, worst_risk_horizon as risk_horizon,
  min_days_to_threshold as estimated_days_to_failure, max_confidence as confidence_level,
  evidence_narrative, recommendation, assessment_state, {NOW} as assessed_at
from assessed"""

# --- incidents --------------------------------------------------------------

_criticality = recode("criticality", rules.CRITICALITY_POINTS.items(), rules.OTHER_CRITICALITY_POINTS)
_confidence = recode("confidence_level", rules.CONFIDENCE_POINTS.items(), 0)

S["prioritised"] = f"""
select *, {r('greatest(0, least(100, health_points + criticality_points + production_points + urgency_points + confidence_points))', 2)}
    as priority_score
from (select a.*, u.* exclude (machine_id), latest_prod_status, latest_reject_rate, parts_available,
        min_lead_time_days,
        {r(f'(100 - coalesce(a.health_score, {rules.UNKNOWN_HEALTH})) * {rules.HEALTH_WEIGHT}', 2)} as health_points,
        cast({_criticality.replace('criticality', 'a.criticality', 1)} as double) as criticality_points,
        cast(case when latest_prod_status = 'DEGRADED' then {rules.DEGRADED_POINTS}
          else {steps('latest_reject_rate', rules.REJECT_STEPS)} end as double) as production_points,
        cast({steps('estimated_days_to_failure', rules.URGENCY_STEPS, '<=')} as double) as urgency_points,
        cast({_confidence} as double) as confidence_points
      from assessments a join background g on g.machine_id = a.machine_id
      left join rollup_ u on u.machine_id = a.machine_id
      where recommendation <> '{rules.RECOMMENDATIONS[3]}')"""

S["incidents"] = f"""
select {incident_id('n')} as incident_id, machine_id, machine_name, machine_type, criticality,
  first_anomaly_time as incident_start, latest_anomaly_time as latest_activity,
  date_diff('hour', first_anomaly_time, {NOW}) as incident_age_hours,
  primary_failure_mode as suspected_failure_mode, all_predicted_modes, affected_signals,
  anomaly_count as related_anomaly_count,
  {pick(rules.INCIDENT_SEVERITIES, 'urgency - 1')} as severity,
  health_score, health_status, risk_horizon, estimated_days_to_failure as rul_days, confidence_level,
  latest_prod_status as production_impact, latest_reject_rate as reject_rate_pct, evidence_narrative,
  priority_score, 'NEW' as status, cast(null as varchar) as owner,
  cast(null as timestamp) as acknowledged_at, cast(null as varchar) as snooze_reason,
  cast(null as varchar) as escalation_status, cast(null as varchar) as resolution_reason,
  cast(null as varchar) as false_positive_reason, parts_available, min_lead_time_days,
  {NOW} as created_at, {NOW} as updated_at
from (select *, row_number() over (order by urgency, estimated_days_to_failure nulls last, machine_id) as n
      from (select *, {place('recommendation', rules.RECOMMENDATIONS[:2], 3)} as urgency from prioritised))"""

S["triaged"] = f"""
select i.* replace (
    case action when 'ACKNOWLEDGE' then 'ACKNOWLEDGED' when 'FALSE_POSITIVE' then 'FALSE_POSITIVE'
      else status end as status,
    {NOW} as updated_at)
from incidents i
left join (select incident_id, arg_max(action, command_seq) as action from triage_commands group by 1)
  using (incident_id)"""

S["notices"] = f"""
select 'INCIDENT_CREATED' as notification_type, incident_id as reference_id, machine_id, severity,
  severity || ' incident ' || incident_id || ' on ' || machine_id || ': ' || suspected_failure_mode
    || '. ' || left(evidence_narrative, {rules.NOTICE_LENGTH}) as message
from incidents where status = 'NEW' and severity in {inside(rules.NOTIFIED_SEVERITIES)}"""

# --- work orders ------------------------------------------------------------

S["asked"] = """
select i.*, exists (select 1 from work_orders w where w.machine_id = i.machine_id
    and w.predicted_failure_mode = i.suspected_failure_mode
    and w.status not in ('RESOLVED', 'REJECTED')) as taken
from incidents i where incident_id in (select incident_id from work_orders)"""

S["accepted"] = """
select * from asked where not taken
qualify row_number() over (partition by machine_id, suspected_failure_mode
                           order by priority_score desc, incident_id) = 1"""


def template(part, quote):
    def shown(v):
        return f"'{v}'" if quote else f"{v}::double"

    arms = " ".join(f"when '{t[0]}' then {shown(t[part])}" for t in rules.ACTION_TEMPLATES[:-1])
    return f"(case suspected_failure_mode {arms} else {shown(rules.ACTION_TEMPLATES[-1][part])} end)"


_window = recode("severity", rules.ORDER_WINDOWS[:-1], f"'{rules.ORDER_WINDOWS[-1][1]}'")
_health = f"regexp_replace({text('health_score', 1)}, '\\.?0+$', '')"

S["drafts"] = f"""
select {order_id('(n + (select max(order_no) from work_orders))')} as work_order_id, incident_id, machine_id,
  'DRAFT' as status, severity as priority,
  'Predicted ' || suspected_failure_mode || ' on ' || machine_id || '. Health: ' || {_health}
    || '/100. Confidence: ' || confidence_level as problem_description,
  evidence_narrative as evidence_summary, suspected_failure_mode as predicted_failure_mode,
  {template(1, True)} as recommended_actions, {template(2, False)} as estimated_repair_hrs,
  {template(3, False)} as estimated_downtime_hrs, {_window} as recommended_window,
  {NOW} as created_at, {NOW} as updated_at
from (select *, row_number() over (order by priority_score desc, incident_id) as n from accepted)"""

S["first_decisions"] = """
select work_order_id, command_seq as decided_at, action as decision, approver as decider
from approval_commands where action in ('APPROVE', 'REJECT')
qualify row_number() over (partition by work_order_id order by command_seq) = 1"""

S["decided"] = """
select w.work_order_id, incident_id, decided_at, decision, decider
from work_orders w join first_decisions using (work_order_id) where status = 'DRAFT'"""

S["last_reports"] = """
select * from resolution_commands
qualify row_number() over (partition by work_order_id order by command_seq desc) = 1"""

# --- production -------------------------------------------------------------

S["oee"] = f"""
select machine_id, machine_name, machine_type, line, criticality, production_date, shift,
  {r('a * 100', 2)} as availability_pct, {r('p * 100', 2)} as performance_pct,
  {r('q * 100', 2)} as quality_pct, {r('a * p * q * 100', 2)} as oee_pct,
  actual_units, good_units, rejected_units, downtime_hrs, cycle_time_sec, ideal_cycle_time_sec,
  production_status
from (select *, coalesce(actual_runtime_hrs / nullif(planned_runtime_hrs, 0), 0) as a,
        coalesce(actual_units * ideal_cycle_time_sec / nullif(actual_runtime_hrs * 3600, 0), 0) as p,
        coalesce(good_units / nullif(actual_units, 0)::double, 0) as q
      from production join machines using (machine_id))"""

S["recent_oee"] = """
select *, date_diff('day', production_date, (select max(production_date) from production)) as age from oee
where production_date >= (select max(production_date) from production) - 7"""

_reject = "rejected_units / nullif(actual_units, 0)::double * 100"

S["effectiveness"] = f"""
select machine_id, {r('avg(oee_pct) filter (age = 0)', 2)} as current_oee,
  {r('avg(availability_pct) filter (age = 0)', 2)} as current_availability,
  {r('avg(quality_pct) filter (age = 0)', 2)} as current_quality, {r('avg(oee_pct)', 2)} as oee_7d_avg,
  {r('avg(good_units) filter (age = 0)', 0)} as daily_good_units,
  {r('avg(good_units) filter (age = 0) / 8.0', 1)} as units_per_hour,
  {r(f'avg({_reject}) filter (age = 0)', 2)} as current_reject_rate,
  {r(f'avg({_reject}) filter (age = 0) - avg({_reject}) filter (age between 1 and 7)', 2)} as reject_rate_trend
from recent_oee group by 1"""


def means(digits, prefix=""):
    return ", ".join(
        f"{r(f'avg({m}_pct)', digits)} as {prefix}{m}"
        for m in ("availability", "performance", "quality", "oee")
    )


S["oee_per_machine"] = f"""
select machine_id, machine_name, line, {means(1, 'avg_')},
  cast(sum(rejected_units) as bigint) as total_rejects, {r('sum(downtime_hrs)', 2)} as total_downtime
from recent_oee group by all"""

# --- queries ----------------------------------------------------------------

Q: dict[str, str] = {}
for _name, _step in {
    "clean_readings": "clean", "clean_readings_sliced": "clean", "latest_state_event": "state_event",
    "operating_context": "operating", "last_maintenance": "last_repair",
    "last_observation": "observation", "latest_production": "output",
    "recent_events": "event_counts", "parts_availability": "stock", "hourly_stats": "hourly",
    "rolling_features": "features", "latest_signal_features": "latest",
    "signal_health_score": "scores", "fleet_health": "fleet", "machine_detail": "fleet",
    "detect_anomalies": "anomalies", "anomaly_rollup": "rollup_", "daily_trends": "daily",
    "trend_slope": "slopes", "failure_forecasts": "forecasts", "machine_evidence": "evidence",
    "failure_assessments": "assessments", "build_incidents": "incidents",
    "incident_notifications": "notices", "draft_work_orders": "drafts", "oee_metrics": "oee",
    "oee_summary": "oee_per_machine",
}.items():
    Q[_name] = f"select * from {_step}"

Q["normalize_units"] = """select reading_id, signal_type, unit, raw_value as reading_value,
  normalized_value from clean"""
Q["threshold_status"] = "select reading_id, raw_value as reading_value, threshold_status from clean"
Q["stale_gap"] = """select t.reading_id, t.sensor_id, t.reading_timestamp, gap_seconds, is_stale
  from timeline t join clean using (reading_id)"""
Q["spike_flag"] = """select reading_id, sensor_id, reading_timestamp, raw_value as reading_value,
  is_spike from clean"""
Q["quality_flag"] = "select reading_id, quality_flag from clean"
Q["flat_lines"] = """select reading_id, sensor_id, machine_id, signal_type, reading_timestamp, reading_value,
  coalesce(count(reading_value) over f = 3 and max(reading_value) over f - min(reading_value) over f <= 10, false) as is_flat
  from readings window f as (partition by sensor_id order by reading_timestamp, reading_id
                             rows between 2 preceding and current row)"""
Q["suppress_offline"] = f"""select reading_id, r.machine_id,
  exists (select 1 from (select machine_id, event_type, event_timestamp as down_from,
            lead(event_timestamp) over (partition by machine_id order by event_timestamp, event_id) as down_to
          from machine_events where event_type in {inside(rules.STATE_EVENTS)}) d
     where d.event_type = 'SHUTDOWN' and d.machine_id = r.machine_id and reading_timestamp >= down_from
       and (down_to is null or reading_timestamp < down_to))
  or coalesce(operating_state in {inside(rules.SUPPRESSED_STATES)}, false) as suppressed
  from readings r left join machines using (machine_id)"""
Q["suppress_offline_sliced"] = Q["suppress_offline"]
Q["load_pct"] = "select machine_id, avg_rpm, load_pct, avg_current, current_pct from operating"
Q["suppress_signals"] = "select machine_id, current_state, suppress_signals from operating"
Q["maintenance_totals"] = """select machine_id, failure_count,
  cast(total_maint_cost as double) as total_maint_cost from repair_totals"""
Q["maintenance_totals_failures"] = """select machine_id, count(*) as failure_count,
  cast(sum(cost) as double) as total_maint_cost from history where failure_mode <> 'NONE' group by 1"""
Q["latest_production_ordinal"] = last_output(place("shift", rules.SHIFT_ORDER, 0)).strip()
Q["maintenance_context"] = """select * replace (cast(total_maint_cost as double) as total_maint_cost)
  from background"""
Q["repair_effect"] = f"""select maintenance_id, h.machine_id, signal_type,
  {r('avg(avg_value) filter (hour_bucket < mended)', 4)} as before_avg,
  {r('avg(avg_value) filter (hour_bucket >= mended)', 4)} as after_avg,
  {r('avg(avg_value) filter (hour_bucket >= mended) - avg(avg_value) filter (hour_bucket < mended)', 4)} as change
  from (select maintenance_id, machine_id, completed_at + to_days(cast(date_diff('day',
          cast(date_trunc('month', completed_at) as date), date '2024-01-01') as integer)) as mended
        from history where completed_at is not null) h
  join features f on f.machine_id = h.machine_id and hour_bucket >= mended - interval 72 hours
    and hour_bucket < mended + interval 72 hours
  group by 1, 2, 3 having count(avg_value) > 0"""
Q["rolling_features_time"] = rolling(
    lambda n: f"range between interval {n - 1} hours preceding and current row",
    f"max(avg_value) over (w range between interval {rules.SHORT_FRAME} hours preceding and interval {rules.SHORT_FRAME} hours preceding)",
    "hour_bucket",
).strip()
_pairs = ", ".join(
    f"{r(f"nullif(corr(vibration, {s.lower()}), 'nan'::double)", 6)} as corr_{s.lower()}, "
    f"count(*) filter (vibration is not null and {s.lower()} is not null) as hours_{s.lower()}"
    for s in rules.SIGNALS[1:]
)
_wide = ", ".join(
    f"max(avg_value) filter (signal_type = '{s}') as {s.lower()}" for s in rules.SIGNALS
)
Q["signal_correlation"] = f"""select machine_id, {_pairs}
  from (select machine_id, hour_bucket, {_wide} from hourly group by 1, 2) group by 1"""
_both = " union all ".join(
    f"select machine_id, '{a}' as signal_a, '{b}' as signal_b, "
    f"{r(f"nullif(corr({a.lower()}, {b.lower()}), 'nan'::double)", 6)} as correlation, "
    f"count(*) filter ({a.lower()} is not null and {b.lower()} is not null) as hours from wide group by 1"
    for i, a in enumerate(rules.SIGNALS) for b in rules.SIGNALS[i + 1:]
)
S["wide"] = f"select machine_id, hour_bucket, {_wide} from hourly group by 1, 2"
Q["signal_correlations"] = _both
Q["anomaly_score"] = "select machine_id, signal_type, hour_bucket, anomaly_score from scored"
Q["anomaly_groups"] = """select machine_id, group_no, min(detection_timestamp) as group_start,
  max(detection_timestamp) as group_end, count(*) as anomaly_count, max(anomaly_score) as max_score,
  string_agg(distinct affected_signal, ', ' order by affected_signal) as affected_signals
  from (select *, cast(sum(fresh) over (partition by machine_id order by detection_timestamp) as bigint) as group_no
        from (select *, case when lag(detection_timestamp) over o >= detection_timestamp - interval 1 hour
                        then 0 else 1 end as fresh
              from anomalies window o as (partition by machine_id order by detection_timestamp, affected_signal)))
  group by 1, 2"""
Q["failure_mode"] = "select machine_id, signal_type, predicted_failure_mode from judged"
Q["risk_horizon"] = "select machine_id, signal_type, risk_horizon, estimated_days_to_threshold from judged"
Q["forecast_confidence"] = "select machine_id, signal_type, confidence_level from judged"
Q["machine_evidence_ordinal"] = evidence(
    f"arg_min(risk_horizon, {place('risk_horizon', rules.HORIZON_ORDER, 9)}) filter ({PREDICTED})",
    f"arg_min(confidence_level, {place('confidence_level', rules.CONFIDENCE_ORDER, 9)})",
).strip()
Q["evidence_object"] = """select machine_id, vib_current as vibration_value, vib_slope as vibration_trend_per_day,
  temp_current as temperature_value, temp_slope as temperature_trend_per_day,
  curr_current as current_value, curr_slope as current_trend_per_day,
  press_current as pressure_value, press_slope as pressure_trend_per_day,
  last_failure_mode, last_root_cause, days_since_last_maint as days_since_last,
  failure_count as total_failures, latest_obs_type as observation_type,
  latest_obs_detail as observation_detail, latest_obs_severity as observation_severity,
  latest_prod_status as production_status, latest_reject_rate as reject_rate_pct from evidence"""
Q["evidence_narrative"] = "select machine_id, evidence_narrative from assessed"
Q["recommendation"] = "select machine_id, recommendation from assessed"
Q["assessment_state"] = "select machine_id, assessment_state from assessed"
Q["priority_score"] = """select machine_id, health_points, criticality_points, production_points,
  urgency_points, confidence_points, priority_score from prioritised"""
Q["triage_update"] = """select incident_id, machine_id, status, updated_at from triaged"""
Q["cycle_summary"] = """select new_incidents, notifications, 'Maintenance cycle complete. Incidents: '
    || cast(new_incidents as varchar) || ' new. Notifications: ' || cast(notifications as varchar) as message
  from (select (select count(*) from incidents where status = 'NEW') as new_incidents,
          (select count(*) from notices) as notifications)"""
Q["incident_sla"] = """select incident_id, machine_id, severity, status, incident_age_hours as age_hours,
  cast(case severity when 'CRITICAL' then 24 when 'HIGH' then 160 when 'MEDIUM' then 168 end as integer) as allowed_hours,
  coalesce(incident_age_hours > case severity when 'CRITICAL' then 24 when 'HIGH' then 160 else 168 end, false) as overdue
  from incidents"""
Q["carry_over"] = """select incident_id, machine_id, suspected_failure_mode,
  if(status = 'FALSE_POSITIVE', 'NEW', status) as status, created_at from triaged"""
Q["draft_rejections"] = """select incident_id, 'DUPLICATE: Active WO exists for ' || machine_id || ' - '
    || suspected_failure_mode as reason
  from asked where incident_id not in (select incident_id from accepted)
  union all select distinct incident_id, 'ERROR: Unknown incident ' || incident_id from work_orders
  where incident_id not in (select incident_id from incidents)"""
Q["draft_results"] = f"""select incident_id, 'SUCCESS: Work order ' || work_order_id || ' drafted for incident '
    || incident_id as result from drafts
  union all select incident_id, reason as result from ({Q["draft_rejections"]})"""
Q["active_order_duplicates"] = """select incident_id, machine_id, suspected_failure_mode from incidents i
  where exists (select 1 from work_orders w where w.machine_id = i.machine_id
    and w.predicted_failure_mode = i.suspected_failure_mode and w.status in ('DRAFT', 'APPROVED', 'ASSIGNED'))"""
Q["allocate_order_ids"] = f"""select incident_id, {order_id('(row_number() over (order by priority_score desc, incident_id) + (select max(order_no) from work_orders))')}
  as work_order_id from incidents"""
Q["action_template"] = f"""select incident_id, {template(1, True)} as recommended_actions,
  {template(2, False)} as estimated_repair_hrs, {template(3, False)} as estimated_downtime_hrs from incidents"""
Q["maintenance_window"] = f"select incident_id, {_window} as recommended_window from incidents"
_state = "if(decision = 'APPROVE', 'APPROVED', 'REJECTED')"
Q["apply_approvals"] = f"""select w.work_order_id, w.incident_id, machine_id,
  if(decision is null, status, {_state}) as status, decider as approved_by,
  if(decision = 'APPROVE', {NOW}, null) as approved_at,
  if(decision is null, created_at, {NOW}) as updated_at
  from work_orders w left join decided d using (work_order_id)"""
Q["approval_results"] = f"""select command_seq, work_order_id,
  case when standing is null then 'ERROR: Unknown work order ' || work_order_id
    when standing <> 'DRAFT' then 'ERROR: Work order ' || work_order_id
      || ' is not in DRAFT status (current: ' || standing || ')'
    when action = 'APPROVE' then 'APPROVED: Work order ' || work_order_id || ' approved by ' || approver
    when action = 'REJECT' then 'REJECTED: Work order ' || work_order_id || ' rejected by ' || approver
    else 'ERROR: Action must be APPROVE or REJECT' end as result
  from (select c.*, if(d.decision is not null and command_seq > decided_at, {_state}, status) as standing
        from approval_commands c left join work_orders w using (work_order_id)
        left join decided d using (work_order_id))"""
Q["approval_incidents"] = f"""select i.incident_id, machine_id,
  coalesce(changed, status) as status, {NOW} as updated_at
  from incidents i left join (select incident_id,
      arg_max(if(decision = 'APPROVE', 'ASSIGNED', 'NEW'), decided_at) as changed from decided group by 1)
    using (incident_id)"""
Q["apply_resolutions"] = f"""select w.work_order_id, w.incident_id, machine_id,
  if(root_cause is null, status, 'RESOLVED') as status, root_cause as actual_root_cause,
  parts as actual_parts_replaced, hours as actual_repair_hrs, findings as technician_findings,
  if(root_cause is null, null, {NOW}) as resolved_at, if(root_cause is null, created_at, {NOW}) as updated_at
  from work_orders w left join last_reports using (work_order_id)"""
Q["resolution_results"] = """select command_seq, c.work_order_id,
  if(w.status is null, 'ERROR: Unknown work order ' || c.work_order_id,
     'RESOLVED: Work order ' || c.work_order_id || ' completed. Root cause: ' || root_cause) as result
  from resolution_commands c left join work_orders w using (work_order_id)"""
Q["performance_baseline"] = f"""select machine_id, shift, production_date, actual_units, good_units,
  rejected_units, cycle_time_sec, ideal_cycle_time_sec, actual_runtime_hrs, downtime_hrs,
  production_status, before as prev_day_units,
  if(before > 0, {r('(actual_units - before) / nullif(before, 0)::double * 100', 2)}, null) as shift_over_shift_pct,
  {r('usual', 1)} as rolling_7d_avg_units, {r('rejects', 2)} as rolling_7d_reject_rate,
  if(usual > 0, {r('(actual_units - usual) / nullif(usual, 0) * 100', 2)}, null) as perf_degradation_vs_7d
  from (select *, lag(actual_units) over w as before, avg(actual_units) over s as usual,
          avg(coalesce({_reject}, 0)) over s as rejects
        from production
        window w as (partition by machine_id, shift order by production_date),
          s as (partition by machine_id, shift order by production_date rows between 6 preceding and current row))"""
Q["production_impact"] = f"""select i.incident_id, i.machine_id, machine_name, severity, priority_score,
  suspected_failure_mode, rul_days, current_oee, current_availability, current_quality, oee_7d_avg,
  {r('current_oee - oee_7d_avg', 2)} as oee_trend,
  {r('daily_good_units * coalesce(rul_days, 7)', 0)} as units_at_risk_if_failure,
  {r('estimated_downtime_hrs * units_per_hour', 0)} as units_lost_during_repair,
  estimated_downtime_hrs as downtime_hrs_at_risk, current_reject_rate, reject_rate_trend
  from incidents i left join effectiveness using (machine_id)
  left join (select incident_id, estimated_downtime_hrs from work_orders where status <> 'REJECTED')
    using (incident_id)"""
Q["line_rollup"] = f"""select line, machine_id, {r('avg(oee_pct)', 2)} as avg_oee,
  {r('sum(downtime_hrs)', 2)} as downtime_hrs, cast(sum(rejected_units) as bigint) as rejected_units,
  {r('sum(downtime_hrs) * 250.0', 2)} as downtime_cost, {r('sum(rejected_units) * 12.5', 2)} as reject_cost
  from oee group by rollup (line, machine_id)"""
Q["command_center"] = """select i.incident_id, machine_id, i.machine_name, i.machine_type, i.criticality,
  m.line, station, location, suspected_failure_mode, all_predicted_modes,
  severity as incident_severity, priority_score, i.status as incident_status, incident_start,
  latest_activity, incident_age_hours, related_anomaly_count, affected_signals, i.health_score,
  i.health_status, risk_horizon, rul_days, confidence_level, evidence_narrative, production_impact,
  reject_rate_pct, i.parts_available, i.min_lead_time_days, last_failure_mode, last_root_cause,
  days_since_last_maint, failure_count, cast(total_maint_cost as double) as total_maint_cost,
  latest_obs_type, latest_obs_detail, latest_obs_severity, w.work_order_id,
  w.status as work_order_status, problem_description as wo_problem, recommended_actions as wo_actions,
  estimated_repair_hrs, assigned_technician, i.created_at as incident_created_at
  from incidents i join machines m using (machine_id) left join background using (machine_id)
  left join (select * from work_orders where status in ('DRAFT', 'APPROVED', 'ASSIGNED')) w using (machine_id)"""
Q["fleet_overlay"] = """select machine_id, f.machine_name, f.machine_type, f.line, f.criticality, current_state,
  f.health_score, f.health_status, concern_rank, worst_signal_score, worst_signal_type, computed_at,
  incident_id, severity as incident_severity, priority_score, rul_days, suspected_failure_mode
  from fleet f left join incidents using (machine_id)"""
Q["oee_daily_trend"] = f"""select *, {r('coalesce(oee - lag(oee) over (order by production_date), 0)', 1)} as oee_delta
  from (select production_date, {means(1)} from recent_oee group by 1)"""
Q["oee_by_machine"] = f"select machine_id, machine_name, {means(1)} from recent_oee group by 1, 2"
Q["station_summary"] = f"""select count(*) as total_machines,
  count(*) filter (current_state = 'RUNNING') as running,
  count(*) filter (health_status <> 'HEALTHY') as machines_at_risk,
  (select count(*) from incidents where severity = 'CRITICAL') as critical_incidents,
  (select count(*) from incidents where severity = 'HIGH') as high_incidents,
  (select {r('avg(quality_pct)', 1)} from recent_oee where age = 0) as avg_quality from fleet"""
Q["incident_triage"] = """select i.*, work_order_id, w.status as wo_status
  from incidents i left join work_orders w on w.incident_id = i.incident_id"""
Q["clean_readings_stored"] = "select * from clean"
Q["machine_detail_one"] = "select * from fleet where machine_id = 'M007'"
Q["incident_triage_filtered"] = f"""select * from ({Q["incident_triage"]}) where severity in ('CRITICAL', 'HIGH') and status = 'NEW'
  order by priority_score desc, incident_id, work_order_id nulls last limit 10"""
Q["sensor_trend"] = "select machine_id, signal_type, hour_bucket, avg_value, rolling_24h_avg from features"
Q["active_forecasts"] = f"""select machine_id, signal_type, predicted_failure_mode, risk_horizon,
  estimated_days_to_threshold, confidence_level, trend_slope_7d from forecasts where {PREDICTED}"""
Q["recent_deviation"] = f"""select machine_id, signal_type, count(*) as hours, max(hour_bucket) as latest_hour,
  arg_max_null(avg_value, hour_bucket) as latest_avg,
  coalesce(arg_max_null(baseline_deviation_7d, hour_bucket), 0) as latest_deviation,
  arg_max_null(rate_of_change_6h, hour_bucket) as latest_rate_of_change
  from features where {since('hour_bucket', '7 days')} group by 1, 2"""
Q["similar_cases"] = """select * from (select i.incident_id, h.maintenance_id, h.machine_id, failure_mode, root_cause,
    action_taken, parts_replaced, completed_at, row_number() over (partition by i.incident_id
      order by completed_at desc nulls first, maintenance_id desc) as case_rank
  from incidents i join history h on h.machine_id = i.machine_id or h.failure_mode = i.suspected_failure_mode)
  where case_rank <= 10"""
S["cases"] = """
select maintenance_id, completed_at, list_sort(list_distinct(regexp_extract_all(
    lower(concat_ws(' ', failure_mode, root_cause, action_taken, parts_replaced)), '[a-z0-9]+'))) as words from history"""
S["kinds"] = "select words, row_number() over () as kind, count(*) as members from cases group by words"
S["kind_newest"] = """
select kind, maintenance_id, completed_at from cases join kinds using (words)
qualify row_number() over (partition by kind order by completed_at desc nulls first, maintenance_id desc) <= 11"""
S["alike"] = """
select a.kind as asking, b.kind as other, len(list_intersect(a.words, b.words)) as common,
  len(a.words) + len(b.words) - len(list_intersect(a.words, b.words)) as united
from kinds a, kinds b where len(list_intersect(a.words, b.words)) * 10
  >= (len(a.words) + len(b.words) - len(list_intersect(a.words, b.words))) * 7"""
S["best_cases"] = """
select asking, maintenance_id as similar_id, completed_at, common / united as similarity
from alike join kind_newest on kind = other
qualify row_number() over (partition by asking order by common / united desc, completed_at desc nulls first, similar_id desc) <= 11"""
Q["similar_repairs"] = """select maintenance_id, row_number() over (partition by maintenance_id
      order by similarity desc, b.completed_at desc nulls first, similar_id desc) as case_rank, similar_id, similarity
  from cases join kinds using (words) join best_cases b on asking = kind and similar_id <> maintenance_id
  qualify case_rank <= 10"""
Q["grounding_context"] = """select i.incident_id, i.machine_id, 'Machine: ' || i.machine_id || ' (' || machine_name
    || '). Predicted failure: ' || suspected_failure_mode || '. Evidence: ' || evidence_narrative
    || ' Maintenance history: ' || coalesce(past, 'No prior maintenance records.') || '.' as context
  from incidents i left join (select machine_id, string_agg(failure_mode || ' | ' || root_cause || ' | '
        || action_taken || ' | ' || coalesce(strftime(completed_at, '%Y-%m-%d'), 'open'), '; ' order by n) as past
      from (select *, row_number() over (partition by machine_id
              order by completed_at desc nulls first, maintenance_id desc) as n from history)
      where n <= 3 group by 1) using (machine_id)"""
Q["maintenance_log"] = """select maintenance_id, machine_id, machine_name, machine_type, line, failure_mode,
  root_cause, action_taken, parts_replaced, repair_duration_hrs, downtime_hrs,
  cast(cost as double) as cost, maintenance_type, completed_at
  from history join machines using (machine_id)"""
Q["maintenance_log_newest"] = f"""{Q["maintenance_log"]}
  order by completed_at desc nulls first, maintenance_id desc limit 50"""
Q["work_order_queue"] = f"""select work_order_id, w.incident_id, w.machine_id, w.status, priority,
  problem_description, predicted_failure_mode, recommended_actions, evidence_narrative,
  health_score as incident_health_score, {place('w.status', rules.ORDER_STAGES, 5)} as stage_rank
  from work_orders w left join incidents i on i.incident_id = w.incident_id"""
Q["oee_overall"] = "select " + ", ".join(
    f"{r(f'avg(avg_{m})', 1)} as avg_{m}" for m in ("availability", "performance", "quality", "oee")
) + " from oee_per_machine"
Q["oee_daily"] = f"select production_date, {r('avg(oee_pct)', 2)} as daily_oee from oee group by 1"
Q["failure_mode_distribution"] = """select failure_mode, count(*) as repairs from history
  where failure_mode <> 'NONE' group by 1"""
Q["maintenance_cost"] = """select machine_name, cast(sum(cost) as double) as total_cost
  from history join machines using (machine_id) group by 1"""
Q["repeat_failures"] = f"""select machine_id, machine_name, failure_mode, count(*) as repairs,
  cast(sum(cost) as double) as total_cost, {r('sum(downtime_hrs)', 2)} as total_downtime
  from history join machines using (machine_id) group by 1, 2, 3 having count(*) > 1"""
Q["sensor_freshness"] = f"""select machine_id, signal_type, max(reading_timestamp) as latest_reading,
  {r("count(*) filter (quality_flag <> 'GOOD') / count(*)::double * 100", 2)} as bad_quality_pct,
  date_diff('minute', max(reading_timestamp), {NOW}) as minutes_since_last
  from clean where {since('reading_timestamp', '1 day')} group by 1, 2"""
Q["pipeline_status"] = f"""select 'STAGING' as layer, dataset, 'SUCCEEDED' as last_refresh_state,
  {NOW} + interval 15 minutes as last_refresh, latest_data, 3600::bigint as target_lag_sec, 4::bigint as refreshes,
  date_diff('minute', latest_data, {NOW}) as minutes_behind,
  date_diff('minute', latest_data, {NOW}) * 60 <= 3600 as within_target
  from (select 'clean' as dataset, max(reading_timestamp) as latest_data from readings
        union all select 'hourly', max(hour_bucket) from hourly)"""
Q["model_versions"] = """select model_version as version, 'FAILURE_FORECAST' as model_type,
  count(*) as predictions from forecasts group by 1
  union all select model_id, 'ANOMALY_DETECTION', count(*) from anomalies group by 1"""
Q["confidence_distribution"] = "select confidence_level, count(*) as forecasts from forecasts group by 1"
Q["fallback_cases"] = """select machine_id, machine_name, assessment_state, confidence_level, recommendation
  from assessments where assessment_state <> 'AUTOMATED_ASSESSMENT'
    or confidence_level in ('LOW', 'INSUFFICIENT_DATA')"""
Q["trend_early_late"] = f"""select *, coalesce(late_avg - early_avg >= 0, false) as passed
  from (select machine_id, signal_type,
          {r("avg(reading_value) filter (reading_timestamp < timestamp '2024-01-11')", 2)} as early_avg,
          {r("avg(reading_value) filter (reading_timestamp > timestamp '2024-01-21')", 2)} as late_avg
        from readings group by 1, 2)"""
Q["quality_counts"] = """select machine_id, signal_type, quality_flag, count(*) as readings,
  quality_flag <> 'STALE' or count(*) >= 2 as passed from clean group by 1, 2, 3"""
Q["assessment_lookup"] = """select machine_id, primary_failure_mode, confidence_level, recommendation,
  evidence_narrative, assessment_state from assessments"""
Q["row_counts"] = "select tbl, rows_ct, rows_ct >= 1 as passed from (" + " union all ".join(
    f"select '{tbl}' as tbl, count(*) as rows_ct from {step}" for tbl, step in {
        "machines": "machines", "sensors": "sensors", "sensor_readings": "readings",
        "machine_event_logs": "machine_events", "maintenance_history": "history",
        "parts_inventory": "parts", "production_quality": "production", "shift_logs": "shift_logs",
        "work_orders": "work_orders", "sensor_readings_clean": "clean",
        "machine_health_features": "features", "cross_machine_health": "fleet",
        "detected_anomalies": "anomalies", "failure_forecasts": "forecasts",
        "failure_assessments": "assessments", "incidents": "incidents",
        "maintenance_context": "background",
    }.items()
) + ")"
Q["priority_list"] = """select incident_id, machine_id, severity, priority_score, health_score, criticality,
  production_impact, rul_days, confidence_level from incidents"""
Q["priority_check"] = """select incident_id, priority_score,
  priority_score between 0 and 100 and criticality is not null as passed from incidents"""
Q["oee_check"] = f"""select *, coalesce(avg_oee > 0, false) as passed
  from (select machine_id, machine_name, {r('avg(oee_pct)', 1)} as avg_oee,
          {r('avg(availability_pct)', 1)} as avg_avail, {r('avg(quality_pct)', 1)} as avg_quality
        from recent_oee group by 1, 2)"""


def catalogue(entry):
    return "(" + ", ".join("null::double" if v is None else f"'{v}'" if isinstance(v, str) else f"{v}::double"
                           for v in entry) + ")"


_catalogue = ", ".join(catalogue(e) for e in (*rules.CORE_SIGNALS, rules.PRESSURE_SIGNAL, rules.ACOUSTIC_SIGNAL))
Q["sensor_registry"] = f"""select machine_id || '-' || signal_type as sensor_id, machine_id, signal_type, unit,
  min_threshold, max_threshold, warning_threshold, critical_threshold,
  60::bigint as sampling_interval_sec, true as is_active
  from supplier_machines, (values {_catalogue})
    v(signal_type, unit, min_threshold, max_threshold, warning_threshold, critical_threshold)
  where case signal_type when 'PRESSURE' then machine_type = 'LARGE' when 'ACOUSTIC' then criticality = 'HIGH'
    when 'RPM' then machine_type not in ('PROMO', 'SMALL') else true end"""
Q["densify"] = f"""select s.sensor_id, s.machine_id, s.signal_type, slot,
  count(reading_id) as readings, {r('avg(reading_value)', 4)} as slot_avg,
  count(reading_id) = 0 as is_missing
  from (select *, unnest(generate_series(timestamp '2024-01-01', timestamp '2024-01-30 18:00:00', interval 6 hours)) as slot
        from sensors) s
  left join readings x on x.sensor_id = s.sensor_id and reading_timestamp >= slot
    and reading_timestamp < slot + interval 6 hours
  group by 1, 2, 3, 4"""
Q["densify_uneven"] = f"""select s.sensor_id, s.machine_id, s.signal_type, slot,
  count(reading_id) as readings, {r('avg(reading_value)', 4)} as slot_avg,
  count(reading_id) = 0 as is_missing
  from (select *, unnest(generate_series(timestamp '2024-01-01', timestamp '2024-01-30 23:59:59', interval 7 hours)) as slot
        from sensors) s
  left join readings x on x.sensor_id = s.sensor_id and reading_timestamp >= slot
    and reading_timestamp < least(slot + interval 7 hours, timestamp '2024-01-31')
  group by 1, 2, 3, 4"""
Q["classify_shift"] = """select reading_id,
  case when h between 6 and 14 then 'DAY' when h between 15 and 22 then 'SWING' else 'NIGHT' end as shift,
  case when h between 6 and 14 then 1.1::double when h between 15 and 22 then 1.0::double else 0.7::double end as shift_load
  from (select reading_id, hour(reading_timestamp) as h from readings)"""
Q["production_calendar"] = """select machine_id, shift, cast(d as date) as production_date
  from supplier_machines, (values ('DAY'), ('SWING'), ('NIGHT')) v(shift),
    generate_series(timestamp '2024-01-01', timestamp '2024-01-30', interval 1 day) g(d)
  where machine_type not in ('PROMO', 'ECONOMY')"""
Q["derive_quality"] = f"""select machine_id, shift, production_date, actual_units, rejected_units,
  actual_units - rejected_units as good_units,
  {r('rejected_units / nullif(actual_units, 0)::double', 4)} as quality_deviation from counts"""


def keys(table, key, step, parent=None):
    lost = "0::bigint"
    if parent:
        column, other = parent
        lost = f"(select count(*) from {step} where {column} not in (select {column} from {other}))"
    return f"""select '{table}' as table_name, count(*) as row_count,
      (select count(*) from (select 1 from {step} group by {key} having count(*) > 1)) as duplicate_keys,
      {lost} as orphan_rows from {step}"""


Q["key_checks"] = "select *, duplicate_keys = 0 and orphan_rows = 0 as passed from (" + " union all ".join([
    keys("machines", "machine_id", "machines"),
    keys("sensors", "sensor_id", "sensors", ("machine_id", "machines")),
    keys("maintenance_history", "maintenance_id", "history"),
    keys("parts_inventory", "part_id", "parts"),
    keys("work_orders", "work_order_id", "work_orders", ("machine_id", "machines")),
    keys("sensor_readings", "machine_id, signal_type, reading_timestamp", "readings", ("sensor_id", "sensors")),
]) + ")"


# --- streams: only windows the watermark has passed are final ----------------

Q["stream_clean"] = "select * exclude (is_stale, is_spike) from clean"
Q["stream_refreshed_clean"] = "select * from clean"
Q["stream_refreshed_fleet"] = "select * from fleet"
Q["stream_notifications"] = "select * from notices"
Q["stream_hourly_stats"] = """select * exclude (spike_count) from hourly
  where hour_bucket + interval 1 hour <= (select max(reading_timestamp) from readings) - interval 2 hours"""
Q["stream_sliding_mean"] = f"""select machine_id, signal_type, s as window_start,
  s + interval 6 hours as window_end, {r('avg(normalized_value)', 4)} as mean_value, count(*) as reading_count
  from (select *, unnest([date_trunc('hour', reading_timestamp) - to_hours(i) for i in range(6)]) as s from clean)
  where s + interval 6 hours <= (select max(reading_timestamp) from readings) - interval 2 hours
  group by 1, 2, 3"""
Q["stream_breach_sessions"] = """select machine_id, min(reading_timestamp) as session_start,
  max(reading_timestamp) + interval 6 hours as session_end, count(*) as breaches,
  count(*) filter (threshold_status = 'CRITICAL') as critical_breaches
  from (select *, sum(fresh) over (partition by machine_id order by reading_timestamp) as run
        from (select *, case when lag(reading_timestamp) over (partition by machine_id order by reading_timestamp)
                > reading_timestamp - interval 6 hours then 0 else 1 end as fresh
              from clean where threshold_status <> 'NORMAL'))
  group by machine_id, run
  having max(reading_timestamp) + interval 6 hours
    <= (select max(reading_timestamp) from clean where threshold_status <> 'NORMAL') - interval 2 hours"""
Q["stream_decisions"] = Q["approval_results"]
Q["stream_orders"] = Q["apply_approvals"]


Q["stream_refreshed_hourly"] = "select * from hourly"
_wave = "cast(substr(reference_id, 5) as integer) % 3"
Q["stream_cycle"] = f"""select *, {NOW} + to_minutes(5 * ({_wave})) as sent_at, 'SENT' as status from notices"""
Q["stream_cycle_log"] = f"""select 'cycle-' || lpad(cast(w as varchar), 8, '0') as cycle_id,
  {NOW} + to_minutes(cast(5 * w as integer)) as as_of, new_incidents, notifications,
  'Maintenance cycle complete. Incidents: ' || cast(new_incidents as varchar) || ' new. Notifications: '
    || cast(notifications as varchar) as message
  from (select w, (select count(*) from incidents where cast(substr(incident_id, 5) as integer) % 3 <= w) as new_incidents,
          (select count(*) from notices where {_wave} = w) as notifications from range(3) t(w))"""

# --- the life of incidents: one step for each command, in order ---------------

S["life_commands"] = f"""
select o_orderkey as command_seq, {incident_id('((o_orderkey // 3) % 40 + 1)')} as incident_id,
  {pick(('ACKNOWLEDGE', 'ASSIGN', 'SNOOZE', 'REQUEST_ORDER', 'ESCALATE', 'RESOLVE', 'FALSE_POSITIVE', 'REOPEN', 'DANCE'), '(o_orderkey * 7 + o_custkey) % 9')} as action,
  timestamp '2024-01-23 00:00:00' + to_seconds((o_orderkey * 37) % 691200) as given_at,
  'TECH-' || cast(o_custkey % 6 as varchar) as owner, 'Reason ' || cast(o_orderkey % 8 as varchar) as reason,
  (o_orderkey % 5) * 24 as snooze_hours
from orders"""
_moves = ", ".join(
    f"('{action}', '{before}', '{after}')" for action, steps_ in rules.INCIDENT_MOVES.items() for before, after in steps_.items()
)
S["moves"] = f"select * from (values {_moves}) m(action, state_before, state_after)"
S["queue"] = """
select c.*, row_number() over (partition by incident_id order by command_seq) as turn
from life_commands c where incident_id in (select incident_id from incidents)"""
S["life_steps"] = """
with recursive walk as (
  select incident_id, 0::bigint as turn, null::varchar as was, status as state, null::boolean as accepted from incidents
  union all
  select w.incident_id, w.turn + 1, w.state, coalesce(m.state_after, w.state), m.state_after is not null
  from walk w join queue q on q.incident_id = w.incident_id and q.turn = w.turn + 1
  left join moves m on m.action = q.action and m.state_before = w.state)
select * from walk"""
S["lived"] = "select q.*, was, state, accepted from life_steps join queue q using (incident_id, turn)"
Q["lifecycle_results"] = """select c.command_seq, c.incident_id, c.action, coalesce(accepted, false) as accepted,
  case when l.incident_id is null then 'ERROR: Unknown incident ' || c.incident_id
    when c.action not in (select action from moves) then 'ERROR: Unknown action ' || c.action
    when not accepted then 'ERROR: ' || c.action || ' not allowed for ' || c.incident_id || ' in ' || was
    else 'OK: ' || c.incident_id || ' ' || was || ' -> ' || state end as result
  from life_commands c left join lived l using (command_seq)"""


def latest_given(action, value):
    return f"arg_max({value}, command_seq) filter (action = '{action}')"


Q["incident_lifecycle"] = f"""select incident_id, machine_id, severity, state as status, owner, acknowledged_at,
  if(snoozed, snooze_reason, null) as snooze_reason, if(snoozed, until, null) as snoozed_until,
  case when state in {inside(rules.CLOSED_INCIDENT_STATES)} then null when escalated then 'ESCALATED'
    when not snoozed and date_diff('second', incident_start, {NOW}) > 3600 *
      case severity when 'CRITICAL' then 24 when 'HIGH' then 160 when 'MEDIUM' then 168 end then 'OVERDUE' end as escalation_status,
  if(state = 'RESOLVED', resolved, null) as resolution_reason,
  if(state = 'FALSE_POSITIVE', dismissed, null) as false_positive_reason, updated_at
  from (select i.incident_id, machine_id, severity, incident_start, f.state, g.owner, g.acknowledged_at, g.snooze_reason,
          until, coalesce(escalated, false) as escalated, resolved, dismissed, coalesce(changed, i.updated_at) as updated_at,
          coalesce(f.state not in {inside(rules.CLOSED_INCIDENT_STATES)} and until > {NOW}, false) as snoozed
        from incidents i join (select incident_id, arg_max(state, turn) as state from life_steps group by 1) f using (incident_id)
        left join (select incident_id, max(given_at) as changed, {latest_given('ACKNOWLEDGE', 'given_at')} as acknowledged_at,
            {latest_given('ASSIGN', 'owner')} as owner, {latest_given('SNOOZE', 'reason')} as snooze_reason,
            {latest_given('SNOOZE', 'given_at + to_hours(snooze_hours)')} as until,
            bool_or(action = 'ESCALATE') as escalated, {latest_given('RESOLVE', 'reason')} as resolved,
            {latest_given('FALSE_POSITIVE', 'reason')} as dismissed
          from lived where accepted group by 1) g using (incident_id))"""


def assemble(body: str) -> str:
    """Put the steps a query mentions, directly or through others, in front of it."""
    needed: dict[str, str] = {}
    started: set[str] = set()

    def visit(sql: str) -> None:
        for name, step in S.items():
            if name not in started and re.search(rf"\b{name}\b", sql):
                started.add(name)
                visit(step)
                needed[name] = f"{name} as ({step.strip()})"

    visit(body)
    return f"with {', '.join(needed.values())}\n{body}" if needed else body


def oracle_sql() -> dict[str, str]:
    out = {name: assemble(body) for name, body in Q.items()}
    out["fallback_cases"] = out["fallback_cases"].replace(NOW, LATER)
    return out
