"""Declared schemas of the stored tables. Readers never infer one."""

from __future__ import annotations

from pyspark.sql import types as T

_TYPES = {
    "str": T.StringType(),
    "dbl": T.DoubleType(),
    "long": T.LongType(),
    "bool": T.BooleanType(),
    "date": T.DateType(),
    "ts": T.TimestampNTZType(),
    "money": T.DecimalType(12, 2),
    "price": T.DecimalType(10, 2),
}


def _table(fields: str) -> T.StructType:
    """``name:type`` pairs; a trailing ``!`` marks a required field."""
    out = []
    for field in fields.split():
        name, kind = field.split(":")
        out.append(T.StructField(name, _TYPES[kind.rstrip("!")], not kind.endswith("!")))
    return T.StructType(out)


MACHINES = _table("""
    machine_id:str! machine_name:str! machine_type:str! line:str! station:str location:str
    rated_rpm:dbl rated_current:dbl rated_pressure:dbl criticality:str! install_date:date
    last_overhaul_date:date operating_state:str manufacturer:str model_number:str
    created_at:ts updated_at:ts""")

SENSORS = _table("""
    sensor_id:str! machine_id:str! signal_type:str! unit:str! min_threshold:dbl
    max_threshold:dbl warning_threshold:dbl critical_threshold:dbl sampling_interval_sec:long
    install_date:date is_active:bool created_at:ts""")

SENSOR_READINGS = _table("""
    reading_id:long sensor_id:str! machine_id:str! signal_type:str! reading_value:dbl
    reading_timestamp:ts! quality_flag:str source_system:str ingested_at:ts""")

MACHINE_EVENT_LOGS = _table("""
    event_id:long machine_id:str! event_type:str! event_code:str event_description:str
    severity:str event_timestamp:ts! resolved_timestamp:ts operator_id:str ingested_at:ts""")

MAINTENANCE_HISTORY = _table("""
    maintenance_id:str! machine_id:str! failure_mode:str root_cause:str action_taken:str
    parts_replaced:str repair_duration_hrs:dbl downtime_hrs:dbl cost:money technician_id:str
    maintenance_type:str started_at:ts completed_at:ts notes:str created_at:ts""")

PARTS_INVENTORY = _table("""
    part_id:str! part_name:str! part_category:str compatible_machine_types:str
    compatible_components:str quantity_on_hand:long reorder_point:long lead_time_days:long
    unit_cost:price supplier:str last_restocked_at:ts created_at:ts""")

TOOLING_CHANGES = _table("""
    change_id:long machine_id:str! tool_name:str change_reason:str previous_tool_life_hrs:dbl
    new_tool_installed:bool production_context:str changed_at:ts! operator_id:str created_at:ts""")

PRODUCTION_QUALITY = _table("""
    production_id:long machine_id:str! shift:str! production_date:date! planned_units:long
    actual_units:long good_units:long rejected_units:long cycle_time_sec:dbl
    ideal_cycle_time_sec:dbl planned_runtime_hrs:dbl actual_runtime_hrs:dbl downtime_hrs:dbl
    quality_deviation:dbl production_status:str created_at:ts""")

SHIFT_LOGS = _table("""
    log_id:long machine_id:str! operator_id:str! shift:str! observation_type:str
    observation_detail:str severity:str observed_at:ts! created_at:ts""")

WORK_ORDERS = _table("""
    work_order_id:str! incident_id:str machine_id:str! status:str! priority:str
    problem_description:str evidence_summary:str predicted_failure_mode:str
    recommended_actions:str required_parts:str estimated_repair_hrs:dbl
    estimated_downtime_hrs:dbl recommended_window:str assigned_technician:str approved_by:str
    approved_at:ts rejection_reason:str actual_root_cause:str actual_parts_replaced:str
    actual_repair_hrs:dbl technician_findings:str created_at:ts updated_at:ts resolved_at:ts""")

NOTIFICATION_LOG = _table("""
    notification_id:long notification_type:str reference_id:str machine_id:str severity:str
    message:str sent_at:ts status:str""")

REFRESH_LOG = _table("""
    dataset:str! layer:str! state:str! batch_id:long input_rows:long latest_data:ts
    refreshed_at:ts! target_lag_sec:long""")

CYCLE_LOG = _table("""
    cycle_id:str! as_of:ts! new_incidents:long notifications:long message:str""")

TABLES = {
    "machines": MACHINES,
    "sensors": SENSORS,
    "sensor_readings": SENSOR_READINGS,
    "machine_event_logs": MACHINE_EVENT_LOGS,
    "maintenance_history": MAINTENANCE_HISTORY,
    "parts_inventory": PARTS_INVENTORY,
    "tooling_changes": TOOLING_CHANGES,
    "production_quality": PRODUCTION_QUALITY,
    "shift_logs": SHIFT_LOGS,
    "work_orders": WORK_ORDERS,
    "notification_log": NOTIFICATION_LOG,
    "refresh_log": REFRESH_LOG,
    "cycle_log": CYCLE_LOG,
}

# What a column holds when the writer leaves it out
DEFAULTS = {
    "machines": {"operating_state": "RUNNING"},
    "sensors": {"sampling_interval_sec": 60, "is_active": True},
    "sensor_readings": {"quality_flag": "GOOD", "source_system": "OT_GATEWAY"},
    "parts_inventory": {"quantity_on_hand": 0, "reorder_point": 5, "lead_time_days": 7},
    "tooling_changes": {"new_tool_installed": True},
    "production_quality": {"downtime_hrs": 0.0, "production_status": "NORMAL"},
    "work_orders": {"status": "DRAFT"},
    "notification_log": {"status": "SENT"},
}

# Key columns, and for each foreign key the table it points to
KEYS = {
    "machines": ["machine_id"],
    "sensors": ["sensor_id"],
    "maintenance_history": ["maintenance_id"],
    "parts_inventory": ["part_id"],
    "work_orders": ["work_order_id"],
}
FOREIGN_KEYS = {"sensors": ("machine_id", "machines")}

# Numbered by the writer when absent: a hash of the row's natural key
SURROGATES = {
    "sensor_readings": ("reading_id", ["sensor_id", "reading_timestamp", "reading_value"]),
    "machine_event_logs": ("event_id", ["machine_id", "event_type", "event_timestamp"]),
    "production_quality": ("production_id", ["machine_id", "shift", "production_date"]),
    "shift_logs": ("log_id", ["machine_id", "operator_id", "observed_at"]),
    "tooling_changes": ("change_id", ["machine_id", "tool_name", "changed_at"]),
    "notification_log": ("notification_id", ["notification_type", "reference_id", "severity"]),
}
