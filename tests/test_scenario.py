"""Six machines with known faults, from stored tables to incidents and orders."""

from datetime import date, datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from plantpulse.operators import checks, reports, work_orders
from plantpulse.plans.cycle import read_cycles, run_cycle, run_cycles
from plantpulse.plans.fleet import FleetPlan
from plantpulse.sources.schemas import TABLES
from plantpulse.sources.store import StoredTables, conform, replace_table, write_readings

START = datetime(2024, 1, 1)
HOURS = 720
NOW = START + timedelta(hours=HOURS)


def wave(h, size=0.3):
    return size * ((h * 7 % 11) - 5) / 5


def telemetry():
    """(machine, signal) -> value by hour."""
    def p(h):
        return h / HOURS

    return {
        ("BEARING", "VIBRATION"): lambda h: 3.5 + 9.5 * p(h) + wave(h),
        ("BEARING", "TEMPERATURE"): lambda h: 45 + 47 * p(h) + wave(h),
        ("ALIGN", "VIBRATION"): lambda h: 3 + max(0, p(h) - 0.5) * 4.5 + wave(h),
        ("SEAL", "PRESSURE"): lambda h: 200 - max(0, p(h) - 0.67) * 120 + wave(h, 1),
        ("FAULTY", "VIBRATION"): lambda h: 2.5 + wave(h),
        ("LOADED", "VIBRATION"): lambda h: 4 + wave(h),
        ("LOADED", "CURRENT"): lambda h: 56 + (h % 24 > 12) * 5,
        ("FURNACE", "TEMPERATURE"): lambda h: 850 + wave(h, 10),
    }


LIMITS = {"VIBRATION": (7.0, 12.0, "mm/s"), "TEMPERATURE": (75.0, 95.0, "C"), "PRESSURE": (220.0, 260.0, "bar"),
          "CURRENT": (None, None, "A")}


@pytest.fixture(scope="module")
def plan(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("plant"))

    def put(name, columns, rows):
        types = ", ".join(f"{c} {TABLES[name][c].dataType.simpleString()}" for c in columns)
        replace_table(conform(spark.createDataFrame(rows, types), name), f"{root}/{name}")

    names = sorted({m for m, _ in telemetry()})
    put("machines", ["machine_id", "machine_name", "machine_type", "line", "criticality"],
        [(m, f"Machine {m}", "MILL", "L1", "HIGH") for m in names])
    put("sensors", ["sensor_id", "machine_id", "signal_type", "unit", "warning_threshold", "critical_threshold"],
        [(f"{m}-{s}", m, s, LIMITS[s][2], *LIMITS[s][:2]) for m, s in telemetry()])
    readings = []
    for (m, s), value in telemetry().items():
        for h in range(HOURS):
            for q in range(4 if m == "FAULTY" else 1):
                flag = "STALE" if m == "FAULTY" and h / HOURS > 0.83 else "GOOD"
                readings.append((f"{m}-{s}", m, s, float(value(h)), START + timedelta(hours=h, minutes=15 * q), flag))
    frame = spark.createDataFrame(
        readings, "sensor_id string, machine_id string, signal_type string, reading_value double, "
                  "reading_timestamp timestamp_ntz, quality_flag string")
    write_readings(frame, f"{root}/sensor_readings")
    put("machine_event_logs", ["machine_id", "event_type", "event_code", "severity", "event_timestamp"],
        [("LOADED", "STATE_CHANGE", "SC-HIGHLOAD", "INFO", NOW - timedelta(hours=1))])
    put("maintenance_history", ["maintenance_id", "machine_id", "failure_mode", "cost", "completed_at"],
        [("M1", "BEARING", "BEARING_DEGRADATION", Decimal("10.00"), START - timedelta(days=30))])
    put("shift_logs", ["machine_id", "operator_id", "shift", "observation_type", "observation_detail", "severity", "observed_at"],
        [("BEARING", "O1", "DAY", "NOISE", "grinding", "HIGH", NOW - timedelta(days=1))])
    put("production_quality", ["machine_id", "shift", "production_date", "actual_units", "good_units", "rejected_units",
                               "ideal_cycle_time_sec", "planned_runtime_hrs", "actual_runtime_hrs", "production_status"],
        [(m, "DAY", date(2024, 1, 30), 100, 95, 5, 60.0, 8.0, 7.0, "DEGRADED" if m == "BEARING" else "NORMAL") for m in names])
    put("parts_inventory", ["part_id", "part_name", "compatible_machine_types", "quantity_on_hand"],
        [("P1", "bearing", "LATHE,MILL", 2)])
    put("work_orders", ["work_order_id", "machine_id"], [])
    return FleetPlan(StoredTables(spark, root), as_of=NOW, shared=True)


def test_conformed_tables_have_defaults_and_numbers(plan):
    assert {r.operating_state for r in plan.machines.collect()} == {"RUNNING"}
    assert {r.sampling_interval_sec for r in plan.sensors.collect()} == {60}
    numbers = [r.reading_id for r in plan.readings.select("reading_id").collect()]
    assert len(numbers) == len(set(numbers)) == 7 * HOURS + 4 * HOURS


def test_stale_sensor_count(plan):
    counts = checks.quality_counts(plan.clean, expected={"STALE": 401}).where("machine_id = 'FAULTY'")
    assert {r.quality_flag: (r.readings, r.passed) for r in counts.collect()} == {
        "STALE": (488, True), "GOOD": (2392, True),
    }


def test_hourly_rows(plan):
    assert plan.features.count() == 8 * HOURS


def test_failure_modes(plan):
    modes = {r.machine_id: (r.primary_failure_mode, r.recommendation) for r in plan.assessments.collect()}
    assert modes["BEARING"][0] == "BEARING_DEGRADATION"
    assert modes["ALIGN"] == ("MISALIGNMENT", "MONITOR_CLOSELY")
    assert modes["SEAL"] == ("HYDRAULIC_SEAL_FAILURE", "MONITOR_CLOSELY")
    for machine in ("LOADED", "FAULTY", "FURNACE"):
        assert modes[machine] == ("NONE_DETECTED", "ROUTINE_MONITORING")
    assert modes["BEARING"][1] in ("IMMEDIATE_ACTION_REQUIRED", "SCHEDULE_MAINTENANCE")


def test_health_and_state(plan):
    fleet = {r.machine_id: r for r in plan.fleet.collect()}
    assert fleet["LOADED"].current_state == "HIGH_LOAD" and fleet["LOADED"].health_score >= 80
    assert fleet["FURNACE"].worst_signal_type == "TEMPERATURE" and fleet["FURNACE"].health_score <= 70
    assert fleet["FAULTY"].health_score == 90.0


def test_incident_to_work_order(plan):
    built = plan.incidents
    first = built.orderBy("incident_id").first()
    assert (first.machine_id, first.incident_id, first.production_impact) == ("BEARING", "INC-001", "DEGRADED")
    assert first.parts_available == 1 and first.affected_signals is not None
    drafts = work_orders.draft_work_orders(built, plan.work_orders, built.select("incident_id"), as_of=NOW)
    assert drafts.orders.count() == built.count() == 3
    assert drafts.orders.where("machine_id = 'BEARING'").first().work_order_id == "WO-0001"
    shown = reports.incident_triage(drafts.incidents, drafts.orders, statuses=["WORK_ORDER_PENDING"]).collect()
    assert [r.wo_status for r in shown] == ["DRAFT"] * 3 and shown[0].machine_id == "BEARING"
    text = reports.grounding_context(built, plan.history.join(built, "machine_id", "left_semi")).where("machine_id = 'BEARING'").first()
    assert "BEARING_DEGRADATION | N/A | N/A | 2023-12-02" in text.context


def test_cycle_announces_once(plan, tmp_path):
    root = str(tmp_path)
    stored = StoredTables(plan.machines.sparkSession, root)
    serious = plan.incidents.where("severity IN ('CRITICAL', 'HIGH')").count()
    first = run_cycle(plan.incidents, root, as_of=NOW, cycle="1").first()
    assert (first.new_incidents, first.notifications) == (3, serious)
    assert {(r.status, r.sent_at) for r in stored.notification_log().collect()} == {("SENT", NOW)}
    repeated = run_cycle(plan.incidents, root, as_of=NOW, cycle="1").first()
    assert repeated.notifications == serious and stored.notification_log().count() == serious
    again = run_cycle(plan.incidents, root, as_of=NOW + timedelta(minutes=5), cycle="2").first()
    assert again.notifications == 0
    assert stored.notification_log().count() == serious
    assert [(r.cycle_id, r.notifications) for r in read_cycles(plan.machines.sparkSession, root).orderBy("cycle_id").collect()] == [
        ("1", serious), ("2", 0)]


def test_what_was_announced_elsewhere_is_not_said_again(plan, tmp_path):
    root = str(tmp_path)
    run_cycle(plan.incidents, root, as_of=NOW, cycle="1")
    said = StoredTables(plan.machines.sparkSession, root).notification_log()
    other = run_cycle(plan.incidents, f"{root}/other", as_of=NOW, cycle="1", log=said).first()
    assert other.notifications == 0


def test_cycles_run_on_an_interval(plan, tmp_path):
    """A clock sets the pace; after a restart the cycles go on where they were."""
    spark, root = plan.machines.sparkSession, str(tmp_path)
    known = plan.incidents.drop("evidence_json")
    known.write.parquet(f"{root}/incidents")
    stored = spark.read.schema(known.schema).parquet(f"{root}/incidents")

    def run_until(cycles):
        clock = spark.readStream.format("rate").option("rowsPerSecond", 5).load()
        query = run_cycles(clock, lambda batch, n: (stored, NOW + timedelta(minutes=5 * n)), root, every="2 seconds")
        try:
            for _ in range(120):
                if read_cycles(spark, root).count() >= cycles or query.exception():
                    break
                query.awaitTermination(1)
        finally:
            query.stop()
        assert query.exception() is None

    run_until(2)
    run_until(4)
    log = read_cycles(spark, root).orderBy("cycle_id").collect()
    assert len(log) >= 4 and [r.cycle_id for r in log] == [f"cycle-{i:08}" for i in range(len(log))]
    serious = plan.incidents.where("severity IN ('CRITICAL', 'HIGH')").count()
    assert [r.notifications for r in log] == [serious] + [0] * (len(log) - 1)
    assert StoredTables(spark, root).notification_log().count() == serious


def test_stored_datasets_are_read_back(plan, tmp_path, plan_of):
    """A second plan on the folder computes nothing anew, and reads the days it is asked for."""
    root = str(tmp_path / "derived")
    writer = FleetPlan(plan.tables, as_of=NOW, stored=root)
    want = sorted(map(str, writer.fleet.collect()))
    reader = FleetPlan(plan.tables, as_of=NOW, stored=root)
    reader.tables = None  # machines and events are still asked for, readings no more
    reader.machines, reader.events = plan.machines, plan.events
    reader.context = plan.context
    assert sorted(map(str, reader.fleet.collect())) == want
    files = len(reader.features.inputFiles())
    recent = reader.recent_features(hours=24)
    assert files >= 30 and len(recent.inputFiles()) == 1  # the last day has no rows yet
    assert "part" in plan_of(recent) and "PartitionFilters: [isnotnull(part" in plan_of(recent)
    assert reader.features_table.step().mark == NOW - timedelta(hours=1)
    before = reader.features_table.step().number
    FleetPlan(plan.tables, as_of=NOW, stored=root).refresh()
    assert reader.features_table.step().number == before + 1


def test_stored_readings_are_clustered(spark, plan, tmp_path):
    """Files say which machines they hold: few of a day's files need to be opened for one machine."""
    import glob

    import pyarrow.parquet as pq

    rows = plan.readings.where("machine_id <> 'FAULTY'")
    many = rows.crossJoin(spark.range(40).withColumnRenamed("id", "n")).withColumns({
        "machine_id": F.concat("machine_id", F.lpad(F.col("n").cast("string"), 2, "0")),
        "reading_timestamp": F.col("reading_timestamp") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("n").cast("decimal(18,6)")),
    }).where("reading_timestamp < timestamp_ntz '2024-01-03'").drop("n")
    write_readings(many, f"{tmp_path}/r", slices_per_day=4)
    files = glob.glob(f"{tmp_path}/r/reading_date=2024-01-02/*.parquet")

    def holds(path, machine):
        group = pq.ParquetFile(path).metadata.row_group(0)
        stats = next(group.column(i).statistics for i in range(group.num_columns) if group.column(i).path_in_schema == "machine_id")
        return stats.min <= machine <= stats.max

    assert len(files) >= 6
    for machine in ("ALIGN07", "LOADED20", "SEAL39"):
        assert 1 <= sum(holds(f, machine) for f in files) <= 2
    day = spark.read.parquet(f"{tmp_path}/r").where("reading_date = date '2024-01-02' and machine_id = 'SEAL39'")
    assert day.count() == 24 and set(day.inputFiles()) <= {f"file://{f}" for f in files}


def test_a_repeated_run_adds_nothing(spark, frame, tmp_path):
    from plantpulse.sources.store import append_table, read_table

    rows = frame("notification_type string, reference_id string, severity string", ("X", "R1", "HIGH"), ("X", "R2", "HIGH"))
    for run in ("1", "1", "2"):
        append_table(rows, "notification_log", str(tmp_path), run=run)
    assert read_table(spark, str(tmp_path), "notification_log").count() == 4
    append_table(rows, "notification_log", str(tmp_path))
    assert read_table(spark, str(tmp_path), "notification_log").count() == 6
