from datetime import datetime, timedelta

from pyspark.sql import functions as F

from plantpulse.operators import readings as R
from plantpulse.operators.features import hourly_stats, rolling_features
from plantpulse.operators.health import latest_signal_features, signal_health_score
from plantpulse.operators.readings import clean_readings
from plantpulse.sources.store import read_table
from plantpulse.streaming import lifecycle, refresh, windows
from test_context import EVENT, MACHINE, machine
from test_readings import READING, SENSOR, START, mixed_rows, sensor
from test_work_orders import ORDER, one_by_one, order

NOW = datetime(2024, 1, 31)


def files(frame, schema, rows, path, parts):
    """Rows dealt out to files, to arrive one file per micro-batch."""
    for i in range(parts):
        frame(schema, *rows[i::parts]).coalesce(1).write.mode("append").parquet(f"{path}")


def arriving(spark, path, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_a_batch_reads_the_days_around_it(spark, frame, tmp_path):
    """A late and a new reading among two months of days: all other days could be gone."""
    import shutil

    root = str(tmp_path)
    rows = [(i, "A-RPM", "A", "RPM", float(i * i % 17), START + timedelta(hours=i), "GOOD") for i in range(24 * 60)]
    late, new = rows[24 * 30 + 2], rows[-1]
    sensors = frame(SENSOR, sensor("A-RPM", "rpm", every=7200))
    first = [r for r in rows if r not in (late, new)]
    refresh.refresh_clean(frame(READING, *first), 0, root=root, sensors=sensors)
    days = lambda *numbers: {(START + timedelta(days=n)).date().isoformat() for n in numbers}
    near = days(29, 30, 31, 58, 59)
    for table in ("readings", "clean", "hourly"):
        for place in (tmp_path / table / "rows").glob("version=*/part=*"):
            if place.name[5:] not in near:
                shutil.rmtree(place)
    refresh.refresh_clean(frame(READING, late, new), 1, root=root, sensors=sensors)
    whole = clean_readings(frame(READING, *rows), sensors)
    table = refresh.clean_table(spark, root)
    changed = table.last_change(1)
    ids = sorted(r.reading_id for r in changed.collect())
    assert ids == [*range(late[0], late[0] + 21), new[0]]
    want = whole.where(F.col("reading_id").isin(ids)).select(changed.columns)
    assert sorted(map(tuple, changed.collect())) == sorted(map(tuple, want.collect()))
    hours = refresh.hourly_table(spark, root).last_change(1)
    assert hours.count() == 22  # one reading an hour
    assert set(refresh.readings_table(spark, root).parts()) == days(*range(60))


def test_neighbours_of_a_seldom_sensor_are_found_further_away(spark, frame, tmp_path):
    """A reading every ten days: its neighbours lie outside the first span of days."""
    root = str(tmp_path)
    rows = [(i, "A-RPM", "A", "RPM", float(i * i % 17), START + timedelta(days=10 * i), "GOOD") for i in range(60)]
    sensors = frame(SENSOR, sensor("A-RPM", "rpm", every=86400 * 10))
    order = [*range(0, 30), *range(31, 60), 30]
    for n, some in enumerate((order[:40], order[40:59], order[59:])):
        refresh.refresh_clean(frame(READING, *[rows[i] for i in some]), n, root=root, sensors=sensors, compact_every=2)
    whole = clean_readings(frame(READING, *rows), sensors)
    got = refresh.read_clean(spark, root).select(whole.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, whole.collect()))
    assert refresh.clean_table(spark, root).last_change(2).count() == 21


def sensors_of(frame):
    names = sorted({r[1] for r in mixed_rows()})
    return frame(SENSOR, *[sensor(n, every=300) for n in names])


def test_refreshed_clean_equals_batch_with_late_rows(spark, frame, tmp_path):
    rows, root = mixed_rows(), str(tmp_path)
    files(frame, READING, rows, f"{root}/in", 3)
    sensors = sensors_of(frame)
    seen = []

    def handle(batch, batch_id):
        seen.append(batch_id)
        refresh.refresh_clean(batch, batch_id, root=root, sensors=sensors)
        refresh.refresh_clean(batch, batch_id, root=root, sensors=sensors)  # a repeated batch

    query = refresh.run_batches(arriving(spark, f"{root}/in", frame(READING).schema), handle, root, name="clean")
    query.awaitTermination()
    assert seen == [0, 1, 2]
    whole = clean_readings(frame(READING, *rows), sensors)
    columns = whole.columns
    assert sorted(map(tuple, refresh.read_clean(spark, root).select(columns).collect()), key=str) == sorted(
        map(tuple, whole.collect()), key=str
    )
    hours = refresh.read_hourly(spark, root)
    assert sorted(map(tuple, hours.collect()), key=str) == sorted(
        map(tuple, hourly_stats(whole).select(hours.columns).collect()), key=str
    )
    assert query.exception() is None
    for _ in range(2):
        refresh.log_refresh(refresh.clean_table(spark, root), 2, root=root, dataset="clean", layer="STAGING",
                            input_rows=3, target_lag_sec=300, refreshed_at=NOW)
    log = read_table(spark, root, "refresh_log").collect()
    assert [(r.dataset, r.state, r.batch_id, r.latest_data) for r in log] == [("clean", "SUCCEEDED", 2, max(r[5] for r in rows))]


def test_an_empty_batch_changes_nothing(spark, frame, tmp_path):
    root = str(tmp_path)
    sensors = frame(SENSOR, sensor("A-RPM", "rpm"))
    rows = hourly_rows()[:40]
    for n, some in enumerate((rows[:30], [], rows[30:])):
        refresh.refresh_clean(frame(READING, *some), n, root=root, sensors=sensors)
    whole = clean_readings(frame(READING, *rows), sensors)
    assert sorted(map(tuple, refresh.read_clean(spark, root).select(whole.columns).collect())) == sorted(map(tuple, whole.collect()))
    assert refresh.read_hourly(spark, root).count() == hourly_stats(whole).count()


def hourly_rows():
    return [
        (i, "A-RPM", "A", "RPM", float(i % 13), START + timedelta(minutes=20 * i), "GOOD") for i in range(90)
    ]


def test_refreshed_fleet_of_an_earlier_time(spark, frame, tmp_path):
    """Hours after the as-of time neither count nor push the ones before it out."""
    root = str(tmp_path)
    rows = [(i, "A-RPM", "A", "RPM", 50.0 + i % 3, START + timedelta(hours=i), "GOOD") for i in range(400)]
    sensors = frame(SENSOR, sensor("A-RPM", "rpm", every=7200))
    machines, events = frame(MACHINE, machine("A")), frame(EVENT)
    refresh.refresh_clean(frame(READING, *rows), 0, root=root, sensors=sensors)
    for hours in (150, 399):
        now = START + timedelta(hours=hours)
        refresh.refresh_fleet(hours, spark=spark, root=root, machines=machines, events=events, as_of=now)
        got = refresh.read_fleet(spark, root).first()
        hourly = hourly_stats(clean_readings(frame(READING, *rows), sensors)).where(F.col("hour_bucket") <= F.lit(now).cast("timestamp_ntz"))
        scores = signal_health_score(latest_signal_features(rolling_features(hourly), as_of=now, hours=24))
        want = scores.first().signal_health_score
        assert want is not None and got.health_score == want


def test_hourly_stream_equals_batch_for_closed_hours(spark, frame, tmp_path):
    rows, root = hourly_rows(), str(tmp_path)
    for i in range(3):
        frame(READING, *rows[30 * i:30 * i + 30]).coalesce(1).write.mode("append").parquet(f"{root}/in")
    sensors = frame(SENSOR, sensor("A-RPM", "rpm"))
    stream = windows.hourly_stats_stream(
        windows.stateless_clean(arriving(spark, f"{root}/in", frame(READING).schema), sensors)
    )
    refresh.run_stream(stream, root, name="hours").awaitTermination()
    got = {tuple(r) for r in spark.read.parquet(f"{root}/hours").collect()}
    whole = hourly_stats(R.clean_readings(frame(READING, *rows), sensors)).select(stream.columns)
    last = rows[-1][5] - timedelta(hours=2)
    assert got == {tuple(r) for r in whole.collect() if r.hour_bucket + timedelta(hours=1) <= last}
    assert len(got) == 27


def test_decisions_over_batches_equal_one_by_one(spark, frame, tmp_path):
    root = str(tmp_path)
    orders = frame(ORDER, *[order(n, "A", "M", s) for n, s in enumerate(("DRAFT", "DRAFT", "APPROVED", "DRAFT"), 1)])
    schema = "command_seq long, work_order_id string, approver string, action string"
    actions = ("ESCALATE", "APPROVE", "REJECT", "DANCE", "REJECT")
    commands = [(i, f"WO-{1 + i * 3 % 6:04}", f"P{i}", actions[i % 5]) for i in range(18)]
    for i in range(3):
        frame(schema, *commands[6 * i:6 * i + 6]).coalesce(1).write.mode("append").parquet(f"{root}/in")
    lifecycle.open_orders(orders, root)
    stream = arriving(spark, f"{root}/in", frame(schema).schema)

    def handle(batch, batch_id):
        lifecycle.decide_batch(batch, batch_id, root=root, as_of=NOW, compact_every=2)
        lifecycle.decide_batch(batch, batch_id, root=root, as_of=NOW)  # a repeated batch

    refresh.run_batches(stream, handle, root, name="commands").awaitTermination()
    statuses = {r.work_order_id: r.status for r in orders.collect()}
    results = spark.read.parquet(f"{root}/decisions").collect()
    # files may arrive in any order; within one batch commands go by number
    batches = sorted({r.batch_id for r in results})
    of = {r.command_seq: r.batch_id for r in results}
    expected = {}
    for b in batches:
        expected.update(one_by_one(statuses, [c for c in commands if of[c[0]] == b]))
    assert len(batches) == 3
    assert {r.command_seq: r.result for r in results} == expected
    assert {r.work_order_id: r.status for r in lifecycle.current_orders(spark, root).collect()} == statuses


def test_notifications_once_per_incident(spark, frame, tmp_path):
    schema = ("incident_id string, machine_id string, severity string, status string, suspected_failure_mode string, "
              "evidence_narrative string, updated_at timestamp_ntz")
    root = str(tmp_path)
    rows = [("I1", "A", "HIGH", "NEW", "X", "t", "2024-01-01 00:00:00"), ("I2", "B", "MEDIUM", "NEW", "X", "t", "2024-01-01 00:00:00"),
            ("I3", "C", "CRITICAL", "ASSIGNED", "X", "t", "2024-01-01 00:00:00")]
    for _ in range(2):
        frame(schema, *rows).coalesce(1).write.mode("append").parquet(f"{root}/in")
    stream = windows.notification_stream(arriving(spark, f"{root}/in", frame(schema).schema))
    refresh.run_stream(stream, root, name="out").awaitTermination()
    assert [r.reference_id for r in spark.read.parquet(f"{root}/out").collect()] == ["I1"]
