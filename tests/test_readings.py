import statistics
from datetime import datetime, timedelta

import pytest

from plantpulse.operators import readings as R
from plantpulse.operators.slices import with_lookback

READING = ("reading_id long, sensor_id string, machine_id string, signal_type string, "
           "reading_value double, reading_timestamp timestamp_ntz, quality_flag string")
SENSOR = ("sensor_id string, machine_id string, signal_type string, unit string, "
          "warning_threshold double, critical_threshold double, sampling_interval_sec long")
START = datetime(2024, 1, 1)


def series(values, sensor="A-VIBRATION", step=60, first_id=0):
    machine, signal = sensor.split("-")
    return [
        (first_id + i, sensor, machine, signal, v, START + timedelta(seconds=i * step), "GOOD")
        for i, v in enumerate(values)
    ]


def sensor(name="A-VIBRATION", unit="mm/s", warning=7.0, critical=12.0, every=60):
    machine, signal = name.split("-")
    return (name, machine, signal, unit, warning, critical, every)


def expected_flags(rows, lookback=20, sigma=3):
    """Spike flag and gap of every row, one sensor at a time."""
    out, by_sensor = {}, {}
    for row in sorted(rows, key=lambda r: (r[1], r[5], r[0])):
        by_sensor.setdefault(row[1], []).append(row)
    for own in by_sensor.values():
        for i, row in enumerate(own):
            before = [r[4] for r in own[max(0, i - lookback):i] if r[4] is not None]
            spike = False
            if row[4] is not None and len(before) > 1:
                spike = abs(row[4] - statistics.fmean(before)) > sigma * statistics.stdev(before) + 1e-9
            gap = None if i == 0 else int((row[5] - own[i - 1][5]).total_seconds())
            out[row[0]] = (gap, spike)
    return out


def history(frame, rows, **options):
    out = R.reading_history(frame(READING, *rows), **options).collect()
    assert len(out) == len(rows)
    return {r.reading_id: (r.gap_seconds, r.is_spike) for r in out}


def mixed_rows():
    """A dense sensor with bursts and pauses, a sparse one and a constant one."""
    rows, at = [], START
    for i in range(400):
        at += timedelta(seconds=5 if i % 50 < 40 else 900)
        value = None if i % 37 == 0 else 5.0 + (i * 7 % 11) * 0.1 + (40.0 if i % 61 == 0 else 0)
        rows.append((i, "HOT-VIBRATION", "HOT", "VIBRATION", value, at, "GOOD"))
    rows += series([1.0, 2.0, 9.0], "FEW-CURRENT", 3600, 1000)
    rows += series([2.1] * 30 + [2.2], "SAME-RPM", 60, 2000)
    # equal timestamps are ordered by id
    rows += [(3000 + i, "TIE-RPM", "TIE", "RPM", float(i % 4), START, "GOOD") for i in range(30)]
    return rows


@pytest.mark.parametrize("hot_rows,slice_rows", [(10**9, 1), (100, 150), (100, 16), (100, 3), (1, 1), (20, 7)])
def test_sliced_history_equals_whole_history(frame, hot_rows, slice_rows):
    rows = mixed_rows()
    got = history(frame, rows, hot_rows=hot_rows, slice_rows=slice_rows)
    assert got == expected_flags(rows)


def test_hot_sensor_is_spread_over_slices(frame):
    rows = series([float(i % 9) for i in range(300)], step=10)
    out = with_lookback(
        frame(READING, *rows), key="sensor_id", ts="reading_timestamp", tie="reading_id",
        carried=["reading_value"], lookback=20, hot_rows=100, slice_rows=30,
    ).collect()
    sizes = {}
    for r in out:
        sizes[r._slice] = sizes.get(r._slice, 0) + 1
    assert len(sizes) == 10
    assert max(sizes.values()) <= 30 + 20 + 1
    assert sum(not r._before for r in out) == 300


def test_clean_readings_boundaries(frame):
    rows = series([6.99, 7.0, 11.99, 12.0, None])
    sensors = frame(SENSOR, sensor())
    out = {r.reading_id: r for r in R.clean_readings(frame(READING, *rows), sensors).collect()}
    assert [out[i].threshold_status for i in range(5)] == ["NORMAL", "WARNING", "WARNING", "CRITICAL", "NORMAL"]
    assert [out[i].quality_flag for i in range(5)] == ["GOOD"] * 4 + ["MISSING"]
    assert not out[4].is_spike


def test_missing_limits_are_normal(frame):
    sensors = frame(SENSOR, sensor("A-RPM", "rpm", None, None))
    out = R.clean_readings(frame(READING, *series([9e9], "A-RPM")), sensors).first()
    assert out.threshold_status == "NORMAL"


def test_fahrenheit_is_converted_but_compared_raw(frame):
    rows = series([212.0], "A-TEMPERATURE")
    sensors = frame(SENSOR, sensor("A-TEMPERATURE", "F", 150.0, 200.0))
    raw = R.clean_readings(frame(READING, *rows), sensors).first()
    assert (raw.normalized_value, raw.threshold_status) == (100.0, "CRITICAL")
    normal = R.clean_readings(frame(READING, *rows), sensors, compare="normalized").first()
    assert normal.threshold_status == "NORMAL"


def test_stale_needs_more_than_three_intervals(frame):
    rows = [
        (i, "A-VIBRATION", "A", "VIBRATION", 1.0, START + timedelta(seconds=s), "GOOD")
        for i, s in enumerate((0, 180, 361))
    ]
    out = R.stale_gap(frame(READING, *rows), frame(SENSOR, sensor())).collect()
    assert {r.reading_id: (r.gap_seconds, r.is_stale) for r in out} == {
        0: (None, False), 1: (180, False), 2: (181, True)
    }


def test_unknown_sensor_drops_out(frame):
    out = R.clean_readings(frame(READING, *series([1.0], "B-RPM")), frame(SENSOR, sensor()))
    assert out.count() == 0


def test_flat_lines(frame):
    values = [1.0, 2.0, 2.0, 2.0, 3.0]
    whole = R.flat_lines(frame(READING, *series(values)), min_readings=3).collect()
    assert {r.reading_id for r in whole if r.is_flat} == {3}
    sliced = R.flat_lines(frame(READING, *series(values)), min_readings=3, hot_rows=1, slice_rows=1)
    assert {r.reading_id for r in sliced.collect() if r.is_flat} == {3}


@pytest.mark.parametrize("slicing", [{}, {"hot_rows": 1, "slice_rows": 1}, {"hot_rows": 2, "slice_rows": 2}])
def test_suppress_offline(frame, slicing):
    events = frame(
        "event_id long, machine_id string, event_type string, event_timestamp timestamp_ntz",
        (1, "A", "SHUTDOWN", "2024-01-01 00:02:00"), (2, "A", "ALARM", "2024-01-01 00:03:00"),
        (3, "A", "STARTUP", "2024-01-01 00:04:00"), (4, "B", "SHUTDOWN", "2024-01-01 00:01:00"),
    )
    machines = frame("machine_id string, operating_state string",
                     ("A", "RUNNING"), ("B", "RUNNING"), ("C", "MAINTENANCE"))
    rows = series([1.0] * 6, "A-RPM") + series([1.0] * 3, "B-RPM", 86400, 10) + series([1.0], "C-RPM", 60, 20)
    out = R.suppress_offline(frame(READING, *rows), events, machines, **slicing).collect()
    assert len(out) == 10
    assert {r.reading_id for r in out if r.suppressed} == {2, 3, 11, 12, 20}


def test_one_shuffle_for_all_history_flags(frame, plan_of):
    assert "_slice" in plan_of(R.reading_history(frame(READING, *series([1.0, 2.0])), hot_rows=1, slice_rows=1))
    df = R.reading_history(frame(READING, *series([1.0, 2.0])))
    text = plan_of(df)
    assert text.count("Window [lag") == 1
    assert text.count("Exchange hashpartitioning(sensor_id") == 1
    assert "BatchEvalPython" not in text and "CartesianProduct" not in text


def test_a_burst_is_cut_by_rows(frame):
    """Nine tenths of a sensor's rows in one hour: no slice has more than twice its share."""
    from datetime import timedelta

    rows = [(i, "A-RPM", "A", "RPM", float(i), START + timedelta(seconds=i if i < 900 else 3600 * (i - 890)), "GOOD") for i in range(1000)]
    marked = with_lookback(
        frame(READING, *rows), key="sensor_id", ts="reading_timestamp", tie="reading_id",
        carried=["reading_value"], lookback=20, hot_rows=100, slice_rows=50,
    )
    sizes = [r["count"] for r in marked.where("not _before").groupBy("_slice").count().collect()]
    assert sum(sizes) == 1000 and max(sizes) <= 100 and len(sizes) >= 15


def test_cuts_are_found_by_halving(frame, plan_of):
    """However many cuts a key has, a row costs the same: no lambda goes through the list."""
    from plantpulse.operators.slices import CUTS, with_slice

    days = frame("key string, ts timestamp_ntz", *[("A", f"2024-01-01 00:{i // 60:02}:{i % 60:02}") for i in range(900)])
    first = 1704067200  # 2024-01-01
    for cuts in ([], [first - 5], [first + 3, first + 4, first + 899], [first + 2 * i for i in range(450)], [first + i for i in range(1000)]):
        listed = frame("key string, _cuts array<bigint>", ("A", cuts))
        got = with_slice(days.join(listed, "key"), "ts").collect()
        assert all(r._slice == sum(c <= first + r.ts.minute * 60 + r.ts.second for c in cuts) for r in got) and len(got) == 900
    none = frame("key string, ts timestamp_ntz, _cuts array<bigint>", ("A", "2024-01-01 00:00:01", None), ("A", None, [first]))
    assert [r._slice for r in with_slice(none, "ts").collect()] == [0, 0]
    assert 2 ** CUTS.bit_length() > CUTS

    rows = frame(READING, *series([float(i % 9) for i in range(300)], step=10))
    text = plan_of(with_lookback(rows, key="sensor_id", ts="reading_timestamp", tie="reading_id",
                                 carried=["reading_value"], lookback=20, hot_rows=100, slice_rows=30))
    assert "lambda" not in text


def test_a_slice_takes_only_the_tails_it_needs(frame, plan_of):
    """Twenty rows before a slice of twenty come from one tail, not from twenty of them."""
    rows = frame(READING, *series([float(i % 9) for i in range(300)], step=10))
    out = with_lookback(rows, key="sensor_id", ts="reading_timestamp", tie="reading_id",
                        carried=["reading_value"], lookback=20, hot_rows=100, slice_rows=30)
    assert "specifiedwindowframe(RangeFrame, -19, currentrow" in plan_of(out)
    given = {}
    for r in out.where("_before").collect():
        given.setdefault(r._slice, []).append(r.reading_id)
    assert {s: sorted(ids) for s, ids in given.items()} == {s: list(range(30 * s - 20, 30 * s)) for s in range(1, 10)}


def test_known_sizes_are_not_counted_again(frame):
    """Where the caller knows how many rows each sensor has, these numbers say which is hot."""
    rows = frame(READING, *series([float(i % 9) for i in range(300)], step=10))
    args = dict(key="sensor_id", ts="reading_timestamp", tie="reading_id", carried=["reading_value"],
                lookback=20, hot_rows=100, slice_rows=30)
    sizes = rows.groupBy("sensor_id").count().withColumnRenamed("count", "_n")
    few = sizes.selectExpr("sensor_id", "cast(1 as long) as _n")
    assert with_lookback(rows, sizes=few, **args).where("_before").count() == 0
    assert sorted(map(str, with_lookback(rows, sizes=sizes, **args).collect())) == sorted(map(str, with_lookback(rows, **args).collect()))
