from datetime import datetime, timedelta

from pyspark.sql import functions as F

from plantpulse.operators import anomalies, features, health, numbering

CLEAN = ("machine_id string, signal_type string, reading_timestamp timestamp_ntz, normalized_value double, "
         "threshold_status string, is_spike boolean, quality_flag string")
HOURLY = "machine_id string, signal_type string, hour_bucket timestamp_ntz, avg_value double, std_value double"
START = datetime(2024, 1, 1)


def test_hourly_stats(frame):
    out = features.hourly_stats(frame(
        CLEAN,
        ("A", "RPM", "2024-01-01 00:00:00", 1.0, "NORMAL", False, "GOOD"),
        ("A", "RPM", "2024-01-01 00:59:59", 2.0, "WARNING", True, "STALE"),
        ("A", "RPM", "2024-01-01 01:00:00", None, "CRITICAL", False, "MISSING"),
    )).orderBy("hour_bucket").collect()
    assert out[0].avg_value == 1.5 and out[0].std_value == 0.7071
    assert (out[0].warning_count, out[0].spike_count, out[0].bad_quality_count) == (1, 1, 1)
    assert out[1].avg_value is None and out[1].std_value is None and out[1].reading_count == 1


def hours(values, skip=()):
    return [("A", "RPM", START + timedelta(hours=i), float(v), 1.0 + i % 3)
            for i, v in enumerate(values) if i not in skip]


def test_rolling_features_by_row(frame):
    values = [i * i % 17 for i in range(200)]
    out = features.rolling_features(frame(HOURLY, *hours(values))).orderBy("hour_bucket").collect()
    for i in (0, 5, 6, 23, 24, 167, 199):
        def mean(n):
            part = values[max(0, i - n + 1):i + 1]
            return sum(part) / len(part)
        assert abs(out[i].rolling_6h_avg - mean(6)) < 1e-4
        assert abs(out[i].rolling_24h_avg - mean(24)) < 1e-4
        assert abs(out[i].baseline_deviation_7d - (values[i] - mean(168))) < 1e-4
        assert out[i].rate_of_change_6h == (values[i] - values[i - 6] if i >= 6 else None)
    assert out[0].variability_trend_24h is None


def test_rolling_features_by_time_see_gaps(frame):
    rows = hours(range(20), skip=range(4, 12))
    by_row = features.rolling_features(frame(HOURLY, *rows)).orderBy("hour_bucket").collect()
    by_time = features.rolling_features(frame(HOURLY, *rows), frame="time").orderBy("hour_bucket").collect()
    assert by_row[4].rolling_6h_avg == (0 + 1 + 2 + 3 + 12) / 5
    assert by_time[4].rolling_6h_avg == 12.0
    assert by_row[6].rate_of_change_6h == 14.0 and by_time[6].rate_of_change_6h is None


LATEST = ("machine_id string, signal_type string, total_criticals_24h long, total_warnings_24h long, "
          "latest_baseline_dev double, total_spikes_24h long, total_bad_quality_24h long, latest_roc double")


def test_signal_health_score(frame):
    out = health.signal_health_score(frame(
        LATEST,
        ("A", "RPM", 0, 0, None, 0, 0, None),
        ("A", "CURRENT", 1, 4, -3.1, 6, 6, 2.1),
        ("A", "PRESSURE", 0, 3, 3.0, 5, 5, -2.0),
    )).collect()
    assert {r.signal_type: r.signal_health_score for r in out} == {"RPM": 100, "CURRENT": 5, "PRESSURE": 85}


def test_fleet_health_ranks_and_unknown(frame):
    machine = "machine_id string, machine_name string, machine_type string, line string, criticality string"
    machines = frame(machine, *[(m, m, "T", "L", "HIGH") for m in "ABCD"])
    context = frame("machine_id string, current_state string, load_pct double, suppress_signals boolean",
                    ("A", "RUNNING", 50.0, False))
    scores = frame("machine_id string, signal_type string, signal_health_score long",
                   ("A", "RPM", 50), ("A", "CURRENT", 60), ("B", "RPM", 55), ("C", "RPM", 55), ("C", "CURRENT", 55))
    now = datetime(2024, 1, 31)
    out = {r.machine_id: r for r in health.fleet_health(machines, context, scores, as_of=now).collect()}
    assert {m: out[m].concern_rank for m in "ABCD"} == {"A": 1, "B": 1, "C": 1, "D": 4}
    assert out["A"].health_status == "DEGRADED" and out["A"].signals_at_risk == 1
    assert (out["C"].worst_signal_type, out["C"].worst_signal_score) == ("CURRENT", 55)
    assert out["D"].health_score is None and out["D"].health_status == "CRITICAL"
    assert out["D"].signals_at_risk == 0
    named = health.fleet_health(machines, context, scores, as_of=now, name_unknown=True)
    assert named.where("machine_id = 'D'").first().health_status == "UNKNOWN"


FEATURE = ("machine_id string, signal_type string, hour_bucket timestamp_ntz, avg_value double, "
           "rolling_24h_avg double, baseline_deviation_7d double, rate_of_change_6h double, "
           "warning_count long, critical_count long, spike_count long")


def feature(machine, at, dev=0.0, roc=0.0, warn=0, crit=0, spikes=0, signal="RPM"):
    return (machine, signal, at, 1.0, 1.0, dev, roc, warn, crit, spikes)


def test_detect_anomalies(frame):
    rows = [
        feature("B", "2024-01-30 01:00:00", dev=5.1, roc=3.1, warn=3, crit=1, spikes=4),
        feature("A", "2024-01-30 01:00:00", dev=-3.1, roc=1.6, warn=1),
        feature("A", "2024-01-30 00:00:00", spikes=1, warn=1),
        feature("A", "2024-01-29 00:00:00", warn=1),
        feature("A", "2024-01-20 00:00:00", crit=1),
    ]
    out = anomalies.detect_anomalies(frame(FEATURE, *rows), as_of=datetime(2024, 1, 31)).orderBy("anomaly_id").collect()
    assert [(r.anomaly_id, r.machine_id, r.anomaly_score, r.severity) for r in out] == [
        (1, "A", 15, "LOW"), (2, "A", 28, "LOW"), (3, "B", 100, "HIGH"),
    ]


def test_anomaly_groups_split_at_gaps(frame):
    rows = frame(
        "machine_id string, detection_timestamp timestamp_ntz, affected_signal string, anomaly_score long",
        ("A", "2024-01-01 00:00:00", "RPM", 20), ("A", "2024-01-01 06:00:00", "CURRENT", 50),
        ("A", "2024-01-01 06:00:00", "RPM", 30), ("A", "2024-01-01 13:00:00", "RPM", 15),
    )
    out = anomalies.anomaly_groups(rows, gap_hours=6).orderBy("group_no").collect()
    assert [(r.anomaly_count, r.max_score, r.affected_signals) for r in out] == [
        (3, 50, "CURRENT, RPM"), (1, 15, "RPM"),
    ]


def test_numbering_is_dense_and_ordered(spark):
    df = spark.range(0, 1000, 1, 7).select((F.col("id") * 37 % 1000).alias("v"))
    out = numbering.number_rows(df, [F.desc("v")], "n").collect()
    assert {(r.v, r.n) for r in out} == {(v, 1000 - v) for v in range(1000)}


def test_numbering_survives_a_hot_first_key(spark):
    df = spark.range(500).select(F.lit(1).alias("k"), "id")
    out = numbering.number_rows(df, [F.asc("k"), F.asc("id")], "n").collect()
    assert {(r.id, r.n) for r in out} == {(i, i + 1) for i in range(500)}


def test_rank_ascending_matches_rank(frame):
    df = frame("v double", (3.0,), (1.0,), (None,), (1.0,), (2.0,), (None,))
    out = sorted((r.v is None, r.v or 0, r.rk) for r in numbering.rank_ascending(df, "v", "rk").collect())
    assert [r[2] for r in out] == [1, 1, 3, 4, 5, 5]


def test_ids_do_not_use_one_task_over_the_rows(frame, plan_of):
    df = anomalies.detect_anomalies(
        frame(FEATURE, feature("A", "2024-01-30 01:00:00", crit=1)), as_of=datetime(2024, 1, 31)
    )
    for line in plan_of(df).splitlines():
        if "Window [row_number" in line:
            assert "windowspecdefinition(detection_timestamp" in line
