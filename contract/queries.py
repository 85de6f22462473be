"""Every operator as a named query over the shared tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession, functions as F

from plantpulse import rules
from plantpulse.operators import (
    anomalies, assessments, checks, context, features, forecasts, health, incidents, preparation,
    production, readings, reports, similar, triage, work_orders,
)
from plantpulse.operators.durable import fresh_folder
from plantpulse.plans import cycle
from plantpulse.plans.fleet import FleetPlan
from plantpulse.sources import store
from plantpulse.sources.shared import SharedTables
from plantpulse.streaming import lifecycle, refresh, windows

AS_OF = datetime(2024, 1, 31)
EARLY = datetime(2024, 1, 11)
LATE = datetime(2024, 1, 21)
LATER = datetime(2024, 1, 31, 23)
CALENDAR_START = date(2024, 1, 1)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(name: str | None = None, *, as_of: datetime = AS_OF, **options):
    """Register a function of a plan under its own name."""

    def register(make):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return make(FleetPlan(SharedTables(spark, sf_dir), as_of=as_of, **options))

        QUERIES[name or make.__name__] = run
        return make

    return register


# --- readings ---------------------------------------------------------------

@query()
def clean_readings(p):
    return p.clean


@query()
def clean_readings_stored(p):
    """The same from readings that were written by day and read back with their declared types."""
    spark = p.machines.sparkSession
    path = fresh_folder(spark, "stored")
    store.write_readings(p.readings, f"{path}/sensor_readings")
    return readings.clean_readings(store.StoredTables(spark, path).sensor_readings(), p.sensors)


@query("clean_readings_sliced", history={"hot_rows": 40, "slice_rows": 16})
def clean_readings_sliced(p):
    """The same table with every sensor treated as a hot one."""
    return p.clean


@query()
def normalize_units(p):
    return readings.normalize_units(p.joined).select(
        "reading_id", "signal_type", "unit", "reading_value", "normalized_value"
    )


@query()
def threshold_status(p):
    return readings.threshold_status(p.joined).select(
        "reading_id", "reading_value", "threshold_status"
    )


@query()
def stale_gap(p):
    return readings.stale_gap(p.readings, p.sensors)


@query()
def spike_flag(p):
    return readings.spike_flag(p.readings, p.sensors)


@query()
def quality_flag(p):
    return readings.quality_flag(p.joined).select("reading_id", "quality_flag")


@query()
def flat_lines(p):
    return readings.flat_lines(p.readings, min_readings=3, tolerance=10.0)


@query()
def suppress_offline(p):
    return readings.suppress_offline(p.readings, p.events, p.machines).select(
        "reading_id", "machine_id", "suppressed"
    )


@query()
def suppress_offline_sliced(p):
    """The same with every machine treated as a hot one."""
    return readings.suppress_offline(
        p.readings, p.events, p.machines, hot_rows=40, slice_rows=16
    ).select("reading_id", "machine_id", "suppressed")


# --- context ----------------------------------------------------------------

@query()
def latest_state_event(p):
    return context.latest_state_event(p.events)


@query()
def operating_context(p):
    return p.context


@query()
def load_pct(p):
    return p.context.select("machine_id", "avg_rpm", "load_pct", "avg_current", "current_pct")


@query()
def suppress_signals(p):
    return p.context.select("machine_id", "current_state", "suppress_signals")


@query()
def last_maintenance(p):
    return context.last_maintenance(p.history, as_of=AS_OF)


@query()
def maintenance_totals(p):
    return context.maintenance_totals(p.history).withColumn(
        "total_maint_cost", F.col("total_maint_cost").cast("double")
    )


@query()
def maintenance_totals_failures(p):
    return context.maintenance_totals(p.history, failures_only=True).withColumn(
        "total_maint_cost", F.col("total_maint_cost").cast("double")
    )


@query()
def last_observation(p):
    return context.last_observation(p.shift_logs)


@query()
def latest_production(p):
    return context.latest_production(p.production)


@query()
def latest_production_ordinal(p):
    return context.latest_production(p.production, shift_order="ordinal")


@query()
def recent_events(p):
    return context.recent_events(p.events, as_of=AS_OF)


@query()
def parts_availability(p):
    return context.parts_availability(p.machines, p.parts)


@query()
def maintenance_context(p):
    return p.maintenance.withColumn(
        "total_maint_cost", F.col("total_maint_cost").cast("double")
    )


@query()
def repair_effect(p):
    """Repairs moved onto the telemetry's calendar: one for each order of the month."""
    moved = p.history.withColumn(
        "completed_at",
        F.col("completed_at") + F.make_dt_interval(
            F.datediff(F.lit("2024-01-01").cast("date"), F.trunc("completed_at", "month"))
        ),
    )
    return context.repair_effect(p.features, moved, hours=72)


# --- features and health ----------------------------------------------------

@query()
def hourly_stats(p):
    return p.hourly


@query()
def rolling_features(p):
    return p.features


@query()
def rolling_features_time(p):
    return features.rolling_features(p.hourly, frame="time")


@query()
def signal_correlation(p):
    return features.signal_correlation(p.hourly)


@query()
def signal_correlations(p):
    return features.signal_correlations(p.hourly)


@query()
def latest_signal_features(p):
    return p.latest


@query()
def signal_health_score(p):
    return p.scores


@query(shared=True)
def fleet_health(p):
    return p.fleet


# --- prediction -------------------------------------------------------------

@query()
def anomaly_score(p):
    return anomalies.anomaly_score(p.features).select(
        "machine_id", "signal_type", "hour_bucket", "anomaly_score"
    )


@query(shared=True)
def detect_anomalies(p):
    return p.anomalies


@query()
def anomaly_rollup(p):
    return p.rollup


@query()
def anomaly_groups(p):
    return anomalies.anomaly_groups(p.anomalies, gap_hours=1)


@query()
def daily_trends(p):
    return p.daily


@query(shared=True)
def trend_slope(p):
    return forecasts.trend_slope(p.daily)


@query(shared=True)
def failure_mode(p):
    return forecasts.failure_mode(forecasts.trend_slope(p.daily)).select(
        "machine_id", "signal_type", "predicted_failure_mode"
    )


@query(shared=True)
def risk_horizon(p):
    return forecasts.risk_horizon(forecasts.slopes_with_limits(p.daily, p.sensors)).select(
        "machine_id", "signal_type", "risk_horizon", "estimated_days_to_threshold"
    )


@query(shared=True)
def forecast_confidence(p):
    return forecasts.forecast_confidence(forecasts.slopes_with_limits(p.daily, p.sensors)).select(
        "machine_id", "signal_type", "confidence_level"
    )


@query(shared=True)
def failure_forecasts(p):
    return forecasts.failure_forecasts(p.daily, p.sensors, as_of=AS_OF, numbered=True)


@query(shared=True)
def machine_evidence(p):
    return p.evidence


@query(shared=True, ordering="ordinal", confidence_scope="all")
def machine_evidence_ordinal(p):
    return p.evidence


@query(shared=True)
def evidence_object(p):
    flat = assessments.evidence_object(p.evidence).select("machine_id", "evidence_json")
    e = "evidence_json."
    return flat.select(
        "machine_id",
        *[
            F.col(f"{e}{signal}.{field}").alias(f"{signal}_{field}")
            for signal in ("vibration", "temperature", "current", "pressure")
            for field in ("value", "trend_per_day")
        ],
        F.col(e + "maintenance_history.last_failure_mode").alias("last_failure_mode"),
        F.col(e + "maintenance_history.last_root_cause").alias("last_root_cause"),
        F.col(e + "maintenance_history.days_since_last").alias("days_since_last"),
        F.col(e + "maintenance_history.total_failures").alias("total_failures"),
        F.col(e + "operator_observation.type").alias("observation_type"),
        F.col(e + "operator_observation.detail").alias("observation_detail"),
        F.col(e + "operator_observation.severity").alias("observation_severity"),
        F.col(e + "production.status").alias("production_status"),
        F.col(e + "production.reject_rate_pct").alias("reject_rate_pct"),
    )


@query(shared=True)
def evidence_narrative(p):
    return assessments.evidence_narrative(p.evidence).select("machine_id", "evidence_narrative")


@query(shared=True)
def recommendation(p):
    return assessments.recommendation(p.evidence).select("machine_id", "recommendation")


@query(shared=True)
def assessment_state(p):
    return assessments.assessment_state(p.evidence).select("machine_id", "assessment_state")


@query(shared=True)
def failure_assessments(p):
    return assessments.failure_assessments(
        p.forecasts, p.maintenance, as_of=AS_OF, numbered=True
    ).drop("evidence_json")


# --- incidents --------------------------------------------------------------

@query(shared=True)
def priority_score(p):
    source = incidents.incident_source(p.assessments, p.maintenance, p.rollup)
    return incidents.priority_score(source).select(
        "machine_id", *incidents.PRIORITY_PARTS, "priority_score"
    )


@query(shared=True)
def build_incidents(p):
    return p.incidents.drop("evidence_json")


@query(shared=True)
def triage_update(p):
    return incidents.triage_update(
        p.incidents, p.tables.triage_commands(), as_of=AS_OF
    ).select("incident_id", "machine_id", "status", "updated_at")


@query(shared=True)
def incident_notifications(p):
    return incidents.incident_notifications(p.incidents)


@query(shared=True)
def cycle_summary(p):
    return incidents.cycle_summary(p.incidents, incidents.incident_notifications(p.incidents))


@query(shared=True)
def incident_sla(p):
    return incidents.incident_sla(
        p.incidents, as_of=AS_OF, hours={"CRITICAL": 24, "HIGH": 160, "MEDIUM": 168}
    )


@query(shared=True)
def carry_over(p):
    """Merged with itself as triaged by the commands."""
    before = incidents.triage_update(p.incidents, p.tables.triage_commands(), as_of=AS_OF)
    return incidents.carry_over(before, p.incidents).select(
        "incident_id", "machine_id", "suspected_failure_mode", "status", "created_at"
    )


SLA_HOURS = {"CRITICAL": 24, "HIGH": 160, "MEDIUM": 168}


def _lived(p):
    return triage.incident_lifecycle(
        p.incidents, p.tables.lifecycle_commands(), as_of=AS_OF, hours=SLA_HOURS
    )


@query(shared=True)
def incident_lifecycle(p):
    """Incidents after all commands on them, snoozes that ended and hours that ran out."""
    return _lived(p).incidents.select(
        "incident_id", "machine_id", "severity", "status", "owner", "acknowledged_at", "snooze_reason",
        "snoozed_until", "escalation_status", "resolution_reason", "false_positive_reason", "updated_at",
    )


@query(shared=True)
def lifecycle_results(p):
    return _lived(p).results


# --- work orders ------------------------------------------------------------

def _asked(p):
    """All incidents and some unknown ones, as asked for by the orders."""
    return p.work_orders.select("incident_id")


@query(shared=True)
def draft_work_orders(p):
    return work_orders.draft_work_orders(p.incidents, p.work_orders, _asked(p), as_of=AS_OF).orders


@query(shared=True)
def draft_rejections(p):
    return work_orders.draft_work_orders(
        p.incidents, p.work_orders, _asked(p), as_of=AS_OF
    ).rejected


@query(shared=True)
def draft_results(p):
    """A row for every request: the order drafted, or why there is none."""
    return work_orders.draft_results(
        work_orders.draft_work_orders(p.incidents, p.work_orders, _asked(p), as_of=AS_OF)
    )


@query(shared=True)
def active_order_duplicates(p):
    return work_orders.active_order_duplicates(p.incidents, p.work_orders).select(
        "incident_id", "machine_id", "suspected_failure_mode"
    )


@query(shared=True)
def allocate_order_ids(p):
    return work_orders.allocate_order_ids(p.incidents, p.work_orders).select(
        "incident_id", "work_order_id"
    )


@query(shared=True)
def action_template(p):
    return work_orders.action_template(p.incidents).select(
        "incident_id", "recommended_actions", "estimated_repair_hrs", "estimated_downtime_hrs"
    )


@query(shared=True)
def maintenance_window(p):
    return work_orders.maintenance_window(p.incidents).select("incident_id", "recommended_window")


ORDER_COLUMNS = ["work_order_id", "incident_id", "machine_id", "status"]


def _approved(p, incidents=None):
    return work_orders.apply_approvals(
        p.work_orders, p.tables.approval_commands(), incidents, as_of=AS_OF
    )


def _resolved(p):
    return work_orders.apply_resolutions(
        p.work_orders, p.tables.resolution_commands(), as_of=AS_OF
    )


@query()
def apply_approvals(p):
    return _approved(p).orders.select(*ORDER_COLUMNS, "approved_by", "approved_at", "updated_at")


@query()
def approval_results(p):
    return _approved(p).results


@query(shared=True)
def approval_incidents(p):
    return _approved(p, p.incidents).incidents.select("incident_id", "machine_id", "status", "updated_at")


@query()
def apply_resolutions(p):
    return _resolved(p).orders.select(
        *ORDER_COLUMNS, "actual_root_cause", "actual_parts_replaced", "actual_repair_hrs",
        "technician_findings", "resolved_at", "updated_at",
    )


@query()
def resolution_results(p):
    return _resolved(p).results


# --- production -------------------------------------------------------------

@query()
def performance_baseline(p):
    return production.performance_baseline(p.production)


@query()
def oee_metrics(p):
    return p.oee


@query(shared=True)
def production_impact(p):
    return production.production_impact(p.incidents, p.oee, p.work_orders)


@query()
def line_rollup(p):
    return production.line_rollup(p.oee, cost_per_hour=250.0, cost_per_reject=12.5)


# --- reports ----------------------------------------------------------------

@query(shared=True)
def command_center(p):
    return reports.command_center(p.incidents, p.machines, p.maintenance, p.work_orders).withColumn(
        "total_maint_cost", F.col("total_maint_cost").cast("double")
    )


@query(shared=True)
def fleet_overlay(p):
    return reports.fleet_overlay(p.fleet, p.incidents)


@query()
def oee_daily_trend(p):
    return reports.oee_daily_trend(p.oee)


@query()
def oee_by_machine(p):
    return reports.oee_by_machine(p.oee)


@query(shared=True)
def station_summary(p):
    return reports.station_summary(p.fleet, p.incidents, p.oee)


@query(shared=True)
def incident_triage(p):
    return reports.incident_triage(p.incidents, p.work_orders).drop("evidence_json")


@query()
def machine_detail(p):
    return reports.machine_detail(p.fleet)


@query(shared=True)
def machine_detail_one(p):
    """The report of one machine."""
    return reports.machine_detail(p.fleet, machine_id="M007")


@query(shared=True)
def incident_triage_filtered(p):
    """The ten most urgent new incidents of the upper severities."""
    return reports.incident_triage(
        p.incidents, p.work_orders, severities=["CRITICAL", "HIGH"], statuses=["NEW"], limit=10
    ).drop("evidence_json")


@query()
def maintenance_log_newest(p):
    """The fifty newest records of the log."""
    return reports.maintenance_log(p.history, p.machines, limit=50).withColumn("cost", F.col("cost").cast("double"))


@query()
def sensor_trend(p):
    return reports.sensor_trend(p.features)


@query(shared=True)
def active_forecasts(p):
    return reports.active_forecasts(p.forecasts)


@query(shared=True)
def recent_deviation(p):
    return reports.recent_deviation(p.recent_features(days=7), as_of=AS_OF)


@query(shared=True)
def similar_cases(p):
    return reports.similar_cases(p.incidents, p.history)


@query()
def similar_repairs(p):
    """For every repair the ten most alike in their words."""
    return similar.similar_repairs(p.history)


@query(shared=True)
def grounding_context(p):
    return reports.grounding_context(p.incidents, p.history).drop("evidence_json")


@query()
def maintenance_log(p):
    return reports.maintenance_log(p.history, p.machines).withColumn(
        "cost", F.col("cost").cast("double")
    )


@query(shared=True)
def work_order_queue(p):
    return reports.work_order_queue(p.work_orders, p.incidents).select(
        *ORDER_COLUMNS, "priority", "problem_description", "predicted_failure_mode",
        "recommended_actions", "evidence_narrative", "incident_health_score", "stage_rank",
    )


@query()
def oee_summary(p):
    return reports.oee_summary(p.oee)


@query()
def oee_overall(p):
    return reports.oee_overall(reports.oee_summary(p.oee))


@query()
def oee_daily(p):
    return reports.oee_daily(p.oee)


@query()
def failure_mode_distribution(p):
    return reports.failure_mode_distribution(p.history)


@query()
def maintenance_cost(p):
    return reports.maintenance_cost(p.history, p.machines)


@query()
def repeat_failures(p):
    return reports.repeat_failures(p.history, p.machines)


@query()
def sensor_freshness(p):
    return reports.sensor_freshness(p.clean, as_of=AS_OF)


@query(shared=True)
def model_versions(p):
    return reports.model_versions(p.forecasts, p.anomalies)


@query(shared=True)
def confidence_distribution(p):
    return reports.confidence_distribution(p.forecasts)


@query(shared=True, as_of=LATER)
def fallback_cases(p):
    """Asked when some machines have no recent data and so no score."""
    return reports.fallback_cases(p.assessments)


# --- checks -----------------------------------------------------------------

@query()
def trend_early_late(p):
    return checks.trend_early_late(p.readings, early_before=EARLY, late_after=LATE)


@query()
def quality_counts(p):
    return checks.quality_counts(p.clean, expected={"STALE": 2})


@query(shared=True)
def assessment_lookup(p):
    return reports.assessment_lookup(p.assessments)


@query(shared=True)
def row_counts(p):
    return checks.row_counts({
        "machines": p.machines, "sensors": p.sensors, "sensor_readings": p.readings,
        "machine_event_logs": p.events, "maintenance_history": p.history,
        "parts_inventory": p.parts, "production_quality": p.production,
        "shift_logs": p.shift_logs, "work_orders": p.work_orders,
        "sensor_readings_clean": p.clean, "machine_health_features": p.features,
        "cross_machine_health": p.fleet, "detected_anomalies": p.anomalies,
        "failure_forecasts": p.forecasts, "failure_assessments": p.assessments,
        "incidents": p.incidents, "maintenance_context": p.maintenance,
    })


@query(shared=True)
def priority_list(p):
    return reports.priority_list(p.incidents)


@query(shared=True)
def priority_check(p):
    return checks.priority_check(p.incidents)


@query()
def oee_check(p):
    return checks.oee_check(p.oee)


# --- preparation ------------------------------------------------------------

@query()
def sensor_registry(p):
    """The catalogue on a registry with a machine for every supplier."""
    return preparation.sensor_registry(
        p.tables.supplier_machines(),
        exclusions=[("PROMO", "RPM"), ("SMALL", "RPM")],
        extras=[
            (rules.PRESSURE_SIGNAL, F.col("machine_type") == "LARGE"),
            (rules.ACOUSTIC_SIGNAL, F.col("criticality") == "HIGH"),
        ],
    )


@query()
def densify(p):
    return preparation.densify(
        p.sensors, p.readings, start=datetime(2024, 1, 1), end=AS_OF, step_minutes=360
    )


@query()
def densify_uneven(p):
    """A step that does not divide the time: the last slot is shorter."""
    return preparation.densify(
        p.sensors, p.readings, start=datetime(2024, 1, 1), end=AS_OF, step_minutes=420
    )


@query()
def classify_shift(p):
    return preparation.classify_shift(p.readings, "reading_timestamp").select(
        "reading_id", "shift", "shift_load"
    )


@query()
def production_calendar(p):
    return preparation.production_calendar(
        p.tables.supplier_machines(), start=CALENDAR_START, days=30,
        exclude_types=["PROMO", "ECONOMY"],
    )


@query()
def derive_quality(p):
    return preparation.derive_quality(p.tables.production_counts()).select(
        "machine_id", "shift", "production_date", "actual_units", "rejected_units",
        "good_units", "quality_deviation",
    )


@query()
def key_checks(p):
    """Keys of every table that declares one, and readings without a sensor."""
    checked = [
        preparation.key_checks(p.machines, ["machine_id"], name="machines"),
        preparation.key_checks(
            p.sensors, ["sensor_id"], name="sensors",
            parent=("machine_id", p.machines, "machine_id"),
        ),
        preparation.key_checks(p.history, ["maintenance_id"], name="maintenance_history"),
        preparation.key_checks(p.parts, ["part_id"], name="parts_inventory"),
        preparation.key_checks(
            p.work_orders, ["work_order_id"], name="work_orders",
            parent=("machine_id", p.machines, "machine_id"),
        ),
        preparation.key_checks(
            p.readings, ["machine_id", "signal_type", "reading_timestamp"],
            name="sensor_readings", parent=("sensor_id", p.sensors, "sensor_id"),
        ),
    ]
    out = checked[0]
    for one in checked[1:]:
        out = out.unionByName(one)
    return out


# --- streams ----------------------------------------------------------------
# Each runs over all that is there and returns what its sink holds.

def _drained(p, stream, name):
    spark = p.machines.sparkSession
    path = fresh_folder(spark, name)
    refresh.run_stream(stream, path, name=name).awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/{name}")


def _arriving(p):
    return p.tables.readings_from(p.tables.stream("events"))


def _arriving_clean(p):
    return windows.stateless_clean(_arriving(p), p.sensors)


@query()
def stream_clean(p):
    return _drained(p, _arriving_clean(p), "clean")


@query()
def stream_hourly_stats(p):
    return _drained(p, windows.hourly_stats_stream(_arriving_clean(p)), "hourly")


@query()
def stream_sliding_mean(p):
    return _drained(p, windows.sliding_mean_stream(_arriving_clean(p)), "sliding")


@query()
def stream_breach_sessions(p):
    return _drained(p, windows.breach_sessions_stream(_arriving_clean(p)), "sessions")


def _in_waves(p, rows, wave, waves, path, handle, name):
    """Rows that arrive in waves, each handled as one micro-batch of one stream."""
    spark, stored = p.machines.sparkSession, f"{path}/arrived"
    for i in range(waves):
        rows.where(wave == i).write.mode("overwrite").parquet(f"{stored}/{i}")
        arriving = spark.readStream.schema(rows.schema).parquet(f"{stored}/*")
        refresh.run_batches(arriving, handle, path, name=name).awaitTermination()


def _decided(p):
    """Commands in four waves, an order's in their order; the second one ends with a new snapshot."""
    spark = p.machines.sparkSession
    path = fresh_folder(spark, "decisions")
    lifecycle.open_orders(p.work_orders, path, buckets=4)

    def handle(batch, batch_id):
        lifecycle.decide_batch(batch, batch_id, root=path, as_of=AS_OF, compact_every=2)

    seq = F.col("command_seq")
    wave = F.when(seq % 2 == 1, F.lit(3)).otherwise(F.floor(seq / 2) % 3)
    _in_waves(p, p.tables.approval_commands(), wave, 4, path, handle, "commands")
    return spark, path


@query()
def stream_decisions(p):
    spark, path = _decided(p)
    return refresh.batches(spark, f"{path}/decisions").drop("batch_id")


@query()
def stream_orders(p):
    spark, path = _decided(p)
    return lifecycle.current_orders(spark, path).select(
        *ORDER_COLUMNS, "approved_by", "approved_at", "updated_at"
    )


WAVES = 4
LAG_SECONDS = 3600


def _refreshed(p, log=False):
    """Readings in four waves by their day, every tenth a wave late; the third wave ends with compaction."""
    spark = p.machines.sparkSession
    path = fresh_folder(spark, "refresh")

    def handle(batch, batch_id):
        refresh.refresh_clean(batch, batch_id, root=path, sensors=p.sensors, compact_every=3)
        if log:
            for name in ("clean", "hourly"):
                refresh.log_refresh(
                    getattr(refresh, f"{name}_table")(batch.sparkSession, path), batch_id, root=path, dataset=name,
                    layer="STAGING", input_rows=batch.count(), target_lag_sec=LAG_SECONDS,
                    refreshed_at=AS_OF + timedelta(minutes=5 * batch_id),
                )

    day = F.least(F.floor((F.dayofmonth("reading_timestamp") - 1) / 8), F.lit(WAVES - 1))
    wave = F.least(day + F.when(F.col("reading_id") % 10 == 7, F.lit(1)).otherwise(F.lit(0)), F.lit(WAVES - 1))
    _in_waves(p, p.readings, wave, WAVES, path, handle, "readings")
    return spark, path


@query()
def stream_refreshed_clean(p):
    return refresh.read_clean(*_refreshed(p))


@query()
def stream_refreshed_hourly(p):
    return refresh.read_hourly(*_refreshed(p))


@query()
def stream_refreshed_fleet(p):
    spark, path = _refreshed(p)
    refresh.refresh_fleet(
        WAVES - 1, spark=spark, root=path, machines=p.machines, events=p.events, as_of=AS_OF,
    )
    return refresh.read_fleet(spark, path)


@query()
def pipeline_status(p):
    """The status of datasets that a refresh in four batches wrote, from the log it left."""
    spark, path = _refreshed(p, log=True)
    return reports.pipeline_status(store.read_table(spark, path, "refresh_log"), as_of=AS_OF)


@query(shared=True)
def stream_notifications(p):
    """Incidents written out as files, read as a stream and announced once each."""
    spark = p.machines.sparkSession
    path = fresh_folder(spark, "incidents")
    for repeat in range(2):
        p.incidents.drop("evidence_json").write.mode("overwrite").parquet(f"{path}/in/{repeat}")
    arriving = spark.readStream.schema(p.incidents.drop("evidence_json").schema).parquet(f"{path}/in/*")
    return _drained(p, windows.notification_stream(arriving), "notices")


def _cycled(p):
    """Three cycles, each over the incidents of all waves so far, the last one run twice."""
    spark = p.machines.sparkSession
    path = fresh_folder(spark, "cycles")
    known = p.incidents.drop("evidence_json").withColumn("wave", F.substring("incident_id", 5, 9).cast("int") % 3)
    known.write.parquet(f"{path}/incidents")
    stored = spark.read.schema(known.schema).parquet(f"{path}/incidents")

    def incidents_at(batch, batch_id):
        return stored.where(F.col("wave") <= batch_id), AS_OF + timedelta(minutes=5 * batch_id)

    for wave in range(3):
        stored.where(F.col("wave") == wave).write.mode("overwrite").parquet(f"{path}/arrived/{wave}")
        ticks = spark.readStream.schema(known.schema).parquet(f"{path}/arrived/*")
        cycle.run_cycles(ticks, incidents_at, path).awaitTermination()
    incidents_now, as_of = incidents_at(None, 2)
    cycle.run_cycle(incidents_now, path, as_of=as_of, cycle=f"cycle-{2:08}")
    return spark, path


@query(shared=True)
def stream_cycle(p):
    """What the cycles announced, each incident once, with the time of its cycle."""
    spark, path = _cycled(p)
    return store.read_table(spark, path, "notification_log").select(
        "notification_type", "reference_id", "machine_id", "severity", "message", "sent_at", "status"
    )


@query(shared=True)
def stream_cycle_log(p):
    return cycle.read_cycles(*_cycled(p))
