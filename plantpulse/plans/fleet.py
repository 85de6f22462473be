"""The datasets of a fleet, each defined from the ones before it.

Nothing runs until a dataset is read. With ``stored`` the datasets that several
later ones read are kept as tables in that folder: hourly features by day, so
that who asks for the last hours reads the last days, and the maintenance
background. What is there is read back, by any plan on the same folder;
``refresh()`` computes it anew. ``shared=True`` is a folder of the plan's own.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta
from functools import cached_property

from pyspark.sql import Column, DataFrame

from plantpulse.operators import (
    anomalies, assessments, context, features, forecasts, health, incidents, production, readings,
)
from plantpulse.operators.durable import fresh_folder
from plantpulse.sources.snapshots import SnapshotTable, bucket_of, day_of


class FleetPlan:
    """Datasets derived from stored tables as they stood at ``as_of``."""

    def __init__(
        self, tables, *, as_of: datetime, shared: bool = False, stored: str | None = None,
        ordering: str = "lexical", confidence_scope: str = "predicted", history: dict | None = None,
    ):
        self.tables = tables
        self.as_of = as_of
        self.shared = shared
        self.stored = stored
        self.ordering = ordering
        self.confidence_scope = confidence_scope
        self.history_options = history or {}

    def _table(self, name: str, key: list[str], part: Column, time: str | None = None) -> SnapshotTable | None:
        """A derived table of the stored folder; none where the plan keeps nothing."""
        spark = self.machines.sparkSession
        if self.stored is None:
            if not self.shared:
                return None
            self.stored = fresh_folder(spark, "fleet")
        return SnapshotTable(spark, f"{self.stored}/{name}", key=key, part=part, time=time)

    def _kept(self, table: SnapshotTable | None, make: Callable[[], DataFrame]) -> DataFrame:
        if table is None:
            return make()
        if table.step() is None:
            table.replace(make())
        return table.read()

    def refresh(self) -> None:
        """Compute the stored tables anew; readers of the folder see the old ones until each is done."""
        for table, make in ((self.features_table, self._features), (self.maintenance_table, self._maintenance)):
            if table is not None:
                table.replace(make())
        for name in ("features", "latest", "scores", "fleet", "maintenance", "anomalies", "rollup", "daily"):
            self.__dict__.pop(name, None)

    # stored tables
    @cached_property
    def machines(self) -> DataFrame:
        return self.tables.machines()

    @cached_property
    def sensors(self) -> DataFrame:
        return self.tables.sensors()

    @cached_property
    def readings(self) -> DataFrame:
        return self.tables.sensor_readings()

    @cached_property
    def events(self) -> DataFrame:
        return self.tables.machine_event_logs()

    @cached_property
    def history(self) -> DataFrame:
        return self.tables.maintenance_history()

    @cached_property
    def shift_logs(self) -> DataFrame:
        return self.tables.shift_logs()

    @cached_property
    def production(self) -> DataFrame:
        return self.tables.production_quality()

    @cached_property
    def parts(self) -> DataFrame:
        return self.tables.parts_inventory()

    @cached_property
    def work_orders(self) -> DataFrame:
        return self.tables.work_orders()

    # telemetry
    @cached_property
    def joined(self) -> DataFrame:
        return readings.attach_sensors(self.readings, self.sensors)

    @cached_property
    def clean(self) -> DataFrame:
        return readings.clean_readings(self.readings, self.sensors, **self.history_options)

    @cached_property
    def hourly(self) -> DataFrame:
        return features.hourly_stats(self.clean)

    @cached_property
    def features_table(self) -> SnapshotTable | None:
        return self._table("features", [*features.SERIES, "hour_bucket"], day_of("hour_bucket"), "hour_bucket")

    def _features(self) -> DataFrame:
        return features.rolling_features(self.hourly)

    @cached_property
    def features(self) -> DataFrame:
        return self._kept(self.features_table, self._features)

    def recent_features(self, **span) -> DataFrame:
        """Features from the days of a time span up to the as-of time; of a stored table only those days are read."""
        whole = self.features
        if self.features_table is None:
            return whole
        first = (self.as_of - timedelta(**span)).date().isoformat()
        return self.features_table.read(first, self.as_of.date().isoformat())

    @cached_property
    def context(self) -> DataFrame:
        return context.operating_context(
            self.machines, self.events, self.readings, as_of=self.as_of
        )

    @cached_property
    def latest(self) -> DataFrame:
        return health.latest_signal_features(self.recent_features(hours=24), as_of=self.as_of)

    @cached_property
    def scores(self) -> DataFrame:
        return health.signal_health_score(self.latest)

    @cached_property
    def fleet(self) -> DataFrame:
        return health.fleet_health(self.machines, self.context, self.scores, as_of=self.as_of)

    @cached_property
    def maintenance_table(self) -> SnapshotTable | None:
        return self._table("maintenance", ["machine_id"], bucket_of("machine_id", 1))

    def _maintenance(self) -> DataFrame:
        return context.maintenance_context(
            self.fleet, self.history, self.shift_logs, self.production, self.events,
            self.machines, self.parts, as_of=self.as_of,
        )

    @cached_property
    def maintenance(self) -> DataFrame:
        return self._kept(self.maintenance_table, self._maintenance)

    # prediction
    @cached_property
    def anomalies(self) -> DataFrame:
        return anomalies.detect_anomalies(self.recent_features(days=7), as_of=self.as_of)

    @cached_property
    def rollup(self) -> DataFrame:
        return anomalies.anomaly_rollup(self.anomalies, as_of=self.as_of)

    @cached_property
    def daily(self) -> DataFrame:
        return forecasts.daily_trends(self.features)

    @cached_property
    def forecasts(self) -> DataFrame:
        return forecasts.failure_forecasts(self.daily, self.sensors, as_of=self.as_of)

    @cached_property
    def evidence(self) -> DataFrame:
        return assessments.machine_evidence(
            self.forecasts, self.maintenance,
            ordering=self.ordering, confidence_scope=self.confidence_scope,
        )

    @cached_property
    def assessments(self) -> DataFrame:
        return assessments.failure_assessments(
            self.forecasts, self.maintenance, as_of=self.as_of,
            ordering=self.ordering, confidence_scope=self.confidence_scope,
        )

    @cached_property
    def incidents(self) -> DataFrame:
        return incidents.build_incidents(
            self.assessments, self.maintenance, self.rollup, as_of=self.as_of
        )

    # production
    @cached_property
    def oee(self) -> DataFrame:
        return production.oee_metrics(self.production, self.machines)
