"""Deriving registries, calendars and checked tables."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, datetime

from pyspark.sql import Column, DataFrame, functions as F

from plantpulse import rules
from plantpulse.functions import as_moment, epoch_seconds, half_up, moment, ratio


def _catalogue(entries: Sequence[tuple]) -> Column:
    """A fixed list of signals as an array column, to be exploded per machine."""
    names = ("signal_type", "unit", "min_threshold", "max_threshold",
             "warning_threshold", "critical_threshold")

    def value(name, v):
        return F.lit(v).cast("string" if name in ("signal_type", "unit") else "double").alias(name)

    return F.array(*[F.struct(*[value(n, v) for n, v in zip(names, e)]) for e in entries])


def sensor_registry(
    machines: DataFrame,
    *,
    catalogue: Sequence[tuple] = rules.CORE_SIGNALS,
    exclusions: Sequence[tuple[str, str]] = (),
    extras: Sequence[tuple[tuple, Column]] = (),
    interval: int = rules.DEFAULT_INTERVAL_SEC,
) -> DataFrame:
    """A sensor for every machine and catalogue signal.

    ``exclusions`` are (machine type, signal) pairs that do not exist;
    ``extras`` are catalogue entries with the machines that also have them.
    The catalogue is a constant exploded on each machine, not a join.
    """
    left_out = F.lit(False)
    for kind, signal in exclusions:
        left_out = left_out | (
            (F.col("machine_type") == kind) & (F.col("s.signal_type") == signal)
        )
    core = machines.select("*", F.explode(_catalogue(catalogue)).alias("s")).where(~left_out)
    parts = [core] + [
        machines.where(has).select("*", F.explode(_catalogue([entry])).alias("s"))
        for entry, has in extras
    ]

    def shaped(part):
        return part.select(
            F.concat(F.col("machine_id"), F.lit("-"), F.col("s.signal_type")).alias("sensor_id"),
            "machine_id", "s.*", F.lit(interval).cast("long").alias("sampling_interval_sec"),
            F.lit(True).alias("is_active"),
        )

    out = shaped(parts[0])
    for part in parts[1:]:
        out = out.unionByName(shaped(part))
    return out


def densify(
    sensors: DataFrame, readings: DataFrame, *, start: datetime, end: datetime, step_minutes: int
) -> DataFrame:
    """Every sensor and time slot from ``start`` to before ``end``, with the slot's mean.

    The last slot may be shorter than the step. Readings are averaged per slot
    before the join, so each side has at most one row per sensor and slot.
    """
    first, last = as_moment(start), as_moment(end)
    slots = F.sequence(
        moment(first), moment(last) - F.expr("interval 1 microsecond"),
        F.make_dt_interval(mins=F.lit(step_minutes)),
    )
    grid = sensors.select("sensor_id", "machine_id", "signal_type", F.explode(slots).alias("slot"))
    width = step_minutes * 60
    offset = F.floor((epoch_seconds(F.col("reading_timestamp")) - epoch_seconds(moment(first))) / width)
    filled = (
        readings.where((F.col("reading_timestamp") >= moment(first))
                       & (F.col("reading_timestamp") < moment(last)))
        .groupBy("sensor_id", offset.alias("_slot"))
        .agg(F.count("*").alias("readings"), half_up(F.avg("reading_value"), 4).alias("slot_avg"))
        .withColumn(
            "slot",
            moment(first) + F.make_dt_interval(secs=(F.col("_slot") * width).cast("decimal(18,6)")),
        )
        .drop("_slot")
    )
    return grid.join(filled, ["sensor_id", "slot"], "left").select(
        "sensor_id", "machine_id", "signal_type", "slot",
        F.coalesce("readings", F.lit(0)).alias("readings"), "slot_avg",
        F.col("readings").isNull().alias("is_missing"),
    )


def classify_shift(df: DataFrame, ts_col: str) -> DataFrame:
    """Load class of the hour: 6 to 14, then to 22, then the rest; a bound goes to the earlier."""
    hour = F.hour(ts_col)
    return df.withColumns({
        "shift": F.when(hour.between(6, 14), F.lit("DAY"))
        .when(hour.between(14, 22), F.lit("SWING")).otherwise(F.lit("NIGHT")),
        "shift_load": F.when(hour.between(6, 14), F.lit(1.1))
        .when(hour.between(14, 22), F.lit(1.0)).otherwise(F.lit(0.7)),
    })


def production_calendar(
    machines: DataFrame, *, start: date, days: int,
    shifts: Sequence[str] = rules.SHIFT_ORDER, exclude_types: Sequence[str] = (),
) -> DataFrame:
    """Machine by shift by day, without machine types that do not produce."""
    first = F.lit(start.isoformat()).cast("date")
    working = machines.where(~F.col("machine_type").isin(*exclude_types)) if exclude_types else machines
    return working.select(
        "machine_id", F.explode(F.array(*[F.lit(s) for s in shifts])).alias("shift")
    ).select(
        "machine_id", "shift",
        F.explode(F.sequence(first, F.date_add(first, days - 1))).alias("production_date"),
    )


def derive_quality(production: DataFrame) -> DataFrame:
    """Good units and the share rejected; no share where nothing was made."""
    made, lost = F.col("actual_units"), F.col("rejected_units")
    return production.withColumns({
        "good_units": made - lost,
        "quality_deviation": half_up(ratio(lost, made), 4),
    })


def duplicate_keys(df: DataFrame, key: Sequence[str]) -> DataFrame:
    return df.groupBy(*key).agg(F.count("*").alias("copies")).where(F.col("copies") > 1)


def orphans(df: DataFrame, column: str, parent: DataFrame, parent_key: str) -> DataFrame:
    keys = parent.select(F.col(parent_key).alias(column))
    return df.where(F.col(column).isNotNull()).join(keys, column, "left_anti")


def key_checks(
    df: DataFrame, key: Sequence[str], *, name: str, parent: tuple[str, DataFrame, str] | None = None
) -> DataFrame:
    """Rows, repeated keys and rows without their parent, in one row."""
    rows = df.agg(F.count("*").alias("row_count")).withColumn("table_name", F.lit(name))
    repeated = duplicate_keys(df, key).select(F.count("*")).scalar()
    lost = F.lit(0).cast("long")
    if parent is not None:
        column, table, parent_key = parent
        lost = orphans(df, column, table, parent_key).select(F.count("*")).scalar()
    return rows.select(
        "table_name", "row_count", repeated.alias("duplicate_keys"), lost.alias("orphan_rows")
    ).withColumn("passed", (F.col("duplicate_keys") == 0) & (F.col("orphan_rows") == 0))
