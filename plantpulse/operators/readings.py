"""Checks and normalisation of sensor readings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from plantpulse import rules
from plantpulse.functions import epoch_seconds, half_up, level
from plantpulse.operators.slices import HOT_ROWS, SLICE_ROWS, with_last_state, with_lookback

# Differences below this are rounding noise of a mean over four-decimal readings.
NOISE = 1e-9


def attach_sensors(readings: DataFrame, sensors: DataFrame) -> DataFrame:
    """Readings with their sensor's unit, limits and interval; unknown sensors drop out."""
    return readings.join(
        sensors.select(
            "sensor_id", "unit", "warning_threshold", "critical_threshold",
            "sampling_interval_sec",
        ),
        "sensor_id",
    )


def _celsius(value: Column) -> Column:
    fahrenheit = (F.col("signal_type") == "TEMPERATURE") & (F.col("unit") == "F")
    return F.when(fahrenheit, half_up((value - 32) * 5.0 / 9.0, 2)).otherwise(value)


def _status(value: Column) -> Column:
    return (
        F.when(value >= F.col("critical_threshold"), F.lit("CRITICAL"))
        .when(value >= F.col("warning_threshold"), F.lit("WARNING"))
        .otherwise(F.lit("NORMAL"))
    )


def _flag(value: Column) -> Column:
    return F.when(value.isNull(), F.lit("MISSING")).otherwise(F.col("quality_flag"))


def normalize_units(joined: DataFrame) -> DataFrame:
    return joined.withColumn("normalized_value", _celsius(F.col("reading_value")))


def threshold_status(joined: DataFrame) -> DataFrame:
    return joined.withColumn("threshold_status", _status(F.col("reading_value")))


def quality_flag(joined: DataFrame) -> DataFrame:
    return joined.withColumn("quality_flag", _flag(F.col("reading_value")))


def reading_history(
    readings: DataFrame,
    *,
    sigma: float = rules.SPIKE_SIGMA,
    lookback: int = rules.SPIKE_LOOKBACK,
    hot_rows: int = HOT_ROWS,
    slice_rows: int = SLICE_ROWS,
    changed: str | None = None,
    sizes: DataFrame | None = None,
) -> DataFrame:
    """Adds the gap to the sensor's previous reading and the spike flag.

    Runs before the sensor join, so that the one shuffle is on (sensor, slice)
    and a large registry cannot force a shuffle on the sensor alone. ``changed``
    names a flag of new readings: only these and the ``lookback`` after each,
    whose flags they change, are kept. ``sizes`` are the rows of every sensor
    (``_n``), where they are known already.
    """
    carried = ["reading_value", *([changed] if changed else [])]
    rows = with_lookback(
        readings, key="sensor_id", ts="reading_timestamp", tie="reading_id",
        carried=carried, lookback=lookback, hot_rows=hot_rows, slice_rows=slice_rows, sizes=sizes,
    )
    by_sensor = Window.partitionBy("sensor_id", "_slice").orderBy("reading_timestamp", "reading_id")
    recent = by_sensor.rowsBetween(-lookback, -1)
    value = F.col("reading_value")
    previous = F.lag("reading_timestamp").over(by_sensor)
    touched = F.max(changed).over(by_sensor.rowsBetween(-lookback, 0)) if changed else F.lit(True)
    return (
        rows.select(
            "*",
            previous.alias("_previous"),
            F.avg(value).over(recent).alias("_mean"),
            F.stddev_samp(value).over(recent).alias("_sd"),
            touched.alias("_touched"),
        )
        .where(~F.col("_before") & F.col("_touched"))
        .withColumns({
            "gap_seconds": epoch_seconds(F.col("reading_timestamp"))
            - epoch_seconds(F.col("_previous")),
            "is_spike": F.coalesce(
                F.abs(value - F.col("_mean")) > F.col("_sd") * sigma + NOISE, F.lit(False)
            ),
        })
        .drop("_slice", "_before", "_previous", "_mean", "_sd", "_touched")
    )


def _stale(factor: float) -> Column:
    return F.coalesce(
        F.col("gap_seconds") > F.col("sampling_interval_sec") * factor, F.lit(False)
    )


def stale_gap(
    readings: DataFrame, sensors: DataFrame, *, stale_factor: float = rules.STALE_FACTOR, **history
) -> DataFrame:
    """Readings whose sensor had been silent for several sampling intervals."""
    joined = attach_sensors(reading_history(readings, **history), sensors)
    return joined.select(
        "reading_id", "sensor_id", "reading_timestamp", "gap_seconds",
        _stale(stale_factor).alias("is_stale"),
    )


def spike_flag(readings: DataFrame, sensors: DataFrame, **history) -> DataFrame:
    """Readings far outside the sensor's preceding readings."""
    joined = attach_sensors(reading_history(readings, **history), sensors)
    return joined.select("reading_id", "sensor_id", "reading_timestamp", "reading_value", "is_spike")


def clean_readings(
    readings: DataFrame,
    sensors: DataFrame,
    *,
    stale_factor: float = rules.STALE_FACTOR,
    compare: str = "raw",
    **history,
) -> DataFrame:
    """The clean table: normalised value, threshold status, stale, spike and quality flags.

    ``compare`` says which value meets the thresholds: ``raw`` (as established)
    or ``normalized``. ``history`` goes to :func:`reading_history`.
    """
    joined = attach_sensors(reading_history(readings, **history), sensors)
    value = F.col("reading_value")
    compared = _celsius(value) if compare == "normalized" else value
    return joined.select(
        "reading_id", "sensor_id", "machine_id", "signal_type", "reading_timestamp",
        value.alias("raw_value"),
        _flag(value).alias("quality_flag"),
        _celsius(value).alias("normalized_value"),
        _status(compared).alias("threshold_status"),
        _stale(stale_factor).alias("is_stale"),
        "is_spike", "warning_threshold", "critical_threshold", "unit",
    )


def flat_lines(
    readings: DataFrame, *, min_readings: int = 5, tolerance: float = 0.0,
    hot_rows: int = HOT_ROWS, slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """Readings that end a run of ``min_readings`` equal ones: a stuck sensor."""
    rows = with_lookback(
        readings, key="sensor_id", ts="reading_timestamp", tie="reading_id",
        carried=["reading_value"], lookback=min_readings - 1,
        hot_rows=hot_rows, slice_rows=slice_rows,
    )
    run = (
        Window.partitionBy("sensor_id", "_slice")
        .orderBy("reading_timestamp", "reading_id")
        .rowsBetween(1 - min_readings, 0)
    )
    spread = F.max("reading_value").over(run) - F.min("reading_value").over(run)
    return (
        rows.select("*", F.count("reading_value").over(run).alias("_n"), spread.alias("_spread"))
        .where(~F.col("_before"))
        .select(
            "reading_id", "sensor_id", "machine_id", "signal_type", "reading_timestamp",
            "reading_value",
            F.coalesce((F.col("_n") == min_readings) & (F.col("_spread") <= tolerance), F.lit(False))
            .alias("is_flat"),
        )
    )


def suppress_offline(
    readings: DataFrame, events: DataFrame, machines: DataFrame, **slicing
) -> DataFrame:
    """Marks readings taken while their machine was down.

    A machine is down from a SHUTDOWN until its next state event, or always
    while it is registered as offline or in maintenance.
    """
    states = events.where(F.col("event_type").isin(*rules.STATE_EVENTS)).select(
        "machine_id", "event_id", F.col("event_timestamp").alias("reading_timestamp"),
        F.col("event_type").alias("_state"),
    )
    registered = machines.select(
        "machine_id", F.col("operating_state").isin(*rules.SUPPRESSED_STATES).alias("_out")
    )
    stated = with_last_state(
        readings, states, key="machine_id", ts="reading_timestamp", tie="event_id",
        state="_state", **slicing,
    )
    return (
        stated.join(registered, "machine_id", "left")
        .withColumn(
            "suppressed",
            F.coalesce((F.col("_state") == "SHUTDOWN") | F.col("_out"), F.col("_out"), F.lit(False)),
        )
        .drop("_state", "_out")
    )
