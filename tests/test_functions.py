from datetime import datetime

import pytest
from pyspark.sql import functions as F

from plantpulse import functions as fn
from plantpulse.functions.keys import incident_key, order_key


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def ts(text):
    return F.lit(text).cast("timestamp_ntz")


@pytest.mark.parametrize("value,digits,expected", [
    (1.005, 2, 1.01), (-1.005, 2, -1.01), (2.5, 0, 3.0), (0.1 + 0.2, 1, 0.3), (None, 2, None),
])
def test_half_up(spark, value, digits, expected):
    assert one(spark, fn.half_up(F.lit(value).cast("double"), digits)) == expected


def test_ratio_by_zero_is_null(spark):
    assert one(spark, fn.ratio(F.lit(1), F.lit(0))) is None


@pytest.mark.parametrize("value,expected", [(0, 0), (1, 10), (3, 10), (4, 20), (-4, 20), (None, 0)])
def test_step_points(spark, value, expected):
    assert one(spark, fn.step_points(F.lit(value).cast("int"), ((3, 20), (0, 10)))) == expected


@pytest.mark.parametrize("value,expected", [
    (80, "HEALTHY"), (79.9, "WARNING"), (40, "DEGRADED"), (39, "CRITICAL"), (None, "CRITICAL"),
])
def test_level(spark, value, expected):
    bands = ((80, "HEALTHY"), (60, "WARNING"), (40, "DEGRADED"))
    assert one(spark, fn.level(F.lit(value).cast("double"), bands, "CRITICAL")) == expected


def test_texts(spark):
    assert one(spark, fn.scaled_text(F.lit(0.3), 2)) == "0.30"
    assert one(spark, fn.plain_number(F.lit(77.0), 1)) == "77"
    assert one(spark, fn.plain_number(F.lit(82.5), 1)) == "82.5"
    assert one(spark, fn.plain_number(F.lit(100.0), 1)) == "100"


def test_values_with_defaults(spark):
    assert one(spark, fn.number_or(F.lit("2.5"))) == 2.5
    assert one(spark, fn.number_or(F.lit("n/a"), 7)) == 7.0
    assert one(spark, fn.number_or(F.lit(None).cast("double"))) == 0.0
    assert one(spark, fn.text_or(F.lit(None).cast("string"))) == "N/A"
    assert one(spark, fn.text_or(F.lit(3))) == "3"


def test_keys_keep_all_digits(spark):
    assert one(spark, incident_key(F.lit(7))) == "INC-007"
    assert one(spark, incident_key(F.lit(12345))) == "INC-12345"
    assert one(spark, order_key(F.lit(12345))) == "WO-12345"


def test_boundaries_are_counted(spark):
    a, b = ts("2024-01-01 00:59:59.9"), ts("2024-01-01 01:00:01.1")
    assert one(spark, fn.hours_between(a, b)) == 1
    assert one(spark, fn.minutes_between(a, b)) == 1
    assert one(spark, fn.epoch_seconds(b) - fn.epoch_seconds(a)) == 2
    assert one(spark, fn.days_between(ts("2024-01-01 23:59:59"), ts("2024-01-02"))) == 1


def test_floors_do_not_depend_on_the_zone(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        # an hour that does not exist there, and one that exists twice
        for text in ("2024-03-10 02:30:15.5", "2024-11-03 01:30:00"):
            moment = datetime.fromisoformat(text)
            floor = moment.replace(minute=0, second=0, microsecond=0)
            assert one(spark, fn.hour_floor(ts(text))) == floor
            assert one(spark, fn.day_floor(ts(text))) == floor.replace(hour=0)
            seconds = int((moment - datetime(1970, 1, 1)).total_seconds())
            assert one(spark, fn.epoch_seconds(ts(text))) == seconds
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
