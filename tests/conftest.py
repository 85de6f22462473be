import os
import re
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def frame(spark):
    """A frame from a DDL schema and rows; strings become moments or dates as needed."""
    from datetime import date, datetime

    def make(schema, *rows):
        kinds = [field.strip().split()[-1] for field in re.split(r",\s*(?![^(]*\))", schema)]

        def cell(value, kind):
            if isinstance(value, str) and kind == "timestamp_ntz":
                return datetime.fromisoformat(value)
            if isinstance(value, str) and kind == "date":
                return date.fromisoformat(value)
            return value

        return spark.createDataFrame(
            [tuple(cell(v, k) for v, k in zip(row, kinds)) for row in rows], schema
        )

    return make


@pytest.fixture(scope="session")
def plan_of():
    """The physical plan as text."""

    def text(df):
        return df._jdf.queryExecution().executedPlan().toString()

    return text
