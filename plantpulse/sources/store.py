"""Reading and writing the stored tables as parquet datasets."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from plantpulse.sources.schemas import DEFAULTS, SURROGATES, TABLES


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder of whatever store the path is in; none if it is not there."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = place.getFileSystem(spark._jsc.hadoopConfiguration())
    return [f.getPath().getName() for f in store.listStatus(place)] if store.exists(place) else []


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A stored table; readings by day, so that days are pruned, others with all their runs."""
    reader = spark.read.schema(TABLES[name])
    if name != "sensor_readings":
        reader = reader.option("recursiveFileLookup", "true")
    return reader.parquet(f"{root}/{name}")


class StoredTables:
    """The stored tables under one root, by the names the plans ask for."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root

    def __getattr__(self, name: str):
        if name not in TABLES:
            raise AttributeError(name)
        return lambda: read_table(self.spark, self.root, name)


def conform(df: DataFrame, name: str) -> DataFrame:
    """Bring a frame to a table's declared columns, filling defaults and row numbers."""
    schema = TABLES[name]
    defaults = DEFAULTS.get(name, {})
    number, natural = SURROGATES.get(name, (None, None))
    present = set(df.columns)

    def column(field):
        value = F.col(field.name) if field.name in present else F.lit(None)
        if field.name in defaults:
            value = F.coalesce(value, F.lit(defaults[field.name]))
        if field.name == number:
            value = F.coalesce(value.cast("long"), F.xxhash64(*natural))
        return value.cast(field.dataType).alias(field.name)

    return df.select(*[column(field) for field in schema])


def replace_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def append_table(df: DataFrame, name: str, root: str, run: str | None = None) -> None:
    """Add rows to a table. A run that is repeated under its name replaces what it had added."""
    place = f"{root}/{name}/run={run or uuid.uuid4().hex}"
    conform(df, name).write.mode("overwrite").parquet(place)


def read_runs(
    spark: SparkSession, root: str, name: str, *, without: str | None = None, only: str | None = None
) -> DataFrame:
    """The runs of an appended table: all, all but one, or one; no rows where none was added yet."""
    runs = [r for r in children(spark, f"{root}/{name}") if r.startswith("run=")]
    chosen = [r for r in runs if r != f"run={without}" and only in (None, r[4:])]
    if not chosen:
        return spark.createDataFrame([], TABLES[name])
    reader = spark.read.schema(TABLES[name]).option("recursiveFileLookup", "true")
    return reader.parquet(*[f"{root}/{name}/{r}" for r in chosen])


def write_readings(readings: DataFrame, path: str, slices_per_day: int = 1) -> None:
    """Store readings by day, sorted by machine and time inside each file.

    The range partitioning works on (day, machine, time), so a day or a machine
    that holds much of the data is spread over several tasks. ``slices_per_day``
    only raises the number of tasks; it does not change what is written.
    """
    spark = readings.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions")) * slices_per_day
    (
        conform(readings, "sensor_readings")
        .withColumn("reading_date", F.col("reading_timestamp").cast("date"))
        .repartitionByRange(tasks, "reading_date", "machine_id", "reading_timestamp")
        .sortWithinPartitions("reading_date", "machine_id", "reading_timestamp")
        .write.mode("overwrite")
        .partitionBy("reading_date")
        .parquet(path)
    )


def literal_rows(spark: SparkSession, rows: Sequence[tuple], name: str) -> DataFrame:
    """A small table given by hand, with defaults filled in."""
    return spark.createDataFrame(rows, TABLES[name])


def patch(df: DataFrame, changes: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """New snapshot of ``df`` in which ``changes`` replaces the given columns.

    ``changes`` holds at most one row per key. A NULL in it is written too.
    """
    renamed = changes.select(
        F.col(key), F.lit(True).alias("_hit"), *[F.col(c).alias(f"_new_{c}") for c in columns]
    )
    joined = df.join(renamed, key, "left")
    replaced = {
        c: F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)) for c in columns
    }
    return joined.withColumns(replaced).select(*df.columns)


def preview(df: DataFrame, rows: int = 1000):
    """At most ``rows`` rows as a local frame, for display only."""
    return df.limit(rows).toPandas()
