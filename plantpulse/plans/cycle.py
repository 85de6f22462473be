"""The regular maintenance cycle: announce new serious incidents and sum up."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from plantpulse.functions import moment
from plantpulse.operators.incidents import cycle_summary, incident_notifications
from plantpulse.sources.store import append_table, read_runs
from plantpulse.streaming.refresh import run_batches


def run_cycle(
    incidents: DataFrame, root: str, *, as_of: datetime, cycle: str, log: DataFrame | None = None
) -> DataFrame:
    """Log a message for each new serious incident that no other cycle announced; give the summary.

    The messages of a cycle are one run of the log and its summary one run of
    the cycle log, both named by ``cycle``: a repeated cycle reads the log
    without its own messages and replaces them, so nothing is said twice.
    ``log`` is what was announced elsewhere.
    """
    spark = incidents.sparkSession
    said = read_runs(spark, root, "notification_log", without=cycle)
    if log is not None:
        said = said.select("reference_id", "severity").unionByName(log.select("reference_id", "severity"))
    messages = incident_notifications(incidents, said).withColumn("sent_at", moment(as_of))
    append_table(messages, "notification_log", root, run=cycle)
    written = read_runs(spark, root, "notification_log", only=cycle)
    summary = cycle_summary(incidents, written)
    append_table(
        summary.withColumns({"cycle_id": F.lit(cycle), "as_of": moment(as_of)}).coalesce(1), "cycle_log", root, run=cycle
    )
    return summary


def read_cycles(spark: SparkSession, root: str) -> DataFrame:
    return read_runs(spark, root, "cycle_log")


def run_cycles(
    ticks: DataFrame, incidents_at: Callable[[DataFrame, int], tuple[DataFrame, datetime]], root: str,
    *, name: str = "cycle", every: str | None = None,
) -> StreamingQuery:
    """A cycle for every micro-batch of a stream: with ``every`` on a fixed interval, else over all that is there.

    ``incidents_at`` gives the incidents and the time of a cycle from its batch
    and number. Any stream can set the pace: a rate source for a plain clock, or
    the refreshes of the fleet. The number of the batch names the cycle, and a
    batch that is repeated after a restart repeats its cycle.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        incidents, as_of = incidents_at(batch, batch_id)
        run_cycle(incidents, root, as_of=as_of, cycle=f"{name}-{batch_id:08}")

    return run_batches(ticks, handle, root, name=name, every=every)
