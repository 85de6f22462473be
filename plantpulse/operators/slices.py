"""Row look-back windows that stay balanced when one key holds much of the data.

A window over a key puts all rows of that key into one task. Keys above
``hot_rows`` are therefore cut in time into slices of about ``slice_rows`` rows,
and each slice is given the last rows before it, so that a frame of
``lookback`` preceding rows sees exactly what it would see in one piece.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from plantpulse.functions import epoch_seconds
from plantpulse.operators.durable import durable

HOT_ROWS = 8_000_000
SLICE_ROWS = 1_000_000
#: Most keys that are cut, and most cuts of all keys together: what is broadcast has a bound at any size.
HOT_KEYS, CUTS = 100_000, 4_000_000


def hot_spans(
    rows: DataFrame, key: str, ts: str, hot_rows: int, slice_rows: int, sizes: DataFrame | None = None
) -> DataFrame | None:
    """The times at which the rows of every hot key are cut: ``_cuts``, ascending; None if no key is hot.

    One pass counts the rows of every key, before anything else is planned, and
    in the normal case that is all; none where ``sizes`` (key, ``_n``) are given. Keys with more than ``hot_rows`` rows are hot,
    or with more than a ``HOT_KEYS``-th of all rows if that is more. Their rows
    are counted by hour, and hours that hold more than a slice by second; a cut
    is made wherever the running count passes a multiple of ``slice_rows`` (or of
    a ``CUTS``-th of all rows if that is more). A slice so holds at most twice as
    many rows, however bunched they are; only rows of one second stay together.
    """
    if sizes is None:
        sizes = rows.groupBy(key).agg(F.count("*").alias("_n"))
    most, total = sizes.agg(F.max("_n"), F.sum("_n")).first()
    limit = max(hot_rows, (total or 0) / HOT_KEYS)
    if (most or 0) <= limit:
        return None
    each = max(slice_rows, (total + CUTS - 1) // CUTS)
    hot = rows.join(F.broadcast(sizes.where(F.col("_n") > limit).select(key)), key)
    second = epoch_seconds(F.col(ts))
    hours = hot.groupBy(key, F.floor(second / 3600).alias("_hour")).agg(F.count("*").alias("_n"))
    # An hour that holds more than a slice: fewer of them than cuts.
    full = F.broadcast(hours.where(F.col("_n") > each).select(key, "_hour"))
    seconds = (
        hot.select(key, second.alias("_from"), F.floor(second / 3600).alias("_hour"))
        .join(full, [key, "_hour"], "left_semi").groupBy(key, "_from").agg(F.count("*").alias("_n"))
    )
    counted = hours.where(F.col("_n") <= each).select(key, (F.col("_hour") * 3600).alias("_from"), "_n").unionByName(seconds)
    by_time = Window.partitionBy(key).orderBy("_from")
    before = F.sum("_n").over(by_time.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")
    slices = counted.withColumn("_slice", F.floor(before / each))
    starts = slices.withColumn("_starts", F.col("_slice") > F.coalesce(F.lag("_slice").over(by_time), F.lit(0)))
    return durable(starts.groupBy(key).agg(F.sort_array(F.collect_list(F.when(F.col("_starts"), F.col("_from")))).alias("_cuts")))


def with_slice(rows: DataFrame, ts: str) -> DataFrame:
    """``_slice`` in place of ``_cuts``: how many of them are at or before a row's time; none if it has no cuts.

    Found by halving, one projection a step. All steps are generated code behind
    the join, so a row costs the same however many cuts there are: neither is the
    list gone through nor copied into a row, as a lambda over it would do.
    """
    rows = rows.withColumns({"_second": epoch_seconds(F.col(ts)), "_slice": F.lit(0)})
    for step in (1 << k for k in reversed(range(CUTS.bit_length()))):
        further = F.col("_slice") + F.lit(step)
        passed = F.get("_cuts", further - 1) <= F.col("_second")  # null beyond the last cut
        rows = rows.withColumn("_slice", F.when(passed, further).otherwise(F.col("_slice")))
    return rows.withColumn("_slice", F.col("_slice").cast("long")).drop("_second", "_cuts")


def with_lookback(
    rows: DataFrame,
    *,
    key: str,
    ts: str,
    tie: str,
    carried: Sequence[str],
    lookback: int,
    hot_rows: int = HOT_ROWS,
    slice_rows: int = SLICE_ROWS,
    sizes: DataFrame | None = None,
) -> DataFrame:
    """``rows`` plus ``_slice`` and, for slices of hot keys, the rows before them.

    Rows repeated from an earlier slice carry ``_before = true`` and only the
    columns ``key``, ``ts``, ``tie`` and ``carried``; a window partitioned by
    (key, _slice) reads them, then the caller drops them.
    """
    spans = hot_spans(rows, key, ts, hot_rows, slice_rows, sizes)
    if spans is None:
        return rows.withColumns({"_slice": F.lit(0).cast("long"), "_before": F.lit(False)})
    marked = with_slice(rows.join(F.broadcast(spans), key, "left"), ts).withColumn("_before", F.lit(False))

    inner = [ts, tie, *[c for c in carried if c not in (ts, tie)]]
    newest_first = Window.partitionBy(key, "_slice").orderBy(F.desc(ts), F.desc(tie))
    tails = (
        with_slice(rows.select(key, *inner).join(F.broadcast(spans), key), ts)
        .withColumn("_rn", F.row_number().over(newest_first))
        .where(F.col("_rn") <= lookback)
        .groupBy(key, "_slice")
        .agg(F.sort_array(F.collect_list(F.struct(*inner)), asc=False).alias("_tail"))
    )
    # A slice takes as many tails before it as make up ``lookback`` rows, found by the rows held before each.
    by_slice = Window.partitionBy(key).orderBy("_slice")
    held = F.sum(F.size("_tail")).over(by_slice) - F.size("_tail")
    reach = Window.partitionBy(key).orderBy("_held").rangeBetween(1 - max(lookback, 1), 0)
    carried_rows = (
        tails.select(key, "_slice", F.lag("_tail").over(by_slice).alias("_given"), held.alias("_held"))
        .withColumn("_tails", F.reverse(F.collect_list("_given").over(reach)))
        .select(key, "_slice", F.explode(F.slice(F.flatten("_tails"), 1, lookback)).alias("_row"))
        .select(key, "_slice", "_row.*", F.lit(True).alias("_before"))
    )
    return marked.unionByName(carried_rows, allowMissingColumns=True)


def with_last_state(
    rows: DataFrame,
    events: DataFrame,
    *,
    key: str,
    ts: str,
    tie: str,
    state: str,
    hot_rows: int = HOT_ROWS,
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """``rows`` plus the ``state`` of the last event of their key at or before them.

    Rows and events are laid on one time line and the state is carried forward,
    so a row is never paired with the events of its key. ``events`` has key, ts,
    tie and state; the slices of hot keys start with the state before them.
    """
    both = rows.select(key, ts).unionByName(events.select(key, ts))
    spans = hot_spans(both, key, ts, hot_rows, slice_rows)
    line = rows.withColumns({state: F.lit(None).cast("string"), "_kind": F.lit(2)}).unionByName(
        events.select(key, ts, state, F.col(tie).alias("_tie"), F.lit(1).alias("_kind")),
        allowMissingColumns=True,
    )
    so_far = (
        Window.partitionBy(key, "_slice")
        .orderBy(F.asc_nulls_first(ts), "_kind", "_tie")
        .rowsBetween(Window.unboundedPreceding, 0)
    )

    def carried(placed: DataFrame) -> DataFrame:
        return (
            placed.withColumn(state, F.last(state, ignorenulls=True).over(so_far))
            .where(F.col("_kind") == 2)
            .select(*rows.columns, state)
        )

    if spans is None:
        return carried(line.withColumn("_slice", F.lit(0).cast("long")))
    line = line.join(F.broadcast(spans), key, "left")
    placed = with_slice(line, ts)

    is_event = F.col("_kind") == 1
    ends = (
        with_slice(line.select(key, ts, state, "_tie", "_kind", "_cuts").where(F.col("_cuts").isNotNull()), ts)
        .groupBy(key, "_slice")
        .agg(F.max(F.when(is_event, F.struct(ts, "_tie", state)))[state].alias("_end"))
    )
    earlier = (
        Window.partitionBy(key).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    )
    starts = ends.select(
        key, "_slice", F.last("_end", ignorenulls=True).over(earlier).alias(state),
        F.lit(0).alias("_kind"),
    ).where(F.col(state).isNotNull())

    return carried(placed.unionByName(starts, allowMissingColumns=True))
