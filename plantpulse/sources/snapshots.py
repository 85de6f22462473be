"""Derived tables stored in parts (days, say), changed in steps, read as of one step.

A table is a folder: ``rows`` holds parquet by part and version, ``log`` one
small parquet table per step that names the versions that count. Rows are written
first and named afterwards, so a reader sees a step whole or not at all, however
it ends; what a failed or repeated attempt left behind is named by no step.

A step either replaces whole parts (``replace``, ``compact``) or lays changed
rows on top of them (``change``). On reading, the newest change of a key
replaces its row: unchanged rows are only filtered, never sorted or ranked, and
compaction folds the changes into the parts that have any. One writer at a time.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from plantpulse.operators.latest import newest
from plantpulse.sources.store import children

_LOG = "batch long, mark timestamp_ntz, part string, version string, level int"


def day_of(column: str) -> Column:
    """The part of a row by its day; parts compare like days."""
    return F.col(column).cast("date").cast("string")


def bucket_of(column: str, buckets: int) -> Column:
    """The part of a row by a hash of its key."""
    return F.lpad(F.pmod(F.xxhash64(column), F.lit(buckets)).cast("string"), 5, "0")


@dataclass(frozen=True)
class Step:
    """What counts at one step: (part, version, level) with level 0 for whole parts and 1, 2, ... for changes on top."""

    number: int
    batch: int
    mark: datetime | None
    held: tuple[tuple[str, str, int], ...]

    @property
    def changed(self) -> set[str]:
        return {part for part, _, level in self.held if level}


class SnapshotTable:
    """Rows with one or more ``key`` columns, stored by ``part``; ``time`` gives the high-water mark."""

    def __init__(self, spark: SparkSession, root: str, *, key: Sequence[str], part: Column, time: str | None = None):
        self.spark, self.root, self.key, self.part, self.time = spark, root.rstrip("/"), list(key), part, time
        self._schema: T.StructType | None = None

    # steps

    def step(self, before_batch: int | None = None) -> Step | None:
        """The newest step, or the newest of an earlier batch: where a repeated batch starts again."""
        numbers = sorted(
            (int(name[2:]) for name in children(self.spark, f"{self.root}/log") if name.startswith("n=")), reverse=True
        )
        for number in numbers:
            if "_SUCCESS" not in children(self.spark, f"{self.root}/log/n={number}"):
                continue
            rows = self.spark.read.schema(_LOG).parquet(f"{self.root}/log/n={number}").collect()
            if before_batch is None or rows[0].batch < before_batch:
                held = tuple(sorted((r.part, r.version, r.level) for r in rows if r.part is not None))
                return Step(number, rows[0].batch, rows[0].mark, held)
        return None

    def _note(self, batch: int, mark: datetime | None, held: Sequence[tuple[str, str, int]]) -> Step:
        """Make a step known. One row without a part keeps the mark of a table without rows."""
        last = max((int(n[2:]) for n in children(self.spark, f"{self.root}/log") if n.startswith("n=")), default=-1)
        rows = [(batch, mark, *h) for h in held] or [(batch, mark, None, None, None)]
        frame = self.spark.createDataFrame(rows, _LOG).coalesce(1)
        frame.write.mode("overwrite").parquet(f"{self.root}/log/n={last + 1}")
        return Step(last + 1, batch, mark, tuple(sorted(held)))

    def _put(self, rows: DataFrame, tasks: int | None) -> tuple[str, list[str], datetime | None]:
        """Write rows by part under a new version: its name, the parts it has, and their newest time."""
        version = f"v{uuid.uuid4().hex}"
        place = f"{self.root}/rows/version={version}"
        placed = rows.withColumn("part", self.part)
        if tasks:  # a part that holds much of the data is cut by key, not left to one task
            placed = placed.repartitionByRange(tasks, "part", *self.key).sortWithinPartitions("part", *self.key)
        placed.write.partitionBy("part").parquet(place)
        parts = [n[5:] for n in children(self.spark, place) if n.startswith("part=")]
        mark = None
        if parts and self.time:
            newest_part = self.spark.read.schema(rows.schema).parquet(*[f"{place}/part={p}" for p in parts])
            mark = newest_part.agg(F.max(self.time)).first()[0]
        if not children(self.spark, f"{self.root}/_schema"):
            rows.limit(0).write.mode("overwrite").parquet(f"{self.root}/_schema")
        return version, parts, mark

    # writing

    def replace(self, rows: DataFrame, *, batch: int = 0, all_parts: bool = True, tasks: int | None = None) -> Step:
        """Rows become the whole content, or with ``all_parts=False`` that of the parts they lie in."""
        before = self.step(batch)
        version, parts, mark = self._put(rows, tasks)
        kept = [] if all_parts or before is None else [h for h in before.held if h[0] not in set(parts)]
        if not all_parts and before is not None and before.mark is not None:
            mark = before.mark if mark is None else max(mark, before.mark)
        return self._note(batch, mark, [*kept, *((p, version, 0) for p in parts)])

    def change(self, rows: DataFrame, *, batch: int) -> list[str]:
        """Lay new and changed rows on top; the parts they lie in.

        A repeated batch starts from the step before its first attempt.
        """
        before = self.step(batch)
        held = list(before.held) if before else []
        version, parts, mark = self._put(rows, None)
        if before is not None and before.mark is not None:
            mark = before.mark if mark is None else max(mark, before.mark)
        level = 1 + max((h[2] for h in held), default=0)
        self._note(batch, mark, [*held, *((p, version, level) for p in parts)])
        return sorted(parts)

    def compact(self, *, tasks: int | None = None) -> Step | None:
        """Fold all changes into the parts that have any; other parts are not read."""
        now = self.step()
        if now is None or not now.changed:
            return now
        touched = sorted(now.changed)
        version, _, _ = self._put(self.read(parts=touched, step=now), tasks)
        kept = [h for h in now.held if h[0] not in now.changed]
        return self._note(now.batch, now.mark, [*kept, *((p, version, 0) for p in touched)])

    def vacuum(self, keep: int = 2) -> int:
        """Remove what only older steps name, and those steps; how many folders went.

        The last ``keep`` steps stay, and the newest of an earlier batch, from
        which a repeated batch starts.
        """
        numbers = sorted(int(n[2:]) for n in children(self.spark, f"{self.root}/log") if n.startswith("n="))
        now = self.step()
        earlier = self.step(now.batch) if now else None
        least = min([*numbers[-keep:], *([earlier.number] if earlier else [])], default=0)
        recent = [n for n in numbers if n >= least]
        if not recent:
            return 0
        paths = [f"{self.root}/log/n={n}" for n in recent]
        named = {r.version for r in self.spark.read.schema(_LOG).parquet(*paths).select("version").distinct().collect()}
        versions = [n for n in children(self.spark, f"{self.root}/rows") if n.startswith("version=")]
        gone = [f"{self.root}/rows/{n}" for n in versions if n[8:] not in named]
        gone += [f"{self.root}/log/n={n}" for n in numbers if n < least]
        for path in gone:
            place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, True)
        return len(gone)

    # reading

    def schema(self) -> T.StructType:
        if self._schema is None:  # written once
            self._schema = self.spark.read.parquet(f"{self.root}/_schema").schema
        return self._schema

    def parts(self, since: str | None = None, until: str | None = None, step: Step | None = None) -> list[str]:
        step = step or self.step()
        held = {part for part, _, _ in step.held} if step else set()
        return sorted(p for p in held if (since is None or p >= since) and (until is None or p <= until))

    def read(
        self, since: str | None = None, until: str | None = None, *, parts: Sequence[str] | None = None,
        step: Step | None = None,
    ) -> DataFrame:
        """The rows of one step (the newest now), of all parts, of a range of them, or of those listed."""
        step = step or self.step()
        schema = self.schema()
        chosen = set(self.parts(since, until, step) if parts is None else parts)
        held = [h for h in step.held if h[0] in chosen] if step else []
        whole = self._rows([h for h in held if not h[2]], schema, since, until)
        changes = [h for h in held if h[2]]
        if not changes:
            return whole
        levels = self.spark.createDataFrame(sorted({(v, lev) for _, v, lev in changes}), "version string, _level int")
        laid = self._rows(changes, schema, since, until, "version").join(F.broadcast(levels), "version").drop("version")
        last = newest(laid, self.key, F.desc("_level")).drop("_level").select(*schema.names)
        if len(changes) == len(held):
            return last
        return whole.join(laid.select(*self.key), self.key, "left_anti").unionByName(last)

    def last_change(self, batch: int) -> DataFrame:
        """What a batch that changed the table last laid on top; no rows if it is not the newest."""
        step = self.step()
        top = max((h[2] for h in step.held), default=0)
        mine = [h for h in step.held if h[2] == top and top] if step.batch == batch else []
        return self._rows(mine, self.schema(), None, None)

    def _rows(self, held, schema: T.StructType, since, until, *extra: str) -> DataFrame:
        places = [f"{self.root}/rows/version={version}/part={part}" for part, version, _ in held]
        if not places:
            empty = self.spark.createDataFrame([], schema)
            return empty.withColumns({c: F.lit(None).cast("string") for c in extra})
        stored = T.StructType([*schema, T.StructField("part", T.StringType()), T.StructField("version", T.StringType())])
        rows = self.spark.read.schema(stored).option("basePath", f"{self.root}/rows").parquet(*places)
        if since is not None:
            rows = rows.where(F.col("part") >= since)
        if until is not None:
            rows = rows.where(F.col("part") <= until)
        return rows.select(*schema.names, *extra)
