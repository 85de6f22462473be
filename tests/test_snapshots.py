"""Tables in steps: what readers see, repeated batches, compaction, pruning."""

import pytest
from pyspark.sql import functions as F

from plantpulse.sources.snapshots import SnapshotTable, bucket_of, day_of

SCHEMA = "k string, at timestamp_ntz, v long"


def at(day, hour=0):
    return f"2024-01-{day:02} {hour:02}:00:00"


@pytest.fixture
def table(spark, tmp_path):
    return SnapshotTable(spark, str(tmp_path / "t"), key=["k"], part=day_of("at"), time="at")


def held(df):
    return sorted((r.k, r.v) for r in df.collect())


def test_changes_replace_and_add_rows(frame, table):
    assert table.step() is None
    table.change(frame(SCHEMA, ("a", at(1), 1), ("b", at(1), 1), ("c", at(2), 1)), batch=0)
    assert table.change(frame(SCHEMA, ("b", at(1), 2), ("d", at(3), 2)), batch=1) == ["2024-01-01", "2024-01-03"]
    table.change(frame(SCHEMA, ("b", at(1), 3)), batch=2)
    want = [("a", 1), ("b", 3), ("c", 1), ("d", 2)]
    assert held(table.read()) == want
    assert held(table.last_change(2)) == [("b", 3)] and table.last_change(1).count() == 0
    assert str(table.step().mark) == at(3)
    table.compact()
    assert held(table.read()) == want and not table.step().changed
    assert str(table.step().mark) == at(3)


def test_a_repeated_batch_starts_where_it_did_before(frame, table):
    table.change(frame(SCHEMA, ("a", at(1), 1)), batch=0)
    table.change(frame(SCHEMA, ("a", at(1), 2), ("b", at(1), 2)), batch=1)
    table.compact()
    table.vacuum(keep=1)
    table.change(frame(SCHEMA, ("c", at(1), 7)), batch=1)  # again, with other rows: the first attempt is forgotten
    assert held(table.read()) == [("a", 1), ("c", 7)]


def test_readers_keep_to_their_step(frame, table):
    table.change(frame(SCHEMA, ("a", at(1), 1), ("b", at(2), 1)), batch=0)
    before = table.read()
    table.change(frame(SCHEMA, ("a", at(1), 2)), batch=1)
    table.compact()
    assert held(before) == [("a", 1), ("b", 1)] and held(table.read()) == [("a", 2), ("b", 1)]


def test_an_unfinished_step_is_not_seen(spark, frame, table, tmp_path):
    table.change(frame(SCHEMA, ("a", at(1), 1)), batch=0)
    table._put(frame(SCHEMA, ("a", at(1), 9)), None)  # rows without a step that names them
    spark.createDataFrame([(1, None, "2024-01-01", "gone", 1)], "batch long, mark timestamp_ntz, part string, version string, level int") \
        .coalesce(1).write.parquet(f"{table.root}/log/n=1")
    (tmp_path / "t" / "log" / "n=1" / "_SUCCESS").unlink()
    assert held(table.read()) == [("a", 1)]
    assert table.vacuum() >= 1 and held(table.read()) == [("a", 1)]


def test_replace_parts_or_all(frame, table):
    table.replace(frame(SCHEMA, ("a", at(1), 1), ("b", at(2), 1)))
    table.replace(frame(SCHEMA, ("c", at(2), 2)), batch=1, all_parts=False)
    assert held(table.read()) == [("a", 1), ("c", 2)]
    table.replace(frame(SCHEMA, ("d", at(5), 3)), batch=2)
    assert held(table.read()) == [("d", 3)]
    table.replace(frame(SCHEMA), batch=3)
    assert table.read().count() == 0 and table.read().columns == ["k", "at", "v"]


def test_days_are_pruned(frame, table, plan_of):
    table.replace(frame(SCHEMA, *[(str(d), at(d), d) for d in range(1, 21)]))
    some = table.read("2024-01-05", "2024-01-07")
    assert held(some) == [(str(d), d) for d in range(5, 8)]
    assert len(some.inputFiles()) == 3
    text = plan_of(some)
    assert "PartitionFilters: [isnotnull(part" in text
    assert table.parts("2024-01-19") == ["2024-01-19", "2024-01-20"]


def test_compaction_reads_only_what_changed(frame, table):
    table.replace(frame(SCHEMA, *[(str(d), at(d), d) for d in range(1, 11)]), batch=0)
    untouched = {v for p, v, _ in table.step().held if p != "2024-01-04"}
    table.change(frame(SCHEMA, ("4", at(4), 44)), batch=1)
    table.compact(tasks=2)
    assert {v for p, v, _ in table.step().held if p != "2024-01-04"} == untouched
    assert held(table.read("2024-01-04", "2024-01-04")) == [("4", 44)]


def test_buckets_by_key(spark, frame, tmp_path):
    orders = SnapshotTable(spark, str(tmp_path / "o"), key=["k"], part=bucket_of("k", 3))
    orders.replace(frame(SCHEMA, *[(f"k{i}", at(1), i) for i in range(30)]), batch=-1)
    assert orders.parts() == ["00000", "00001", "00002"] and orders.step().mark is None
    one = frame(SCHEMA, ("k7", at(1), 700))
    part = one.select(orders.part).first()[0]
    assert orders.change(one, batch=0) == [part]
    assert dict(held(orders.read()))["k7"] == 700 and orders.read().count() == 30


def test_changes_alone_are_read_once(spark, frame, tmp_path, plan_of):
    """Without whole parts nothing has to be kept apart from the changes: one pass over them, no anti join."""
    table = SnapshotTable(spark, f"{tmp_path}/t", key=["id"], part=day_of("at"), time="at")
    kind = "id long, at timestamp_ntz, v long"
    table.change(frame(kind, (1, "2024-01-01 00:00:00", 1), (2, "2024-01-02 00:00:00", 1)), batch=0)
    table.change(frame(kind, (1, "2024-01-01 00:00:00", 5)), batch=1)
    text = plan_of(table.read())
    assert text.count("FileScan") == 1 and "LeftAnti" not in text
    assert sorted((r.id, r.v) for r in table.read().collect()) == [(1, 5), (2, 1)]
    table.compact()
    table.change(frame(kind, (2, "2024-01-02 00:00:00", 7)), batch=2)
    assert plan_of(table.read()).count("Window [") <= 1
    assert sorted((r.id, r.v) for r in table.read().collect()) == [(1, 5), (2, 7)]
