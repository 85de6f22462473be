"""Similar repairs against all pairs of a small history."""

import random

import pytest
from pyspark.sql import functions as F

from plantpulse.operators import similar

SCHEMA = ("maintenance_id string, machine_id string, failure_mode string, root_cause string, action_taken string, "
          "parts_replaced string, completed_at timestamp_ntz")


def history(seed, n, vocabulary=14):
    rng = random.Random(seed)

    def text(most):
        return rng.choice([None, " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(rng.randrange(most + 1)))])

    return [
        (f"C{i:03}", "M", rng.choice(["WORN_PART", "Leak", None]), text(4), text(3), text(2),
         rng.choice([None, f"2024-01-{1 + rng.randrange(9):02} 00:00:00"]))
        for i in range(n)
    ]


def words(row):
    import re
    return set(re.findall(r"[^\W_]+", " ".join(c for c in row[2:6] if c).lower()))


def plain(rows, keep, num, den):
    out = []
    for a in rows:
        near = []
        for b in rows:
            if a[0] != b[0] and words(a) and words(b):
                common, united = len(words(a) & words(b)), len(words(a) | words(b))
                if common * den >= united * num:
                    near.append((common / united, b[6] is None, b[6] or "", b[0]))
        near.sort(reverse=True)
        out += [(a[0], k, b[3], b[0]) for k, b in enumerate(near[:keep], 1)]
    return sorted(out)


@pytest.mark.parametrize("num, den, keep", [(7, 10, 10), (1, 2, 3), (1, 1, 2), (1, 5, 40)])
def test_against_all_pairs(frame, num, den, keep):
    rows = history(num * 10 + keep, 90)
    got = similar.similar_repairs(frame(SCHEMA, *rows), keep=keep, at_least=(num, den))
    assert sorted(map(tuple, got.select("maintenance_id", "case_rank", "similar_id", "similarity").collect())) == plain(rows, keep, num, den)


def test_hot_words_and_classes_in_blocks(frame, monkeypatch):
    monkeypatch.setattr(similar, "BLOCK", 3)
    monkeypatch.setattr(similar, "HOT_KEYS", 8)
    rows = history(5, 80, vocabulary=5) + [(f"S{i:03}", "M", "Leak", "w1 w2", None, None, None) for i in range(40)]
    got = similar.similar_repairs(frame(SCHEMA, *rows), keep=5, at_least=(1, 2))
    assert sorted(map(tuple, got.select("maintenance_id", "case_rank", "similar_id", "similarity").collect())) == plain(rows, 5, 1, 2)


def test_repeated_records_are_one_case(frame):
    rows = [("A", "M", "Leak", "x", None, None, None)] * 3 + [("B", "M", "leak!", "X", None, None, None)]
    got = similar.similar_repairs(frame(SCHEMA, *rows)).collect()
    assert sorted((r.maintenance_id, r.similar_id, r.similarity) for r in got) == [("A", "B", 1.0), ("B", "A", 1.0)]


def test_no_records(frame):
    assert similar.similar_repairs(frame(SCHEMA)).collect() == []


def test_classes_are_joined_by_equality_only(frame, plan_of):
    text = plan_of(similar.similar_repairs(frame(SCHEMA, *history(1, 20))))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
