"""Bundles of notifications over finished tables, against a plain loop."""

import datetime as dt
import random

import pytest

from curaspark.streaming import streams

BASE = dt.datetime(2024, 1, 1)


def plain(rows, gap):
    """(key, start, end, n, by hand, automatic), event by event."""
    out, last = [], {}
    for key, at, hand in sorted((r for r in rows if r[1] is not None), key=lambda r: r[1]):
        if key in last and (at - last[key][2]) < gap:
            last[key][2] = at
        else:
            last[key] = [key, at, at, 0, 0, 0]
            out.append(last[key])
        last[key][3] += 1
        last[key][4 if hand else 5] += 1
    return {(k, a, b + gap, n, m, o) for k, a, b, n, m, o in out}


def run(spark, rows, **more):
    table = spark.createDataFrame(rows, "user string, at timestamp, hand boolean").selectExpr("*", "1 as n", "2 as _lo", "'x' as start_ts")
    found = streams.bundle_table(table, ["user"], ts="at", manual=table["hand"], **more).collect()
    assert len(set(found)) == len(found)
    return {tuple(r) for r in found}


@pytest.mark.parametrize("range_slots", [1, 3, 100_000])
def test_bundles_of_a_hot_key_over_many_ranges(spark, range_slots):
    rng = random.Random(range_slots)
    rows = []
    for user, pause in (("hot", 1.2), ("calm", 9.0), ("steady", 3.0), (None, 2.0)):
        at = 0.0
        for _ in range(400 if user == "hot" else 60):
            at += 3.0 if user == "steady" else rng.choice([0, 0.5, pause, pause, 2.999999, 3.0, 3.000001, 40])
            rows.append((user, BASE + dt.timedelta(seconds=at), rng.random() < 0.5))
    rows += [("steady", None, True), ("never", None, False), rows[0], rows[0]]
    rng.shuffle(rows)
    assert run(spark, rows, range_slots=range_slots) == plain(rows, dt.timedelta(seconds=3))


def test_a_bundle_through_all_ranges(spark):
    rows = [("one", BASE + dt.timedelta(seconds=2 * i), True) for i in range(300)]
    assert run(spark, rows, range_slots=7) == plain(rows, dt.timedelta(seconds=3))


def test_bundles_of_nothing(spark):
    assert run(spark, []) == set()
    assert run(spark, [("one", None, True)]) == set()


def test_bundles_before_the_epoch(spark):
    rows = [("one", dt.datetime(1969, 12, 31, 23, 59, 50) + dt.timedelta(seconds=2.5 * i), False) for i in range(9)]
    assert run(spark, rows, range_slots=2) == plain(rows, dt.timedelta(seconds=3))
