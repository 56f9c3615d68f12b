"""Distance joins against plain loops: bounds must lose nothing and skip much where the data allows it."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from curaspark.functions import vec as V
from curaspark.operators import blocks as B
from curaspark.operators import pairs as J


def _frame(spark, rows, name="v"):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(rows)], f"id long, {name} array<double>")


def _expanded(found):
    """Item pairs that a PairSet stands for."""
    members = {}
    for r in found.members.collect():
        members.setdefault(r.cls, []).append(r.id)
    out = {}
    for r in found.pairs.collect():
        out |= {tuple(sorted((a, b))): r.score for a in members[r.c] for b in members[r.d]}
    for r in found.classes.filter("n > 1 and self_score is not null").collect():
        out |= {(a, b): r.self_score for a in members[r.cls] for b in members[r.cls] if a < b}
    return out


def _clusters(rng, groups, each, width, spread):
    centres = rng.normal(size=(groups, width))
    centres /= np.linalg.norm(centres, axis=1)[:, None]
    rows = np.repeat(centres, each, axis=0) + rng.normal(size=(groups * each, width)) * spread
    return rows / np.linalg.norm(rows, axis=1)[:, None]


def test_vectors_in_clusters_skip_most_pairs(spark):
    rng = np.random.default_rng(1)
    rows = np.round(_clusters(rng, 40, 25, 16, 0.03), 6)
    rows[5] = rows[4]
    found = J.similar_pairs(_frame(spark, rows), "id", "v", 0.9, block_rows=64)
    scores = np.round(rows @ rows.T, 9)
    want = {(i, j): scores[i, j] for i in range(len(rows)) for j in range(i + 1, len(rows)) if scores[i, j] > 0.9}
    got = _expanded(found)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-8 for k in want)
    assert found.compared() < 0.3


@pytest.mark.parametrize("threshold", [0.0, 0.35, 0.8])
def test_vectors_of_any_length_and_threshold(spark, threshold):
    rng = np.random.default_rng(2)
    rows = np.round(rng.normal(size=(400, 5)) * rng.uniform(0.1, 2, size=(400, 1)), 4)
    rows[:30] = 0
    found = J.similar_pairs(_frame(spark, rows), "id", "v", threshold, block_rows=40)
    scores = np.round(rows @ rows.T, 9)
    want = {(i, j) for i in range(len(rows)) for j in range(i + 1, len(rows)) if scores[i, j] > threshold}
    assert _expanded(found).keys() == want


def test_histograms_in_clusters_skip_most_pairs(spark):
    rng = np.random.default_rng(3)
    base = rng.dirichlet(np.full(24, 0.2), size=30)
    rows = np.round(np.repeat(base, 20, axis=0) * rng.uniform(0.9, 1.1, size=(600, 24)), 6)
    found = J.hist_pairs(_frame(spark, rows), "id", "v", 0.1, block_rows=50)
    far = np.round(np.abs(rows[:, None] - rows[None]).sum(2) / 2, 9)
    want = {(i, j) for i in range(600) for j in range(i + 1, 600) if far[i, j] <= 0.1}
    assert _expanded(found).keys() == want
    assert found.compared() < 0.4


def test_every_pair_of_cells_is_compared_once(spark):
    rng = np.random.default_rng(4)
    rows = rng.normal(size=(300, 4))
    items = _frame(spark, rows).select(F.col("id").alias("cls"), F.col("v").alias("vec"))
    placed = B.metric_cells(items, 100.0, "l2", 20)  # nothing can be ruled out
    assert B.compared_pairs(B.work(placed)) == 300 * 299 // 2


def _run_test(flags, needed):
    """The rule as a scan: both counters, the running total and the flag before."""
    hits, run, runs, before = 1, 1, 0, False
    for flag in flags:
        if flag:
            hits += 1
            if before:
                run += 1
                if run > V.RUN_LENGTH:
                    runs += 1
        before = flag
    return hits > needed and runs > V.RUN_COUNT


def _signatures(rng, n, cells, kinds=6):
    """Copies of a few signatures with some cells far off, so that runs are interrupted."""
    base = [[(rng.uniform(0, 100), rng.uniform(-80, 80), rng.uniform(-80, 80)) for _ in range(cells)] for _ in range(kinds)]
    rows = []
    for _ in range(n):
        cell = [tuple(x + rng.uniform(-7, 7) for x in c) for c in rng.choice(base)]
        for k in rng.sample(range(cells), rng.choice([0, 1, 3, 8, 14])):
            cell[k] = (rng.uniform(0, 100), rng.uniform(-80, 80), rng.uniform(-80, 80))
        rows.append([round(x, 3) for c in cell for x in c])
    return rows


@pytest.mark.parametrize("cells, kinds", [(20, 6), (21, 6), (30, 40), (36, 6), (50, 6)])
def test_colours_equal_plain_loop(spark, cells, kinds):
    rng = random.Random(cells)
    rows = _signatures(rng, 120, cells, kinds)
    rows[7] = rows[3]
    want = {}
    for i in range(len(rows)):
        for j in range(i + 1, len(rows)):
            d = [int(math.sqrt(sum((rows[i][3 * c + k] - rows[j][3 * c + k]) ** 2 for k in range(3)))) for c in range(cells)]
            if _run_test([x < 15 for x in d], cells // 2):
                want[i, j] = float(sum(d))
    found = J.color_pairs(_frame(spark, rows), "id", "v", 15, block_rows=16)
    assert _expanded(found) == want
    if cells > 20:
        assert want and found.compared() <= (0.8 if kinds > 6 else 1)


def test_run_test_column(spark):
    rng = random.Random(6)
    rows = [[rng.random() < 0.85 for _ in range(n)] for n in (0, 1, 21, 30, 36, 36, 36, 50, 64, 64) for _ in range(6)]
    table = spark.createDataFrame([(r,) for r in rows], "flags array<boolean>")
    got = table.select("flags", V.run_test("flags", 18).alias("ok")).collect()
    assert all(r.ok == _run_test(r.flags, 18) for r in got) and {r.ok for r in got} == {True, False}


def test_empty_and_single_rows(spark):
    empty = spark.createDataFrame([], "id long, v array<double>")
    one = _frame(spark, [[1.0] * 63])
    for table in (empty, one):
        assert J.similar_pairs(table, "id", "v", 0.5).rows().count() == 0
        assert J.hist_pairs(table, "id", "v", 0.5).rows().count() == 0
        assert J.color_pairs(table, "id", "v", 15).rows().count() == 0
