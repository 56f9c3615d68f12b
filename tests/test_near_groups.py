"""Groups from nearest items alone equal the groups from all pairs, copies and many blocks included."""

from functools import partial

import numpy as np
import pytest

from curaspark.operators import cluster as C
from curaspark.operators import pairs as J
from curaspark.operators import products as P


def rows_of(kind, seed, n, copies):
    rng = np.random.default_rng(seed)
    if kind == "dot":
        around = rng.normal(size=(5, 6))
        x = around[rng.integers(0, 5, n)] + rng.normal(size=(n, 6)) * rng.choice([0.05, 0.8], size=(n, 1))
        x /= np.linalg.norm(x, axis=1)[:, None]
    else:
        x = rng.dirichlet(np.full(8, 0.7), n)
    for _ in range(copies):
        x[rng.integers(0, n)] = x[rng.integers(0, n)]
    return [(int(i) * 3, v.tolist()) for i, v in enumerate(np.round(x, 6))]


def collected(df):
    return {r["id"]: (r["group_id"], r["score"]) for r in df.collect()}


@pytest.mark.parametrize("seed,n,copies,threshold", [(1, 90, 0, 0.9), (2, 80, 25, 0.8), (3, 60, 0, 0.3)])
def test_greedy_groups_without_a_table_of_pairs(spark, monkeypatch, seed, n, copies, threshold):
    df = spark.createDataFrame(rows_of("dot", seed, n, copies), "id long, v array<double>").repartition(3)
    want = collected(C.greedy_groups(J.similar_pairs(df, "id", "v", threshold)))
    monkeypatch.setattr(J.P, "seek", partial(P.seek, few=0, block_rows=9))
    near = J.similar_near(df, "id", "v", threshold, block_rows=16)
    assert collected(C.greedy_groups(near)) == want
    # of every item at most the nearest one on both sides
    assert near.near.groupBy("pos", "up").count().filter("count > 1").isEmpty()
    if not copies:
        assert near.copies.pairs.isEmpty()


@pytest.mark.parametrize("seed,n,copies,cutoff", [(4, 60, 0, 0.15), (5, 50, 15, 0.1), (6, 40, 0, 0.05)])
def test_regroup_without_a_table_of_pairs(spark, monkeypatch, seed, n, copies, cutoff):
    df = spark.createDataFrame(rows_of("l1", seed, n, copies), "id long, h array<double>").repartition(3)
    want = collected(C.regroup_groups(J.hist_pairs(df, "id", "h", 0.4), cutoff, lower=True))
    monkeypatch.setattr(J.P, "seek", partial(P.seek, few=0, block_rows=9))
    assert collected(C.regroup_groups(J.hist_near(df, "id", "h", 0.4, block_rows=16), cutoff, lower=True)) == want


def test_vectors_are_stored_once_however_many_blocks_they_meet(spark):
    df = spark.createDataFrame(rows_of("dot", 7, 70, 0), "id long, v array<double>").repartition(2)
    found = J.similar_pairs(df, "id", "v", 0.3, block_rows=8)
    x = {r["id"]: np.array(r["v"]) for r in df.collect()}
    want = {(i, j) for i in x for j in x if i < j and np.round(x[i] @ x[j], 9) > 0.3}
    assert {(r["c"], r["d"]) for r in found.pairs.collect()} == want
    asked = P.matches(df.selectExpr("id", "v vec"), df.selectExpr("id key", "v vec"), 0.3, few=0, block_rows=20)
    assert {(r["key"], r["id"]) for r in asked.collect() if r["key"] < r["id"]} == want
    # blocks are read by the tasks that need them; no row is shuffled for every block
    for made in (found.pairs, asked):
        assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
