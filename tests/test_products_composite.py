"""Query tables, composite runs, re-added items and captured seeds against plain loops."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from curaspark.operators import agg as A
from curaspark.operators import cluster as C
from curaspark.operators import pairs as J
from curaspark.operators import products as P
from curaspark.operators import search as S
from curaspark.operators.composite import CompositeCompare, Instance


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(9)
    items, queries = np.round(rng.normal(size=(130, 6)), 3), np.round(rng.normal(size=(70, 6)), 3)
    items[10] = items[3]  # ties
    queries[5] = queries[4]
    return items, queries


def _table(spark, rows, name):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(rows)], f"{name} long, vec array<double>")


@pytest.mark.parametrize("few", [1000, 0])
def test_products_in_blocks(spark, vectors, few):
    x, q = vectors
    items, queries = _table(spark, x, "id"), _table(spark, q, "key")
    how = {"block_rows": 32, "few": few}
    scores = np.round(q @ x.T, 9)
    top = {(r.key, r.id) for r in P.top_matches(items, queries, 4, **how).collect()}
    assert top == {(k, i) for k in range(len(q)) for i in sorted(range(len(x)), key=lambda i: (-scores[k, i], i))[:4]}
    above = {(r.key, r.id): r.score for r in P.matches(items, queries, 2.0, **how).collect()}
    assert above == {(k, i): scores[k, i] for k in range(len(q)) for i in range(len(x)) if scores[k, i] > 2.0}
    low = {r.key: r.low for r in P.lowest_scores(items, queries, **how).collect()}
    assert all(abs(low[k] - scores[k].min()) < 1e-8 for k in range(len(q)))
    best = {r.id: r.key for r in P.best_queries(items, queries, **how).collect()}
    assert best == {i: int(np.argmax(scores[:, i])) for i in range(len(x))}


def test_products_of_empty_tables(spark, vectors):
    items, none = _table(spark, vectors[0], "id"), _table(spark, [], "key")
    assert P.top_matches(items, none, 3).count() == 0 and P.best_queries(items, none).count() == 0
    assert P.matches(_table(spark, [], "id"), _table(spark, vectors[1], "key"), 0.0).count() == 0
    gaps = spark.createDataFrame([(1, None), (2, [1.0] * 6)], "id long, vec array<double>")
    assert [r.id for r in P.top_matches(gaps, _table(spark, vectors[1][:1], "key"), 3).collect()] == [2]


def test_presets_relative_to_their_smallest_score(spark, vectors):
    x, q = np.abs(vectors[0]) + 0.1, np.abs(vectors[1]) + 0.1
    items, presets = _table(spark, x, "id"), _table(spark, q, "key")
    relative = (q @ x.T) / (q @ x.T).min(axis=1)[:, None]
    for few in (1000, 0):
        got = {r.id: r.preset for r in S.segregate(items, "id", "vec", presets, "key", "vec", block_rows=32, few=few).collect()}
        best = {i: int(np.argmax(relative[:, i])) for i in range(len(x))}
        assert all(got[i] == b or abs(relative[got[i], i] - relative[b, i]) < 1e-9 for i, b in best.items())
    one = int(np.argmax(relative[:, 0]))
    assert 0 in {r.id for r in S.search_preset(items, "id", "vec", presets, "key", "vec", one).collect()}


def test_means_of_vectors(spark):
    rows = [(1, [1.0, 2.0]), (1, [3.0, None]), (1, None), (2, [5.0, 6.0, 7.0]), (3, []), (None, [1.0, 1.0])]
    got = {r.k: r.vec for r in A.mean_vector(spark.createDataFrame(rows, "k long, v array<double>"), "k", "v").collect()}
    assert got == {1: [2.0, 2.0], 2: [5.0, 6.0, 7.0], None: [1.0, 1.0]}


def _scores(spark, rows):
    return spark.createDataFrame(rows, "id long, score double")


def test_composite_logic(spark):
    vec, hist = _scores(spark, [(1, 0.9), (2, 0.4), (3, 1.5)]), _scores(spark, [(1, 0.2), (3, 0.6), (4, 0.1)])
    again = _scores(spark, [(1, 0.5), (5, 0.3)])
    runs = [
        Instance("v", "embedding", search=lambda: vec, weight=2.0), Instance("h", "histogram", search=lambda: hist),
        Instance("w", "embedding", search=lambda: again), Instance("x", "color", enabled=False),
    ]

    def run(logic):
        return {r.id: round(r.score, 9) for r in CompositeCompare(runs, logic, by_item=True).search().collect()}

    # same-mode runs count with their best score, histograms are turned round, scores end at 1
    assert run("and") == {1: round((0.9 * 0.8) ** 0.5, 9), 3: round((1.0 * 0.4) ** 0.5, 9)}
    assert run("or") == {1: 0.9, 2: 0.4, 3: 1.0, 4: 0.9, 5: 0.3}
    assert run("weighted") == {1: round((1.8 + 0.8 + 0.5) / 4, 9), 2: 0.2, 3: round((2.0 + 0.4) / 4, 9), 4: round(0.9 / 4, 9), 5: round(0.3 / 4, 9)}


def test_composite_rules(spark):
    found = _scores(spark, [(1, 0.5)])
    vec, hist = Instance("v", "embedding", search=lambda: found), Instance("h", "histogram", search=lambda: found)
    own = Instance("o", "prompts", search=lambda: found, own_text=True)
    assert [i.name for i in CompositeCompare([vec, hist], by_text=True).plan()[2]] == ["h"]
    assert CompositeCompare([vec, hist], by_item=True).plan()[2] == []
    # a skipped mode found nothing, so nothing is in all modes
    assert CompositeCompare([vec, hist], "and", by_text=True).search().count() == 0
    assert CompositeCompare([vec, hist], "or", by_text=True).search().count() == 1
    assert CompositeCompare([own, hist], "or", by_text=True).plan()[2] == [hist]
    for bad in (
        lambda: CompositeCompare([vec, own]).plan(), lambda: CompositeCompare([hist], by_text=True).plan(), lambda: CompositeCompare([]).plan(),
        lambda: CompositeCompare([vec]).search(), lambda: CompositeCompare([vec], by_item=True).groups(), lambda: CompositeCompare([vec], "xor"),
    ):
        with pytest.raises(ValueError):
            bad()


def test_composite_groups(spark):
    first = spark.createDataFrame([(1, 0, 0.9), (2, 0, 0.9), (3, 1, 0.8), (4, 1, 0.8), (5, 2, 0.7), (6, 2, 0.7)], "id long, group_id long, score double")
    second = spark.createDataFrame([(1, 7, 3.0), (3, 7, 3.0), (4, 7, 3.0), (5, 8, 9000.0), (6, 8, 2.0)], "id long, group_id long, score double")
    runs = [Instance("v", "embedding", group=lambda: first), Instance("c", "color", group=lambda: second)]
    got = sorted((r.id, r.group_id, r.score) for r in CompositeCompare(runs).groups().collect())
    assert got == [(3, 0, 0.8), (4, 0, 0.8), (5, 1, 0.7), (6, 1, 0.7)]


@pytest.mark.parametrize("gone", [(0, 1, 2), (7, 20, 39), tuple(range(40))])
def test_readded_items_give_the_pairs_of_a_full_run(spark, gone):
    rng = np.random.default_rng(12)
    rows = np.round(rng.normal(size=(40, 4)), 2)
    rows[7], rows[20], rows[2] = rows[3], rows[1], rows[39]  # copies across the border of old and new
    full = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)], "id long, v array<double>")
    old = J.similar_pairs(full.filter(~F.col("id").isin(list(gone))), "id", "v", 0.8)
    again, whole = J.readd_pairs(old, full, "id", "v", 0.8), J.similar_pairs(full, "id", "v", 0.8)
    for part in ("members", "classes", "pairs"):
        assert sorted(map(tuple, getattr(again, part).collect())) == sorted(map(tuple, getattr(whole, part).collect()))
    # items may also have left
    fewer = full.filter("id % 5 != 0")
    again, whole = J.readd_pairs(old, fewer, "id", "v", 0.8), J.similar_pairs(fewer, "id", "v", 0.8)
    assert sorted(map(tuple, C.greedy_groups(again).collect())) == sorted(map(tuple, C.greedy_groups(whole).collect()))


@pytest.mark.parametrize("gone", [(7, 20, 39), tuple(range(0, 40, 3))])
def test_readded_items_are_grouped_without_a_table_of_pairs(spark, gone):
    rng = np.random.default_rng(13)
    rows = np.round(rng.normal(size=(40, 4)), 2)
    rows[7], rows[20], rows[2] = rows[3], rows[1], rows[39]
    full = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)], "id long, v array<double>")
    old = J.similar_near(full.filter(~F.col("id").isin(list(gone))), "id", "v", 0.8)
    for now in (full, full.filter("id % 5 != 0")):  # items may also have left
        again, whole = J.readd_near(old, now, "id", "v", 0.8), J.similar_near(now, "id", "v", 0.8)
        assert sorted(map(tuple, again.near.collect())) == sorted(map(tuple, whole.near.collect()))
        assert sorted(map(tuple, again.copies.pairs.collect())) == sorted(map(tuple, whole.copies.pairs.collect()))


def test_capture(spark):
    library = spark.createDataFrame([(1, "a", ["t"], [1.0, 0.0], "m", 3, False)], "id long, name string, tags array<string>, vec array<double>, model string, use_count long, deprecated boolean")
    frames = spark.createDataFrame([(5, [3.0, 0.0]), (5, [0.0, 4.0]), (6, None)], "item long, v array<double>")
    lib = S.SeedLibrary(library).capture(frames, "item", "v", 5, 2, "five", "m", ["x"]).capture(frames, "item", "v", 6, 3, "six", "m")
    got = {r.id: r for r in lib.list().collect()}
    assert sorted(got) == [1, 2] and [round(x, 9) for x in got[2].vec] == [0.6, 0.8] and got[2].tags == ["x"] and got[2].use_count == 0
    assert {r.id: r.name for r in lib.capture(frames, "item", "v", 5, 1, "new", "m").list().collect()}[1] == "new"
