"""Candidates of token sets: no similar pair is lost, and sets that share a pair of tokens only are not sent on."""

import random

from curaspark.operators import pairs as J


def _sets(spark, sets):
    return spark.createDataFrame(list(enumerate(sets)), "cls bigint, toks array<string>")


def test_sets_with_two_tokens_in_common_are_ruled_out(spark):
    sets = [["a", "b", f"x{i}", f"y{i}"] for i in range(40)] + [["a", "b", "x0", "y0", "z"]]
    got = {(r.c, r.d) for r in J.token_candidates(_sets(spark, sets), "cls", "toks", 0.57).collect()}
    assert (0, 40) in got
    assert len(got) < 200  # of 780 pairs that share a and b


def test_no_similar_sets_are_lost(spark):
    rng = random.Random(8)
    sets = [[]]
    for _ in range(150):
        base = rng.sample(range(60), rng.choice([1, 2, 3, 4, 5, 30]))
        sets.append([f"t{x}" for x in base])
        sets.append([f"t{x}" for x in {*base[: rng.randint(1, len(base))], *rng.sample(range(400), rng.randint(0, 2))}])
    long = [f"u{x}" for x in range(300)]
    sets += [long, long[40:], long[:-100]]
    for least in (0.1, 0.57, 0.9):
        got = {(r.c, r.d) for r in J.token_candidates(_sets(spark, sets), "cls", "toks", least).collect()}
        pairs = ((i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if sets[i] and sets[j])
        assert {(i, j) for i, j in pairs if len({*sets[i]} & {*sets[j]}) >= least * len({*sets[i]} | {*sets[j]})} <= got
