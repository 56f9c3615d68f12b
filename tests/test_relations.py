"""Origins, free names, generation gate, walks and adaptive bundles against sequential versions."""

import random
import re

import pytest
from pyspark.sql import functions as F

from curaspark.operators import history as H
from curaspark.operators import relate as R
from curaspark.plans import decision as D
from curaspark.streaming import streams as S


def follow(name, related, seen=()):
    """Walk the pointers of one name, one step at a time."""
    seen = (*seen, name)
    to = related.get(name)
    if to:
        return follow(to, related, seen) if to in related and to not in seen else to
    cut = re.match(r"^(.+)_[A-Za-z0-9]{1,8}$", name.rsplit(".", 1)[0])
    parent = cut and cut.group(1) + ".png"
    return follow(parent, related, seen) if parent in related and parent not in seen else name


@pytest.mark.parametrize("seed", [1, 2])
def test_origins_with_cycles(spark, seed):
    rng = random.Random(seed)
    names = [f"n{i}{s}.png" for i in range(12) for s in ("", "_a", "_a_b")]
    related = {n: rng.choice([None, None, rng.choice(names), "outside.png"]) for n in names}
    rows = [(f"/d/{n}", None if to is None else f"/e/{to}") for n, to in related.items()]
    got = {r.basename: r.origin for r in R.origins(spark.createDataFrame(rows, "path string, related_path string")).collect()}
    assert got == {n: follow(n, related) for n in names}


def test_free_names(spark):
    rng = random.Random(3)
    wanted = [rng.choice(["a.png", "b.png", "a_1.png", "a_2.png"]) for _ in range(25)]
    held = ["a.png", "b_2.png", "a_5.png"]
    df = spark.createDataFrame(list(enumerate(wanted)), "n int, name string")
    out = H.free_names(df, "name", [F.col("n")], spark.createDataFrame([(h,) for h in held], "name string")).collect()
    final = [r.final_name for r in out]
    assert len(set(final)) == len(final) and not set(final) & set(held)
    for r in out:
        assert re.match(re.escape(r.name[:-4]) + r"(_\d+)?\.png$", r.final_name)


def test_generate_gate_counts(spark):
    rng = random.Random(4)
    base = [f"/w/picture00{i}{s}.png" for i in range(6) for s in ("", "_edit", "_ed_2", "__other", "_7")]
    rows = [(p, rng.choice([None, f"/w/picture00{rng.randrange(6)}.png", f"/x/picture00{rng.randrange(6)}.png", "/x/short.png"])) for p in base]
    df = spark.createDataFrame(rows, "path string, related_path string")
    got = {r.path: (r.n_downstream, r.generate) for r in R.should_generate(df, df, "_edit", 1).collect()}
    name = lambda p: p.rsplit("/", 1)[1]
    stem = lambda p: name(p)[:-4]
    known = lambda s: re.search(r"_(e|ed|edi|edit)([_ ]*\d+)?$", s) or re.search(r"^picture\d+_\d+$", s)
    for p, rel in rows:
        down = [q for q, r in rows if (r and (r == p or (len(name(r)) > 10 and name(r) == name(p)))) or
                (len(stem(q)) > len(stem(p)) and stem(q).startswith(stem(p)) and not stem(q)[len(stem(p))].isalnum())]
        count = sum(bool(known(stem(q))) for q in down)
        own = rel is not None and any(q == rel or (len(name(rel)) > 10 and name(q) == name(rel)) for q, _ in rows)
        assert got[p] == (count, not own and count < 1), p


def test_walk_validation():
    node = D.Node("a", D.Condition("always"), D.Outcome("GOTO", "a"), D.Outcome("EXECUTE"))
    walk = D.DecisionWalk("w", [node, D.Node("a", D.Condition("node_result", {"node_name": "later"}))], category_map={"x": "_12"}, seed_category="y")
    text = " ".join(walk.validate())
    for part in ("does not go forward", "without an action", "occurs twice", "not an earlier node", "only digits", "not a category"):
        assert part in text
    assert D.DecisionWalk.from_dict(walk.to_dict()).to_dict() == walk.to_dict()


def test_adaptive_bundles(spark, tmp_path):
    rng = random.Random(5)
    rows, t = [], 1_700_000_000.0
    for _ in range(120):
        t += rng.choice([0.5, 2.0, 4.0, 9.0, 30.0])
        rows.append((rng.randrange(2), int(t * 1e6)))
    df = spark.createDataFrame(rows, "k int, us long").select("k", F.timestamp_micros("us").alias("ts"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    out = S.drain(S.bundle_adaptive(S.stream_table(spark, str(tmp_path / "in"), df.schema), "k")).collect()
    want = []
    for k in (0, 1):
        gap, last, size = S.BASE_GAP, None, 0
        for us in sorted(u for x, u in rows if x == k):
            if last is not None:
                gap = S.next_gap(gap, (us - last) / 1e6)
                if (us - last) / 1e6 >= gap:
                    want.append((k, size))
                    size = 0
            last, size = us, size + 1
        want.append((k, size))
    got = sorted((r.k, r.n) for r in out)
    # the last bundle of a key is open until its timer fires
    assert all(got.count(w) <= sorted(want).count(w) for w in got) and len(want) - len(got) <= 2
