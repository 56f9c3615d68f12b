"""Text and set joins against brute force on small fixtures."""

import random

import pytest

from pyspark.sql import functions as F

from curaspark.functions import fuzzy
from curaspark.functions import text as X
from curaspark.operators import pairs as J
from curaspark.operators import textpairs as T


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        nxt = [i]
        for j, y in enumerate(b, 1):
            nxt.append(min(nxt[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = nxt
    return row[-1]


def plain_words(a, b):
    a, b = set(a), set(b)
    same = a & b
    score = float(len(same))
    for x in a:
        for y in b:
            if x != y and min(len(x), len(y)) >= 3:
                if x in y or y in x:
                    score += 0.8
                elif x not in same and y not in same and distance(x, y) <= 2:
                    score += 0.6
    return score / len(a | b) if a | b else 0.0


def plain_score(s, t):
    if not s or not t:
        return 0.0
    s, t = s.lower().strip(), t.lower().strip()
    if s == t:
        return 1.0
    if s in t or t in s:
        return 0.9
    cut = [{p.strip() for sep in (",", "\n", "\r\n") for p in u.split(sep)} - {""} for u in (s, t)]
    both = cut[0] & cut[1]
    if both:
        ratio = len(both) / len(cut[0] | cut[1])
        return min(0.95, ratio * 1.3) if len(both) >= 2 else ratio
    return min(0.7, plain_words(s.split(), t.split()))


WORDS = ["cat", "cats", "catalogue", "dog", "dot", "night", "knight", "nights", "sky", "s", "ab", "blue sky", "deep blue", "river bank"]


def texts(n, seed):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        parts = [" ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(1, 6))]
        out.append(rng.choice([", ", "\n", " "]).join(parts))
    # copies, parts of other texts, near copies and empties
    out += [rng.choice(out) for _ in range(n // 4)] + [rng.choice(out)[3:20] for _ in range(n // 4)]
    out += [rng.choice(out) + ", " + rng.choice(WORDS) for _ in range(n // 3)] + ["", "  ", "a"]
    return out


def test_word_score():
    rng = random.Random(5)
    pool = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 7))) for _ in range(60)]
    long = "".join(rng.choice("abc") for _ in range(25))
    pool += [long, long[:-1], long[:-2], long + "a", "b" + long[1:], "x" * 23 + "yz", "x" * 25, "x" * 30]
    for _ in range(200):
        a, b = rng.sample(pool, rng.randint(0, 14)), rng.sample(pool, rng.randint(0, 14))
        assert abs(fuzzy.word_score(a, b) - plain_words(a, b)) < 1e-12


def test_text_similarity(spark):
    rng = random.Random(6)
    pool = texts(60, 7)
    rows = [(rng.choice(pool), rng.choice(pool)) for _ in range(400)]
    df = spark.createDataFrame(rows, "a string, b string")
    for r in df.select("a", "b", X.text_similarity("a", "b").alias("s")).collect():
        assert abs(r.s - plain_score(r.a, r.b)) < 1e-12, (r.a, r.b)


@pytest.mark.parametrize("threshold", [0.85, 0.75, 0.5, 0.2])
def test_text_pairs(spark, threshold):
    rng = random.Random(8)
    pos = texts(70 if threshold > 0.7 else 45, 9)
    rows = [(i, p, rng.choice(["blurry", "blurry, dark", "dark", "", "bad night"])) for i, p in enumerate(pos)]
    found = T.text_pairs(spark.createDataFrame(rows, "id long, p string, n string"), "id", "p", "n", threshold)
    member = {r["id"]: r["cls"] for r in found.members.collect()}
    own = {r["cls"]: r["self_score"] for r in found.classes.collect()}
    rows_found = found.pairs.collect()
    score = {(r["c"], r["d"]): r["score"] for r in rows_found}
    assert len(score) == len(rows_found)
    for i, p, n in rows:
        for j, q, m in rows[i + 1 :]:
            want = round(0.7 * plain_score(p, q) + 0.3 * plain_score(n, m), 9)
            a, b = sorted((member[i], member[j]))
            got = own[a] if a == b else score.get((a, b))
            assert (got is not None) == (want >= threshold), (p, q, n, m, want, got)
            assert got is None or abs(got - want) < 1e-6


def test_related_words(spark):
    rng = random.Random(11)
    pool = {"".join(rng.choice("abé") for _ in range(rng.randint(1, 8))) for _ in range(150)} | {"x" * 30, "x" * 28 + "y", "catalogue", "cat"}
    got = {(r.w, r.v): r.weight for r in T.related_words(spark.createDataFrame([(w,) for w in pool], "word string")).collect()}
    for a in pool:
        for b in pool:
            if a == b:
                want = 1.0
            elif min(len(a), len(b)) < 3:
                want = None
            elif a in b or b in a:
                want = 0.8
            else:
                want = 0.6 if fuzzy._near(a, b) else None
            assert got.get((a, b)) == want, (a, b)


@pytest.mark.parametrize("threshold", [0.7, 0.4, 0.25])
def test_set_pairs(spark, threshold):
    rng = random.Random(10)
    rows = []
    for i in range(140):
        size = rng.choice([0, 1, 2, 3, 4, 6, 60])
        pool = [f"m{k}" for k in range(70 if size == 60 else 12)]
        rows.append((i, rng.sample(pool, size), rng.sample(["x", "y", "z"], rng.randint(0, 2))))
    found = J.set_pairs(spark.createDataFrame(rows, "id long, m array<string>, l array<string>"), "id", "m", "l", threshold)
    member = {r["id"]: r["cls"] for r in found.members.collect()}
    own = {r["cls"]: r["self_score"] for r in found.classes.collect()}
    score = {(r["c"], r["d"]): r["score"] for r in found.pairs.collect()}

    def jac(a, b):
        a, b = set(a), set(b)
        return len(a & b) / len(a | b) if a | b else 0.0

    for i, m1, l1 in rows:
        for j, m2, l2 in rows[i + 1 :]:
            if not (m1 or l1) and not (m2 or l2):
                want = 1.0
            elif not (m1 or l1) or not (m2 or l2):
                want = 0.0
            else:
                want = jac(m1, m2) * 0.7 + jac(l1, l2) * 0.3
            a, b = sorted((member[i], member[j]))
            got = own[a] if a == b else score.get((a, b))
            assert (got is not None) == (round(want, 9) >= threshold), (m1, l1, m2, l2, want)


def test_hist_pairs_with_pivots(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    base = rng.dirichlet([0.3] * 6, size=50)
    df = spark.createDataFrame([(i, h.tolist()) for i, h in enumerate(base)], "id long, h array<double>")
    found = J.hist_pairs(df, "id", "h", 0.25, block_rows=3).rows().collect()
    want = {(i, j) for i in range(50) for j in range(i + 1, 50) if round(np.abs(base[i] - base[j]).sum() / 2, 9) <= 0.25}
    assert {(r["i"], r["j"]) for r in found} == want


def test_text_functions(spark):
    df = spark.createDataFrame([("a\\,b,c",), ("x",), ("p,,q,",)], "s string")
    got = [r[0] for r in df.select(X.split_escaped("s")).collect()]
    assert got == [["a,b", "c"], ["x"], ["p", "", "q"]]
    one = spark.range(1).select(
        X.strip_emphasis(F.lit("a BREAK (red:1.2) [sky] <lora:x:1>")).alias("e"), X.parse_size(F.lit("512 X 768")).alias("s"), X.reduced_ratio(F.lit(1920), F.lit(1080)).alias("r"),
        X.rotation_degrees(F.lit("450_cw")).alias("d"), X.rotation_degrees(F.lit("45")).alias("n"),
    ).first()
    assert (one.e, tuple(one.s), tuple(one.r), one.d, one.n) == ("red sky ", (512, 768), (16, 9), 90, None)
