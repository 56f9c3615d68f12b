"""Name functions against plain Python statements of their rules on random names."""

import random
import re

from pyspark.sql import functions as F

from curaspark.functions import paths as P

PIECES = ["img", "a", "IMG1234", "cherry", "_", "__", "-", " ", ".", "12", "0007", "2", "über", "x1", "longwordlongword", "!!", "v2", "édit"]


def names(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(PIECES) for _ in range(rng.randint(1, 7))) for _ in range(n)]


def alnum(t):
    return any(c.isalnum() for c in t)


def expected_base(s):
    cut = re.split(r"([_\s\-.]+)", s)
    if len(cut) == 1:
        return s
    first, second = cut[0], cut[2]
    if len(first) >= 30:
        return first
    if len(second) <= 4:
        return first if len(first) >= 3 and alnum(first) else s
    two = "".join(cut[:3])
    if len(two) >= 10:
        return two
    if len(cut) > 4 and len(cut[4]) > 4 and alnum("".join(cut[:5])):
        return "".join(cut[:5])
    return two if alnum(two) else s


def expected_suffix(stem, suffixes):
    low = stem.lower()
    forms = {low}
    if low[-1:].isdigit():
        forms.add(re.sub(r"[_ ]*\d+$", "", low))
    for suffix in suffixes:
        core = suffix.lower().lstrip("_ ")
        for k in range(1, len(core) + 1):
            for form in forms:
                if form.endswith(core[:k]) and (len(form) == k or not form[-k - 1].isalnum()):
                    return True
    return False


def run(spark, texts, column):
    df = spark.createDataFrame(list(enumerate(texts)), "n int, s string")
    return [r[0] for r in df.orderBy("n").select(column).collect()]


def test_base_stem(spark):
    texts = names(4000, 1)
    assert run(spark, texts, P.base_stem_of("s")) == [expected_base(t) for t in texts]


def test_suffix_matches(spark):
    texts = names(4000, 2)
    for suffixes in (["_cherry"], ["v2", " x1"], ["2x", "_édit"]):
        assert run(spark, texts, P.suffix_matches("s", suffixes)) == [expected_suffix(t, suffixes) for t in texts]


def test_path_parts(spark):
    import os

    texts = [t + "/" + u for t, u in zip(names(1500, 3), names(1500, 4))]
    texts += ["/a/.bashrc", "/a/..x", "/a/b.", "plain", "/a/b.tar.gz"]
    assert run(spark, texts, P.basename("s")) == [os.path.basename(t) for t in texts]
    assert run(spark, texts, P.stem("s")) == [os.path.splitext(os.path.basename(t))[0] for t in texts]
    assert run(spark, texts, P.ext("s")) == [os.path.splitext(os.path.basename(t))[1] for t in texts]


def test_natural_key_orders_like_a_person(spark):
    texts = ["a10", "a2", "a", "a!", "b1", "a02x", "10", "9", "a10b", "a 5"]

    def key(t):
        return [int(p) if p.isdigit() else p for p in re.split(r"([0-9]+)", t.lower())]

    df = spark.createDataFrame([(t,) for t in texts], "s string")
    got = [r.s for r in df.orderBy(P.natural_key("s")).collect()]
    assert got == sorted(texts, key=key)


def test_boundary(spark):
    rows = [("img12_a", "img12", True), ("img123", "img12", False), ("img12a", "img12", True), ("imgs", "img", False), ("img", "img", True), ("xmg", "img", False)]
    df = spark.createDataFrame(rows, "f string, b string, ok boolean")
    assert all(r.ok == r.got for r in df.select("ok", P.boundary_ok("f", "b").alias("got")).collect())


def test_glob(spark):
    import fnmatch

    texts = names(500, 5)
    for pattern in ("*cherry*", "img?", "[!a]*", "a*2", "*.*"):
        got = run(spark, texts, F.col("s").rlike(P.glob_regex(pattern)))
        assert got == [fnmatch.fnmatchcase(t, pattern) for t in texts]
