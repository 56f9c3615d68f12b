"""Vector, histogram and colour-signature expressions on array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dot(a, b) -> Column:
    """Dot product of two numeric arrays in double precision."""
    products = F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a) -> Column:
    return F.sqrt(F.aggregate(_col(a), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a, b) -> Column:
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size).otherwise(F.lit(0.0))


def l2_normalize(a) -> Column:
    """Unit-length copy of the vector; the zero vector stays as it is."""
    n = norm(a)
    return F.transform(_col(a), lambda x: F.when(n > 0, x.cast("double") / n).otherwise(x.cast("double")))


def combine_vectors(pos, neg, weight: float = 0.5) -> Column:
    """pos − weight·neg, element by element; a missing negative leaves pos unchanged."""
    p, n = _col(pos), _col(neg)
    mixed = F.zip_with(p, n, lambda x, y: x.cast("double") - F.lit(weight) * y.cast("double"))
    return F.when(n.isNull(), F.transform(p, lambda x: x.cast("double"))).otherwise(mixed)


def l1_half(a, b) -> Column:
    """Half of the L1 distance between two histograms."""
    diffs = F.zip_with(_col(a), _col(b), lambda x, y: F.abs(x.cast("double") - y.cast("double")))
    return F.aggregate(diffs, F.lit(0.0), lambda s, x: s + x) / F.lit(2.0)


def delta_e76(a, b) -> Column:
    """Per-cell CIE76 difference of two arrays of struct<l,a,b>, truncated to int."""

    def cell(x: Column, y: Column) -> Column:
        parts = [(x[c] - y[c]) * (x[c] - y[c]) for c in ("l", "a", "b")]
        return F.sqrt(parts[0] + parts[1] + parts[2]).cast("int")

    return F.zip_with(_col(a), _col(b), cell)


# Fixed values of the run test: length a run must pass, number of passes it must exceed.
RUN_LENGTH = 10
RUN_COUNT = 10


def run_test(flags, needed: int) -> Column:
    """Consecutive-run test over a boolean array.

    True once the match count (starting at 1) exceeds ``needed`` and more than RUN_COUNT matches
    followed another match while the running total of such matches was above RUN_LENGTH. The running
    total is never reset. Both counters only grow, so testing after the last element is enough.
    """
    zero = F.struct(
        F.lit(1).alias("hits"), F.lit(1).alias("run"), F.lit(0).alias("runs"), F.lit(False).alias("prior")
    )

    def step(acc: Column, flag: Column) -> Column:
        linked = flag & acc["prior"]
        run = acc["run"] + linked.cast("int")
        return F.struct(
            (acc["hits"] + flag.cast("int")).alias("hits"),
            run.alias("run"),
            (acc["runs"] + (linked & (run > RUN_LENGTH)).cast("int")).alias("runs"),
            flag.alias("prior"),
        )

    def finish(acc: Column) -> Column:
        return (acc["hits"] > needed) & (acc["runs"] > RUN_COUNT)

    return F.aggregate(_col(flags), zero, step, finish)


def match_label(score, duplicate: float, related: float, higher_is_better: bool = True) -> Column:
    """'duplicate', 'probable' or 'similar' from two thresholds in the mode's direction."""
    s = _col(score)
    if higher_is_better:
        return F.when(s > duplicate, "duplicate").when(s > related, "probable").otherwise("similar")
    return F.when(s < duplicate, "duplicate").when(s < related, "probable").otherwise("similar")
