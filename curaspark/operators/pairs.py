"""Exact threshold self-joins over vectors, histograms, colour signatures and token sets.

Every join first collapses identical items into one *class*, so that a block of copies costs one
row instead of a quadratic number of pairs. Results come as a :class:`PairSet`: which class each
item belongs to, the classes with their sizes, and the pairs between distinct classes. The full
pair relation is exactly (members × members) over those pairs plus, for classes with a
``self_score``, the pairs inside the class; grouping and duplicate operators work on the compact
form and never build the expanded one.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curaspark.functions import vec as V
from curaspark.operators import blocks as B
from curaspark.operators import products as P
from curaspark.scale import broadcast_if_small, row_index
from curaspark.session import checkpoint


@dataclass(frozen=True)
class PairSet:
    """members(id, cls) · classes(cls, n, self_score) · pairs(c, d, score) with c < d · sizes: work of a block join."""

    members: DataFrame
    classes: DataFrame
    pairs: DataFrame
    sizes: DataFrame | None = None

    def rows(self) -> DataFrame:
        """One row per pair of classes plus one row (i = j) per class holding similar copies."""
        # only classes of copies are looked up, so pairs do not travel where these are few
        copies = broadcast_if_small(self.classes.filter("n > 1").select("cls", "n"))
        one = F.lit(1).cast("bigint")
        between = (
            self.pairs.join(copies.select(F.col("cls").alias("c"), F.col("n").alias("n_i")), "c", "left")
            .join(copies.select(F.col("cls").alias("d"), F.col("n").alias("n_j")), "d", "left")
            .select(F.col("c").alias("i"), F.col("d").alias("j"), "score", F.coalesce("n_i", one).alias("n_i"), F.coalesce("n_j", one).alias("n_j"))
        )
        within = self.classes.filter((F.col("n") > 1) & F.col("self_score").isNotNull()).select(
            F.col("cls").alias("i"), F.col("cls").alias("j"), F.col("self_score").alias("score"),
            F.col("n").alias("n_i"), F.col("n").alias("n_j"),
        )
        return between.unionByName(within)

    def compared(self) -> float:
        """Share of all pairs of classes that a block join compared; the bounds ruled the others out."""
        n = self.classes.count()
        return B.compared_pairs(self.sizes) / max(1, n * (n - 1) // 2)

    def adjacency(self) -> DataFrame:
        """Both directions of every class pair plus the self edge of classes of similar copies: (cls, d, score)."""
        # pairs may be computed as they are read, so they are read once
        ways = F.explode(F.array(F.struct(F.col("c").alias("cls"), "d"), F.struct(F.col("d").alias("cls"), F.col("c").alias("d"))))
        both = self.pairs.select(ways.alias("w"), "score").select("w.cls", "w.d", "score")
        own = self.classes.filter(F.col("self_score").isNotNull() & (F.col("n") > 1)).select(
            "cls", F.col("cls").alias("d"), F.col("self_score").alias("score")
        )
        return both.unionByName(own)


# --------------------------------------------------------------------------- classes


def _classes(df: DataFrame, ident: str, payload: list[str], key: Column, self_score: Column):
    """Collapse rows with the same payload; rows that do not match themselves stay alone."""
    base = df.select(F.col(ident).alias("id"), *payload).withColumn("_self", self_score)
    digest = F.unhex(F.sha2(key, 256))
    base = base.withColumn(
        "_key", F.when(F.col("_self").isNotNull(), digest).otherwise(
            F.concat(F.lit("row:"), F.col("id").cast("string")).cast("binary")
        )
    )
    classes = checkpoint(
        base.groupBy("_key").agg(
            F.min("id").alias("cls"),
            F.count(F.lit(1)).alias("n"),
            F.first("_self").alias("self_score"),
            *[F.first(c).alias(c) for c in payload],
        )
    )
    members = base.select("id", "_key").join(classes.select("_key", "cls"), "_key").select("id", "cls")
    return members, classes.drop("_key")


# --------------------------------------------------------------------------- joins


def _joined(members: DataFrame, classes: DataFrame, placed: DataFrame, kernel: B.Kernel, block_rows: int | None, join: Callable = B.block_join) -> PairSet:
    placed = checkpoint(placed)
    sizes = checkpoint(B.work(placed))
    rows = B.block_size(classes.count(), block_rows, B.width_of(classes))
    # blocks of one size are not cut again because a hash deals unevenly; pairs are not stored, there may be very many
    pairs = join(placed, sizes, kernel, 2 * rows)
    return PairSet(members, classes.select("cls", "n", "self_score"), pairs, sizes)


@dataclass(frozen=True)
class NearSet:
    """What grouping needs of a pair set, without a row for every pair.

    items(id, cls, idx): all items in id order · vecs(idx, cls, vec): the items without copies · near(pos, hit, score, up): of each of
    these the nearest similar one on both sides · copies: the pairs with a class of copies on one side at least.
    """

    items: DataFrame
    vecs: DataFrame
    near: DataFrame
    copies: PairSet
    kernel: B.Kernel

    def seek(self, queries: DataFrame, marks: DataFrame | None = None, up: bool = False, sign: float = 1.0) -> DataFrame:
        """(pos, score, hit) for queries (pos, cls, and if needed edge, ban, bound, least): the nearest item without copies that is similar to
        the one of class ``cls``. ``marks`` (hit, mark) names what a ``ban`` rules out."""
        free = {"edge": F.col("pos"), "ban": F.lit(-1).cast("bigint"), "bound": F.lit(float("-inf")), "least": F.lit(0.0)}
        asked = queries.join(self.vecs.select("cls", "vec"), "cls").select(
            F.col("pos").alias("key"), *[(F.col(n) if n in queries.columns else c).alias(n) for n, c in free.items()], "vec"
        )
        items = self.vecs.select(F.col("idx").alias("pos"), "vec")
        none = F.lit(-2).cast("bigint")
        items = items.withColumn("mark", none) if marks is None else items.join(
            marks.select(F.col("hit").alias("pos"), "mark"), "pos", "left"
        ).withColumn("mark", F.coalesce("mark", none))
        return P.seek(items, checkpoint(asked), self.kernel, up, sign).select(F.col("key").alias("pos"), "score", "hit")


def _near(members: DataFrame, classes: DataFrame, radius: float, metric: str, kernel: B.Kernel, block_rows: int | None) -> NearSet:
    items = row_index(members, [F.col("id")])
    alone = classes.filter("n = 1").select("cls", "vec")
    vecs = checkpoint(alone.join(items.select("cls", "idx"), "cls").select("idx", "cls", "vec"))
    places = vecs.select(F.col("idx").alias("cls"), "vec")
    placed = checkpoint(B.metric_cells(places, radius, metric, block_rows))
    rows = B.block_size(vecs.count(), block_rows, B.width_of(vecs))
    near = checkpoint(B.nearest_join(placed, checkpoint(B.work(placed)), kernel, 2 * rows))
    return NearSet(items, vecs, near, _copies(members, classes, kernel), kernel)


def _copies(members: DataFrame, classes: DataFrame, kernel: B.Kernel) -> PairSet:
    """The pairs with a class of copies on one side at least."""
    many = classes.filter("n > 1").select(F.col("cls").alias("key"), "vec")
    found = P.found_pairs(classes.select(F.col("cls").alias("id"), "vec"), many, kernel).filter("id != key")
    pairs = checkpoint(found.select(F.least("id", "key").alias("c"), F.greatest("id", "key").alias("d"), "score").dropDuplicates(["c", "d"]))
    return PairSet(members, classes.select("cls", "n", "self_score"), pairs)


def _dot_classes(df: DataFrame, ident: str, vec: str, threshold: float) -> tuple[DataFrame, DataFrame, float]:
    """Members, classes and the radius within which partners lie."""
    if threshold < 0:
        raise ValueError("threshold must not be negative")
    base = df.filter(F.col(vec).isNotNull()).select(F.col(ident).alias("id"), F.col(vec).alias("vec"))
    own = F.round(V.dot("vec", "vec"), 9)
    members, classes = _classes(
        base, "id", ["vec"], F.col("vec").cast("string"), F.when(own > threshold, own)
    )
    longest = classes.agg(F.max(V.dot("vec", "vec"))).first()[0] or 0.0
    # |x - y|² = |x|² + |y|² - 2 x·y
    return members, classes, math.sqrt(max(0.0, 2.0 * longest - 2.0 * threshold))


def similar_pairs(df: DataFrame, ident: str, vec: str, threshold: float, block_rows: int | None = None) -> PairSet:
    """Pairs whose dot product is strictly above ``threshold`` (score rounded to 9 places)."""
    members, classes, radius = _dot_classes(df, ident, vec, threshold)
    placed = B.metric_cells(classes.select("cls", "vec"), radius, "l2", block_rows)
    return _joined(members, classes, placed, B.dot_kernel(threshold), block_rows)


def similar_near(df: DataFrame, ident: str, vec: str, threshold: float, block_rows: int | None = None) -> NearSet:
    """What grouping needs of ``similar_pairs``."""
    members, classes, radius = _dot_classes(df, ident, vec, threshold)
    return _near(members, classes, radius, "l2", B.dot_kernel(threshold), block_rows)


def readd_pairs(old: PairSet, df: DataFrame, ident: str, vec: str, threshold: float) -> PairSet:
    """The pairs of all rows of ``df``, from those found before and the products of new vectors with all.

    ``df`` holds the items of ``old`` that are still there and the ones added (again) since; vectors of known items must not have
    changed. Only classes without a known item are compared, with each other and with the rest.
    """
    base = df.filter(F.col(vec).isNotNull()).select(F.col(ident).alias("id"), F.col(vec).alias("vec"))
    own = F.round(V.dot("vec", "vec"), 9)
    members, classes = _classes(base, "id", ["vec"], F.col("vec").cast("string"), F.when(own > threshold, own))
    members = checkpoint(members)
    # classes are named by their smallest member, which may have come or gone
    names = checkpoint(
        old.members.withColumnRenamed("cls", "was").join(members, "id").groupBy("was").agg(F.min("cls").alias("cls"))
    )
    kept = old.pairs.join(names.select(F.col("was").alias("c"), F.col("cls").alias("c2")), "c").join(names.select(F.col("was").alias("d"), F.col("cls").alias("d2")), "d")
    kept = kept.select(F.least("c2", "d2").alias("c"), F.greatest("c2", "d2").alias("d"), "score")
    fresh = classes.join(names.select("cls"), "cls", "left_anti")
    found = P.matches(
        classes.select(F.col("cls").alias("id"), "vec"), fresh.select(F.col("cls").alias("key"), "vec"), threshold
    ).filter("id != key").select(F.least("id", "key").alias("c"), F.greatest("id", "key").alias("d"), "score").dropDuplicates(["c", "d"])
    return PairSet(members, classes.select("cls", "n", "self_score"), checkpoint(kept.unionByName(found)))


def readd_near(old: NearSet, df: DataFrame, ident: str, vec: str, threshold: float) -> NearSet:
    """What grouping needs of ``readd_pairs``, from the nearest items found before and the products of new vectors with all.

    Known are the items without copies, before and now; their nearest known item stays unless it left or has copies now. Only the
    others are looked for among all, and for the known ones the nearest of the others.
    """
    members, classes, _ = _dot_classes(df, ident, vec, threshold)
    kernel = B.dot_kernel(threshold)
    items = row_index(members, [F.col("id")])
    vecs = checkpoint(classes.filter("n = 1").select("cls", "vec").join(items.select("cls", "idx"), "cls").select("idx", "cls", "vec"))
    # an item without copies names its class
    places = old.vecs.select(F.col("idx").alias("was"), "cls").join(vecs.select("cls", "idx"), "cls").select("was", "idx")
    places = checkpoint(places)
    moved = old.near.join(places.select(F.col("was").alias("pos"), F.col("idx").alias("at")), "pos").join(
        places.select(F.col("was").alias("hit"), F.col("idx").alias("near")), "hit", "left"
    )
    moved = checkpoint(moved.select(F.col("at").alias("pos"), F.col("near").alias("hit"), "score", "up"))
    known = vecs.join(places.select("idx"), "idx", "left_semi")
    fresh = vecs.join(places.select("idx"), "idx", "left_anti")
    lost = vecs.join(moved.filter("hit is null").select(F.col("pos").alias("idx")).distinct(), "idx", "left_semi")

    def sides(asked: DataFrame, among: DataFrame) -> DataFrame:
        rows = among.select(F.col("idx").alias("pos"), F.lit(-2).cast("bigint").alias("mark"), "vec")
        free = [F.lit(-1).cast("bigint").alias("ban"), F.lit(float("-inf")).alias("bound"), F.lit(0.0).alias("least")]
        asked = checkpoint(asked.select(F.col("idx").alias("key"), F.col("idx").alias("edge"), *free, "vec"))
        both = [P.seek(rows, asked, kernel, up).select(F.col("key").alias("pos"), "hit", "score", F.lit(up).alias("up")) for up in (False, True)]
        return both[0].unionByName(both[1])

    found = moved.filter("hit is not null").unionByName(sides(fresh.unionByName(lost), vecs)).unionByName(sides(known, fresh))
    sign = F.when(F.col("up"), -1).otherwise(1)
    nearest = found.groupBy("pos", "up").agg(F.max(F.struct((F.col("hit") * sign).alias("at"), "score")).alias("m"))
    near = checkpoint(nearest.select("pos", (F.col("m.at") * sign).alias("hit"), "m.score", "up"))
    return NearSet(items, vecs, near, _copies(members, classes, kernel), kernel)


def _hist_classes(df: DataFrame, ident: str, hist: str) -> tuple[DataFrame, DataFrame]:
    base = df.filter(F.col(hist).isNotNull()).select(F.col(ident).alias("id"), F.col(hist).alias("vec"))
    return _classes(base, "id", ["vec"], F.col("vec").cast("string"), F.lit(0.0))


def hist_pairs(df: DataFrame, ident: str, hist: str, threshold: float = 0.2, block_rows: int | None = None) -> PairSet:
    """Pairs of histograms whose half L1 distance is at most ``threshold``; lower is closer."""
    members, classes = _hist_classes(df, ident, hist)
    placed = B.metric_cells(classes.select("cls", "vec"), threshold, "l1", block_rows)
    return _joined(members, classes, placed, B.l1_kernel(threshold), block_rows)


def hist_near(df: DataFrame, ident: str, hist: str, threshold: float = 0.2, block_rows: int | None = None) -> NearSet:
    """What grouping needs of ``hist_pairs``."""
    members, classes = _hist_classes(df, ident, hist)
    return _near(members, classes, threshold, "l1", B.l1_kernel(threshold), block_rows)


def color_pairs(df: DataFrame, ident: str, lab: str, threshold: float = 15, block_rows: int | None = None) -> PairSet:
    """Pairs of colour signatures (flat l,a,b,l,a,b… arrays, one length) that pass the run test; score Σ ΔE.

    The run test of ``functions.vec.run_test`` comes to two counts: matching cells, and matching cells that follow
    another one. Both need a number of equal cells, so signatures are looked up by quantised cells.
    """
    base = df.filter(F.col(lab).isNotNull()).select(F.col(ident).alias("id"), F.col(lab).alias("vec"))
    cells = F.floor(F.size("vec") / 3)
    linked = V.RUN_LENGTH + V.RUN_COUNT
    # identical signatures match in every cell, so they pass exactly when the run test can be passed
    alike = (cells + 1 > F.floor(cells / 2)) & (cells > linked)
    members, classes = _classes(
        base, "id", ["vec"], F.col("vec").cast("string"), F.when(alike & F.lit(threshold > 0), F.lit(0.0))
    )
    one = classes.first()
    matches = max((len(one["vec"]) // 3) // 2 if one is not None else 0, linked + 1)
    items = classes.select("cls", "vec")
    placed, chosen = B.pigeonhole_cells(items, float(max(1, math.ceil(threshold))), matches)
    # a pair may meet in many places: where signatures crowd in few grid cells, comparing every pair once is less work
    placed, n = checkpoint(placed), classes.count()
    if chosen and B.compared_pairs(B.work(placed)) > n * (n - 1) // 2:
        placed, chosen = B.all_blocks(items, B.block_size(n, block_rows, B.width_of(items))), None
    # grid cells are many and small
    join = B.block_join if chosen is None else B.visit_join
    return _joined(members, classes, placed, B.color_kernel(threshold, matches, linked, chosen), block_rows, join)


# Sets whose two-token prefix is longer than this are indexed by single tokens.
LONG_PREFIX = 24
# Slots in which tokens are counted.
TOKEN_SLOTS = 1 << 20


def token_candidates(sets: DataFrame, ident: str, tokens: str, min_jaccard: float) -> DataFrame:
    """Candidate pairs (c, d) of all rows whose token sets have a Jaccard index ≥ ``min_jaccard``.

    Prefix filter: with tokens ordered from rare to frequent (by slots) and a = ⌈t·|s|⌉ common tokens needed,
    two such sets share at least k tokens among the first |s| − a + k of each. Sets needing two or
    more common tokens are joined on pairs of prefix tokens (k = 2), which are far rarer than single
    tokens; very small and very long sets are joined with all others on single ones (k = 1).
    """
    rows = sets.filter(F.size(tokens) > 0).select(F.col(ident).alias("cls"), F.transform(tokens, lambda t: F.xxhash64(t)).alias("toks"))
    # tokens are counted by slots: any order of tokens is right, so those that share a slot may share their numbers
    counts = np.zeros(TOKEN_SLOTS, np.int64)
    slots = rows.select(F.explode("toks").alias("h")).groupBy(F.pmod("h", F.lit(TOKEN_SLOTS)).alias("slot")).count().toArrow()
    counts[slots.column("slot").to_numpy()] = slots.column("count").to_numpy()  # at most TOKEN_SLOTS rows
    held = sets.sparkSession.sparkContext.broadcast(counts)

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            n = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            h = lists.flatten().to_numpy(zero_copy_only=False)
            df = held.value[h % TOKEN_SLOTS]
            row = np.repeat(np.arange(len(n)), n)
            order = np.lexsort((h, df, row))
            h, df = h[order], df[order]
            need = np.ceil(n * min_jaccard - 1e-9).astype(np.int64)
            place = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            columns = [batch.column(0), pa.array(n.astype(np.int32))]
            for more in (1, 2):
                # a token of one set joins nothing, but it still counts in the order
                keep = (place < (n - need + more)[row]) & (df > 1)
                ends = np.concatenate([[0], np.cumsum(np.bincount(row[keep], minlength=len(n)))])
                columns.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(h[keep], pa.int64())))
            columns.append(pa.array((need < 2) | (n - need + 2 > LONG_PREFIX)))
            # every token sets one of 64 bits
            bits = np.zeros(len(n), np.int64)
            np.bitwise_or.at(bits, row, np.int64(1) << (h & 63))
            columns.append(pa.array(bits))
            yield pa.RecordBatch.from_arrays(columns, names=["cls", "size", "one", "two", "special", "bits"])

    kinds = T._parse_datatype_string("size int, one array<bigint>, two array<bigint>, special boolean, bits bigint").fields
    base = checkpoint(rows.mapInArrow(prefixes, T.StructType([rows.schema["cls"], *kinds])))

    def sides(keyed: DataFrame, key: str, left: DataFrame | None = None) -> DataFrame:
        a, b = ((d.select(F.col("cls").alias(f"_{n}"), F.col("size").alias(f"_s{n}"), F.col("bits").alias(f"_b{n}"), key)) for n, d in (
            ("a", left if left is not None else keyed), ("b", keyed)
        ))
        near = F.least("_sa", "_sb") >= F.greatest("_sa", "_sb") * F.lit(min_jaccard) - 1e-9
        # tokens in common are at most the bits in common and, of either set, the tokens that share their bit with another one
        most = F.bit_count(F.col("_ba").bitwiseAND(F.col("_bb"))) + F.least(F.col("_sa") - F.bit_count("_ba"), F.col("_sb") - F.bit_count("_bb"))
        enough = most * (1 + min_jaccard) >= (F.col("_sa") + F.col("_sb")) * min_jaccard - 1e-6
        different = F.col("_a") < F.col("_b") if left is None else F.col("_a") != F.col("_b")
        return a.join(b, key).filter(different & near & enough).select(F.least("_a", "_b").alias("c"), F.greatest("_a", "_b").alias("d"))

    singles = base.select("cls", "size", "bits", "special", F.explode("one").alias("h"))
    # a pair of tokens travels as one number
    couples = F.flatten(F.transform("two", lambda x, i: F.transform(F.slice("two", i + 2, F.size("two")), lambda y: F.xxhash64(x, y))))
    doubles = base.filter(~F.col("special")).select("cls", "size", "bits", F.explode(couples).alias("k"))
    return sides(doubles, "k").unionByName(sides(singles, "h", singles.filter("special"))).distinct()


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard index of two distinct arrays, 0 when both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


# Fixed values of the two-part set score.
MODEL_WEIGHT = 0.7
LORA_WEIGHT = 0.3


def set_similarity(m1: Column, l1: Column, m2: Column, l2: Column) -> Column:
    """0.7·J(models) + 0.3·J(loras); two empty items score 1, one empty item scores 0."""
    empty1 = (F.size(m1) == 0) & (F.size(l1) == 0)
    empty2 = (F.size(m2) == 0) & (F.size(l2) == 0)
    mixed = jaccard(m1, m2) * MODEL_WEIGHT + jaccard(l1, l2) * LORA_WEIGHT
    return F.when(empty1 & empty2, F.lit(1.0)).when(empty1 | empty2, F.lit(0.0)).otherwise(mixed)


#: Stands for "above 0".
ANY = 1e-6


def two_sided(
    owner: DataFrame, p_scored: Callable[[float], DataFrame], n_scored: Callable[[float], DataFrame], weights: tuple[float, float], threshold: float
) -> DataFrame:
    """(c, d, score), c < d, of items (cls, p, n) whose weighted scores of both sides come to ``threshold`` (above 0).

    p and n name the item's value on a side, null where it has none, which is worth nothing. ``p_scored(least)`` gives the
    pairs (c, d, score) of different values of a side that score at least that much; equal values score 1. Each side is
    scored once per pair of values, so an item costs one row however popular its values are.
    """
    p_weight, n_weight = weights

    def both_ways(scored: DataFrame, side: str, equal: bool = True) -> DataFrame:
        """(side, side2, score) in both directions, equal values included if asked."""
        every = scored.select("c", "d", "score").unionByName(scored.select(F.col("d").alias("c"), F.col("c").alias("d"), "score"))
        if equal:
            every = every.unionByName(
                owner.filter(F.col(side).isNotNull()).select(F.col(side).alias("c"), F.col(side).alias("d"), F.lit(1.0).alias("score")).distinct()
            )
        return every.select(F.col("c").alias(side), F.col("d").alias(f"{side}2"), F.col("score").alias(f"{side}s"))

    # the least that each side has to give when the other one gives all it can
    p_need, n_need = (threshold - n_weight) / p_weight, (threshold - p_weight) / n_weight
    p_scores = p_scored(max(p_need, ANY))
    p_pairs = both_ways(p_scores, "p")
    n_pairs = both_ways(n_scored(max(n_need, ANY)), "n")
    left = owner.select(F.col("cls").alias("c"), "p", "n")
    right = owner.select(F.col("cls").alias("d"), F.col("p").alias("p2"), F.col("n").alias("n2"))
    if n_need > 0:
        met = left.join(p_pairs, "p").join(n_pairs, "n").join(right, ["p2", "n2"]).select("c", "d", "ps", "ns")
    else:
        # the second side may be worth nothing; items with equal values meet by the value itself
        alike = left.join(right.withColumn("p", F.col("p2")), "p").withColumn("ps", F.lit(1.0))
        unlike = left.join(both_ways(p_scores, "p", equal=False), "p").join(right, "p2").select(*alike.columns)
        met = alike.unionByName(unlike).filter("c < d").join(n_pairs, ["n", "n2"], "left").select("c", "d", "ps", "ns")
    if p_need <= 0:
        alone = n_pairs.filter(F.col("ns") * n_weight >= threshold - 1e-9)
        met = met.unionByName(
            left.join(alone, "n").join(right, "n2").filter("c < d").join(p_pairs, ["p", "p2"], "left").select("c", "d", "ps", "ns")
        ).distinct()
    total = F.coalesce("ps", F.lit(0.0)) * p_weight + F.coalesce("ns", F.lit(0.0)) * n_weight
    return met.filter("c < d").select("c", "d", total.alias("raw")).filter(F.round("raw", 9) >= threshold).select("c", "d", F.round("raw", 9).alias("score"))


def scored_sets(sets: DataFrame, least: float) -> DataFrame:
    """(c, d, score), c < d, of distinct token sets (cls, toks) whose Jaccard index is at least ``least`` (above 0)."""
    found = token_candidates(sets, "cls", "toks", least)
    left, right = sets.select(F.col("cls").alias("c"), F.col("toks").alias("a")), sets.select(F.col("cls").alias("d"), F.col("toks").alias("b"))
    scored = found.join(left, "c").join(right, "d").select("c", "d", jaccard(F.col("a"), F.col("b")).alias("score"))
    return checkpoint(scored.filter(F.col("score") >= least - 1e-9))


def set_pairs(df: DataFrame, ident: str, models: str, loras: str, threshold: float = 0.7) -> PairSet:
    """Pairs of items whose two-part set score is at least ``threshold`` (any number above 0).

    Items fall into classes of equal pairs of sets; model sets and add-on sets are joined on their own, each set once.
    """
    if threshold <= 0:
        raise ValueError("the threshold must be above 0")
    empty = F.array().cast("array<string>")
    base = df.select(
        F.col(ident).alias("id"),
        F.array_sort(F.array_distinct(F.coalesce(F.col(models).cast("array<string>"), empty))).alias("m"),
        F.array_sort(F.array_distinct(F.coalesce(F.col(loras).cast("array<string>"), empty))).alias("l"),
    )
    own = set_similarity(F.col("m"), F.col("l"), F.col("m"), F.col("l"))
    members, classes = _classes(
        base, "id", ["m", "l"], F.to_json(F.struct("m", "l")), F.when(own >= threshold, F.round(own, 9))
    )
    named = classes.select("cls", "m", "l", *[F.when(F.size(s) > 0, F.unhex(F.md5(F.to_json(s)))).alias(k) for s, k in (("m", "p"), ("l", "n"))])

    def distinct_sets(side: str, key: str) -> DataFrame:
        return checkpoint(named.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("cls")).agg(F.first(side).alias("toks")))

    m_sets, l_sets = distinct_sets("m", "p"), distinct_sets("l", "n")
    scored = two_sided(
        checkpoint(named.select("cls", "p", "n")), lambda least: scored_sets(m_sets, least), lambda least: scored_sets(l_sets, least),
        (MODEL_WEIGHT, LORA_WEIGHT), threshold,
    )
    return PairSet(members, classes.select("cls", "n", "self_score"), checkpoint(scored))
