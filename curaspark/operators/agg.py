"""Aggregations: centroids, signatures, diversity, votes, counts and class decisions."""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curaspark.functions import paths as P
from curaspark.functions import vec as V


# ------------------------------------------------------------------ vectors and histograms


def mean_vector(df: DataFrame, key: str, vec: str, name: str = "vec") -> DataFrame:
    """Element-wise mean per key, one running mean per element: a vector is one row all the way, partial sums are combined on
    the map side, and no group is ever collected. Null vectors count for nothing, shorter vectors end earlier."""
    rows = df.filter(F.col(vec).isNotNull()).select(key, F.col(vec).alias("_v"))
    width = rows.agg(F.max(F.size("_v"))).first()[0] or 0
    means = rows.groupBy(key).agg(
        F.max(F.size("_v")).alias("_n"), *[F.avg(F.get("_v", F.lit(i)).cast("double")).alias(f"_m{i}") for i in range(width)]
    )
    packed = F.array(*[F.col(f"_m{i}") for i in range(width)]).cast("array<double>")
    return means.filter("_n > 0").select(key, F.slice(packed, F.lit(1), F.col("_n")).alias(name))


def centroid(df: DataFrame, key: str, vec: str, name: str = "vec") -> DataFrame:
    """Mean vector per key, brought back to unit length (a zero mean stays zero)."""
    return mean_vector(df, key, vec, name).withColumn(name, V.l2_normalize(name))


def hist_bin(x: Column, lo: float, hi: float, bins: int) -> Column:
    """Bin of a value in [lo, hi]; the last bin includes its upper edge, values outside are null."""
    raw = F.floor((x - F.lit(float(lo))) / F.lit(float(hi - lo)) * bins)
    return F.when((x >= lo) & (x <= hi), F.least(raw, F.lit(bins - 1)).cast("int"))


def hist_signature(df: DataFrame, key: str, channels: Sequence[tuple[str, float, float, int]], name: str = "hist") -> DataFrame:
    """Concatenated per-channel histograms, each channel summing to 1. ``channels`` are (column, lo, hi, bins)."""
    tagged, offset, total_bins = [], 0, sum(c[3] for c in channels)
    for number, (column, lo, hi, bins) in enumerate(channels):
        tagged.append(
            F.struct(F.lit(number).alias("ch"), (F.lit(offset) + hist_bin(F.col(column), lo, hi, bins)).alias("slot"))
        )
        offset += bins
    cells = df.select(key, F.explode(F.array(*tagged)).alias("c")).select(key, "c.ch", "c.slot").filter("slot is not null")
    counts = cells.groupBy(key, "ch", "slot").agg(F.count(F.lit(1)).alias("n"))
    per_key = counts.groupBy(key).agg(
        F.map_from_entries(F.collect_list(F.struct("slot", F.struct("ch", "n")))).alias("m"),
        *[F.sum(F.when(F.col("ch") == i, F.col("n"))).alias(f"t{i}") for i in range(len(channels))],
    )
    totals = F.array(*[F.col(f"t{i}").cast("double") for i in range(len(channels))])

    def slot(i: Column) -> Column:
        hit = F.element_at("m", i.cast("int"))
        return F.when(hit.isNull(), F.lit(0.0)).otherwise(hit["n"] / F.element_at(totals, hit["ch"] + 1))

    return per_key.select(key, F.transform(F.sequence(F.lit(0), F.lit(total_bins - 1)), slot).alias(name))


def diversity(df: DataFrame, key: str, category: Column, slots: int = 64) -> DataFrame:
    """Shannon entropy of the category shares per key, relative to log2(slots), at most 1."""
    counts = df.select(key, category.alias("_c")).groupBy(key, "_c").agg(F.count(F.lit(1)).alias("_n"))
    sums = counts.groupBy(key).agg(
        F.sum("_n").alias("_t"), F.sum(F.col("_n") * F.log2(F.col("_n").cast("double"))).alias("_s")
    )
    entropy = F.log2(F.col("_t").cast("double")) - F.col("_s") / F.col("_t")
    return sums.select(key, F.least(entropy / F.lit(math.log2(slots)), F.lit(1.0)).alias("score"))


def breadth(df: DataFrame, key: str, hue: Column, saturation: Column, bins: int = 36, gate: float = 0.08) -> DataFrame:
    """Spread of hues among saturated rows per key; keys without such rows score 0."""
    keys = df.select(key).distinct()
    used = df.filter(saturation > gate)
    scored = diversity(used, key, hist_bin(hue, 0.0, 1.0, bins), bins)
    return keys.join(scored, key, "left").select(key, F.coalesce("score", F.lit(0.0)).alias("score"))


def dimension_map(df: DataFrame, ident: str, width: str = "width", height: str = "height") -> DataFrame:
    """Items by exact dimensions with the reduced ratio: one row per (w, h) with count and id range.

    The members themselves stay rows (join back on w, h), so a dimension shared by a large part of
    the items is not gathered into one array.
    """
    from curaspark.functions.text import reduced_ratio

    sized = df.filter((F.col(width) > 0) & (F.col(height) > 0))
    grouped = sized.groupBy(F.col(width).alias("w"), F.col(height).alias("h")).agg(
        F.count(F.lit(1)).alias("n_items"), F.min(ident).alias("first_id"), F.max(ident).alias("last_id")
    )
    return grouped.withColumn("_r", reduced_ratio("w", "h")).select("w", "h", "_r.rw", "_r.rh", "n_items", "first_id", "last_id")


# ------------------------------------------------------------------ counts and reports


def count_by_ext(df: DataFrame, path: str = "path") -> DataFrame:
    """Files per lower-cased extension plus rows for the total and the number of directories."""
    e = F.lower(P.ext(path))
    base = df.select(F.when(e == "", "(no extension)").otherwise(e).alias("ext"), P.dirname(path).alias("dir"))
    per_ext = base.groupBy("ext").agg(F.count(F.lit(1)).alias("n_files"))
    total = base.agg(F.count(F.lit(1)).alias("n_files")).select(F.lit("__total").alias("ext"), "n_files")
    dirs = base.select("dir").distinct().agg(F.count(F.lit(1)).alias("n_files")).select(
        F.lit("__subdirectories").alias("ext"), "n_files"
    )
    return per_ext.unionByName(total).unionByName(dirs)


def run_stats(verdicts: DataFrame, directory: str = "directory", action: str = "action", error: str = "error") -> DataFrame:
    """Evaluated rows and errors per directory and action with totals at every level."""
    shown = F.coalesce(F.col(action), F.lit("(no action)"))
    return (
        verdicts.withColumn("_a", shown)
        .rollup(F.col(directory).alias("directory"), F.col("_a").alias("action"))
        .agg(
            F.count(F.lit(1)).alias("n_evaluated"),
            F.sum(F.coalesce(F.col(error).cast("int"), F.lit(0))).alias("n_errors"),
            F.grouping_id().cast("int").alias("level"),
        )
    )


def report_groups(messages: DataFrame, keys: Sequence[str], member: str, show: int = 8) -> DataFrame:
    """Messages grouped by identity: count, the first ``show`` members, and how many are not shown."""
    ranked = messages.withColumn(
        "_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(member))
    ).filter(F.col("_rn") <= show)
    counts = messages.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_messages"))
    shown = ranked.groupBy(*keys).agg(F.sort_array(F.collect_list(member)).alias("shown"))
    return counts.join(shown, list(keys)).withColumn(
        "n_more", F.greatest(F.col("n_messages") - show, F.lit(0).cast("bigint"))
    )


def stem_overflow(df: DataFrame, path: str = "path", limit: int = 0, n_categories: int = 0) -> DataFrame:
    """Items per base stem and whether they exceed the limit (categories + 1 unless given)."""
    bound = limit if limit > 0 else n_categories + 1
    return df.groupBy(P.base_stem(path).alias("base_stem")).agg(F.count(F.lit(1)).alias("n_files")).withColumn(
        "overflow", F.col("n_files") > bound
    )


def set_id(df: DataFrame, path: str = "path") -> DataFrame:
    """Fingerprint of a set of paths that does not depend on their order.

    Count, sum and exclusive-or of per-path digests are combined on the map side, so the paths
    never have to meet in one place.
    """
    part = F.conv(F.substring(F.md5(F.col(path)), 1, 15), 16, 10).cast("bigint")
    other = F.conv(F.substring(F.md5(F.col(path)), 17, 15), 16, 10).cast("bigint")
    rows = df.select(F.col(path)).distinct().select(part.alias("a"), other.alias("b"))
    folded = rows.agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("a").cast("decimal(38,0)")).alias("s"), F.bit_xor("b").alias("x")
    )
    text = F.concat_ws(":", F.col("n").cast("string"), F.col("s").cast("string"), F.col("x").cast("string"))
    return folded.select("n", F.sha2(text, 256).alias("set_id"))


def policy_signature(rules: Sequence[dict]) -> str:
    """Hash over the active rules, for judging whether cached verdicts still hold."""
    active = [r for r in rules if r.get("is_active", True)]
    return hashlib.sha256(json.dumps(active, sort_keys=True, default=str).encode()).hexdigest()


# ------------------------------------------------------------------ score combination


def combine_and(scores: DataFrame, modes: int) -> DataFrame:
    """(id, mode, score) → ids present in all modes with the geometric mean of their best scores."""
    merged = merge_instances(scores)
    zero = F.min("score") <= 0
    return (
        merged.groupBy("id")
        .agg(
            F.count(F.lit(1)).alias("_m"),
            F.when(zero, F.lit(0.0)).otherwise(F.exp(F.avg(F.log(F.when(F.col("score") > 0, F.col("score")))))).alias("score"),
        )
        .filter(F.col("_m") == modes)
        .select("id", "score")
    )


def combine_or(scores: DataFrame) -> DataFrame:
    return scores.groupBy("id").agg(F.max("score").alias("score"))


def combine_weighted(scores: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Weighted mean over all enabled modes; an absent mode counts as 0."""
    weight = F.element_at(F.create_map(*[x for k, w in weights.items() for x in (F.lit(k), F.lit(float(w)))]), F.col("mode"))
    return merge_instances(scores).groupBy("id").agg(
        (F.sum(F.col("score") * weight) / F.lit(float(sum(weights.values())))).alias("score")
    )


def merge_instances(scores: DataFrame) -> DataFrame:
    """Several runs of one mode count with their best score."""
    return scores.groupBy("id", "mode").agg(F.max("score").alias("score"))


def normalize_score(score: Column, mode: str) -> Column:
    """Score on [0, 1], higher is better: colours 1 − s/4500, histograms 1 − s, others s."""
    if mode == "color":
        raw = 1 - score / F.lit(4500.0)
    elif mode == "histogram":
        raw = 1 - score
    else:
        raw = score
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw))


# ------------------------------------------------------------------ frames


def frame_vote(frames: DataFrame, key: str, match: Column, ratio: float, planned: Column | None = None,
               static: Column | None = None) -> DataFrame:
    """Whether enough frames of an item match: positives ≥ ⌈slots · ratio⌉, or a static item."""
    slots = F.count(F.lit(1)) if planned is None else F.max(planned)
    voted = frames.groupBy(key).agg(
        F.sum(match.cast("int")).alias("n_positive"), slots.cast("bigint").alias("n_slots"),
        *([F.bool_or(static).alias("_static")] if static is not None else []),
    )
    enough = F.col("n_positive") >= F.ceil(F.col("n_slots") * F.lit(ratio))
    if static is not None:
        enough = enough | F.coalesce(F.col("_static"), F.lit(False))
    return voted.withColumn("matched", enough).select(key, "n_positive", "n_slots", "matched")


def first_trigger(frames: DataFrame, key: str, slot: str, match: Column, ratio: float, start: int = 0) -> DataFrame:
    """First matching slot at or after ``start`` of every item whose scanned slots meet the vote (at least one)."""
    scanned = frames.filter(F.col(slot) >= start).groupBy(key).agg(
        F.count(F.lit(1)).alias("_n"), F.sum(match.cast("int")).alias("n_positive"),
        F.min(F.when(match, F.col(slot))).alias("slot"),
    )
    required = F.greatest(F.lit(1), F.ceil(F.col("_n") * F.lit(ratio)))
    return scanned.filter(F.col("n_positive") >= required).select(key, "slot", "n_positive")


def sample_count(total: Column, ratio: float, minimum: int, maximum: int) -> Column:
    """Number of samples: ⌊n · ratio⌋ limited to [min, max] and to n."""
    count = F.greatest(F.floor(total * F.lit(ratio)), F.lit(max(1, minimum)).cast("bigint"))
    return F.least(count, F.lit(max(1, maximum)).cast("bigint"), total)


def sample_slots(frames: DataFrame, key: str, slot: str, ratio: float, minimum: int, maximum: int) -> DataFrame:
    """Systematic sample of 0-based, gap-free slots: every step-th one, the first ``count`` of them."""
    totals = frames.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    joined = frames.join(totals, key).withColumn("_c", sample_count(F.col("_n"), ratio, minimum, maximum))
    step = F.greatest(F.lit(1).cast("bigint"), F.floor(F.col("_n") / F.col("_c")))
    return joined.filter((F.col(slot) % step == 0) & (F.floor(F.col(slot) / step) < F.col("_c"))).drop("_n", "_c")


def seek_position(slot: Column, planned: Column, total: Column, fps: Column, duration: Column, kind: Column) -> Column:
    """Page number or milliseconds of a sampled slot; null without enough information."""
    step = F.greatest(F.lit(1).cast("bigint"), F.floor(total / planned))
    actual = slot * step
    by_rate = F.floor(actual / fps * 1000)
    by_share = F.floor(slot / F.greatest(F.lit(1), planned - 1) * duration * 1000)
    value = F.when(kind == "pdf", actual).when(fps > 0, by_rate).when(duration > 0, by_share)
    return F.when((planned > 0) & (total > 0), value).cast("bigint")


def pseudostatic(frames: DataFrame, key: str, slot: str, vec: str, threshold: float = 0.03) -> DataFrame:
    """Items of at most one frame, or whose spread frame pairs all differ by less than the threshold.

    Pairs are (0, 1), (0, n−1) and (n÷2, n−1); only the up to four frames they need are kept.
    """
    sizes = frames.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    s, n = F.col(slot), F.col("_n")
    mid = F.floor(n / 2)
    needed = frames.join(sizes, key).filter((s == 0) | (s == 1) | (s == n - 1) | ((n > 3) & (s == mid)))

    def frame(at: Column) -> Column:
        return F.max(F.when(s == at, F.col(vec)))

    picked = needed.groupBy(key).agg(
        F.max("_n").alias("n_frames"), frame(F.lit(0)).alias("f0"), frame(F.lit(1)).alias("f1"),
        frame(n - 1).alias("fz"), F.max(F.when((n > 3) & (s == mid), F.col(vec))).alias("fm"),
    )

    def gap(a: str, b: str) -> Column:
        diffs = F.zip_with(F.col(a), F.col(b), lambda x, y: F.abs(x.cast("double") - y.cast("double")))
        return F.aggregate(diffs, F.lit(0.0), lambda t, x: t + x) / F.size(diffs)

    m = F.col("n_frames")
    still = (gap("f0", "f1") < threshold) & F.when(m > 2, gap("f0", "fz") < threshold).otherwise(F.lit(True)) & F.when(
        m > 3, gap("fm", "fz") < threshold
    ).otherwise(F.lit(True))
    return picked.select(key, "n_frames", F.when(m <= 1, F.lit(True)).otherwise(still).alias("is_static"))


# ------------------------------------------------------------------ class decisions

# Fixed value: a group must beat the neutral classes by more than this.
NEUTRAL_MARGIN = 0.05


def classify(preds: DataFrame, key: str, categories: Sequence[str], groups: Sequence[Sequence[str]] = (),
             severity: Sequence[str] = ()) -> DataFrame:
    """Category of each item from long-form (key, category, score) predictions.

    The positive group with the largest summed score wins when it beats the neutral classes by the
    margin; inside it the most severe class with a score above 0 is taken, else its best one.
    Without a winning group the best class overall. Earlier classes win ties.
    """
    wide = preds.groupBy(key).agg(
        *[F.coalesce(F.max(F.when(F.col("category") == c, F.col("score"))), F.lit(0.0)).alias(f"c{i}")
          for i, c in enumerate(categories)]
    )
    col = {c: F.col(f"c{i}") for i, c in enumerate(categories)}
    grouped = {c for g in groups for c in g}

    def total(names) -> Column:
        out = F.lit(0.0)
        for name in names:
            out = out + col.get(name, F.lit(0.0))
        return out

    def best_of(names) -> Column:
        ranked = F.array_max(F.array(*[F.struct(col[n].alias("s"), F.lit(-i).alias("o"), F.lit(n).alias("n")) for i, n in enumerate(names)]))
        return ranked["n"]

    neutral = total([c for c in categories if c not in grouped])
    winners = []
    for order, names in enumerate(groups):
        if len(names) <= 1:
            continue
        severe = F.coalesce(*[F.when(col.get(s, F.lit(0.0)) > 0, F.lit(s)) for s in severity if s in names], best_of(names))
        winners.append(
            F.when(total(names) > neutral + NEUTRAL_MARGIN,
                   F.struct(total(names).alias("s"), F.lit(-order).alias("o"), severe.alias("n")))
        )
    overall = best_of(list(categories))
    if not winners:
        return wide.select(key, overall.alias("category"))
    top = F.array_max(F.filter(F.array(*winners), lambda w: w.isNotNull()))
    return wide.select(key, F.coalesce(top["n"], overall).alias("category"))


def rank_condition(preds: DataFrame, key: str, categories: Sequence[str], min_rank: int = 1, max_rank: int = 1,
                   min_confidence: float = 0.0, negate: bool = False) -> DataFrame:
    """Whether one of the categories ranks within [min_rank, max_rank] with enough confidence.

    Ranks follow the score, then the category's position (``ord``). No categories never match,
    negated or not.
    """
    if not categories:
        return preds.select(key).distinct().withColumn("matched", F.lit(False))
    ranked = preds.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(F.col("score").desc(), "ord")))
    hit = F.col("_r").between(min_rank, max_rank) & F.col("category").isin(*categories) & (F.col("score") >= min_confidence)
    out = ranked.groupBy(key).agg(F.bool_or(hit).alias("matched"))
    return out.withColumn("matched", ~F.col("matched")) if negate else out
