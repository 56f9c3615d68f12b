"""Similarity search over vectors, texts, sets, sizes and signatures.

The vectors of one request travel as literals and scoring is a projection without a join; tables of query vectors (presets,
stored seeds, named texts) may have any size and go through ``operators.products``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curaspark.functions import text as X
from curaspark.functions import vec as V
from curaspark.operators import products
from curaspark.operators.order import top_k
from curaspark.operators.pairs import set_similarity
from curaspark.scale import broadcast_if_small, hold, spread
from curaspark.session import checkpoint

SEARCH_RESULTS = 50


def _literal(vec: Sequence[float]) -> Column:
    return F.lit([float(x) for x in vec])


def item_vector(df: DataFrame, ident: str, vec: str, key) -> list[float]:
    row = df.filter(F.col(ident) == F.lit(key)).select(vec).first()
    if row is None:
        raise KeyError(key)
    return [float(x) for x in row[0]]


def search_item(df: DataFrame, ident: str, vec: str, key, k: int | None = SEARCH_RESULTS, threshold: float | None = None) -> DataFrame:
    """Items most similar to one item (itself excluded), best ``k`` or all above the threshold."""
    q = item_vector(df, ident, vec, key)
    scored = df.filter(F.col(ident) != F.lit(key)).select(F.col(ident).alias("id"), F.round(V.dot(vec, _literal(q)), 9).alias("score"))
    if threshold is not None:
        return scored.filter(F.col("score") > threshold)
    return top_k(scored, k)


def mean_score(vec: str, vectors: Sequence[Sequence[float]]) -> Column:
    """Mean dot product with the given vectors, 0 without any."""
    total = F.lit(0.0)
    for v in vectors:
        total = total + V.dot(vec, _literal(v))
    return total / F.lit(float(max(1, len(vectors))))


def search_multimodal(df: DataFrame, ident: str, vec: str, positives: Sequence, negatives: Sequence = (),
                      k: int | None = SEARCH_RESULTS, threshold: float | None = None) -> DataFrame:
    """Mean similarity to the positive vectors minus mean similarity to the negative ones."""
    if not positives and not negatives:
        return df.select(F.col(ident).alias("id"), F.lit(0.0).alias("score")).limit(0)
    score = F.round(mean_score(vec, positives) - mean_score(vec, negatives), 9)
    scored = df.select(F.col(ident).alias("id"), score.alias("score"))
    if threshold is not None:
        return scored.filter(F.col("score") > threshold)
    return top_k(scored, k)


def text_threshold(threshold: float) -> float:
    """Looser threshold of searches by text alone."""
    return threshold / 3


def mean_of(queries: DataFrame, vec: str) -> list[float] | None:
    """Mean of any number of query vectors: the mean of dot products is the dot product with the mean. None without any."""
    from curaspark.operators.agg import mean_vector

    row = mean_vector(queries.filter(F.col(vec).isNotNull()).withColumn("_all", F.lit(0)), "_all", vec).first()
    return None if row is None else [float(x) for x in row["vec"]]


def _tables(df: DataFrame, ident: str, vec: str, queries: DataFrame, key: str, query_vec: str, unit: bool = False) -> tuple[DataFrame, DataFrame]:
    def side(d: DataFrame, name: str, of: str, v: str) -> DataFrame:
        return d.select(F.col(of).alias(name), (V.l2_normalize(v) if unit else F.col(v)).alias("vec"))

    return side(df, "id", ident, vec), side(queries, "key", key, query_vec)


def segregate(df: DataFrame, ident: str, vec: str, presets: DataFrame, key: str, preset_vec: str, **how) -> DataFrame:
    """(id, preset, score): the preset with the largest relative score per item, ties to the smaller key.

    A preset's scores are divided by its smallest one; with its vector divided instead, the best preset is the one with the
    largest dot product. ``presets`` (key, vector) may have any number of rows; a preset whose smallest score is 0 has no
    relative scores.
    """
    items, queries = _tables(df, ident, vec, presets, key, preset_vec)
    low = products.lowest_scores(items, queries, **how).filter("low != 0")
    scaled = checkpoint(queries.join(low, "key").select("key", F.transform("vec", lambda x: x / F.col("low")).alias("vec")))
    return products.best_queries(items, scaled, **how).select("id", F.col("key").alias("preset"), "score")


def search_preset(df: DataFrame, ident: str, vec: str, presets: DataFrame, key: str, preset_vec: str, query, k: int = SEARCH_RESULTS) -> DataFrame:
    """Best items of those whose best preset is the query."""
    return top_k(segregate(df, ident, vec, presets, key, preset_vec).filter(F.col("preset") == F.lit(query)).select("id", "score"), k)


def best_texts(df: DataFrame, ident: str, vec: str, texts: DataFrame, key: str, text_vec: str, **how) -> DataFrame:
    """(id, text, score): the named text vector with the largest cosine for every item, ties to the smaller name."""
    items, queries = _tables(df, ident, vec, texts, key, text_vec, unit=True)
    return products.best_queries(items, queries, **how).select("id", F.col("key").alias("text"), "score")


def search_each(df: DataFrame, ident: str, vec: str, queries: DataFrame, key: str, query_vec: str, k: int = SEARCH_RESULTS, **how) -> DataFrame:
    """(key, id, score): the best ``k`` items of every query vector of a table of any size."""
    items, asked = _tables(df, ident, vec, queries, key, query_vec)
    return products.top_matches(items, asked, k, **how)


def search_prompt_vector(df: DataFrame, ident: str, pos: str, neg: str, key, k: int | None = SEARCH_RESULTS, threshold: float | None = None) -> DataFrame:
    """Items whose prompt vectors (positive less half of the negative one, unit length) are most similar to one item's."""
    unit = df.select(F.col(ident).alias("id"), V.l2_normalize(V.combine_vectors(pos, neg)).alias("vec"))
    return search_item(unit, "id", "vec", key, k, threshold)


def multi_text_score(vec: str, positives: Sequence, negatives: Sequence = ()) -> Column:
    """P/N when both are positive, P alone, else 1/N, with P the mean cosine to the positive vectors
    and N the mean inverse cosine to the negative ones; null when undefined."""
    pos = F.lit(0.0)
    for v in positives:
        pos = pos + V.cosine(vec, _literal(v))
    pos = pos / F.lit(float(max(1, len(positives))))
    neg = F.lit(0.0)
    for v in negatives:
        c = V.cosine(vec, _literal(v))
        neg = neg + F.when(c != 0, F.lit(1.0) / c)
    neg = neg / F.lit(float(max(1, len(negatives))))
    return F.when((pos > 0) & (neg > 0), pos / neg).when(pos > 0, pos).when(neg != 0, F.lit(1.0) / neg)


def text_scores(df: DataFrame, ident: str, vec: str, texts: DataFrame, name: str, text_vec: str) -> DataFrame:
    """(id, text, score): cosine of every item with every named text vector."""
    items = df.select(F.col(ident).alias("id"), F.col(vec).alias("_v"))
    named = broadcast_if_small(texts.select(F.col(name).alias("text"), F.col(text_vec).alias("_t")), max_rows=10_000)
    return items.crossJoin(named).select("id", "text", V.cosine("_v", "_t").alias("score"))


def prototype_score(vec: str, positive: Sequence[float], negative: Sequence[float] | None = None, lam: float = 0.5) -> Column:
    score = V.dot(vec, _literal(positive))
    return score if negative is None else score - F.lit(float(lam)) * V.dot(vec, _literal(negative))


def validate_with_prototypes(df: DataFrame, ident: str, vec: str, positive, negative=None, lam: float = 0.5,
                             threshold: float = 0.23) -> DataFrame:
    """Items whose prototype score reaches the threshold."""
    return df.select(F.col(ident).alias("id"), prototype_score(vec, positive, negative, lam).alias("score")).filter(
        F.col("score") >= threshold
    )


# ------------------------------------------------------------------ texts, sets, sizes, signatures


def search_text_exact(df: DataFrame, ident: str, pos: str, neg: str, positives: Sequence[str], negatives: Sequence[str] = (),
                      threshold: float = 0.85, k: int | None = SEARCH_RESULTS) -> DataFrame:
    """Best text score of any positive text minus half the best of any negative text, limited to [0, 1]."""

    def best(texts: Sequence[str], sides: Sequence[str], fuzzy: bool) -> Column:
        scores = [X.prepared_similarity(X.prepare(F.lit(t)), s, fuzzy) for t in texts for s in sides]
        return F.greatest(F.lit(0.0), F.lit(0.0), *scores)

    # the negative part only lowers a score, so rows are first cut by the positive part; above the
    # cap of the fuzzy stage that needs no word comparison
    fuzzy = threshold <= X.FUZZY_CAP
    rows = spread(df.select(F.col(ident).alias("id"), F.col(pos).alias("_p"), F.col(neg).alias("_n")), "id")
    ready = hold(rows, "_pp", X.prepare("_p"))
    first = hold(ready, "_s", best(positives, ["_pp"], fuzzy)).filter(F.col("_s") >= threshold)
    both = hold(first, "_np", X.prepare("_n"))
    combined = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("_s") - 0.5 * best(negatives, ["_pp", "_np"], True)))
    scored = hold(both, "_c", F.round(combined, 9)).select("id", F.col("_c").alias("score")).filter(F.col("score") >= threshold)
    return scored if k is None else top_k(scored, k)


def search_sets(df: DataFrame, ident: str, models: str, loras: str, want_models: Sequence[str], want_loras: Sequence[str] = (),
                threshold: float = 0.7, k: int | None = SEARCH_RESULTS) -> DataFrame:
    """Items by set score against the wanted names; without names, the items that have none."""
    empty = F.array().cast("array<string>")
    m, l = F.array_distinct(F.coalesce(F.col(models), empty)), F.array_distinct(F.coalesce(F.col(loras), empty))
    if not want_models and not want_loras:
        scored = df.filter((F.size(m) == 0) & (F.size(l) == 0)).select(F.col(ident).alias("id"), F.lit(1.0).alias("score"))
    else:
        wm = F.lit(list(want_models)) if want_models else empty
        wl = F.lit(list(want_loras)) if want_loras else empty
        score = F.round(set_similarity(wm, wl, m, l), 9)
        scored = df.select(F.col(ident).alias("id"), score.alias("score")).filter(F.col("score") >= threshold)
    return scored if k is None else top_k(scored, k)


def search_size(df: DataFrame, ident: str, w: str, h: str, size: tuple[int, int], tolerance: int = 0, threshold: float = 0.0,
                k: int | None = SEARCH_RESULTS) -> DataFrame:
    """Items within the tolerance of a size, by closeness."""
    scored = df.filter(F.col(w).between(size[0] - tolerance, size[0] + tolerance) & F.col(h).between(size[1] - tolerance, size[1] + tolerance)).select(
        F.col(ident).alias("id"), F.round(X.size_similarity(w, h, F.lit(size[0]), F.lit(size[1]), tolerance), 9).alias("score")
    ).filter(F.col("score") >= threshold)
    return scored if k is None else top_k(scored, k)


def size_matches(queries: DataFrame, items: DataFrame, tolerance: int) -> DataFrame:
    """Items within the tolerance of each query size: (qid, id, score). Both have (id, w, h).

    A band join: sizes fall into cells of the tolerance's width and a query visits the cells next
    to its own. Equal sizes are one row on both sides, so a common size costs one comparison.
    """
    width = max(1, tolerance)

    def sizes(df: DataFrame) -> DataFrame:
        return df.groupBy("w", "h").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id"))

    cell_w, cell_h = F.floor(F.col("w") / width), F.floor(F.col("h") / width)
    around = F.lit([-1, 0, 1])
    q = sizes(queries).select(F.col("id").alias("qid"), F.col("w").alias("qw"), F.col("h").alias("qh"), F.col("n").alias("nq"),
                              F.explode(F.transform(around, lambda d: cell_w + d)).alias("cw"), cell_h.alias("_ch"))
    q = q.withColumn("ch", F.explode(F.transform(around, lambda d: F.col("_ch") + d))).drop("_ch")
    i = sizes(items).withColumn("cw", cell_w).withColumn("ch", cell_h)
    score = X.size_similarity("qw", "qh", "w", "h", tolerance)
    near = (F.abs(F.col("qw") - F.col("w")) <= tolerance) & (F.abs(F.col("qh") - F.col("h")) <= tolerance)
    return q.join(i, ["cw", "ch"]).filter(near).select(
        "qid", "id", F.col("nq"), F.col("n").alias("ni"), F.round(score, 9).alias("score")
    )


def search_hist(df: DataFrame, ident: str, hist: str, key, threshold: float | None = None, k: int = SEARCH_RESULTS) -> DataFrame:
    """Histograms closest to one item's histogram."""
    q = item_vector(df, ident, hist, key)
    scored = df.filter(F.col(ident) != F.lit(key)).select(F.col(ident).alias("id"), F.round(V.l1_half(hist, _literal(q)), 9).alias("score"))
    return scored.filter(F.col("score") <= threshold) if threshold is not None else top_k(scored, k, desc=False)


def color_cells(flat) -> Column:
    """Flat l,a,b,l,a,b… array as array<struct<l,a,b>>; a trailing incomplete cell is dropped."""
    c = F.col(flat) if isinstance(flat, str) else flat

    def cell(i: Column) -> Column:
        return F.struct(*[F.element_at(c, (i * 3 + j).cast("int")).cast("double").alias(n) for j, n in ((1, "l"), (2, "a"), (3, "b"))])

    return F.transform(F.sequence(F.lit(0), F.floor(F.size(c) / 3).cast("int") - 1), cell)


def search_colors(df: DataFrame, ident: str, lab: str, key, k: int = SEARCH_RESULTS) -> DataFrame:
    """Colour signatures with the smallest summed difference to one item's signature."""
    q = item_vector(df, ident, lab, key)
    diffs = V.delta_e76(color_cells(lab), color_cells(_literal(q)))
    scored = df.filter(F.col(ident) != F.lit(key)).select(
        F.col(ident).alias("id"), F.aggregate(diffs, F.lit(0).cast("bigint"), lambda s, x: s + x).cast("double").alias("score")
    )
    return top_k(scored, k, desc=False)


# ------------------------------------------------------------------ seeds


class SeedLibrary:
    """Named vectors as a table: id, name, tags, vec, neg_vec, model, use_count, deprecated."""

    def __init__(self, df: DataFrame):
        self.df = df

    def upsert(self, rows: DataFrame) -> SeedLibrary:
        """Add seeds; a seed with a known id is replaced."""
        return SeedLibrary(self.df.join(rows.select("id"), "id", "left_anti").unionByName(rows, allowMissingColumns=True))

    def delete(self, ids: DataFrame) -> SeedLibrary:
        return SeedLibrary(self.df.join(ids.select("id"), "id", "left_anti"))

    def list(self, model: str | None = None, tag: str | None = None, deprecated: bool = False) -> DataFrame:
        out = self.df if deprecated else self.df.filter(~F.coalesce(F.col("deprecated"), F.lit(False)))
        if model is not None:
            out = out.filter(F.col("model") == model)
        if tag is not None:
            out = out.filter(F.array_contains("tags", tag))
        return out

    def capture(self, items: DataFrame, ident: str, vec: str, key, seed_id, name: str, model: str, tags: Sequence[str] = ()) -> SeedLibrary:
        """Store one item's vector as a seed; of several vectors (frames of one item) the mean, at unit length.

        An item without a vector adds nothing.
        """
        found = items.filter((F.col(ident) == F.lit(key)) & F.col(vec).isNotNull()).withColumn("_all", F.lit(0))
        from curaspark.operators.agg import mean_vector

        kinds = {f.name: f.dataType for f in self.df.schema}
        row = mean_vector(found, "_all", vec).select(
            F.lit(seed_id).cast(kinds["id"]).alias("id"), F.lit(name).alias("name"), F.lit(list(tags)).cast("array<string>").alias("tags"),
            V.l2_normalize("vec").cast(kinds["vec"]).alias("vec"), F.lit(model).alias("model"), F.lit(0).cast(kinds["use_count"]).alias("use_count"),
            F.lit(False).alias("deprecated"),
        )
        return self.upsert(row)

    def used(self, ids: DataFrame) -> SeedLibrary:
        """Count one more use of the listed seeds."""
        marks = ids.select("id").distinct().withColumn("_used", F.lit(1))
        bumped = self.df.join(marks, "id", "left").withColumn("use_count", F.col("use_count") + F.coalesce("_used", F.lit(0)))
        return SeedLibrary(bumped.drop("_used"))
