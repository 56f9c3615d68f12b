"""Registered queries over vectors, histograms, colours and model sets, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curaspark.functions import vec as V
from curaspark.operators import agg as A
from curaspark.operators import cluster as C
from curaspark.operators import composite as Q
from curaspark.operators import pairs as J
from curaspark.operators import search as S
from curaspark.plans.tables import table
from curaspark.scale import broadcast_if_small
from curaspark.session import checkpoint
from curaspark.sources import media as M
from curaspark.sources import sinks as K

THRESHOLD = 0.3
_MEMO: dict[tuple, object] = {}


def _once(spark: SparkSession, folder: str, what: str, make):
    """Intermediate result shared by several queries of one session (the stored result of a run)."""
    key = (spark.sparkContext.applicationId, folder, what)
    if key not in _MEMO:
        _MEMO[key] = make()
    return _MEMO[key]


def _emb(spark, folder) -> DataFrame:
    return table(spark, folder, "embeddings")


def _pairs(spark, folder) -> J.PairSet:
    return _once(spark, folder, "pairs", lambda: J.similar_pairs(_emb(spark, folder), "vec_id", "embedding", THRESHOLD))


def _groups(spark, folder) -> DataFrame:
    return _once(spark, folder, "groups", lambda: checkpoint(C.greedy_groups(J.similar_near(_emb(spark, folder), "vec_id", "embedding", THRESHOLD))))


def _centroids(spark, folder) -> DataFrame:
    return A.centroid(_emb(spark, folder), "label", "embedding")


def _r6(c: str):
    return F.round(c, 6).alias(c)


# ------------------------------------------------------------------ pairs and groups


def similar_pairs(spark, folder):
    return J.similar_pairs(_emb(spark, folder), "vec_id", "embedding", THRESHOLD).rows().select("i", "j", _r6("score"), "n_i", "n_j")


def greedy_groups(spark, folder):
    near = J.similar_near(_emb(spark, folder), "vec_id", "embedding", THRESHOLD)
    return C.greedy_groups(near).select(F.col("id").alias("vec_id"), "group_id", _r6("score"))


def group_order(spark, folder):
    return C.sorted_groups(_groups(spark, folder), desc=True).select("group_id", "n_members", "position")


def group_members_order(spark, folder):
    groups = _groups(spark, folder)
    return C.display_order(groups, C.sorted_groups(groups, desc=True)).withColumnRenamed("id", "vec_id")


def group_complement(spark, folder):
    return C.complement(_emb(spark, folder), _groups(spark, folder), "vec_id").select("vec_id", "label")


def stranded_groups(spark, folder):
    return C.stranded(_groups(spark, folder))


def groups_after_removal(spark, folder):
    gone = _emb(spark, folder).filter(F.col("label") == 3).select(F.col("vec_id").alias("id"))
    return C.remove_items(_groups(spark, folder), gone).select(F.col("id").alias("vec_id"), "group_id", _r6("score"))


def groups_filtered(spark, folder):
    keep = _emb(spark, folder).filter(F.col("label") < 5).select(F.col("vec_id").alias("id"))
    return C.filter_groups(_groups(spark, folder), keep).select(F.col("id").alias("vec_id"), "group_id", _r6("score"))


def duplicate_vectors(spark, folder):
    dup = C.duplicate_groups(C.duplicates(_pairs(spark, folder), 0.4))
    return dup.select("i", "j", _r6("score"), "group_id")


def supergroups(spark, folder):
    """Groups by centroid similarity, complete link."""
    groups = _groups(spark, folder)
    emb = _emb(spark, folder).select(F.col("vec_id").alias("id"), "embedding")
    return C.supergroups(groups, emb, "embedding", 0.6, min_viable=0.5, ratio=0.5)


def prompt_vector_pairs(spark, folder):
    """Positive vector minus half of the label's centroid as the negative vector."""
    neg = broadcast_if_small(_centroids(spark, folder))  # one row per label
    mixed = _emb(spark, folder).join(neg, "label").select("vec_id", V.combine_vectors("embedding", "vec").alias("v"))
    unit = mixed.select("vec_id", F.transform(V.l2_normalize("v"), lambda x: F.round(x, 7)).alias("v"))
    return J.similar_pairs(unit, "vec_id", "v", 0.35).rows().select("i", "j", F.round("score", 5).alias("score"))


def purge_plan(spark, folder):
    emb = _emb(spark, folder)
    sized = emb.select("vec_id", (F.col("vec_id") % 300).alias("width"), F.lit(200).alias("height"))
    return C.purge_plan(_groups(spark, folder), sized, "vec_id", F.col("id")).select(F.col("id").alias("vec_id"), "group_id", "action")


def unrelated_breaks(spark, folder):
    emb = _emb(spark, folder).select("vec_id", "label", "embedding")
    related = V.cosine("embedding", F.col("prev.embedding")) > 0.0
    return C.adjacency_breaks(emb, [F.col("vec_id")], related).select("vec_id", F.col("is_break").cast("int").alias("is_break"), "run_id")


def _unrelated_steps(spark, folder, forward):
    runs = C.adjacency_breaks(
        _emb(spark, folder).select("vec_id", "embedding"), [F.col("vec_id")], V.cosine("embedding", F.col("prev.embedding")) > 0.0
    ).select("vec_id", "idx", "run_id")
    return C.unrelated_step(runs, forward).select("vec_id", "next_pos", "n_skipped")


def next_unrelated(spark, folder):
    """For every item the next position whose predecessor it is not related to, and the number skipped."""
    return _unrelated_steps(spark, folder, True)


def previous_unrelated(spark, folder):
    """The same walk backwards."""
    return _unrelated_steps(spark, folder, False)


def color_pairs(spark, folder):
    return J.color_pairs(_lab(spark, folder), "vec_id", "lab", 40).rows().select("i", "j", "score")


def search_colors(spark, folder):
    lab = _emb(spark, folder).select("vec_id", F.transform("embedding", lambda x: x.cast("double") * 100).alias("lab"))
    return S.search_colors(lab, "vec_id", "lab", 7).select(F.col("id").alias("vec_id"), "score")


# ------------------------------------------------------------------ centroids and search


def label_centroids(spark, folder):
    out = _centroids(spark, folder)
    return out.select("label", F.posexplode("vec").alias("pos", "x")).select("label", "pos", _r6("x"))


def search_item(spark, folder):
    return S.search_item(_emb(spark, folder), "vec_id", "embedding", 11).select(F.col("id").alias("vec_id"), _r6("score"))


def search_item_threshold(spark, folder):
    return S.search_item(_emb(spark, folder), "vec_id", "embedding", 11, None, 0.1).select(F.col("id").alias("vec_id"), _r6("score"))


def _vectors(spark, folder, keys):
    return [S.item_vector(_emb(spark, folder), "vec_id", "embedding", k) for k in keys]


def search_multimodal(spark, folder):
    pos, neg = _vectors(spark, folder, (1, 2, 3)), _vectors(spark, folder, (4, 5))
    return S.search_multimodal(_emb(spark, folder), "vec_id", "embedding", pos, neg).select(F.col("id").alias("vec_id"), _r6("score"))


def search_with_seeds(spark, folder):
    """Item vectors and stored seed vectors in one query; text-only threshold."""
    seeds = _centroids(spark, folder).filter("label in (0, 1)").select("vec")
    item = _emb(spark, folder).filter("vec_id = 1").select(F.col("embedding").cast("array<double>").alias("vec"))
    mean = S.mean_of(item.unionByName(seeds), "vec")
    out = S.search_multimodal(_emb(spark, folder), "vec_id", "embedding", [mean], [], None, S.text_threshold(THRESHOLD))
    return out.select(F.col("id").alias("vec_id"), _r6("score"))


def search_preset(spark, folder):
    out = S.search_preset(_emb(spark, folder), "vec_id", "embedding", _centroids(spark, folder), "label", "vec", 2)
    return out.select(F.col("id").alias("vec_id"), _r6("score"))


def preset_matches(spark, folder):
    """The five best items of every item's vector: a table of queries as large as the table of items."""
    emb = _emb(spark, folder)
    out = S.search_each(emb, "vec_id", "embedding", emb, "vec_id", "embedding", 5)
    return out.select(F.col("key").alias("query_id"), F.col("id").alias("vec_id"), _r6("score"))


def prototype_validation(spark, folder):
    wanted = _centroids(spark, folder)
    good, bad = (S.item_vector(wanted, "label", "vec", k) for k in (1, 2))
    out = S.validate_with_prototypes(_emb(spark, folder), "vec_id", "embedding", good, bad, 0.5, 0.1)
    return out.select(F.col("id").alias("vec_id"), _r6("score"))


def multi_text_score(spark, folder):
    pos, neg = _vectors(spark, folder, (1, 2)), _vectors(spark, folder, (3,))
    score = S.multi_text_score("embedding", pos, neg)
    return _emb(spark, folder).select("vec_id", F.round(score, 5).alias("score")).filter(F.col("score") > 0.01)


def best_texts(spark, folder):
    """Cosine of every item with the label vectors as named texts, best text per item."""
    out = S.best_texts(_emb(spark, folder), "vec_id", "embedding", _centroids(spark, folder), "label", "vec")
    return out.select(F.col("id").alias("vec_id"), F.col("text").alias("best_label"), _r6("score"))


def text_scores(spark, folder):
    """Cosine of every item with the label vectors as named texts."""
    out = S.text_scores(_emb(spark, folder), "vec_id", "embedding", _centroids(spark, folder), "label", "vec")
    return out.select(F.col("id").alias("vec_id"), F.col("text").alias("label"), _r6("score"))


def search_prompt_vector(spark, folder):
    """Positive vectors with their label's centroid as the negative one, most similar to those of item 11."""
    neg = broadcast_if_small(_centroids(spark, folder))  # one row per label
    both = _emb(spark, folder).join(neg, "label")
    return S.search_prompt_vector(both, "vec_id", "embedding", "vec", 11).select(F.col("id").alias("vec_id"), _r6("score"))


def capture_seed(spark, folder):
    """One item's vector and the mean of a label's vectors captured into a library of centroids."""
    seeds = _centroids(spark, folder).filter("label < 5").select(
        F.col("label").cast("bigint").alias("id"), F.concat(F.lit("label "), F.col("label").cast("string")).alias("name"),
        F.array(F.lit("centroid")).alias("tags"), "vec", F.lit("m1").alias("model"), F.lit(0).cast("bigint").alias("use_count"), F.lit(False).alias("deprecated"),
    )
    emb = _emb(spark, folder)
    lib = S.SeedLibrary(seeds).capture(emb, "vec_id", "embedding", 7, 100, "item 7", "m1", ["item"])
    lib = lib.capture(emb, "label", "embedding", 6, 101, "label 6", "m1", ["frames"]).capture(emb, "vec_id", "embedding", -1, 102, "none", "m1")
    return lib.list("m1").select("id", "name", F.array_join("tags", "|").alias("tags"), F.round(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


def readd_items(spark, folder):
    """Groups after the items of one label were left out at first and added afterwards."""
    emb = _emb(spark, folder)
    before = J.similar_near(emb.filter("label != 3"), "vec_id", "embedding", THRESHOLD)
    after = J.readd_near(before, emb, "vec_id", "embedding", THRESHOLD)
    return C.greedy_groups(after).select(F.col("id").alias("vec_id"), "group_id", _r6("score"))


def _lab(spark, folder) -> DataFrame:
    return _emb(spark, folder).select("vec_id", F.transform(F.slice("embedding", 1, 63), lambda x: x.cast("double") * 100).alias("lab"))


def composite_search(spark, folder):
    """Items that two modes place among the 200 nearest to item 7: by vector and by colour signature."""
    run = Q.CompositeCompare(
        [
            Q.Instance("vector", "embedding", search=lambda: S.search_item(_emb(spark, folder), "vec_id", "embedding", 7, 200)),
            Q.Instance("colour", "color", search=lambda: S.search_colors(_lab(spark, folder), "vec_id", "lab", 7, 200)),
            Q.Instance("off", "histogram", enabled=False),
        ],
        "and", by_item=True,
    )
    return run.search().select(F.col("id").alias("vec_id"), _r6("score"))


def composite_text_search(spark, folder):
    """A search by text alone: the colour instance is skipped, its weight still counts."""
    centroid = S.item_vector(_centroids(spark, folder), "label", "vec", 4)
    run = Q.CompositeCompare(
        [
            Q.Instance("text", "embedding", search=lambda: S.search_multimodal(_emb(spark, folder), "vec_id", "embedding", [centroid], [], None, 0.1), weight=3.0),
            Q.Instance("colour", "color", search=lambda: S.search_colors(_lab(spark, folder), "vec_id", "lab", 7), weight=1.0),
        ],
        "weighted", by_text=True,
    )
    return run.search().select(F.col("id").alias("vec_id"), _r6("score"))


def composite_groups(spark, folder):
    """Groups of similar vectors, reduced to the items that also have a group by colour."""
    run = Q.CompositeCompare(
        [
            Q.Instance("vector", "embedding", group=lambda: _groups(spark, folder)),
            Q.Instance("colour", "color", group=lambda: C.greedy_groups(J.color_pairs(_lab(spark, folder), "vec_id", "lab", 36))),
        ],
        "and",
    )
    return run.groups("vector").select(F.col("id").alias("vec_id"), "group_id", _r6("score"))


def seed_library(spark, folder):
    """Label centroids as seeds: one replaced, one deprecated, uses counted per item."""
    seeds = _centroids(spark, folder).select(
        F.col("label").cast("bigint").alias("id"), F.concat(F.lit("label "), F.col("label").cast("string")).alias("name"),
        F.array(F.lit("centroid")).alias("tags"), "vec", F.lit("m1").alias("model"), F.lit(0).cast("bigint").alias("use_count"),
        (F.col("label") == 4).alias("deprecated"),
    )
    lib = S.SeedLibrary(seeds)
    renamed = seeds.filter("id = 1").withColumn("name", F.lit("renamed"))
    lib = lib.upsert(renamed).delete(seeds.filter("id = 9").select("id"))
    lib = lib.used(_emb(spark, folder).filter("label < 3").select(F.col("label").cast("bigint").alias("id")))
    return lib.list("m1", "centroid").select("id", "name", "use_count")


def _mode_scores(spark, folder) -> DataFrame:
    """Two runs per mode: similarity of each half of the vector to two query items."""
    emb = _emb(spark, folder)
    parts = []
    for mode, start in (("front", 1), ("back", 33)):
        for key in (1, 2):
            q = S.item_vector(emb, "vec_id", "embedding", key)[start - 1 : start + 31]
            score = V.cosine(F.slice("embedding", start, 32), F.lit(q))
            parts.append(emb.select(F.col("vec_id").alias("id"), F.lit(mode).alias("mode"), A.normalize_score(score, "embedding").alias("score")).filter("score > 0.1"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def composite_and(spark, folder):
    return A.combine_and(_mode_scores(spark, folder), 2).select(F.col("id").alias("vec_id"), _r6("score"))


def composite_or(spark, folder):
    return A.combine_or(A.merge_instances(_mode_scores(spark, folder))).select(F.col("id").alias("vec_id"), _r6("score"))


def composite_weighted(spark, folder):
    return A.combine_weighted(_mode_scores(spark, folder), {"front": 2.0, "back": 1.0}).select(F.col("id").alias("vec_id"), _r6("score"))


# ------------------------------------------------------------------ feature store


def feature_fill(spark, folder):
    """Stored vectors for most labels, computed ones (normalised copies) for the rest."""
    emb = _emb(spark, folder)
    store = emb.filter("label < 8").select(F.col("vec_id").alias("path"), F.round(V.norm("embedding"), 4).alias("feature"))
    media = emb.select(F.col("vec_id").alias("path"), "embedding")
    out = M.ensure_features(media, store, lambda m: m.select("path", F.round(V.norm("embedding"), 4).alias("feature")))
    return out.select("path", "feature", F.col("is_new").cast("int").alias("is_new"))


def stale_purge(spark, folder):
    emb = _emb(spark, folder).select(F.col("vec_id").alias("path"), "label")
    return K.purge_stale(emb, emb.filter("label = 0").select("path")).select("path", "label")


def reference_row(spark, folder):
    """A filtered set keeps the search reference."""
    emb = _emb(spark, folder).select(F.col("vec_id").alias("path"), "label")
    out = M.reference_first(emb, F.col("label") == 1, emb.filter("path = 0"))
    return out.select("path", "label", F.col("is_reference").cast("int").alias("is_reference"))


# ------------------------------------------------------------------ histograms


CHANNELS = (("l_quantity", 0.0, 50.0, 36), ("l_discount", 0.0, 0.1, 16), ("l_tax", 0.0, 0.08, 16))


def _hists(spark, folder) -> DataFrame:
    # exact decimals keep the bin of 0.07 and the like independent of binary rounding
    li = table(spark, folder, "lineitem").select("l_suppkey", "l_quantity", F.round("l_discount", 2).alias("l_discount"), F.round("l_tax", 2).alias("l_tax"))
    return A.hist_signature(li, "l_suppkey", CHANNELS)


def hist_signature(spark, folder):
    return _hists(spark, folder).select("l_suppkey", F.posexplode("hist").alias("slot", "share")).select("l_suppkey", "slot", _r6("share"))


def hist_pairs(spark, folder):
    return J.hist_pairs(_hists(spark, folder), "l_suppkey", "hist", 0.3).rows().select("i", "j", "score")


def hist_groups(spark, folder):
    """Histogram groups: with the regroup rule of the mode."""
    near = J.hist_near(_hists(spark, folder), "l_suppkey", "hist", 0.3)
    return C.regroup_groups(near, 0.15, lower=True).select(F.col("id").alias("l_suppkey"), "group_id", _r6("score"))


def search_hist(spark, folder):
    return S.search_hist(_hists(spark, folder), "l_suppkey", "hist", 3).select(F.col("id").alias("l_suppkey"), _r6("score"))


def mean_signature(spark, folder):
    supp = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    joined = _hists(spark, folder).join(supp, "l_suppkey")
    out = A.mean_vector(joined, "s_nationkey", "hist")
    return out.select("s_nationkey", F.posexplode("vec").alias("slot", "share")).select("s_nationkey", "slot", _r6("share"))


def diversity(spark, folder):
    li = table(spark, folder, "lineitem")
    return A.diversity(li, "l_suppkey", F.col("l_quantity").cast("int")).select("l_suppkey", _r6("score"))


def breadth(spark, folder):
    li = table(spark, folder, "lineitem")
    return A.breadth(li, "l_suppkey", F.col("l_quantity") / 50.0, F.col("l_discount")).select("l_suppkey", _r6("score"))


# ------------------------------------------------------------------ model sets


def _order_sets(spark, folder) -> DataFrame:
    """Order → ship-line suppliers as models, part groups as add-ons; orders without lines have none."""
    li = table(spark, folder, "lineitem")
    sets = li.groupBy("l_orderkey").agg(
        F.collect_set(F.concat(F.lit("s"), F.col("l_suppkey").cast("string"))).alias("models"),
        F.collect_set(F.concat(F.lit("r"), F.col("l_returnflag"), F.col("l_linestatus"))).alias("loras"),
    )
    return table(spark, folder, "orders").select("o_orderkey").join(sets, F.col("o_orderkey") == F.col("l_orderkey"), "left").drop("l_orderkey")


def set_pairs(spark, folder):
    return J.set_pairs(_order_sets(spark, folder), "o_orderkey", "models", "loras").rows().select("i", "j", _r6("score"), "n_i", "n_j")


def set_groups(spark, folder):
    pairs = J.set_pairs(_order_sets(spark, folder), "o_orderkey", "models", "loras")
    return C.regroup_groups(pairs, 0.0, lower=False).select(F.col("id").alias("o_orderkey"), "group_id", _r6("score"))


def search_sets(spark, folder):
    out = S.search_sets(_order_sets(spark, folder), "o_orderkey", "models", "loras", ["s1", "s2"], ["rNO"], 0.3, None)
    return out.select(F.col("id").alias("o_orderkey"), _r6("score"))


def search_no_models(spark, folder):
    return S.search_sets(_order_sets(spark, folder), "o_orderkey", "models", "loras", [], [], k=None).select(F.col("id").alias("o_orderkey"), "score")


QUERIES = {f.__name__: f for f in (
    similar_pairs, greedy_groups, group_order, group_members_order, group_complement, stranded_groups, groups_after_removal,
    groups_filtered, duplicate_vectors, supergroups, prompt_vector_pairs, purge_plan, unrelated_breaks, next_unrelated, previous_unrelated, color_pairs,
    search_colors, label_centroids, search_item, search_item_threshold, search_multimodal, search_with_seeds, search_preset,
    preset_matches, prototype_validation, multi_text_score, best_texts, text_scores, search_prompt_vector, capture_seed, readd_items,
    composite_search, composite_text_search, composite_groups, seed_library, composite_and, composite_or, composite_weighted, feature_fill,
    stale_purge, reference_row, hist_signature, hist_pairs, hist_groups, search_hist, mean_signature, diversity, breadth, set_pairs,
    set_groups, search_sets, search_no_models,
)}

# ------------------------------------------------------------------ SQL twins

_DOT = "list_dot_product({a}.embedding::DOUBLE[], {b}.embedding::DOUBLE[])"
_PAIR = f"""pair AS (
  SELECT a.vec_id AS i, b.vec_id AS j, round({_DOT.format(a='a', b='b')}, 9) AS s
  FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id
  WHERE round({_DOT.format(a='a', b='b')}, 9) > {THRESHOLD})"""
_GROUPS = f"""{_PAIR},
edge AS (SELECT i AS v, j AS w, s FROM pair UNION ALL SELECT j, i, s FROM pair),
low AS (SELECT v, max(w) AS p FROM edge WHERE w < v GROUP BY v),
heads AS (
  SELECT v, min(w) AS k0, arg_min(s, w) AS s0 FROM edge WHERE w > v GROUP BY v),
firsts AS (SELECT * FROM heads WHERE v NOT IN (SELECT v FROM low)),
adopt AS (
  SELECT f.v, max(b.w) AS a FROM firsts f JOIN edge b ON b.v = f.k0 AND b.w < f.v GROUP BY f.v),
par AS (
  SELECT v, p FROM low UNION ALL
  SELECT f.v, coalesce(a.a, f.v) FROM firsts f LEFT JOIN adopt a ON a.v = f.v),
chase AS (
  SELECT v, p AS r FROM par UNION
  SELECT c.v, q.p FROM chase c JOIN par q ON q.v = c.r WHERE q.p <> c.r),
root AS (SELECT v, min(r) AS r FROM chase GROUP BY v),
joiner AS (SELECT f.v, f.k0 FROM firsts f JOIN adopt a ON a.v = f.v),
writer AS (
  SELECT b.v, max(b.w) AS m, arg_max(b.s, b.w) AS s FROM edge b
  WHERE b.w < b.v AND NOT EXISTS (SELECT 1 FROM joiner x WHERE x.v = b.w AND x.k0 = b.v) GROUP BY b.v),
grp AS (
  SELECT root.v AS id, dense_rank() OVER (ORDER BY root.r) - 1 AS group_id, coalesce(w.s, h.s0) AS score
  FROM root LEFT JOIN writer w ON w.v = root.v LEFT JOIN heads h ON h.v = root.v),
sizes AS (SELECT group_id, count(*) AS n_members FROM grp GROUP BY group_id)"""
_WITH = "WITH RECURSIVE "
_CENT = """cell AS (
  SELECT label, unnest(range(1, 65)) AS p, unnest(embedding)::DOUBLE AS x FROM embeddings),
mean AS (SELECT label, p, avg(x) AS m FROM cell GROUP BY label, p),
len AS (SELECT label, sqrt(sum(m * m)) AS l FROM mean GROUP BY label),
cent AS (SELECT label, list(m / l ORDER BY p) AS vec FROM mean JOIN len USING (label) GROUP BY label)"""
_LABS = """lab AS (
  SELECT vec_id, c, embedding[c * 3 + 1]::DOUBLE * 100 AS l, embedding[c * 3 + 2]::DOUBLE * 100 AS a, embedding[c * 3 + 3]::DOUBLE * 100 AS b
  FROM embeddings, range(0, 21) t(c))"""
_HALF = """half AS (
  SELECT vec_id, embedding[1:32]::DOUBLE[] AS front, embedding[33:64]::DOUBLE[] AS back FROM embeddings),
run AS (
  SELECT a.vec_id, 'front' AS mode, greatest(0, least(1, list_cosine_similarity(a.front, q.front))) AS score FROM half a, half q WHERE q.vec_id IN (1, 2)
  UNION ALL
  SELECT a.vec_id, 'back', greatest(0, least(1, list_cosine_similarity(a.back, q.back))) FROM half a, half q WHERE q.vec_id IN (1, 2)),
best AS (SELECT vec_id, mode, max(score) AS score FROM run WHERE score > 0.1 GROUP BY vec_id, mode)"""
_HIST = """obs AS (
  SELECT l_suppkey, 0 AS ch, least(floor(l_quantity / 50.0 * 36), 35)::INT AS slot FROM lineitem WHERE l_quantity BETWEEN 0 AND 50
  UNION ALL SELECT l_suppkey, 1, 36 + least(floor(round(l_discount, 2) / 0.1 * 16), 15)::INT FROM lineitem WHERE round(l_discount, 2) BETWEEN 0 AND 0.1
  UNION ALL SELECT l_suppkey, 2, 52 + least(floor(round(l_tax, 2) / 0.08 * 16), 15)::INT FROM lineitem WHERE round(l_tax, 2) BETWEEN 0 AND 0.08),
cnt AS (SELECT l_suppkey, ch, slot, count(*) AS n FROM obs GROUP BY ALL),
tot AS (SELECT l_suppkey, ch, sum(n) AS t FROM cnt GROUP BY ALL),
grid AS (SELECT l_suppkey, unnest(range(0, 68))::INT AS slot FROM (SELECT DISTINCT l_suppkey FROM obs)),
hist AS (
  SELECT g.l_suppkey, g.slot, coalesce(c.n / t.t, 0.0)::DOUBLE AS share
  FROM grid g LEFT JOIN cnt c USING (l_suppkey, slot) LEFT JOIN tot t ON t.l_suppkey = c.l_suppkey AND t.ch = c.ch),
hist_pair AS (
  SELECT a.l_suppkey AS i, b.l_suppkey AS j, sum(abs(a.share - b.share)) / 2 AS s
  FROM hist a JOIN hist b ON a.slot = b.slot AND a.l_suppkey < b.l_suppkey GROUP BY 1, 2)"""
_SETS = """line AS (
  SELECT l_orderkey, list_sort(list(DISTINCT 's' || l_suppkey)) AS m, list_sort(list(DISTINCT 'r' || l_returnflag || l_linestatus)) AS l
  FROM lineitem GROUP BY l_orderkey),
sets AS (
  SELECT o_orderkey, coalesce(m, []::VARCHAR[]) AS m, coalesce(l, []::VARCHAR[]) AS l FROM orders LEFT JOIN line ON l_orderkey = o_orderkey)"""


def scan_sql(pairs: str, better: str = "false") -> str:
    """The sequential grouping rule as SQL: pairs (i, j, s) are taken in order, the groups of all items so far are one map.

    ``better`` compares the item's score ``old.s`` with the pair's ``s``. Gives ``scanned`` (id, group_id, score).
    """
    return f"""seq AS MATERIALIZED (SELECT row_number() OVER (ORDER BY i, j) AS k, i::BIGINT AS i, j::BIGINT AS j, s::DOUBLE AS s FROM ({pairs})),
scan(k, g, st) AS (
  SELECT 0::BIGINT, 0::BIGINT, MAP([]::BIGINT[], []::STRUCT(g BIGINT, s DOUBLE)[])
  UNION ALL
  SELECT k, CASE WHEN fresh THEN g + 1 ELSE g END, CASE
    WHEN fresh THEN map_concat(st, MAP([i, j], [{{'g': g, 's': s}}, {{'g': g, 's': s}}]))
    WHEN a IS NOT NULL THEN map_concat(st, MAP([j], [{{'g': a.g, 's': s}}])) ELSE map_concat(st, MAP([i], [{{'g': b.g, 's': s}}])) END
  FROM (SELECT *, old IS NULL OR ({better}) AS fresh FROM (
    SELECT seq.k, i, j, s, g, st, st[i] AS a, st[j] AS b, coalesce(st[i], st[j]) AS old FROM scan JOIN seq ON seq.k = scan.k + 1))),
scanned AS (
  SELECT e.key AS id, e.value.g AS group_id, e.value.s AS score FROM (SELECT unnest(map_entries(st)) AS e FROM (SELECT st FROM scan ORDER BY k DESC LIMIT 1)))"""


def _jac(a: str, b: str) -> str:
    both = f"len(list_intersect({a}, {b}))"
    return f"CASE WHEN len({a}) + len({b}) = 0 THEN 0.0 ELSE {both}::DOUBLE / (len({a}) + len({b}) - {both}) END"


ORACLES = {
    "similar_pairs": f"WITH {_PAIR} SELECT i, j, round(s, 6) AS score, 1::BIGINT AS n_i, 1::BIGINT AS n_j FROM pair",
    "greedy_groups": f"{_WITH}{_GROUPS} SELECT id AS vec_id, group_id, round(score, 6) AS score FROM grp",
    "group_order": f"{_WITH}{_GROUPS} SELECT group_id, n_members, row_number() OVER (ORDER BY n_members DESC, group_id) - 1 AS position FROM sizes",
    "group_members_order": f"""{_WITH}{_GROUPS}, ord AS (SELECT group_id, row_number() OVER (ORDER BY n_members DESC, group_id) - 1 AS group_pos FROM sizes)
      SELECT id AS vec_id, group_id, group_pos, row_number() OVER (PARTITION BY group_id ORDER BY score DESC, id) - 1 AS member_pos
      FROM grp JOIN ord USING (group_id)""",
    "group_complement": f"{_WITH}{_GROUPS} SELECT vec_id, label FROM embeddings WHERE vec_id NOT IN (SELECT id FROM grp)",
    "stranded_groups": f"{_WITH}{_GROUPS} SELECT group_id, n_members FROM sizes WHERE n_members = 1",
    "groups_after_removal": f"""{_WITH}{_GROUPS}, kept AS (SELECT grp.* FROM grp JOIN embeddings e ON e.vec_id = grp.id WHERE e.label <> 3)
      SELECT id AS vec_id, group_id, round(score, 6) AS score FROM kept
      WHERE group_id IN (SELECT group_id FROM kept GROUP BY group_id HAVING count(*) >= 2)""",
    "groups_filtered": f"""{_WITH}{_GROUPS}, kept AS (SELECT grp.* FROM grp JOIN embeddings e ON e.vec_id = grp.id WHERE e.label < 5),
      alive AS (SELECT * FROM kept WHERE group_id IN (SELECT group_id FROM kept GROUP BY group_id HAVING count(*) >= 2))
      SELECT id AS vec_id, dense_rank() OVER (ORDER BY group_id) - 1 AS group_id, round(score, 6) AS score FROM alive""",
    "duplicate_vectors": f"WITH {_PAIR} SELECT i, j, round(s, 6) AS score, row_number() OVER (ORDER BY i, j) - 1 AS group_id FROM pair WHERE s > 0.4",
    "prompt_vector_pairs": f"""WITH {_CENT},
      mixed AS (SELECT vec_id, [embedding[p]::DOUBLE - 0.5 * vec[p] FOR p IN range(1, 65)] AS v FROM embeddings JOIN cent USING (label)),
      unit AS (SELECT vec_id, [round(x / sqrt(list_dot_product(v, v)), 7) FOR x IN v] AS v FROM mixed)
      SELECT a.vec_id AS i, b.vec_id AS j, round(list_dot_product(a.v, b.v), 5) AS score
      FROM unit a JOIN unit b ON a.vec_id < b.vec_id WHERE round(list_dot_product(a.v, b.v), 9) > 0.35""",
    "purge_plan": f"""{_WITH}{_GROUPS} SELECT id AS vec_id, group_id,
      CASE WHEN row_number() OVER (PARTITION BY group_id ORDER BY CASE WHEN id % 300 >= 120 THEN 0 ELSE 1 END, id) = 1 THEN 'KEEP' ELSE 'DELETE' END AS action FROM grp""",
    "unrelated_breaks": """WITH seq AS (SELECT vec_id, embedding::DOUBLE[] AS e, lag(embedding::DOUBLE[]) OVER (ORDER BY vec_id) AS p FROM embeddings),
      brk AS (SELECT vec_id, CASE WHEN p IS NULL THEN 0 WHEN list_cosine_similarity(e, p) > 0 THEN 0 ELSE 1 END AS is_break FROM seq)
      SELECT vec_id, is_break, CAST(sum(is_break) OVER (ORDER BY vec_id) AS BIGINT) AS run_id FROM brk""",
    "next_unrelated": """WITH seq AS (
        SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS idx, embedding::DOUBLE[] AS e, lag(embedding::DOUBLE[]) OVER (ORDER BY vec_id) AS p FROM embeddings),
      brk AS (SELECT idx FROM seq WHERE p IS NOT NULL AND NOT list_cosine_similarity(e, p) > 0),
      nxt AS (SELECT s.vec_id, s.idx, (SELECT min(b.idx) FROM brk b WHERE b.idx > s.idx) AS next_pos FROM seq s)
      SELECT vec_id, next_pos, next_pos - idx - 1 AS n_skipped FROM nxt""",
    "previous_unrelated": """WITH seq AS (
        SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS idx, embedding::DOUBLE[] AS e, lead(embedding::DOUBLE[]) OVER (ORDER BY vec_id) AS p FROM embeddings),
      brk AS (SELECT idx FROM seq WHERE p IS NOT NULL AND NOT list_cosine_similarity(e, p) > 0),
      prv AS (SELECT s.vec_id, s.idx, (SELECT max(b.idx) FROM brk b WHERE b.idx < s.idx) AS next_pos FROM seq s)
      SELECT vec_id, next_pos, idx - next_pos - 1 AS n_skipped FROM prv""",
    "color_pairs": """WITH cell AS (
        SELECT vec_id, c, embedding[c * 3 + 1]::DOUBLE * 100 AS l, embedding[c * 3 + 2]::DOUBLE * 100 AS a, embedding[c * 3 + 3]::DOUBLE * 100 AS b
        FROM embeddings, range(0, 21) t(c)),
      diff AS (
        SELECT x.vec_id AS i, y.vec_id AS j, x.c, trunc(sqrt((x.l - y.l) ** 2 + (x.a - y.a) ** 2 + (x.b - y.b) ** 2)) AS d
        FROM cell x JOIN cell y ON x.c = y.c AND x.vec_id < y.vec_id)
      SELECT i, j, sum(d)::DOUBLE AS score FROM diff GROUP BY i, j HAVING max(d) < 40""",
    "search_colors": """WITH cell AS (
        SELECT vec_id, c, embedding[c * 3 + 1]::DOUBLE * 100 AS l, embedding[c * 3 + 2]::DOUBLE * 100 AS a, embedding[c * 3 + 3]::DOUBLE * 100 AS b
        FROM embeddings, range(0, 21) t(c))
      SELECT y.vec_id, sum(trunc(sqrt((x.l - y.l) ** 2 + (x.a - y.a) ** 2 + (x.b - y.b) ** 2)))::DOUBLE AS score
      FROM cell x JOIN cell y ON x.c = y.c AND x.vec_id = 7 AND y.vec_id <> 7 GROUP BY y.vec_id ORDER BY score, y.vec_id LIMIT 50""",
    "label_centroids": f"WITH {_CENT} SELECT label, (p - 1)::INT AS pos, round(m / l, 6) AS x FROM mean JOIN len USING (label)",
    "search_item": f"""SELECT b.vec_id, round({_DOT.format(a='a', b='b')}, 6) AS score FROM embeddings a, embeddings b
      WHERE a.vec_id = 11 AND b.vec_id <> 11 ORDER BY round({_DOT.format(a='a', b='b')}, 9) DESC, b.vec_id LIMIT 50""",
    "search_item_threshold": f"""SELECT b.vec_id, round({_DOT.format(a='a', b='b')}, 6) AS score FROM embeddings a, embeddings b
      WHERE a.vec_id = 11 AND b.vec_id <> 11 AND round({_DOT.format(a='a', b='b')}, 9) > 0.1""",
    "search_multimodal": f"""WITH sc AS (SELECT b.vec_id, a.vec_id <= 3 AS pos, {_DOT.format(a='a', b='b')} AS s FROM embeddings a, embeddings b WHERE a.vec_id IN (1, 2, 3, 4, 5)),
      tot AS (SELECT vec_id, round(avg(s) FILTER (pos) - avg(s) FILTER (NOT pos), 9) AS score FROM sc GROUP BY vec_id)
      SELECT vec_id, round(score, 6) AS score FROM tot ORDER BY tot.score DESC, vec_id LIMIT 50""",
    "search_with_seeds": f"""WITH {_CENT}, q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 1 UNION ALL SELECT vec FROM cent WHERE label IN (0, 1)),
      sc AS (SELECT e.vec_id, round(avg(list_dot_product(e.embedding::DOUBLE[], q.v)), 9) AS score FROM embeddings e, q GROUP BY e.vec_id)
      SELECT vec_id, round(score, 6) AS score FROM sc WHERE score > {THRESHOLD} / 3""",
    "search_preset": f"""WITH {_CENT}, sc AS (SELECT e.vec_id, c.label AS preset, list_dot_product(e.embedding::DOUBLE[], c.vec) AS s FROM embeddings e, cent c),
      rel AS (SELECT vec_id, preset, s / min(s) OVER (PARTITION BY preset) AS r FROM sc),
      best AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY r DESC, preset) AS k FROM rel)
      SELECT vec_id, round(r, 6) AS score FROM best WHERE k = 1 AND preset = 2 ORDER BY r DESC, vec_id LIMIT 50""",
    "preset_matches": f"""WITH sc AS (SELECT a.vec_id AS query_id, b.vec_id, round({_DOT.format(a='a', b='b')}, 9) AS s FROM embeddings a, embeddings b),
      best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS k FROM sc)
      SELECT query_id, vec_id, round(s, 6) AS score FROM best WHERE k <= 5""",
    "prototype_validation": f"""WITH {_CENT}, sc AS (
        SELECT e.vec_id, list_dot_product(e.embedding::DOUBLE[], (SELECT vec FROM cent WHERE label = 1))
          - 0.5 * list_dot_product(e.embedding::DOUBLE[], (SELECT vec FROM cent WHERE label = 2)) AS score FROM embeddings e)
      SELECT vec_id, round(score, 6) AS score FROM sc WHERE score >= 0.1""",
    "multi_text_score": """WITH sc AS (SELECT b.vec_id, a.vec_id AS q, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS s FROM embeddings a, embeddings b WHERE a.vec_id IN (1, 2, 3)),
      pn AS (SELECT vec_id, avg(s) FILTER (q < 3) AS p, avg(1 / s) FILTER (q = 3) AS n FROM sc GROUP BY vec_id),
      out AS (SELECT vec_id, round(CASE WHEN p > 0 AND n > 0 THEN p / n WHEN p > 0 THEN p ELSE 1 / n END, 5) AS score FROM pn)
      SELECT * FROM out WHERE score > 0.01""",
    "best_texts": f"""WITH {_CENT}, sc AS (SELECT e.vec_id, c.label, list_cosine_similarity(e.embedding::DOUBLE[], c.vec) AS s FROM embeddings e, cent c)
      SELECT vec_id, arg_max(label, s) AS best_label, round(max(s), 6) AS score FROM sc GROUP BY vec_id""",
    "text_scores": f"""WITH {_CENT} SELECT e.vec_id, c.label, round(list_cosine_similarity(e.embedding::DOUBLE[], c.vec), 6) AS score FROM embeddings e, cent c""",
    "search_prompt_vector": f"""WITH {_CENT},
      mixed AS (SELECT vec_id, [embedding[p]::DOUBLE - 0.5 * vec[p] FOR p IN range(1, 65)] AS v FROM embeddings JOIN cent USING (label))
      SELECT b.vec_id, round(list_cosine_similarity(a.v, b.v), 6) AS score FROM mixed a, mixed b WHERE a.vec_id = 11 AND b.vec_id <> 11
      ORDER BY round(list_cosine_similarity(a.v, b.v), 9) DESC, b.vec_id LIMIT 50""",
    "capture_seed": f"""WITH {_CENT}, one AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 7)
      SELECT label::BIGINT AS id, 'label ' || label AS name, 'centroid' AS tags, round(list_sum(vec), 6) AS total FROM cent WHERE label < 5
      UNION ALL SELECT 100, 'item 7', 'item', round(list_sum(v) / sqrt(list_dot_product(v, v)), 6) FROM one
      UNION ALL SELECT 101, 'label 6', 'frames', round(list_sum(vec), 6) FROM cent WHERE label = 6""",
    "readd_items": f"{_WITH}{_GROUPS} SELECT id AS vec_id, group_id, round(score, 6) AS score FROM grp",
    "composite_search": f"""WITH near AS (
        SELECT b.vec_id, round({_DOT.format(a='a', b='b')}, 9) AS s FROM embeddings a, embeddings b WHERE a.vec_id = 7 AND b.vec_id <> 7 ORDER BY s DESC, b.vec_id LIMIT 200),
      {_LABS},
      hue AS (SELECT y.vec_id, sum(trunc(sqrt((x.l - y.l) ** 2 + (x.a - y.a) ** 2 + (x.b - y.b) ** 2)))::DOUBLE AS s
        FROM lab x JOIN lab y ON x.c = y.c AND x.vec_id = 7 AND y.vec_id <> 7 GROUP BY y.vec_id ORDER BY s, y.vec_id LIMIT 200)
      SELECT vec_id, round(sqrt(greatest(0, least(1, near.s)) * greatest(0, least(1, 1 - hue.s / 4500.0))), 6)::DOUBLE AS score FROM near JOIN hue USING (vec_id)""",
    "composite_text_search": f"""WITH {_CENT}, sc AS (SELECT e.vec_id, round(list_dot_product(e.embedding::DOUBLE[], c.vec), 9) AS s FROM embeddings e, cent c WHERE c.label = 4)
      SELECT vec_id, round(least(1, s) * 3.0 / 4.0, 6)::DOUBLE AS score FROM sc WHERE s > 0.1""",
    "composite_groups": f"""{_WITH}{_GROUPS}, {_LABS},
      hue_pair AS (SELECT x.vec_id AS i, y.vec_id AS j FROM lab x JOIN lab y ON x.c = y.c AND x.vec_id < y.vec_id
        GROUP BY 1, 2 HAVING max(trunc(sqrt((x.l - y.l) ** 2 + (x.a - y.a) ** 2 + (x.b - y.b) ** 2))) < 36),
      hue_ids AS (SELECT i AS id FROM hue_pair UNION SELECT j FROM hue_pair), kept AS (SELECT * FROM grp WHERE id IN (SELECT id FROM hue_ids)),
      alive AS (SELECT * FROM kept WHERE group_id IN (SELECT group_id FROM kept GROUP BY group_id HAVING count(*) >= 2))
      SELECT id AS vec_id, dense_rank() OVER (ORDER BY group_id) - 1 AS group_id, round(score, 6) AS score FROM alive""",
    "seed_library": """SELECT label::BIGINT AS id, CASE WHEN label = 1 THEN 'renamed' ELSE 'label ' || label END AS name,
      CASE WHEN label < 3 THEN 1 ELSE 0 END::BIGINT AS use_count FROM (SELECT DISTINCT label FROM embeddings) WHERE label NOT IN (4, 9)""",
    "composite_and": f"WITH {_HALF} SELECT vec_id, round(exp(avg(ln(score))), 6) AS score FROM best GROUP BY vec_id HAVING count(*) = 2",
    "composite_or": f"WITH {_HALF} SELECT vec_id, round(max(score), 6) AS score FROM best GROUP BY vec_id",
    "composite_weighted": f"WITH {_HALF} SELECT vec_id, round(sum(score * CASE mode WHEN 'front' THEN 2.0 ELSE 1.0 END) / 3.0, 6) AS score FROM best GROUP BY vec_id",
    "feature_fill": """SELECT vec_id AS path, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 4) AS feature,
      CASE WHEN label < 8 THEN 0 ELSE 1 END AS is_new FROM embeddings""",
    "stale_purge": "SELECT vec_id AS path, label FROM embeddings WHERE label = 0",
    "reference_row": """SELECT vec_id AS path, label, CASE WHEN vec_id = 0 THEN 1 ELSE 0 END AS is_reference FROM embeddings WHERE label = 1 OR vec_id = 0""",
    "hist_signature": f"WITH {_HIST} SELECT l_suppkey, slot, round(share, 6) AS share FROM hist",
    "hist_pairs": f"WITH {_HIST} SELECT i, j, round(s, 9) AS score FROM hist_pair WHERE round(s, 9) <= 0.3",
    "hist_groups": f"""WITH RECURSIVE {_HIST},
      {scan_sql("SELECT i, j, round(s, 9) AS s FROM hist_pair WHERE round(s, 9) <= 0.3", "old.s - s > 0.15")}
      SELECT id AS l_suppkey, group_id, round(score, 6) AS score FROM scanned""",
    "supergroups": f"""{_WITH}{_GROUPS},
      cells AS (SELECT group_id, unnest(range(1, 65)) AS p, unnest(embedding)::DOUBLE AS x FROM grp JOIN embeddings ON vec_id = id),
      avgs AS (SELECT group_id, p, avg(x) AS m FROM cells GROUP BY group_id, p),
      lens AS (SELECT group_id, sqrt(sum(m * m)) AS l FROM avgs GROUP BY group_id),
      centers AS (SELECT group_id, list(m / l ORDER BY p) AS v FROM avgs JOIN lens USING (group_id) GROUP BY group_id),
      near AS (SELECT a.group_id, list(b.group_id) AS nb FROM centers a JOIN centers b ON a.group_id <> b.group_id AND round(list_dot_product(a.v, b.v), 9) >= 0.3 GROUP BY a.group_id),
      nodes AS MATERIALIZED (SELECT row_number() OVER (ORDER BY group_id) AS k, group_id::BIGINT AS v, coalesce(nb, [])::BIGINT[] AS nb FROM centers LEFT JOIN near USING (group_id)),
      fit(k, st) AS (
        SELECT 0::BIGINT, MAP([]::BIGINT[], []::BIGINT[][])
        UNION ALL
        SELECT k, map_concat(st, MAP([coalesce(pick, v)], [list_append(coalesce(st[pick], []::BIGINT[]), v)])) FROM (
          SELECT nodes.k, v, st, list_min([e.key FOR e IN map_entries(st) IF len(list_intersect(e.value, nb)) = len(e.value)]) AS pick
          FROM fit JOIN nodes ON nodes.k = fit.k + 1)),
      homes AS (SELECT e.key AS leader, unnest(e.value) AS group_id FROM (SELECT unnest(map_entries(st)) AS e FROM (SELECT st FROM fit ORDER BY k DESC LIMIT 1))),
      totals AS (SELECT leader, sum(n_members)::BIGINT AS n_items FROM homes JOIN sizes USING (group_id) GROUP BY leader),
      ranks AS (SELECT leader, n_items, row_number() OVER (ORDER BY n_items, leader) - 1 AS supergroup_id FROM totals)
      SELECT group_id, supergroup_id, n_items FROM homes JOIN ranks USING (leader)""",
    "search_hist": f"""WITH {_HIST}, sc AS (SELECT CASE WHEN i = 3 THEN j ELSE i END AS l_suppkey, round(s, 9) AS s FROM hist_pair WHERE i = 3 OR j = 3)
      SELECT l_suppkey, round(s, 6) AS score FROM sc ORDER BY s, l_suppkey LIMIT 50""",
    "mean_signature": f"WITH {_HIST} SELECT s_nationkey, slot, round(avg(share), 6) AS share FROM hist JOIN supplier ON s_suppkey = l_suppkey GROUP BY s_nationkey, slot",
    "diversity": """WITH c AS (SELECT l_suppkey, CAST(l_quantity AS INT) AS q, count(*) AS n FROM lineitem GROUP BY 1, 2),
      p AS (SELECT l_suppkey, n / sum(n) OVER (PARTITION BY l_suppkey) AS p FROM c)
      SELECT l_suppkey, round(least(-sum(p * log2(p)) / 6, 1.0), 6) AS score FROM p GROUP BY l_suppkey""",
    "breadth": """WITH c AS (SELECT l_suppkey, least(floor(l_quantity / 50.0 * 36), 35) AS b, count(*) AS n FROM lineitem WHERE l_discount > 0.08 GROUP BY 1, 2),
      p AS (SELECT l_suppkey, n / sum(n) OVER (PARTITION BY l_suppkey) AS p FROM c),
      e AS (SELECT l_suppkey, least(-sum(p * log2(p)) / log2(36), 1.0) AS score FROM p GROUP BY l_suppkey)
      SELECT s.l_suppkey, round(coalesce(e.score, 0.0), 6) AS score FROM (SELECT DISTINCT l_suppkey FROM lineitem) s LEFT JOIN e USING (l_suppkey)""",
    "set_pairs": f"""WITH {_SETS}, cls AS (SELECT m, l, min(o_orderkey) AS c, count(*) AS n FROM sets GROUP BY m, l),
      tok AS (SELECT c, len(m) AS k, unnest(m) AS t FROM cls),
      hit AS (SELECT a.c AS i, b.c AS j FROM tok a JOIN tok b ON a.t = b.t AND a.c < b.c
        GROUP BY a.c, b.c, a.k, b.k HAVING count(*) >= 0.57 * (a.k + b.k - count(*))),
      sc AS (
        SELECT i, j, a.n AS n_i, b.n AS n_j, 0.7 * {_jac('a.m', 'b.m')} + 0.3 * {_jac('a.l', 'b.l')} AS s
        FROM hit JOIN cls a ON a.c = i JOIN cls b ON b.c = j
        UNION ALL
        SELECT c, c, n, n, CASE WHEN len(m) = 0 THEN 1.0 ELSE 0.7 * {_jac('m', 'm')} + 0.3 * {_jac('l', 'l')} END FROM cls WHERE n > 1)
      SELECT i, j, round(s, 6) AS score, n_i, n_j FROM sc WHERE s >= 0.7""",
    "search_sets": f"""WITH {_SETS}, sc AS (SELECT o_orderkey, CASE WHEN len(m) = 0 THEN 0.0
        ELSE 0.7 * {_jac('m', "['s1', 's2']")} + 0.3 * {_jac('l', "['rNO']")} END AS s FROM sets)
      SELECT o_orderkey, round(s, 6) AS score FROM sc WHERE s >= 0.3""",
    "search_no_models": f"WITH {_SETS} SELECT o_orderkey, 1.0::DOUBLE AS score FROM sets WHERE len(m) = 0 AND len(l) = 0",
}
