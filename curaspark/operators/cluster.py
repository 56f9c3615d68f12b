"""Order-dependent similarity grouping, done as pointer forests instead of a sequential scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curaspark.operators.pairs import NearSet, PairSet
from curaspark.scale import asof, chase_parents, row_index
from curaspark.session import checkpoint


class _Neighbours:
    """Items of a pair set in id order (idx, id, cls) with lookups of their nearest similar items."""

    def __init__(self, pairs: PairSet, items: DataFrame | None = None):
        sizes = pairs.classes.select(F.col("cls").alias("d"), (F.col("n") > 1).alias("many"))
        self.adjacency = checkpoint(pairs.adjacency().join(sizes, "d"))
        linked = self.adjacency.select("cls").distinct()
        self.items = row_index(pairs.members.join(linked, "cls", "left_semi"), [F.col("id")], "idx") if items is None else items
        self.span = self.items.count()
        self.copies = not self.adjacency.filter("many").isEmpty()

    def below(self) -> DataFrame:
        """(pos, score, hit) of smaller similar items; the largest one of every item is among them."""
        return self.nearest(self.around(self.items.select("idx", "cls")))

    def above(self, some: DataFrame) -> DataFrame:
        """(pos, score, hit) of larger similar items; the smallest one of every item is among them."""
        return self.nearest(self.around(some), forward=True)

    def under(self, asked: DataFrame) -> DataFrame:
        """(pos, score, hit) of items similar to class ``cls`` below ``pos``; the largest one is among them."""
        return self.nearest(asked.select(F.col("pos").alias("idx"), "cls").transform(self.around))

    def beyond(self, hits: DataFrame, barred: DataFrame, asked: DataFrame) -> DataFrame:
        """``hits`` (pos, score, hit) less the barred ones (hit, mark) of queries asked (pos, cls, ban) with that ``ban``; where the
        largest hit is barred, the largest one that is not is among the rest."""
        ruled = asked.select("pos", F.col("ban").alias("mark")).join(barred, "mark").select("pos", "hit")
        return hits.join(ruled, ["pos", "hit"], "left_anti")

    def steps(self, after: DataFrame, cutoff: float, lower: bool) -> DataFrame:
        """The records (pos, hit, score) of larger similar items above ``edge``, from the score ``sc0`` on: after(pos, cls, edge, sc0)."""
        ahead = self.above(self.items.select("idx", "cls")).join(after.select("pos", "edge", "sc0"), "pos").filter(F.col("hit") > F.col("edge"))
        return _records(checkpoint(ahead), "pos", "hit", "sc0", cutoff, lower)

    def around(self, some: DataFrame) -> DataFrame:
        """One query row per (item, similar class): (key, pos, score, many)."""
        return some.join(self.adjacency, "cls").select(
            F.col("d").alias("key"), F.col("idx").alias("pos"), "score", "many"
        )

    def nearest(self, queries: DataFrame, forward: bool = False) -> DataFrame:
        """Nearest member of class ``key`` below (above) ``pos``; classes of one item need no search."""
        single = self.items.select(F.col("cls").alias("key"), F.col("idx").alias("hit"))
        side = F.col("hit") > F.col("pos") if forward else F.col("hit") < F.col("pos")
        found = queries.filter(~F.col("many")).join(single, "key").filter(side).select("pos", "score", "hit")
        if not self.copies:
            return found
        data = self.items.select(F.col("cls").alias("key"), F.col("idx").alias("pos"))
        searched = asof(data, queries.filter("many").drop("many"), "key", "pos", self.span, forward)
        return found.unionByName(searched.filter(F.col("hit").isNotNull()).select("pos", "score", "hit"))


class _Nearest(_Neighbours):
    """The same lookups for a set that holds no pairs between items without copies: they are asked for by products in blocks."""

    def __init__(self, near: NearSet):
        super().__init__(near.copies, near.items)
        self.near = near

    def _side(self, up: bool) -> DataFrame:
        return self.near.near.filter(F.col("up") == up).select("pos", "score", "hit")

    def below(self) -> DataFrame:
        return super().below().unionByName(self._side(False))

    def above(self, some: DataFrame) -> DataFrame:
        return super().above(some).unionByName(self._side(True).join(some.select(F.col("idx").alias("pos")), "pos", "left_semi"))

    def under(self, asked: DataFrame) -> DataFrame:
        return super().under(asked).unionByName(self.near.seek(asked))

    def beyond(self, hits: DataFrame, barred: DataFrame, asked: DataFrame) -> DataFrame:
        ruled = asked.select("pos", F.col("ban").alias("mark")).join(barred, "mark").select("pos", "hit")
        again = asked.join(hits.join(ruled, ["pos", "hit"], "left_semi").select("pos").distinct(), "pos", "left_semi")
        found = self.near.seek(again, marks=barred)
        return super().beyond(hits, barred, asked).unionByName(found)

    def steps(self, after: DataFrame, cutoff: float, lower: bool) -> DataFrame:
        sign = -1.0 if lower else 1.0
        copied = super().above(self.items.select("idx", "cls"))
        copied = checkpoint(copied.withColumn("_s", F.col("score") * sign))
        state = checkpoint(after.select("pos", "cls", "edge", (F.col("sc0") * sign).alias("bound"), F.lit(float(cutoff)).alias("least")))
        found = None
        # with a cutoff every round improves the scores by it, so rounds are few; without one there may be many
        while True:
            held = copied.join(state, "pos").filter((F.col("hit") > F.col("edge")) & (F.col("_s") - F.col("bound") > F.col("least")))
            some = held.select("pos", "score", "hit").unionByName(self.near.seek(state, up=True, sign=sign))
            first = checkpoint(some.groupBy("pos").agg(F.min(F.struct("hit", "score")).alias("m")).select("pos", "m.hit", "m.score"))
            if first.isEmpty():
                break
            found = first if found is None else found.unionByName(first)
            state = checkpoint(
                state.join(first, "pos").select("pos", "cls", F.col("hit").alias("edge"), (F.col("score") * sign).alias("bound"), "least")
            )
        return found if found is not None else first


def _graph(pairs: PairSet | NearSet) -> _Neighbours:
    return _Nearest(pairs) if isinstance(pairs, NearSet) else _Neighbours(pairs)


def greedy_groups(pairs: PairSet | NearSet) -> DataFrame:
    """Greedy grouping of a pair stream in (i, j) order, without a regroup rule: (id, group_id, score).

    With items numbered in id order and i ~ j meaning "similar", the sequential rule assigns every
    item to the group of its largest smaller neighbour. An item without one adopts the group its
    smallest larger neighbour k already has (that is, the group of k's largest neighbour below the
    item) and otherwise founds a group. Pointers only go down, so groups are the trees of a forest
    and are numbered in root order. The score is that of the last pair that wrote the item.

    Neighbours are looked up per (item, similar class) with a distributed as-of lookup, so copies
    are never paired with each other.
    """
    graph = _graph(pairs)
    items = graph.items
    below = checkpoint(graph.below())
    lower = below.groupBy("pos").agg(F.max("hit").alias("parent"))
    first = items.join(lower, items["idx"] == lower["pos"], "left_anti").select("idx", "cls")
    nearest = checkpoint(
        graph.above(first)
        .groupBy("pos")
        .agg(F.min(F.struct("hit", "score")).alias("m"))
        .select(F.col("pos").alias("idx"), F.col("m.hit").alias("k0"), F.col("m.score").alias("k0_score"))
    )
    # neighbours of k0 below the item
    k_side = nearest.join(items.select(F.col("idx").alias("k0"), "cls"), "k0").select(F.col("idx").alias("pos"), "cls")
    adopted = graph.under(k_side).groupBy("pos").agg(F.max("hit").alias("adopt"))
    heads = checkpoint(
        nearest.join(adopted, nearest["idx"] == adopted["pos"], "left").select("idx", "k0", "k0_score", "adopt")
    )
    parents = lower.select(F.col("pos").alias("node"), "parent").unionByName(
        heads.select(F.col("idx").alias("node"), F.coalesce("adopt", "idx").alias("parent"))
    )
    roots = chase_parents(parents)
    # last writer: the largest smaller neighbour that did not itself join through this item
    adopters = heads.filter(F.col("adopt").isNotNull()).select(
        F.col("idx").alias("hit"), F.col("k0").alias("mark")
    )
    everyone = items.select(F.col("idx").alias("pos"), "cls", F.col("idx").alias("ban"))
    writers = graph.beyond(below, adopters, everyone)
    written = writers.groupBy("pos").agg(F.max(F.struct("hit", "score")).alias("w")).select(
        F.col("pos").alias("node"), F.col("w.score").alias("w_score")
    )
    # an item whose smaller neighbours all joined through it keeps the score of its own first pair up
    head_scores = heads.select(F.col("idx").alias("node"), "k0_score")
    bare = (
        items.select("idx", "cls")
        .join(written, items["idx"] == written["node"], "left_anti")
        .join(head_scores, F.col("idx") == head_scores["node"], "left_anti")
    )
    up_scores = (
        graph.above(bare)
        .groupBy("pos")
        .agg(F.min(F.struct("hit", "score")).alias("m"))
        .select(F.col("pos").alias("node"), F.col("m.score").alias("k0_score"))
    )
    first_scores = head_scores.unionByName(up_scores)
    named = roots.join(written, "node", "left").join(first_scores, "node", "left").select(
        "node", "root", F.coalesce("w_score", "k0_score").alias("score")
    )
    numbered = row_index(roots.select("root").distinct(), [F.col("root")], "group_id")
    return (
        named.join(numbered, "root")
        .join(items.select(F.col("idx").alias("node"), "id"), "node")
        .select("id", "group_id", "score")
    )


def _records(rows: DataFrame, key: str, pos: str, start: str, cutoff: float, lower: bool) -> DataFrame:
    """Rows (key, pos, score) that improve on the running score of their key by more than ``cutoff``.

    The running score begins at ``start`` and takes the score of every row found. With a cutoff the
    scan is repeated from the last row found; every repeat improves the score by the cutoff, so
    repeats are few. Without one, the rows are those better than everything before them.
    """
    sign = -1.0 if lower else 1.0
    rows = rows.withColumn("_s", F.col("score") * sign).withColumn("_b", F.col(start) * sign)
    if cutoff == 0:
        from curaspark.scale import range_width

        top = rows.agg(F.max(pos)).first()[0] or 0
        width = range_width(top + 1)
        ranged = rows.withColumn("_rng", F.floor(F.col(pos) / F.lit(width)))
        tops = ranged.groupBy(key, "_rng").agg(F.max("_s").alias("_top"))
        before = Window.partitionBy(key).orderBy("_rng").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
        carried = tops.select(key, "_rng", F.max("_top").over(before).alias("_carry"))
        inside = Window.partitionBy(key, "_rng").orderBy(pos).rowsBetween(Window.unboundedPreceding, -1)
        seen = ranged.withColumn("_in", F.max("_s").over(inside)).join(carried, [key, "_rng"])
        return seen.filter(F.col("_s") > F.greatest("_b", "_in", "_carry")).select(key, pos, "score")
    open_rows = checkpoint(rows.select(key, pos, "score", "_s", "_b"))
    found = None
    while True:
        better = open_rows.filter(F.col("_s") - F.col("_b") > cutoff)
        first = checkpoint(better.groupBy(key).agg(F.min(F.struct(F.col(pos).alias("p"), F.col("score").alias("sc"), F.col("_s").alias("v"))).alias("f")))
        if first.isEmpty():
            break
        hit = first.select(key, F.col("f.p").alias(pos), F.col("f.sc").alias("score"))
        found = hit if found is None else found.unionByName(hit)
        open_rows = checkpoint(
            open_rows.join(first, key).filter(F.col(pos) > F.col("f.p")).select(key, pos, "score", "_s", F.col("f.v").alias("_b"))
        )
    return found if found is not None else rows.select(key, pos, "score").limit(0)


def regroup_groups(pairs: PairSet | NearSet, cutoff: float, lower: bool) -> DataFrame:
    """Greedy grouping with the regroup rule: (id, group_id, score).

    As ``greedy_groups``, but a pair that improves on the score of the item looked at by more than
    ``cutoff`` moves both items into a new group. An item's scan over its larger neighbours is then
    cut into versions by its regrouping pairs, and an item belongs to the version its last writer
    was in. Within one similar class only the first member above an item can regroup, so copies
    are again looked up per class. Groups are numbered by founding pair, emptied ones included.
    """
    graph = _graph(pairs)
    items = graph.items
    everyone = items.select(F.col("idx").alias("pos"), "cls", F.col("idx").alias("ban"))
    below = checkpoint(graph.below())
    has_lower = below.select(F.col("pos").alias("idx")).distinct()
    first = graph.above(items.select("idx", "cls").join(has_lower, "idx", "left_anti")).groupBy("pos").agg(
        F.min(F.struct("hit", "score")).alias("m")
    )
    heads = checkpoint(first.select(F.col("pos").alias("i"), F.col("m.hit").alias("k0"), F.col("m.score").alias("s0")))

    # adopters: heads whose partner k0 already has a smaller neighbour
    k_rows = heads.join(items.select(F.col("idx").alias("k0"), "cls"), "k0").select(F.col("i").alias("pos"), "cls", F.col("k0").alias("ban"))
    k_low = checkpoint(graph.under(k_rows))
    is_adopter = checkpoint(heads.join(k_low.select(F.col("pos").alias("i")).distinct(), "i", "left_semi"))
    other = is_adopter.select(F.col("i").alias("hit"), F.col("k0").alias("mark"))
    plain = graph.beyond(k_low, other, k_rows).groupBy(F.col("pos").alias("i")).agg(
        F.max(F.struct(F.col("hit").alias("x"), F.col("score").alias("sx"))).alias("m")
    )
    adopters = checkpoint(
        is_adopter.join(plain, "i").select("i", "k0", F.col("s0").alias("score"), F.col("m.x").alias("mx"), F.col("m.sx").alias("msx"))
        .withColumn("seg", F.struct("k0", "mx"))
    )
    moved = checkpoint(_records(adopters, "seg", "i", "msx", cutoff, lower).select("i", F.col("seg.k0").alias("k0"), "score"))
    stay = checkpoint(adopters.join(moved.select("i"), "i", "left_anti").select(F.col("i").alias("hit"), F.col("k0").alias("mark")))

    # last writer and score at the start of each item's scan
    writers = graph.beyond(below, stay, everyone).groupBy("pos").agg(F.max(F.struct("hit", "score")).alias("w"))
    writers = checkpoint(writers.select(F.col("pos").alias("node"), F.col("w.hit").alias("by"), F.col("w.score").alias("sc0")))
    start = writers.select(F.col("node").alias("pos"), "sc0").unionByName(heads.select(F.col("i").alias("pos"), F.col("s0").alias("sc0")))
    # the first pair of a head, with its nearest larger item, is no part of the scan
    scan = start.join(everyone.select("pos", "cls"), "pos").join(heads.select(F.col("i").alias("pos"), "k0"), "pos", "left")
    scan = scan.select("pos", "cls", F.coalesce("k0", "pos").alias("edge"), "sc0")
    later = graph.steps(scan, cutoff, lower).select(F.col("pos").alias("i"), F.col("hit").alias("at"), "score")
    # founding pairs: heads with an ungrouped partner, regrouping adopters, regrouping pairs of scans
    founders = heads.join(adopters.select("i"), "i", "left_anti").select("i", F.col("k0").alias("at"), F.col("s0").alias("score"))
    events = checkpoint(later.unionByName(founders).unionByName(moved.select("i", F.col("k0").alias("at"), "score")))
    numbered = row_index(events, [F.col("i"), F.col("at")], "group_id")

    # version of the writer an item (or, for a staying adopter, its partner) was written in
    last_before = (
        adopters.join(stay.select(F.col("hit").alias("i")), "i")
        .select("i", "k0", F.col("mx").alias("x"))
    )
    regrouped = moved.select(F.col("i").alias("x"), "k0")
    late = last_before.select("i", "k0").join(regrouped, "k0").filter(F.col("x") < F.col("i")).select("i", "k0", "x")
    last_before = last_before.unionByName(late).groupBy("i", "k0").agg(F.max("x").alias("x"))
    asked = writers.select("node", F.col("by").alias("x"), F.col("node").alias("at")).unionByName(
        last_before.select(F.col("i").alias("node"), "x", F.col("k0").alias("at"))
    )
    # the as-of lookup finds positions strictly below, so the query asks one position further
    version = asof(
        events.select(F.col("i").alias("x"), "at"), asked.withColumn("at", F.col("at") + 1), "x", "at", graph.span + 2
    ).select("node", "x", F.col("hit").alias("at"))
    own = events.groupBy("i").agg(F.max(F.struct("at", "score")).alias("e")).select(
        F.col("i").alias("node"), F.col("e.at").alias("own_at"), F.col("e.score").alias("own_score")
    )
    heads_with_event = founders.select(F.col("i").alias("node"), "at").unionByName(moved.select(F.col("i").alias("node"), F.col("k0").alias("at")))
    origin = checkpoint(
        version.select("node", "x", "at").unionByName(heads_with_event.select("node", F.col("node").alias("x"), "at"))
    )
    roots = chase_parents(origin.select("node", F.when(F.col("at").isNull(), F.col("x")).otherwise(F.col("node")).alias("parent")))
    ends = origin.filter("at is not null").select(F.col("node").alias("root"), F.col("x").alias("f_i"), F.col("at").alias("f_at"))
    state = (
        roots.join(ends, "root").join(own, "node", "left").join(start.select(F.col("pos").alias("node"), "sc0"), "node")
        .select(
            "node",
            F.when(F.col("own_at").isNotNull(), F.col("node")).otherwise(F.col("f_i")).alias("i"),
            F.coalesce("own_at", "f_at").alias("at"), F.coalesce("own_score", "sc0").alias("score"),
        )
    )
    return (
        state.join(numbered.select("i", "at", "group_id"), ["i", "at"])
        .join(items.select(F.col("idx").alias("node"), "id"), "node").select("id", "group_id", "score")
    )


# ------------------------------------------------------------------ supergroups

# Share of the base threshold, and the lowest base threshold that is still used.
SUPER_RATIO = 0.85
SUPER_MIN = 0.5


def components(edges: DataFrame) -> DataFrame:
    """(node, label): connected components of undirected edges (a, b) by minimum label and jumping."""
    both = checkpoint(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = checkpoint(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")))
    while True:
        heard = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("seen"))
        low = labels.join(heard, F.col("node") == F.col("a")).select("node", "label", F.least("label", "seen").alias("low"))
        jump = labels.select(F.col("node").alias("_n"), F.col("label").alias("_l"))
        step = checkpoint(low.join(jump, F.col("low") == F.col("_n")).select("node", "label", F.least("low", "_l").alias("next")))
        done = step.filter(F.col("label") != F.col("next")).isEmpty()
        labels = step.select("node", F.col("next").alias("label"))
        if done:
            return labels


def complete_link(edges: DataFrame) -> DataFrame:
    """(node, leader) of first-fit complete-link clusters over the edges (a, b), a < b.

    In ascending order every node joins the first cluster all of whose members it is linked to, which is what merging the
    first mergeable pair of clusters again and again comes to. Decided in rounds, whatever the size of a component: a node is
    decided once its smaller neighbours are, and once no smaller undecided node is linked to a leader it could join.
    """
    both = checkpoint(edges.select(F.col("a").alias("v"), F.col("b").alias("w")).unionByName(edges.select(F.col("b").alias("v"), F.col("a").alias("w"))))
    state = checkpoint(both.select("v").distinct().withColumn("leader", F.lit(None).cast(both.schema["v"].dataType)))
    while not state.filter("leader is null").isEmpty():
        undecided = state.filter("leader is null").select("v")
        first_open = both.join(undecided.withColumnRenamed("v", "w"), "w").groupBy("v").agg(F.min("w").alias("open"))
        lower = both.join(undecided, "v").filter(F.col("w") < F.col("v")).join(
            state.select(F.col("v").alias("w"), F.col("leader").alias("home")), "w"
        ).join(first_open.select(F.col("v").alias("w"), "open"), "w", "left")
        blocked = lower.filter(F.col("home").isNull() | ((F.col("home") == F.col("w")) & (F.col("open") < F.col("v")))).select("v").distinct()
        ready = checkpoint(undecided.join(blocked, "v", "left_anti"))
        sizes = state.filter("leader is not null").groupBy("leader").agg(F.count(F.lit(1)).alias("size"))
        fits = (
            lower.join(ready, "v").groupBy("v", "home").agg(F.count(F.lit(1)).alias("n"))
            .join(sizes, F.col("home") == F.col("leader")).filter(F.col("n") == F.col("size")).groupBy("v").agg(F.min("home").alias("home"))
        )
        decided = ready.join(fits, "v", "left").select("v", F.coalesce("home", "v").alias("leader"))
        state = checkpoint(state.join(ready, "v", "left_anti").unionByName(decided))
    return state.select(F.col("v").alias("node"), "leader")


def supergroups(groups: DataFrame, items: DataFrame, vec: str, threshold: float, min_viable: float = SUPER_MIN,
                ratio: float = SUPER_RATIO) -> DataFrame:
    """(group_id, supergroup_id, n_items): groups clustered by centroid similarity, smallest total first.

    Skipped (empty) for thresholds below ``min_viable``. ``items`` has (id, vec).
    """
    from curaspark.operators.agg import centroid
    from curaspark.operators.pairs import similar_pairs

    empty = groups.select("group_id", F.lit(0).cast("bigint").alias("supergroup_id"), F.lit(0).cast("bigint").alias("n_items")).limit(0)
    if threshold < min_viable:
        return empty
    members = groups.select("id", "group_id").join(items, "id").select("group_id", vec)
    centers = checkpoint(centroid(members, "group_id", vec, "center"))
    limit = threshold * ratio
    # at-least test: scores are rounded to 9 places, so the strict join starts just below
    found = similar_pairs(centers, "group_id", "center", limit - 1e-9)
    expanded = found.members.withColumnRenamed("id", "g")
    links = found.pairs.filter(F.col("score") >= limit).join(expanded.select(F.col("g").alias("x"), F.col("cls").alias("c")), "c").join(
        expanded.select(F.col("g").alias("y"), F.col("cls").alias("d")), "d"
    ).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    same = expanded.filter(F.col("g") != F.col("cls")).select(F.col("cls").alias("a"), F.col("g").alias("b"))
    edges = checkpoint(links.unionByName(same).distinct())
    sizes = group_sizes(groups)
    if edges.isEmpty():
        named = sizes.select("group_id", F.col("group_id").alias("leader"), "n_members")
    else:
        led = complete_link(edges)
        named = sizes.join(led, F.col("group_id") == F.col("node"), "left").select("group_id", F.coalesce("leader", "group_id").alias("leader"), "n_members")
    named = checkpoint(named)
    totals = named.groupBy("leader").agg(F.sum("n_members").alias("n_items"))
    ranked = row_index(totals, [F.col("n_items"), F.col("leader")], "supergroup_id")
    return named.join(ranked, "leader").select("group_id", "supergroup_id", "n_items")


def meaningful(supers: DataFrame) -> DataFrame:
    """One row: whether any supergroup joins several groups."""
    sizes = supers.groupBy("supergroup_id").agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.coalesce(F.bool_or(F.col("n") > 1), F.lit(False)).alias("meaningful"))


def group_sizes(groups: DataFrame) -> DataFrame:
    return groups.groupBy("group_id").agg(F.count(F.lit(1)).alias("n_members"))


def stranded(groups: DataFrame) -> DataFrame:
    """Groups left with one member."""
    return group_sizes(groups).filter(F.col("n_members") == 1)


def complement(media: DataFrame, groups: DataFrame, ident: str) -> DataFrame:
    """Items that belong to no group."""
    return media.join(groups.select(F.col("id").alias(ident)), ident, "left_anti")


def remove_items(groups: DataFrame, keys: DataFrame) -> DataFrame:
    """Drop the listed ids; groups left with fewer than two members disappear."""
    left = groups.join(keys.select("id"), "id", "left_anti")
    alive = group_sizes(left).filter(F.col("n_members") >= 2).select("group_id")
    return left.join(alive, "group_id", "left_semi").select(*groups.columns)


def filter_groups(groups: DataFrame, keep: DataFrame) -> DataFrame:
    """Keep the listed ids, drop groups below two members, renumber the rest from 0 in old order."""
    left = groups.join(keep.select("id"), "id", "left_semi")
    alive = group_sizes(left).filter(F.col("n_members") >= 2).select("group_id")
    renumbered = row_index(alive, [F.col("group_id")], "new_id")
    return left.join(renumbered, "group_id").select("id", F.col("new_id").alias("group_id"), "score")


def prune_supergroups(supergroups: DataFrame, live: DataFrame) -> DataFrame:
    """Drop supergroup entries of groups that no longer exist."""
    return supergroups.join(live.select("group_id").distinct(), "group_id", "left_semi")


def sorted_groups(groups: DataFrame, supergroups: DataFrame | None = None, desc: bool = False) -> DataFrame:
    """Display order of groups: by supergroup total, then own size; uncovered groups last."""
    sizes = group_sizes(groups)
    if supergroups is None:
        keyed = sizes.withColumn("covered", F.lit(1)).withColumn("supergroup_id", F.lit(None).cast("bigint"))
        keyed = keyed.withColumn("super_total", F.lit(0).cast("bigint"))
    else:
        joined = sizes.join(supergroups.select("group_id", "supergroup_id"), "group_id", "left")
        totals = joined.filter("supergroup_id is not null").groupBy("supergroup_id").agg(
            F.sum("n_members").alias("super_total")
        )
        keyed = joined.join(totals, "supergroup_id", "left").withColumn(
            "covered", F.when(F.col("supergroup_id").isNotNull(), 0).otherwise(1)
        )

    def way(c: str) -> Column:
        return F.col(c).desc() if desc else F.col(c).asc()

    order = [F.col("covered"), way("super_total"), F.col("supergroup_id"), way("n_members"), F.col("group_id")]
    return row_index(keyed, order, "position").select("group_id", "supergroup_id", "n_members", "position")


def display_order(groups: DataFrame, order: DataFrame, desc: bool = True) -> DataFrame:
    """Position of every item: (group position, position inside the group by score)."""
    from curaspark.scale import group_index

    score = F.col("score").desc() if desc else F.col("score").asc()
    inside = group_index(groups, ["group_id"], [score, F.col("id")], "member_pos")
    places = order.select(F.col("group_id").alias("_g"), F.col("position").alias("group_pos"))
    return inside.join(places, F.col("group_id") == F.col("_g")).select("id", "group_id", "group_pos", "member_pos")


def duplicate_groups(pairs: DataFrame) -> DataFrame:
    """Every duplicate pair (i, j, score, n_i, n_j) as a group of its own, numbered in pair order."""
    return row_index(pairs, [F.col("i"), F.col("j")], "group_id")


def duplicates(pairs: PairSet, threshold: float, at_least: bool = False, lower: bool = False) -> DataFrame:
    """Probable duplicates: pairs beyond the duplicate threshold, one row per pair of classes."""
    rows = pairs.rows()
    score = F.col("score")
    if lower:
        return rows.filter(score < threshold)
    return rows.filter(score >= threshold if at_least else score > threshold)


def purge_plan(groups: DataFrame, media: DataFrame, ident: str, tie: Column) -> DataFrame:
    """Keep one member per group, preferring sides of at least 120 or unknown; the rest are deleted.

    ``media`` has (ident, width, height). The keeper is an aggregate minimum, not a window, so a
    group of any size stays distributed.
    """
    side_ok = F.coalesce(F.col("width") >= 120, F.lit(True)) & F.coalesce(F.col("height") >= 120, F.lit(True))
    unknown = F.col("width").isNull() | F.col("height").isNull()
    joined = groups.join(media, groups["id"] == media[ident]).select(
        "id", "group_id", F.struct((~(side_ok | unknown)).cast("int").alias("q"), tie.alias("t"), F.col("id")).alias("rank")
    )
    keepers = joined.groupBy("group_id").agg(F.min("rank").alias("best"), F.count(F.lit(1)).alias("n_members"))
    return joined.join(keepers, "group_id").select(
        "id", "group_id",
        F.when(F.col("id") == F.col("best.id"), "KEEP").otherwise("DELETE").alias("action"),
    )


def adjacency_breaks(df: DataFrame, order: list[Column], related: Column, run: str = "run_id") -> DataFrame:
    """Split an ordered sequence into runs: a row starts a new run when ``related`` is false.

    ``related`` is an expression over the row's columns and ``prev`` (struct of the previous row).
    """
    indexed = row_index(df, order, "idx")
    names = [c for c in indexed.columns]
    before = indexed.select((F.col("idx") + 1).alias("idx"), F.struct(*names).alias("prev"))
    joined = indexed.join(before, "idx", "left").withColumn(
        "is_break", F.when(F.col("prev").isNull(), False).otherwise(~F.coalesce(related, F.lit(False)))
    )
    return running_total(joined, "idx", F.col("is_break").cast("bigint"), run).drop("prev")


def running_total(df: DataFrame, pos: str, value: Column, name: str) -> DataFrame:
    """Inclusive running sum of ``value`` along the dense position ``pos``, computed per range."""
    from curaspark.scale import range_width

    total = df.agg(F.max(pos)).first()[0]
    width = range_width((total or 0) + 1)
    ranged = df.withColumn("_rng", F.floor(F.col(pos) / F.lit(width))).withColumn("_v", value)
    sums = ranged.groupBy("_rng").agg(F.sum("_v").alias("_s"))
    prior = Window.orderBy("_rng").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    starts = sums.select("_rng", F.coalesce(F.sum("_s").over(prior), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("_rng").orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    return (
        ranged.join(F.broadcast(starts), "_rng")
        .withColumn(name, F.col("_start") + F.sum("_v").over(inside))
        .drop("_rng", "_v", "_start")
    )


def unrelated_step(runs: DataFrame, forward: bool = True) -> DataFrame:
    """For every row of ``adjacency_breaks`` the position a walk stops at: the next (or the last earlier) row that is not
    related to the one before it on the way, and the number of rows skipped. Null where the walk runs into an end.
    """
    edge = F.min("idx") if forward else F.max("idx")
    step = 1 if forward else -1
    edges = runs.groupBy(F.col("run_id").alias("_r")).agg(edge.alias("_at"))
    walked = runs.join(edges, F.col("run_id") + step == F.col("_r"), "left")
    return walked.withColumn("next_pos", F.col("_at")).withColumn("n_skipped", F.abs(F.col("_at") - F.col("idx")) - 1).drop("_r", "_at")
