"""Exact Jaccard join of word-shingle sets by signature trees.

Equal sets count once (a *set* below is a class of copies). Sets that could be linked share one of the first
shingles of their prefixes; shingles that are frequent in the corpus come last in the order, so the groups of
sets under one shingle stay small. Over such a group stands a signature tree: components that are already known
form its lower nodes, with OR-combined bitmaps of their shingles and the range of their sizes, and further nodes
combine those. Two trees are walked together: a pair of nodes whose sizes are too far apart, or whose bitmaps
leave too few shingles that could be common, is pruned with everything below it. What survives is compared
shingle by shingle, except where two sets are already connected.

A first round links every set with the one it shares most prefix shingles with, by which copies with small
edits become few components; the second round then walks all pairs of components that are left.

Rows with null or empty texts have no shingles and link with nothing. Rows without an id are returned with a null
component. Repeated rows are copies. Ties are broken by the smaller id.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from curaspark.llm.common import batch_windows, lowered_words, per_batch, text_rows, window_hashes, word_hashes
from curaspark.operators.cluster import components
from curaspark.session import checkpoint

#: Words of a shingle, and the similarity from which two sets are linked, in hundredths.
WIDTH = 5
PERCENT = 80
#: A shingle that one batch of texts holds more often is reported as perhaps frequent; at most so many of the
#: most frequent ones are put last. Both only steer the order of shingles, never which pairs are found.
OFTEN = 4
FREQUENT = 100_000
#: Texts whose sets are compared for copies and frequent shingles at a time.
TEXTS = 4000
#: Sets or components that one task compares with each other.
BLOCK = 256
#: Slots of the filter that spares most texts the second reading; it lets some through, the join after it none.
SLOTS = 1 << 23
#: Parts that a frequent shingle, or the summary of a component, is split into.
SALTS = 64
#: Halvings of a bitmap for which the number of colliding shingles is kept.
LEVELS = 4


def shingles(text: bytes | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct shingle hashes of a text."""
    return np.unique(window_hashes(word_hashes(lowered_words(text)), width))


def batch_shingles(texts: list[bytes | None], width: int) -> list[np.ndarray]:
    """``shingles`` of many texts."""
    out = []
    for runs in batch_windows(texts, width):
        runs = np.sort(runs)
        fresh = np.ones(len(runs), bool)
        fresh[1:] = runs[1:] != runs[:-1]
        out.append(runs if fresh.all() else runs[fresh])
    return out


def set_key(tokens: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(tokens.tobytes(), seed=len(tokens)) - (1 << 63)


# ------------------------------------------------------------------ signatures


def signature(tokens: np.ndarray) -> tuple[int, int, list[int]]:
    """(bitmap size as a power of two, bitmap, shingles lost to collisions at this size and at its halves)."""
    n = len(tokens)
    power = max(8, int(4 * n - 1).bit_length())
    flags = np.zeros(1 << power, np.uint8)
    flags[(tokens & np.uint64((1 << power) - 1)).astype(np.int64)] = 1
    bits = int.from_bytes(np.packbits(flags, bitorder="little").tobytes(), "little")
    lost = [n - fold(bits, power, power - j).bit_count() for j in range(LEVELS)]
    return power, bits, lost


def fold(bits: int, power: int, to: int) -> int:
    """Halve a bitmap until it has 2**to places."""
    while power > to:
        power -= 1
        bits = (bits & ((1 << (1 << power)) - 1)) | (bits >> (1 << power))
    return bits


class Node:
    """A node of a signature tree: size range, OR-combined bitmap, and what lies below."""

    __slots__ = ("below", "bits", "high", "item", "lost", "low", "power")

    def __init__(self, low, high, power, bits, lost, item=None, below=()):
        self.low, self.high, self.power, self.bits, self.lost, self.item, self.below = low, high, power, bits, lost, item, below

    @classmethod
    def over(cls, nodes: list[Node]) -> Node:
        if len(nodes) == 1:
            return nodes[0]
        power = min(n.power for n in nodes)
        bits = 0
        for n in nodes:
            bits |= fold(n.bits, n.power, power)
        high = max(n.high for n in nodes)
        lost = [max(n.lost[j + d] if (d := n.power - power) + j < LEVELS else high for n in nodes) for j in range(LEVELS)]
        return cls(min(n.low for n in nodes), high, power, bits, lost, None, tuple(nodes))

    def may_link(self, other: Node, percent: int) -> bool:
        """Whether some set below one could be linked with some set below the other."""
        if 100 * self.high < percent * other.low or 100 * other.high < percent * self.low:
            return False
        power = min(self.power, other.power)
        a, b = self.power - power, other.power - power
        if a >= LEVELS or b >= LEVELS:
            return True
        common = (fold(self.bits, self.power, power) & fold(other.bits, other.power, power)).bit_count()
        common += min(self.lost[a], other.lost[b])
        # overlap o and sizes n, m are linked when o / (n + m - o) reaches the similarity
        return common * (100 + percent) >= percent * (self.low + other.low)


def build(nodes: list[Node], fanout: int = 6) -> Node:
    """A tree over nodes of neighbouring sizes."""
    nodes = sorted(nodes, key=lambda n: (n.low, n.bits))
    while len(nodes) > 1:
        nodes = [Node.over(nodes[i : i + fanout]) for i in range(0, len(nodes), fanout)]
    return nodes[0]


def walk(tree: Node, percent: int):
    """Pairs of items below a tree that cannot be pruned, by walking the tree against itself."""
    stack = [(tree, tree)]
    while stack:
        a, b = stack.pop()
        if a is b:
            if a.item is None:
                stack += [(x, y) for i, x in enumerate(a.below) for y in a.below[i:]]
            continue
        if not a.may_link(b, percent):
            continue
        if a.item is not None and b.item is not None:
            yield a.item, b.item
        elif b.item is None and (a.item is not None or len(b.below) >= len(a.below)):
            stack += [(a, x) for x in b.below]
        else:
            stack += [(x, b) for x in a.below]


class Union:
    """Components of the few items of one task."""

    def __init__(self):
        self.up: dict = {}

    def find(self, x):
        while (y := self.up.setdefault(x, x)) != x:
            self.up[x] = self.up[y]
            x = y
        return x

    def join(self, x, y) -> bool:
        x, y = self.find(x), self.find(y)
        self.up[max(x, y)] = min(x, y)
        return x != y


def _links(sets: list[dict], percent: int) -> list[tuple[int, int]]:
    """Links that connect the sets of one task; sets of one component are connected from the start."""
    tokens = {s["node"]: np.frombuffer(s["tokens"], np.uint64) for s in sets}
    label = {s["node"]: s["comp"] for s in sets}
    if len(set(label.values())) < 2:
        return []
    known, found = Union(), []
    groups: dict[int, list[Node]] = {}
    for node, t in tokens.items():
        groups.setdefault(label[node], []).append(Node(len(t), len(t), *signature(t), item=node))
    # components are nodes of their own; pairs inside one are met as well, and known already
    for a, b in walk(build([build(g) for g in groups.values()]), percent):
        if known.find(label[a]) == known.find(label[b]):
            continue
        x, y = tokens[a], tokens[b]
        common = len(np.intersect1d(x, y, assume_unique=True))
        if 100 * common >= percent * (len(x) + len(y) - common):
            known.join(label[a], label[b])
            found.append((a, b))
    return found


# ------------------------------------------------------------------ tables


def _frequent(docs: DataFrame, width: int) -> np.ndarray:
    """Shingles that many different sets hold, sorted; only a bounded number of the most frequent."""

    def make(columns: list[list]) -> list[list]:
        seen: dict[int, np.ndarray] = {}
        for tokens in batch_shingles(columns[1], width):
            if len(tokens):
                seen[set_key(tokens)] = tokens
        if not seen:
            return [[], []]
        values, counts = np.unique(np.concatenate([*seen.values()]), return_counts=True)
        often = counts >= OFTEN
        return [values[often].view(np.int64), counts[often]]

    rows = per_batch(text_rows(docs), make, "token bigint, n bigint", TEXTS)
    top = rows.groupBy("token").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "token").limit(FREQUENT).select("token")
    return np.sort(np.array([r[0] for r in top.collect()], np.int64).view(np.uint64))


_SIGNATURE = "power int, bits binary, lost array<bigint>"


def _profiles(docs: DataFrame, width: int, percent: int, frequent: np.ndarray, ident: str) -> DataFrame:
    """(id, node, n, signature..., prefix, cold) of every row; a set that a batch holds again comes without the last five.

    The first ``cold`` shingles of a prefix are not frequent.
    """
    last = docs.sparkSession.sparkContext.broadcast(frequent)

    def make(columns: list[list]) -> list[list]:
        hot = last.value
        seen: set[int] = set()
        out: list[list] = [[] for _ in range(7)]
        for tokens in batch_shingles(columns[1], width):
            n = len(tokens)
            key = set_key(tokens) if n else None
            row = [key, n, None, None, None, None, None]
            if n and key not in seen:
                seen.add(key)
                is_hot = _inside(tokens, hot)
                order = np.argsort(is_hot, kind="stable")[: n - (percent * n + 99) // 100 + 1]
                power, bits, lost = signature(tokens)
                row[2:] = power, bits.to_bytes((1 << power) // 8, "little"), lost, tokens[order].view(np.int64), int((~is_hot[order]).sum())
            for c, x in zip(out, row):
                c.append(x)
        return [columns[0], *out]

    kind = docs.schema[ident].dataType.simpleString()
    return per_batch(text_rows(docs, ident), make, f"id {kind}, node bigint, n bigint, {_SIGNATURE}, prefix array<bigint>, cold int", TEXTS)


def _inside(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Which values are in a sorted table."""
    if not len(table):
        return np.zeros(len(values), bool)
    at = np.searchsorted(table, values)
    at[at == len(table)] = 0
    return table[at] == values


def _sets(docs: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """(node, tokens) of the given sets, each once."""
    slot = F.pmod("node", F.lit(SLOTS))
    words = nodes.groupBy(F.shiftright(slot, 5).cast("int").alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(pmod(node, 32) as int))")).alias("bits")
    )
    table = np.zeros(SLOTS // 32, np.int64)
    for r in words.collect():  # as many rows as the filter has words, whatever the corpus
        table[r["word"]] = r["bits"]
    filled = docs.sparkSession.sparkContext.broadcast(table)

    def make(columns: list[list]) -> list[list]:
        some = filled.value
        out: dict[int, bytes] = {}
        for tokens in batch_shingles(columns[1], width):
            if len(tokens):
                key = set_key(tokens)
                if some[key % SLOTS // 32] >> (key % 32) & 1:
                    out[key] = tokens.tobytes()
        return [list(out), list(out.values())]

    rows = per_batch(text_rows(docs), make, "node bigint, tokens binary", TEXTS)
    return rows.join(nodes, "node", "left_semi").dropDuplicates(["node"])


def meetings(rows: DataFrame, key: str, item: str, size: int = BLOCK) -> DataFrame:
    """(key, i, j, item): blocks of a key's items such that any two items of a key meet in some block pair."""
    sizes = rows.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias("_blocks"), F.count(F.lit(1)).alias("_count"))
    dealt = rows.join(sizes.filter("_count > 1").drop("_count"), key).withColumn("_own", F.pmod(F.xxhash64(item), F.col("_blocks")).cast("int"))
    dealt = dealt.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    return dealt.select(
        *rows.columns, F.least("_own", "_other").alias("i"), F.greatest("_own", "_other").alias("j")
    )


def member_meetings(rows: DataFrame, size: int = BLOCK) -> DataFrame:
    """(cluster, i, j, node, comp): block pairs in which members of different components of a cluster meet.

    A component of more than one block has blocks of its own, which never meet each other; the rest are mixed.
    """
    sizes = rows.groupBy("cluster", "comp").agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias("own"))
    mixed = rows.join(sizes, ["cluster", "comp"])
    few = mixed.filter("own = 1").groupBy("cluster").agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias("mixed"))
    mixed = mixed.join(few, "cluster", "left")
    pure = F.struct(F.col("comp").alias("of"), F.pmod(F.xxhash64("node"), F.col("own")).cast("int").alias("k"))
    shared = F.struct(F.lit(None).cast("bigint").alias("of"), F.pmod(F.xxhash64("comp"), F.col("mixed")).cast("int").alias("k"))
    dealt = mixed.select("cluster", "node", "comp", F.when(F.col("own") > 1, pure).otherwise(shared).alias("block"))
    blocks = dealt.select("cluster", "block").distinct()
    pairs = blocks.withColumnRenamed("block", "i").join(blocks.withColumnRenamed("block", "j"), "cluster").filter(
        "i <= j and (i.of is null or j.of is null or i.of != j.of)"
    )
    first = dealt.join(pairs.withColumn("block", F.col("i")), ["cluster", "block"])
    second = dealt.join(pairs.filter("i != j").withColumn("block", F.col("j")), ["cluster", "block"])
    return first.unionByName(second).select("cluster", "i", "j", "node", "comp")


def _verified(groups: DataFrame, keys: list[str], sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): links among the sets of every group; rows are (keys..., node, comp)."""
    filled = groups.join(sets, "node").groupBy(*keys).agg(F.collect_list(F.struct("node", "comp", "tokens")).alias("sets"))

    def make(columns: list[list]) -> list[list]:
        found = [pair for sets in columns[0] for pair in _links(sets, percent)]
        return [[a for a, _ in found], [b for _, b in found]]

    return per_batch(filled.select("sets"), make, "a bigint, b bigint", 64)


def _unpruned(pairs: DataFrame, signatures: DataFrame, percent: int) -> DataFrame:
    """The pairs (node, anchor) whose signatures leave a link possible."""
    own = signatures.select("node", F.struct("low", "high", "power", "bits", "lost").alias("x"))
    other = signatures.select(F.col("node").alias("anchor"), F.struct("low", "high", "power", "bits", "lost").alias("y"))

    def make(columns: list[list]) -> list[list]:
        keep = [k for k, (x, y) in enumerate(zip(columns[2], columns[3])) if unpack(x).may_link(unpack(y), percent)]
        return [[columns[0][k] for k in keep], [columns[1][k] for k in keep]]

    both = pairs.join(own, "node").join(other, "anchor").select("node", "anchor", "x", "y")
    return per_batch(both, make, "node bigint, anchor bigint")


def _summaries(members: DataFrame, signatures: DataFrame) -> DataFrame:
    """(comp, low, high, signature...): one tree node for every component; those of several sets are combined in two steps."""

    def make(columns: list[list]) -> list[list]:
        nodes = [Node.over([unpack(x) for x in group]) for group in columns[1]]
        return [
            columns[0], [n.low for n in nodes], [n.high for n in nodes], [n.power for n in nodes],
            [n.bits.to_bytes((1 << n.power) // 8, "little") for n in nodes], [n.lost for n in nodes],
        ]

    fields = ["low", "high", "power", "bits", "lost"]
    entry = F.collect_list(F.struct(*fields)).alias("t")
    schema = f"comp bigint, low bigint, high bigint, {_SIGNATURE}"
    several = members.groupBy("comp").count().filter("count > 1").select("comp", F.lit(True).alias("several"))
    filled = members.join(several, "comp", "left").join(signatures, "node")
    parts = filled.filter("several").groupBy("comp", F.pmod("node", F.lit(SALTS)).alias("salt")).agg(entry).select("comp", "t")
    combined = per_batch(per_batch(parts, make, schema).groupBy("comp").agg(entry), make, schema)
    return filled.filter("several is null").select("comp", *fields).unionByName(combined)


def unpack(x: dict, item=None) -> Node:
    return Node(x["low"], x["high"], x["power"], int.from_bytes(x["bits"], "little"), x["lost"], item)


def _walked(groups: DataFrame, summaries: DataFrame, percent: int) -> DataFrame:
    """(cluster, comp): components that survive the walk over some tree, clustered by the pairs that survive."""
    filled = groups.join(summaries, "comp").groupBy("bucket").agg(
        F.collect_list(F.struct("comp", "low", "high", "power", "bits", "lost")).alias("nodes")
    )

    def make(columns: list[list]) -> list[list]:
        clusters = []
        for nodes in columns[0]:
            near, met = Union(), set()
            for a, b in walk(build([unpack(x, x["comp"]) for x in nodes]), percent):
                near.join(a, b)
                met |= {a, b}
            parts: dict[int, list[int]] = {}
            for c in sorted(met):
                parts.setdefault(near.find(c), []).append(c)
            clusters += parts.values()
        return [clusters]

    found = checkpoint(per_batch(filled.select("nodes"), make, "comps array<bigint>", 64).distinct())
    # clusters that share a component are one, so that a set travels to one place
    other = F.explode(F.slice("comps", 2, F.size("comps"))).alias("b")
    return components(found.select(F.element_at("comps", 1).alias("a"), other)).select(F.col("label").alias("cluster"), F.col("node").alias("comp"))


def _by_size(groups: DataFrame, percent: int) -> DataFrame:
    """(bucket, comp): groups of (comp, low, high) cut where sizes are too far apart to link; lone components go."""

    def make(columns: list[list]) -> list[list]:
        out: set[tuple[int, ...]] = set()
        for comps in columns[0]:
            comps.sort(key=lambda c: (c["low"], c["comp"]))
            run, top = [], 0
            for c in [*comps, {"comp": None, "low": float("inf"), "high": 0}]:
                if 100 * top < percent * c["low"]:
                    if len(run) > 1:
                        out.add(tuple(sorted(run)))
                    run, top = [], 0
                run.append(c["comp"])
                top = max(top, c["high"])
        return [[list(x) for x in out]]

    found = per_batch(groups, make, "comps array<bigint>").distinct()
    return found.select(F.xxhash64("comps").alias("bucket"), F.explode("comps").alias("comp"))


def _labels(edges: DataFrame) -> DataFrame:
    return components(edges).select("node", F.col("label").alias("comp"))


def linked_sets(docs: DataFrame, ident: str = "doc_id", text: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """(ident, n_shingles, component_id) of every row; component_id is the smallest id reachable by links.

    Reads the texts three or four times (frequent shingles, profiles, sets that signatures could not prune). Only
    prefixes - a fifth of the shingles - signatures and those sets are shuffled. Nothing is collected but the
    frequent shingles (at most FREQUENT) and filters of SLOTS bits.
    """
    docs = docs.select(F.col(ident), F.col(text).alias("text"))
    rows = docs.withColumnRenamed(ident, "doc_id")
    profiles = checkpoint(_profiles(docs, width, percent, _frequent(rows, width), ident))
    fresh = profiles.filter("prefix is not null")
    index = fresh.select("node", "cold", F.posexplode("prefix").alias("at", "token"))
    salt = F.when(F.col("at") >= F.col("cold"), 1 + F.pmod("node", F.lit(SALTS))).otherwise(0).cast("int")
    over = Window.partitionBy("token", "salt")
    index = index.select("token", salt.alias("salt"), "node")
    index = index.select("token", "salt", "node", F.min("node").over(over).alias("anchor"), F.max("node").over(over).alias("top"))
    # a frequent shingle counts as shared even where one of its parts holds a single set
    shared = checkpoint(index.filter("anchor < top or salt > 0").select("token", "node", "anchor").distinct())
    sizes = checkpoint(fresh.select("node", "n").join(shared.select("node").distinct(), "node", "left_semi").distinct())

    def signatures(nodes: DataFrame) -> DataFrame:
        found = fresh.select("node", F.col("n").alias("low"), F.col("n").alias("high"), "power", "bits", "lost")
        return checkpoint(found.join(nodes, "node", "left_semi").dropDuplicates(["node"]))

    # first round: every set with the one of a fitting size that it shares most of its prefix with
    votes = shared.filter("node != anchor").groupBy("node", "anchor").count()
    votes = votes.join(sizes, "node").join(sizes.select(F.col("node").alias("anchor"), F.col("n").alias("m")), "anchor")
    votes = votes.filter(100 * F.least("n", "m") >= percent * F.greatest("n", "m"))
    best = checkpoint(votes.groupBy("node").agg(F.max_by("anchor", F.struct("count", "anchor")).alias("anchor")))
    both = best.select("node").unionByName(best.select(F.col("anchor").alias("node"))).distinct()
    best = checkpoint(_unpruned(best, signatures(both), percent))
    ends = best.select("node").unionByName(best.select(F.col("anchor").alias("node"))).distinct()
    sets = checkpoint(_sets(rows, ends, width))
    stars = best.withColumn("part", F.pmod(F.xxhash64("node"), F.lit(SALTS)))
    hubs = stars.select("anchor", "part").distinct().withColumn("node", F.col("anchor"))
    stars = stars.unionByName(hubs).withColumn("comp", F.col("node"))
    edges = checkpoint(_verified(stars, ["anchor", "part"], sets, percent))

    # second round: components under a common shingle, first by sizes, then by the trees of those that are left
    members = checkpoint(sizes.join(_labels(edges), "node", "left").select("node", "n", F.coalesce("comp", "node").alias("comp")))
    spans = members.groupBy("comp").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    members = members.drop("n")
    under = shared.select("token", "node").join(members, "node").select("token", "comp").distinct()
    meet = meetings(under, "token", "comp").join(spans, "comp")
    meet = meet.groupBy("token", "i", "j").agg(F.collect_set(F.struct("comp", "low", "high")).alias("comps"))
    buckets = checkpoint(_by_size(meet.filter(F.size("comps") > 1).select("comps"), percent))
    close = checkpoint(members.join(buckets.select("comp").distinct(), "comp", "left_semi"))
    summaries = checkpoint(_summaries(close, signatures(close.select("node"))))
    near = checkpoint(_walked(buckets, summaries, percent))
    face = checkpoint(member_meetings(near.join(members, "comp")))
    missing = checkpoint(face.select("node").distinct().join(sets.select("node"), "node", "left_anti"))
    if not missing.isEmpty():
        sets = sets.unionByName(checkpoint(_sets(rows, missing, width)))
    more = _verified(face, ["cluster", "i", "j"], sets, percent)
    labels = _labels(checkpoint(edges.unionByName(more)))

    named = profiles.select("id", "n", "node").join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    named = checkpoint(named.select("id", "n", "comp"))
    smallest = named.groupBy("comp").agg(F.min("id").alias("least"))
    joined = named.join(smallest, "comp", "left")
    return joined.select(
        F.col("id").alias(ident), F.col("n").alias("n_shingles"),
        F.when(F.col("id").isNotNull(), F.coalesce("least", "id")).alias("component_id"),
    )
