"""Mixing sources to target weights through a multivariate-hypergeometric splitting tree.

Targets are filled like water: sources share all words by weight, none gets more than ``most`` times its own size,
and what is left over is shared again. A source is cut into blocks by a hash of its rows; each pass over a source
draws its blocks in a permuted order until the target is met; of the last block, and then of what is left of the
source, single rows are taken while they fit. A splitting tree
deals the drawn blocks out: every node draws, without replacement, how many blocks of each source go to its left
half of the output shards, down to single shards. A shard takes the next blocks of each source's permuted order, so
shards are disjoint, and shuffles its rows locally.

All choices are hashes or seeded draws: reruns agree. Null sources form the last source. Null and empty texts have size
0; they come with their blocks. Repeated rows are mixed like any others. An empty table gives an empty mix.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from curaspark.llm.common import per_batch
from curaspark.scale import broadcast_if_small, group_index, range_width, row_index
from curaspark.session import checkpoint

#: Weights of the sources in code-point order, repeating, and how often a source's words may be taken.
WEIGHTS, MOST = (5, 2, 1), 3
#: Words of a block and of an output shard.
BLOCK_WORDS, SHARD_WORDS = 20_000, 2_000_000
SEED = 11


def sized(docs: DataFrame, ident: str, source: str, text: str) -> DataFrame:
    """(ident, source, size, u): words of every text, and the hash that deals the row to a block."""
    rows = docs.select(F.col(ident), F.col(source), F.col(text).cast("binary"))

    def make(columns: list[list]) -> list[list]:
        return [columns[0], columns[1], [len(t.split()) if t else 0 for t in columns[2]]]

    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    out = per_batch(rows, make, f"ident {kinds[ident]}, source {kinds[source]}, size bigint")
    return out.withColumn("u", F.xxhash64("ident", "source", "size", F.lit(SEED)))


def fill_level(sources: DataFrame, most: float) -> float:
    """The level L at which the targets least(most * size, L * weight) sum up to all words."""
    ratio = F.col("source_size") * most / F.col("weight")
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    level, capped = 0.0, None
    while True:
        open_ = ratio > level if capped is not None else F.lit(True)
        r = sources.agg(
            F.sum(F.when(open_, F.col("weight"))).alias("w"),
            F.sum(F.when(~open_, F.col("source_size") * most)).alias("full"),
            F.count(F.when(~open_, 1)).alias("n"),
        ).first()
        if capped == r["n"] or not r["w"]:
            return level
        level, capped = (total - (r["full"] or 0)) / r["w"], r["n"]


def targets(rows: DataFrame, weights: tuple = WEIGHTS, most: float = MOST) -> DataFrame:
    """(source, idx, source_size, target), one row per source."""
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = row_index(sources, [F.col("source").asc_nulls_last()])
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("idx") % len(weights) + 1).cast("int"))
    ranked = checkpoint(ranked.withColumn("weight", weight))
    level = fill_level(ranked, most)
    target = F.least(F.col("source_size") * F.lit(float(most)), F.col("weight") * F.lit(float(level)))
    return ranked.withColumn("target", target).drop("weight")


def drawn_blocks(rows: DataFrame) -> DataFrame:
    """(idx, block, seq, part): the draws of every source in order; part is null for a whole block, else the words wanted of it.

    ``rows``: (idx, block, size, source_size, target). A source may have any number of blocks: they are numbered by a
    range sort, and words are added up range by range, so only one row for each range of a source meets in one task.
    """
    blocks = rows.groupBy("idx", "block").agg(F.sum("size").alias("words"), F.first("source_size").alias("all"), F.first("target").alias("target"))
    full = F.when(F.col("all") > 0, F.floor(F.col("target") / F.col("all"))).otherwise(0)
    blocks = blocks.withColumn("full", full).withColumn("pass", F.explode(F.sequence(F.lit(0), F.col("full"))))
    blocks = blocks.withColumn("permuted", F.xxhash64("idx", "pass", "block", F.lit(SEED)))
    numbered = checkpoint(group_index(blocks, ["idx"], [F.col("pass"), F.col("permuted"), F.col("block")], "seq"))
    width = range_width(numbered.count())
    numbered = numbered.withColumn("range", F.floor(F.col("seq") / width))
    ranges = numbered.groupBy("idx", "range").agg(F.sum("words").alias("sum"))
    earlier = Window.partitionBy("idx").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    carried = ranges.select("idx", "range", F.coalesce(F.sum("sum").over(earlier), F.lit(0)).alias("carried"))
    inside = Window.partitionBy("idx", "range").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("carried") + F.coalesce(F.sum("words").over(inside), F.lit(0))
    # what is wanted of a block in the last pass: the target without all blocks before it, those of the full passes too
    blocks = numbered.join(carried, ["idx", "range"]).withColumn("before", before)
    blocks = blocks.withColumn("left", F.when(F.col("pass") < F.col("full"), F.col("words")).otherwise(F.col("target") - F.col("before")))
    drawn = blocks.filter("left > 0 or pass < full").withColumn("part", F.when(F.col("left") < F.col("words"), F.col("left")))
    return drawn.select("idx", "block", "pass", "seq", "part")


def split_path(quotas: np.ndarray, shard: int, shards: int, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """(first block, number of blocks) of every source for one shard: a walk from the root of the tree to its leaf.

    A node over ``m`` shards gives its left half the share of blocks that its shards make up; which sources they come
    from is one multivariate-hypergeometric draw, seeded by the node, so all shards below see the same draw.
    """
    low, high, start = 0, shards, np.zeros_like(quotas)
    while high - low > 1:
        middle = (low + high) // 2
        total = int(quotas.sum())
        left_total = total * (middle - low) // (high - low)
        draw = np.random.default_rng([seed, low, high]).multivariate_hypergeometric(quotas, left_total, method="marginals")
        if shard < middle:
            quotas, high = draw, middle
        else:
            start, quotas, low = start + draw, quotas - draw, middle
    return start, quotas


def dealt(drawn: DataFrame, shards: int) -> DataFrame:
    """(idx, seq, shard): the shard of every drawn block, by the splitting tree."""
    quotas = drawn.groupBy("idx").count().agg(F.sort_array(F.collect_list(F.struct("idx", F.col("count").alias("n")))).alias("quotas"))
    # one row with a number for each source goes to every shard's walk
    walks = drawn.sparkSession.range(shards).join(F.broadcast(quotas)).select("id", "quotas")

    def make(columns: list[list]) -> list[list]:
        out: list[list] = [[], [], [], []]
        for shard, quotas in zip(*columns):
            if not quotas:
                continue
            start, count = split_path(np.array([q["n"] for q in quotas], np.int64), shard, shards)
            for q, s, n in zip(quotas, start, count):
                if n:
                    for c, x in zip(out, (q["idx"], shard, int(s), int(n))):
                        c.append(x)
        return out

    runs = per_batch(walks, make, "idx bigint, shard bigint, start bigint, n bigint")
    return runs.select("idx", "shard", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("n") - 1)).alias("seq"))


def _cut_rows(rows: DataFrame, drawn: DataFrame) -> DataFrame:
    """(idx, block, pass, u): the rows that complete the last pass over each source.

    In the order of their hashes the rows of the block drawn in part are taken where they fit; those that do not are
    passed over. What is then still wanted comes from all rows the pass has not drawn, long ones first, until no row
    fits, and last from the shortest row if that is nearer to the target. Rows alike go together. Rows meet by block
    (one block per source), else only numbers for every size are gathered.
    """
    keys = ["idx", "block", "pass"]
    cut = drawn.filter("part is not null").select(*keys, "part")
    some = rows.join(broadcast_if_small(cut), ["idx", "block"]).groupBy(*keys, "u").agg(F.sum("size").alias("size"), F.first("part").alias("part"))
    filled = some.filter("size > 0").groupBy(keys).agg(F.first("part").alias("part"), F.sort_array(F.collect_list(F.struct("u", "size"))).alias("r"))

    def fit(columns: list[list]) -> list[list]:
        taken, left = [], []
        for part, block in zip(columns[3], columns[4]):
            taken.append([])
            for r in block:
                if r["size"] <= part:
                    part -= r["size"]
                    taken[-1].append(r["u"])
            left.append(part)
        return [*columns[:3], taken, left]

    chosen = checkpoint(per_batch(filled, fit, f"{_kinds(filled, keys)}, us array<bigint>, left double"))
    inside = chosen.select(*keys, F.explode("us").alias("u"))
    empty = some.filter("size = 0").select(*keys, "u")

    # what the pass has not drawn yet; rows longer than twice what is wanted bring no total nearer to the target
    rest = broadcast_if_small(chosen.filter("left > 0").select("idx", "pass", "left"))
    whole = drawn.filter("part is null").select("idx", "block", "pass")
    other = rows.filter("size > 0").join(rest, "idx").groupBy(*keys, "u", "left").agg(F.sum("size").alias("size")).filter("size < 2 * left")
    other = checkpoint(other.join(whole, keys, "left_anti").join(inside, [*keys, "u"], "left_anti"))
    sizes = other.groupBy("idx", "left", "size").count().groupBy("idx", "left").agg(F.sort_array(F.collect_list(F.struct("size", "count")), False).alias("s"))

    def complete(columns: list[list]) -> list[list]:
        out: list[list] = [[], [], []]
        for idx, left, known in zip(*columns):
            wanted, spare = {}, None
            for x in known:
                n = min(x["count"], int(left // x["size"]))
                left -= n * x["size"]
                wanted[x["size"]] = n
                spare = x["size"] if n < x["count"] else spare
            if spare is not None and spare < 2 * left:
                wanted[spare] += 1
            for size, n in wanted.items():
                if n:
                    for c, x in zip(out, (idx, size, n)):
                        c.append(x)
        return out

    wanted = checkpoint(per_batch(sizes, complete, f"{_kinds(sizes, ['idx'])}, size bigint, wanted bigint"))
    counts = other.join(wanted, ["idx", "size"]).groupBy(*keys, "size", "wanted").count()
    order = Window.partitionBy("idx", "size").orderBy(F.xxhash64("idx", "pass", "block", F.lit(SEED)), "block")
    before = F.coalesce(F.sum("count").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    quotas = counts.withColumn("quota", F.col("wanted") - before).filter("quota > 0").select(*keys, "size", "quota")
    rank = F.row_number().over(Window.partitionBy(*keys, "size").orderBy("u"))
    more = other.join(quotas, [*keys, "size"]).withColumn("rank", rank).filter("rank <= quota").select(*keys, "u")
    return inside.unionByName(empty).unionByName(more)


def _kinds(rows: DataFrame, names: list[str]) -> str:
    return ", ".join(f"{n} {rows.schema[n].dataType.simpleString()}" for n in names)


class Mix:
    """The plan of a mix: slim rows, targets, and the draws with their shards."""

    def __init__(self, docs: DataFrame, ident: str = "doc_id", source: str = "source", text: str = "text",
                 weights: tuple = WEIGHTS, most: float = MOST, block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS):
        rows = checkpoint(sized(docs, ident, source, text))
        sources = checkpoint(targets(rows, weights, most))
        known = sources.withColumnRenamed("source", "_s")
        rows = rows.join(broadcast_if_small(known), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
        blocks = F.greatest(F.lit(1), F.ceil(F.col("source_size") / block_words))
        self.rows = rows.withColumn("block", F.pmod("u", blocks))
        drawn = checkpoint(drawn_blocks(self.rows))
        total = sources.agg(F.sum("target")).first()[0] or 0
        self.shards = max(1, int(-(-total // shard_words)))
        draws = checkpoint(drawn.join(dealt(drawn, self.shards), ["idx", "seq"]))
        self.whole = draws.filter("part is null").select("idx", "block", "pass", "shard")
        # one block per source is drawn in part; the rows that complete its pass go to that block's shard
        part = draws.filter("part is not null").select("idx", "pass", "shard")
        self.cut = checkpoint(_cut_rows(self.rows, drawn).join(part, ["idx", "pass"]))

    def taken(self) -> DataFrame:
        """(ident, size, source_size, target, taken): the words that the mix takes of every row."""
        whole = self.whole.groupBy("idx", "block").agg(F.count(F.lit(1)).alias("whole"))
        cut = self.cut.groupBy("idx", "block", "u").agg(F.count(F.lit(1)).alias("once"))
        marked = self.rows.join(whole, ["idx", "block"], "left").join(cut, ["idx", "block", "u"], "left")
        times = F.coalesce("whole", F.lit(0)) + F.coalesce("once", F.lit(0))
        return marked.select("ident", "size", "source_size", "target", (F.col("size") * times).alias("taken"))

    def chosen(self) -> DataFrame:
        """(ident, u, pass, shard): every draw of a row; rows alike share their draws."""
        rows = self.rows.select("ident", "idx", "block", "u").distinct()
        columns = ["ident", "u", "pass", "shard"]
        return rows.join(self.whole, ["idx", "block"]).select(columns).unionByName(
            rows.join(self.cut, ["idx", "block", "u"]).select(columns)
        )


def mix_table(docs: DataFrame, ident: str = "doc_id", source: str = "source", text: str = "text", **more) -> DataFrame:
    """(ident, size, source_size, target, taken) of every row."""
    return Mix(docs, ident, source, text, **more).taken().withColumnRenamed("ident", ident)


def mixed(docs: DataFrame, ident: str = "doc_id", source: str = "source", text: str = "text", **more) -> DataFrame:
    """The mix itself: the columns of ``docs``, each row as often as it is drawn, shard by shard, shuffled within a shard."""
    plan = Mix(docs, ident, source, text, **more)
    words = F.size(F.filter(F.split(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")).cast("bigint")
    columns = docs.columns
    named = docs.select(F.struct(*columns).alias("_row"), F.col(ident).alias("_i"), F.xxhash64(ident, source, words, F.lit(SEED)).alias("_u"))
    out = named.join(plan.chosen(), F.col("_i").eqNullSafe(F.col("ident")) & (F.col("_u") == F.col("u")))
    out = out.withColumn("_place", F.xxhash64("u", "pass", F.lit(SEED)))
    n = min(plan.shards, 10_000)
    return out.repartition(n, "shard").sortWithinPartitions("shard", "_place").select("_row.*")
