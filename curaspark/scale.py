"""Building blocks that keep global orders, group orders and as-of lookups distributed.

A plain ``Window.orderBy`` without a partition key moves every row to one task, and a window
over a hot key moves that whole key to one task. The helpers here split both.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curaspark.session import checkpoint

# A hot key is split into at least RANGES ranges, and into more where a range would hold more than RANGE_ROWS positions.
RANGES = 256
RANGE_ROWS = 1_000_000


def range_width(positions: int) -> int:
    """Positions of one range when ``positions`` are split."""
    return max(1, min(-(-int(positions) // RANGES), RANGE_ROWS))


def row_index(df: DataFrame, order: Sequence[Column], name: str = "idx") -> DataFrame:
    """Add the dense 0-based position of every row in ``order`` (which must be a total order).

    Rows are range-partitioned and sorted; the sorted layout is checkpointed so that the
    partition sizes and the positions come from one and the same layout.
    """
    laid = df.repartitionByRange(*order).sortWithinPartitions(*order)
    laid = laid.withColumn("_mid", F.monotonically_increasing_id())
    laid = checkpoint(laid)
    part = F.shiftright("_mid", 33)
    sizes = laid.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    # one row per non-empty shuffle partition, so the window is bounded by the partition count
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return (
        laid.withColumn("_part", part)
        .join(F.broadcast(starts), "_part")
        .withColumn(name, F.col("_start") + F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1)))
        .drop("_mid", "_part", "_start")
    )


def group_index(df: DataFrame, key: Sequence[str], order: Sequence[Column], name: str = "pos") -> DataFrame:
    """0-based position of every row inside its ``key`` group, without a window over the key.

    Position in the global (key, order) sequence minus the first position of the group; a group
    of any size stays spread over many partitions.
    """
    ranked = row_index(df, [F.col(k) for k in key] + list(order), "_g")
    marks = [f"_key{n}" for n in range(len(key))]
    starts = ranked.groupBy(*[F.col(k).alias(m) for k, m in zip(key, marks)]).agg(F.min("_g").alias("_g0"))
    on = F.lit(True)
    for k, m in zip(key, marks):
        on = on & F.col(k).eqNullSafe(F.col(m))
    joined = ranked.join(starts, on)
    return joined.select(*df.columns, (F.col("_g") - F.col("_g0")).alias(name))


def asof(data: DataFrame, queries: DataFrame, key: str, pos: str, span: int, forward: bool = False) -> DataFrame:
    """For each query row the nearest ``data`` position strictly before (after) it within its key.

    ``data`` has (key, pos); ``queries`` has (key, pos, payload...). Returns the query rows with
    ``hit``. ``span`` is the number of positions; every key is cut into ranges of bounded length and
    the last position of earlier ranges is carried over through a small per-range summary.
    """
    width = range_width(span)
    order = F.col(pos).desc() if forward else F.col(pos).asc()
    rng = F.floor(F.col(pos) / F.lit(width))
    marked = data.select(key, pos).withColumn("_data", F.lit(1)).withColumn("_rng", rng)
    asked = queries.withColumn("_data", F.lit(0)).withColumn("_rng", rng)
    both = asked.unionByName(marked, allowMissingColumns=True)
    # queries sort before data at the same position, so an item never finds itself
    inside = Window.partitionBy(key, "_rng").orderBy(order, F.col("_data").asc()).rowsBetween(
        Window.unboundedPreceding, -1
    )
    own = F.last(F.when(F.col("_data") == 1, F.col(pos)), ignorenulls=True).over(inside)
    local = both.withColumn("_own", own).filter(F.col("_data") == 0)
    edge = F.min(pos) if forward else F.max(pos)
    ends = marked.groupBy(key, "_rng").agg(edge.alias("_end"))
    rng_order = F.col("_rng").desc() if forward else F.col("_rng").asc()
    # one data row and one query row for each range of a key
    keys = asked.select(key, "_rng").distinct().join(ends, [key, "_rng"], "full")
    across = Window.partitionBy(key).orderBy(rng_order).rowsBetween(Window.unboundedPreceding, -1)
    carried = keys.select(key, "_rng", F.last("_end", ignorenulls=True).over(across).alias("_carry"))
    return (
        local.join(carried, [key, "_rng"], "left")
        .withColumn("hit", F.coalesce("_own", "_carry"))
        .drop("_own", "_carry", "_rng", "_data")
    )


def chase_parents(parents: DataFrame, hops: int = 3) -> DataFrame:
    """Resolve (node, parent) pointers to (node, root) by repeated pointer jumping.

    Roots point at themselves and pointers never form another cycle. A round follows every open
    pointer ``hops`` times, so rounds are logarithmic in the longest chain; nodes that reached
    their root leave the loop, and a round joins only the open rows.
    """
    current = checkpoint(parents.withColumn("_done", F.col("node") == F.col("parent")))
    while True:
        pending = current.filter(~F.col("_done"))
        if pending.isEmpty():
            return current.select("node", F.col("parent").alias("root"))
        target = current.select(
            F.col("node").alias("_t"), F.col("parent").alias("_tp"), F.col("_done").alias("_td")
        )
        moved = pending
        for _ in range(hops):
            moved = moved.join(target, F.col("parent") == F.col("_t")).select(
                "node", F.col("_tp").alias("parent"), F.col("_td").alias("_done")
            )
        current = checkpoint(current.filter("_done").unionByName(moved))


def broadcast_if_small(df: DataFrame, max_rows: int = 100_000) -> DataFrame:
    """Mark ``df`` for broadcast only after checking that it has at most ``max_rows`` rows."""
    if df.limit(max_rows + 1).count() <= max_rows:
        return F.broadcast(df)
    return df


def hold(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column that is computed once per row.

    A plain column is copied into every expression and pushed-down filter that uses it, which
    multiplies the cost of an expensive one; the optimizer keeps a generated column as it is.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))


def spread(df: DataFrame, key: str) -> DataFrame:
    """Hash rows over at least as many partitions as there are cores, before costly work per row.

    A few large files would otherwise bind that work to a few tasks; the explicit number also keeps
    adaptive execution from merging the partitions again because they are small in bytes.
    """
    spark = df.sparkSession
    n = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(n, key)
