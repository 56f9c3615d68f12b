"""A table of query vectors against a table of item vectors: blocked matrix products with a reduction per block.

Few queries travel to the items, which are not moved; many are cut into blocks like the items, blocks are stored once, and a task
reads and multiplies blocks of each. Either way a task reduces its products at once (best items per query, best query per item, smallest score), so that no
table ever holds a row for every item and query.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from curaspark.operators.blocks import BLOCK_ROWS, DISTANCES, Kernel, matrix_of, met, most_rows, packed, rows_of

# Queries that travel to the items: at most so many, and at most so many numbers (32 MB).
FEW_QUERIES = 2048
FEW_NUMBERS = 1 << 22

#: (ids, items, keys, queries) of one block to the columns of the result
Reduce = Callable[[pa.Array, np.ndarray, pa.Array, np.ndarray], list]


def _one(column) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def blocked(items: DataFrame, queries: DataFrame, reduce: Reduce, schema: T.StructType, block_rows: int | None = None, few: int = FEW_QUERIES) -> DataFrame:
    """Results of ``reduce`` over all blocks of items (id, vec) and queries (key, vec), some queries at a time; rows without a vector
    take no part."""
    items = items.select("id", "vec").filter("vec is not null")
    queries = queries.select("key", "vec").filter("vec is not null")
    arrow = to_arrow_schema(schema)

    def table_of(columns: list) -> pa.Table:
        return pa.Table.from_arrays([c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

    def reduced(ids: pa.Array, x: np.ndarray, keys: pa.Array, asked: np.ndarray) -> Iterator[pa.RecordBatch]:
        step = max(1, DISTANCES // len(x))
        for j in range(0, len(asked), step):
            yield from table_of(reduce(ids, x, keys.slice(j, step), asked[j : j + step])).to_batches()

    n_queries = queries.count()
    first = queries.first()
    if n_queries <= few and (first is None or n_queries * len(first["vec"]) <= FEW_NUMBERS):
        if first is None:
            return items.sparkSession.createDataFrame([], schema)
        held = queries.toArrow()  # a bounded number of rows
        keys, asked = _one(held.column("key")), rows_of(held.column("vec"))

        def against(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(0, batch.num_rows, block_rows or BLOCK_ROWS):
                    part = batch.slice(i, block_rows or BLOCK_ROWS)
                    yield from reduced(part.column(0), rows_of(part.column(1)), keys, asked)

        return items.mapInArrow(against, schema)

    n_items = items.count()
    # large blocks travel fewer times, several are needed to keep many tasks busy
    most = most_rows(len(first["vec"]))
    blocks = [max(1, math.ceil(n / (block_rows or min(most, max(BLOCK_ROWS, n // 16))))) for n in (n_items, n_queries)]

    def packs(rows: DataFrame, name: str, n: int) -> DataFrame:
        cell = F.pmod(F.xxhash64(name, F.lit(3)), F.lit(n))
        placed = rows.select(F.col(name).alias("cls"), "vec", cell.alias("cell"), F.lit(0).alias("blk"), F.array().cast("array<bigint>").alias("visits"))
        return packed(placed, n, order=False)

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield from reduced(*matrix_of(batch, i), *matrix_of(batch, i, "_"))

    return met(packs(items, "id", blocks[0]), packs(queries, "key", blocks[1])).mapInArrow(pair, schema)


def _schema(items: DataFrame, queries: DataFrame, *names: str) -> T.StructType:
    kinds = {"id": items.schema["id"].dataType, "key": queries.schema["key"].dataType}
    return T.StructType([T.StructField(n, kinds.get(n, T.DoubleType())) for n in names])


def matches(items: DataFrame, queries: DataFrame, threshold: float, **how) -> DataFrame:
    """(key, id, score) of all dot products above ``threshold``, rounded to 9 places."""

    def reduce(ids, x, keys, q):
        rows, cols = np.nonzero((products := q @ x.T) > threshold - 1e-8)
        scores = np.round(products[rows, cols], 9)
        keep = scores > threshold
        return [keys.take(pa.array(rows[keep])), ids.take(pa.array(cols[keep])), scores[keep]]

    return blocked(items, queries, reduce, _schema(items, queries, "key", "id", "score"), **how)


def found_pairs(items: DataFrame, queries: DataFrame, kernel: Kernel, **how) -> DataFrame:
    """(key, id, score) of all pairs that ``kernel`` finds."""

    def reduce(ids, x, keys, q):
        rows, cols, scores = (np.concatenate(c) for c in zip((np.zeros(0, int), np.zeros(0, int), np.zeros(0)), *kernel(q, x, 0)))
        return [keys.take(pa.array(rows)), ids.take(pa.array(cols)), scores]

    return blocked(items, queries, reduce, _schema(items, queries, "key", "id", "score"), **how)


def seek(items: DataFrame, queries: DataFrame, kernel: Kernel, up: bool, sign: float = 1.0, **how) -> DataFrame:
    """(key, hit, score): of the items (pos, mark, vec) that ``kernel`` pairs with a query (key, edge, ban, bound, vec) the nearest one
    below ``edge``, or above it (``up``), whose mark is not ``ban`` and whose score times ``sign`` less ``bound`` is above ``least``."""

    def reduce(ids, x, keys, q):
        pos, mark = (ids.field(n).to_numpy(zero_copy_only=False) for n in range(2))
        edge, ban, bound, least = (keys.field(n).to_numpy(zero_copy_only=False) for n in range(1, 5))
        order = np.argsort(pos, kind="stable")
        pos, mark, x = pos[order], mark[order], x[order]
        hit, score = np.full(len(q), -1), np.zeros(len(q))
        for rows, cols, scores in kernel(q, x, 0):
            side = pos[cols] > edge[rows] if up else pos[cols] < edge[rows]
            keep = side & (mark[cols] != ban[rows]) & (scores * sign - bound[rows] > least[rows])
            if up:
                keep &= hit[rows] < 0
            rows, cols, scores = rows[keep], cols[keep], scores[keep]
            if up:
                rows, cols, scores = rows[::-1], cols[::-1], scores[::-1]
            # of equal places the last one written stays
            hit[rows], score[rows] = cols, scores
        held = np.flatnonzero(hit >= 0)
        return [keys.field(0).to_numpy(zero_copy_only=False)[held], pos[hit[held]], score[held]]

    rows = items.select(F.struct("pos", "mark").alias("id"), "vec")
    asked = queries.select(F.struct("key", "edge", "ban", "bound", "least").alias("key"), "vec")
    schema = T.StructType([T.StructField("key", queries.schema["key"].dataType), T.StructField("hit", T.LongType()), T.StructField("score", T.DoubleType())])
    found = blocked(rows, asked, reduce, schema, **how)
    way = -1 if up else 1
    return found.groupBy("key").agg(F.max(F.struct((F.col("hit") * way).alias("at"), "score")).alias("m")).select(
        "key", (F.col("m.at") * way).alias("hit"), "m.score"
    )


def top_matches(items: DataFrame, queries: DataFrame, k: int, **how) -> DataFrame:
    """(key, id, score) of the ``k`` items with the largest dot product for every query, ties to the smaller id."""

    def reduce(ids, x, keys, q):
        scores = np.round(q @ x.T, 9)
        if scores.shape[1] > k:
            border = np.partition(scores, -k, axis=1)[:, -k][:, None]
            rows, cols = np.nonzero(scores >= border)  # ties at the border stay until ids decide
        else:
            rows, cols = np.nonzero(np.ones(scores.shape, bool))
        return [keys.take(pa.array(rows)), ids.take(pa.array(cols)), scores[rows, cols]]

    found = blocked(items, queries, reduce, _schema(items, queries, "key", "id", "score"), **how)
    order = Window.partitionBy("key").orderBy(F.desc("score"), "id")
    return found.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= k).drop("_r")


def lowest_scores(items: DataFrame, queries: DataFrame, **how) -> DataFrame:
    """(key, low): the smallest dot product of every query with any item."""

    def reduce(ids, x, keys, q):
        return [keys, (q @ x.T).min(axis=1)]

    return blocked(items, queries, reduce, _schema(items, queries, "key", "low"), **how).groupBy("key").agg(F.min("low").alias("low"))


def best_queries(items: DataFrame, queries: DataFrame, **how) -> DataFrame:
    """(id, key, score): for every item the query with the largest dot product, ties to the smaller key."""

    def reduce(ids, x, keys, q):
        order = np.argsort(keys.to_pandas().to_numpy(), kind="stable")
        scores = x @ q[order].T
        best = scores.argmax(axis=1)
        return [ids, keys.take(pa.array(order[best])), scores[np.arange(len(best)), best]]

    found = blocked(items, queries, reduce, _schema(items, queries, "id", "key", "score"), **how)
    # the smallest (-score, key) is the best one
    best = found.groupBy("id").agg(F.min(F.struct((-F.col("score")).alias("down"), "key")).alias("b"))
    return best.select("id", "b.key", (-F.col("b.down")).alias("score"))
