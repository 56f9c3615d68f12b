"""Exact distance joins over blocks: every row has a home cell, visits the cells where partners may be, and a task compares
the rows of a home block with the rows of another block or with visitors.

Three ways to choose homes and visits, all of them exact:

* ``metric_cells``: cells around refined centres, as many as the root of the rows. A row at distance d_h from its own centre
  cannot have a partner within ``radius`` in the cell of centre c if any of these exceeds it: the distance to the plane between the
  two centres, (d_c² - d_h²) / 2|p_c - p_h| (Euclidean), half of d_c - d_h (any metric), or d_c less the cell's own radius.
* ``pigeonhole_cells``: signatures that must match in at least m of n places agree in one of any n - m + 1 places; these are
  the places where the fewest rows agree, each with a grid whose neighbours are visited.
* ``all_blocks``: no bound is known, every block meets every other.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from curaspark.scale import broadcast_if_small
from curaspark.session import checkpoint

# Rows per block of a block join, more where vectors are short: a block holds up to 8 MB of doubles, or 2048 rows.
BLOCK_ROWS = 2048
BLOCK_NUMBERS = 1 << 20
SMALLEST_BLOCK = 256
# Numbers that all centres, and the sample they are refined on, hold at most (32 MB each).
CENTRE_NUMBERS = 1 << 22
# Distances to centres that are held at a time.
DISTANCES = 1 << 21
REFINEMENTS = 3
# Distances are rounded; a bound has to be exceeded by more than this.
SLACK = 1e-6


def rows_of(column: pa.Array) -> np.ndarray:
    """A list column as a matrix of doubles; all vectors must have one length and no missing numbers."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten()
    sizes = column.value_lengths()
    if column.null_count or flat.null_count or len(sizes.unique()) > 1:
        raise ValueError("vectors must have one length and no missing numbers")
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def most_rows(width: int) -> int:
    """Rows of ``width`` numbers that a block holds at most."""
    return max(BLOCK_ROWS, BLOCK_NUMBERS // max(1, width))


def width_of(items: DataFrame) -> int:
    first = items.select("vec").first()
    return len(first["vec"]) if first is not None else 1


def block_size(n: int, block_rows: int | None, width: int) -> int:
    """Rows per block: enough blocks to keep many tasks busy, up to what a task holds."""
    return block_rows or min(most_rows(width), max(SMALLEST_BLOCK, n // 16))


# ------------------------------------------------------------------ cells


def distances(x: np.ndarray, centres: np.ndarray, metric: str) -> np.ndarray:
    if metric == "l1":
        return np.stack([np.abs(x - p).sum(axis=1) / 2.0 for p in centres], axis=1)
    squares = (x**2).sum(1)[:, None] + (centres**2).sum(1)[None, :] - 2 * x @ centres.T
    return np.sqrt(np.maximum(squares, 0.0))


def refined_centres(sample: np.ndarray, k: int, metric: str) -> np.ndarray:
    """k centres moved to the means of their rows a few times, in an order that keeps near ones together."""
    centres = sample[:k].copy()
    for _ in range(REFINEMENTS):
        home = np.concatenate([distances(sample[i : i + 4096], centres, metric).argmin(axis=1) for i in range(0, len(sample), 4096)])
        held = np.bincount(home, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, home, sample)
        centres[held > 0] = sums[held > 0] / held[held > 0, None]
    around = centres - centres.mean(axis=0)
    axis = np.linalg.svd(around, full_matrices=False)[2][0] if k > 1 else np.zeros(centres.shape[1])
    return centres[np.argsort(around @ axis, kind="stable")]


def _chunks(batch: pa.RecordBatch, rows: int) -> Iterator[pa.RecordBatch]:
    for i in range(0, batch.num_rows, rows):
        yield batch.slice(i, rows)


def metric_cells(items: DataFrame, radius: float, metric: str, block_rows: int | None) -> DataFrame:
    """(cls, vec, cell, visits): the block of every row, and the lower-numbered blocks that may hold partners."""
    n, width = items.count(), width_of(items)
    size = block_size(n, block_rows, width)
    if n <= size:
        return all_blocks(items, size)
    k = max(2, min(math.isqrt(n), CENTRE_NUMBERS // width))
    want = min(20 * k, CENTRE_NUMBERS // width)
    # a sample of bounded size: it only steers where cells lie
    picked = items.filter(F.pmod(F.xxhash64("cls"), F.lit(n)) < 2 * want).limit(max(k, want)).select("vec").toArrow().column(0)
    sample = rows_of(picked)
    centres = refined_centres(sample, min(k, len(sample)), metric)
    k = len(centres)
    at_once = max(1, DISTANCES // k)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _chunks(batch, at_once):
                dist = distances(rows_of(part.column(1)), centres, metric)
                home = dist.argmin(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(home.astype(np.int32)), pa.array(dist[np.arange(len(home)), home])], names=["cls", "vec", "cell", "dist"]
                )

    base = T.StructType([items.schema["cls"], items.schema["vec"]])
    assigned = checkpoint(
        items.select("cls", "vec").mapInArrow(assign, T.StructType([*base.fields, T.StructField("cell", T.IntegerType()), T.StructField("dist", T.DoubleType())]))
    )
    held, reach = np.zeros(k, np.int64), np.zeros(k)
    for r in assigned.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("dist").alias("far")).collect():  # one row per centre
        held[r["cell"]], reach[r["cell"]] = r["n"], r["far"]
    # neighbouring cells share a block, large ones are cut into several
    first, parts, starts, filled = np.zeros(k, np.int64), np.ones(k, np.int64), [], size
    for c in range(k):
        parts[c] = max(1, math.ceil(held[c] / size))
        if parts[c] > 1 or filled + held[c] > size:
            first[c] = len(starts)
            starts += [c] * parts[c]
            filled = size if parts[c] > 1 else held[c]
        else:
            first[c] = len(starts) - 1
            filled += held[c]
    between = np.maximum(distances(centres, centres, metric), 1e-12) if k * k <= 8 * CENTRE_NUMBERS else None

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = np.arange(len(starts))
        for batch in batches:
            for part in _chunks(batch, at_once):
                x = rows_of(part.column(1))
                dist = distances(x, centres, metric)
                cell = part.column(2).to_numpy()
                own = dist[np.arange(len(cell)), cell][:, None]
                if metric == "l1":
                    bound = (dist - own) / 2.0
                else:
                    apart = between[cell] if between is not None else np.maximum(distances(centres[cell], centres, metric), 1e-12)
                    bound = (dist**2 - own**2) / (2.0 * apart)
                near = (np.maximum(bound, dist - reach[None, :]) <= radius + SLACK) & (held > 0)[None, :]
                near[np.arange(len(cell)), cell] = True
                block = first[cell] + part.column(3).to_numpy() % parts[cell]
                visits = np.logical_or.reduceat(near, starts, axis=1) & (every[None, :] < block[:, None])
                rows, found = np.nonzero(visits)
                offsets = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=len(cell)))])
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(found, pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(block, pa.int64()), lists], names=["cls", "vec", "cell", "visits"])

    salted = assigned.select("cls", "vec", "cell", F.pmod(F.xxhash64("cls", F.lit(7)), F.lit(1 << 30)).alias("salt"))
    return salted.mapInArrow(visit, _placed(items))


def _placed(items: DataFrame) -> T.StructType:
    return T.StructType(
        [items.schema["cls"], items.schema["vec"], T.StructField("cell", T.LongType()), T.StructField("visits", T.ArrayType(T.LongType()))]
    )


def all_blocks(items: DataFrame, size: int) -> DataFrame:
    """Blocks by hash, each visiting all lower-numbered ones."""
    blocks = max(1, math.ceil(items.count() / size))
    placed = items.select("cls", "vec", F.pmod(F.xxhash64("cls", F.lit(7)), F.lit(blocks)).alias("cell"))
    visits = F.when(F.col("cell") > 0, F.sequence(F.lit(0).cast("bigint"), F.col("cell") - 1)).otherwise(F.array().cast("array<bigint>"))
    return placed.withColumn("visits", visits)


#: Bits of one coordinate of a grid cell; coordinates beyond are taken to the border, which keeps neighbours neighbours.
GRID_BITS = 13
_AROUND = [(a, b, c) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1) if (a, b, c) < (0, 0, 0)]


def _grid(points: np.ndarray, width: float) -> np.ndarray:
    """Grid coordinates of 3-d points, never negative."""
    half = 1 << (GRID_BITS - 1)
    return (np.clip(np.floor(np.nan_to_num(points) / width), 1 - half, half - 2) + half).astype(np.int64)


def _token(layer: int, grid: np.ndarray) -> np.ndarray:
    return (((layer << GRID_BITS | grid[..., 0]) << GRID_BITS | grid[..., 1]) << GRID_BITS) | grid[..., 2]


def pigeonhole_cells(items: DataFrame, width: float, matches: int) -> tuple[DataFrame, list[int]]:
    """(cls, vec, cell, visits) rows and the indexed places, for signatures of 3-d points of which at least ``matches`` have to
    lie closer than ``width`` to the other one's. A cell stands for (number of the place, grid cell)."""
    first = items.first()
    places = len(first["vec"]) // 3 if first is not None else 0
    layers = max(0, places - matches + 1)
    vec_field = items.schema["vec"]

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _chunks(batch, 4096):
                x = rows_of(part.column(0))[:, : places * 3].reshape(-1, places, 3)
                grid = _grid(x, width)
                for p in range(places):
                    found, n = np.unique(_token(p, grid[:, p]), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), p, np.int32)), pa.array(found), pa.array(n.astype(np.int64))], names=["p", "token", "n"])

    if layers == 0:
        return items.select("cls", "vec", F.lit(0).cast("bigint").alias("cell"), F.array().cast("array<bigint>").alias("visits")).limit(0), []
    counted = items.select("vec").mapInArrow(tokens, "p int, token bigint, n bigint").groupBy("p", "token").agg(F.sum("n").cast("double").alias("n"))
    # pairs that agree by a place, as far as the grid tells; one row per place
    crowded = counted.groupBy("p").agg(F.sum(F.col("n") * F.col("n")).alias("pairs")).orderBy("pairs", "p").limit(layers).collect()
    chosen = [r["p"] for r in crowded]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _chunks(batch, max(1, 65_536 // (14 * len(chosen)))):
                x = rows_of(part.column(1))[:, : places * 3].reshape(-1, places, 3)
                grid = _grid(x[:, chosen], width)
                cells = np.stack([_token(layer, grid[:, layer]) for layer in range(len(chosen))], axis=1)
                visits = np.stack([np.stack([_token(layer, grid[:, layer] + np.array(d)) for d in _AROUND], axis=1) for layer in range(len(chosen))], axis=1)
                n = len(x)
                inner = pa.ListArray.from_arrays(pa.array(np.arange(0, n * len(chosen) * 13 + 1, 13), pa.int32()), pa.array(visits.ravel()))
                each = pa.StructArray.from_arrays([pa.array(cells.ravel()), inner], ["cell", "visits"])
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, n * len(chosen) + 1, len(chosen)), pa.int32()), each)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), lists], names=["cls", "vec", "places"])

    kinds = T.StructType([items.schema["cls"], vec_field, T.StructField("places", T._parse_datatype_string("array<struct<cell: bigint, visits: array<bigint>>>"))])
    placed = items.select("cls", "vec").mapInArrow(place, kinds)
    return placed.select("cls", "vec", F.explode("places").alias("p")).select("cls", "vec", "p.cell", "p.visits"), chosen


# ------------------------------------------------------------------ the join

Found = tuple[np.ndarray, np.ndarray, np.ndarray]
#: (a, b, cell) to row numbers of both sides and scores, some rows of ``a`` at a time: the rows of ``a`` ascend, and those of ``b``
#: ascend for each of them
Kernel = Callable[[np.ndarray, np.ndarray, int], Iterator[Found]]


def work(placed: DataFrame) -> DataFrame:
    """(cell, homes, visitors): rows of every cell and rows that visit it."""
    homes = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("homes"))
    visitors = placed.select(F.explode("visits").alias("cell")).groupBy("cell").agg(F.count(F.lit(1)).alias("visitors"))
    return homes.join(visitors, "cell", "left").select("cell", "homes", F.coalesce("visitors", F.lit(0).cast("bigint")).alias("visitors"))


def compared_pairs(sizes: DataFrame) -> int:
    """Pairs of rows that a join with this ``work`` compares."""
    pairs = F.col("homes") * F.col("visitors") + F.floor(F.col("homes") * (F.col("homes") - 1) / 2)
    return int(sizes.agg(F.sum(pairs)).first()[0] or 0)


def _tasks(placed: DataFrame, sizes: DataFrame, block_rows: int) -> DataFrame:
    """Rows for the tasks of a block join: (cls, vec, home, blk) by (cell, inside, x, y). Cells of any size are cut into blocks of
    ``block_rows``; a task handles two blocks, or one and its own pairs."""
    blocks = sizes.select(
        "cell", F.ceil(F.col("homes") / block_rows).cast("int").alias("nh"), F.ceil(F.col("visitors") / block_rows).cast("int").alias("nv")
    )
    rows = placed.select("cls", "vec", "cell", F.lit(True).alias("home")).unionByName(
        placed.select("cls", "vec", F.explode("visits").alias("cell"), F.lit(False).alias("home"))
    )
    own = F.when(F.col("home"), F.col("nh")).otherwise(F.col("nv"))
    # a visited cell without rows of its own has no work
    dealt = rows.join(broadcast_if_small(blocks), "cell").withColumn("blk", F.pmod(F.xxhash64("cls", F.lit(23)), own.cast("long")).cast("int"))

    def span(n: str) -> Column:
        return F.when(F.col(n) > 0, F.sequence(F.lit(0), F.col(n) - 1)).otherwise(F.array().cast("array<int>"))

    def task(same: bool, x: Column, y: Column) -> Column:
        return F.struct(F.lit(same).alias("inside"), x.alias("x"), y.alias("y"))

    home_tasks = F.concat(
        F.transform(span("nh"), lambda t: task(True, F.least(F.col("blk"), t), F.greatest(F.col("blk"), t))),
        F.transform(span("nv"), lambda t: task(False, F.col("blk"), t)),
    )
    visit_tasks = F.transform(span("nh"), lambda t: task(False, t, F.col("blk")))
    return dealt.withColumn("_t", F.explode(F.when(F.col("home"), home_tasks).otherwise(visit_tasks))).select(
        "cls", "vec", "home", "blk", "cell", "_t.inside", "_t.x", "_t.y"
    )


def _found(kernel: Kernel, key: tuple, table: pa.Table) -> Iterator[tuple[pa.Array, pa.Array, Iterator[Found]]]:
    """The names of the two sides of a task and what the kernel finds, rows of one block only once."""
    cell, inside, x, y = (k.as_py() for k in key)
    home, blk = table.column("home").to_numpy(), table.column("blk").to_numpy()
    left, right = (blk == x, blk == y) if inside else (home, ~home)
    one, two = (table.filter(pa.array(side)).select(["cls", "vec"]) for side in (left, right))
    if not one.num_rows or not two.num_rows:
        return
    a, b = rows_of(one.column("vec")), rows_of(two.column("vec"))

    def parts() -> Iterator[Found]:
        for rows, cols, scores in kernel(a, b, cell):
            if inside and x == y:
                keep = rows < cols
                rows, cols, scores = rows[keep], cols[keep], scores[keep]
            yield rows, cols, scores

    yield one.column("cls").combine_chunks(), two.column("cls").combine_chunks(), parts()


def visit_join(placed: DataFrame, sizes: DataFrame, kernel: Kernel, block_rows: int) -> DataFrame:
    """(c, d, score), c < d, of the pairs that ``kernel`` finds among rows of one cell and between rows and their visitors."""
    ident = placed.schema["cls"].dataType
    out = T.StructType([T.StructField("c", ident), T.StructField("d", ident), T.StructField("score", T.DoubleType())])
    names = to_arrow_schema(out)

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for one, two, parts in _found(kernel, key, pa.Table.from_batches(list(batches))):
            yield from _pair_batches(one, two, parts, names)

    return _tasks(placed, sizes, block_rows).groupBy("cell", "inside", "x", "y").applyInArrow(run, out)


def packed(rows: DataFrame, blocks: int, order: bool = True) -> DataFrame:
    """One row for each block of rows (cls, vec, cell, blk, visits): the names, in order if asked, the vectors as one matrix, the cells
    that some of the rows visit and a bit for each of these and each row."""
    names = T.StructField("names", T.ArrayType(rows.schema["cls"].dataType))
    out = T.StructType([*T._parse_datatype_string("cell bigint, blk int, width int, visited array<bigint>, seen binary, vec binary").fields, names])
    arrow = to_arrow_schema(out)

    def pack(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        if order:
            table = table.sort_by("cls")
        table = table.combine_chunks()
        vecs, visits = rows_of(table.column("vec")), table.column("visits").combine_chunks()
        visited, place = np.unique(visits.flatten().to_numpy(zero_copy_only=False), return_inverse=True)
        seen = np.zeros((len(visited), len(vecs)), bool)
        seen[place, np.repeat(np.arange(len(vecs)), visits.value_lengths().to_numpy(zero_copy_only=False))] = True
        cls = table.column("cls").combine_chunks()
        held = pa.ListArray.from_arrays(pa.array([0, len(cls)], pa.int32()), cls).cast(arrow.field("names").type)
        columns = [[key[0].as_py()], [key[1].as_py()], [vecs.shape[1]], [visited.astype(np.int64)], [np.packbits(seen, axis=1).tobytes()], [vecs.tobytes()]]
        yield pa.RecordBatch.from_arrays([*[pa.array(c, t) for c, t in zip(columns, arrow.types)], held], schema=arrow)

    # as many partitions as blocks: the files of one block each are dealt to tasks as they are read
    dealt = rows.select("cls", "vec", "cell", "blk", "visits").repartition(blocks, "cell", "blk")
    return checkpoint(dealt.groupBy("cell", "blk").applyInArrow(pack, out))


def met(left: DataFrame, right: DataFrame, on: Callable[[Callable[[str], Column]], Column] | None = None) -> DataFrame:
    """Packed blocks side by side, the columns of the right ones marked by an underscore. The stored blocks are read by every task
    that needs them, so vectors are not sent anew for every block that they meet."""
    other = right.select(*[F.col(c).alias(f"_{c}") for c in ("cell", "blk", "width", "vec", "names")]).hint("shuffle_replicate_nl")
    return left.crossJoin(other) if on is None else left.join(other, on(F.col))


def matrix_of(batch: pa.RecordBatch, i: int, mark: str = "") -> tuple[pa.Array, np.ndarray]:
    """Names and vectors of a packed block."""
    names = batch.column(f"{mark}names")[i].values
    return names, np.frombuffer(batch.column(f"{mark}vec")[i].as_buffer(), np.float64).reshape(len(names), batch.column(f"{mark}width")[i].as_py())


def _block_pairs(placed: DataFrame, sizes: DataFrame, block_rows: int) -> DataFrame:
    """Packed blocks of cells that are blocks: those of one cell, and those with visitors of another one."""
    counts = checkpoint(sizes.select("cell", F.ceil(F.col("homes") / block_rows).cast("int").alias("nh")))
    blocks = max(1, counts.agg(F.sum("nh")).first()[0] or 0)
    dealt = placed.join(broadcast_if_small(counts), "cell").withColumn("blk", F.pmod(F.xxhash64("cls", F.lit(23)), F.col("nh").cast("long")).cast("int"))
    packs = packed(dealt, blocks)
    return met(
        packs, packs, lambda c: ((c("cell") == c("_cell")) & (c("blk") <= c("_blk"))) | ((c("cell") != c("_cell")) & F.array_contains("visited", c("_cell")))
    )


def _met(kernel: Kernel, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, pa.Array, Iterator[Found]]]:
    """The names of both sides of every pair of blocks, those that visit the other block's cell only, and what the kernel finds."""
    for batch in batches:
        for i in range(batch.num_rows):
            cell, other, blk, blk2 = (batch.column(n)[i].as_py() for n in ("cell", "_cell", "blk", "_blk"))
            (one, a), (two, b) = matrix_of(batch, i), matrix_of(batch, i, "_")
            same = cell == other and blk == blk2
            if cell != other:
                at = batch.column("visited")[i].as_py().index(other)
                each = -(-len(one) // 8)
                bits = np.frombuffer(batch.column("seen")[i].as_buffer(), np.uint8, each, at * each)
                some = np.unpackbits(bits, count=len(one)).astype(bool)
                one, a = one.filter(pa.array(some)), a[some]

            def parts(a=a, b=b, cell=cell, same=same) -> Iterator[Found]:
                for rows, cols, scores in kernel(a, b, cell):
                    if same:
                        keep = rows < cols
                        rows, cols, scores = rows[keep], cols[keep], scores[keep]
                    yield rows, cols, scores

            if len(one) and len(two):
                yield one, two, parts()


def _pair_batches(one: pa.Array, two: pa.Array, parts: Iterator[Found], names: pa.Schema) -> Iterator[pa.RecordBatch]:
    left, right = (side.to_pandas().to_numpy() for side in (one, two))
    # a task may find most of its pairs: they leave in parts
    for rows, cols, scores in parts:
        c, d = left[rows], right[cols]
        swap = c > d
        yield pa.RecordBatch.from_arrays([pa.array(np.where(swap, d, c), names.types[0]), pa.array(np.where(swap, c, d), names.types[0]), pa.array(scores, pa.float64())], schema=names)


def block_join(placed: DataFrame, sizes: DataFrame, kernel: Kernel, block_rows: int) -> DataFrame:
    """``visit_join`` for cells that are blocks, each as large as a task holds."""
    ident = placed.schema["cls"].dataType
    out = T.StructType([T.StructField("c", ident), T.StructField("d", ident), T.StructField("score", T.DoubleType())])
    names = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for one, two, parts in _met(kernel, batches):
            yield from _pair_batches(one, two, parts, names)

    return _block_pairs(placed, sizes, block_rows).mapInArrow(run, out)


def nearest_join(placed: DataFrame, sizes: DataFrame, kernel: Kernel, block_rows: int) -> DataFrame:
    """(pos, hit, score, up): for rows named by numbers (``cls``), the largest smaller and the smallest larger (``up``) one among those
    that ``kernel`` pairs them with. Every task reduces its pairs, so no table ever holds a row for each pair."""
    out = "pos bigint, hit bigint, score double, up boolean"
    names = pa.schema([("pos", pa.int64()), ("hit", pa.int64()), ("score", pa.float64()), ("up", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for one, two, parts in _met(kernel, batches):
            left, right = one.to_numpy(), two.to_numpy()
            best = [_Best(left, right, low) for low in (True, False)]
            for rows, cols, scores in parts:
                below = right[cols] < left[rows]
                for b, which in zip(best, (below, ~below)):
                    b.take(rows[which], cols[which], scores[which])
            for b in best:
                for pos, hit, score, up in b.rows():
                    yield pa.RecordBatch.from_arrays([pa.array(pos), pa.array(hit), pa.array(score), pa.array(np.full(len(pos), up))], schema=names)

    found = _block_pairs(placed, sizes, block_rows).mapInArrow(run, out)
    sign = F.when(F.col("up"), -1).otherwise(1)
    nearest = found.groupBy("pos", "up").agg(F.max(F.struct((F.col("hit") * sign).alias("at"), "score")).alias("m"))
    return nearest.select("pos", (F.col("m.at") * sign).alias("hit"), "m.score", "up")


class _Best:
    """Of pairs (row of one side, row of the other), both in ascending order: the nearest partner of every row, where the partners
    of the left rows are all smaller (``low``) or all larger."""

    def __init__(self, left: np.ndarray, right: np.ndarray, low: bool):
        self.names, self.low = (left, right), low
        self.hit = [np.full(len(left), -1), np.full(len(right), -1)]
        self.score = [np.zeros(len(left)), np.zeros(len(right))]

    def take(self, rows: np.ndarray, cols: np.ndarray, scores: np.ndarray) -> None:
        if not len(rows):
            return
        # smaller partners of left rows: the last one counts, and for their right rows, whose partners are larger, the first one
        edge = np.flatnonzero(rows[1:] != rows[:-1])
        ends = np.append(edge, len(rows) - 1) if self.low else np.append(0, edge + 1)
        if not self.low:
            ends = ends[self.hit[0][rows[ends]] < 0]  # a row may go on from the part before
        self.hit[0][rows[ends]], self.score[0][rows[ends]] = cols[ends], scores[ends]
        if self.low:
            fresh = self.hit[1][cols] < 0
            rows, cols, scores = rows[fresh][::-1], cols[fresh][::-1], scores[fresh][::-1]
        # of equal places the last one written stays
        self.hit[1][cols] = rows
        self.score[1][cols] = scores

    def rows(self) -> Iterator[tuple]:
        for side in (0, 1):
            held = np.flatnonzero(self.hit[side] >= 0)
            yield self.names[side][held], self.names[1 - side][self.hit[side][held]], self.score[side][held], self.low == (side == 1)


# ------------------------------------------------------------------ kernels


def dot_kernel(threshold: float) -> Kernel:
    """Dot products, rounded to 9 places, above the threshold."""

    def kernel(a: np.ndarray, b: np.ndarray, _: int):
        step = max(1, DISTANCES // len(b))
        for i in range(0, len(a), step):
            products = a[i : i + step] @ b.T
            rows, cols = np.nonzero(products > threshold - 1e-8)
            scores = np.round(products[rows, cols], 9)
            keep = scores > threshold
            yield rows[keep] + i, cols[keep], scores[keep]

    return kernel


def l1_kernel(threshold: float) -> Kernel:
    """Half L1 distances, rounded to 9 places, up to the threshold; sums of neighbouring slots give a lower bound first."""

    def kernel(a: np.ndarray, b: np.ndarray, _: int):
        starts = np.arange(0, a.shape[1], max(1, a.shape[1] // 8))
        coarse_a, coarse_b = np.add.reduceat(a, starts, axis=1), np.add.reduceat(b, starts, axis=1)
        for i in range(0, len(a), 64):
            low = np.zeros((len(coarse_a[i : i + 64]), len(b)))
            for s in range(len(starts)):
                low += np.abs(coarse_a[i : i + 64, s, None] - coarse_b[None, :, s])
            rows, cols = np.nonzero(low / 2.0 <= threshold + 1e-8)
            for j in range(0, len(rows), 8192):
                r, c = rows[j : j + 8192] + i, cols[j : j + 8192]
                scores = np.round(np.abs(a[r] - b[c]).sum(axis=1) / 2.0, 9)
                keep = scores <= threshold
                yield r[keep], c[keep], scores[keep]

    return kernel


def _leveled(points: np.ndarray, sign: float) -> tuple[np.ndarray, float]:
    """Per place the rows (-2 p, |p|², 1) or, for the other side, (p, 1, |p|²), whose products are squared distances; and the largest
    |p|². Places with numbers that are not finite give no number, so they are close to nothing."""
    points = np.where(np.isfinite(points), points, np.nan)
    squares = (points**2).sum(axis=2, keepdims=True)
    one = np.ones_like(squares)
    rows = np.concatenate([-2.0 * points, squares, one] if sign < 0 else [points, one, squares], axis=2)
    return rows.transpose(1, 0, 2), float(np.nanmax(squares, initial=0.0))


def color_kernel(limit: float, matches: int, linked: int, chosen: Sequence[int] | None) -> Kernel:
    """Sums of truncated differences of signatures with at least ``matches`` places closer than the limit, ``linked`` of them
    behind another such place. A pair that meets in several of the ``chosen`` places counts in the first one only.

    Products in short numbers, with room for their rounding, rule most pairs out; the others are looked at in full.
    """
    closer = math.ceil(limit)

    def kernel(a: np.ndarray, b: np.ndarray, cell: int):
        places = a.shape[1] // 3
        layer = cell >> (3 * GRID_BITS) if chosen is not None else 0
        earlier = list(chosen[:layer]) if chosen is not None else []
        left, right = a[:, : places * 3].reshape(len(a), places, 3), b[:, : places * 3].reshape(len(b), places, 3)
        (one, most), (two, most2) = _leveled(left, -1.0), _leveled(right, 1.0)
        kind = np.float32 if most + most2 < 1e30 else np.float64
        one, two = one.astype(kind), np.ascontiguousarray(two.transpose(0, 2, 1).astype(kind))
        room = kind(closer * closer + 1e-5 * (closer * closer + most + most2))
        every = matches >= places > linked  # no place may fail, so nothing has to be counted
        for i in range(0, len(a), 64):
            part = left[i : i + 64]
            may = np.ones((len(part), len(b)), bool)
            hits = np.zeros((len(part), len(b)), np.int8 if places < 128 else np.int16)
            links = np.zeros_like(hits)
            before = None
            for p in range(places):
                hit = one[p, i : i + 64] @ two[p] < room
                if every:
                    may &= hit
                    continue
                hits += hit
                if before is not None:
                    links += hit & before
                before = hit
            rows, cols = np.nonzero(may if every else (hits >= matches) & (links >= linked))
            for j in range(0, len(rows), 8192):
                r, c = rows[j : j + 8192], cols[j : j + 8192]
                apart = right[c] - part[r]
                apart = np.sqrt(apart[:, :, 0] ** 2 + apart[:, :, 1] ** 2 + apart[:, :, 2] ** 2)
                near = apart < closer
                keep = (near.sum(axis=1) >= matches) & ((near[:, 1:] & near[:, :-1]).sum(axis=1) >= linked) & ~near[:, earlier].any(axis=1)
                yield r[keep] + i, c[keep], apart[keep].astype(np.int64).sum(axis=1).astype(float)

    return kernel
