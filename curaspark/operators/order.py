"""Sort orders, positions, closest matches and the find cascade."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curaspark.functions import paths as P
from curaspark.scale import row_index

# Columns a media table may carry: path, ctime, mtime, size, width, height, origin.


def sort_keys(by: str, path: str = "path") -> list[Column]:
    """Sort columns of one browser order (ascending, without the final tie-break)."""
    low = F.lower(F.col(path))
    table = {
        "full_path": [low],
        "name": [P.natural_key(P.basename(path))],
        "ctime": [F.col("ctime")] if by == "ctime" else [],
        "mtime": [F.col("mtime")] if by == "mtime" else [],
        "type": [P.ext(path), low],
        "size": [F.col("size"), low] if by == "size" else [],
        "name_length": [F.length(P.basename(path)), low],
        "pixels": [F.col("width") * F.col("height"), low] if by == "pixels" else [],
        "height": [F.col("height"), low] if by == "height" else [],
        "width": [F.col("width"), low] if by == "width" else [],
        "related": [F.col("origin"), P.basename(path)] if by == "related" else [],
        "suffix": [P.variant_tail(path), P.basename(path), F.col(path)],
        "random": [F.xxhash64(F.col(path))],
    }
    if by not in table:
        raise ValueError(f"unknown sort order {by!r}")
    return table[by]


def _directed(keys: list[Column], desc: bool) -> list[Column]:
    return [k.desc() if desc else k.asc() for k in keys]


def sort_media(df: DataFrame, by: str = "name", desc: bool = False, path: str = "path") -> DataFrame:
    """Rows in a browser order (a range-partitioned sort)."""
    return df.orderBy(*_directed(sort_keys(by, path), desc), F.col(path))


def sort_for_run(df: DataFrame, by: str | None = None, desc: bool = False, path: str = "path") -> DataFrame:
    """Batch-run order; no order leaves the rows as they are."""
    return df if by is None else sort_media(df, by, desc, path)


def positions(df: DataFrame, by: str = "name", desc: bool = False, path: str = "path", name: str = "pos") -> DataFrame:
    """0-based display position of every row."""
    return row_index(df, _directed(sort_keys(by, path), desc) + [F.col(path).asc()], name)


def shuffle(df: DataFrame, seed: int, path: str = "path") -> DataFrame:
    """Reproducible random order: by a digest of path and seed, which any engine can repeat."""
    return df.orderBy(F.md5(F.concat_ws(":", F.col(path), F.lit(str(seed)))), F.col(path))


def sample_one(df: DataFrame, seed: int, path: str = "path") -> DataFrame:
    """One reproducible random row: a top-1, not a sort."""
    return shuffle(df, seed, path).limit(1)


def cap(df: DataFrame, n: int, path: str = "path") -> DataFrame:
    """First ``n`` rows in path order."""
    return df.orderBy(F.col(path)).limit(n)


def top_k(df: DataFrame, k: int = 50, score: str = "score", tie: str = "id", desc: bool = True) -> DataFrame:
    """Best ``k`` rows by score (distances ascending)."""
    return df.orderBy(F.col(score).desc() if desc else F.col(score).asc(), F.col(tie)).limit(k)


def within_threshold(df: DataFrame, threshold: float, score: str = "score", lower: bool = False) -> DataFrame:
    return df.filter(F.col(score) <= threshold if lower else F.col(score) > threshold)


def nth(positioned: DataFrame, n: int, pos: str = "pos") -> DataFrame:
    """The n-th row, counted from 1."""
    if n < 1:
        raise ValueError("index must be 1 or greater")
    return positioned.filter(F.col(pos) == n - 1)


def select_series(positioned: DataFrame, first: Column, last: Column, pos: str = "pos") -> DataFrame:
    """Rows between two rows in display order, ends included, in either direction."""
    ends = positioned.filter(first | last).agg(F.min(pos).alias("_lo"), F.max(pos).alias("_hi"), F.count(F.lit(1)).alias("_n"))
    bound = ends.first()  # one row
    if not bound or bound["_n"] == 0:
        return positioned.limit(0)
    return positioned.filter(F.col(pos).between(bound["_lo"], bound["_hi"]))


def closest(positioned: DataFrame, value, by: Column, pos: str = "pos", path: str = "path") -> DataFrame:
    """Row whose value is nearest to ``value``; the first in display order wins a tie."""
    gap = F.abs(by - F.lit(value))
    best = positioned.filter(by.isNotNull()).agg(F.min(F.struct(gap.alias("gap"), F.col(pos), F.col(path))).alias("b"))
    return best.filter("b is not null").select(F.col(f"b.{path}").alias(path), F.col(f"b.{pos}").alias(pos), F.col("b.gap").alias("gap"))


def first_at_or_after(positioned: DataFrame, key: Column, target: Column, pos: str = "pos", path: str = "path") -> DataFrame:
    """First row in display order whose key is at least ``target`` (closest by name or by origin)."""
    best = positioned.filter(key >= target).agg(F.min(F.struct(F.col(pos), F.col(path))).alias("b"))
    return best.filter("b is not null").select(F.col(f"b.{path}").alias(path), F.col(f"b.{pos}").alias(pos))


def closest_by_name(positioned: DataFrame, text: str, **kw) -> DataFrame:
    return first_at_or_after(
        positioned, P.natural_key(P.basename(kw.get("path", "path"))), P.natural_key(P.basename(F.lit(text))), **kw
    )


def first_equal(positioned: DataFrame, key: Column, target: Column, pos: str = "pos", path: str = "path") -> DataFrame:
    """First row in display order with an equal key (closest by type or by suffix)."""
    best = positioned.filter(key == target).agg(F.min(F.struct(F.col(pos), F.col(path))).alias("b"))
    return best.filter("b is not null").select(F.col(f"b.{path}").alias(path), F.col(f"b.{pos}").alias(pos))


def find(positioned: DataFrame, text: str, exact: bool = False, pos: str = "pos", path: str = "path") -> DataFrame:
    """Find cascade in one pass: path, basename, name prefix, name substring; best stage, then position."""
    name = P.basename(path)
    low = F.lower(name)
    stage = F.when(F.col(path) == text, 1).when(name == text, 2)
    if not exact:
        stage = stage.when(F.startswith(low, F.lit(text.lower())), 3).when(F.contains(low, F.lit(text.lower())), 4)
    best = positioned.withColumn("stage", stage).filter("stage is not null").agg(
        F.min(F.struct(F.col("stage"), F.col(pos), F.col(path))).alias("b")
    )
    return best.filter("b is not null").select(
        F.col(f"b.{path}").alias(path), F.col(f"b.{pos}").alias(pos), F.col("b.stage").alias("stage")
    )


def ranked_stage(path_col, text: str) -> Column:
    """Text-filter pass of a path: 1 name equals, 2 name prefix, 3 parent prefix, 4 ' x' or '_x' inside."""
    p = F.regexp_replace(F.col(path_col) if isinstance(path_col, str) else path_col, r"/+$", "")
    low, t = F.lower(P.basename(p)), text.strip().lower()
    parent = F.lower(P.basename(P.dirname(p)))
    return (
        F.when(low == t, 1)
        .when(F.startswith(low, F.lit(t)), 2)
        .when((parent != "") & F.startswith(parent, F.lit(t)), 3)
        .when(F.contains(low, F.lit(" " + t)) | F.contains(low, F.lit("_" + t)), 4)
    )


def ranked_filter(df: DataFrame, path_col: str, text: str, pos: str = "pos") -> DataFrame:
    """Rows passing any text-filter pass, with the pass number; order is (stage, pos)."""
    return df.withColumn("stage", ranked_stage(path_col, text)).filter("stage is not null").orderBy("stage", pos)
