"""Sources: directory listings, file lists, multi-root gathering and feature stores."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from curaspark.functions import paths as P

# Default still-image extensions.
IMAGE_EXTENSIONS = (".jpg", ".jpeg", ".png", ".tiff", ".bmp", ".webp")


def extensions(images: Sequence[str] = IMAGE_EXTENSIONS, videos: bool = False, gifs: bool = False, pdfs: bool = False) -> list[str]:
    out = list(images)
    if videos:
        out += P.VIDEO_EXTENSIONS
    if gifs:
        out.append(".gif")
    if pdfs:
        out.append(".pdf")
    return out


def scan_media(spark: SparkSession, directory: str, exts: Sequence[str] | None = None, recursive: bool = True,
               videos: bool = False, gifs: bool = False, pdfs: bool = False) -> DataFrame:
    """List media files: (path, base_dir, size, mtime). File contents are never read."""
    wanted = list(exts) if exts is not None else extensions(videos=videos, gifs=gifs, pdfs=pdfs)
    listed = (
        spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(directory)
        .select(F.regexp_replace("path", "^file:(//)?", "").alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))
    )
    return has_extension(listed, wanted).withColumn("base_dir", F.lit(directory))


def has_extension(df: DataFrame, exts: Sequence[str], path: str = "path") -> DataFrame:
    return df.filter(F.lower(P.ext(path)).isin(*[e.lower() for e in exts]))


def scan_filtered(df: DataFrame, text: str | None, mode: str = "glob", path: str = "path") -> DataFrame:
    return df.filter(P.scan_filter(path, text, mode))


def from_file_list(spark: SparkSession, json_path: str) -> DataFrame:
    """Explicit file list: JSON arrays of paths in text files."""
    raw = spark.read.text(json_path, wholetext=True)
    return raw.select(F.explode(F.from_json("value", "array<string>")).alias("path"))


def gather(roots: dict[str, DataFrame]) -> DataFrame:
    """Union of several roots that keeps the root as ``base_dir``."""
    out = None
    for root, df in roots.items():
        part = df.withColumn("base_dir", F.lit(root))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def gather_sorted(media: DataFrame, prefs: DataFrame, path: str = "path") -> DataFrame:
    """Order every root by its own preference: ``prefs`` has (base_dir, sort_by, descending).

    Orders: name, full_path, ctime, mtime, type, size, name_length, related, random, pixels, height, width and suffix;
    those that need a column (ctime, related, width, height …) need it in ``media``. One numeric and one text key
    express them all, so the whole gathering is a single range sort. An order that is not known raises when it is
    met. Adds the dense position ``pos``.
    """
    from curaspark.scale import broadcast_if_small, row_index

    joined = media.join(broadcast_if_small(prefs), "base_dir", "left")  # one row per root
    by = F.coalesce("sort_by", F.lit("name"))
    known = set(media.columns)

    def micros(name: str) -> Column:
        return F.unix_micros(F.col(name).cast("timestamp")).cast("double")

    numbers = {"name_length": F.length(P.basename(path)).cast("double"), "random": F.rand(7)}
    numbers |= {n: F.col(n).cast("double") for n in ("size", "width", "height") if n in known}
    numbers |= {n: micros(n) for n in ("ctime", "mtime") if n in known}
    if {"width", "height"} <= known:
        numbers["pixels"] = F.col("width").cast("double") * F.col("height")
    texts = {
        "name": P.natural_key(P.basename(path)), "full_path": F.lower(F.col(path)), "path": F.lower(F.col(path)),
        "type": F.lower(P.ext(path)), "suffix": F.lower(P.variant_tail(path)),
    }
    if "related" in known:
        texts["related"] = F.lower(F.col("related"))
    number, text = F.lit(None).cast("double"), F.lower(F.col(path))
    for name, value in numbers.items():
        number = F.when(by == name, value).otherwise(number)
    for name, value in texts.items():
        text = F.when(by == name, value).otherwise(text)
    unknown = ~by.isin(*numbers, *texts)
    number = F.when(unknown, F.raise_error(F.concat(F.lit("no such order: "), by)).cast("double")).otherwise(number)
    sign = F.when(F.coalesce("descending", F.lit(False)), -1.0).otherwise(1.0)
    down = F.coalesce("descending", F.lit(False))
    keyed = joined.withColumn("_n", number * sign).withColumn("_up", F.when(~down, text)).withColumn("_down", F.when(down, text))
    order = [F.col("base_dir"), F.col("_n").asc_nulls_first(), F.col("_up").asc_nulls_first(), F.col("_down").desc_nulls_last(), F.col(path)]
    return row_index(keyed, order, "pos").drop("_n", "_up", "_down")


def profiles(media: DataFrame, prefs: DataFrame, key: str = "directory", max_rows: int = 100_000) -> DataFrame:
    """Attach per-directory preferences; the small side is broadcast only after its size is checked."""
    from curaspark.scale import broadcast_if_small

    return media.join(broadcast_if_small(prefs, max_rows), key, "left")


def reference_first(df: DataFrame, test: Column, reference: DataFrame) -> DataFrame:
    """Filtered rows plus the search reference, which stays in any case and is flagged."""
    kept = df.filter(test)
    others = kept.join(reference.select("path"), "path", "left_anti").withColumn("is_reference", F.lit(False))
    return others.unionByName(reference.withColumn("is_reference", F.lit(True)), allowMissingColumns=True)


def ensure_features(media: DataFrame, store: DataFrame, extractor: Callable[[DataFrame], DataFrame], key: str = "path") -> DataFrame:
    """Stored features of the media plus freshly extracted ones for those without; ``is_new`` marks the latter."""
    known = store.join(media.select(key), key, "left_semi").withColumn("is_new", F.lit(False))
    missing = extractor(media.join(store.select(key), key, "left_anti")).withColumn("is_new", F.lit(True))
    return known.unionByName(missing)


def frames(items: DataFrame, key: str, slots: Column) -> DataFrame:
    """One row per frame slot of an item."""
    return items.select("*", F.explode(F.sequence(F.lit(0), slots - 1)).alias("slot")).filter(F.col(key).isNotNull())
