"""Sinks and stores: purge, result checkpoints, reports, notes, snapshots."""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curaspark.functions import paths as P
from curaspark.operators.agg import set_id

# Gates of the stale-feature purge.
PURGE_FACTOR = 2.0
PURGE_FLOOR = 100


def purge_stale(store: DataFrame, media: DataFrame, found: int | None = None, last_clean: int | None = None, key: str = "path") -> DataFrame:
    """Drop features whose file is gone, when the store looks inflated.

    Kept as it is while it is at most max(100, 2·found) rows, or when it has not grown since the last clean run.
    """
    size = store.count()
    n = media.count() if found is None else found
    inflated = size > max(PURGE_FLOOR, PURGE_FACTOR * n)
    if not inflated or (last_clean is not None and size <= last_clean):
        return store
    return store.join(media.select(key).distinct(), key, "left_semi")


def save_result(result: DataFrame, inputs: DataFrame, folder: str) -> str:
    """Write a result with the fingerprint of its input list; returns the fingerprint."""
    mark = set_id(inputs).first()["set_id"]
    result.write.mode("overwrite").parquet(f"{folder}/result")
    spark = result.sparkSession
    spark.createDataFrame([(mark,)], "fingerprint string").coalesce(1).write.mode("overwrite").json(f"{folder}/inputs")
    return mark


def load_result(spark: SparkSession, inputs: DataFrame, folder: str, key: str = "path") -> DataFrame | None:
    """Saved result when the input list is the same and every row belongs to it, else None."""
    try:
        saved = spark.read.schema("fingerprint string").json(f"{folder}/inputs").first()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None  # no such result
    if saved is None or saved["fingerprint"] != set_id(inputs).first()["set_id"]:
        return None
    result = spark.read.parquet(f"{folder}/result")
    foreign = result.join(inputs.select(F.col("path").alias(key)), key, "left_anti")
    return result if foreign.isEmpty() else None


def snapshot(df: DataFrame, folder: str, version: int) -> str:
    path = f"{folder}/v={version}"
    df.write.mode("overwrite").parquet(path)
    return path


def restore(spark: SparkSession, folder: str, version: int) -> DataFrame:
    return spark.read.parquet(f"{folder}/v={version}")


def write_report(stats: DataFrame, messages: DataFrame, folder: str) -> None:
    """Run report: totals and grouped messages as JSON tables."""
    stats.write.mode("overwrite").json(f"{folder}/stats")
    messages.write.mode("overwrite").json(f"{folder}/messages")


# ------------------------------------------------------------------ notes and marks


def export_marks(marks: DataFrame, folder: str, as_text: bool = True) -> None:
    """Marked files as text (basenames) or JSON (paths)."""
    if as_text:
        marks.select(P.basename("path").alias("value")).write.mode("overwrite").text(folder)
    else:
        marks.select("path").write.mode("overwrite").json(folder)


def import_marks(media: DataFrame, names: DataFrame, by: str = "basename") -> DataFrame:
    """Match listed names to media: (name, n_found, path). Names without a match keep a null path."""
    key = P.basename("path") if by == "basename" else F.col("path")
    known = media.groupBy(key.alias("name")).agg(F.count(F.lit(1)).alias("n_found"), F.min("path").alias("path"))
    return names.select("name").distinct().join(known, "name", "left").select(
        "name", F.coalesce("n_found", F.lit(0)).alias("n_found"), "path"
    )


def import_summary(matched: DataFrame) -> DataFrame:
    """(n_added, n_missing) of an import."""
    return matched.agg(
        F.sum((F.col("n_found") > 0).cast("bigint")).alias("n_added"), F.sum((F.col("n_found") == 0).cast("bigint")).alias("n_missing")
    )


def config_json(obj) -> str:
    """Stable JSON text of a configuration object with ``to_dict``."""
    return json.dumps(obj.to_dict(), sort_keys=True)
