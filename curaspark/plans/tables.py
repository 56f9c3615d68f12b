"""Input tables of the registered queries and the media tables derived from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def media(spark: SparkSession, folder: str) -> DataFrame:
    """One file per part, four variants per stem, spread over three directories:
    (id, path, related_path, width, height, size)."""
    part = table(spark, folder, "part")
    key = F.col("p_partkey")
    stem = F.concat(F.lit("img"), F.lpad(F.floor(key / 4).cast("string"), 9, "0"))
    suffix = (
        F.when(key % 4 == 0, "").when(key % 4 == 1, "_edit")
        .when(key % 4 == 2, F.concat(F.lit("_"), F.lower(F.substring("p_type", 1, 4)))).otherwise("_2")
    )
    directory = F.when(F.col("p_size") % 3 == 0, "work").when(F.col("p_size") % 3 == 1, "pool").otherwise("target")
    return part.select(
        key.alias("id"),
        F.concat(F.lit("/lib/"), directory, F.lit("/"), stem, suffix, F.lit(".png")).alias("path"),
        F.when((key % 5 != 0) & (key % 4 != 0), F.concat(F.lit("/lib/pool/"), stem, F.lit(".png"))).alias("related_path"),
        (F.col("p_size") * 40).cast("bigint").alias("width"),
        F.floor("p_retailprice").cast("bigint").alias("height"),
        F.length("p_name").cast("bigint").alias("size"),
    )


MEDIA_SQL = """media AS (
  SELECT p_partkey AS id,
    '/lib/' || CASE p_size % 3 WHEN 0 THEN 'work' WHEN 1 THEN 'pool' ELSE 'target' END || '/img'
      || lpad(CAST(p_partkey // 4 AS VARCHAR), 9, '0')
      || CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN '_edit' WHEN 2 THEN '_' || lower(substr(p_type, 1, 4)) ELSE '_2' END
      || '.png' AS path,
    CASE WHEN p_partkey % 5 <> 0 AND p_partkey % 4 <> 0
      THEN '/lib/pool/img' || lpad(CAST(p_partkey // 4 AS VARCHAR), 9, '0') || '.png' END AS related_path,
    CAST(p_size * 40 AS BIGINT) AS width, CAST(floor(p_retailprice) AS BIGINT) AS height,
    CAST(length(p_name) AS BIGINT) AS size
  FROM part),
parts_of AS (
  SELECT *, regexp_extract(path, '([^/]*)$', 1) AS name, regexp_replace(path, '/[^/]*$', '') AS dir,
    regexp_replace(regexp_extract(path, '([^/]*)$', 1), '\\.[^.]*$', '') AS stem,
    regexp_extract(related_path, '([^/]*)$', 1) AS rname,
    split_part(regexp_replace(regexp_extract(path, '([^/]*)$', 1), '\\.[^.]*$', ''), '_', 1) AS base
  FROM media)"""


def actions(spark: SparkSession, folder: str) -> DataFrame:
    """Event log read as an action history: kind, target, original_marks, new_files, auto, ts, action_id."""
    ev = table(spark, folder, "events")
    k = F.get_json_object("props", "$.k")
    name = F.concat(F.lit("file_"), k, F.lit(".png"))
    target = F.concat(F.lit("/lib/user_"), F.col("user_id").cast("string"))
    new_file = F.concat(target, F.lit("/"), name)
    kind = F.when(F.col("event_type") == "error", "delete").when(F.col("event_type").isin("view", "click"), "copy").otherwise("move")
    return ev.select(
        F.col("event_id").alias("action_id"), kind.alias("kind"), target.alias("target"),
        F.array(F.concat(F.lit("/in/"), name)).alias("original_marks"),
        F.when(kind == "delete", F.array().cast("array<string>"))
        .when(F.col("event_type") == "purchase", F.array(new_file, F.concat(new_file, F.lit(".bak"))))
        .otherwise(F.array(new_file)).alias("new_files"),
        (F.col("event_id") % 3 == 0).alias("auto"), "ts",
    )


ACTIONS_SQL = """actions AS (
  SELECT event_id AS action_id,
    CASE WHEN event_type = 'error' THEN 'delete' WHEN event_type IN ('view', 'click') THEN 'copy' ELSE 'move' END AS kind,
    '/lib/user_' || user_id AS target, '/in/file_' || json_extract_string(props, '$.k') || '.png' AS original_mark,
    CASE WHEN event_type = 'error' THEN 0 WHEN event_type = 'purchase' THEN 2 ELSE 1 END AS n_new,
    CASE WHEN event_type <> 'error' THEN '/lib/user_' || user_id || '/file_' || json_extract_string(props, '$.k') || '.png' END AS first_new,
    event_id % 3 = 0 AS auto, ts, event_type
  FROM events)"""


def predictions(spark: SparkSession, folder: str) -> DataFrame:
    """Class scores of every document in long form: (doc_id, category, score, ord)."""
    doc = table(spark, folder, "documents")
    n, d = F.col("n_chars"), F.col("doc_id")
    scores = [("art", n % 7, 0), ("draft", (n + d) % 11, 1), ("photo", (n * 3 + d) % 13, 2), ("scan", (d * 5 + n) % 5, 3)]
    rows = F.array(*[F.struct(F.lit(c).alias("category"), (s / 13.0).alias("score"), F.lit(o).alias("ord")) for c, s, o in scores])
    return doc.select("doc_id", F.explode(rows).alias("r")).select("doc_id", "r.category", "r.score", "r.ord")


PREDICTIONS_SQL = """preds AS (
  SELECT doc_id, 'art' AS category, (n_chars % 7) / 13.0::DOUBLE AS score, 0 AS ord FROM documents
  UNION ALL SELECT doc_id, 'draft', ((n_chars + doc_id) % 11) / 13.0::DOUBLE, 1 FROM documents
  UNION ALL SELECT doc_id, 'photo', ((n_chars * 3 + doc_id) % 13) / 13.0::DOUBLE, 2 FROM documents
  UNION ALL SELECT doc_id, 'scan', ((doc_id * 5 + n_chars) % 5) / 13.0::DOUBLE, 3 FROM documents)"""
