"""Registered streaming queries, drained over the event table, with SQL twins where windows are fixed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curaspark.functions import paths as P
from curaspark.operators import history as H
from curaspark.plans.tables import actions, media, table
from curaspark.session import checkpoint
from curaspark.streaming import streams as S


def _stream(spark, folder, name: str) -> DataFrame:
    return S.stream_table(spark, f"{folder}/{name}.parquet", table(spark, folder, name).schema)


def _events(spark, folder) -> DataFrame:
    return _stream(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def stream_daily(spark, folder):
    out = S.daily_stats(_events(spark, folder), ["event_type"], value=F.col("event_id"))
    rows = S.drain(out, ["event_type", "day_start"], "update")
    return rows.select("event_type", F.date_format("day_start", "yyyy-MM-dd HH:mm:ss").alias("day_start"), "n", "total")


def stream_sliding_rate(spark, folder):
    """Events per type in windows of one hour that start every quarter of an hour."""
    rows = S.drain(S.sliding_rate(_events(spark, folder), ["event_type"]), ["event_type", "window_start"], "update")
    start = F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start")
    return rows.select("event_type", start, "n", F.round("per_minute", 6).alias("per_minute"))


def stream_bundles(spark, folder):
    """Session windows of one hour per user; open bundles are closed by the end of the data only in the batch twin."""
    out = S.bundle_fixed(_events(spark, folder), ["user_id"], gap="1 hour", manual=F.col("event_type") != "error")
    rows = S.drain(out)
    return rows.select("user_id", F.date_format("start_ts", "yyyy-MM-dd HH:mm:ss").alias("start_ts"), "n", "n_manual", "n_auto")


def batch_bundles(spark, folder):
    """The same bundles over the finished table, from slots and ranges."""
    out = S.bundle_table(table(spark, folder, "events"), ["user_id"], gap="1 hour", manual=F.col("event_type") != "error")
    return out.select("user_id", F.unix_micros("start_ts").alias("start_us"), F.unix_micros("end_ts").alias("end_us"), "n", "n_manual", "n_auto")


def stream_adaptive_bundles(spark, folder):
    """Bundles with a gap that adapts to each user's rate; event times are compressed to seconds."""
    ev = _events(spark, folder).withColumn("ts", F.timestamp_micros((F.unix_micros("ts") / 3600).cast("bigint")))
    return S.drain(S.bundle_adaptive(ev.select("user_id", "ts"), "user_id"))


def stream_first_seen(spark, folder):
    """Each (user, property) once within the watermark delay."""
    ev = _events(spark, folder).withColumn("path", F.concat_ws("/", F.col("user_id").cast("string"), F.get_json_object("props", "$.k")))
    rows = S.drain(S.stream_media(ev.select("path", "ts"), delay="60 days"))
    return rows.groupBy("path").agg(F.count(F.lit(1)).alias("n"))


def stream_votes(spark, folder):
    out = S.frame_votes(_stream(spark, folder, "conversations"), "conv_id", F.length("text") > 300, 0.5, 4)
    return S.drain(out, ["conv_id"], "update")


def stream_exempt(spark, folder):
    recent = H.recent_names(actions(spark, folder))
    name = F.concat(F.lit("file_"), F.get_json_object("props", "$.k"), F.lit(".png"))
    rows = S.drain(S.exempt_stream(_events(spark, folder), recent, name).select("event_id", F.col("exempt").cast("int").alias("exempt")))
    return rows


def verdict_cache(spark, folder):
    """Second run over a stored first one: new policy for nobody, newer files for every third."""
    m = checkpoint(media(spark, folder).select("path", F.timestamp_seconds(F.col("id") * 0 + 1_700_000_000).alias("mtime"), "width", "id"))
    now = F.lit("2024-01-01 00:00:00").cast("timestamp")

    def judge(df: DataFrame) -> DataFrame:
        sized = df.join(m.select("path", "width"), "path")
        return sized.withColumn("verdict", F.when(F.col("width") > 1000, "HIDE").otherwise("NOTIFY"))

    empty = spark.createDataFrame([], "path string, mtime timestamp, epoch int, verdict string, stored_at timestamp")
    store = checkpoint(S.cached_verdicts(m.filter("id % 5 <> 0").select("path", "mtime"), empty, 1, judge, now=now).drop("from_cache"))
    store = S.evict(store, "/lib/work")
    later = m.select("path", F.when(F.col("id") % 3 == 0, F.timestamp_seconds(F.unix_seconds("mtime") + 60)).otherwise(F.col("mtime")).alias("mtime"))
    out = S.cached_verdicts(later, store, 1, judge, max_age="30 DAYS", now=now)
    return out.select("path", "verdict", F.col("from_cache").cast("int").alias("from_cache"))


def paced_queue(spark, folder):
    """Dispatch times at least ten minutes apart, in event order."""
    ev = table(spark, folder, "events").select("event_id", "ts")
    out = S.rate_limit(ev, [F.col("ts"), F.col("event_id")], "ts", 600.0)
    return out.select("event_id", F.unix_micros("dispatch_ts").alias("dispatch_us"))


QUERIES = {f.__name__: f for f in (
    stream_daily, stream_sliding_rate, stream_bundles, batch_bundles, stream_adaptive_bundles, stream_first_seen, stream_votes, stream_exempt, verdict_cache, paced_queue,
)}

ORACLES = {
    "stream_daily": """SELECT event_type, strftime(date_trunc('day', ts - INTERVAL 5 HOURS) + INTERVAL 5 HOURS, '%Y-%m-%d %H:%M:%S') AS day_start, count(*) AS n, sum(event_id)::BIGINT AS total FROM events GROUP BY 1, 2""",
    "stream_sliding_rate": """WITH q AS (SELECT event_type, to_timestamp(floor(epoch(ts) / 900) * 900 - unnest([0, 900, 1800, 2700])) AT TIME ZONE 'UTC' AS s FROM events)
      SELECT event_type, strftime(s, '%Y-%m-%d %H:%M:%S') AS window_start, count(*) AS n, round(count(*) / 60.0, 6)::DOUBLE AS per_minute FROM q GROUP BY 1, 2""",
    "batch_bundles": """WITH s AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS brk FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
      g AS (SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM s)
      SELECT user_id, epoch_us(min(ts)) AS start_us, epoch_us(max(ts) + INTERVAL 1 HOUR) AS end_us, count(*) AS n, sum((event_type <> 'error')::INT)::BIGINT AS n_manual,
        sum((event_type = 'error')::INT)::BIGINT AS n_auto FROM g GROUP BY user_id, b""",
    # a bundle is closed when the watermark, ten minutes behind the last event, has passed its end
    "stream_bundles": """WITH s AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS brk FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
      g AS (SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM s)
      SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start_ts, count(*) AS n, sum((event_type <> 'error')::INT)::BIGINT AS n_manual, sum((event_type = 'error')::INT)::BIGINT AS n_auto
      FROM g GROUP BY user_id, b HAVING epoch_us(max(ts)) + 3600000000 <= (SELECT epoch_ms(max(ts)) * 1000 FROM events) - 600000000""",
    "stream_first_seen": "SELECT DISTINCT user_id || '/' || json_extract_string(props, '$.k') AS path, 1::BIGINT AS n FROM events",
    "stream_votes": """WITH v AS (SELECT conv_id, sum((length(text) > 300)::INT)::BIGINT AS n_positive, count(*) AS n_seen FROM conversations GROUP BY conv_id)
      SELECT *, CASE WHEN n_positive >= 2 THEN 'match' WHEN n_positive + 4 - n_seen < 2 THEN 'no match' ELSE 'open' END AS state FROM v""",
    "stream_exempt": """WITH r AS (SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 100), n AS (SELECT DISTINCT json_extract_string(props, '$.k') AS k FROM r WHERE event_type <> 'error')
      SELECT event_id, (json_extract_string(props, '$.k') IN (SELECT k FROM n))::INT AS exempt FROM events""",
    "verdict_cache": """SELECT '/lib/' || CASE p_size % 3 WHEN 0 THEN 'work' WHEN 1 THEN 'pool' ELSE 'target' END || '/img' || lpad(CAST(p_partkey // 4 AS VARCHAR), 9, '0')
        || CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN '_edit' WHEN 2 THEN '_' || lower(substr(p_type, 1, 4)) ELSE '_2' END || '.png' AS path,
      CASE WHEN p_size * 40 > 1000 THEN 'HIDE' ELSE 'NOTIFY' END AS verdict, (p_partkey % 5 <> 0 AND p_size % 3 <> 0 AND p_partkey % 3 <> 0)::INT AS from_cache FROM part""",
    "paced_queue": """WITH q AS (SELECT event_id, epoch_us(ts) AS t, row_number() OVER (ORDER BY ts, event_id) - 1 AS k FROM events)
      SELECT event_id, max(t - k * 600000000) OVER (ORDER BY k) + k * 600000000 AS dispatch_us FROM q""",
}
