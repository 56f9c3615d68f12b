"""Structured Streaming counterparts: ingest, bundling, daily windows, verdict cache, pacing, votes."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from curaspark.session import checkpoint, ensure_checkpoint_dir


def stream_table(spark: SparkSession, path: str, schema, max_files: int = 250) -> DataFrame:
    """A table as a stream, at most ``max_files`` files per batch; ``path`` is one file or a folder of files."""
    # a plain path must be a folder, a pattern may name either
    path = path.rstrip("/")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).format("parquet").load(f"{path[:-1]}[{path[-1]}]")


def stream_media(stream: DataFrame, ts: str = "ts", delay: str = "10 minutes", key: str = "path") -> DataFrame:
    """Each path once: repeats within the watermark delay are dropped with bounded state."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def bundle_fixed(stream: DataFrame, keys: list[str], ts: str = "ts", gap: str = "3 seconds", delay: str = "10 minutes",
                 manual: Column | None = None) -> DataFrame:
    """Notifications of one kind within a fixed gap form a bundle."""
    by_hand = manual if manual is not None else F.lit(True)
    return (
        stream.withWatermark(ts, delay).groupBy(*keys, F.session_window(ts, gap).alias("w"))
        .agg(F.count(F.lit(1)).alias("n"), F.sum(by_hand.cast("int")).alias("n_manual"), F.sum((~by_hand).cast("int")).alias("n_auto"))
        .select(*keys, F.col("w.start").alias("start_ts"), F.col("w.end").alias("end_ts"), "n", "n_manual", "n_auto")
    )


#: Slots of one gap each that a range of a key's time line holds, at most.
RANGE_SLOTS = 100_000


def bundle_table(events: DataFrame, keys: list[str], ts: str = "ts", gap: str = "3 seconds", manual: Column | None = None,
                 range_slots: int = RANGE_SLOTS) -> DataFrame:
    """The bundles of ``bundle_fixed`` over a finished table, with no task that gathers a key.

    Events in one slot as wide as the gap always belong together, so they are first added up per (key, slot), on the map
    side too. The time line of a key is cut into ranges of ``range_slots`` slots and bundled range by range; only the
    first and last bundle of a range may go on in a neighbour, and these two rows are all that a key's own window reads.
    Events without a time are in no bundle; null keys form keys of their own. Input columns other than the keys and the
    time are read only by ``manual``, so their names may clash with anything.
    """
    wide = pd.Timedelta(gap) // pd.Timedelta(microseconds=1)
    by_hand = manual if manual is not None else F.lit(True)
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    names = [f"_k{i}" for i in range(len(keys))]
    rows = events.select(*[F.col(k).alias(n) for k, n in zip(keys, names)], at.alias("_at"), by_hand.cast("int").alias("_m"))
    slots = rows.filter("_at is not null").groupBy(*names, F.floor(F.col("_at") / wide).alias("_slot")).agg(
        F.min("_at").alias("_lo"), F.max("_at").alias("_hi"), F.count(F.lit(1)).alias("_n"), F.sum("_m").alias("_by"), F.sum(1 - F.col("_m")).alias("_auto")
    ).withColumn("_range", F.floor(F.col("_slot") / range_slots))

    def joined(parts: DataFrame, within: list[str]) -> DataFrame:
        """Rows in time order become one where the next begins less than a gap after the end of the one before."""
        order = Window.partitionBy(*within).orderBy("_lo")
        begins = F.coalesce((F.col("_lo") - F.lag("_hi").over(order) >= wide).cast("int"), F.lit(1))
        marked = parts.withColumn("_begins", begins).withColumn("_bundle", F.sum("_begins").over(order))
        return marked.groupBy(*within, "_bundle").agg(
            F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"), *[F.sum(c).alias(c) for c in ("_n", "_by", "_auto")]
        )

    pieces = joined(slots, [*names, "_range"])
    pieces = checkpoint(pieces.withColumn("_last", F.max("_bundle").over(Window.partitionBy(*names, "_range"))))
    at_border = (F.col("_bundle") == 1) | (F.col("_bundle") == F.col("_last"))
    columns = [*names, "_lo", "_hi", "_n", "_by", "_auto"]
    done = pieces.filter(~at_border).select(columns).unionByName(joined(pieces.filter(at_border).select(columns), names).select(columns))
    return done.select(
        *[F.col(n).alias(k) for k, n in zip(keys, names)], F.timestamp_micros("_lo").alias("start_ts"), F.timestamp_micros(F.col("_hi") + wide).alias("end_ts"),
        F.col("_n").alias("n"), F.col("_by").alias("n_manual"), F.col("_auto").alias("n_auto"),
    )


# Fixed values of the adaptive gap, in seconds.
BASE_GAP, MAX_GAP, WIDEN, NARROW = 3.0, 10.0, 1.5, 0.8


def next_gap(gap: float, since_last: float) -> float:
    """Gap after one more event: wider when events come quickly, back towards the base otherwise."""
    return min(gap * WIDEN, MAX_GAP) if since_last < gap else max(gap * NARROW, BASE_GAP)


def bundle_adaptive(stream: DataFrame, key: str, ts: str = "ts", delay: str = "10 minutes") -> DataFrame:
    """Bundles with a gap that adapts to the event rate, one state per key: (key, start_ts, end_ts, n).

    State is one open bundle and the gap. Events are taken in time order within a batch, events
    behind the watermark are dropped, and an event-time timer closes the last bundle.
    """
    kind = stream.schema[key].dataType.simpleString()
    out = f"{key} {kind}, start_ts timestamp, end_ts timestamp, n long"
    state_type = "start long, last long, n long, gap double"  # times in microseconds

    def step(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        def row(start: int, last: int, n: int) -> dict:
            return {key: group[0], "start_ts": pd.Timestamp(start, unit="us"), "end_ts": pd.Timestamp(last, unit="us"), "n": n}

        if state.hasTimedOut:
            start, last, n, _ = state.get
            state.remove()
            yield pd.DataFrame([row(start, last, n)])
            return
        times = sorted(t for pdf in batches for t in pdf[ts].astype("datetime64[us]").astype("int64").tolist())
        start, last, n, gap = state.get if state.exists else (None, None, 0, BASE_GAP)
        done = []
        for t in times:
            since = None if last is None else (t - last) / 1e6
            if since is not None:
                gap = next_gap(gap, since)
            if since is not None and since < gap:
                last, n = t, n + 1
            else:
                if last is not None:
                    done.append(row(start, last, n))
                start, last, n = t, t, 1
        state.update((start, last, n, gap))
        state.setTimeoutTimestamp(max(last // 1000 + int(MAX_GAP * 1000), state.getCurrentWatermarkMs() + 1))
        if done:
            yield pd.DataFrame(done)

    return stream.withWatermark(ts, delay).groupBy(key).applyInPandasWithState(
        step, out, state_type, "append", GroupStateTimeout.EventTimeTimeout
    )


def daily_stats(stream: DataFrame, keys: list[str], ts: str = "ts", delay: str = "1 hour", start: str = "5 hours", value: Column | None = None) -> DataFrame:
    """Counts per session day; days start at ``start`` after midnight."""
    extra = [F.sum(value).alias("total")] if value is not None else []
    return (
        stream.withWatermark(ts, delay).groupBy(*keys, F.window(ts, "1 day", startTime=start).alias("w"))
        .agg(F.count(F.lit(1)).alias("n"), *extra).select(*keys, F.col("w.start").alias("day_start"), "n", *(["total"] if extra else []))
    )


def sliding_rate(stream: DataFrame, keys: list[str], ts: str = "ts", size: str = "1 hour", slide: str = "15 minutes", delay: str = "1 hour") -> DataFrame:
    """Counts per sliding window and key, and the rate per minute of the window; partial counts are combined before the shuffle."""
    span = F.window(ts, size, slide).alias("w")
    counted = stream.withWatermark(ts, delay).groupBy(*keys, span).agg(F.count(F.lit(1)).alias("n"))
    minutes = (F.unix_timestamp("w.end") - F.unix_timestamp("w.start")) / 60
    return counted.select(*keys, F.col("w.start").alias("window_start"), "n", (F.col("n") / minutes).alias("per_minute"))


def frame_votes(stream: DataFrame, key: str, match: Column, ratio: float, slots: int) -> DataFrame:
    """Running vote per item (update mode): decided once positives reach the quota or cannot any more."""
    votes = stream.groupBy(key).agg(F.sum(match.cast("int")).alias("n_positive"), F.count(F.lit(1)).alias("n_seen"))
    need = F.ceil(F.lit(slots) * F.lit(ratio))
    state = F.when(F.col("n_positive") >= need, "match").when(F.col("n_positive") + (F.lit(slots) - F.col("n_seen")) < need, "no match").otherwise("open")
    return votes.withColumn("state", state)


def exempt_stream(stream: DataFrame, recent: DataFrame, name: Column) -> DataFrame:
    """Stream rows flagged when they are named in the recent-action table, however many names it holds."""
    named = recent.select("basename").distinct().withColumn("_hit", F.lit(True))
    return stream.join(named, name == named["basename"], "left").withColumn("exempt", F.coalesce("_hit", F.lit(False))).drop("_hit", "basename")


# ------------------------------------------------------------------ verdict cache


def cached_verdicts(media: DataFrame, store: DataFrame, epoch: int, evaluate: Callable[[DataFrame], DataFrame],
                    max_age: str | None = None, now: Column | None = None, key: str = "path") -> DataFrame:
    """Verdicts of the media: stored ones of the same policy epoch and not older than the file, else fresh.

    ``store`` has (path, mtime, epoch, verdict, stored_at). Returns the next store content for these media.
    """
    usable = store.filter(F.col("epoch") == epoch)
    if max_age is not None:
        usable = usable.filter(F.col("stored_at") >= (now if now is not None else F.current_timestamp()) - F.expr(f"INTERVAL {max_age}"))
    kept = usable.select(key, F.col("mtime").alias("_m"), "verdict", "stored_at")
    joined = media.join(kept, key, "left")
    fresh = F.col("_m").isNotNull() & (F.col("mtime") <= F.col("_m"))
    hits = joined.filter(fresh).select(key, "mtime", F.lit(epoch).alias("epoch"), "verdict", "stored_at", F.lit(True).alias("from_cache"))
    missing = joined.filter(~F.coalesce(fresh, F.lit(False))).select(*media.columns)
    stamp = (now if now is not None else F.current_timestamp()).alias("stored_at")
    made = evaluate(missing).select(key, "mtime", F.lit(epoch).alias("epoch"), "verdict", stamp, F.lit(False).alias("from_cache"))
    return hits.unionByName(made)


def evict(store: DataFrame, directory: str | None = None, before: Column | None = None) -> DataFrame:
    """Drop cached verdicts of a directory, or those stored before a time."""
    out = store
    if directory is not None:
        out = out.filter(~F.startswith("path", F.lit(directory.rstrip("/") + "/")))
    if before is not None:
        out = out.filter(F.col("stored_at") >= before)
    return out


def run_cache_stream(stream: DataFrame, folder: str, epoch: int, evaluate: Callable[[DataFrame], DataFrame]):
    """Stream of media rows through the verdict cache; every batch writes the next version of the store."""
    spark = stream.sparkSession
    schema = None

    def batch(df: DataFrame, number: int) -> None:
        nonlocal schema
        current = f"{folder}/v={number}"
        if number == 0:
            store = spark.createDataFrame([], "path string, mtime timestamp, epoch int, verdict string, stored_at timestamp")
        else:
            store = spark.read.parquet(f"{folder}/v={number - 1}")
        latest = df.groupBy("path").agg(F.max("mtime").alias("mtime"))
        verdicts = cached_verdicts(latest, store, epoch, evaluate).drop("from_cache")
        rest = store.join(latest.select("path"), "path", "left_anti").select(*verdicts.columns)
        rest.unionByName(verdicts).write.mode("overwrite").parquet(current)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", f"{folder}/_log").trigger(availableNow=True).start()


# ------------------------------------------------------------------ pacing


def rate_limit(df: DataFrame, order: list[Column], ts: str, seconds: float) -> DataFrame:
    """Dispatch time of a queue with at least ``seconds`` between items: max(ts, previous + seconds).

    With positions k this equals max over earlier items of (ts_i + (k − i)·seconds), so it is a
    running maximum of ts − i·seconds: computed per range and carried over, not item by item.
    """
    from pyspark.sql import Window

    from curaspark.scale import range_width, row_index

    queue = row_index(df, order, "queue_pos")
    base = F.unix_micros(F.col(ts).cast("timestamp")) - F.col("queue_pos") * F.lit(int(seconds * 1_000_000))
    total = queue.count()
    width = range_width(total)
    ranged = queue.withColumn("_v", base).withColumn("_rng", F.floor(F.col("queue_pos") / F.lit(width)))
    tops = ranged.groupBy("_rng").agg(F.max("_v").alias("_top"))
    before = Window.orderBy("_rng").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    carried = tops.select("_rng", F.max("_top").over(before).alias("_carry"))
    inside = Window.partitionBy("_rng").orderBy("queue_pos").rowsBetween(Window.unboundedPreceding, 0)
    best = F.greatest(F.max("_v").over(inside), F.col("_carry"))
    return (
        ranged.join(F.broadcast(carried), "_rng")
        .withColumn("dispatch_ts", F.timestamp_micros(best + F.col("queue_pos") * F.lit(int(seconds * 1_000_000))))
        .drop("_v", "_rng", "_carry")
    )


# ------------------------------------------------------------------ draining


def drain(stream: DataFrame, keys: list[str] | None = None, mode: str = "append") -> DataFrame:
    """Run a stream over everything available into a table of the checkpoint folder and read it back.

    In update mode the last version of every key is returned.
    """
    spark = stream.sparkSession
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    schema = stream.schema

    def batch(df: DataFrame, number: int) -> None:
        # a batch that is run again replaces its own rows
        df.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/rows/run={number}")

    query = (
        stream.writeStream.outputMode(mode).foreachBatch(batch).option("checkpointLocation", f"{folder}/log")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    stored = T.StructType([*schema.fields, T.StructField("_batch", T.IntegerType())])
    rows = spark.read.schema(stored).parquet(f"{folder}/rows")
    names = schema.names
    if mode != "update" or not keys:
        return rows.select(*names)
    rest = [c for c in names if c not in keys]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_batch").alias("_l"))
    return last.select(*keys, *[F.col(f"_l.{c}").alias(c) for c in rest])
