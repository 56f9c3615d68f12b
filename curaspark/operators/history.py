"""Action history: statistics, filters, recency lists and overlays.

Action tables have kind ('move', 'copy', 'delete'), target, original_marks, new_files, auto, ts and
a unique ``action_id`` that breaks ties of ts.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curaspark.functions import paths as P
from curaspark.operators.order import ranked_stage
from curaspark.scale import row_index

DAY_START_HOUR = 5


def newest() -> list[Column]:
    return [F.col("ts").desc(), F.col("action_id").desc()]


def session_day(ts: Column, hour: int = DAY_START_HOUR) -> Column:
    """Date of the session day, which starts at ``hour``."""
    return F.to_date(ts - F.expr(f"INTERVAL {hour} HOURS"))


def filter_history(actions: DataFrame, kind: str | None = None, auto: bool | None = None,
                   day: dt.date | None = None, text: str | None = None) -> DataFrame:
    """Conjunction of kind, initiator and session day; with a text, also the ranked text filter (stage)."""
    out = actions
    if kind is not None:
        out = out.filter(F.col("kind") == kind)
    if auto is not None:
        out = out.filter(F.col("auto") == auto)
    if day is not None:
        out = out.filter(session_day(F.col("ts")) == F.lit(day))
    if text:
        out = out.withColumn("stage", ranked_stage("target", text)).filter("stage is not null")
    return out


def affected(df_kind: str = "kind") -> Column:
    """Files an action affected: original marks of deletes, new files otherwise."""
    return F.when(F.col(df_kind) == "delete", F.col("original_marks")).otherwise(F.col("new_files"))


def action_stats(actions: DataFrame, day: dt.date | None = None, kind: str | None = None, auto: bool | None = False) -> DataFrame:
    """Files moved, copied and deleted per target."""
    rows = filter_history(actions, kind, auto, day)
    n = F.size(affected())

    def total(k: str) -> Column:
        return F.sum(F.when(F.col("kind") == k, n).otherwise(0)).cast("bigint")

    return rows.groupBy("target").agg(total("move").alias("moved"), total("copy").alias("copied"), total("delete").alias("deleted")).withColumn(
        "total", F.col("moved") + F.col("copied") + F.col("deleted")
    )


def top_with_rest(stats: DataFrame, n: int, key: str = "target", value: str = "total", rest: str = "(rest)") -> DataFrame:
    """The ``n`` largest targets, everything else folded into one row."""
    top = stats.orderBy(F.col(value).desc(), F.col(key)).limit(n).select(F.col(key).alias("_top"))
    joined = stats.join(F.broadcast(top), F.col(key) == F.col("_top"), "left")  # at most n rows
    return joined.groupBy(F.coalesce("_top", F.lit(rest)).alias(key)).agg(F.sum(value).alias(value))


def recent_names(actions: DataFrame, limit: int = 100, auto: bool | None = None) -> DataFrame:
    """Basenames of the first new file of the latest ``limit`` actions, deletes excluded."""
    last = actions.orderBy(*newest()).limit(limit)
    rows = last.filter((F.col("kind") != "delete") & (F.size("new_files") > 0))
    if auto is not None:
        rows = rows.filter(F.col("auto") == auto)
    return rows.select(P.basename(F.element_at("new_files", 1)).alias("basename")).filter(F.col("basename") != "").distinct()


def recently_actioned(media: DataFrame, actions: DataFrame, limit: int = 100, auto: bool | None = None) -> DataFrame:
    """Media named like a recently moved or copied file."""
    names = F.broadcast(recent_names(actions, limit, auto))  # at most `limit` rows
    return media.join(names, P.basename("path") == names["basename"], "left_semi")


def exempt(media: DataFrame, actions: DataFrame, rule_targets: list[str], limit: int = 100) -> DataFrame:
    """Recently actioned media, and media lying in a rule's target directory."""
    names = F.broadcast(recent_names(actions, limit))
    marked = media.join(names.withColumn("_hit", F.lit(True)), P.basename("path") == names["basename"], "left").drop("basename")
    keep = F.coalesce("_hit", F.lit(False)) | P.dirname("path").isin(*[t.rstrip("/") for t in rule_targets])
    return marked.filter(keep).drop("_hit")


def distinct_actions(actions: DataFrame, auto: bool | None = False, deletes: bool = False,
                     permanent: tuple[str, str] | None = None) -> DataFrame:
    """Distinct (kind, target) actions that can be repeated, latest use first (position ``n``)."""
    rows = actions if deletes else actions.filter(F.col("kind") != "delete")
    if auto is not None:
        rows = rows.filter(F.col("auto") == auto)
    if permanent is not None:
        rows = rows.filter(~((F.col("kind") == permanent[0]) & (F.col("target") == permanent[1])))
    last = rows.groupBy("kind", "target").agg(F.max(F.struct("ts", "action_id")).alias("_l"))
    return row_index(last.select("kind", "target", "_l.ts", "_l.action_id"), newest(), "n")


def history_action(actions: DataFrame, n: int = 0, **options) -> DataFrame:
    """The n-th previous distinct action, counted from 0."""
    return distinct_actions(actions, **options).filter(F.col("n") == n)


def history_for(actions: DataFrame, path: str) -> DataFrame:
    """Actions that affected a file, with the pass: 1 exact path, 2 basename, 3 basename prefix."""
    name = path.rsplit("/", 1)[-1].lower()
    head = name.rsplit(".", 1)[0] if "." in name.lstrip(".") else name
    files = affected()

    def hit(test) -> Column:
        return F.coalesce(F.exists(files, test), F.lit(False))

    stage = (
        F.when(hit(lambda f: f == path), 1)
        .when(hit(lambda f: F.lower(P.basename(f)) == name), 2)
        .when(hit(lambda f: F.startswith(F.lower(P.basename(f)), F.lit(head))), 3)
    )
    return actions.withColumn("stage", stage).filter("stage is not null")


def destinations(actions: DataFrame, media: DataFrame) -> DataFrame:
    """Existing destination files of the history in first-seen order (position ``n``)."""
    files = actions.select("ts", "action_id", F.posexplode("new_files").alias("p", "path"))
    alive = files.join(media.select("path").distinct(), "path", "left_semi")
    first = alive.groupBy("path").agg(F.max(F.struct("ts", "action_id", (-F.col("p")).alias("p"))).alias("_f"))
    return row_index(first, [F.col("_f").desc(), F.col("path")], "n").select("path", "n")


def recent_first(events: DataFrame, key: str, cap: int, ts: str = "ts") -> DataFrame:
    """Most recently used list: each key once, latest first, at most ``cap``."""
    last = events.groupBy(key).agg(F.max(ts).alias("last_ts"))
    return last.orderBy(F.col("last_ts").desc(), F.col(key)).limit(cap)


def record_history(log: DataFrame, identity: list[str], cap: int = 20) -> DataFrame:
    """Run log without repeats of an identity, newest first, at most ``cap`` entries."""
    last = log.groupBy(*identity).agg(F.max(F.struct("ts", "action_id")).alias("_l"))
    return last.select(*identity, "_l.ts", "_l.action_id").orderBy(*newest()).limit(cap)


def replacement_dir(recent: DataFrame, opened: DataFrame, existing: DataFrame) -> DataFrame:
    """First recent directory (by pos) that exists and is not open."""
    free = recent.join(opened.select("directory"), "directory", "left_anti").join(existing.select("directory"), "directory", "left_semi")
    return free.agg(F.min_by("directory", "pos").alias("directory"))


def apply_action_set(items: DataFrame, steps: list[tuple[str, str]]) -> DataFrame:
    """Plan rows of an action set (kind, target) for every item; at most one step may move."""
    if sum(kind == "move" for kind, _ in steps) > 1:
        raise ValueError("an action set may move at most once")
    listed = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(t).alias("target")) for k, t in steps])
    return items.select("*", F.posexplode(listed).alias("step", "_s")).select(*items.columns, "step", "_s.kind", "_s.target")


# ------------------------------------------------------------------ names and mappings


def merge_mapping(old: DataFrame, new: DataFrame, keys: list[str], value: str = "new_name") -> DataFrame:
    """Mapping table with the new entries over the old ones."""
    o = old.select(*keys, F.col(value).alias("_old"))
    n = new.select(*keys, F.col(value).alias("_new"))
    return o.join(n, keys, "full").select(*keys, F.coalesce("_new", "_old").alias(value))


def review_rows(media: DataFrame, mapping: DataFrame, keys: list[str]) -> DataFrame:
    """Media whose (relative directory, original name) is in the mapping."""
    return media.join(mapping.select(*keys), keys, "left_semi")


def free_names(df: DataFrame, name: str, order: list[Column], existing: DataFrame | None = None, out: str = "final_name") -> DataFrame:
    """Collision-free names: the wanted name when free, else ``stem_1``, ``stem_2`` … in row order.

    Rows sharing a wanted name are numbered by a distributed group index; numbered names that are
    already taken (by ``existing`` or by another row's wanted name) are skipped by retrying the
    rows concerned with the next number.
    """
    from curaspark.scale import group_index
    from curaspark.session import checkpoint

    rows = group_index(df, [name], order, "_n")
    taken = df.select(F.col(name).alias("t")).distinct()
    if existing is not None:
        held = existing.select(F.col(name).alias("t")).distinct()
        # a wanted name that already exists shifts the whole group by one
        rows = rows.join(held.withColumnRenamed("t", "_h"), F.col(name) == F.col("_h"), "left").withColumn(
            "_n", F.col("_n") + F.col("_h").isNotNull().cast("int")
        ).drop("_h")
        taken = taken.unionByName(held).distinct()
    stem, ext = P.stem(name), P.ext(name)
    numbered = F.concat(stem, F.lit("_"), F.col("_n").cast("string"), ext)
    rows = checkpoint(rows.withColumn(out, F.when(F.col("_n") == 0, F.col(name)).otherwise(numbered)))
    while True:
        clash = rows.filter(F.col("_n") > 0).join(taken.withColumnRenamed("t", "_t"), F.col(out) == F.col("_t"))
        if clash.isEmpty():
            return rows.drop("_n")
        # every number at or above a taken one moves up by one within its group
        hit = clash.groupBy(name).agg(F.min("_n").alias("_m"))
        moved = rows.join(hit, name, "left").withColumn(
            "_n", F.col("_n") + F.coalesce((F.col("_n") >= F.col("_m")).cast("int"), F.lit(0))
        ).drop("_m")
        rows = checkpoint(moved.withColumn(out, F.when(F.col("_n") == 0, F.col(name)).otherwise(numbered)))


def unique_sibling(df: DataFrame, path: str, part: str, existing: DataFrame) -> DataFrame:
    """Free output path beside every row: ``stem+part``, else with ``_1``, ``_2`` …"""
    wanted = F.concat(P.dirname(path), F.lit("/"), P.stem(path), F.lit(part), P.ext(path))
    held = existing.select(F.col("path").alias("sibling"))
    named = df.withColumn("sibling", wanted)
    # names are compared as whole paths
    return free_names_for_paths(named, "sibling", [F.col(path)], held)


def free_names_for_paths(df: DataFrame, name: str, order: list[Column], existing: DataFrame) -> DataFrame:
    """``free_names`` for full paths: the directory is carried apart from the name."""
    split = df.withColumn("_dir", P.dirname(name)).withColumn("_name", F.concat(P.dirname(name), F.lit("//"), P.basename(name)))
    held = existing.select(F.concat(P.dirname(name), F.lit("//"), P.basename(name)).alias("_name"))
    # '//' cannot occur in a path, so stem and extension of the pair are those of the basename
    flat = split.withColumn("_name", F.replace("_name", F.lit("/"), F.lit("\x02")))
    held = held.withColumn("_name", F.replace("_name", F.lit("/"), F.lit("\x02")))
    out = free_names(flat, "_name", order, held, "_final")
    return out.withColumn("free_path", F.replace(F.replace("_final", F.lit("\x02\x02"), F.lit("/")), F.lit("\x02"), F.lit("/"))).drop("_dir", "_name", "_final")
