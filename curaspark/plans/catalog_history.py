"""Registered queries over the action history, with their SQL twins."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from curaspark.functions import paths as P
from curaspark.operators import history as H
from curaspark.operators import order as O
from curaspark.plans.tables import ACTIONS_SQL, MEDIA_SQL, actions, media, table

DAY = dt.date(2024, 1, 10)


def action_stats(spark, folder):
    return H.action_stats(actions(spark, folder))


def action_stats_day(spark, folder):
    return H.action_stats(actions(spark, folder), day=DAY, auto=None)


def top_with_rest(spark, folder):
    return H.top_with_rest(H.action_stats(actions(spark, folder), auto=None), 10)


def session_days(spark, folder):
    a = actions(spark, folder)
    return a.groupBy(H.session_day(F.col("ts")).alias("day"), "kind").agg(F.count(F.lit(1)).alias("n_actions"))


def history_filter(spark, folder):
    return H.filter_history(actions(spark, folder), "move", False, DAY).select("action_id", "target")


def history_text_filter(spark, folder):
    """Ranked text filter on targets."""
    return H.filter_history(actions(spark, folder), text="user_1").select("action_id", "target", "stage")


def ranked_filter(spark, folder):
    """Text filter on page paths: name, prefix, parent, word inside."""
    pages = table(spark, folder, "pages").select("page_id", F.regexp_replace("url", "[?#].*$", "").alias("path"))
    return pages.withColumn("stage", O.ranked_stage("path", "en")).filter("stage is not null").select("page_id", "stage").unionByName(
        pages.withColumn("stage", O.ranked_stage("path", "49")).filter("stage is not null").select("page_id", (F.col("stage") + 10).alias("stage"))
    )


def history_lookup(spark, folder):
    return H.history_for(actions(spark, folder), "/lib/user_7/file_42.png").select("action_id", "stage")


def recently_actioned(spark, folder):
    a = actions(spark, folder)
    files = a.select(F.explode("original_marks").alias("path")).distinct()
    return H.recently_actioned(files, a).select("path")


def direct_display(spark, folder):
    """Exempt from checks: recently actioned, or in a rule's target directory."""
    a = actions(spark, folder)
    files = a.select(F.explode(F.concat("original_marks", "new_files")).alias("path")).distinct()
    return H.exempt(files, a, ["/lib/user_3", "/lib/user_5/"]).select("path")


def distinct_actions(spark, folder):
    return H.distinct_actions(actions(spark, folder), permanent=("move", "/lib/user_2")).select("kind", "target", "action_id", "n")


def previous_action(spark, folder):
    return H.history_action(actions(spark, folder), 3, auto=None, deletes=True).select("kind", "target", "action_id")


def destination_files(spark, folder):
    a = actions(spark, folder)
    alive = a.filter("kind <> 'delete'").select(F.explode("new_files").alias("path")).filter("path not like '%.bak'")
    return H.destinations(a, alive)


def recent_targets(spark, folder):
    return H.recent_first(actions(spark, folder), "target", 50).select("target")


def run_log(spark, folder):
    return H.record_history(actions(spark, folder), ["kind", "target"]).select("kind", "target", "action_id")


def replacement_dir(spark, folder):
    a = actions(spark, folder)
    recent = H.recent_first(a, "target", 100).select(F.col("target").alias("directory"), (-F.unix_micros(F.col("last_ts").cast("timestamp"))).alias("pos"))
    opened = a.filter("kind = 'delete' and auto").select(F.col("target").alias("directory")).distinct().filter("directory like '%1'")
    existing = a.filter("kind = 'move'").select(F.col("target").alias("directory")).distinct()
    return H.replacement_dir(recent, opened, existing)


def action_set_plan(spark, folder):
    m = media(spark, folder).select("id", "path").filter(P.stem("path").endswith("_edit"))
    return H.apply_action_set(m, [("copy", "/a"), ("copy", "/b"), ("move", "/c")]).select("id", "step", "kind", "target")


QUERIES = {f.__name__: f for f in (
    action_stats, action_stats_day, top_with_rest, session_days, history_filter, history_text_filter, ranked_filter, history_lookup,
    recently_actioned, direct_display, distinct_actions, previous_action, destination_files, recent_targets, run_log, replacement_dir,
    action_set_plan,
)}

_A = f"WITH {ACTIONS_SQL}"
_N = "CASE WHEN kind = 'delete' THEN 1 ELSE n_new END"


def _stats(where: str) -> str:
    return f"""stats AS (SELECT target, sum(CASE WHEN kind = 'move' THEN {_N} ELSE 0 END)::BIGINT AS moved, sum(CASE WHEN kind = 'copy' THEN {_N} ELSE 0 END)::BIGINT AS copied,
      sum(CASE WHEN kind = 'delete' THEN {_N} ELSE 0 END)::BIGINT AS deleted, sum({_N})::BIGINT AS total FROM actions WHERE {where} GROUP BY target)"""


_DAY = f"CAST(ts - INTERVAL 5 HOURS AS DATE) = DATE '{DAY}'"


def _stage(name: str, parent: str, text: str) -> str:
    return f"""CASE WHEN {name} = '{text}' THEN 1 WHEN starts_with({name}, '{text}') THEN 2 WHEN {parent} <> '' AND starts_with({parent}, '{text}') THEN 3
      WHEN contains({name}, ' {text}') OR contains({name}, '_{text}') THEN 4 END"""


ORACLES = {
    "action_stats": f"{_A}, {_stats('NOT auto')} SELECT * FROM stats",
    "action_stats_day": f"{_A}, {_stats(_DAY)} SELECT * FROM stats",
    "top_with_rest": f"""{_A}, {_stats('true')}, r AS (SELECT *, row_number() OVER (ORDER BY total DESC, target) AS k FROM stats)
      SELECT CASE WHEN k <= 10 THEN target ELSE '(rest)' END AS target, sum(total)::BIGINT AS total FROM r GROUP BY 1""",
    "session_days": f"{_A} SELECT CAST(ts - INTERVAL 5 HOURS AS DATE) AS day, kind, count(*) AS n_actions FROM actions GROUP BY 1, 2",
    "history_filter": f"{_A} SELECT action_id, target FROM actions WHERE kind = 'move' AND NOT auto AND {_DAY}",
    "history_text_filter": f"""{_A}, s AS (SELECT action_id, target, {_stage("regexp_extract(target, '([^/]*)$', 1)", "'lib'", "user_1")} AS stage FROM actions) SELECT * FROM s WHERE stage IS NOT NULL""",
    "ranked_filter": f"""WITH p AS (SELECT page_id, regexp_replace(regexp_replace(url, '[?#].*$', ''), '/+$', '') AS path FROM pages),
      n AS (SELECT page_id, lower(regexp_extract(path, '([^/]*)$', 1)) AS name, lower(regexp_extract(path, '([^/]*)/[^/]*$', 1)) AS parent FROM p),
      s AS (SELECT page_id, {_stage('name', 'parent', 'en')} AS stage FROM n UNION ALL SELECT page_id, 10 + {_stage('name', 'parent', '49')} FROM n)
      SELECT * FROM s WHERE stage IS NOT NULL""",
    "history_lookup": f"""{_A}, f AS (SELECT action_id, CASE WHEN kind = 'delete' THEN original_mark ELSE first_new END AS f FROM actions
        UNION ALL SELECT action_id, first_new || '.bak' FROM actions WHERE event_type = 'purchase'),
      s AS (SELECT action_id, CASE WHEN f = '/lib/user_7/file_42.png' THEN 1 WHEN regexp_extract(f, '([^/]*)$', 1) = 'file_42.png' THEN 2
        WHEN starts_with(regexp_extract(f, '([^/]*)$', 1), 'file_42') THEN 3 END AS stage FROM f)
      SELECT action_id, min(stage)::INT AS stage FROM s WHERE stage IS NOT NULL GROUP BY action_id""",
    "recently_actioned": f"""{_A}, r AS (SELECT * FROM actions ORDER BY ts DESC, action_id DESC LIMIT 100),
      n AS (SELECT regexp_extract(first_new, '([^/]*)$', 1) AS name FROM r WHERE kind <> 'delete')
      SELECT DISTINCT original_mark AS path FROM actions WHERE regexp_extract(original_mark, '([^/]*)$', 1) IN (SELECT name FROM n)""",
    "direct_display": f"""{_A}, r AS (SELECT * FROM actions ORDER BY ts DESC, action_id DESC LIMIT 100),
      n AS (SELECT regexp_extract(first_new, '([^/]*)$', 1) AS name FROM r WHERE kind <> 'delete'),
      f AS (SELECT original_mark AS path FROM actions UNION SELECT first_new FROM actions WHERE kind <> 'delete' UNION SELECT first_new || '.bak' FROM actions WHERE event_type = 'purchase')
      SELECT path FROM f WHERE regexp_extract(path, '([^/]*)$', 1) IN (SELECT name FROM n) OR regexp_replace(path, '/[^/]*$', '') IN ('/lib/user_3', '/lib/user_5')""",
    "distinct_actions": f"""{_A}, l AS (SELECT kind, target, ts, action_id FROM actions WHERE kind <> 'delete' AND NOT auto AND NOT (kind = 'move' AND target = '/lib/user_2')
        QUALIFY row_number() OVER (PARTITION BY kind, target ORDER BY ts DESC, action_id DESC) = 1)
      SELECT kind, target, action_id, row_number() OVER (ORDER BY ts DESC, action_id DESC) - 1 AS n FROM l""",
    "previous_action": f"""{_A}, l AS (SELECT kind, target, ts, action_id FROM actions QUALIFY row_number() OVER (PARTITION BY kind, target ORDER BY ts DESC, action_id DESC) = 1)
      SELECT kind, target, action_id FROM l ORDER BY ts DESC, action_id DESC LIMIT 1 OFFSET 3""",
    "destination_files": f"""{_A}, l AS (SELECT first_new AS path, max(ts) AS ts, arg_max(action_id, ts) AS a FROM actions WHERE kind <> 'delete' GROUP BY first_new)
      SELECT path, row_number() OVER (ORDER BY ts DESC, a DESC, path) - 1 AS n FROM l""",
    "recent_targets": f"{_A} SELECT target FROM actions GROUP BY target ORDER BY max(ts) DESC, target LIMIT 50",
    "run_log": f"{_A} SELECT kind, target, arg_max(action_id, ts) AS action_id FROM actions GROUP BY kind, target ORDER BY max(ts) DESC LIMIT 20",
    "replacement_dir": f"""{_A}, r AS (SELECT target, max(ts) AS t FROM actions GROUP BY target ORDER BY t DESC, target LIMIT 100)
      SELECT target AS directory FROM r WHERE target IN (SELECT target FROM actions WHERE kind = 'move')
        AND target NOT IN (SELECT target FROM actions WHERE kind = 'delete' AND auto AND target LIKE '%1') ORDER BY t DESC LIMIT 1""",
    "action_set_plan": f"""WITH {MEDIA_SQL} SELECT id, s.step, s.kind, s.target FROM parts_of,
      (VALUES (0, 'copy', '/a'), (1, 'copy', '/b'), (2, 'move', '/c')) s(step, kind, target) WHERE stem LIKE '%\\_edit' ESCAPE '\\'""",
}
