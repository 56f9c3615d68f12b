"""Registered queries of rules, decision walks, frames and class decisions, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curaspark.functions import paths as P
from curaspark.functions import text as X
from curaspark.operators import agg as A
from curaspark.operators import filters as L
from curaspark.operators import rules as R
from curaspark.plans import decision as D
from curaspark.plans.tables import MEDIA_SQL, PREDICTIONS_SQL, media, predictions, table
from curaspark.session import checkpoint

CATEGORIES = ["art", "draft", "photo", "scan"]
GROUPS = [["art", "photo"], ["scan"], ["art", "draft"]]


def _docs(spark, folder) -> DataFrame:
    """Documents with labels, predicted category and a directory."""
    doc = table(spark, folder, "documents")
    lab = table(spark, folder, "labels")
    cat = A.classify(predictions(spark, folder), "doc_id", CATEGORIES, GROUPS, ["photo"])
    base = doc.join(lab, "doc_id", "left").join(cat, "doc_id")
    return base.withColumn("path", F.concat(F.lit("/docs/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.when(F.col("lang") == "fr", ".gif").otherwise(".png"))).withColumn(
        "base_dir", F.concat(F.lit("/docs/"), "source")
    )


def classifier_rank(spark, folder):
    return A.rank_condition(predictions(spark, folder), "doc_id", ["photo", "scan"], 2, 3, 0.3)


def classifier_rank_negated(spark, folder):
    return A.rank_condition(predictions(spark, folder), "doc_id", ["art"], 1, 2, 0.1, negate=True)


def class_decision(spark, folder):
    return A.classify(predictions(spark, folder), "doc_id", CATEGORIES, GROUPS, ["photo"])


def neutral_classes(spark, folder):
    """Languages of every source outside the positive groups."""
    doc = table(spark, folder, "documents")
    langs = doc.groupBy("source").agg(F.collect_set("lang").alias("langs"))
    groups = F.array(F.array(F.lit("en"), F.lit("fr")), F.array(F.lit("xx")))
    return langs.select("source", F.array_join(F.sort_array(L.neutral_categories("langs", groups)), ",").alias("neutral"))


# ------------------------------------------------------------------ rules


def _rule(mode: str) -> R.Rule:
    return R.Rule(
        "mixed", "MOVE", mode=mode,
        checks={
            "prototype": F.col("n_chars") > 6000, "embedding": F.col("quality") == 1,
            "classifier": R.classifier_match("selected", F.col("category"), ["photo", "art"]), "prompt": X.prompt_condition("text", ["the"]),
        },
        veto=R.lookahead_veto(None, [F.col("toxic") == 1, F.col("n_chars") < 100]), category=F.col("category"), selected=["photo"],
    )


def rule_or(spark, folder):
    return _rule("or").evaluate(_docs(spark, folder)).select("doc_id", F.col("verdict.matched").cast("int").alias("matched"), "verdict.trigger", F.col("verdict.category").alias("category"))


def rule_and(spark, folder):
    rule = _rule("and")
    del rule.checks["prototype"]
    return rule.evaluate(_docs(spark, folder)).select("doc_id", F.col("verdict.matched").cast("int").alias("matched"), "verdict.trigger", F.col("verdict.category").alias("category"))


def _rules() -> list[R.Rule]:
    return [
        R.Rule("gifs", "HIDE", checks={"classifier": F.col("category") == "scan"}, media_types=["gif"]),
        R.Rule("moves", "MOVE", "/docs/src3", checks={"prompt": X.prompt_condition("text", ["license"]), "embedding": F.col("quality") == 0}),
        R.Rule("one dir", "BLUR", checks={"embedding": F.col("n_chars") > 500}, directories=["/docs/src1", "/docs/src2"]),
        R.Rule("off", "DELETE", checks={"embedding": F.lit(True)}, is_active=False),
    ]


def prevalidation(spark, folder):
    docs = _docs(spark, folder)
    walk = F.when(F.col("toxic") == 1, "NOTIFY")
    overrides = docs.filter("lang = 'es'").select("path")
    return R.prevalidate(docs, _rules(), [(walk, None)], overrides).select("doc_id", "action", "rule", "trigger")


def action_plan(spark, folder):
    """Where the rule's moves go and what happens on name collisions."""
    docs = _docs(spark, folder)
    verdicts = _rule("or").evaluate(docs).filter("verdict.matched")
    target = R.target_dir("MOVE", "", F.col("base_dir"), F.col("path"), F.col("verdict.category"))
    rows = verdicts.select("path", F.lit("MOVE").alias("action"), target.alias("target_dir"), F.md5("text").alias("hash"), F.md5(F.lower("text")).alias("loose_hash"))
    held = docs.filter("category = 'photo'").select(
        F.concat("base_dir", F.lit("/photo/"), P.basename("path")).alias("path"),
        F.when(F.col("doc_id") % 2 == 0, F.md5("text")).otherwise(F.lit("x")).alias("hash"),
        F.when(F.col("doc_id") % 3 == 0, F.md5(F.lower("text"))).otherwise(F.lit("y")).alias("loose_hash"),
    )
    return R.action_plan(rows, held)


def rule_summary(spark, folder):
    return R.rule_summary(action_plan(spark, folder))


def rotations(spark, folder):
    part = table(spark, folder, "part")
    label = F.concat((F.col("p_size") * 45).cast("string"), F.lit("_cw"))
    plan = R.rotation_plan(label)
    return part.groupBy(F.coalesce(plan, F.lit(-1)).alias("degrees")).agg(F.count(F.lit(1)).alias("n_items"))


def cacheable_verdicts(spark, folder):
    docs = R.prevalidate(_docs(spark, folder), _rules())
    keep = R.is_cacheable(F.col("action"), P.dirname("path"), F.lit("/docs/src3/"))
    return docs.groupBy("action", keep.cast("int").alias("cacheable")).agg(F.count(F.lit(1)).alias("n_docs"))


def skipped_items(spark, folder):
    docs = R.prevalidate(_docs(spark, folder), _rules())
    return docs.filter(L.is_skipped(F.col("action"), F.col("n_chars") < 50)).select("doc_id", "action")


# ------------------------------------------------------------------ decision walks


def _walk() -> D.DecisionWalk:
    C, O, N = D.Condition, D.Outcome, D.Node
    walk = D.DecisionWalk("review", [
        N("short", C("score", {"column": "length_ok", "threshold": 1}), O(), O("REJECT")),
        N("gif", C("media_type", {"media_types": ["gif"]}), O("GOTO", "toxic"), O()),
        N("words", C("prompt", {"column": "text", "prompts": ["the"]}), O("EXECUTE_AND_CONTINUE", action="ADD_MARK", modifier="w"), O()),
        N("off", C("always"), O("EXECUTE", action="DELETE"), O(), enabled=False),
        N("pair", C("group", {"operator": "OR"}, [C("column", {"column": "is_photo", "name": "photo"}), C("filename_contains", {"patterns": ["77"], "name": "named"})]),
          O("EXECUTE_AND_CONTINUE", action="BLUR"), O()),
        N("both", C("composite", {"operator": "AND"}, [C("node_result", {"node_name": "words", "expected_result": True}),
                                                       C("group_child_result", {"group_node_name": "pair", "child_node_name": "photo", "expected_result": False})]), O("EXECUTE", action="MOVE", modifier="/x"), O()),
        N("toxic", C("composite", {"operator": "XOR"}, [C("column", {"column": "toxic_flag"}), C("node_result", {"node_name": "gif"})]), O("ACCEPT"), O()),
    ], default_reject_action="HIDE")
    return D.DecisionWalk.from_dict(walk.to_dict())


def _walk_rows(spark, folder) -> DataFrame:
    docs = _docs(spark, folder).withColumns({
        "length_ok": (F.col("n_chars") >= 80).cast("int"), "is_photo": F.col("category") == "photo", "toxic_flag": F.coalesce(F.col("toxic"), F.lit(0)) == 1,
    })
    return _walk().run(docs)


def decision_walk(spark, folder):
    fired = F.array_join(F.transform("fired", lambda x: F.concat_ws(":", x["node"], x["action"], x["modifier"])), "|")
    return _walk_rows(spark, folder).select("doc_id", "final_action", fired.alias("fired"), "ended_at", "terminal")


def decision_node(spark, folder):
    docs = _docs(spark, folder)
    return _walk().run_node(docs, "words").select("doc_id", F.col("matched").cast("int").alias("matched"), "action")


def run_stats(spark, folder):
    rows = _walk_rows(spark, folder).select("source", "final_action", (F.col("n_chars") < 30).alias("failed"))
    return A.run_stats(rows, "source", "final_action", "failed")


def report_messages(spark, folder):
    rows = _walk_rows(spark, folder).select("ended_at", "terminal", "doc_id")
    out = A.report_groups(rows, ["ended_at", "terminal"], "doc_id")
    return out.select("ended_at", "terminal", "n_messages", F.array_join("shown", ",").alias("shown"), "n_more")


def _library(spark, folder):
    m = checkpoint(media(spark, folder))
    place = lambda d: m.filter(F.col("path").startswith(f"/lib/{d}/"))
    return m, place("work"), place("pool"), place("target")


def category_fill(spark, folder):
    """Missing variants of the working directory over two target directories."""
    _, work, pool, target = _library(spark, folder)
    walk = D.category_fill({"Edit": "_edit", "Small": "_small"})
    walk.default_reject_action = "HIDE"
    ready = D.prepare_category_fill(work, work, {"_edit": pool, "_small": target}, walk, limit=4)
    out = walk.run(ready)
    return out.select("path", F.array_join(F.transform("fired", lambda x: F.concat_ws(":", x["action"], x["modifier"])), "|").alias("fired"), "terminal")


def three_buckets(spark, folder):
    """Coherence variants; seeds are coherent already."""
    _, work, pool, target = _library(spark, folder)
    walk = D.three_bucket()
    ready = D.prepare_category_fill(work, work, {"_coherent": pool, "_semiinco": target, "_inco": work}, walk, limit=10)
    out = walk.run(ready, is_seed=F.lower(P.stem("path")) == F.lower(P.base_stem("path")))
    return out.select("path", F.array_join(F.transform("fired", lambda x: F.concat_ws(":", x["action"], x["modifier"])), "|").alias("fired"), "terminal")


def stem_group_roles(spark, folder):
    _, work, _, target = _library(spark, folder)
    return D.stem_group_role(work, target).select("path", "role", F.col("evaluate").cast("int").alias("evaluate"), F.col("mark_done").cast("int").alias("mark_done"))


def stem_group_gate(spark, folder):
    _, work, _, target = _library(spark, folder)
    roles = D.stem_group_role(work, target)
    return D.stem_group_gate(roles, [F.col("path")]).select("path", F.col("considered").cast("int").alias("considered"))


# ------------------------------------------------------------------ frames


def _frames(spark, folder) -> DataFrame:
    """Conversation turns as frames of an item, 0-based and gap-free."""
    return table(spark, folder, "conversations").select("conv_id", F.col("turn").alias("slot"), (F.length("text") > 300).alias("match"), F.length("text").alias("n_text"))


def frame_vote(spark, folder):
    out = A.frame_vote(_frames(spark, folder), "conv_id", F.col("match"), 0.4)
    return out.select("conv_id", "n_positive", "n_slots", F.col("matched").cast("int").alias("matched"))


def first_trigger(spark, folder):
    return A.first_trigger(_frames(spark, folder), "conv_id", "slot", F.col("match"), 0.3, 2)


def frame_samples(spark, folder):
    return A.sample_slots(_frames(spark, folder), "conv_id", "slot", 0.5, 2, 3).select("conv_id", "slot")


def seek_positions(spark, folder):
    li = table(spark, folder, "lineitem")
    ms = A.seek_position(
        F.col("l_linenumber").cast("bigint"), F.lit(10).cast("bigint"), F.col("l_quantity").cast("bigint") * 7,
        F.when(F.col("l_returnflag") == "A", 25.0).otherwise(0.0), F.when(F.col("l_returnflag") == "R", 90.0), F.when(F.col("l_linestatus") == "O", "pdf").otherwise("video"),
    )
    return li.select("l_orderkey", "l_linenumber", ms.alias("position"))


def static_items(spark, folder):
    """Items whose spread frames hardly differ in text length (relative to 2000)."""
    f = _frames(spark, folder).withColumn("vec", F.array(F.col("n_text") / 2000.0))
    return A.pseudostatic(f, "conv_id", "slot", "vec", 0.2).select("conv_id", "n_frames", F.col("is_static").cast("int").alias("is_static"))


QUERIES = {f.__name__: f for f in (
    classifier_rank, classifier_rank_negated, class_decision, neutral_classes, rule_or, rule_and, prevalidation, action_plan, rule_summary,
    rotations, cacheable_verdicts, skipped_items, decision_walk, decision_node, run_stats, report_messages, category_fill, three_buckets,
    stem_group_roles, stem_group_gate, frame_vote, first_trigger, frame_samples, seek_positions, static_items,
)}

_WIDE = f"""{PREDICTIONS_SQL},
wide AS (SELECT doc_id, max(score) FILTER (ord = 0) AS art, max(score) FILTER (ord = 1) AS draft, max(score) FILTER (ord = 2) AS photo, max(score) FILTER (ord = 3) AS scan FROM preds GROUP BY doc_id),
top AS (SELECT doc_id, arg_max(category, score * 100 - ord) AS best FROM preds GROUP BY doc_id),
cls AS (
  SELECT w.doc_id, CASE
    WHEN art + photo > 0.05 AND (art + photo >= art + draft OR NOT art + draft > 0.05) THEN CASE WHEN photo > 0 THEN 'photo' ELSE 'art' END
    WHEN art + draft > 0.05 THEN CASE WHEN art >= draft THEN 'art' ELSE 'draft' END ELSE best END AS category
  FROM wide w JOIN top USING (doc_id)),
docs AS (SELECT d.*, l.quality, l.toxic, c.category, '/docs/' || source || '/' || d.doc_id || CASE WHEN lang = 'fr' THEN '.gif' ELSE '.png' END AS path, '/docs/' || source AS base_dir
  FROM documents d LEFT JOIN labels l USING (doc_id) JOIN cls c USING (doc_id)),
the AS (SELECT *, contains(lower(text), 'the') AS has_the, coalesce(toxic = 1, false) OR n_chars < 100 AS veto FROM docs)"""
_ORV = """orv AS (SELECT *, CASE WHEN n_chars > 6000 THEN 'prototype' WHEN veto THEN NULL WHEN quality = 1 THEN 'embedding' WHEN category IN ('photo', 'art') THEN 'classifier' WHEN has_the THEN 'prompt' END AS trig FROM the)"""
_PRE = """pre AS (SELECT *, CASE WHEN base_dir = '/docs/src3' THEN NULL WHEN category = 'scan' AND lang = 'fr' THEN 'gifs'
    WHEN quality = 0 OR contains(lower(text), 'license') THEN 'moves' WHEN n_chars > 500 AND base_dir IN ('/docs/src1', '/docs/src2') THEN 'one dir' END AS rule FROM docs)"""
_PREACT = "CASE rule WHEN 'gifs' THEN 'HIDE' WHEN 'moves' THEN 'MOVE' WHEN 'one dir' THEN 'BLUR' END"
_PLAN = f"""{_ORV}, mv AS (SELECT path, doc_id, category, CASE WHEN trig = 'classifier' AND category = 'photo' THEN base_dir || '/photo' END AS dir, text, base_dir FROM orv WHERE trig IS NOT NULL),
plan AS (SELECT path, 'MOVE' AS action, CASE WHEN dir IS NULL THEN regexp_extract(path, '([^/]*)$', 1) ELSE dir || '/' || regexp_extract(path, '([^/]*)$', 1) END AS target,
  CASE WHEN dir IS NULL THEN 'no_target' WHEN category <> 'photo' THEN 'apply' WHEN doc_id % 2 = 0 THEN 'drop_source' WHEN doc_id % 3 = 0 THEN 'overwrite' ELSE 'error' END AS outcome FROM mv)"""
_WALKSQL = """w AS (SELECT *, n_chars >= 80 AS ok, lang = 'fr' AS gif, category = 'photo' AS ph, contains(regexp_extract(path, '([^/]*)$', 1), '77') AS nm, coalesce(toxic, 0) = 1 AS tox FROM the),
walk AS (SELECT *, ok AND NOT gif AS mid, ok AND NOT gif AND has_the AS f1, ok AND NOT gif AND (ph OR nm) AS f2, ok AND NOT gif AND has_the AND NOT ph AS mv FROM w),
res AS (SELECT *, CASE WHEN NOT ok THEN 'REJECT' WHEN mv THEN 'EXECUTE' WHEN tox <> gif THEN 'ACCEPT' ELSE 'EXHAUSTED' END AS terminal FROM walk),
fin AS (SELECT *, concat_ws('|', CASE WHEN NOT ok THEN 'short:HIDE:' END, CASE WHEN f1 THEN 'words:ADD_MARK:w' END, CASE WHEN f2 THEN 'pair:BLUR:' END, CASE WHEN mv THEN 'both:MOVE:/x' END) AS fired,
  CASE terminal WHEN 'REJECT' THEN 'HIDE' WHEN 'EXECUTE' THEN 'MOVE' WHEN 'EXHAUSTED' THEN CASE WHEN f2 THEN 'BLUR' WHEN f1 THEN 'ADD_MARK' END END AS final_action,
  CASE terminal WHEN 'REJECT' THEN 'short' WHEN 'EXECUTE' THEN 'both' WHEN 'ACCEPT' THEN 'toxic' ELSE '(end)' END AS ended_at FROM res)"""
_W = f"WITH {_WIDE}"
_FILL = """work AS (SELECT * FROM parts_of WHERE dir = '/lib/work')"""


def _known(stem: str, suffixes: tuple[str, ...]) -> str:
    tails = sorted({s[:k] for s in suffixes for k in range(1, len(s) + 1)})
    return f"(regexp_matches({stem}, '_({'|'.join(tails)})([_ ]*[0-9]+)?$') OR regexp_matches({stem}, '_[0-9]+$'))"


def _gate(suffix: str) -> str:
    """No derivative with the suffix in the working directory, and the file's own source is not there."""
    return f"""(NOT EXISTS (SELECT 1 FROM work e WHERE (e.related_path = a.path OR (length(e.rname) > 10 AND e.rname = a.name)
        OR (length(e.stem) > length(a.stem) AND starts_with(e.stem, a.stem) AND substr(e.stem, length(a.stem) + 1, 1) = '_')) AND {_known('e.stem', (suffix,))})
      AND NOT EXISTS (SELECT 1 FROM work e WHERE e.path = a.related_path OR (length(a.rname) > 10 AND e.name = a.rname)))"""


def _odd(suffixes: tuple[str, ...]) -> str:
    return f"EXISTS (SELECT 1 FROM work e WHERE e.base = a.base AND e.path <> a.path AND e.stem <> e.base AND NOT {_known('e.stem', suffixes)})"


def _free(directory: str) -> str:
    return f"NOT EXISTS (SELECT 1 FROM parts_of e WHERE e.dir = '/lib/{directory}' AND e.base = a.base)"


ORACLES = {
    "classifier_rank": f"""WITH {PREDICTIONS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, ord) AS k FROM preds)
      SELECT doc_id, bool_or(k BETWEEN 2 AND 3 AND category IN ('photo', 'scan') AND score >= 0.3) AS matched FROM r GROUP BY doc_id""",
    "classifier_rank_negated": f"""WITH {PREDICTIONS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, ord) AS k FROM preds)
      SELECT doc_id, NOT bool_or(k <= 2 AND category = 'art' AND score >= 0.1) AS matched FROM r GROUP BY doc_id""",
    "class_decision": f"{_W} SELECT doc_id, category FROM cls",
    "neutral_classes": "SELECT source, coalesce(string_agg(DISTINCT lang, ',' ORDER BY lang) FILTER (lang NOT IN ('en', 'fr', 'xx')), '') AS neutral FROM documents GROUP BY source",
    "rule_or": f"""{_W}, {_ORV} SELECT doc_id, (trig IS NOT NULL)::INT AS matched, trig AS trigger, CASE WHEN trig = 'classifier' AND category = 'photo' THEN 'photo' END AS category FROM orv""",
    "rule_and": f"""{_W}, r AS (SELECT *, NOT veto AND coalesce(quality = 1, false) AND category IN ('photo', 'art') AND has_the AS m FROM the)
      SELECT doc_id, m::INT AS matched, CASE WHEN m THEN 'prompt' END AS trigger, CASE WHEN m AND category = 'photo' THEN 'photo' END AS category FROM r""",
    "prevalidation": f"""{_W}, {_PRE}, p AS (SELECT *, CASE WHEN rule IS NULL AND toxic = 1 AND base_dir <> '/docs/src3' THEN 'walk 0' ELSE rule END AS ru FROM pre)
      SELECT doc_id, CASE WHEN lang = 'es' THEN NULL WHEN ru = 'walk 0' THEN 'NOTIFY' ELSE {_PREACT} END AS action, CASE WHEN lang <> 'es' THEN ru END AS rule,
        CASE WHEN lang = 'es' THEN NULL WHEN ru = 'gifs' THEN 'classifier' WHEN ru = 'moves' THEN CASE WHEN quality = 0 THEN 'embedding' ELSE 'prompt' END WHEN ru = 'one dir' THEN 'embedding' END AS trigger FROM p""",
    "action_plan": f"{_W}, {_PLAN} SELECT * FROM plan",
    "rule_summary": f"""{_W}, {_PLAN} SELECT count(*) AS n_checked, count(*) AS n_matched, count(*) FILTER (outcome = 'apply') AS n_moves, 0::BIGINT AS n_copies, 0::BIGINT AS n_deletes,
      count(*) FILTER (outcome IN ('error', 'no_target')) AS n_errors FROM plan""",
    "rotations": "SELECT CASE WHEN (p_size * 45) % 90 = 0 THEN (p_size * 45) % 360 ELSE -1 END::INT AS degrees, count(*) AS n_items FROM part GROUP BY 1",
    "cacheable_verdicts": f"""{_W}, {_PRE} SELECT {_PREACT} AS action, CASE WHEN rule = 'moves' AND base_dir <> '/docs/src3' THEN 0 ELSE 1 END AS cacheable, count(*) AS n_docs FROM pre GROUP BY 1, 2""",
    "skipped_items": f"{_W}, {_PRE} SELECT doc_id, {_PREACT} AS action FROM pre WHERE n_chars < 50 OR rule IN ('gifs', 'moves')",
    "decision_walk": f"{_W}, {_WALKSQL} SELECT doc_id, final_action, fired, ended_at, terminal FROM fin",
    "decision_node": f"{_W} SELECT doc_id, has_the::INT AS matched, CASE WHEN has_the THEN 'ADD_MARK' END AS action FROM the",
    "run_stats": f"""{_W}, {_WALKSQL}, s AS (SELECT source, coalesce(final_action, '(no action)') AS act, (n_chars < 30)::INT AS e FROM fin)
      SELECT source AS directory, act AS action, count(*) AS n_evaluated, sum(e)::BIGINT AS n_errors, grouping(source, act)::INT AS level FROM s GROUP BY ROLLUP (source, act)""",
    "report_messages": f"""{_W}, {_WALKSQL}, r AS (SELECT ended_at, terminal, doc_id, row_number() OVER (PARTITION BY ended_at, terminal ORDER BY doc_id) AS k FROM fin)
      SELECT ended_at, terminal, count(*) AS n_messages, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) FILTER (k <= 8) AS shown, greatest(count(*) - 8, 0) AS n_more FROM r GROUP BY 1, 2""",
    "category_fill": f"""WITH {MEDIA_SQL}, {_FILL}, c AS (SELECT a.path, {_odd(('edit', 'small'))} AS odd, (SELECT count(*) FROM parts_of e WHERE e.dir IN ('/lib/pool', '/lib/target') AND e.base = a.base) > 4 AS over,
        {_gate('edit')} AND {_free('pool')} AS g1, {_gate('small')} AND {_free('target')} AS g2 FROM work a)
      SELECT path, CASE WHEN odd OR over THEN 'HIDE:' ELSE concat_ws('|', CASE WHEN g1 THEN 'GENERATE:_edit' END, CASE WHEN g2 THEN 'GENERATE:_small' END) END AS fired,
        CASE WHEN odd OR over THEN 'REJECT' ELSE 'EXHAUSTED' END AS terminal FROM c""",
    "three_buckets": f"""WITH {MEDIA_SQL}, {_FILL}, c AS (SELECT a.path, a.stem = a.base AS seed, {_odd(('coherent', 'semiinco', 'inco'))} AS odd,
        {_gate('coherent')} AND {_free('pool')} AS g1, {_gate('semiinco')} AND {_free('target')} AS g2, {_gate('inco')} AND {_free('work')} AS g3 FROM work a)
      SELECT path, CASE WHEN odd THEN '' ELSE concat_ws('|', CASE WHEN g1 AND NOT seed THEN 'GENERATE:_coherent' END, CASE WHEN g2 THEN 'SCRAMBLE:_semiinco' END, CASE WHEN g3 THEN 'SCRAMBLE:_inco' END) END AS fired,
        CASE WHEN odd THEN 'REJECT' ELSE 'EXHAUSTED' END AS terminal FROM c""",
    "stem_group_roles": f"""WITH {MEDIA_SQL}, {_FILL}, r AS (SELECT a.path, CASE
        WHEN a.stem = a.base THEN CASE WHEN EXISTS (SELECT 1 FROM parts_of t WHERE t.dir = '/lib/target' AND t.stem = a.base) THEN 'seed' ELSE 'unfiled_seed' END
        WHEN EXISTS (SELECT 1 FROM work s WHERE s.stem = a.base) THEN 'derivative' WHEN a.related_path IS NULL THEN 'no_pointer'
        WHEN EXISTS (SELECT 1 FROM parts_of t WHERE t.dir = '/lib/target' AND t.name = a.rname) OR EXISTS (SELECT 1 FROM parts_of t WHERE t.dir IN ('/lib/target', '/lib/work') AND t.path = a.related_path) THEN 'source_derivative'
        ELSE 'unfiled_pointer' END AS role FROM work a)
      SELECT path, role, (role IN ('seed', 'derivative', 'source_derivative'))::INT AS evaluate, (role <> 'derivative')::INT AS mark_done FROM r""",
    "stem_group_gate": f"""WITH {MEDIA_SQL}, {_FILL}, r AS (SELECT a.path, a.base, NOT (a.stem <> a.base AND EXISTS (SELECT 1 FROM work s WHERE s.stem = a.base)) AS done FROM work a)
      SELECT path, (NOT EXISTS (SELECT 1 FROM r q WHERE q.base = r.base AND q.done AND q.path < r.path))::INT AS considered FROM r""",
    "frame_vote": """SELECT conv_id, sum((length(text) > 300)::INT)::BIGINT AS n_positive, count(*) AS n_slots, (sum((length(text) > 300)::INT) >= ceil(count(*) * 0.4))::INT AS matched FROM conversations GROUP BY conv_id""",
    "first_trigger": """SELECT conv_id, min(turn) FILTER (length(text) > 300) AS slot, count(*) FILTER (length(text) > 300) AS n_positive FROM conversations WHERE turn >= 2 GROUP BY conv_id
      HAVING count(*) FILTER (length(text) > 300) >= greatest(1, ceil(count(*) * 0.3))""",
    "frame_samples": """WITH t AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id), c AS (SELECT conv_id, n, least(greatest(floor(n * 0.5), 2), 3, n)::BIGINT AS c FROM t),
      s AS (SELECT *, greatest(1, n // c) AS step FROM c) SELECT conv_id, turn AS slot FROM conversations JOIN s USING (conv_id) WHERE turn % step = 0 AND turn // step < c""",
    "seek_positions": """WITH f AS (SELECT l_orderkey, l_linenumber, l_quantity::BIGINT * 7 AS total, l_returnflag AS r, l_linestatus AS s FROM lineitem)
      SELECT l_orderkey, l_linenumber, CASE WHEN s = 'O' THEN l_linenumber * greatest(1, total // 10) WHEN r = 'A' THEN floor(l_linenumber * greatest(1, total // 10) / 25.0::DOUBLE * 1000)
        WHEN r = 'R' THEN floor(l_linenumber / 9::DOUBLE * 90.0 * 1000) END::BIGINT AS position FROM f""",
    "static_items": """WITH n AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id), f AS (SELECT conv_id, turn, length(text) / 2000.0 AS x FROM conversations),
      p AS (SELECT n.conv_id, n.n, max(x) FILTER (turn = 0) AS f0, max(x) FILTER (turn = 1) AS f1, max(x) FILTER (turn = n.n - 1) AS fz, max(x) FILTER (turn = n.n // 2) AS fm FROM f JOIN n USING (conv_id) GROUP BY n.conv_id, n.n)
      SELECT conv_id, n AS n_frames, CASE WHEN n <= 1 THEN 1 WHEN abs(f0 - f1) < 0.2 AND (n <= 2 OR abs(f0 - fz) < 0.2) AND (n <= 3 OR abs(fm - fz) < 0.2) THEN 1 ELSE 0 END AS is_static FROM p""",
}
