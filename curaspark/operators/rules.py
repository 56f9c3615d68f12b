"""Rules: any/all combinations of checks with a veto, target directories and action plans."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curaspark.functions import paths as P
from curaspark.functions import text as X

# Action names, those whose verdict may be cached, those needing a target directory.
ACTIONS = ("SKIP", "HIDE", "NOTIFY", "MOVE", "COPY", "DELETE", "ADD_MARK", "BLUR", "GENERATE", "ROTATE", "SCRAMBLE")
UNCACHED_ACTIONS = ("MOVE", "COPY", "DELETE")
TARGET_ACTIONS = ("MOVE", "COPY")
# Order in which the checks of a rule are tried after the prototype and the veto.
CHECK_ORDER = ("embedding", "classifier", "prompt", "filename", "base_stem")


@dataclass
class Rule:
    """Named checks over the columns of an item table.

    ``checks`` maps 'prototype', 'embedding', 'classifier', 'prompt', 'filename', 'base_stem' to
    boolean columns; ``veto`` is a boolean column; ``category`` is the predicted category for
    classifier matches.
    """

    name: str
    action: str = "NOTIFY"
    modifier: str = ""
    mode: str = "or"
    checks: dict[str, Column] = field(default_factory=dict)
    veto: Column | None = None
    category: Column | None = None
    selected: Sequence[str] = ()
    media_types: Sequence[str] | None = None
    directories: Sequence[str] | None = None
    is_active: bool = True

    def verdict(self) -> Column:
        """struct<matched, trigger, category>; checks are tried lazily in their fixed order."""
        no = self._row(F.lit(False), F.lit(None).cast("string"), None)
        veto = F.coalesce(self.veto, F.lit(False)) if self.veto is not None else F.lit(False)
        order = [c for c in CHECK_ORDER if c in self.checks]

        def ok(c: str) -> Column:
            return F.coalesce(self.checks[c], F.lit(False))

        if self.mode == "and":
            if not self.checks:
                return no
            every = ~veto
            for c in (["prototype"] if "prototype" in self.checks else []) + order:
                every = every & ok(c)
            last = ([c for c in ["prototype"] if c in self.checks] + order)[-1]
            return F.when(every, self._row(F.lit(True), F.lit(last), self._category("classifier" in order))).otherwise(no)
        out = None
        if "prototype" in self.checks:
            # a prototype match comes before the veto
            out = F.when(ok("prototype"), self._row(F.lit(True), F.lit("prototype"), None))
        out = out.when(veto, no) if out is not None else F.when(veto, no)
        for c in order:
            out = out.when(ok(c), self._row(F.lit(True), F.lit(c), self._category(c == "classifier")))
        return out.otherwise(no)

    def _category(self, wanted: bool) -> Column | None:
        if not wanted or self.category is None:
            return None
        return F.when(self.category.isin(*self.selected), self.category) if self.selected else self.category

    @staticmethod
    def _row(matched: Column, trigger: Column, category: Column | None) -> Column:
        cat = category if category is not None else F.lit(None).cast("string")
        return F.struct(matched.alias("matched"), trigger.alias("trigger"), cat.alias("category"))

    def evaluate(self, df: DataFrame, name: str = "verdict") -> DataFrame:
        return df.withColumn(name, self.verdict())


def lookahead_veto(df: DataFrame, lookaheads: Sequence[Column]) -> Column:
    """Any lookahead that holds vetoes the rule."""
    out = F.lit(False)
    for test in lookaheads:
        out = out | F.coalesce(test, F.lit(False))
    return out


def classifier_match(mode: str, category: Column, selected: Sequence[str], positive_groups: Sequence[Sequence[str]] = ()) -> Column:
    """'selected': predicted category is selected; 'strategy': it belongs to any positive group."""
    names = list(selected) if mode == "selected" else sorted({c for g in positive_groups for c in g})
    return category.isin(*names) if names else F.lit(False)


def target_dir(action: str, modifier: str, base_dir: Column, path: Column, category: Column) -> Column:
    """Target directory: the fixed one, else base directory / category for moves."""
    if modifier:
        return F.lit(modifier.rstrip("/"))
    if action != "MOVE":
        return F.lit(None).cast("string")
    base = F.coalesce(F.nullif(X.strip(base_dir), F.lit("")), P.dirname(path))
    return F.when(category.isNotNull(), F.concat_ws("/", F.regexp_replace(base, "/+$", ""), category))


def action_plan(verdicts: DataFrame, existing: DataFrame, content: str | None = None) -> DataFrame:
    """Plan rows (path, action, target, outcome) from (path, action, target_dir[, content hash]).

    ``existing`` has (path[, hash, loose_hash]) of files already there. A move onto an existing
    name drops the source when contents are identical, overwrites when they are equal apart from
    metadata, and is an error otherwise.
    """
    dest = F.concat_ws("/", F.col("target_dir"), P.basename("path"))
    rows = verdicts.filter("action is not null").withColumn(
        "target", F.when(F.col("action").isin(*TARGET_ACTIONS), dest)
    )
    held = existing.select(F.col("path").alias("target"), F.col("hash").alias("_h"), F.col("loose_hash").alias("_l"), F.lit(True).alias("_held"))
    joined = rows.join(held, "target", "left")
    home = P.dirname("path") == F.col("target_dir")
    clash = F.coalesce("_held", F.lit(False))
    outcome = (
        F.when(~F.col("action").isin(*TARGET_ACTIONS), "apply")
        .when(F.col("target_dir").isNull(), "no_target")
        .when(home, "already_there")
        .when(~clash, "apply")
        .when((F.col("action") == "MOVE") & (F.col("_h") == F.col("hash")), "drop_source")
        .when((F.col("action") == "MOVE") & (F.col("_l") == F.col("loose_hash")), "overwrite")
        .otherwise("error")
    )
    return joined.select("path", "action", "target", outcome.alias("outcome"))


def rotation_plan(category: Column, modifier: str = "") -> Column:
    """Degrees to rotate, null when unknown; 0 means nothing to do."""
    return X.rotation_degrees(F.lit(modifier) if modifier else category)


def prevalidate(df: DataFrame, rules: Sequence[Rule], walks: Sequence[tuple[Column, Sequence[str] | None]] = (),
                overrides: DataFrame | None = None, base_dir: str = "base_dir", path: str = "path") -> DataFrame:
    """First action of the rules in order, then of the decision walks (action column, directories).

    Nothing applies in a directory that is a rule's move or copy target, nor to overridden paths.
    A rule may be limited to directories and media types. Adds (action, rule, trigger).
    """
    active = [r for r in rules if r.is_active]
    excluded = [r.modifier.rstrip("/") for r in active if r.action in TARGET_ACTIONS and r.modifier]
    base = F.col(base_dir)
    choices = []
    for r in active:
        v = r.verdict()
        gate = v["matched"]
        if r.directories is not None:
            gate = gate & (base.isin(*r.directories) if r.directories else F.lit(False))
        if r.media_types is not None:
            gate = gate & P.media_type(path).isin(*r.media_types)
        choices.append(F.when(gate, F.struct(F.lit(r.action).alias("action"), F.lit(r.name).alias("rule"), v["trigger"].alias("trigger"))))
    for number, (action, directories) in enumerate(walks):
        gate = action.isNotNull()
        if directories is not None:
            gate = gate & base.isin(*directories)
        choices.append(F.when(gate, F.struct(action.alias("action"), F.lit(f"walk {number}").alias("rule"), F.lit(None).cast("string").alias("trigger"))))
    pick = F.coalesce(*choices)
    if excluded:
        pick = F.when(~F.coalesce(base.isin(*excluded), F.lit(False)), pick)
    out = df.withColumn("_v", pick)
    if overrides is not None:
        known = overrides.select(F.col("path").alias("_op")).distinct().withColumn("_ov", F.lit(True))
        out = out.join(known, F.col(path) == F.col("_op"), "left").withColumn("_v", F.when(F.col("_ov").isNull(), F.col("_v"))).drop("_op", "_ov")
    return out.select(*df.columns, "_v.action", "_v.rule", "_v.trigger")


def is_cacheable(action: Column, directory: Column, target: Column) -> Column:
    """Whether a verdict may be kept: none, any harmless action, or a move that is already done."""
    done = (action == "MOVE") & (F.regexp_replace(directory, "/+$", "") == F.regexp_replace(target, "/+$", ""))
    return action.isNull() | ~action.isin(*UNCACHED_ACTIONS) | F.coalesce(done, F.lit(False))


def rule_summary(plan: DataFrame) -> DataFrame:
    """Totals of a bulk run: checked, matched, moves, copies, deletes, errors."""

    def n(test: Column) -> Column:
        return F.sum(F.coalesce(test, F.lit(False)).cast("int")).cast("bigint")

    done = F.col("outcome") == "apply"
    return plan.agg(
        F.count(F.lit(1)).alias("n_checked"), n(F.col("action").isNotNull()).alias("n_matched"),
        n((F.col("action") == "MOVE") & done).alias("n_moves"), n((F.col("action") == "COPY") & done).alias("n_copies"),
        n(F.col("action") == "DELETE").alias("n_deletes"), n(F.col("outcome").isin("error", "no_target")).alias("n_errors"),
    )
