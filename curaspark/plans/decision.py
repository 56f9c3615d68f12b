"""Decision walks: ordered nodes with outcomes, compiled to columns in one pass over the nodes.

Jumps only go forward, so a fold over the nodes with a few state columns decides every row; no row
is ever walked on its own.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curaspark.functions import paths as P
from curaspark.functions import text as X

OUTCOMES = ("CONTINUE", "GOTO", "EXECUTE", "EXECUTE_AND_CONTINUE", "ACCEPT", "REJECT")
NEEDS_ACTION = ("EXECUTE", "EXECUTE_AND_CONTINUE")


@dataclass
class Outcome:
    kind: str = "CONTINUE"
    target: str | None = None
    action: str | None = None
    modifier: str = ""

    def to_dict(self) -> dict:
        return {"outcome_type": self.kind, "target_node": self.target, "action_type": self.action, "action_modifier": self.modifier}

    @staticmethod
    def from_dict(d: dict) -> Outcome:
        return Outcome(d.get("outcome_type", "CONTINUE"), d.get("target_node"), d.get("action_type"), d.get("action_modifier", ""))


@dataclass
class Condition:
    """A condition by type name with its settings; ``children`` for composites and groups."""

    kind: str = "always"
    options: dict = field(default_factory=dict)
    children: list = field(default_factory=list)

    def to_dict(self) -> dict:
        return {"condition_type": self.kind, **self.options, **({"sub_conditions": [c.to_dict() for c in self.children]} if self.children else {})}

    @staticmethod
    def from_dict(d: dict) -> Condition:
        options = {k: v for k, v in d.items() if k not in ("condition_type", "sub_conditions")}
        return Condition(d.get("condition_type", "embedding"), options, [Condition.from_dict(c) for c in d.get("sub_conditions", [])])


@dataclass
class Node:
    name: str
    condition: Condition
    on_match: Outcome = field(default_factory=Outcome)
    on_no_match: Outcome = field(default_factory=lambda: Outcome("ACCEPT"))
    enabled: bool = True

    def to_dict(self) -> dict:
        d = {"name": self.name, "condition": self.condition.to_dict(), "on_match": self.on_match.to_dict(), "on_no_match": self.on_no_match.to_dict()}
        return d if self.enabled else {**d, "enabled": False}

    @staticmethod
    def from_dict(d: dict) -> Node:
        return Node(
            d.get("name", ""), Condition.from_dict(d.get("condition", {"condition_type": "embedding"})),
            Outcome.from_dict(d.get("on_match", {})), Outcome.from_dict(d.get("on_no_match", {})), d.get("enabled", True),
        )


# ------------------------------------------------------------------ conditions

Builder = Callable[[dict], Column]


def _prompt(o: dict) -> Column:
    terms = o.get("blacklist", []) if o.get("use_blacklist") else o.get("prompts", [])
    return X.prompt_condition(o.get("column", "positive"), terms)


# Condition types that need other rows. ``DecisionWalk.prepare`` joins a boolean column for each.
JOINED = ("classifier_rank", "audio_classifier_rank", "base_stem_match", "unknown_suffix", "related_image")


def joined_name(kind: str, options: dict) -> str:
    """Name of the column that a condition of type ``kind`` is joined as: the same settings share one column."""
    settings = json.dumps({k: v for k, v in options.items() if k != "column"}, sort_keys=True, default=str)
    return f"_{kind}_{zlib.crc32(settings.encode()):08x}"


def _joined(kind: str) -> Builder:
    return lambda o: F.col(o.get("column") or joined_name(kind, o)).cast("boolean")


# Condition types by name: those of the row's own columns, and the joined ones.
CONDITIONS: dict[str, Builder] = {
    **{kind: _joined(kind) for kind in JOINED},
    "always": lambda o: F.lit(True),
    "column": lambda o: F.col(o["column"]).cast("boolean"),
    "prompt": _prompt,
    "filename_contains": lambda o: P.filename_contains(o.get("column", "path"), o.get("patterns", []), o.get("case_sensitive", False)),
    "media_type": lambda o: P.media_type(o.get("column", "path")).isin(*o.get("media_types", [""])),
    "embedding": lambda o: F.col(o.get("column", "text_score")) > o.get("threshold", 0.23),
    "prototype": lambda o: F.col(o.get("column", "prototype_score")) >= o.get("threshold", 0.23),
    "lookahead": lambda o: F.col(o.get("column", "lookahead_score")) > o.get("threshold", 0.23),
    "score": lambda o: F.col(o["column"]) >= o.get("threshold", 0.0),
}


@dataclass
class DecisionWalk:
    name: str
    nodes: list[Node]
    default_action: str | None = None
    default_reject_action: str | None = None
    is_active: bool = True
    media_types: Sequence[str] | None = None
    category_map: dict[str, str] = field(default_factory=dict)
    seed_category: str = ""
    run_sort_by: str | None = None

    # -------------------------------------------------------------- JSON

    def to_dict(self) -> dict:
        return {
            "name": self.name, "nodes": [n.to_dict() for n in self.nodes], "default_action": self.default_action,
            "default_reject_action": self.default_reject_action, "is_active": self.is_active,
            "applies_to_media_types": list(self.media_types) if self.media_types is not None else None,
            "category_map": self.category_map, "seed_category": self.seed_category, "run_sort_by": self.run_sort_by,
        }

    @staticmethod
    def from_dict(d: dict) -> DecisionWalk:
        return DecisionWalk(
            d.get("name", ""), [Node.from_dict(n) for n in d.get("nodes", [])], d.get("default_action"), d.get("default_reject_action"),
            d.get("is_active", True), d.get("applies_to_media_types"), d.get("category_map", {}), d.get("seed_category", ""), d.get("run_sort_by"),
        )

    # -------------------------------------------------------------- checks

    def validate(self) -> list[str]:
        """Configuration errors; an empty list means the walk can run."""
        errors = []
        if not self.name.strip():
            errors.append("the walk has no name")
        if self.seed_category and self.seed_category not in self.category_map:
            errors.append(f"seed category {self.seed_category!r} is not a category")
        for category, suffix in self.category_map.items():
            core = suffix.lstrip("_ ")
            if core and core.isdigit():
                errors.append(f"suffix of {category!r} is only digits")
        names = [n.name for n in self.nodes]
        for i, node in enumerate(self.nodes):
            if not node.name.strip():
                errors.append("a node has no name")
            elif node.name in names[:i]:
                errors.append(f"node name {node.name!r} occurs twice")
            for outcome in (node.on_match, node.on_no_match):
                if outcome.kind not in OUTCOMES:
                    errors.append(f"node {node.name!r}: unknown outcome {outcome.kind!r}")
                if outcome.kind == "GOTO":
                    if not outcome.target or outcome.target not in names:
                        errors.append(f"node {node.name!r}: jump to unknown node {outcome.target!r}")
                    elif names.index(outcome.target) <= i:
                        errors.append(f"node {node.name!r}: jump to {outcome.target!r} does not go forward")
                if outcome.kind in NEEDS_ACTION and outcome.action is None:
                    errors.append(f"node {node.name!r}: {outcome.kind} without an action")
            errors += self._condition_errors(node.condition, node.name, set(names[:i]))
        return errors

    def _condition_errors(self, c: Condition, node: str, before: set[str]) -> list[str]:
        errors = []
        o = c.options
        if c.kind not in CONDITIONS and c.kind not in ("node_result", "group_child_result", "composite", "group"):
            errors.append(f"node {node!r}: unknown condition type {c.kind!r}")
        if c.kind in ("classifier_rank", "audio_classifier_rank"):
            low, high = o.get("min_rank", 1), o.get("max_rank", 1)
            if low < 1 or high < low:
                errors.append(f"node {node!r}: ranks {low} to {high} are no range")
            if not o.get("categories") and not (o.get("inherit_categories") and self.category_map):
                errors.append(f"node {node!r}: no categories to rank")
        if c.kind == "filename_contains" and not any(str(p).strip() for p in o.get("patterns", [])):
            errors.append(f"node {node!r}: no file name pattern")
        if c.kind == "unknown_suffix" and not o.get("expected_suffixes"):
            errors.append(f"node {node!r}: no expected suffixes")
        if c.kind == "related_image" and not str(o.get("edit_suffix", "")).strip():
            errors.append(f"node {node!r}: no suffix of the related file")
        if c.kind == "node_result" and c.options.get("node_name") not in before:
            errors.append(f"node {node!r}: refers to {c.options.get('node_name')!r}, which is not an earlier node")
        if c.kind == "composite":
            least = {"XOR": 2}.get(c.options.get("operator", "AND"), 1)
            if len(c.children) < least:
                errors.append(f"node {node!r}: composite needs {least} or more conditions")
        for child in c.children:
            errors += self._condition_errors(child, node, before)
        return errors

    def warnings(self) -> list[str]:
        """Settings that run but hardly mean what was intended."""
        notes = []
        if not self.nodes:
            notes.append("the walk has no nodes")
        reached = {0}
        for i, n in enumerate(self.nodes):
            if i not in reached:
                notes.append(f"node {n.name!r} is never reached")
                continue
            for o in (n.on_match, n.on_no_match):
                if o.kind == "GOTO":
                    reached.update(k for k, m in enumerate(self.nodes) if m.name == o.target)
                elif o.kind in ("CONTINUE", "EXECUTE_AND_CONTINUE"):
                    reached.add(i + 1)
            if not n.enabled:
                notes.append(f"node {n.name!r} is disabled")
                reached.add(i + 1)
            if n.on_match.to_dict() == n.on_no_match.to_dict():
                notes.append(f"node {n.name!r} does the same on match and no match")
        if any(o.kind == "REJECT" for n in self.nodes for o in (n.on_match, n.on_no_match)) and self.default_reject_action is None:
            notes.append("nodes reject but there is no reject action")
        return notes

    # -------------------------------------------------------------- evaluation

    def _test(self, c: Condition, leaf: Callable[[Condition], Column], known: Callable[[str], Column]) -> Column:
        """Condition as a column; ``leaf`` gives tests of the row itself, ``known`` earlier results (null if none)."""
        o = c.options
        if c.kind in ("node_result", "group_child_result"):
            name = o.get("node_name") if c.kind == "node_result" else f"{o.get('group_node_name')}/{o.get('child_node_name')}"
            return F.coalesce(known(name) == F.lit(bool(o.get("expected_result", True))), F.lit(False))
        if c.kind in ("composite", "group"):
            operator = o.get("operator", "AND" if c.kind == "composite" else "OR")
            parts = [self._test(child, leaf, known) for child in c.children]
            if operator == "NOT":
                return ~parts[0]
            if operator == "XOR":
                return parts[0] != parts[1]
            out = F.lit(operator == "AND")
            for part in parts:
                out = out & part if operator == "AND" else out | part
            return out
        return leaf(c)

    def prepare(self, df: DataFrame, predictions: dict[str, DataFrame] | None = None, directories: dict[str, DataFrame] | None = None,
                working: DataFrame | None = None, path: str = "path") -> DataFrame:
        """``df`` with a boolean column for every condition that needs other rows, so that ``run`` can read it by name.

        ``predictions``: (path, category, score, ord) by classifier name; ``directories``: (path, ...) by search directory;
        ``working``: the files of the working directory (by default ``df``). Conditions with the same settings share a column.
        """
        from curaspark.operators.agg import rank_condition

        predictions, directories = predictions or {}, directories or {}
        work = df if working is None else working
        done: set[str] = set()
        for node in self.nodes:
            for c in self._leaves(node.condition) if node.enabled else []:
                o = c.options
                if c.kind not in JOINED or o.get("column") or (name := joined_name(c.kind, o)) in done:
                    continue
                done.add(name)
                if c.kind in ("classifier_rank", "audio_classifier_rank"):
                    categories = list(self.category_map) if o.get("inherit_categories") and self.category_map else o.get("categories", [])
                    found = rank_condition(
                        predictions[o.get("classifier_name", "")], path, categories, o.get("min_rank", 1), o.get("max_rank", 1),
                        o.get("min_confidence", 0.0), o.get("negate", False),
                    )
                    df = df.join(found.withColumnRenamed("matched", name), path, "left")
                    continue
                near = o.get("use_working_directory") or o.get("use_base_directory") or not o.get("search_directory")
                files = work if near and c.kind != "related_image" else directories.get(o.get("search_directory", ""))
                if c.kind == "base_stem_match":
                    only = o.get("suffix_filter", [])
                    only = [only] if isinstance(only, str) and only else list(only or [])
                    df = add_stem_match(df, files, name, only, o.get("require_match", True), o.get("max_stem_group_size", 0), path)
                elif c.kind == "unknown_suffix":
                    best = None
                    if (preds := predictions.get(o.get("classifier_name", ""))) is not None:
                        best = preds.groupBy(path).agg(F.max("score").alias("score"))
                    df = add_unknown_suffix(df, files, name, o.get("expected_suffixes", []), best, o.get("inference_threshold", 0.85), path)
                else:
                    places = list(directories.values()) if o.get("use_configured_search_directories", True) else [files]
                    df = add_related_image(df, places, name, o.get("edit_suffix", ""), o.get("count_threshold", 1))
        return df

    @staticmethod
    def _leaves(c: Condition) -> list[Condition]:
        if c.kind in ("composite", "group"):
            return [x for child in c.children for x in DecisionWalk._leaves(child)]
        return [] if c.kind in ("node_result", "group_child_result") else [c]

    def run(self, df: DataFrame, is_seed: Column | None = None, path: str = "path") -> DataFrame:
        """Add (final_action, fired, ended_at, terminal) to every row.

        ``fired`` lists the actions in order as (action, modifier, node); ``terminal`` is how the
        walk ended. Inactive walks and media types the walk does not apply to leave nulls.

        The tests of the row are one array column. The walk itself is one fold over the node
        numbers, so the expression grows with the number of nodes and not with the paths through
        them.
        """
        errors = self.validate()
        if errors:
            raise ValueError("; ".join(errors))
        seed_suffix = self.category_map.get(self.seed_category, "") if self.seed_category else ""
        applies = F.lit(self.is_active and bool(self.nodes))
        if self.media_types is not None:
            applies = applies & P.media_type(path).isin(*self.media_types)
        order = {n.name: i for i, n in enumerate(self.nodes)}
        live = [(i, n) for i, n in enumerate(self.nodes) if n.enabled]
        leaves = [c for _, n in live for c in self._leaves(n.condition)]
        place = {id(c): k for k, c in enumerate(leaves)}
        tests = [F.coalesce(CONDITIONS[c.kind](c.options), F.lit(False)) for c in leaves]
        seed = F.coalesce(is_seed, F.lit(False)) if is_seed is not None else F.lit(False)
        ready = df.withColumn("_leaf", F.array(seed, *tests)).withColumn("_applies", applies)

        def leaf(c: Condition) -> Column:
            return F.get(F.col("_leaf"), F.lit(place[id(c)] + 1))

        entry_type = "struct<action:string,modifier:string,node:string>"
        empty = F.struct(
            F.when(F.col("_applies"), F.lit(0)).alias("at"), F.array().cast(f"array<{entry_type}>").alias("fired"),
            F.lit(None).cast("string").alias("end"), F.lit(None).cast("string").alias("final"), F.lit(None).cast("string").alias("where"),
            F.create_map().cast("map<string,boolean>").alias("res"),
        )

        def entry(action: str | None, modifier: str, node: str) -> Column:
            return F.struct(F.lit(action).alias("action"), F.lit(modifier).alias("modifier"), F.lit(node).alias("node")).cast(entry_type)

        def step(acc: Column, number: Column) -> Column:
            def known(name: str) -> Column:
                return F.element_at(acc["res"], name)

            test, extra = F.lit(None).cast("boolean"), F.create_map().cast("map<string,boolean>")
            for i, n in live:
                one = self._test(n.condition, leaf, known)
                if seed_suffix and n.on_match.action == "GENERATE" and n.on_match.modifier == seed_suffix:
                    one = one & ~F.get(F.col("_leaf"), F.lit(0))
                test = F.when(number == i, one).otherwise(test)
                if n.condition.kind == "group":
                    named = []
                    for k, child in enumerate(n.condition.children):
                        named += [F.lit(f"{n.name}/{child.options.get('name', k)}"), self._test(child, leaf, known)]
                    if named:
                        extra = F.when(number == i, F.create_map(*named)).otherwise(extra)
            here = acc["end"].isNull() & (acc["at"] <= number)
            code = F.when(here, number * 2 + F.when(test, 0).otherwise(1))

            def settle(state: Column, code: Column) -> Column:
                return F.when(code.isNull(), state).otherwise(moved(state, code, extra))

            return F.aggregate(F.array(code), acc, settle)

        def moved(acc: Column, code: Column, extra: Column) -> Column:
            at, fire = acc["at"], F.lit(None).cast(entry_type)
            end, final, where = (F.lit(None).cast("string") for _ in range(3))
            names = F.lit(None).cast("string")
            for i, n in live:
                for side, o in ((0, n.on_match), (1, n.on_no_match)):
                    hit = code == 2 * i + side
                    at = F.when(hit, F.lit(order[o.target] if o.kind == "GOTO" else i + 1)).otherwise(at)
                    action = self.default_reject_action if o.kind == "REJECT" else o.action if o.kind in NEEDS_ACTION else None
                    if action is not None:
                        fire = F.when(hit, entry(action, "" if o.kind == "REJECT" else o.modifier, n.name)).otherwise(fire)
                    if o.kind in ("EXECUTE", "ACCEPT", "REJECT"):
                        end = F.when(hit, F.lit(o.kind)).otherwise(end)
                        where = F.when(hit, F.lit(n.name)).otherwise(where)
                        if o.kind != "ACCEPT":
                            final = F.when(hit, F.lit(action).cast("string")).otherwise(final)
                names = F.when(F.floor(code / 2) == i, F.lit(n.name)).otherwise(names)
            return F.struct(
                at.alias("at"), F.when(fire.isNull(), acc["fired"]).otherwise(F.concat(acc["fired"], F.array(fire))).alias("fired"),
                end.alias("end"), final.alias("final"), where.alias("where"),
                F.map_concat(acc["res"], F.create_map(names, code % 2 == 0), extra).alias("res"),
            )

        walked = ready.withColumn("_w", F.aggregate(F.lit([i for i, _ in live]).cast("array<int>"), empty, step))
        fired, ended = F.col("_w.fired"), F.col("_w.end")
        exhausted = ended.isNull() & F.col("_w.at").isNotNull()
        last = F.try_element_at(fired, F.lit(-1))["action"]
        default = F.lit(self.default_action).cast("string")
        closing = F.concat(fired, F.array(entry(self.default_action, "", "(default)"))) if self.default_action is not None else fired
        return walked.select(
            *df.columns,
            F.when(exhausted, F.coalesce(default, last)).otherwise(F.col("_w.final")).alias("final_action"),
            F.when(exhausted, closing).otherwise(fired).alias("fired"),
            F.when(exhausted, "(end)").otherwise(F.col("_w.where")).alias("ended_at"),
            F.when(exhausted, "EXHAUSTED").otherwise(ended).alias("terminal"),
        )

    def run_node(self, df: DataFrame, name: str) -> DataFrame:
        """Evaluate one node alone: (matched, action). Earlier results count as missing."""
        node = next(n for n in self.nodes if n.name == name)
        test = self._test(
            node.condition, lambda c: F.coalesce(CONDITIONS[c.kind](c.options), F.lit(False)), lambda name: F.lit(None).cast("boolean")
        )

        def act(o: Outcome) -> Column:
            action = o.action if o.kind in NEEDS_ACTION else self.default_reject_action if o.kind == "REJECT" else None
            return F.lit(action).cast("string")

        return df.withColumn("matched", test).withColumn("action", F.when(F.col("matched"), act(node.on_match)).otherwise(act(node.on_no_match)))


# ------------------------------------------------------------------ conditions that need other rows


def add_stem_match(df: DataFrame, files: DataFrame, name: str, suffixes: Sequence[str] = (), require: bool = True,
                   limit: int = 0, path: str = "path") -> DataFrame:
    """Boolean column: files sharing the base stem exist (or, with a limit, are more than the limit)."""
    from curaspark.operators.relate import stem_matches

    rows = df.withColumn("_b", P.base_stem(path))
    found = stem_matches(rows.select(F.col("_b").alias("base_stem")), files)
    if suffixes:
        found = found.filter(P.known_suffix(P.stem("path"), list(suffixes)))
    counts = found.groupBy("base_stem").agg(F.count(F.lit(1)).alias("_n"))
    n = F.coalesce("_n", F.lit(0))
    test = n > limit if limit > 0 else (n > 0 if require else n == 0)
    return rows.join(counts, F.col("_b") == F.col("base_stem"), "left").withColumn(name, (F.length("_b") > 0) & test).drop("_b", "_n", "base_stem")


def add_unknown_suffix(df: DataFrame, files: DataFrame, name: str, expected: Sequence[str], top1: DataFrame | None = None,
                       threshold: float = 0.85, path: str = "path") -> DataFrame:
    """Boolean column: another file of the stem group has a suffix that is not expected.

    ``top1`` (path, score) holds the best prediction per file; a confident one resolves the file.
    Unknown files are counted per stem, and a file does not count against itself.
    """
    from curaspark.operators.relate import stem_matches

    rows = df.withColumn("_b", P.base_stem(path))
    found = stem_matches(rows.select(F.col("_b").alias("base_stem")), files).select("base_stem", F.col("path").alias("_f"))
    stem = P.stem("_f")
    odd = found.filter((F.lower(stem) != F.lower("base_stem")) & ~P.known_suffix(stem, list(expected)))
    if top1 is not None:
        sure = top1.filter(F.col("score") >= threshold).select(F.col("path").alias("_f"))
        odd = odd.join(sure, "_f", "left_anti")
    counts = odd.groupBy("base_stem").agg(F.count(F.lit(1)).alias("_n"))
    own = odd.select(F.col("_f").alias("_own"), F.col("base_stem").alias("_ob"), F.lit(1).alias("_self"))
    return (
        rows.join(counts, F.col("_b") == F.col("base_stem"), "left")
        .join(own, (F.col(path) == F.col("_own")) & (F.col("_b") == F.col("_ob")), "left")
        .withColumn(name, F.coalesce("_n", F.lit(0)) - F.coalesce("_self", F.lit(0)) > 0)
        .drop("_b", "base_stem", "_n", "_own", "_ob", "_self")
    )


def add_related_image(df: DataFrame, directories: Sequence[DataFrame], name: str, suffix: str, threshold: int = 1) -> DataFrame:
    """Boolean column: the generation gate is open in every search directory."""
    from curaspark.operators.relate import should_generate

    out = df
    names = []
    for number, entries in enumerate(directories):
        gate = should_generate(df, entries, suffix, threshold).select("path", F.col("generate").alias(f"_g{number}"))
        out = out.join(gate, "path", "left")
        names.append(f"_g{number}")
    every = F.lit(bool(names))
    for n in names:
        every = every & F.coalesce(n, F.lit(False))
    return out.withColumn(name, every).drop(*names)


def stem_group_role(df: DataFrame, targets: DataFrame, path: str = "path") -> DataFrame:
    """Role of every file in its stem group: (evaluate, mark_done, role).

    ``df`` has (path, related_path) of the working set, ``targets`` (path) of the target
    directories. Seeds need a filed copy in a target directory; derivatives follow their seed when
    it is in the same directory, else they need a related file that is filed.
    """
    stem, base = F.lower(P.stem(path)), F.lower(P.base_stem(path))
    rows = df.withColumn("_b", base).withColumn("_d", P.dirname(path)).withColumn("_seed", stem == base)
    filed = targets.select(F.lower(P.stem("path")).alias("_b")).distinct().withColumn("_filed", F.lit(True))
    seeds = df.select(F.lower(P.stem(path)).alias("_b"), P.dirname(path).alias("_d")).distinct().withColumn("_here", F.lit(True))
    names = targets.select(P.basename("path").alias("_rn")).distinct().withColumn("_known", F.lit(True))
    known_paths = targets.select("path").unionByName(df.select("path")).distinct().select(F.col("path").alias("_rp"), F.lit(True).alias("_onpath"))
    joined = (
        rows.join(filed, "_b", "left").join(seeds, ["_b", "_d"], "left")
        .withColumn("_rn", P.basename("related_path")).join(names, "_rn", "left")
        .join(known_paths, F.col("related_path") == F.col("_rp"), "left")
    )
    found = F.coalesce("_known", "_onpath", F.lit(False))
    role = (
        F.when(F.col("_seed"), F.when(F.coalesce("_filed", F.lit(False)), "seed").otherwise("unfiled_seed"))
        .when(F.coalesce("_here", F.lit(False)), "derivative")
        .when(F.coalesce(F.col("related_path"), F.lit("")) == "", "no_pointer")
        .when(~found, "unfiled_pointer")
        .otherwise("source_derivative")
    )
    return joined.withColumn("role", role).select(
        *df.columns, F.col("_b").alias("group_stem"), "role",
        F.col("role").isin("seed", "derivative", "source_derivative").alias("evaluate"),
        (F.col("role") != "derivative").alias("mark_done"),
    )


def stem_group_gate(df: DataFrame, order: list[Column]) -> DataFrame:
    """Rows of a stem group that are still looked at: none after the first row that marks the group done.

    Needs (group_stem, mark_done); the first marking position per group is an aggregate, so no
    group is sorted in one task.
    """
    from curaspark.scale import row_index

    indexed = row_index(df, order, "run_pos")
    done = indexed.groupBy("group_stem").agg(F.min(F.when(F.col("mark_done"), F.col("run_pos"))).alias("_done"))
    return indexed.join(done, "group_stem", "left").withColumn(
        "considered", F.col("_done").isNull() | (F.col("run_pos") <= F.col("_done"))
    ).drop("_done")


# ------------------------------------------------------------------ ready-made walks


def _category_walk(name: str, categories: dict[str, str], actions: dict[str, str], seed: str = "") -> DecisionWalk:
    """Guard, uniqueness check and one node per category, over the columns 'unknown_suffix',
    'stem_overflow', 'gate<suffix>' and 'free<suffix>'."""

    def col(c: str) -> Condition:
        return Condition("column", {"column": c})

    nodes = [
        Node("No foreign variants", Condition("composite", {"operator": "NOT"}, [col("unknown_suffix")]), Outcome(), Outcome("REJECT")),
        Node("Not too many filed", col("stem_overflow"), Outcome("REJECT"), Outcome()),
    ]
    for category, suffix in categories.items():
        both = Condition("composite", {"operator": "AND"}, [col(f"gate{suffix}"), col(f"free{suffix}")])
        nodes.append(
            Node(f"{actions[category].title()} {category}", both, Outcome("EXECUTE_AND_CONTINUE", action=actions[category], modifier=suffix), Outcome())
        )
    return DecisionWalk(name, nodes, category_map=dict(categories), seed_category=seed)


def category_fill(categories: dict[str, str]) -> DecisionWalk:
    """Generate the missing categories of every stem group (category → suffix)."""
    return _category_walk("category fill", categories, {c: "GENERATE" for c in categories})


def three_bucket(coherent: str = "_coherent", semi: str = "_semiinco", incoherent: str = "_inco") -> DecisionWalk:
    """Generate a coherent and scramble two less coherent variants of every stem group."""
    categories = {"Coherent": coherent, "Semi-incoherent": semi, "Incoherent": incoherent}
    actions = {"Coherent": "GENERATE", "Semi-incoherent": "SCRAMBLE", "Incoherent": "SCRAMBLE"}
    return _category_walk("three buckets", categories, actions, seed="Coherent")


def prepare_category_fill(df: DataFrame, working: DataFrame, targets: dict[str, DataFrame], walk: DecisionWalk, limit: int | None = None) -> DataFrame:
    """Join the columns a category walk reads: guard, overflow, gates and free targets per suffix.

    The files of all targets are matched with the base stems once and counted per target; the derivatives of all
    suffixes are counted once. The number of joins does not depend on the number of categories.
    """
    from curaspark.operators.relate import downstream_counts, stem_matches
    from curaspark.session import checkpoint

    suffixes = list(walk.category_map.values())
    missing = [s for s in suffixes if s not in targets]
    if missing:
        raise KeyError(f"no target for {missing}")
    filed = None
    for suffix, t in targets.items():
        part = t.select("path", F.lit(suffix).alias("_target"))
        filed = part if filed is None else filed.unionByName(part)
    # one table, so that neither the stems nor the guard are computed again in the joins below
    rows = checkpoint(add_unknown_suffix(df, working, "unknown_suffix", suffixes).withColumn("_b", P.base_stem("path")))
    found = stem_matches(rows.select(F.col("_b").alias("base_stem")), filed, more=["_target"])
    per_target = [F.count_if(F.col("_target") == s) for s in suffixes]
    counts = found.groupBy("base_stem").agg(F.count(F.lit(1)).alias("_n"), F.array(*per_target).alias("_per_target"))
    gates = downstream_counts(df, working, suffixes)
    out = rows.join(counts, F.col("_b") == F.col("base_stem"), "left").join(gates, "path", "left")
    named = F.length("_b") > 0
    columns = {"stem_overflow": named & (F.coalesce("_n", F.lit(0)) > (limit or len(suffixes) + 1))}
    for i, suffix in enumerate(suffixes):
        open_gate = ~F.col("own_source") & (F.get("n_downstream", F.lit(i)) < 1)
        columns[f"gate{suffix}"] = F.coalesce(open_gate, F.lit(False))
        columns[f"free{suffix}"] = named & (F.coalesce(F.get("_per_target", F.lit(i)), F.lit(0)) == 0)
    out = out.withColumns(columns).drop("_b", "base_stem", "_n", "_per_target", "own_source", "n_downstream")
    return checkpoint(out)  # a walk reads its columns many times
