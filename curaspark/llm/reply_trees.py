"""Conversations from reply trees: paths from root to leaf, ranked by score, each formatted as one conversation.

Pointers to the parent are doubled by self-joins until every message knows its depth, its root and the score of its path;
the leaves of a tree are ranked by that score (ties: the smaller id). The chosen paths are then unfolded with
the same tables, halving path lengths, so that both directions take a logarithmic number of joins however deep
a tree is, and no table grows beyond the messages or the paths' total length.

Messages without tree or id belong to no tree. A parent that is null, unknown or the message itself makes a root;
messages on a cycle of parents have no root and are left out. Of repeated (tree, id) rows the one with the least
content counts. Null roles and texts are empty.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from curaspark.llm.common import per_batch
from curaspark.session import checkpoint

#: The template: a turn is START role newline text END newline.
START, END = "<|im_start|>", "<|im_end|>"
#: Strings that chat models read as control; in contents a backslash goes behind their first letter.
CONTROLS = (START, END, "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")

_RISKY = re.compile(r"\\|" + "|".join(map(re.escape, CONTROLS)))
_ESCAPED = re.compile(r"\\([\\n]?)")


def escape(text: str) -> str:
    """Break up control strings; backslashes are doubled so that the change can be undone."""
    return _RISKY.sub(lambda m: "\\\\" if m[0] == "\\" else f"{m[0][0]}\\{m[0][1:]}", text)


def escape_role(role: str) -> str:
    return escape(role).replace("\n", "\\n")


def unescape(text: str) -> str:
    """Undo ``escape`` and ``escape_role``: a pair of backslashes is one, a single one goes, with n it is a newline."""
    return _ESCAPED.sub(lambda m: {"\\": "\\", "n": "\n"}.get(m[1], ""), text)


def render(turns: list[tuple[str, str]], learn: str = "assistant") -> tuple[str, list[tuple[int, int]]]:
    """(formatted text, spans under the loss mask): the spans cover the escaped texts of role ``learn``."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{START}{escape_role(role)}\n", escape(text)
        if role == learn:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, f"{END}\n"]
        at += len(head) + len(body) + len(END) + 1
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """Turns read back from a formatted conversation."""
    turns = []
    for part in formatted.split(START)[1:]:
        role, _, rest = part.partition("\n")
        turns.append((unescape(role), unescape(rest[: rest.rindex(END)])))
    return turns


# ------------------------------------------------------------------ trees


class Paths:
    """Depths, path scores and pointer tables of all messages: (tree, id, parent, score, ...) rows."""

    def __init__(self, messages: DataFrame, tree: str = "tree", ident: str = "id", parent: str = "parent", score: str = "score"):
        rows = messages.select(
            F.col(tree).alias("tree"), F.col(ident).alias("id"), F.col(parent).alias("parent"),
            F.coalesce(F.col(score).cast("double"), F.lit(0.0)).alias("score"),
        ).filter("tree is not null and id is not null")
        rows = rows.groupBy("tree", "id").agg(F.min(F.struct("parent", "score")).alias("m")).select("tree", "id", "m.parent", "m.score")
        rows = rows.withColumn("parent", F.when(F.col("parent") != F.col("id"), F.col("parent")))
        known = rows.select("tree", F.col("id").alias("parent"), F.lit(True).alias("known"))
        rows = rows.join(known, ["tree", "parent"], "left").withColumn("up", F.when(F.col("known"), F.col("parent")))
        # level k: the ancestor 2**k above, null beyond the root; hops and score up to it
        level = checkpoint(rows.select("tree", "id", "up", F.lit(1).cast("bigint").alias("hops"), "score"))
        self.levels = []
        waiting = None
        while True:
            self.levels.append(level.filter("up is not null").select("tree", "id", "up"))
            left = level.filter("up is not null").count()
            if left == 0 or left == waiting:  # none is left, or only cycles are
                break
            waiting = left
            above = level.select("tree", F.col("id").alias("up"), F.col("up").alias("next"), F.col("hops").alias("more"), F.col("score").alias("extra"))
            # only messages that have not reached their root are joined
            moved = level.filter("up is not null").join(above, ["tree", "up"]).select(
                "tree", "id", F.col("next").alias("up"), (F.col("hops") + F.col("more")).alias("hops"), (F.col("score") + F.col("extra")).alias("score")
            )
            level = checkpoint(level.filter("up is null").unionByName(moved))
        #: every message with a root: the number of messages on its path, and their scores' sum
        self.nodes = level.filter("up is null").select("tree", "id", F.col("hops").alias("length"), "score")
        self.parents = rows.filter("up is not null").select("tree", F.col("up").alias("id")).distinct()

    def leaves(self, branches: int | None = 1) -> DataFrame:
        """(tree, leaf, rank, length, score): the best branches of every tree, or all of them."""
        ends = self.nodes.join(self.parents, ["tree", "id"], "left_anti")
        order = Window.partitionBy("tree").orderBy(F.desc("score"), "id")
        ranked = ends.withColumn("rank", F.row_number().over(order))
        if branches is not None:
            ranked = ranked.filter(F.col("rank") <= branches)
        return ranked.select("tree", F.col("id").alias("leaf"), "rank", "length", "score")

    def unfold(self, leaves: DataFrame) -> DataFrame:
        """(tree, leaf, id, place): the messages of every path, the root at place 0."""
        todo = checkpoint(leaves.select("tree", "leaf", F.col("leaf").alias("id"), "length", F.lit(0).cast("bigint").alias("below")))
        for k in reversed(range(len(self.levels))):
            step = 1 << k
            long = todo.filter(F.col("length") > step)
            jump = long.join(self.levels[k], ["tree", "id"]).select(
                "tree", "leaf", F.col("up").alias("id"), (F.col("length") - step).alias("length"), (F.col("below") + step).alias("below")
            )
            todo = checkpoint(todo.withColumn("length", F.least("length", F.lit(step))).unionByName(jump))
        sizes = leaves.select("tree", "leaf", F.col("length").alias("all"))
        return todo.join(sizes, ["tree", "leaf"]).select("tree", "leaf", "id", (F.col("all") - 1 - F.col("below")).alias("place"))


def conversations(messages: DataFrame, branches: int | None = 1, learn: str = "assistant") -> DataFrame:
    """(tree, leaf, rank, formatted, spans) of the chosen paths; ``messages``: (tree, id, parent, role, text, score).

    ``spans`` (start, stop) lie under the loss mask. A conversation is one output row, so it is gathered in one task.
    """
    paths = Paths(messages)
    leaves = checkpoint(paths.leaves(branches))
    content = messages.filter("tree is not null and id is not null").groupBy("tree", "id").agg(
        F.min(F.struct(F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))).alias("m")
    )
    full = paths.unfold(leaves).join(content, ["tree", "id"])
    gathered = full.groupBy("tree", "leaf").agg(F.sort_array(F.collect_list(F.struct("place", "m.role", "m.text"))).alias("turns"))
    gathered = gathered.join(leaves.select("tree", "leaf", "rank"), ["tree", "leaf"]).select("tree", "leaf", "rank", "turns")

    def make(columns: list[list]) -> list[list]:
        done = [render([(t["role"], t["text"]) for t in turns], learn) for turns in columns[3]]
        return [*columns[:3], [f for f, _ in done], [[{"start": a, "stop": b} for a, b in s] for _, s in done]]

    kinds = {f.name: f.dataType.simpleString() for f in gathered.schema}
    schema = f"tree {kinds['tree']}, leaf {kinds['leaf']}, rank int, formatted string, spans array<struct<start: int, stop: int>>"
    return per_batch(gathered, make, schema)


def read_back(formatted: DataFrame) -> DataFrame:
    """(tree, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) from formatted conversations alone."""

    def make(columns: list[list]) -> list[list]:
        out: list[list] = [columns[0], [], [], [], [], []]
        for text, spans in zip(columns[1], columns[2]):
            turns = parse(text)
            learnt = "".join(unescape(text[s["start"] : s["stop"]]) for s in spans)
            out[1].append(len(turns))
            out[2].append(hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest())
            out[3].append(len(learnt))
            out[4].append(hashlib.sha256(learnt.encode()).hexdigest())
            out[5].append(len(text))
        return out

    kind = formatted.schema["tree"].dataType.simpleString()
    schema = f"tree {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    return per_batch(formatted.select("tree", "formatted", "spans"), make, schema)


def chains(rows: DataFrame, tree: str, order: list[str], role: str = "role", text: str = "text") -> DataFrame:
    """Messages of conversations that are kept as ordered rows: each row replies to the one before it."""
    by = Window.partitionBy("tree").orderBy(*[F.col(c) for c in order], F.col(role), F.col(text))
    rows = rows.filter(F.col(tree).isNotNull()).withColumn("tree", F.col(tree))
    rows = rows.withColumn("id", F.row_number().over(by).cast("bigint"))
    return rows.select(
        "tree", "id", F.when(F.col("id") > 1, F.col("id") - 1).alias("parent"), F.col(role).alias("role"), F.col(text).alias("text"),
        F.lit(0.0).alias("score"),
    )
