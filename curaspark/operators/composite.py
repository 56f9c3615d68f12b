"""Several compare modes run together: their scores or groups are combined into one result.

All enabled instances search or all of them group. In a search by text alone, an instance whose mode cannot search by text and
that has no text of its own is skipped; it still counts as a mode (and a weight) that found nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curaspark.operators import agg as A
from curaspark.operators import cluster as C
from curaspark.session import checkpoint

#: Modes whose vectors texts can be compared with.
TEXT_MODES = ("embedding",)


@dataclass(frozen=True)
class Instance:
    """One configured run: ``search`` gives (id, score), ``group`` gives (id, group_id, score); scores as the mode has them."""

    name: str
    mode: str
    search: Callable[[], DataFrame] | None = None
    group: Callable[[], DataFrame] | None = None
    weight: float = 1.0
    own_text: bool = False
    enabled: bool = True


@dataclass(frozen=True)
class CompositeCompare:
    """``logic``: and (in every mode, geometric mean), or (in any mode, best score), weighted (mean over instances)."""

    instances: Sequence[Instance]
    logic: str = "and"
    by_item: bool = False
    by_text: bool = False

    def __post_init__(self):
        if self.logic not in ("and", "or", "weighted"):
            raise ValueError(f"unknown logic {self.logic}")

    def plan(self) -> tuple[bool, list[Instance], list[Instance]]:
        """(whether this is a search, instances that run, instances that are skipped)."""
        enabled = [i for i in self.instances if i.enabled]
        if not enabled:
            raise ValueError("no enabled instance")
        searching = self.by_item or self.by_text
        if len({searching or i.own_text for i in enabled}) > 1:
            raise ValueError("all instances must search or all must group")
        search = searching or enabled[0].own_text
        skipped = [i for i in enabled if searching and not self.by_item and i.mode not in TEXT_MODES and not i.own_text]
        if skipped and len(skipped) == len(enabled):
            raise ValueError("no mode of this composite can search by text")
        return search, [i for i in enabled if i not in skipped], skipped

    def _combine(self, results: list[tuple[Instance, DataFrame]]) -> DataFrame:
        """(id, score) on [0, 1] from (id, score) of every instance that ran."""
        enabled = [i for i in self.instances if i.enabled]
        scores = None
        for instance, found in results:
            mode = instance.name if self.logic == "weighted" else instance.mode
            rows = found.select("id", F.lit(mode).alias("mode"), A.normalize_score(F.col("score"), instance.mode).alias("score"))
            scores = rows if scores is None else scores.unionByName(rows)
        if self.logic == "weighted":
            return A.combine_weighted(scores, {i.name: i.weight for i in enabled})
        if self.logic == "and":
            return A.combine_and(scores, len({i.mode for i in enabled}))
        return A.combine_or(scores)

    def search(self) -> DataFrame:
        """(id, score) of a composite search."""
        search, running, _ = self.plan()
        if not search:
            raise ValueError("no instance has anything to search for")
        return self._combine([(i, i.search()) for i in running])

    def groups(self, primary: str | None = None) -> DataFrame:
        """(id, group_id, score): the groups of the primary instance (the first one by default), reduced to the items of the
        combined result; groups below two members go, the rest are numbered anew."""
        search, running, _ = self.plan()
        if search:
            raise ValueError("instances search; there are no groups")
        primary = primary or running[0].name
        found = {i.name: checkpoint(i.group()) for i in running}
        kept = self._combine([(i, found[i.name].select("id", "score")) for i in running])
        return C.filter_groups(found[primary], kept.select("id"))
