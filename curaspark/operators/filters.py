"""Data filters: trees of size and model constraints compiled to one predicate column."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _any_contains(candidates: Column, name: str) -> Column:
    return F.exists(candidates, lambda c: F.contains(F.lower(c), F.lit(name)))


@dataclass
class SizeFilter:
    """Width and height limits; every active limit must hold, unknown dimensions fail."""

    min_size: tuple[int, int] | None = None
    max_size: tuple[int, int] | None = None
    exact_size: tuple[int, int] | None = None
    size_tolerance: int = 0

    @property
    def active(self) -> bool:
        return any(v is not None for v in (self.min_size, self.max_size, self.exact_size))

    def to_column(self, width="width", height="height", **_) -> Column:
        w, h = F.col(width), F.col(height)
        keep = w.isNotNull() & h.isNotNull()
        if self.exact_size is not None:
            ew, eh = self.exact_size
            keep = keep & (F.abs(w - ew) <= self.size_tolerance) & (F.abs(h - eh) <= self.size_tolerance)
        if self.min_size is not None:
            keep = keep & (w >= self.min_size[0]) & (h >= self.min_size[1])
        if self.max_size is not None:
            keep = keep & (w <= self.max_size[0]) & (h <= self.max_size[1])
        return F.coalesce(keep, F.lit(False))

    def to_dict(self) -> dict:
        def pair(v):
            return list(v) if v else None

        return {
            "type": "size", "min_size": pair(self.min_size), "max_size": pair(self.max_size),
            "exact_size": pair(self.exact_size), "size_tolerance": self.size_tolerance,
        }


@dataclass
class ModelFilter:
    """Case-insensitive substring test of names against an item's models (and LoRAs)."""

    models: list[str] | None = None
    mode: str = "include"
    match_any: bool = False
    include_loras: bool = True

    @property
    def active(self) -> bool:
        return bool(self.models)

    def to_column(self, models="models", loras="loras", **_) -> Column:
        empty = F.array().cast("array<string>")
        candidates = F.coalesce(F.col(models), empty)
        if self.include_loras:
            candidates = F.concat(candidates, F.coalesce(F.col(loras), empty))
        found = None
        for name in self.models or []:
            one = F.coalesce(_any_contains(candidates, name.lower()), F.lit(False))
            found = one if found is None else (found | one if self.match_any else found & one)
        if found is None:
            return F.lit(True)
        return found if self.mode == "include" else ~found

    def to_dict(self) -> dict:
        return {
            "type": "model", "models": self.models, "mode": self.mode,
            "match_any": self.match_any, "include_loras": self.include_loras,
        }


@dataclass
class FilterGroup:
    """AND / OR / NOT over child filters; NOT drops rows any child accepts. Inactive children do not count."""

    operator: str = "and"
    filters: list = field(default_factory=list)

    @property
    def active(self) -> bool:
        return any(f.active for f in self.filters)

    def to_column(self, **columns) -> Column:
        parts = [f.to_column(**columns) for f in self.filters if f.active]
        if not parts:
            return F.lit(True)
        total = parts[0]
        for p in parts[1:]:
            total = total & p if self.operator == "and" else total | p
        return ~total if self.operator == "not" else total

    def to_dict(self) -> dict:
        return {"type": "group", "operator": self.operator, "filters": [f.to_dict() for f in self.filters]}


def filter_to_dict(f) -> dict | None:
    return None if f is None else f.to_dict()


def filter_from_dict(d: dict | None):
    """Rebuild a filter tree; an unknown operator falls back to AND, an unknown type is dropped."""
    if not d:
        return None

    def pair(name):
        return tuple(d[name]) if d.get(name) else None

    kind = d.get("type")
    if kind == "size":
        return SizeFilter(pair("min_size"), pair("max_size"), pair("exact_size"), d.get("size_tolerance", 0))
    if kind == "model":
        return ModelFilter(
            d.get("models"), d.get("mode", "include"), d.get("match_any", False), d.get("include_loras", True)
        )
    if kind == "group":
        operator = d.get("operator", "and")
        children = [filter_from_dict(c) for c in d.get("filters", [])]
        return FilterGroup(
            operator if operator in ("and", "or", "not") else "and", [c for c in children if c is not None]
        )
    return None


def apply_filter(df: DataFrame, tree, keep: Column | None = None, **columns) -> DataFrame:
    """Filter rows by a tree; rows meeting ``keep`` (the search reference) stay in any case."""
    if tree is None or not tree.active:
        return df
    test = tree.to_column(**columns)
    return df.filter(test if keep is None else test | F.coalesce(keep, F.lit(False)))


# ------------------------------------------------------------------ resolution predicates


def higher_than(w: Column, h: Column, max_w: int, max_h: int, inclusive: bool = False) -> Column:
    """Both sides exceed (or reach) their bounds; a zero bound is off."""
    tests = [(c >= b if inclusive else c > b) for c, b in ((w, max_w), (h, max_h)) if b]
    out = F.lit(True)
    for t in tests:
        out = out & t
    return out


def lower_than(w: Column, h: Column, max_w: int, max_h: int, inclusive: bool = False) -> Column:
    tests = [(c <= b if inclusive else c < b) for c, b in ((w, max_w), (h, max_h)) if b]
    out = F.lit(True)
    for t in tests:
        out = out & t
    return out


def equal_size(w: Column, h: Column, ew: int, eh: int) -> Column:
    return (w == ew) & (h == eh)


# ------------------------------------------------------------------ set operations on keys


def union_keys(key: str, *frames: DataFrame) -> DataFrame:
    total = frames[0].select(key)
    for f in frames[1:]:
        total = total.unionByName(f.select(key))
    return total.distinct()


def intersect_keys(key: str, *frames: DataFrame) -> DataFrame:
    total = frames[0].select(key).distinct()
    for f in frames[1:]:
        total = total.join(f.select(key), key, "left_semi")
    return total


def except_keys(df: DataFrame, key: str, *frames: DataFrame) -> DataFrame:
    for f in frames:
        df = df.join(f.select(key), key, "left_anti")
    return df


def neutral_categories(categories: Column, groups: Column) -> Column:
    """Categories that appear in no positive group."""
    return F.array_except(categories, F.flatten(groups))


def same_set(a: Column, b: Column) -> Column:
    """Equality of two arrays ignoring order and repeats."""
    return F.sort_array(F.array_distinct(a)) == F.sort_array(F.array_distinct(b))


# ------------------------------------------------------------------ search by dimensions


def search_by_dimension(df: DataFrame, w: int, h: int, aspect: bool = False, tolerance: float = 0.01,
                        width: str = "width", height: str = "height") -> DataFrame:
    """Rows of exactly w×h, and with ``aspect`` also rows whose ratio is within the tolerance."""
    exact = (F.col(width) == w) & (F.col(height) == h)
    kind = F.when(exact, "exact")
    if aspect:
        near = F.abs(F.col(width) / F.col(height) - F.lit(w / h)) <= tolerance
        kind = kind.when((F.col(height) > 0) & near, "ratio")
    return df.withColumn("match", kind).filter(F.col("match").isNotNull())


def is_skipped(verdict: Column, hidden: Column, visible: Sequence[str] = ("NOTIFY", "BLUR", "GENERATE", "ROTATE")) -> Column:
    """Hidden rows and rows whose verdict is not one of the visible actions are skipped."""
    return F.coalesce(hidden, F.lit(False)) | (verdict.isNotNull() & ~verdict.isin(*visible))
