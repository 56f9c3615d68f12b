"""All registered queries and SQL twins."""

from __future__ import annotations

from importlib import import_module

THEMES = ("vectors", "texts", "files", "history", "rules", "streams")


def _modules():
    for theme in THEMES:
        yield import_module(f"curaspark.plans.catalog_{theme}")


def queries() -> dict:
    out: dict = {}
    for m in _modules():
        out.update(m.QUERIES)
    return out


def oracle_sql() -> dict:
    out: dict = {}
    for m in _modules():
        out.update(m.ORACLES)
    return out
