"""Queries over the test tables, each next to the SQL that must agree with it."""

from __future__ import annotations

import importlib

MODULES = ["explore", "prepare", "balance", "models", "flagship"]


def load_all():
    from evenkeel.workloads.registry import QUERIES, SQL

    for name in MODULES:
        importlib.import_module(f"evenkeel.workloads.{name}")
    return dict(QUERIES), dict(SQL)
