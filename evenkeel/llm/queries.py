"""All queries of the operators and their SQL; importing a module registers its query."""

from __future__ import annotations

import importlib

MODULES = ["line_quality", "pii", "lm_score", "chat_format", "chosen_path", "decontaminate", "line_dedup", "secrets", "url_filters", "pieces",
           "prefix_trie", "cross_tokens", "license_scan"]


def load_all():
    from evenkeel.llm.common import QUERIES, SQL

    for name in MODULES:
        importlib.import_module(f"evenkeel.llm.{name}")
    return dict(QUERIES), dict(SQL)
