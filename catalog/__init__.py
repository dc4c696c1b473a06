"""Checked queries over the generic test tables, grouped like the operators."""

from __future__ import annotations

import importlib

MODULES = ["summaries", "tables", "learning", "blending", "calibrating", "training"]


def all_queries():
    from catalog.base import QUERIES

    for module in MODULES:
        importlib.import_module(f"catalog.{module}")
    return QUERIES
