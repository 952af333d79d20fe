"""Registered queries: import every module so the registry is complete."""

from __future__ import annotations

import importlib

from .registry import ORACLES, QUERIES

_MODULES = [
    "faq_queries",
    "positional_queries",
    "markdown_queries",
    "text_queries",
    "llm_queries",
    "history_queries",
    "vector_queries",
    "source_queries",
    "stream_queries",
]

for _m in _MODULES:
    importlib.import_module(f"{__name__}.{_m}")

__all__ = ["QUERIES", "ORACLES"]
