"""Queries of the task store over the sample tables, each with its oracle."""

from __future__ import annotations

from importlib import import_module

MODULES = ("inspect", "metrics", "transitions", "scalars", "workflow", "streams")


def load() -> None:
    for m in MODULES:
        import_module(f"millrace.queries.{m}")
