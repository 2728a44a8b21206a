"""Imports every module that registers queries."""

from __future__ import annotations

from importlib import import_module

MODULES = ("metric_queries", "label_queries", "source_queries", "split_queries", "routing_queries", "learn_queries")


def load() -> None:
    for name in MODULES:
        import_module(f"selroute.plans.{name}")
