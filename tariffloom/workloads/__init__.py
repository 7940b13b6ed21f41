"""The registered queries, grouped by theme."""

from __future__ import annotations

from importlib import import_module

from tariffloom.workloads.registry import WORKLOADS, Workload

THEMES = ("prices", "tariffs", "texts", "grids", "matching", "notices")


def all_workloads() -> dict[str, Workload]:
    for theme in THEMES:
        import_module(f"tariffloom.workloads.{theme}")
    return WORKLOADS
