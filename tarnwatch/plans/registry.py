"""Collects the registered queries and their oracle SQL from the plan modules."""

from __future__ import annotations

import importlib

MODULES = ["traffic", "alerting", "signature", "intel", "preparation", "reporting", "behaviour", "correlation", "streamed", "modelling", "stored"]


def _collect(attribute: str) -> dict:
    out: dict = {}
    for name in MODULES:
        part = getattr(importlib.import_module(f"tarnwatch.plans.{name}"), attribute)
        clash = set(out) & set(part)
        if clash:
            raise ValueError(f"registered twice: {sorted(clash)}")
        out.update(part)
    return out


def queries() -> dict:
    return _collect("QUERIES")


def oracle_sql() -> dict:
    return _collect("ORACLE")
