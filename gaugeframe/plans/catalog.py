"""Imports every module that registers queries."""

import importlib

from gaugeframe.plans.registry import ORACLES, QUERIES

MODULES = ("measure", "audit", "collections", "decisions", "fields")
for _name in MODULES:
    importlib.import_module(f"gaugeframe.plans.{_name}")

__all__ = ["ORACLES", "QUERIES"]
