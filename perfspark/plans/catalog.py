"""Imports every query module so that the registry is complete."""

import importlib
import pkgutil

import perfspark.plans as _plans
from perfspark.plans.registry import ORACLES, QUERIES

for _m in sorted(m.name for m in pkgutil.iter_modules(_plans.__path__)):
    if _m.startswith("q_"):
        importlib.import_module(f"perfspark.plans.{_m}")

__all__ = ["ORACLES", "QUERIES"]
