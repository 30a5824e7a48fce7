"""Registered queries; importing the modules fills the registry."""

import importlib
import pkgutil

from warmgrid.plans.registry import QUERIES

for _m in sorted(m.name for m in pkgutil.iter_modules(__path__)):
    if _m.startswith("q_"):
        importlib.import_module(f"{__name__}.{_m}")

__all__ = ["QUERIES"]
