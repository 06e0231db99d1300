"""Imports every query module so that the registry is complete."""

import importlib
import pkgutil

import queries

for module in sorted(m.name for m in pkgutil.iter_modules(queries.__path__)):
    if module not in {"base", "catalog"}:
        importlib.import_module(f"queries.{module}")
