"""All queries of the library: importing this module fills the registry."""

from __future__ import annotations

from importlib import import_module

from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]

for _name in ("claims", "candidates", "vectors", "texts", "names", "truths", "models", "flagship"):
    import_module(f"tessera.plans.{_name}")
