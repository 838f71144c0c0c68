"""Imports every query module once."""

from importlib import import_module

MODULES = ["capacity", "series", "tables", "inventory", "backups", "locks", "health", "usage", "alerts", "sources", "streams"]


def load() -> None:
    for name in MODULES:
        import_module(f"fleetlens.plans.{name}")
