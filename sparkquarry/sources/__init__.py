"""Scans of the project's tables."""

from sparkquarry.sources.tables import load, spread

__all__ = ["load", "spread"]
