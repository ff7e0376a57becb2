"""Demonstration queries, one or more per operator, over the given tables."""

from __future__ import annotations

import importlib
import pkgutil

from .base import ORACLES, QUERIES


def catalogue():
    """Import every query module once and return (queries, sql)."""
    for info in pkgutil.iter_modules(__path__):
        importlib.import_module(f"{__name__}.{info.name}")
    return QUERIES, ORACLES
