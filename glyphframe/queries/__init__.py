"""The registered queries of the engine's own operators, by area."""

from __future__ import annotations

from . import analysis, tabular, visual  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
