"""The catalogue: every query of the engine with, where SQL can say it, its oracle."""

from __future__ import annotations

from .declare import ORACLES, QUERIES
from .functions import extension, scalar
from .operators import control, exchange, integrity, metrics, placement, relational
from .sources import formats, framed
from .streaming import twins

MODULES = (exchange, integrity, placement, control, metrics, relational, scalar, extension, formats, framed, twins)

__all__ = ["MODULES", "ORACLES", "QUERIES"]
