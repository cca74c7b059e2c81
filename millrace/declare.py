"""How a query joins the catalogue.

A query is a function (spark, sf_dir) -> DataFrame.  ``@query(sql)`` registers it under its own name
together with SQL of the same result for another engine.
"""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable[[Callable], Callable]:
    def register(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = oracle
        return f

    return register
