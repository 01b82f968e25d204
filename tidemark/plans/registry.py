"""Registry of queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from tidemark.plans.domain_sql import with_ctes

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, uses: str = ""):
    """Register ``fn(domain) -> DataFrame``; ``sql`` is its twin over the CTEs named in ``uses``."""

    def register(fn):
        from tidemark.plans.domain import Domain

        def run(spark, sf_dir):
            return fn(Domain(spark, sf_dir))

        run.__doc__ = fn.__doc__
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = with_ctes(uses.split(), sql)
        return fn

    return register
