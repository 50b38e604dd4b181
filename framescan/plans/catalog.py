"""Registry of named queries: ``name -> (spark builder, DuckDB oracle SQL)``.

Every builder takes ``(spark, sf_dir)`` and returns a DataFrame over the whole
given tables (or data Spark derives from them).  The oracle SQL computes the
same result in DuckDB over the same parquet tables; it is ``None`` for the
few operators that cannot be expressed in SQL (user classifier, streaming).
Computed columns carry the same alias on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]

_REGISTRY: dict[str, tuple[Builder, Callable[[], str] | None]] = {}


def register(name: str, sql: Callable[[], str] | None = None):
    def deco(fn: Builder) -> Builder:
        if name in _REGISTRY:
            raise ValueError(f"duplicate query {name!r}")
        _REGISTRY[name] = (fn, sql)
        return fn

    return deco


def _load_all() -> None:
    # importing the modules registers their queries
    from . import queries  # noqa: F401


def queries() -> dict[str, Builder]:
    _load_all()
    return {k: v[0] for k, v in _REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    _load_all()
    return {k: v[1]() for k, v in _REGISTRY.items() if v[1] is not None}
