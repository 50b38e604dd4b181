"""Per-SparkContext memoisation of Column expressions.

Building the scan / policy expressions costs thousands of JVM calls from
Python; the expressions only depend on the (immutable) rule set, policy and
column names, so they are built once per SparkContext and reused across
queries.  Keys must be hashable and describe the expression completely."""

from __future__ import annotations

import functools


def _context_key():
    from pyspark import SparkContext

    sc = SparkContext._active_spark_context
    return id(sc) if sc is not None else None


def column_memo(fn):
    cache: dict = {}

    @functools.wraps(fn)
    def wrapper(*args):
        # the last argument may be an unhashable Column that the key describes
        k = (_context_key(),) + tuple(a for a in args if _hashable(a))
        if k not in cache:
            cache[k] = fn(*args)
        return cache[k]

    return wrapper


def _hashable(a) -> bool:
    from pyspark.sql import Column

    if isinstance(a, (Column, dict)) or type(a).__name__ == "Policy":
        return False
    try:
        hash(a)
        return True
    except TypeError:
        return False
