"""Column-expression builders (redaction, strict JSON, time formats)."""

from __future__ import annotations

import functools


def cached_expr(fn):
    """Memoize a builder of unresolved Column expressions.

    Building large expressions costs one JVM round trip per node; an
    unresolved expression can be reused by any number of DataFrames, so it
    is built once per JVM (the gateway is part of the key) and arguments.
    """
    cache: dict = {}

    @functools.wraps(fn)
    def wrapper(*args, **kwargs):
        from pyspark import SparkContext

        key = (id(SparkContext._gateway), args, tuple(sorted(kwargs.items())))
        try:
            return cache[key]
        except KeyError:
            value = cache[key] = fn(*args, **kwargs)
            return value
        except TypeError:  # unhashable argument: build every time
            return fn(*args, **kwargs)

    return wrapper
