"""Per-session memo of built Column expressions.

Detector and fact expressions are large trees; building them through py4j
costs seconds.  A Column is an immutable expression that can be reused by
any DataFrame of the same JVM session, so each tree is built once.
"""
from __future__ import annotations

import functools

from pyspark import SparkContext


def per_session(fn):
    cache: dict = {}

    @functools.wraps(fn)
    def wrapper(*args):
        sc = SparkContext._active_spark_context
        key = (sc.applicationId, args)
        if key not in cache:
            cache[key] = fn(*args)
        return cache[key]
    return wrapper
