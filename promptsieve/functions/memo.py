"""Reuse of unresolved column expressions.

A screening plan holds a few thousand expression nodes, each built through a call to
the JVM.  They name columns, not data, so one set serves every plan of a session.
"""

from __future__ import annotations

from functools import wraps


def _jvm() -> int:
    try:
        from pyspark import SparkContext

        return id(SparkContext._gateway)
    except ImportError:  # a client without a local JVM
        return 0


def per_session(build):
    """Cache a builder of columns by its (hashable) arguments and the current JVM."""
    store: dict = {}

    @wraps(build)
    def get(*args):
        jvm = _jvm()
        if store.get("jvm") != jvm:
            store.clear()
            store["jvm"] = jvm
        if args not in store:
            store[args] = build(*args)
        return store[args]

    return get
