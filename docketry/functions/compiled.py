"""Columns built once per application and used again in later plans.

Building the columns of a whole pack takes tens of thousands of calls into the
JVM.  Columns are immutable and name their inputs, so they can be shared.
"""

from __future__ import annotations

from collections.abc import Callable, Hashable
from typing import Any

from pyspark import SparkContext

_built: dict[tuple, Any] = {}


def compiled(key: Hashable, build: Callable[[], Any]) -> Any:
    context = SparkContext._active_spark_context
    full = (context.applicationId if context else None, key)
    if full not in _built:
        for old in [k for k in _built if k[0] != full[0]]:  # of applications that have ended
            del _built[old]
        _built[full] = build()
    return _built[full]
