"""Column expressions that are built once."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark import SparkContext
from pyspark.sql import Column


def built_once(build: Callable[..., Column]) -> Callable[..., Column]:
    """build with its results kept by arguments and by the session's gateway: building an expression takes a call to the JVM for each of its nodes, so a large one takes seconds."""
    kept = functools.lru_cache(maxsize=64)(lambda gateway, *args: build(*args))
    return functools.wraps(build)(lambda *args: kept(id(SparkContext._gateway), *args))
