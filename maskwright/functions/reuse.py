"""Large expressions over columns of fixed names, built once per Spark context.

Building an expression from Python costs a call to the JVM per node; the detectors alone have
hundreds. A column expression is bound to no table, so it can serve many plans.
"""

from collections.abc import Callable
from functools import cache

from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F


def on(build: Callable[..., Column], *columns: str) -> Column:
    """``build(col(name), …)``, remembered."""
    return _built(build, columns, SparkContext._active_spark_context)


@cache
def _built(build: Callable[..., Column], columns: tuple[str, ...], context: SparkContext | None) -> Column:
    return build(*[F.col(c) for c in columns])
