"""Functions over Arrow batches as column expressions, run by Python workers."""

import os
import tempfile
import zipfile
from collections.abc import Callable

import pyarrow as pa
from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F

_shipped: set[str] = set()


def ship() -> None:
    """Sends this package to the Python workers, which may run where it is not installed. Once per application."""
    context = SparkContext._active_spark_context
    if context is None or context.applicationId in _shipped:
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    archive = os.path.join(tempfile.mkdtemp(prefix="maskwright-"), f"{os.path.basename(top)}-workers.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, names in os.walk(top):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(top)))
    context.addPyFile(archive)
    _shipped.add(context.applicationId)


def in_worker(batch: Callable[..., pa.Array], result: str, *columns: Column) -> Column:
    """What ``batch`` gives for Arrow arrays of the columns' values, an array of as many values of type ``result``."""
    ship()
    batch.__annotations__ = {"return": pa.Array}
    batch.__annotations__ |= {name: pa.Array for name in batch.__code__.co_varnames[: batch.__code__.co_argcount]}
    return F.arrow_udf(batch, result)(*columns)
