"""Dense numbering inside groups that may hold a third of all rows."""

import json
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskwright.schema import CHUNK


def chunk_of(position: Column, size: int = CHUNK) -> Column:
    return F.floor(position / size).cast("bigint")


def number_rows(
    rows: DataFrame, group: list[str], chunks: dict[str, Column], order: list[Column], name: str
) -> DataFrame:
    """Adds ``name``: 1, 2, 3 … within ``group`` by ``order``, as ``row_number()`` would.

    A window over the whole group would bring it into one task. ``chunks`` are non-null
    expressions that follow ``order`` from coarse to fine: rows are numbered inside their chunk,
    and each chunk starts where the chunks before it end. Only the chunks' sizes, one row per
    chunk, pass through a window over the group.
    """
    keys = group + list(chunks)
    chunked = rows.withColumns(chunks)
    sizes = chunked.groupBy(*keys).agg(F.count("*").alias("_size"))
    before = Window.partitionBy(*group).orderBy(*chunks).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*keys, F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(*keys).orderBy(*order)
    return (
        chunked.withColumn("_rank", F.row_number().over(inside))
        .join(starts, keys)
        .withColumn(name, (F.col("_start") + F.col("_rank")).cast("int"))
        .drop("_start", "_rank", *chunks)
    )


# Ranges of keys, and how many sampled keys each is cut from.
RANGES, SAMPLES = 256, 16


def range_of(rows: DataFrame, keys: list[str], ranges: int = RANGES) -> Column:
    """The number of the range that a row's (integer) ``keys`` fall into; ranges follow the order of the keys.

    Runs a job that reads the keys: of all rows, the ``ranges * SAMPLES`` with the smallest hashes come to the driver, and
    every ``SAMPLES``-th of them, sorted, is a bound. So ranges hold about as many rows each, whatever the distances
    between keys; rows with equal keys share a range.
    """
    sample = rows.select(*keys).dropna().orderBy(F.xxhash64(*keys)).limit(ranges * SAMPLES).collect()
    bounds = sorted(tuple(r) for r in sample)[SAMPLES // 2 :: SAMPLES]
    steps = max(1, math.isqrt(len(bounds)))
    # Two levels, so that a row is compared with twice the square root of the bounds.
    kind = "struct<" + ", ".join(f"k{i}: bigint" for i in range(len(keys))) + ">"
    as_rows = [[dict((f"k{i}", v) for i, v in enumerate(b)) for b in bounds[j : j + steps]] for j in range(0, len(bounds), steps)]
    if not as_rows:
        return F.lit(0).cast("bigint")
    blocks = F.from_json(F.lit(json.dumps(as_rows)), f"array<array<{kind}>>")
    key = F.struct(*[F.col(k).cast("bigint").alias(f"k{i}") for i, k in enumerate(keys)])
    passed = F.size(F.filter(F.transform(blocks, lambda b: b[0]), lambda first: first <= key))
    inside = F.size(F.filter(F.get(blocks, passed - 1), lambda b: b <= key))
    return F.when(passed > 0, (passed - 1) * steps + inside).otherwise(0).cast("bigint")
