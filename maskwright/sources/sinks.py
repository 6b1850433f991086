"""Where results go: redacted text, replacement map, summaries."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.operators.pseudonym import as_map


def balanced(rows: DataFrame, *partitions: str) -> DataFrame:
    """Rows dealt out for a write by ``partitions``: small ones together, large ones split.

    Spark decides from the sizes it has shuffled: a task gets about ``spark.sql.adaptive.advisoryPartitionSizeInBytes``, so
    neither does a source with most of the rows end in one file, nor does each task write a small file per source.
    """
    if not partitions:
        return rows
    columns = ", ".join(f"`{p}`" for p in partitions)
    return rows.sparkSession.sql(f"SELECT /*+ REBALANCE({columns}) */ * FROM {{rows}}", rows=rows)


def write_redacted(redacted: DataFrame, path: str, *partitions: str) -> None:
    """Partitioned by columns of the result, such as ``story`` or a ``source`` that came with the documents."""
    balanced(redacted, *partitions).write.mode("overwrite").partitionBy(*partitions).parquet(path)


def write_mapping(mapped: DataFrame, path: str) -> None:
    """Kept apart from the redacted text: whoever holds both can undo the redaction."""
    as_map(mapped).write.mode("overwrite").json(path)


def write_mapping_batch(mapped: DataFrame, path: str, batch_id: int) -> None:
    """The map of one batch of a stream. A batch that is delivered again replaces its own rows, and no others."""
    rows = as_map(mapped).withColumn("batch_id", F.lit(batch_id))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(path)


def write_summary(summary: DataFrame, path: str, source: str, output: str) -> None:
    named = summary.select(F.lit(source).alias("source"), F.lit(output).alias("output"), "*")
    named.write.mode("overwrite").json(path)
