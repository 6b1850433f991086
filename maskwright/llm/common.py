"""What several operators of this subpackage share: words, staging, salted group minima, rows kept whole."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# A word: characters that are neither a space nor one of U+0009 to U+000D. On UTF-8 bytes this is
# what bytes.split() gives, and bytes.lower() changes A-Z only.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Rows per Arrow batch that a task hands to Python: texts may be long, so batches are short.
BATCH_BYTES = 4 << 20


def checkpointed(rows: DataFrame) -> DataFrame:
    """Computes ``rows`` once, into the folder of ``spark.checkpoint.dir``, which all executors share.

    Only a local session without that setting (a test) gets a temporary folder.
    """
    spark = rows.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", None):
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="llm-"))
    return rows.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder, for tables that an operator writes and reads back."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="llm-")


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, which may run where it is not installed. Once per application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    archive = os.path.join(tempfile.mkdtemp(prefix="llm-"), f"{os.path.basename(top)}.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, names in os.walk(top):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(top)))
    context.addPyFile(archive)
    _shipped.add(context.applicationId)


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The named columns of the ``documents`` table, and no others."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*(columns or ("doc_id", "text")))


def whole_rows(rows: DataFrame, **extra: Column) -> DataFrame:
    """The input row as one struct column ``row`` beside derived columns.

    Columns of the input can then never clash with those an operator adds.
    """
    return rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"), *[c.alias(n) for n, c in extra.items()])


def result_columns(rows: DataFrame, *added: str) -> DataFrame:
    """Unpacks ``row``; a result column replaces an input column of its name (letter case aside)."""
    names = {a.lower() for a in added}
    kept = [f.name for f in rows.schema["row"].dataType if f.name.lower() not in names]
    return rows.select(*[F.col("row")[c].alias(c) for c in kept], *added)


def binary_text(column: str = "text") -> Column:
    """A text as UTF-8 bytes; null gives no bytes."""
    return F.coalesce(F.col(column).cast("binary"), F.lit(b""))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def text_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches so that each holds a few MB, whatever the length of its texts."""
    for batch in batches:
        rows, size = batch.num_rows, max(1, batch.nbytes)
        step = max(1, rows * BATCH_BYTES // size)
        for at in range(0, rows, step):
            yield batch.slice(at, step)


def leaving_nothing(
    run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], forget: Callable[[], None] | None = None
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for ``mapInArrow``; at the end of its task the worker gives back what it holds.

    Spark keeps idle workers, beside which tasks of the JVM and of other operators then need memory. ``forget``
    empties what a module remembers between batches: a function of that module, as names of a module that are used here
    would be copied to the workers.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            if forget is not None:
                forget()
            pa.default_memory_pool().release_unused()

    return task


def spread_over_cores(docs: DataFrame, partitions: int | None = None) -> DataFrame:
    """An explicit repartitioning, if asked for; otherwise the partitions of the scan."""
    return docs.repartition(partitions) if partitions else docs


SALTS = 256


def with_group(rows: DataFrame, keys: list[str], salt: Column, salts: int = SALTS, **aggregates: tuple[Column, str]) -> DataFrame:
    """Gives every row the aggregates of its group, without bringing a large group into one task.

    Each group is cut into ``salts`` parts at most. Parts are aggregated (and combined on the map
    side), then groups from their parts; a group's values return to the parts that it has, so the
    joined table never has more rows than the input and no join key holds more than a part.
    ``aggregates``: name -> (column, "min", "max" or "count").
    """
    salted = rows.withColumn("__salt", F.pmod(salt, F.lit(salts)).cast("int"))
    first = {n: F.count(F.lit(1)) if how == "count" else getattr(F, how)(c) for n, (c, how) in aggregates.items()}
    then = {n: getattr(F, "sum" if how == "count" else how)(f"__{n}") for n, (_, how) in aggregates.items()}
    parts = salted.groupBy(*keys, "__salt").agg(*[c.alias(f"__{n}") for n, c in first.items()])
    groups = parts.groupBy(*keys).agg(*[c.alias(n) for n, c in then.items()], F.collect_list("__salt").alias("__salts"))
    back = groups.select(*keys, *then, F.explode("__salts").alias("__salt"))
    return salted.join(back, [*keys, "__salt"]).drop("__salt")


def running_totals(rows: DataFrame, key: str, chunk: str, order: list[str], value: str, name: str) -> DataFrame:
    """Adds the sum of ``value`` over all earlier rows of ``key``, in the order of (chunk, order).

    Rows are summed inside their chunk; only the chunks' totals pass a window over the key.
    """
    inside = Window.partitionBy(key, chunk).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    over = Window.partitionBy(key).orderBy(chunk).rowsBetween(Window.unboundedPreceding, 0)
    totals = rows.groupBy(key, chunk).agg(F.sum(value).alias("__total"))
    before = totals.select(key, chunk, (F.sum("__total").over(over) - F.col("__total")).alias("__before"))
    within = rows.withColumn("__within", F.sum(value).over(inside) - F.col(value))
    return within.join(before, [key, chunk]).withColumn(name, F.col("__within") + F.col("__before")).drop("__within", "__before")


# Slots of a filter. Its bitmaps of 32,768 bits come to 16 MB at most, which bounds their broadcast; a
# filter too small for its table only lets more rows through to the join that follows.
FILTER_BITS = 1 << 27


def bitmaps(slots: DataFrame) -> DataFrame:
    """(bucket, bits) of the distinct values of ``slot``, numbers from 0 on."""
    placed = slots.select((F.col("slot") + 1).alias("slot"))
    return placed.groupBy(F.bitmap_bucket_number("slot").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits"))


def with_bit(rows: DataFrame, filter_rows: DataFrame, slot: Column, name: str) -> DataFrame:
    """Adds a boolean column ``name``: whether the filter has the row's slot."""
    found = F.broadcast(filter_rows.select(F.col("bucket").alias("__bucket"), F.col("bits").alias("__bits")))
    position = F.bitmap_bit_position(slot + 1)
    byte = F.conv(F.hex(F.substring("__bits", (position / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    joined = rows.join(found, F.bitmap_bucket_number(slot + 1) == F.col("__bucket"), "left")
    return joined.withColumn(name, F.coalesce(F.getbit(byte, (position % 8).cast("int")) == 1, F.lit(False))).drop("__bucket", "__bits")


def in_table(rows: DataFrame, wanted: DataFrame, key: str, filter_bits: int = FILTER_BITS) -> DataFrame:
    """The rows whose ``key`` is in ``wanted``. A filter keeps most others out of the shuffle."""
    slot = F.pmod(F.xxhash64(key), F.lit(filter_bits))
    likely = with_bit(rows, bitmaps(wanted.select(slot.alias("slot"))), slot, "__likely").filter("__likely").drop("__likely")
    return likely.join(wanted.select(key), key, "left_semi")


def staged(rows: DataFrame) -> DataFrame:
    """Computes ``rows`` once, into a compressed table in the shared folder."""
    path = f"{shared_folder(rows.sparkSession)}/staged-{uuid.uuid4().hex}"
    rows.write.option("compression", "zstd").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
