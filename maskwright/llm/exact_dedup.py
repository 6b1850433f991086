"""Exact deduplication by two passes over a Bloom filter.

Pass one posts ``HASHES`` slots per text hash and counts rows per slot: a narrow shuffle of slot
numbers that is combined on the map side. Slots that two or more rows hit set a bit of the filter.
Pass two reads the texts again. A row whose slots are all set is possibly repeated and is shuffled
by the SHA-256 of its text; every other row is unique for certain and passes straight through.

The filter is a table of bitmaps of 32,768 bits, at most ``FILTER_BITS`` / 8 bytes (16 MB) in all: that
is what bounds the broadcast. A filter too small for the corpus only sends more rows to the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from maskwright.llm import common as C
from maskwright.llm.common import FILTER_BITS

HASHES = 2


def normalised(text: Column) -> Column:
    """Lower-cases A-Z only; null counts as empty."""
    return C.ascii_lower(F.coalesce(text, F.lit("")))


def _slots(digest: Column, filter_bits: int) -> Column:
    """The slots of a text, from separate stretches of its SHA-256."""
    return F.array(*[F.conv(F.substring(digest, 1 + 12 * i, 12), 16, 10).cast("bigint") % filter_bits for i in range(HASHES)])


def repeated_slots(digests: DataFrame, filter_bits: int = FILTER_BITS) -> DataFrame:
    """The filter: a bit for each slot that two or more rows hit."""
    hit = digests.select(F.explode(_slots(F.col("text_sha256"), filter_bits)).alias("slot")).groupBy("slot").count()
    return C.bitmaps(hit.filter("count > 1"))


def flagged(rows: DataFrame, filter_bits: int = FILTER_BITS) -> DataFrame:
    """Adds ``suspect`` to rows that have ``text_sha256``: false if no other row has that text."""
    found, slots = repeated_slots(rows.select("text_sha256"), filter_bits), _slots(F.col("text_sha256"), filter_bits)
    for i in range(HASHES):
        rows = C.with_bit(rows, found, slots[i], f"__set{i}")
    names = [f"__set{i}" for i in range(HASHES)]
    return rows.withColumn("suspect", F.expr(" AND ".join(names))).drop(*names)


def mark_copies(docs: DataFrame, filter_bits: int = FILTER_BITS) -> DataFrame:
    """Adds keep_id, group_size, kept and text_sha256 to every document.

    Of equal texts (after lower-casing A-Z; null counts as empty) the row with the largest doc_id stays.
    Null doc_ids lose to all others. Of several rows with that same doc_id one stays. Input columns
    named like a result are replaced; an empty table gives an empty one.
    """
    rows = C.whole_rows(docs, doc_id=F.col("doc_id"), text_sha256=F.sha2(normalised(F.col("text")), 256))
    marked = flagged(rows, filter_bits)
    alone = marked.filter("NOT suspect").select(
        "row", F.col("doc_id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"), F.lit(True).alias("kept"), "text_sha256"
    )
    suspects = C.with_group(
        marked.filter("suspect"), ["text_sha256"], F.xxhash64("doc_id"), keep_id=(F.col("doc_id"), "max"), group_size=(F.col("doc_id"), "count")
    )
    # Of rows that repeat the doc_id that stays, one does.
    first = F.row_number().over(_window("text_sha256", "doc_id")) == 1
    both = suspects.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")) & first)
    both = both.select("row", "keep_id", "group_size", "kept", "text_sha256")
    return C.result_columns(alone.unionByName(both), "keep_id", "group_size", "kept", "text_sha256")


def _window(*keys: str) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(F.lit(0))


def drop_copies(docs: DataFrame, filter_bits: int = FILTER_BITS) -> DataFrame:
    """The documents that stay, with their own columns."""
    rows = C.whole_rows(docs, doc_id=F.col("doc_id"), text_sha256=F.sha2(normalised(F.col("text")), 256))
    marked = flagged(rows, filter_bits)
    suspects = C.with_group(
        marked.filter("suspect"), ["text_sha256"], F.xxhash64("doc_id"), keep_id=(F.col("doc_id"), "max")
    ).filter(F.col("doc_id").eqNullSafe(F.col("keep_id")))
    first = suspects.withColumn("n", F.row_number().over(_window("text_sha256", "doc_id"))).filter("n = 1")
    return marked.filter("NOT suspect").select("row").unionByName(first.select("row")).select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: one row per document, dropped ones too."""
    marked = mark_copies(C.documents(spark, sf_dir))
    return marked.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


SQL = """
    WITH d AS (
        SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
        FROM documents
    ), g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
    SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)
"""
