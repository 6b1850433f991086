"""One stable replacement per document, type and normalised value."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskwright.functions.fakes import fake
from maskwright.functions.reuse import on
from maskwright.functions.text import hash_bucket, normalise
from maskwright.operators.numbering import chunk_of, number_rows
from maskwright.schema import CHUNK

KEY = ["doc_id", "pii_type", "norm_value"]


def keyed(spans: DataFrame, size: int = CHUNK) -> DataFrame:
    """Spans (one per row) with their key and the chunk of paragraphs they stand in."""
    return spans.withColumn("norm_value", on(normalise, "value")).withColumn(
        "chunk", chunk_of(F.col("para_idx"), size)
    )


def occurrences(spans: DataFrame, size: int = CHUNK) -> DataFrame:
    """Per key and chunk: where the key first stands there and how often it does."""
    # Paragraph and offset in one number, which aggregates by hash where a struct would be sorted.
    place = F.shiftleft(F.col("para_idx").cast("bigint"), 32) + F.col("start")
    return keyed(spans, size).groupBy(*KEY, "chunk").agg(
        F.min(place).alias("first"), F.count("*").alias("n")
    )


def ordinals(occurring: DataFrame, size: int = CHUNK) -> DataFrame:
    """Numbers the keys of each document and type by first appearance."""
    keys = occurring.groupBy(*KEY).agg(F.min("first").alias("first"))
    chunk = chunk_of(F.shiftright("first", 32), size)
    numbered = number_rows(keys, ["doc_id", "pii_type"], {"_chunk": chunk}, [F.col("first")], "ordinal")
    return numbered.select(*KEY, "ordinal", "first")


def with_fakes(numbered: DataFrame) -> DataFrame:
    return numbered.withColumn("fake", on(_fake, "pii_type", "norm_value", "ordinal"))


def _fake(pii_type: Column, norm_value: Column, ordinal: Column) -> Column:
    return fake(pii_type, hash_bucket(norm_value), ordinal)


def lookups(occurring: DataFrame, size: int = CHUNK) -> DataFrame:
    """The mapping, repeated once per chunk in which a key occurs.

    Spans then meet their replacement on (key, chunk): a value that fills a third of all rows is
    spread over the chunks it stands in.

    Runs a job that looks for documents of several chunks, which are numbered chunk by chunk. The others are brought together by
    document: one shuffle serves.
    """
    # Keys without a place, or without a part, are not numbered.
    placed = occurring.dropna(subset=[*KEY, "chunk", "first"])
    of_chunks = placed.groupBy("doc_id").agg(F.min("chunk").alias("_from"), F.max("chunk").alias("_to"))
    large = of_chunks.filter(F.col("_from") < F.col("_to")).select("doc_id")
    columns = *KEY, "chunk", "ordinal", "fake", "is_first"
    none_large = large.isEmpty()
    small = placed if none_large else placed.join(large, "doc_id", "left_anti")
    in_order = Window.partitionBy("doc_id", "pii_type").orderBy("first", "norm_value")
    numbered = small.repartition("doc_id").withColumns({"ordinal": F.row_number().over(in_order), "is_first": F.lit(True)})
    numbered = with_fakes(numbered).select(*columns)
    if none_large:
        return numbered
    rest = placed.join(large, "doc_id", "left_semi")
    mapped = with_fakes(ordinals(rest, size)).withColumnRenamed("first", "_first")
    rows = rest.select(*KEY, "chunk", "first").join(mapped, KEY).withColumn("is_first", F.col("first") == F.col("_first"))
    return numbered.unionByName(rows.select(*columns))


def mapping(looked_up: DataFrame) -> DataFrame:
    """``mapping(doc_id, pii_type, norm_value, ordinal, fake)``: each key in the chunk it first stands in."""
    return looked_up.filter("is_first").select(*KEY, "ordinal", "fake")


def as_map(mapped: DataFrame) -> DataFrame:
    """The mapping with the published export's keys, ``type:value``, one pair per row."""
    return mapped.select("doc_id", F.concat_ws(":", "pii_type", "norm_value").alias("key"), "fake")
