"""Ordered paragraphs, the unit every detector works on."""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskwright.functions.text import is_blank, strip
from maskwright.operators.numbering import RANGES, chunk_of, number_rows, range_of
from maskwright.plans.staging import input_bytes
from maskwright.schema import CHUNK

# The order in which a document's stories are read.
STORY_ORDER = ("body", "header", "footer", "first_page_header", "first_page_footer")


def spread(docs: DataFrame) -> DataFrame:
    """Shuffles documents over the cores if their files are too small to occupy them.

    A Parquet row group is read by one task. Input of less than one full split per core is spread
    at the price of one small shuffle; larger input is left as it is.
    """
    spark = docs.sparkSession
    cores = spark.sparkContext.defaultParallelism
    split = spark.conf.get("spark.sql.files.maxPartitionBytes").rstrip("bB")
    return docs.repartition(cores) if input_bytes(docs) < cores * int(split) else docs


def from_documents(docs: DataFrame, *carried: str) -> DataFrame:
    """One paragraph per line of ``text``, blank ones kept. ``carried`` columns (a ``source``, say) go along.

    The preceding line rides along as ``prev_text``: learning from label/value neighbours then
    needs neither a window nor a join.
    """
    lines = spread(docs.select("doc_id", *carried, "text")).select("doc_id", *carried, F.split("text", "\n", -1).alias("lines"))
    with_previous = F.transform(
        "lines",
        lambda line, i: F.struct(
            line.alias("text"), F.when(i > 0, F.get("lines", i - 1)).alias("prev_text")
        ),
    )
    return lines.select("doc_id", *carried, F.posexplode(with_previous).alias("para_idx", "line")).select(
        "doc_id", "para_idx", *carried, F.lit("body").alias("story"), "line.text", "line.prev_text"
    )


def from_rows(rows: DataFrame, doc_id: str, position: str, text: str, ranges: int = RANGES) -> DataFrame:
    """One paragraph per row (a turn of a conversation, say), numbered by an integer position of any distances.

    Rows are numbered, and see the text before theirs, inside ranges of (document, position). Of each range, only its
    size and its last text pass a window over the document. Rows with equal positions follow their texts.
    """
    named = rows.select(
        F.col(doc_id).alias("doc_id"), F.col(position).alias("_position"), F.col(text).alias("text")
    )
    ranged = named.withColumn("_range", range_of(named, ["doc_id", "_position"], ranges))
    last = F.max(F.struct("_position", "text"))["text"]
    ends = ranged.groupBy("doc_id", "_range").agg(F.count("*").alias("_size"), last.alias("_last"))
    along = Window.partitionBy("doc_id").orderBy("_range")
    before = F.coalesce(F.sum("_size").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = ends.select("doc_id", "_range", before.alias("_start"), F.lag("_last").over(along).alias("_carried"))
    inside = Window.partitionBy("doc_id", "_range").orderBy("_position", "text")
    numbered = ranged.withColumns({"_rank": F.row_number().over(inside), "_above": F.lag("text").over(inside)})
    return numbered.join(starts, ["doc_id", "_range"]).select(
        "doc_id",
        (F.col("_start") + F.col("_rank") - 1).cast("int").alias("para_idx"),
        F.lit("body").alias("story"),
        "text",
        F.when(F.col("_rank") == 1, F.col("_carried")).otherwise(F.col("_above")).alias("prev_text"),
    )


def from_blocks(blocks: DataFrame, size: int = CHUNK) -> DataFrame:
    """Paragraphs of structured documents, in reading order, each element once.

    ``path`` locates a block inside its story: ``[n]`` for a plain paragraph and
    ``[table, row, cell, 0, n]`` for one in a table cell; a table nested in that cell continues
    ``[table, row, cell, 1, table, row, cell, 0, n]``. A merged cell is reached several times
    under the same ``element_id``; its first place counts.

    Runs a job that counts the blocks per document: one of more than ``size`` blocks is numbered chunk by chunk.
    """
    story_rank: Column = F
    for rank, story in enumerate(STORY_ORDER):
        story_rank = story_rank.when(F.col("story") == story, rank)
    place = F.struct(
        F.when(F.col("story") == "body", -1).otherwise(F.col("section")).alias("section"),
        story_rank.alias("story_rank"),
        F.col("in_table").cast("int").alias("in_table"),
        "path",
    )

    def firsts(some: DataFrame) -> DataFrame:
        return (
            some.groupBy("doc_id", "element_id")
            .agg(F.min(F.struct(place.alias("place"), "story", "text")).alias("first"))
            .select("doc_id", "first.place", "first.story", "first.text")
        )

    in_table = F.col("place.in_table") == 1
    head, row = F.get("place.path", F.lit(0)), F.get("place.path", F.lit(1))
    chunks = {
        "_section": F.col("place.section"),
        "_story": F.col("place.story_rank"),
        "_kind": F.col("place.in_table"),
        "_head": F.when(in_table, head.cast("bigint")).otherwise(chunk_of(head, size)),
        "_row": F.when(in_table, chunk_of(row, size)).otherwise(F.lit(0).cast("bigint")),
    }
    columns = "doc_id", (F.col("_number") - 1).alias("para_idx"), "story", "text"
    counts = blocks.groupBy("doc_id").agg(F.count("*").alias("_n"))
    large = counts.filter((F.col("_n") > size) & F.col("doc_id").isNotNull()).select("doc_id")
    none_large = large.isEmpty()
    # Few blocks are brought together by document: one shuffle serves both their first places and their numbers.
    small = (blocks if none_large else blocks.join(large, "doc_id", "left_anti")).repartition("doc_id")
    # As chunk by chunk: blocks without a place are counted, but not returned.
    keyed = reduce(lambda kept, chunk: kept & chunk.isNotNull(), chunks.values(), F.col("doc_id").isNotNull())
    along = Window.partitionBy("doc_id").orderBy("place")
    numbered = firsts(small).withColumn("_number", F.row_number().over(along)).filter(keyed).select(*columns)
    if none_large:
        return numbered
    rest = firsts(blocks.join(large, "doc_id", "left_semi"))
    return numbered.unionByName(number_rows(rest, ["doc_id"], chunks, [F.col("place")], "_number").select(*columns))


def with_previous(paragraphs: DataFrame) -> DataFrame:
    """Adds ``prev_text``, by an equi-join on unique keys rather than a window over a document."""
    if "prev_text" in paragraphs.columns:
        return paragraphs
    previous = paragraphs.select(
        "doc_id", (F.col("para_idx") + 1).alias("para_idx"), F.col("text").alias("prev_text")
    )
    return paragraphs.join(previous, ["doc_id", "para_idx"], "left")


def preview(paragraphs: DataFrame, k: int) -> DataFrame:
    """The first ``k`` non-blank lines of each document, trimmed, with the document's total.

    A document without such lines has one row, with no line and a total of 0. ``row_number() <= k`` lets Spark keep at
    most ``k`` rows per document and map task before the shuffle, so a huge document sends few rows to its task.
    """
    lines = paragraphs.select("doc_id", "para_idx", strip(F.col("text")).alias("line"))
    filled = F.coalesce(~is_blank(F.col("line")), F.lit(False))
    first = Window.partitionBy("doc_id").orderBy("para_idx")
    top = lines.filter(filled).withColumn("line_no", F.row_number().over(first)).filter(F.col("line_no") <= k)
    totals = lines.groupBy("doc_id").agg(F.count_if(filled).alias("total_lines"))
    return totals.join(top, "doc_id", "left").select(
        "doc_id", "line_no", "line", "total_lines", (F.col("total_lines") > k).alias("truncated")
    )
