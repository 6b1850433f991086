"""Sharding by extendible hashing.

A document's hash has 60 bits. The directory starts with one bucket; only buckets over the byte limit
split, on one more bit of the prefix, until each fits. A round sums the bytes of prefixes ``STEP`` bits
longer, one row per prefix after a map-side combine, and rolls the sums up bit by bit, so that
buckets split up to ``STEP`` times per pass; only rows of buckets still too large take part in the next.
A bucket of one document does not split. Rows that share all 60 bits (repeats of one doc_id, or of a
text without one) fill numbered overflow shards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from maskwright.llm import common as C

BITS = 60
STEP = 12
LIMIT = 1 << 20  # bytes of text in a shard


def hashed(docs: DataFrame) -> DataFrame:
    """(doc_id, h, bytes): the first 60 bits of the MD5 of the doc_id (or of the text, where it is null)."""
    name = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("~"), F.coalesce("text", F.lit(""))))
    h = F.conv(F.substring(F.md5(name), 1, BITS // 4), 16, 10).cast("bigint")
    return docs.select("doc_id", h.alias("h"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("bytes"))


def _prefix(h: Column, depth: Column | int) -> Column:
    return F.expr(f"shiftright(h, {BITS} - {depth})") if isinstance(depth, int) else F.call_function("shiftright", h, (F.lit(BITS) - depth).cast("int"))


def _bits(h: Column, depth: Column) -> Column:
    return F.when(depth == 0, "").otherwise(F.lpad(F.bin(_prefix(h, depth)), depth.cast("int"), F.lit("0")))


def _depths(rows: DataFrame, base: int, limit: int) -> DataFrame:
    """(cell, depth): for each prefix of base + STEP bits the depth of the bucket it ends in, null if none fits."""
    cells = rows.groupBy(_prefix(F.col("h"), base + STEP).alias("cell")).agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("rows"))
    paths = cells.select("*", F.explode(F.sequence(F.lit(0), F.lit(STEP))).alias("d")).withColumn(
        "prefix", F.call_function("shiftright", F.col("cell"), F.lit(STEP) - F.col("d"))
    )
    fit = paths.groupBy("d", "prefix").agg(F.sum("bytes").alias("b"), F.sum("rows").alias("r")).filter(f"b <= {limit} OR r = 1")
    ends = paths.join(fit.select("d", "prefix"), ["d", "prefix"]).groupBy("cell").agg((F.min("d") + base).alias("depth"))
    return cells.select("cell").join(ends, "cell", "left")


def shards(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """One row per row of ``docs``: doc_id, bytes, depth, shard (the bits of its prefix; empty for one shard).

    A null text has no bytes. A document over the limit is a shard of its own. An empty table has no shards.
    """
    rest, base, done = C.checkpointed(hashed(docs)), 0, []
    while base < BITS and not rest.isEmpty():
        placed = rest.withColumn("cell", _prefix(F.col("h"), base + STEP)).join(_depths(rest, base, limit), "cell")
        placed = C.checkpointed(placed.select("doc_id", "h", "bytes", "depth"))
        done.append(placed.filter("depth IS NOT NULL").select("doc_id", "bytes", "depth", _bits(F.col("h"), F.col("depth")).alias("shard")))
        rest, base = placed.filter("depth IS NULL").select("doc_id", "h", "bytes"), base + STEP
    same = Window.partitionBy("h")
    each = F.greatest(F.lit(1), F.floor(limit / F.greatest(F.lit(1), F.max("bytes").over(same))))
    number = F.floor((F.row_number().over(same.orderBy("bytes")) - 1) / each)
    full = rest.select("doc_id", "bytes", F.lit(BITS).alias("depth"), F.concat(_bits(F.col("h"), F.lit(BITS)), F.lit("+"), number.cast("string")).alias("shard"))
    for part in done:
        full = full.unionByName(part)
    return full


def directory(assigned: DataFrame) -> DataFrame:
    """One row per shard: depth, documents, bytes, and how many entries of the full directory point to it."""
    sizes = assigned.groupBy("shard", "depth").agg(F.count(F.lit(1)).alias("documents"), F.sum("bytes").alias("bytes"))
    deepest = assigned.agg(F.max("depth").alias("global_depth"))
    return sizes.join(F.broadcast(deepest)).withColumn("entries", F.expr("shiftleft(1L, global_depth - depth)"))


def write_shards(docs: DataFrame, path: str, limit: int = LIMIT) -> None:
    """Writes the documents, one folder per shard. Ids must be unique."""
    rows = C.whole_rows(docs, id=F.col("doc_id")).join(shards(docs, limit).select(F.col("doc_id").alias("id"), "shard"), "id")
    C.result_columns(rows, "shard").repartition("shard").write.partitionBy("shard").parquet(path)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: the shard of every document."""
    return shards(C.documents(spark, sf_dir))


SQL = f"""
    WITH d AS (
        SELECT doc_id, ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '~' || coalesce(text, ''))), 1, 15))::BIGINT AS h,
               coalesce(octet_length(CAST(encode(text) AS BLOB)), 0) AS bytes
        FROM documents
    ), p AS (SELECT doc_id, h, bytes, k, h >> (60 - k) AS prefix FROM d, (SELECT unnest(range(41)) AS k)),
    n AS (SELECT k, prefix FROM p GROUP BY k, prefix HAVING sum(bytes) <= {LIMIT} OR count(*) = 1)
    SELECT doc_id, bytes, CAST(min(k) AS INTEGER) AS depth,
           CASE WHEN min(k) = 0 THEN '' ELSE lpad(bin(h >> (60 - min(k))), CAST(min(k) AS INTEGER), '0') END AS shard
    FROM p JOIN n USING (k, prefix) GROUP BY doc_id, h, bytes
"""
