"""Which values of their document may stand in a paragraph.

A document with few values brings them all to each of its paragraphs, as one array. The paragraphs of other documents meet
theirs in an inverted index: a paragraph is posted under the 64-bit hashes of its tokens, a value under the hash of one token that it must share with any
text it stands in. Only hashes and keys are shuffled, over (document, hash, salt): a document may hold a third of all
rows, any number of values, and a token in all of its paragraphs.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright.functions.reuse import on

# Up to this many values of a document are searched one by one in each of its paragraphs.
FEW = 64

# How many tasks share the paragraphs of one document that hold the same token, and the values that do.
SALTS = 16


def anchored(values: DataFrame, tokens: Column) -> DataFrame:
    """``values`` (distinct rows of ``doc_id, value`` and more) with ``anchor``: the hash of the one of their ``tokens`` that
    fewest values of the document hold; of equals, the longest.

    A token that very many values of a document hold is counted in ``SALTS`` parts, and meets its values in as many.
    """
    columns = values.columns
    held = values.withColumns({"_salt": F.pmod(F.xxhash64("value"), F.lit(SALTS)), "_token": F.explode(tokens)})
    parts = held.groupBy("doc_id", "_token", "_salt").agg(F.count("*").alias("_n"))
    counts = parts.groupBy("doc_id", "_token").agg(F.sum("_n").alias("_n"), F.collect_list("_salt").alias("_salts"))
    counts = counts.select("doc_id", "_token", "_n", F.explode("_salts").alias("_salt"))
    rarest = F.min(F.struct("_n", (-F.length("_token")).alias("_shortness"), "_token"))["_token"]
    return held.join(counts, ["doc_id", "_token", "_salt"]).groupBy(*columns).agg(F.xxhash64(rarest).alias("anchor"))


def met(
    paragraphs: DataFrame, text: str, tokens: Callable[[Column], Column], wanted: DataFrame, value: Column, hint: str | None = None
) -> DataFrame:
    """``(doc_id, para_idx, _values)``: per paragraph, ``value`` of the rows of ``wanted(doc_id, anchor, …)`` whose token it holds.

    ``hint`` names a join strategy; without it, Spark chooses. The groups are the values of one paragraph.
    """
    posted = paragraphs.select(
        "doc_id", "para_idx",
        F.pmod("para_idx", F.lit(SALTS)).alias("_salt"),
        F.explode(F.transform(on(tokens, text), lambda t: F.xxhash64(t))).alias("anchor"),
    )
    salted = wanted.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = salted.hint(hint) if hint else salted
    pairs = posted.join(salted, ["doc_id", "anchor", "_salt"])
    return pairs.groupBy("doc_id", "para_idx").agg(F.collect_list(value).alias("_values"))


def with_values(
    paragraphs: DataFrame,
    text: str,
    tokens: Callable[[Column], Column],
    values: DataFrame,
    own_tokens: Column,
    value: Column,
    hint: str | None = None,
    few: int = FEW,
) -> DataFrame:
    """Adds ``_values`` (or null): ``value`` of those ``values(doc_id, value, …)`` of its document that may stand in a paragraph.

    Runs a job that counts the values per document. Text is indexed only if a document has more than ``few``, and only of
    such documents. The empty value has no tokens and stands with any text.
    """
    counts = values.groupBy("doc_id").agg(F.count("*").alias("_n"))
    large = counts.filter((F.col("_n") > few) & F.col("doc_id").isNotNull()).select("doc_id")
    none_large = large.isEmpty()
    listed = values if none_large else (
        values.join(large, "doc_id", "left_anti").unionByName(values.filter(F.col("value") == ""))
    )
    lists = listed.groupBy("doc_id").agg(F.collect_set(value).alias("_values"))
    lists = lists.hint(hint) if hint else lists
    rows = paragraphs.join(lists, "doc_id", "left")
    if none_large:
        return rows
    wanted = anchored(values.join(large, "doc_id", "left_semi"), own_tokens)
    indexed = met(paragraphs.join(large, "doc_id", "left_semi"), text, tokens, wanted, value, hint)
    rows = rows.join(indexed.withColumnRenamed("_values", "_indexed"), ["doc_id", "para_idx"], "left")
    none = F.filter("_indexed", lambda v: F.lit(False))
    both = F.flatten(F.array(F.coalesce("_values", none), "_indexed"))
    return rows.withColumn("_values", F.coalesce(both, "_values")).drop("_indexed")
