"""Counts over resolved spans and over redacted text."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright import fixed_values as fixed
from maskwright.functions.dialect import java
from maskwright.functions.text import is_blank
from maskwright.schema import check_mode


def redactions_by_type(occurring: DataFrame) -> DataFrame:
    return occurring.groupBy("doc_id", "pii_type").agg(F.sum("n").alias("redactions"))


def changed_paragraphs(paragraphs: DataFrame) -> DataFrame:
    """A paragraph is one row, so counting rows with spans needs no distinct."""
    return paragraphs.groupBy("doc_id").agg(F.count_if(F.size("spans") > 0).alias("changed_paragraphs"))


def summary(paragraphs: DataFrame, occurring: DataFrame, mode: str, ner_model: str | None = None) -> DataFrame:
    """One row per document, documents without finds included. ``ner_model`` names what made the annotations, if any."""
    counts = (
        occurring.groupBy("doc_id", "pii_type")
        .agg(F.sum("n").alias("n"), F.count_distinct("norm_value").alias("keys"))
        .groupBy("doc_id")
        .agg(
            # At most nine entries: one per type.
            F.map_from_entries(F.array_sort(F.collect_list(F.struct("pii_type", "n")))).alias("redactions"),
            F.sum("keys").alias("unique_replacements"),
            F.sum("n").alias("total_redactions"),
            F.count("*").alias("types_found"),
        )
    )
    zero = F.lit(0).cast("bigint")
    return changed_paragraphs(paragraphs).join(counts, "doc_id", "left").select(
        "doc_id",
        F.lit(check_mode(mode)).alias("mode"),
        F.lit(ner_model).cast("string").alias("ner_model"),
        "changed_paragraphs",
        F.coalesce("redactions", F.create_map().cast("map<string, bigint>")).alias("redactions"),
        F.coalesce("unique_replacements", zero).alias("unique_replacements"),
        F.coalesce("total_redactions", zero).alias("total_redactions"),
        F.coalesce("types_found", zero).alias("types_found"),
    )


def marker_audit(redacted: DataFrame, column: str = "redacted") -> DataFrame:
    """Counts of the replacements' shapes, and of non-blank paragraphs, in one scan."""
    text = F.col(column)

    def shapes(name: str, pattern: str) -> Column:
        # A pattern is tried only where the characters that each of its matches holds are found.
        held = F.contains(F.lower(text) if pattern.startswith("(?i)") else text, F.lit(fixed.MARKERS_HOLD[name]))
        return F.when(held, F.regexp_count(text, F.lit(java(pattern))))

    counts = [F.coalesce(F.sum(shapes(*m)), F.lit(0)).cast("bigint").alias(m[0]) for m in fixed.MARKERS.items()]
    return redacted.agg(F.count_if(~is_blank(text)).alias("non_blank_paragraphs"), *counts)
