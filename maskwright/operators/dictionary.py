"""The values a document teaches about itself, and where else they occur in it."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright.functions import plain
from maskwright.functions import spans as S
from maskwright.functions import text as X
from maskwright.functions.dialect import WORD, java
from maskwright.functions.reuse import on
from maskwright.functions.workers import in_worker
from maskwright.operators import inverted
from maskwright.operators.detectors import DICTIONARY_RANKS, TAUGHT_BY_FINDS, candidates, seed_candidates, span_rows
from maskwright.sources.paragraphs import with_previous

_TYPED = "array<struct<pii_type: string, value: string>>"


def _taught_by_label(rows: DataFrame) -> DataFrame:
    """Adds ``taught``: typed values of a paragraph whose predecessor is a label."""
    return rows.withColumn("taught", in_worker(plain.label_batch, _TYPED, F.col("prev_text"), F.col("text")))


def _taught_by_spans(spans: Column) -> Column:
    """Names, and companies of more than one word, among one paragraph's resolved spans."""
    keep = F.filter(
        spans,
        lambda s: (s["pii_type"] == "name") | ((s["pii_type"] == "company") & (X.word_count(s["value"]) > 1)),
    )
    return F.transform(
        keep, lambda s: F.struct(s["pii_type"].alias("pii_type"), X.strip(s["value"]).alias("value"))
    )


def _distinct_values(rows: DataFrame, typed: str | Column) -> DataFrame:
    # The outer form, for the reason given at ``span_rows``.
    return rows.select("doc_id", F.inline_outer(typed)).filter(F.col("value").isNotNull()).distinct()


def label_pairs(paragraphs: DataFrame) -> DataFrame:
    """``(doc_id, pii_type, value)`` of values that follow a paragraph which is a label."""
    return _distinct_values(_taught_by_label(with_previous(paragraphs)), "taught")


def seeds(paragraphs: DataFrame) -> DataFrame:
    """``(doc_id, pii_type, value)`` of the names and companies the first pass finds."""
    spans = seed_candidates(paragraphs).withColumn("spans", on(S.resolve, "candidates"))
    return _distinct_values(spans.withColumn("taught", on(_taught_by_spans, "spans")), "taught")


def learn(paragraphs: DataFrame) -> DataFrame:
    """``dictionary(doc_id, pii_type, value)`` of every document: seeds and label pairs, in one scan."""
    rows = seed_candidates(with_previous(paragraphs)).withColumn("spans", on(S.resolve, "candidates"))
    rows = _taught_by_label(rows)
    return _distinct_values(
        rows.withColumn("taught", F.concat("taught", on(_taught_by_spans, "spans"))), "taught"
    )


def searched(paragraphs: DataFrame) -> DataFrame:
    """Paragraphs with all their ``candidates``, and ``taught``: the typed values that each teaches, as in ``learn``."""
    rows = _taught_by_label(candidates(with_previous(paragraphs)))
    teaches = F.exists("candidates", lambda s: s["pii_type"].isin(*TAUGHT_BY_FINDS))
    rows = rows.withColumn("spans", F.when(teaches, on(S.resolve, "candidates")).otherwise(S.no_spans()))
    kept = ["doc_id", "para_idx", "story", "text", *[c for c in ("source",) if c in paragraphs.columns]]
    return rows.select(*kept, "candidates", F.concat("taught", on(_taught_by_spans, "spans")).alias("taught"))


def taught(rows: DataFrame) -> DataFrame:
    """``dictionary(doc_id, pii_type, value)`` of paragraphs from ``searched``."""
    return _distinct_values(rows, "taught")


def _rank(pii_type: Column) -> Column:
    rank = F
    for kind, level in DICTIONARY_RANKS.items():
        rank = rank.when(pii_type == kind, level)
    return rank


def _tokens(text: Column) -> Column:
    """Distinct words of a text, and every three signs in a row.

    A value occurs where no word character touches it, so its words are words of the text there. A value
    without any word has two words of signs at least: three characters in a row that are no word characters.
    """
    words = F.regexp_extract_all(text, F.lit(java(r"\w+")), F.lit(0))
    signs = F.regexp_extract_all(text, F.lit(f"(?=([^{WORD}]{{3}}))"), F.lit(1))
    return F.array_distinct(F.concat(words, signs))


def _own_tokens(value: Column) -> Column:
    """A value's words; its signs only if it has none."""
    own = _tokens(value)
    words = F.filter(own, lambda t: t.rlike(java(r"\w")))
    return F.when(F.size(words) > 0, words).otherwise(own)


def with_dictionary_hits(paragraphs: DataFrame, dictionary: DataFrame, hint: str | None = None) -> DataFrame:
    """Adds ``hits``: the dictionary's values in the paragraphs of their own document.

    A document's few values, or those that an inverted index finds under their rarest token, are searched in the text.
    """
    # Others have no token (see ``_tokens``).
    findable = F.col("value").rlike(java(r"\w")) | (F.length("value") >= 3)
    values = dictionary.select("doc_id", "pii_type", "value").filter(findable)
    value = F.struct("pii_type", "value", _rank(F.col("pii_type")).alias("detector_rank"))
    rows = inverted.with_values(paragraphs, "text", _tokens, values, _own_tokens(F.col("value")), value, hint)
    found = F.coalesce(on(_hits_of_values, "text", "_values"), S.no_spans())
    return rows.withColumn("hits", found).drop("_values")


def _hits_of_values(text: Column, values: Column) -> Column:
    occurring = F.filter(values, lambda v: F.contains(text, v["value"]))
    return F.flatten(
        F.transform(occurring, lambda v: S.find_literal(text, v["value"], v["pii_type"], v["detector_rank"]))
    )


def dictionary_hits(paragraphs: DataFrame, dictionary: DataFrame, hint: str | None = None) -> DataFrame:
    """One row per occurrence of a dictionary value."""
    return span_rows(with_dictionary_hits(paragraphs, dictionary, hint), "hits")
