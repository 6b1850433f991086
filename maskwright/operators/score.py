"""Scores against labelled cases, and audits of redacted documents."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright.operators import inverted
from maskwright.plans.staging import Workspace
from maskwright.schema import PII_TYPES


def _found(mode: str) -> Column:
    # At most nine types per case and mode.
    return F.collect_set(F.when(F.col("mode") == mode, F.col("pii_type")))


def judged(cases: DataFrame, spans: DataFrame) -> DataFrame:
    """Per view and case, the gold types and the found ones.

    ``spans`` holds ``(mode, case_id, pii_type)``. Three views: rules on their own gold, rules on
    the full gold, hybrid on the full gold.
    """
    found = spans.groupBy("case_id").agg(_found("rules").alias("rules"), _found("hybrid").alias("hybrid"))
    rows = cases.join(found, "case_id", "left")
    none = F.array().cast("array<string>")
    view = lambda name, gold, by: F.struct(
        F.lit(name).alias("view"), F.col(gold).alias("gold"), F.coalesce(F.col(by), none).alias("found")
    )
    views = F.array(
        view("rules", "gold_rules", "rules"),
        view("rules_against_full_gold", "gold_full", "rules"),
        view("hybrid", "gold_full", "hybrid"),
    )
    return rows.select("case_id", F.inline(views))


def _ratio(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0))


def scores(cases: DataFrame, spans: DataFrame) -> DataFrame:
    """One row per view: counts and ratios. A true negative is a case with no type on either side."""
    both = F.size(F.array_intersect("gold", "found"))
    counts = judged(cases, spans).groupBy("view").agg(
        F.count("*").alias("cases"),
        F.sum(both).alias("tp"),
        F.sum(F.size("found") - both).alias("fp"),
        F.sum(F.size("gold") - both).alias("fn"),
        F.count_if((F.size("gold") == 0) & (F.size("found") == 0)).alias("tn"),
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return counts.withColumns(
        {
            "precision": _ratio(tp, tp + fp),
            "recall": _ratio(tp, tp + fn),
            "accuracy": _ratio(tp + tn, tp + tn + fp + fn),
        }
    )


def as_percentages(scored: DataFrame) -> DataFrame:
    return scored.withColumns({c: F.round(F.col(c) * 100, 1) for c in ("precision", "recall", "accuracy")})


def per_type(cases: DataFrame, spans: DataFrame) -> DataFrame:
    """One row per view and type that occurs in gold or finds."""
    kind = F.explode(F.array_union("gold", "found")).alias("pii_type")
    rows = judged(cases, spans).select("view", kind, "gold", "found")
    expected = F.array_contains("gold", F.col("pii_type"))
    seen = F.array_contains("found", F.col("pii_type"))
    return rows.groupBy("view", "pii_type").agg(
        F.count_if(expected & seen).alias("tp"),
        F.count_if(~expected & seen).alias("fp"),
        F.count_if(expected & ~seen).alias("fn"),
    )


def _grams(text: Column) -> Column:
    """The distinct stretches of one, two and three characters of a text."""
    of = lambda n: F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1))
    return F.array_distinct(F.concat(of(1), of(2), of(3)))


def _own_grams(value: Column) -> Column:
    """The longest stretches a value has."""
    longest = F.least(F.length(value), F.lit(3))
    return F.filter(_grams(value), lambda g: F.length(g) == longest)


def occurring(redacted: DataFrame, expected: DataFrame) -> DataFrame:
    """The ``expected(doc_id, value)`` that stand anywhere in the redacted text of their document, also inside a word.

    A document's few values, or those that an inverted index finds under their rarest three characters, are searched in the text.
    """
    values = expected.select("doc_id", "value").filter(F.col("value").isNotNull()).distinct()
    texts = redacted.select("doc_id", "para_idx", "redacted")
    rows = inverted.with_values(texts, "redacted", _grams, values, _own_grams(F.col("value")), F.col("value"))
    # An empty value stands in every text.
    hits = F.filter("_values", lambda v: (v == "") | F.contains(F.col("redacted"), v))
    return rows.select("doc_id", F.explode_outer(hits).alias("value")).filter(F.col("value").isNotNull()).distinct()


def leaks(redacted: DataFrame, gone: DataFrame, kept: DataFrame) -> DataFrame:
    """``(doc_id, value, problem)``: originals that remain, controls that vanished. The texts are searched once for both."""
    marked = lambda rows, is_gone: rows.select("doc_id", "value", F.lit(is_gone).alias("_gone"))
    expected = marked(gone, True).unionByName(marked(kept, False)).groupBy("doc_id", "value").agg(
        F.bool_or("_gone").alias("_gone"), F.bool_or(~F.col("_gone")).alias("_kept")
    )
    expected = Workspace(redacted.sparkSession).stage(expected, "expected")
    present = occurring(redacted, expected).withColumn("_present", F.lit(True))
    stands = F.coalesce("_present", F.lit(False))
    problems = F.array(F.when(F.col("_gone") & stands, "remains"), F.when(F.col("_kept") & ~stands, "missing"))
    rows = expected.join(present, ["doc_id", "value"], "left").select("doc_id", "value", F.explode(problems).alias("problem"))
    return rows.filter(F.col("problem").isNotNull())


def coverage(spans: DataFrame, documents: DataFrame, required: tuple[str, ...] = PII_TYPES) -> DataFrame:
    """Per document of ``documents(doc_id)``, the required types not found in it; all of them where nothing was found."""
    types = F.array(*[F.lit(t) for t in required])
    # At most nine types per document.
    found = spans.groupBy("doc_id").agg(F.collect_set("pii_type").alias("found"))
    rows = documents.select("doc_id").distinct().join(found, "doc_id", "left")
    lacking = F.array_sort(F.array_except(types, F.coalesce("found", F.array().cast("array<string>"))))
    rows = rows.select("doc_id", lacking.alias("lacking"))
    return rows.select(
        "doc_id", F.array_join("lacking", ",").alias("lacking"), (F.size("lacking") == 0).alias("complete")
    )


def mode_delta(spans: DataFrame, documents: DataFrame) -> DataFrame:
    """Per document of ``documents(doc_id)``, redactions by mode and what hybrid adds; ``spans`` holds ``(mode, doc_id)``."""
    counts = spans.groupBy("doc_id").agg(
        F.count_if(F.col("mode") == "rules").alias("rules"), F.count_if(F.col("mode") == "hybrid").alias("hybrid")
    )
    rows = documents.select("doc_id").distinct().join(counts, "doc_id", "left").fillna(0, ["rules", "hybrid"])
    return rows.withColumn("added", F.col("hybrid") - F.col("rules"))
