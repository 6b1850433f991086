"""Both modes on labelled cases: what is found against what should be."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.functions import spans as S
from maskwright.functions.reuse import on
from maskwright.operators import score
from maskwright.operators.detectors import candidates
from maskwright.operators.entities import with_entity_spans


def spans_by_mode(annotated: DataFrame) -> DataFrame:
    """``(doc_id, para_idx, mode, …)``, a row per span that either mode keeps, of paragraphs with ``entity_spans``.

    The patterns run once: the modes differ in whether annotations compete with their finds.
    """
    rows = candidates(annotated.withColumnRenamed("entity_spans", "_annotations"))
    rows = rows.withColumn("_annotations", on(S.with_original_values, "_annotations", "text"))
    rules = on(S.resolve, "candidates").alias("_rules")
    with_annotations = F.flatten(F.array("candidates", F.coalesce("_annotations", S.no_spans())))
    rows = rows.select("doc_id", "para_idx", rules, "_annotations", with_annotations.alias("_both"))
    hybrid = F.when(F.size("_annotations") > 0, on(S.resolve, "_both")).otherwise(F.col("_rules"))
    of_mode = lambda mode, spans: F.struct(F.lit(mode).alias("mode"), spans.alias("_spans"))
    modes = rows.select("doc_id", "para_idx", F.inline_outer(F.array(of_mode("rules", F.col("_rules")), of_mode("hybrid", hybrid))))
    return modes.select("doc_id", "para_idx", "mode", F.inline_outer("_spans")).filter(F.col("start").isNotNull())


def case_spans(cases: DataFrame, entities: DataFrame) -> DataFrame:
    """``(mode, case_id, pii_type, …)``: the finds of both modes. Cases stand alone, so nothing is learned from them.

    ``entities`` holds the annotations of the cases, with ``case_id`` as ``doc_id`` and ``para_idx`` 0.
    """
    paragraphs = cases.select(
        F.col("case_id").alias("doc_id"), F.lit(0).alias("para_idx"), F.lit("body").alias("story"), "text"
    )
    return spans_by_mode(with_entity_spans(paragraphs, entities)).withColumnRenamed("doc_id", "case_id").drop("para_idx")


def evaluate(cases: DataFrame, entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Scores in percent per view, and counts per view and type, of ``cases(case_id, text, gold_rules, gold_full)``."""
    spans = case_spans(cases, entities)
    return score.as_percentages(score.scores(cases, spans)), score.per_type(cases, spans)
