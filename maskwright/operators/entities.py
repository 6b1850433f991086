"""Annotations of an external entity model, read from a table, as spans."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright import fixed_values as fixed
from maskwright.functions import spans as S
from maskwright.functions import text as X
from maskwright.functions.dialect import label_and_value
from maskwright.operators.detectors import ENTITY_RANK
from maskwright.plans.staging import in_tasks

# What the model's labels mean.
PERSON_LABELS = ("PERSON",)
ORGANISATION_LABELS = ("ORG",)
PLACE_LABELS = ("GPE", "LOC", "FAC")
SHORTEST = 3


def looks_like_address(text: Column) -> Column:
    return (
        text.rlike(label_and_value(*fixed.ADDRESS_LABEL)) | X.has_address_hint(text) | X.has_postal(text)
    )


def with_entity_spans(paragraphs: DataFrame, entities: DataFrame) -> DataFrame:
    """Adds ``entity_spans``. The groups are one paragraph's annotations; the join key is unique."""
    grouped = (
        entities.groupBy("doc_id", "para_idx")
        .agg(F.collect_list(F.struct("start", "end", "label", F.col("text").alias("words"))).alias("entities"))
    )
    key = ["doc_id", "para_idx"]
    rows = in_tasks(paragraphs, key).join(in_tasks(grouped, key, paragraphs), key, "left")

    def keep(e: Column) -> Column:
        value = X.strip(e["words"])
        person = e["label"].isin(*PERSON_LABELS) & X.is_person(value)
        organisation = e["label"].isin(*ORGANISATION_LABELS) & (X.word_count(value) <= 9)
        place = e["label"].isin(*PLACE_LABELS) & looks_like_address(F.col("text"))
        return (F.length(value) >= SHORTEST) & (person | organisation | place)

    def as_span(e: Column) -> Column:
        pii_type = (
            F.when(e["label"].isin(*PERSON_LABELS), "name")
            .when(e["label"].isin(*ORGANISATION_LABELS), "company")
            .otherwise("address")
        )
        return S.span(e["start"], e["end"], pii_type, X.strip(e["words"]), ENTITY_RANK)

    # A paragraph of blanks carries no annotations worth having.
    usable = F.filter("entities", lambda e: ~X.is_blank(F.col("text")) & keep(e))
    return rows.withColumn("entity_spans", F.transform(usable, as_span)).drop("entities")
