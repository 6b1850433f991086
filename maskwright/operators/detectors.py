"""The thirteen pattern detectors and their registry.

The patterns run in Python workers (``functions.plain``), batch by batch; a cheap necessary condition of each comes first.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright.functions import plain
from maskwright.functions import spans as S
from maskwright.functions.reuse import on
from maskwright.functions.workers import in_worker
from maskwright.schema import SPANS


@dataclass(frozen=True)
class Detector:
    """``plain.FINDERS`` holds what each does, by name. Rank breaks ties; texts with fewer than ``least_digits`` digits hold none."""

    name: str
    pii_type: str
    rank: int
    least_digits: int = 0


DETECTORS = (
    Detector("address_label", "address", 1),
    Detector("address_line", "address", 2, 5),
    Detector("email", "email", 3),
    Detector("ssn", "ssn", 4, 9),
    Detector("ip", "ip", 5, 4),
    Detector("card", "card", 6, 14),
    Detector("phone_shape", "phone", 7, 10),
    Detector("phone_label", "phone", 8, 10),
    Detector("birth_date", "dob", 9, 4),
    Detector("name_label", "name", 10),
    Detector("contact_list", "name", 11),
    Detector("titled_name", "name", 12),
    Detector("company", "company", 13),
)

# Ranks of the finds that come from elsewhere; they break ties after the patterns above.
DICTIONARY_RANKS = {"name": 14, "company": 15, "dob": 16, "phone": 17, "address": 18}
ENTITY_RANK = 19

# The types whose finds teach the document's dictionary.
TAUGHT_BY_FINDS = ("name", "company")


def detector(name: str) -> Detector:
    return next(d for d in DETECTORS if d.name == name)


def _finds(detectors: tuple[Detector, ...]) -> Column:
    """All finds of the detectors in a paragraph, unresolved."""
    known = [(d.name, d.pii_type, d.rank, d.least_digits) for d in detectors]
    return in_worker(plain.finder(known), SPANS, F.col("text"))


def candidates(paragraphs: DataFrame, detectors: tuple[Detector, ...] = DETECTORS) -> DataFrame:
    """Adds ``candidates``: every find of the patterns and of the annotations, overlaps included."""
    rows = paragraphs.withColumn("candidates", _finds(detectors))
    if "entity_spans" not in paragraphs.columns:
        return rows
    rows = rows.withColumn("candidates", F.concat("candidates", F.coalesce("entity_spans", S.no_spans())))
    return rows.withColumn("candidates", on(S.with_original_values, "candidates", "text"))


def seed_candidates(paragraphs: DataFrame) -> DataFrame:
    """As ``candidates``, but empty for paragraphs in which no name or company was found: there the first pass learns nothing."""
    teaches = F.exists("candidates", lambda s: s["pii_type"].isin(*TAUGHT_BY_FINDS))
    return candidates(paragraphs).withColumn("candidates", F.when(teaches, F.col("candidates")).otherwise(S.no_spans()))


def span_rows(paragraphs: DataFrame, column: str) -> DataFrame:
    """One row per span of an array column.

    Spark infers a filter on the array below a plain ``inline`` and would compute the array once
    more for it. It infers none below the outer form.
    """
    rows = paragraphs.select("doc_id", "para_idx", F.inline_outer(column))
    return rows.filter(F.col("start").isNotNull())
