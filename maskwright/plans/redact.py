"""From documents to redacted documents, their mapping and their summary."""

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.functions import spans as S
from maskwright.functions.reuse import on
from maskwright.operators import dictionary as D
from maskwright.operators import pseudonym, report, rewrite
from maskwright.operators.detectors import candidates
from maskwright.operators.entities import with_entity_spans
from maskwright.plans.staging import Workspace
from maskwright.schema import check_mode


@dataclass(frozen=True)
class Result:
    redacted: DataFrame
    mapping: DataFrame
    summary: DataFrame
    spans: DataFrame
    pieces: DataFrame | None
    workspace: Workspace


def resolved(paragraphs: DataFrame, dictionary: DataFrame | None = None) -> DataFrame:
    """Adds ``spans``: the finds of patterns, annotations and dictionary, overlaps resolved.

    Paragraphs that have their ``candidates`` already are not searched for patterns again.
    """
    rows = paragraphs.drop("prev_text")
    if dictionary is not None:
        rows = D.with_dictionary_hits(rows, dictionary)
    rows = rows if "candidates" in rows.columns else candidates(rows)
    found = F.concat("candidates", on(S.without_doubles, "hits", "candidates")) if dictionary is not None else F.col("candidates")
    return rows.withColumn("candidates", found).select(
        "doc_id", "para_idx", "story", "text", *[c for c in ("source",) if c in paragraphs.columns],
        on(S.resolve, "candidates").alias("spans"),
    )


def redact(
    paragraphs: DataFrame,
    mode: str = "rules",
    entities: DataFrame | None = None,
    runs: DataFrame | None = None,
    workspace: Workspace | None = None,
    ner_model: str | None = None,
) -> Result:
    """Redacts paragraphs document by document.

    One pass reads the input and runs the patterns, for the dictionary and for the finds. What it found, the dictionary, the
    resolved paragraphs and the keys' occurrences are written as tables; everything returned is computed from those.
    """
    workspace = workspace or Workspace(paragraphs.sparkSession)
    if check_mode(mode) == "hybrid":
        if entities is None:
            raise ValueError("hybrid mode reads annotations: pass an entities table")
        paragraphs = with_entity_spans(D.with_previous(paragraphs), entities)

    searched = workspace.stage(D.searched(paragraphs), "searched")
    dictionary = workspace.stage(D.taught(searched), "dictionary")
    found = resolved(searched.drop("taught"), dictionary)
    if runs is not None:
        found = rewrite.with_runs(found, runs)
    found = workspace.stage(found, "paragraphs")

    span_rows = rewrite._span_rows(found)
    occurring = workspace.stage(pseudonym.occurrences(span_rows), "occurrences")
    looked_up = workspace.stage(pseudonym.lookups(occurring), "lookups")
    changed = rewrite.replaced(found, looked_up, rewrite.set_apart(found, looked_up))
    return Result(
        redacted=rewrite.rewrite(found, changed),
        mapping=pseudonym.mapping(looked_up),
        summary=report.summary(found, occurring, mode, ner_model if mode == "hybrid" else None),
        spans=span_rows,
        pieces=None if runs is None else rewrite.run_pieces(changed),
        workspace=workspace,
    )
