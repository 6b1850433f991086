"""Redaction of arriving documents.

All state is per document, so a micro-batch of whole documents needs none from earlier batches:
each batch runs the batch plan. Batches land in a partition of their own that a repeated batch
overwrites, because redacting redacted text again would replace the replacements.
"""

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from maskwright.plans.redact import redact
from maskwright.plans.staging import Workspace
from maskwright.schema import check_mode
from maskwright.sources.paragraphs import from_documents
from maskwright.sources.sinks import write_mapping_batch, write_redacted, write_summary

ANNOTATION = "struct<para_idx: int, start: int, end: int, label: string, text: string>"
ANNOTATIONS = f"array<{ANNOTATION}>"


def batch_writer(
    output: str, mode: str = "rules", mapping: str | None = None, ner_model: str | None = None
) -> Callable[[DataFrame, int], None]:
    """Writes a batch of ``(doc_id, text)``, in hybrid mode with ``annotations``, and any ``source`` column.

    ``mapping`` names a folder for the replacement map, apart from the output; without it no map is written.
    """
    check_mode(mode)

    def write(docs: DataFrame, batch_id: int) -> None:
        workspace = Workspace(docs.sparkSession)
        try:
            carried = [c for c in ("source",) if c in docs.columns]
            # The stream's rows of the batch are computed once; a join of streams would otherwise run for each pass.
            rows = workspace.stage(docs, "batch")
            entities = rows.select("doc_id", F.inline("annotations")) if mode == "hybrid" else None
            result = redact(from_documents(rows, *carried), mode, entities, workspace=workspace, ner_model=ner_model)
            target = f"{output}/redacted/batch_id={batch_id}"
            write_redacted(result.redacted, target, *carried)
            write_summary(result.summary, f"{output}/summary/batch_id={batch_id}", "stream", target)
            if mapping is not None:
                write_mapping_batch(result.mapping, mapping, batch_id)
        finally:
            workspace.release()

    return write


def start(
    docs: DataFrame,
    output: str,
    checkpoint: str,
    once: bool = False,
    mode: str = "rules",
    mapping: str | None = None,
    ner_model: str | None = None,
) -> StreamingQuery:
    """Redacts a stream of ``(doc_id, text)``; ``once`` stops when all present input is done.

    In hybrid mode the stream has ``annotations`` (see ``with_annotations``).
    """
    write = batch_writer(output, mode, mapping, ner_model)
    writer = docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def with_annotations(docs: DataFrame, annotations: DataFrame, wait: str = "10 minutes") -> DataFrame:
    """Documents ``(doc_id, text, arrived)`` joined with annotations that arrive apart, ``(doc_id, annotations, arrived)``.

    Both streams are held for ``wait`` of event time, on a watermark. A document goes on as soon as its annotations are
    there, if the two arrived within ``wait`` of one another. When the watermark has passed it without any, it goes on with none: rules
    alone redact it. Annotations (or documents) older than the watermark are late: Spark drops them, and ``late_rows`` counts them.
    One row per document on either side is expected; a document with several rows of annotations would go on several times.
    """
    own = docs.withWatermark("arrived", wait)
    said = annotations.select(
        F.col("doc_id").alias("_doc_id"), F.col("annotations").cast(ANNOTATIONS).alias("annotations"), F.col("arrived").alias("_arrived")
    ).withWatermark("_arrived", wait)
    near = F.expr(f"_arrived BETWEEN arrived - INTERVAL {wait} AND arrived + INTERVAL {wait}")
    joined = own.join(said, (F.col("doc_id") == F.col("_doc_id")) & near, "left_outer")
    return joined.withColumn("annotations", F.coalesce("annotations", F.array().cast(ANNOTATIONS))).drop("_doc_id", "_arrived")


def late_rows(query: StreamingQuery) -> int:
    """How many rows of a query's recent batches came after the watermark had passed them."""
    return sum(int(s["numRowsDroppedByWatermark"]) for p in query.recentProgress for s in p["stateOperators"])
