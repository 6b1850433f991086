"""Texts with their spans replaced."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright.functions import plain
from maskwright.functions.reuse import on
from maskwright.functions.sweep import let
from maskwright.functions.text import TEXT_BLOCK, cut, in_blocks, normalise
from maskwright.functions.workers import in_worker
from maskwright.operators.numbering import chunk_of
from maskwright.operators.pseudonym import KEY, keyed
from maskwright.schema import CHUNK


def replacements(spans: DataFrame, looked_up: DataFrame, size: int = CHUNK) -> DataFrame:
    """Spans (one per row) with their ``fake``."""
    fakes = looked_up.select(*KEY, "chunk", "fake")
    return keyed(spans, size).join(fakes, [*KEY, "chunk"]).drop("norm_value", "chunk")


def _span_rows(paragraphs: DataFrame) -> DataFrame:
    rows = paragraphs.select("doc_id", "para_idx", F.inline_outer("spans"))
    return rows.filter(F.col("start").isNotNull())


def spliced(text: Column, replaced: Column) -> Column:
    """``text`` with every ``(start, end, fake)``, in order and disjoint, put in its place."""
    pieces = F.transform(
        replaced,
        lambda r, i: F.struct(
            F.when(i == 0, 0).otherwise(F.get(replaced, i - 1)["end"]).alias("from"),
            r["start"].alias("to"),
            r["fake"].alias("fake"),
        ),
    )
    tail_from = F.element_at(replaced, -1)["end"]

    def joined(blocks: Column) -> Column:
        kept = F.transform(pieces, lambda p: F.concat(cut(blocks, p["from"], p["to"]), p["fake"]))
        return F.concat(F.array_join(kept, ""), cut(blocks, tail_from, F.length(text)))

    # In a short text every place is near its start.
    def short(r: Column, i: Column) -> Column:
        first = F.when(i == 0, 0).otherwise(F.get(replaced, i - 1)["end"])
        return F.concat(F.substring(text, first + 1, r["start"] - first), r["fake"])

    tail = F.substring(text, tail_from + 1, F.length(text))
    whole = F.concat(F.array_join(F.transform(replaced, short), ""), tail)
    return F.when(F.length(text) <= TEXT_BLOCK, whole).otherwise(let(in_blocks(text), joined))


# Up to this many keys of one chunk of a document go along with each of its paragraphs.
FEW = 64


def set_apart(paragraphs: DataFrame, looked_up: DataFrame, size: int = CHUNK, few: int = FEW) -> DataFrame | None:
    """``(doc_id, chunk)`` of the chunks with more than ``few`` keys, or with changed paragraphs that come more than once.

    Runs a job that looks for them; none, if there are none.
    """
    one = F.count("*").alias("_n")
    many = looked_up.groupBy("doc_id", "chunk").agg(one).filter(F.col("_n") > few).select("doc_id", "chunk")
    changed = paragraphs.filter(F.size("spans") > 0)
    repeated = changed.groupBy("doc_id", "para_idx").agg(one).filter(F.col("_n") > 1)
    repeated = repeated.select("doc_id", chunk_of(F.col("para_idx"), size).alias("chunk"))
    apart = many.unionByName(repeated).dropna().distinct()
    return None if apart.isEmpty() else apart


def _replaced(spans: Column, fakes: Column) -> Column:
    own = lambda s: F.concat(s["pii_type"], F.lit(":"), normalise(s["value"]))
    found = F.transform(spans, lambda s: F.struct(s["start"], s["end"], fakes[own(s)].alias("fake")))
    return F.filter(found, lambda r: r["fake"].isNotNull())


def replaced(paragraphs: DataFrame, looked_up: DataFrame, apart: DataFrame | None, size: int = CHUNK) -> DataFrame:
    """The changed paragraphs with ``_replaced``: their spans, in order, with the replacements.

    Paragraphs meet the keys of their chunk of the document, as one map. In chunks that are ``set_apart``, spans meet their keys one by one.
    """
    changed = paragraphs.filter(F.size("spans") > 0).withColumn("chunk", chunk_of(F.col("para_idx"), size))
    place = ["doc_id", "chunk"]
    few, keys = (x if apart is None else x.join(apart, place, "left_anti") for x in (changed, looked_up))
    entry = F.struct(F.concat_ws(":", "pii_type", "norm_value"), "fake")
    # At most ``FEW`` entries.
    fakes = keys.groupBy(*place).agg(F.map_from_entries(F.collect_list(entry)).alias("_fakes"))
    rows = few.join(fakes, place).withColumn("_replaced", on(_replaced, "spans", "_fakes")).drop("_fakes", "chunk")
    if apart is None:
        return rows
    rest = changed.join(apart, place, "left_semi").drop("chunk")
    # Groups are the spans inside one paragraph.
    one_by_one = (
        replacements(_span_rows(rest), looked_up, size)
        .groupBy("doc_id", "para_idx")
        .agg(F.array_sort(F.collect_list(F.struct("start", "end", "fake"))).alias("_replaced"))
    )
    return rows.unionByName(rest.join(one_by_one, ["doc_id", "para_idx"]).select(*rows.columns))


def rewrite(paragraphs: DataFrame, changed: DataFrame) -> DataFrame:
    """``redacted`` for paragraphs with resolved ``spans``, and those ``changed``, as ``replaced`` gives them; those without any pass unshuffled."""
    same = paragraphs.filter(F.size("spans") == 0)
    columns = ["doc_id", "para_idx", "story", *[c for c in ("source",) if c in paragraphs.columns]]
    rewritten = changed.select(*columns, on(spliced, "text", "_replaced").alias("redacted"), F.lit(True).alias("changed"))
    untouched = same.select(*columns, F.col("text").alias("redacted"), F.lit(False).alias("changed"))
    return untouched.unionByName(rewritten)


def with_runs(paragraphs: DataFrame, runs: DataFrame) -> DataFrame:
    """Adds ``_runs`` of changed paragraphs and empties ``spans`` of those without runs: nothing there can be rewritten.

    Groups are the runs of one paragraph.
    """
    key = ["doc_id", "para_idx"]
    styles = runs.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("start", "end", "run_idx", "style"))).alias("_runs"))
    rows = paragraphs.join(styles, key, "left")
    none = F.filter("spans", lambda s: F.lit(False))
    rows = rows.withColumn("spans", F.when(F.col("_runs").isNotNull(), F.col("spans")).otherwise(none))
    return rows.withColumn("_runs", F.when(F.size("spans") > 0, F.col("_runs")))


_PIECES = "array<struct<text: string, style: string>>"


def _styled(text: Column, replaced: Column, runs: Column) -> Column:
    """``plain.pieces`` of runs ``(start, end, run_idx, style)`` and spans ``(start, end, fake)``, both in order and disjoint."""
    return in_worker(plain.piece_batch, _PIECES, text, replaced, runs)


def run_pieces(changed: DataFrame) -> DataFrame:
    """Rewritten paragraphs as styled pieces ``(doc_id, para_idx, piece_idx, text, style)``, of paragraphs with ``_runs`` and ``_replaced``.

    Text between spans keeps the runs it stood in, which do not overlap; a replacement takes the style of the run in
    which its span starts, or of the first run. Only changed paragraphs have pieces.
    """
    key = ["doc_id", "para_idx"]
    rows = changed.select(*key, _styled(F.col("text"), F.col("_replaced"), F.col("_runs")).alias("_pieces"))
    rows = rows.select(*key, F.posexplode("_pieces").alias("piece_idx", "piece"))
    return rows.select(*key, "piece_idx", "piece.text", "piece.style")
