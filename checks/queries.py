"""The registered queries, by name."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import forms as forms_corpus
from maskwright import fixed_values as fixed
from maskwright.functions import spans as S
from maskwright.functions import text as X
from maskwright.operators import detectors, dictionary, entities, pseudonym, report, rewrite, score
from maskwright.plans import evaluate
from maskwright.plans.redact import Result, redact, resolved
from maskwright.plans.staging import Workspace
from maskwright.sources import paragraphs as P
from maskwright.streaming import incremental

Query = Callable[[SparkSession, str], DataFrame]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.from_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def form_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.from_documents(forms_corpus.forms(spark, sf_dir))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.from_rows(spark.read.parquet(f"{sf_dir}/conversations.parquet"), "conv_id", "turn", "text")


def spans_of(detector: str, source: Query) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = detectors.candidates(source(spark, sf_dir), (detectors.detector(detector),))
        return detectors.span_rows(rows, "candidates")

    return query


def paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", "para_idx", "story", "text")


def conversation_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.with_previous(turns(spark, sf_dir))


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order sheets: a title, a table of items with merged cells, a header and a footer."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr("o_orderkey AS doc_id", "*")
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr("l_orderkey AS doc_id", "*")
    columns = "element_id", "story", "section", "in_table", "path", "text"

    def block(*values: str) -> str:
        return "named_struct(" + ", ".join(f"'{c}', {v}" for c, v in zip(columns, values)) + ")"

    def cell(number: int, element: str, text: str) -> str:
        path = f"array(0, l_linenumber, {number}, 0, int(l_partkey), int(l_suppkey))"
        return block(f"concat(item, {element})", "'body'", "0", "true", path, text)

    title = block("'t'", "'body'", "0", "false", "array(0)", "o_orderstatus")
    blank = block("'e'", "'body'", "0", "false", "array(1)", "''")
    footer = block("'f'", "'footer'", "0", "false", "array(0)", "o_orderpriority")
    header = block("'h'", "'header'", "0", "false", "array(0)", "concat('Order ', doc_id)")
    plain = orders.selectExpr("doc_id", f"inline(array({title}, {blank}, {footer}, {header}))")
    merged = cell(2, "if(l_quantity > 25, '/1', '/2')", "if(l_quantity > 25, string(l_suppkey), l_returnflag)")
    cells = items.withColumn(
        "item", F.concat_ws("-", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")
    ).selectExpr(
        "doc_id",
        f"inline(array({cell(0, "'/0'", 'string(l_partkey)')}, {cell(1, "'/1'", 'string(l_suppkey)')}, {merged}))",
    )
    return plain.unionByName(cells)


def story_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.from_blocks(blocks(spark, sf_dir))


def preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.preview(documents(spark, sf_dir), fixed.PREVIEW_LINES)


def text_helpers(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    return form_lines(spark, sf_dir).select(
        "doc_id",
        "para_idx",
        X.normalise(text).alias("normalised"),
        X.hash_bucket(X.normalise(text)).alias("bucket"),
        F.length(X.digits(text)).cast("bigint").alias("n_digits"),
        X.word_count(text).cast("bigint").alias("n_words"),
        X.luhn(text).alias("luhn"),
        X.label_type(text).alias("label"),
        X.has_postal(text).alias("postal"),
        X.has_address_hint(text).alias("hint"),
        X.is_person(text).alias("person"),
    )


def label_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dictionary.label_pairs(form_lines(spark, sf_dir))


def learned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dictionary.learn(form_lines(spark, sf_dir))


def dictionary_hits(spark: SparkSession, sf_dir: str, hint: str | None = None) -> DataFrame:
    lines = form_lines(spark, sf_dir)
    words = Workspace(spark).stage(dictionary.learn(lines), "dictionary")
    return dictionary.dictionary_hits(lines.drop("prev_text"), words, hint)


def dictionary_hits_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``dictionary_hits``, by a sort-merge join, as for a dictionary of any size."""
    return dictionary_hits(spark, sf_dir, "merge")


def resolved_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = form_lines(spark, sf_dir)
    words = Workspace(spark).stage(dictionary.learn(lines), "dictionary")
    return detectors.span_rows(resolved(lines, words), "spans")


def resolved_document_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detectors.span_rows(resolved(documents(spark, sf_dir)), "spans")


def entity_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = entities.with_entity_spans(form_lines(spark, sf_dir), forms_corpus.entities(spark, sf_dir))
    return detectors.span_rows(rows, "entity_spans")


def _redacted_forms(spark: SparkSession, sf_dir: str, **options) -> Result:
    return redact(form_lines(spark, sf_dir), **options)


def ordinals(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = detectors.span_rows(resolved(documents(spark, sf_dir)), "spans")
    occurring = Workspace(spark).stage(pseudonym.occurrences(spans), "occurrences")
    return pseudonym.ordinals(occurring).drop("first")


def mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _redacted_forms(spark, sf_dir).mapping


def redacted_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _redacted_forms(spark, sf_dir).redacted.drop("story")


def redacted_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redact(documents(spark, sf_dir)).redacted.drop("story")


def redacted_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redact(turns(spark, sf_dir)).redacted.drop("story")


def redaction_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = detectors.span_rows(resolved(documents(spark, sf_dir)), "spans")
    return report.redactions_by_type(pseudonym.occurrences(spans))


def doc_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _redacted_forms(spark, sf_dir).summary
    return rows.withColumn("redactions", F.to_json("redactions"))


def marker_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.marker_audit(_redacted_forms(spark, sf_dir).redacted)


def run_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines styled in stretches of seven characters; every fourteenth line has no runs at all."""
    lines = form_lines(spark, sf_dir)
    n = F.length("text")
    runs = lines.filter((n > 0) & (F.col("para_idx") != 13)).select(
        "doc_id", "para_idx", n.alias("n"), F.explode(F.sequence(F.lit(0), F.floor((n - 1) / 7).cast("int"))).alias("run_idx")
    )
    styled = runs.select(
        "doc_id",
        "para_idx",
        "run_idx",
        (F.col("run_idx") * 7).alias("start"),
        F.least(F.col("run_idx") * 7 + 7, F.col("n")).alias("end"),
        F.when(F.col("run_idx") % 3 == 0, "plain").when(F.col("run_idx") % 3 == 1, "bold").otherwise("italic").alias("style"),
    )
    return redact(lines, runs=styled).pieces


def _cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    types = lambda which: F.filter(
        F.split(F.expr(forms_corpus.gold(which)), ","), lambda t: t != ""
    )
    return form_lines(spark, sf_dir).select(
        "*",
        (F.col("doc_id") * 100 + F.col("para_idx")).alias("case_id"),
        types(0).alias("gold_rules"),
        types(1).alias("gold_full"),
    )


def _case_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finds of both modes; cases stand alone, so nothing is learned from them."""
    cases = _cases(spark, sf_dir).select("doc_id", "para_idx", "story", "text")
    annotated = entities.with_entity_spans(cases, forms_corpus.entities(spark, sf_dir))
    return evaluate.spans_by_mode(annotated).withColumn("case_id", F.col("doc_id") * 100 + F.col("para_idx"))


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score.as_percentages(score.scores(_cases(spark, sf_dir), _case_spans(spark, sf_dir)))


def per_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score.per_type(_cases(spark, sf_dir), _case_spans(spark, sf_dir))


def leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values that should be gone and controls that should stand, taken from the forms by what their lines say.

    Cards and mail addresses must be gone. Order numbers and a stretch that begins inside a word stand in the
    text all the same: they remain. Of what should stand, the numbers of night desks are missing.
    """
    # Read three times: the forms are built once.
    lines = Workspace(spark).stage(form_lines(spark, sf_dir), "lines")
    after = lambda head, value: F.regexp_extract("text", f"{head}{value}", 1)
    gone = lines.select(
        "doc_id",
        F.explode(F.array(after("paid with ", "([0-9 ]+)$"), after("leave word at ", "(.+)$"), after("Order ", "([0-9-]+) stands"), after("P", "(arcel [0-9]+ w)"))).alias("value"),
    )
    kept = lines.select("doc_id", F.explode(F.array(after("", "^(Parcel [0-9]+ waits)"), after("Desk ", "(.+) or"))).alias("value"))
    some = F.col("value") != ""
    return score.leaks(redact(lines).redacted, gone.filter(some), kept.filter(some))


def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forms, and the plain documents, most of which lack most types."""
    forms, plain = form_lines(spark, sf_dir), documents(spark, sf_dir)
    found = lambda rows: detectors.span_rows(resolved(rows), "spans")
    of_forms = score.coverage(found(forms), forms).withColumn("corpus", F.lit("forms"))
    return of_forms.unionByName(score.coverage(found(plain), plain).withColumn("corpus", F.lit("documents")))


def mode_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per line of the forms, each a case of its own: many have no find in either mode."""
    lines = _cases(spark, sf_dir).select(F.col("case_id").alias("doc_id"))
    return score.mode_delta(_case_spans(spark, sf_dir).select("mode", F.col("case_id").alias("doc_id")), lines)


def hybrid_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    annotated = forms_corpus.entities(spark, sf_dir)
    return _redacted_forms(spark, sf_dir, mode="hybrid", entities=annotated).redacted.drop("story")


def streamed_redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents, arriving as a stream of files."""
    schema = spark.read.parquet(f"{sf_dir}/documents.parquet").schema
    arriving = spark.readStream.schema(schema).parquet(f"{sf_dir}/documents*.parquet")
    folder = Workspace(spark).path
    incremental.start(arriving, f"{folder}/out", f"{folder}/state", once=True).awaitTermination()
    return spark.read.parquet(f"{folder}/out/redacted").select("doc_id", "para_idx", "redacted", "changed")


QUERIES: dict[str, Query] = {
    "paragraphs": paragraphs,
    "conversation_turns": conversation_turns,
    "story_order": story_order,
    "preview": preview,
    "text_helpers": text_helpers,
    "email_spans": spans_of("email", documents),
    "ip_spans": spans_of("ip", documents),
    "card_spans": spans_of("card", documents),
    "phone_spans": spans_of("phone_shape", documents),
    "email_spans_in_forms": spans_of("email", form_lines),
    "ip_spans_in_forms": spans_of("ip", form_lines),
    "card_spans_in_forms": spans_of("card", form_lines),
    "phone_spans_in_forms": spans_of("phone_shape", form_lines),
    "ssn_spans": spans_of("ssn", form_lines),
    "dob_spans": spans_of("birth_date", form_lines),
    "phone_label": spans_of("phone_label", form_lines),
    "label_names": spans_of("name_label", form_lines),
    "contact_list_names": spans_of("contact_list", form_lines),
    "titled_names": spans_of("titled_name", form_lines),
    "companies": spans_of("company", form_lines),
    "address_label": spans_of("address_label", form_lines),
    "address_line": spans_of("address_line", form_lines),
    "label_pairs": label_pairs,
    "dictionary": learned,
    "dictionary_hits": dictionary_hits,
    "dictionary_hits_joined": dictionary_hits_joined,
    "resolved_spans": resolved_spans,
    "resolved_document_spans": resolved_document_spans,
    "entity_spans": entity_spans,
    "ordinals": ordinals,
    "mapping": mapping,
    "redacted_text": redacted_text,
    "redacted_documents": redacted_documents,
    "redacted_turns": redacted_turns,
    "hybrid_text": hybrid_text,
    "run_pieces": run_pieces,
    "redaction_counts": redaction_counts,
    "doc_summary": doc_summary,
    "marker_audit": marker_audit,
    "scores": scores,
    "per_type": per_type,
    "leaks": leaks,
    "coverage": coverage,
    "mode_delta": mode_delta,
    "streamed_redaction": streamed_redaction,
}
