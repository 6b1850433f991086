import json
import os

import pytest
from pyspark.sql import functions as F

from maskwright import fixed_values as fixed
from maskwright.functions import text as X
from maskwright.functions.fakes import card
from maskwright.operators import pseudonym, report, score
from maskwright.operators.numbering import chunk_of, number_rows
from maskwright.plans.redact import redact
from maskwright.sources import paragraphs as P
from maskwright.sources.sinks import write_mapping, write_redacted, write_summary
from maskwright.streaming import incremental
from tests import model


def values(spark, column, inputs):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], "i int, v string")
    return [r[0] for r in rows.orderBy("i").select(column(F.col("v"))).collect()]


def test_casefold(spark):
    words = ["Straße", "ΟΔΟΣ", "ﬃ", "İx", "µm", "Ꭰꭰ", "plain ASCII", "ŉ", ""]
    assert values(spark, X.casefold, words) == [w.casefold() for w in words]


def test_normalise_and_hash(spark):
    words = ["  Ann  LEE\x1c", "x\t\ny", "ẞ"]
    assert values(spark, X.normalise, words) == [model.key(w) for w in words]
    assert values(spark, X.hash_bucket, ["ann lee"]) == [int(__import__("hashlib").sha256(b"ann lee").hexdigest()[:8], 16)]


def test_luhn(spark):
    numbers = ["4111 1111 1111 1111", "4111111111111112", "٤١١١١١١١١١١١١١١١", "123", "6011000990139424", "0" * 20]
    assert values(spark, X.luhn, numbers) == [model.passes_luhn(n) for n in numbers]


def test_labels(spark):
    labels = ["Full  Name:", "DOB", "Contact no.", "the name", "", "COMPANY (*)", "-" * 60 + "tel", "Reſidence", "full name of the applicant"]
    assert values(spark, X.label_type, labels) == ["name", "dob", "phone", None, None, "company", "phone", "address", None]


def test_label_values(lines_of):
    from maskwright.operators.dictionary import label_pairs

    lines = [
        "Full Name", "", "Ann Lee", "Company", "X" * 90 + " " + "y" * 89, "Company", "X" * 90 + " " + "y" * 90,
        "Birth Date", "7 Jan 1992 and 8/9/1990", "Tel", "12345", "Address", "nowhere", "Employer", "One",
    ]
    got = {(r["pii_type"], r["value"]) for r in label_pairs(lines_of(lines)).collect()}
    assert got == {("company", lines[4]), ("dob", "7 Jan 1992"), ("dob", "8/9/1990")} == model.learn(lines) - {
        p for t in lines for a, b, k, _ in model.resolve(model.finds(t)) for p in [(k, t[a:b].strip())]
    }


@pytest.mark.parametrize("size", [1, 3, 1000])
def test_numbering_equals_a_plain_window(spark, size):
    rows = spark.range(200).select(
        F.when(F.col("id") % 3 == 0, F.col("id") % 7).otherwise(F.lit(99)).alias("g"),
        ((F.col("id") * 37) % 211).alias("at"),
    )
    numbered = number_rows(rows, ["g"], {"_c": chunk_of(F.col("at"), size)}, [F.col("at")], "n").collect()
    groups = {}
    for r in numbered:
        groups.setdefault(r["g"], []).append((r["at"], r["n"]))
    for pairs in groups.values():
        assert [n for _, n in sorted(pairs)] == list(range(1, len(pairs) + 1))


def test_no_window_over_a_whole_document(spark, lines_of):
    """Rows are numbered inside chunks; only chunk sizes are summed over a document."""
    spans = spark.createDataFrame(
        [(0, i, 0, 1, "email", f"v{i % 40}", 3) for i in range(200)],
        "doc_id bigint, para_idx int, start int, end int, pii_type string, value string, detector_rank int",
    )
    occurring = pseudonym.occurrences(spans, size=16)
    got = {r["norm_value"]: r["ordinal"] for r in pseudonym.ordinals(occurring, size=16).collect()}
    assert got == {f"v{i}": i + 1 for i in range(40)}
    plan = pseudonym.ordinals(occurring, size=16)._jdf.queryExecution().optimizedPlan().toString()
    ranks = [line for line in plan.splitlines() if "row_number" in line]
    assert ranks and all("_chunk" in line for line in ranks)


def test_fakes(spark):
    rows = spark.range(1, 12031, 401).select("id", card(F.lit(0), F.col("id")).alias("fake")).collect()
    for r in rows:
        assert model.passes_luhn(r["fake"]) and r["fake"] == model.fake("card", "", r["id"])
    with pytest.raises(Exception, match="unknown type"):
        keys = spark.createDataFrame([(0, "iban", "x", 1)], "doc_id bigint, pii_type string, norm_value string, ordinal int")
        pseudonym.with_fakes(keys).collect()


def test_same_value_same_fake(lines_of):
    result = redact(lines_of(["a@b.io", "A@B.IO and c@d.io"], ["c@d.io"]))
    texts = {(r["doc_id"], r["para_idx"]): r["redacted"] for r in result.redacted.collect()}
    assert texts[0, 0] == "contact001@example.com"
    assert texts[0, 1] == "contact001@example.com and contact002@example.com"
    assert texts[1, 0] == "contact001@example.com"


@pytest.mark.parametrize("ranges", [1, 3, 256])
def test_turns_and_previous(spark, ranges):
    """Positions are timestamps, in bursts and with equal ones; one conversation holds most rows."""
    draw = __import__("random").Random(2)
    rows = [(c, 1_700_000_000_000 + draw.choice((0, 10**9)) + draw.randrange(700), f"t{i}") for i in range(600) for c in [5 if i % 3 else i % 11]]
    rows += [(77, None, "unplaced"), (77, 3, "x"), (77, 3, "a"), (77, -4, "first")]
    table = spark.createDataFrame(rows, "conv bigint, turn bigint, words string").repartition(5)
    got = P.with_previous(P.from_rows(table, "conv", "turn", "words", ranges)).collect()
    expected = []
    for conv in {r[0] for r in rows}:
        own = [r[2] for r in sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))]
        expected += [(conv, i, t, own[i - 1] if i else None) for i, t in enumerate(own)]
    assert sorted((r["doc_id"], r["para_idx"], r["text"], r["prev_text"]) for r in got) == sorted(expected, key=lambda r: r[:2])


def test_merged_cells_and_nested_tables(spark):
    rows = [
        (1, "a", [0, 0, 0, 0, 0], "one"), (1, "b", [0, 0, 1, 0, 0], "merged"), (1, "b", [0, 0, 2, 0, 0], "merged"),
        (1, "n", [0, 0, 1, 1, 0, 0, 0, 0, 0], "nested"), (1, "c", [0, 1, 0, 0, 0], ""), (1, "d", [1, 0, 0, 0, 0], "next table"),
    ]
    blocks = spark.createDataFrame(
        [(d, e, "body", 0, True, p, t) for d, e, p, t in rows],
        "doc_id bigint, element_id string, story string, section int, in_table boolean, path array<int>, text string",
    )
    got = P.from_blocks(blocks, size=1).orderBy("para_idx").collect()
    assert [r["text"] for r in got] == ["one", "merged", "nested", "", "next table"]
    assert [r["para_idx"] for r in got] == list(range(5))


def test_preview(lines_of):
    got = P.preview(lines_of(["a", "", " b ", "c"], ["x"], ["", " "]), 2).orderBy("doc_id", "line_no").collect()
    assert [tuple(r) for r in got] == [(0, 1, "a", 3, True), (0, 2, "b", 3, True), (1, 1, "x", 1, False), (2, None, None, 0, False)]


def test_audits_list_documents_without_finds(spark, lines_of):
    docs = spark.createDataFrame([(0,), (1,)], "doc_id bigint")
    spans = spark.createDataFrame([("rules", 0, "email"), ("hybrid", 0, "email"), ("hybrid", 0, "name")], "mode string, doc_id bigint, pii_type string")
    lacking = {r["doc_id"]: (r["lacking"], r["complete"]) for r in score.coverage(spans, docs, ("name", "email")).collect()}
    assert lacking == {0: ("", True), 1: ("email,name", False)}
    assert sorted(tuple(r) for r in score.mode_delta(spans, docs).collect()) == [(0, 1, 2, 1), (1, 0, 0, 0)]


def test_marker_audit(spark):
    texts = [
        "contact001@example.com, x@example.com", "Example Entity 001 Limited", "101 Example Avenue, Sample City - 400001",
        "+91 70000 10000", "900-01-1001 900-02-1002", "4111 1111 1111 1111", "203.0.113.7", " ",
    ]
    row = report.marker_audit(spark.createDataFrame([(t,) for t in texts], "redacted string")).first().asDict()
    assert row.pop("non_blank_paragraphs") == 7
    assert row == {**dict.fromkeys(fixed.MARKERS, 1), "example_com_emails": 2}


def test_scores(spark):
    cases = spark.createDataFrame(
        [(1, "", ["name"], ["name"]), (2, "", [], ["company"]), (3, "", [], []), (4, "", [], [])],
        "case_id int, text string, gold_rules array<string>, gold_full array<string>",
    )
    found = spark.createDataFrame(
        [("rules", 1, "name"), ("hybrid", 1, "name"), ("hybrid", 2, "company"), ("hybrid", 3, "company")],
        "mode string, case_id int, pii_type string",
    )
    rows = {r["view"]: r for r in score.as_percentages(score.scores(cases, found)).collect()}
    pick = lambda v: tuple(rows[v][c] for c in ("tp", "fp", "fn", "tn", "accuracy", "precision", "recall"))
    assert pick("rules") == (1, 0, 0, 3, 100.0, 100.0, 100.0)
    assert pick("rules_against_full_gold") == (1, 0, 1, 2, 75.0, 100.0, 50.0)
    assert pick("hybrid") == (2, 1, 0, 1, 75.0, 66.7, 100.0)
    kinds = {(r["view"], r["pii_type"]): (r["tp"], r["fp"], r["fn"]) for r in score.per_type(cases, found).collect()}
    assert kinds["hybrid", "company"] == (1, 1, 0) and ("rules", "company") not in kinds
    empty = score.scores(cases.limit(0), found)
    assert empty.count() == 0


def test_sinks(lines_of, tmp_path):
    result = redact(lines_of(["Mail a@b.io"], ["nothing"]))
    write_redacted(result.redacted, f"{tmp_path}/out", "story")
    write_mapping(result.mapping, f"{tmp_path}/map")
    write_summary(result.summary, f"{tmp_path}/summary", "in", "out")
    read = lambda d: [
        json.loads(line) for f in sorted(os.listdir(f"{tmp_path}/{d}")) if f.startswith("part") for line in open(f"{tmp_path}/{d}/{f}")
    ]
    assert read("map") == [{"doc_id": 0, "key": "email:a@b.io", "fake": "contact001@example.com"}]
    assert sorted((r["doc_id"], r["source"], r["changed_paragraphs"], r["redactions"]) for r in read("summary")) == [
        (0, "in", 1, {"email": 1}), (1, "in", 0, {}),
    ]
    assert os.listdir(f"{tmp_path}/out/story=body")
    result.workspace.release()
    assert not os.path.exists(result.workspace.path)


def test_stream_equals_batch_and_survives_restart(spark, tmp_path):
    schema = "doc_id bigint, text string"
    write = lambda rows, name: spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{name}")
    run = lambda: incremental.start(
        spark.readStream.schema(schema).parquet(f"{tmp_path}/in/*"), f"{tmp_path}/out", f"{tmp_path}/state", once=True
    ).awaitTermination()
    write([(1, "Mail a@b.io\nDOB: 1/2/1990"), (2, "x")], "first")
    run()
    write([(3, "Dr. Ann Lee\nsaw Dr. Ann Lee, b@c.io")], "second")
    run()
    run()
    got = spark.read.parquet(f"{tmp_path}/out/redacted").select("doc_id", "para_idx", "redacted").collect()
    docs = spark.read.schema(schema).parquet(f"{tmp_path}/in/*")
    batch = redact(P.from_documents(docs)).redacted.select("doc_id", "para_idx", "redacted").collect()
    assert sorted(got) == sorted(batch) and len(got) == 5
    # A batch delivered twice replaces its own output.
    incremental.batch_writer(f"{tmp_path}/out")(docs.filter("doc_id < 3"), 0)
    again = spark.read.parquet(f"{tmp_path}/out/redacted").select("doc_id", "para_idx", "redacted").collect()
    assert sorted(again) == sorted(got)


def test_scan_reads_two_columns(spark, tmp_path):
    spark.createDataFrame([(1, "a", "en")], "doc_id bigint, text string, lang string").write.parquet(f"{tmp_path}/docs")
    rows = P.from_documents(spark.read.parquet(f"{tmp_path}/docs"))
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in rows._jdf.queryExecution().executedPlan().toString()
