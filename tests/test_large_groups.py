"""Documents with very many values, paragraphs with very many runs, sources with most of the rows."""

import glob
import os
import random
import time

import pytest
from pyspark.sql import functions as F

from maskwright.functions import text as X
from maskwright.operators import dictionary, rewrite, score
from maskwright.plans.redact import redact
from maskwright.schema import SPANS
from maskwright.sources.paragraphs import from_documents
from maskwright.sources.sinks import write_mapping_batch, write_redacted
from maskwright.streaming import incremental
from tests import model

PARAGRAPHS = "doc_id bigint, para_idx int, story string, text string"


def test_one_document_with_very_many_values(spark):
    n = 100_000
    lines = spark.range(n).select(
        F.lit(1).cast("bigint").alias("doc_id"), F.col("id").cast("int").alias("para_idx"), F.lit("body").alias("story"),
        F.concat(F.lit("met Harbour Goods "), "id", F.lit(" and Harbour Goods "), F.col("id") + 1, F.lit("x")).alias("text"),
    )
    known = spark.range(n).select(F.lit(1).cast("bigint").alias("doc_id"), F.lit("company").alias("pii_type"), F.concat(F.lit("Harbour Goods "), "id").alias("value"))
    start = time.perf_counter()
    hits = dictionary.dictionary_hits(lines, known, "merge")
    row = hits.agg(F.count("*"), F.min("start"), F.max("start"), F.count_distinct("para_idx")).first()
    assert tuple(row) == (n, 4, 4, n) and time.perf_counter() - start < 90


def test_values_with_marks_and_signs(spark):
    lines = ["a b c", "a �b c", "(- -) x", "x- -", "--  -- -", "ab", "tail a b"]
    known = [("company", "a b"), ("company", "- -"), ("company", "-- --"), ("company", "--  --"), ("name", "ab")]
    paragraphs = spark.createDataFrame([(0, i, "body", t) for i, t in enumerate(lines)], PARAGRAPHS)
    words = spark.createDataFrame([(0, *k) for k in known], "doc_id bigint, pii_type string, value string")
    got = {(r["para_idx"], r["start"], r["end"], r["pii_type"], r["detector_rank"], r["value"]) for r in dictionary.dictionary_hits(paragraphs, words).collect()}
    assert got == {(i, a, b, k, r, t[a:b]) for i, t in enumerate(lines) for a, b, k, r in model.known(t, known)}
    assert not any(r[0] == 1 for r in got)


def test_leaks_equal_brute_force(spark):
    draw = random.Random(9)
    text = lambda n: "".join(draw.choice("ab \n-é😀") for _ in range(n))
    docs = [[text(draw.randint(0, 40)) for _ in range(4)] for _ in range(40)]
    values = [(d, text(draw.randint(0, 6))) for d in range(41) for _ in range(12)]
    redacted = spark.createDataFrame([(d, i, t) for d, lines in enumerate(docs) for i, t in enumerate(lines)], "doc_id bigint, para_idx int, redacted string")
    expected = spark.createDataFrame(values, "doc_id bigint, value string")
    got = {tuple(r) for r in score.leaks(redacted, expected, expected).collect()}
    there = {(d, v) for d, v in values if d < 40 and any(v in t for t in docs[d])}
    assert got == {(d, v, "remains") for d, v in there} | {(d, v, "missing") for d, v in set(values) - there}


def test_text_blocks(spark):
    text = "ab😀é" * 4000
    places = [(0, 0), (0, 5), (4090, 4100), (4096, 8192), (5, 5), (15990, 16000), (15000, 16010), (0, 16000)]
    rows = spark.createDataFrame([(text, a, b) for a, b in places], "t string, a int, b int")
    got = rows.select("a", "b", X.cut(X.in_blocks(F.col("t")), F.col("a"), F.col("b")).alias("s")).collect()
    assert all(r["s"] == text[r["a"]:r["b"]] for r in got)


def pieces_by_hand(text, spans, runs):
    out, done = [], 0
    for a, b, fake in [*spans, (len(text), len(text), None)]:
        out += [(text[max(done, x):min(a, y)], s) for x, y, _, s in runs if max(done, x) < min(a, y)]
        if fake:
            under = [s for x, y, _, s in runs if x <= a < y]
            out.append((fake, under[0] if under else min(runs, key=lambda r: r[2])[3]))
        done = b
    return [p for p in out if p[0]]


def styled(spark, cases):
    rows = spark.createDataFrame(
        [(i, t, s, r) for i, (t, s, r) in enumerate(cases)],
        "i int, text string, spans array<struct<start: int, end: int, fake: string>>, runs array<struct<start: int, end: int, run_idx: int, style: string>>",
    )
    got = rows.select("i", rewrite._styled(F.col("text"), F.col("spans"), F.col("runs")).alias("p")).collect()
    return {r["i"]: [(p["text"], p["style"]) for p in r["p"]] for r in got}


def test_pieces_equal_brute_force(spark):
    draw, cases = random.Random(4), []
    for _ in range(200):
        text = "".join(draw.choice("abcdé😀") for _ in range(draw.randint(1, 30)))
        cuts = lambda k: sorted(draw.sample(range(len(text) + 1), min(len(text) + 1, k)))  # noqa: B023, E731
        at = cuts(draw.randint(2, 8))
        runs = [(a, b, i, f"s{i % 3}") for i, (a, b) in enumerate(zip(at, at[1:])) if draw.random() < 0.85] or [(0, len(text), 0, "s0")]
        at = cuts(draw.randint(2, 8))
        spans = [(a, b, f"<{a}>") for a, b in zip(at, at[1:]) if draw.random() < 0.6] or [(0, 1, "<0>")]
        cases.append((text, spans, runs))
    for i, got in styled(spark, cases).items():
        assert got == pieces_by_hand(*cases[i]), cases[i]


def test_very_many_runs_in_one_paragraph(spark):
    n = 50_000
    text = "abcdefgh" * n
    runs = [(8 * i, 8 * i + 8, i, "b" if i % 2 else "p") for i in range(n)]
    spans = [(16 * i + 3, 16 * i + 6, "*") for i in range(n // 2)]
    start = time.perf_counter()
    got = styled(spark, [(text, spans, runs)])[0]
    assert got == pieces_in_order(n) and time.perf_counter() - start < 60


def pieces_in_order(n):
    return [p for _ in range(n // 2) for p in (("abc", "p"), ("*", "p"), ("gh", "p"), ("abcdefgh", "b"))]


def test_one_source_with_most_rows_spreads_over_files(spark, tmp_path):
    docs = spark.range(0, 20_000, 1, 16).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") % 10 > 0, "big").otherwise(F.concat(F.lit("s"), F.col("id") % 50)).alias("source"),
        F.concat(F.lit("mail u"), "id", F.lit("@ex.org about "), F.sha2(F.col("id").cast("string"), 512)).alias("text"),
    )
    few = redact(from_documents(docs.limit(5), "source")).redacted
    assert {r["source"] for r in few.collect()} <= {"big", "s0"} and "@example.com" in few.first()["redacted"]
    rows = docs.withColumnRenamed("text", "redacted")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "200k")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.minPartitionSize", "50k")
    try:
        write_redacted(rows, f"{tmp_path}/out", "source")
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.minPartitionSize")
    files = {d: glob.glob(f"{tmp_path}/out/{d}/*.parquet") for d in os.listdir(f"{tmp_path}/out") if d.startswith("source=")}
    assert len(files["source=big"]) >= 4
    sizes = [os.path.getsize(f) for f in files["source=big"]]
    assert max(sizes) < 0.5 * sum(sizes)
    assert all(len(f) <= 2 for d, f in files.items() if d != "source=big")
    assert spark.read.parquet(f"{tmp_path}/out").count() == 20_000


def test_a_repeated_batch_leaves_one_copy_of_the_map(spark, tmp_path):
    keys = "doc_id bigint, pii_type string, norm_value string, ordinal int, fake string"
    write = lambda fakes, batch: write_mapping_batch(spark.createDataFrame([(1, "email", f, 1, f) for f in fakes], keys), f"{tmp_path}/map", batch)
    write(["a", "b"], 0)
    write(["c"], 1)
    write(["a", "b"], 0)
    rows = spark.read.parquet(f"{tmp_path}/map").collect()
    assert sorted((r["batch_id"], r["key"]) for r in rows) == [(0, "email:a"), (0, "email:b"), (1, "email:c")]


def test_hybrid_stream_equals_batch(spark, tmp_path):
    """Annotations arrive apart, some before and some after their document; a restart lies between."""
    docs_type, said_type = "doc_id bigint, text string, arrived timestamp", f"doc_id bigint, annotations {incremental.ANNOTATIONS}, arrived timestamp"

    def put(kind, schema, rows, name):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{kind}/{name}")

    def at(minute):
        import datetime

        return datetime.datetime(2026, 1, 1, 10 + minute // 60, minute % 60)

    def run():
        docs = spark.readStream.schema(docs_type).parquet(f"{tmp_path}/docs/*")
        said = spark.readStream.schema(said_type).parquet(f"{tmp_path}/said/*")
        query = incremental.start(
            incremental.with_annotations(docs, said), f"{tmp_path}/out", f"{tmp_path}/state", once=True, mode="hybrid",
            mapping=f"{tmp_path}/map", ner_model="a model",
        )
        query.awaitTermination()
        return incremental.late_rows(query)

    mark = lambda text, words, label: [(0, text.index(words), text.index(words) + len(words), label, words)]
    one, two, three = "Bram Hoekstra called a@b.io", "no word of Kestrel Lines", "Lotte Veen and Mr. Ole Berg"
    put("docs", docs_type, [(1, one, at(0)), (2, two, at(1))], "a")
    put("said", said_type, [(1, mark(one, "Bram Hoekstra", "PERSON"), at(2))], "a")
    late = run()
    put("docs", docs_type, [(3, three, at(4))], "b")
    put("said", said_type, [(2, mark(two, "Kestrel Lines", "ORG"), at(5)), (3, mark(three, "Lotte Veen", "PERSON"), at(5))], "b")
    late += run()
    put("docs", docs_type, [(4, "Ms. Ann Lee, alone", at(6)), (9, "x", at(300))], "c")
    put("said", said_type, [(9, [], at(300))], "c")
    late += run()
    assert late == 0
    put("said", said_type, [(4, mark("Ms. Ann Lee, alone", "Ms. Ann Lee", "ORG"), at(7))], "d")
    late += run()
    assert late == 1
    got = {(r["doc_id"], r["redacted"]) for r in spark.read.parquet(f"{tmp_path}/out/redacted").collect()}
    rows = [(1, one), (2, two), (3, three), (4, "Ms. Ann Lee, alone"), (9, "x")]
    entities = spark.createDataFrame(
        [(1, *mark(one, "Bram Hoekstra", "PERSON")[0]), (2, *mark(two, "Kestrel Lines", "ORG")[0]), (3, *mark(three, "Lotte Veen", "PERSON")[0])],
        "doc_id bigint, para_idx int, start int, end int, label string, text string",
    )
    batch = redact(from_documents(spark.createDataFrame(rows, "doc_id bigint, text string")), "hybrid", entities, ner_model="a model")
    assert got == {(r["doc_id"], r["redacted"]) for r in batch.redacted.collect()} and len(got) == 5
    assert {r["key"] for r in spark.read.parquet(f"{tmp_path}/map").collect()} >= {"name:bram hoekstra", "email:a@b.io", "company:kestrel lines"}
    assert {r["ner_model"] for r in batch.summary.collect()} == {"a model"}


@pytest.mark.parametrize("bad", [None])
def test_workspace_goes_when_a_batch_fails(spark, tmp_path, bad, monkeypatch):
    kept = []
    plain = incremental.Workspace

    def noted(session):
        kept.append(plain(session))
        return kept[-1]

    monkeypatch.setattr(incremental, "Workspace", noted)
    docs = spark.createDataFrame([(1, "a@b.io")], "doc_id bigint, text string")
    (tmp_path / "out").write_text("a file where a folder must be")
    with pytest.raises(Exception):
        incremental.batch_writer(f"{tmp_path}/out")(docs, 0)
    assert kept and not os.path.exists(kept[0].path)


def test_span_type_is_complete(spark):
    assert spark.createDataFrame([], f"s {SPANS}").schema["s"].dataType.elementType.names == ["start", "end", "pii_type", "value", "detector_rank"]
