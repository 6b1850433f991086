"""Steps that must not shuffle or compute more than the input asks for, and their forms for large groups."""

from collections import Counter

from pyspark.sql import functions as F

from maskwright import fixed_values as fixed
from maskwright.functions import spans as S
from maskwright.functions.dialect import java
from maskwright.operators import dictionary, entities, inverted, report, rewrite, score
from maskwright.operators.detectors import candidates, span_rows
from maskwright.plans import evaluate, staging
from maskwright.plans import redact as redaction
from maskwright.plans.redact import resolved
from maskwright.sources import paragraphs as P

rows_of = lambda frame: Counter(tuple(map(str, r)) for r in frame.select(*sorted(frame.columns)).collect())
plan_of = lambda frame: frame._jdf.queryExecution().toString()


def _values(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, pii_type string, value string")


def test_few_values_need_no_index_and_many_are_found_by_it(spark, lines_of, monkeypatch):
    lines = lines_of(["Ada Byron met Ada Byron.", "", "XAda Byron", "Red Maple Mills, Red"], ["Ada Byron", "--- ???"])
    known = _values(spark, [(0, "name", "Ada Byron"), (0, "name", "Ada Byron"), (0, "company", "Red Maple Mills"), (0, "company", "Red"),
                            (1, "name", "??"), (1, "name", "???"), (None, "name", "Ada"), (1, "name", None), (1, "name", "")])
    listed = dictionary.dictionary_hits(lines.drop("prev_text"), known)
    assert "xxhash64" not in plan_of(listed)
    assert {(r.doc_id, r.para_idx, r.start, r.value) for r in listed.collect()} == {
        (0, 0, 0, "Ada Byron"), (0, 0, 14, "Ada Byron"), (0, 3, 0, "Red Maple Mills"), (0, 3, 0, "Red"), (0, 3, 17, "Red"), (1, 1, 4, "???"),
    }
    monkeypatch.setattr(inverted.with_values, "__defaults__", (None, 2))
    mixed = dictionary.dictionary_hits(lines.drop("prev_text"), known)
    assert "xxhash64" in plan_of(mixed)
    assert rows_of(mixed) == rows_of(listed)


def test_leaks_are_searched_once_without_an_index(spark, monkeypatch):
    redacted = spark.createDataFrame([(0, 0, "abc 12"), (0, 1, "xyz"), (1, 0, None), (None, 0, "abc")], "doc_id bigint, para_idx int, redacted string")
    pairs = lambda rows: spark.createDataFrame(rows, "doc_id bigint, value string")
    gone = pairs([(0, "bc 1"), (0, "bc 1"), (0, "gone"), (0, ""), (1, "x"), (2, ""), (None, "abc"), (0, None)])
    kept = pairs([(0, "yz"), (0, "bc 1"), (0, "lost"), (1, "y"), (None, "abc")])
    want = Counter([("0", "remains", "bc 1"), ("0", "remains", ""), ("0", "missing", "lost"), ("1", "missing", "y"), ("None", "missing", "abc")])
    listed = score.leaks(redacted, gone, kept)
    assert "xxhash64" not in plan_of(listed)
    assert rows_of(listed) == rows_of(listed.select(F.col("doc_id"), "problem", "value"))
    assert Counter(tuple(map(str, r)) for r in listed.select("doc_id", "problem", "value").collect()) == want
    monkeypatch.setattr(inverted.with_values, "__defaults__", (None, 1))
    indexed = score.leaks(redacted, gone, kept)
    assert Counter(tuple(map(str, r)) for r in indexed.select("doc_id", "problem", "value").collect()) == want


def test_both_modes_come_from_one_run_of_the_patterns(spark, lines_of):
    lines = lines_of(["Mr. Jonas Ito met Red Maple Inc.", "Mobile: 9000000001", "Ada Byron", ""]).drop("prev_text")
    notes = spark.createDataFrame([(0, 2, 0, 9, "PERSON", "Ada Byron"), (0, 0, 4, 13, "PERSON", "Jonas Ito")], "doc_id bigint, para_idx int, start int, end int, label string, text string")
    annotated = entities.with_entity_spans(lines, notes)
    found = evaluate.spans_by_mode(annotated)
    assert "Union" not in plan_of(found)
    apart = lambda rows, mode: span_rows(resolved(rows), "spans").withColumn("mode", F.lit(mode))
    assert rows_of(found) == rows_of(apart(lines, "rules").unionByName(apart(annotated, "hybrid")))


def test_annotations_meet_large_input_in_more_tasks(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "docs")
    spark.createDataFrame([(i, f"line {i}\nmore") for i in range(400)], "doc_id bigint, text string").write.parquet(path)
    lines = P.from_documents(spark.read.parquet(path)).drop("prev_text")
    notes = spark.createDataFrame([(7, 0, 0, 4, "ORG", "line")], "doc_id bigint, para_idx int, start int, end int, label string, text string")
    plain = entities.with_entity_spans(lines, notes)
    monkeypatch.setattr(staging, "TASK_BYTES", 64)
    finer = entities.with_entity_spans(lines, notes)
    assert "RepartitionByExpression" in plan_of(finer) and rows_of(plain) == rows_of(finer)


def test_blocks_of_small_documents_are_shuffled_once(spark):
    rows = [(d, f"e{i % 7}", "body", 0, i % 2 == 1, [i, 1, 0, 0, i] if i % 2 else [i], f"t{i}") for d in (1, 2) for i in range(9 * d)]
    rows.append((None, "e", "body", 0, False, [0], "x"))
    blocks = spark.createDataFrame(rows, "doc_id bigint, element_id string, story string, section int, in_table boolean, path array<int>, text string")
    whole = P.from_blocks(blocks)
    assert plan_of(whole).split("== Physical Plan ==")[1].count("Exchange") == 1
    assert rows_of(whole) == rows_of(P.from_blocks(blocks, 4)) == rows_of(P.from_blocks(blocks, 10))


def test_settling_few_candidates_and_one_match(spark):
    span = lambda a, b, kind, rank: (a, b, kind, "v", rank)
    cases = [[], [span(0, 3, "name", 1)], [span(4, 6, "name", 1), span(0, 3, "ip", 2)], [span(0, 3, "name", 1), span(2, 5, "ip", 2)],
             [span(0, 3, "name", 1), span(2, 5, "ip", 2), span(5, 6, "dob", 3), span(4, 9, "address", 4)]]
    frame = spark.createDataFrame(list(enumerate(cases)), f"i int, c {S.SPANS}")
    got = {r.i: r for r in frame.select("i", S.resolve(F.col("c")).alias("quick"), S.resolve(F.col("c"), 0).alias("sweep")).collect()}
    assert all(r.quick == r.sweep for r in got.values())
    assert [s.start for s in got[2].quick] == [0, 4] and [s.start for s in got[3].quick] == [2] and [s.start for s in got[4].quick] == [0, 4]
    text = spark.createDataFrame([("a@b.org",), ("é a@b.org, c@d.org",), ("none",)], "text string").selectExpr("1 AS doc_id", "0 AS para_idx", "text")
    found = {r.text: [(s.start, s.end) for s in r.candidates] for r in candidates(text).collect()}
    assert found == {"a@b.org": [(0, 7)], "é a@b.org, c@d.org": [(2, 9), (11, 18)], "none": []}


def test_a_redaction_runs_the_patterns_once(spark, lines_of, monkeypatch):
    lines = lines_of(["Mr. Jonas Ito met Red Maple Inc.", "Full Name:", "Ada Byron", "Jonas Ito saw Ada Byron; Ada Byron left"], ["a@b.org", ""])
    runs = []
    for module, name in ((redaction, "candidates"), (dictionary, "candidates"), (dictionary, "seed_candidates")):
        monkeypatch.setattr(module, name, lambda *a, f=getattr(module, name), **b: runs.append(1) or f(*a, **b), raising=False)
    result = redaction.redact(lines)
    assert len(runs) == 1
    twice = resolved(lines, dictionary.learn(lines))
    assert rows_of(result.spans) == rows_of(span_rows(twice, "spans"))
    assert {(r.doc_id, r.start, r.value) for r in result.spans.collect() if r.para_idx == 3} == {(0, 14, "Ada Byron"), (0, 25, "Ada Byron")}


def test_a_value_that_stands_once_is_placed_as_by_its_pattern(spark):
    texts = ["", "Ada", "Ada Ada", "xAda", "Ada_", "Ada Adam", "é Ada.", "\U0001d49cAda", "Ada\U0001d49c", "\U0001f600Ada\U0001f600", "AdaAda Ada", "aAaAa", r"\E.\Q Ada", None]
    values = ["Ada", "a", "AaA", "da", r"\E.\Q", "😀", " ", "Ada Ada", ""]
    pairs = spark.createDataFrame([(t, v) for t in texts for v in values], "t string, v string")
    rest = F.col("v"), F.lit("name"), F.lit(14)
    got = pairs.select("t", "v", S.find_literal(F.col("t"), *rest).alias("ours"), S._find_pattern(F.col("t"), *rest).alias("plain")).collect()
    assert [r for r in got if (r.ours or []) != (r.plain or [])] == []
    assert [[(s.start, s.end) for s in r.ours] for r in got if (r.t, r.v) == ("é Ada.", "Ada")] == [[(2, 5)]]


def test_hits_that_a_candidate_doubles_do_not_reach_the_overlaps(spark):
    c, other, entity = (0, 3, "name", "Ada", 12), (4, 7, "company", "Bob", 13), (8, 11, "name", "Eve", 19)
    hits = [(0, 3, "name", "Ada", 14), (4, 7, "name", "Bob", 14), (8, 11, "name", "Eve", 14)]
    rows = spark.createDataFrame([([c, other, entity], hits), ([], hits), ([c], [])], f"c {S.SPANS}, h {S.SPANS}")
    kept = rows.withColumn("k", S.without_doubles(F.col("h"), F.col("c")))
    kept = kept.select("k", S.resolve(F.concat("c", "k")).alias("few"), S.resolve(F.concat("c", "h")).alias("all")).collect()
    assert [[s.start for s in r.k] for r in kept] == [[4, 8], [0, 4, 8], []] and all(r.few == r.all for r in kept)


def test_shapes_are_counted_only_where_they_can_stand_and_texts_are_spliced_plainly(spark):
    texts = ["a@EXAMPLE.com b@example.com", "Example Entity 7 Limited, Example Avenue, Sample City", "+91 12345 12345 900-01-1234", "4111 1111 1111 1234 203.0.113.9", "ſ@example.com", " ", None, "x"]
    rows = spark.createDataFrame([(t,) for t in texts], "redacted string")
    plain = rows.agg(*[F.sum(F.regexp_count("redacted", F.lit(java(p)))).alias(n) for n, p in fixed.MARKERS.items()])
    audit = report.marker_audit(rows)
    assert audit.drop("non_blank_paragraphs").first().asDict() == plain.first().asDict()
    assert "Contains" in audit._jdf.queryExecution().optimizedPlan().toString()
    replaced = spark.createDataFrame([("é Ada, Bob", [(2, 5, "X"), (7, 10, "Y")]), ("Ada", [(0, 3, "Z")])], "t string, r array<struct<start: int, end: int, fake: string>>")
    assert [r[0] for r in replaced.select(rewrite.spliced(F.col("t"), F.col("r"))).collect()] == ["é X, Y", "Z"]
