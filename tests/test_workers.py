"""Steps that run in Python workers, and the joins that feed them: the same results as by the general forms."""

import random
from collections import Counter

import pyarrow as pa
from pyspark.sql import functions as F

from maskwright.functions import plain
from maskwright.functions import text as X
from maskwright.operators import detectors, pseudonym, rewrite
from maskwright.plans.redact import redact
from tests import model

rows_of = lambda frame: Counter(tuple(map(str, r)) for r in frame.select(*sorted(frame.columns)).collect())
plan_of = lambda frame: frame._jdf.queryExecution().toString()

LINES = ["Mr. Jonas Ito met Red Maple Inc.", "Full Name:", "Ada Byron", "Jonas Ito saw Ada Byron; a@b.org, c@d.org left"], ["a@b.org", "", "A@b.org x@y.org"]


def test_finds_of_a_batch_equal_the_model_also_beyond_ascii():
    lines = [line for doc in model.sample(random.Random(8), 60, 20) for line in doc] + [None, "", "ÄDDRESS: 5 road", "\ue000 a@b.org"]
    known = [(d.name, d.pii_type, d.rank, d.least_digits) for d in detectors.DETECTORS]
    got = plain.finder(known)(pa.array(lines, pa.string())).to_pylist()
    for line, found in zip(lines, got):
        assert {(s["start"], s["end"], s["pii_type"], s["detector_rank"]) for s in found} == set(model.finds(line or "")), line
        assert all(s["value"] == line[s["start"] : s["end"]] for s in found)


def test_labels_teach_as_in_the_model_and_as_the_expression_says(spark):
    docs = model.sample(random.Random(9), 80, 20) + [["FULL   name --", "Ada Byron"], ["Name", " "], ["contact no. 1 2 3", "98765 43210"], ["Contact NO.", "9876543210"], ["ÑAME", "x y"], ["", ""]]
    pairs = [(a, b) for doc in docs for a, b in zip([None, *doc], [*doc, None])]
    for label, text in pairs:
        assert set(plain.taught_by_label(label, text)) == {(k, v) for k, v in model.learn([label or "", text or ""]) if plain.label_type(label or "") == k and v in (text or "")} - taught_by_finds(label, text), (label, text)
    rows = spark.createDataFrame([(a,) for a, _ in pairs], "t string")
    assert all(r.k == (plain.label_type(r.t) if r.t else None) for r in rows.select("t", X.label_type(F.col("t")).alias("k")).collect())


def taught_by_finds(label, text):
    """What the finds of a paragraph, or of its label, teach beside the label."""
    by_label = set(plain.taught_by_label(label, text))
    found = {(k, line[a:b].strip()) for line in (label or "", text or "") for a, b, k, _ in model.resolve(model.finds(line))}
    return {f for f in found if f[0] in ("name", "company")} - by_label


def test_pieces_are_walked_alike_whatever_the_order_of_places():
    draw = random.Random(3)
    for _ in range(2000):
        text = "".join(draw.choice("abcé😀") for _ in range(draw.randint(0, 20)))
        cuts = lambda: sorted(draw.sample(range(len(text) + 3), draw.randint(0, min(len(text) + 1, 7))))  # noqa: B023, E731
        at, to = cuts(), cuts()
        runs = [(a, b, draw.randint(0, 5), draw.choice(["s0", "s1", None])) for a, b in zip(at, at[1:]) if draw.random() < 0.8]
        spans = [(a, b, draw.choice([f"<{a}>", ""])) for a, b in zip(to, to[1:]) if draw.random() < 0.6]
        assert plain.pieces(text, spans, runs) == plain._by_events(text, spans, runs)
    assert plain.pieces("abc", [(1, 2, "X")], [(2, 3, 1, "b"), (0, 2, 0, "a")]) == [("a", "a"), ("X", "a"), ("c", "b")]
    assert plain.pieces(None, [(0, 1, "X")], [(None, 1, 0, "a")]) == [("X", "a")] and plain.pieces("abc", [], []) == []


def test_spans_meet_few_keys_as_a_map_and_many_one_by_one(spark, lines_of):
    lines = lines_of(*LINES)
    styled = lines.selectExpr("doc_id", "para_idx", "0 AS run_idx", "0 AS start", "5 AS end", "'b' AS style").unionByName(
        lines.selectExpr("doc_id", "para_idx", "1 AS run_idx", "5 AS start", "length(text) AS end", "'i' AS style")
    ).filter("NOT (doc_id = 0 AND para_idx = 2)")
    result = redact(lines, runs=styled)
    # Paragraphs meet runs once, before they are staged, and keys once: no find is shuffled by itself.
    joins = plan_of(result.pieces).split("== Physical Plan ==")[0].split("== Optimized Logical Plan ==")[1]
    assert joins.count("Join Inner") == 1 and "Generate" not in joins.split("Join Inner")[1] and "pieces" in joins
    found = result.workspace.spark.read.parquet(f"{result.workspace.path}/paragraphs")
    looked_up = spark.read.parquet(f"{result.workspace.path}/lookups")
    assert rewrite.set_apart(found, looked_up) is None
    whole = rewrite.replaced(found, looked_up, None)
    for few in (0, 2):
        apart = rewrite.set_apart(found, looked_up, few=few)
        assert apart.count() == (2 if few == 0 else 1)
        assert rows_of(rewrite.replaced(found, looked_up, apart)) == rows_of(whole)
    assert {r.redacted for r in result.redacted.filter("doc_id = 0 AND para_idx = 2").collect()} == {"Ada Byron"}
    repeated = found.unionByName(found.filter("doc_id = 1"))
    assert [tuple(r) for r in rewrite.set_apart(repeated, looked_up).collect()] == [(1, 0)]


def test_keys_of_small_documents_are_numbered_in_one_shuffle(spark):
    rows = [(d, k, f"v{v}", 0, (v << 32) + v, 1) for d in (1, 2) for k in ("name", "email") for v in range(9 * d)]
    rows += [(None, "name", "x", 0, 5, 1), (3, "name", None, 0, 5, 1), (3, "name", "y", None, None, 1)]
    occurring = spark.createDataFrame(rows, "doc_id bigint, pii_type string, norm_value string, chunk bigint, first bigint, n bigint")
    whole = pseudonym.lookups(occurring)
    assert plan_of(whole).split("== Physical Plan ==")[1].count("Exchange") == 1
    everything = pseudonym.with_fakes(pseudonym.ordinals(occurring, 1)).withColumnRenamed("first", "_first")
    by_chunks = occurring.select("doc_id", "pii_type", "norm_value", "chunk", "first").join(everything, ["doc_id", "pii_type", "norm_value"])
    by_chunks = by_chunks.selectExpr("doc_id", "pii_type", "norm_value", "chunk", "ordinal", "fake", "first = _first AS is_first")
    assert rows_of(whole) == rows_of(by_chunks)
    several = occurring.unionByName(occurring.selectExpr("doc_id", "pii_type", "norm_value", "chunk + 3", "first + (1 << 50)", "n").filter("doc_id = 2").toDF(*occurring.columns))
    assert rows_of(pseudonym.lookups(several).filter("doc_id = 2 AND chunk < 3")) == rows_of(whole.filter("doc_id = 2"))
    assert pseudonym.lookups(several).filter("doc_id = 2 AND NOT is_first").count() == whole.filter("doc_id = 2").count()
    assert whole.filter("doc_id IS NULL OR doc_id = 3").count() == 0
    assert [r.ordinal for r in pseudonym.mapping(whole).filter("doc_id = 1 AND pii_type = 'email'").orderBy("ordinal").collect()] == list(range(1, 10))
