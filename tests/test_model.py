"""The library against the plain model, on lines that mix everything."""

import random

import pytest
from pyspark.sql import functions as F

from maskwright.operators import detectors, dictionary
from maskwright.plans.redact import redact, resolved
from maskwright.plans.staging import Workspace
from tests import model


@pytest.fixture(scope="module")
def docs():
    return model.sample(random.Random(1), 60, 25)


@pytest.fixture(scope="module")
def paragraphs(spark, docs):
    rows = [(d, i, "body", t) for d, lines in enumerate(docs) for i, t in enumerate(lines)]
    return spark.createDataFrame(rows, "doc_id bigint, para_idx int, story string, text string").cache()


def as_sets(rows):
    out = {}
    for r in rows:
        out.setdefault((r["doc_id"], r["para_idx"]), set()).add((r["start"], r["end"], r["pii_type"], r["detector_rank"]))
    return out


def test_candidates(docs, paragraphs):
    ours = as_sets(detectors.span_rows(detectors.candidates(paragraphs), "candidates").collect())
    for d, lines in enumerate(docs):
        for i, text in enumerate(lines):
            assert ours.get((d, i), set()) == set(model.finds(text)), text


def test_values_are_slices(paragraphs):
    rows = detectors.span_rows(detectors.candidates(paragraphs), "candidates").join(paragraphs, ["doc_id", "para_idx"])
    for r in rows.collect():
        assert r["value"] == r["text"][r["start"]:r["end"]]


def test_dictionary(docs, paragraphs):
    ours = {}
    for r in dictionary.learn(paragraphs).collect():
        ours.setdefault(r["doc_id"], set()).add((r["pii_type"], r["value"]))
    for d, lines in enumerate(docs):
        assert ours.get(d, set()) == model.learn(lines)


@pytest.mark.parametrize("options", [{}, {"hint": "merge"}, {"hint": "broadcast"}])
def test_dictionary_hits(docs, paragraphs, options):
    words = Workspace(paragraphs.sparkSession).stage(dictionary.learn(paragraphs), "dictionary")
    ours = as_sets(dictionary.dictionary_hits(paragraphs, words, **options).collect())
    for d, lines in enumerate(docs):
        learned = model.learn(lines)
        for i, text in enumerate(lines):
            assert ours.get((d, i), set()) == set(model.known(text, learned)), (text, learned)


def test_spans_do_not_overlap_and_match(docs, paragraphs):
    words = Workspace(paragraphs.sparkSession).stage(dictionary.learn(paragraphs), "dictionary")
    ours = as_sets(detectors.span_rows(resolved(paragraphs, words), "spans").collect())
    for d, lines in enumerate(docs):
        for i, expected in enumerate(model.spans(lines)):
            assert ours.get((d, i), set()) == set(expected), lines[i]


def test_redaction(docs, paragraphs):
    result = redact(paragraphs)
    texts = {(r["doc_id"], r["para_idx"]): r["redacted"] for r in result.redacted.collect()}
    fakes = {(r["doc_id"], r["pii_type"], r["norm_value"]): r["fake"] for r in result.mapping.collect()}
    expected = [model.redact(lines) for lines in docs]
    assert texts == {(d, i): t for d, (lines, _) in enumerate(expected) for i, t in enumerate(lines)}
    assert fakes == {(d, *k): v for d, (_, m) in enumerate(expected) for k, v in m.items()}
    ordinals = result.mapping.groupBy("doc_id", "pii_type").agg(
        F.sort_array(F.collect_list("ordinal")).alias("o")
    ).collect()
    assert all(r["o"] == list(range(1, len(r["o"]) + 1)) for r in ordinals)
