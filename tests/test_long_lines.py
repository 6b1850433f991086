"""Lines with very many finds: right offsets, right choices, time in proportion."""

import random
import time

import pytest
from pyspark.sql import functions as F

from maskwright import fixed_values as fixed
from maskwright.functions import spans as S
from maskwright.functions.sweep import sweep
from maskwright.operators import detectors
from maskwright.schema import SPANS
from tests import model

# One find of each detector, separated so that finds do not join.
ONE = {
    "address_label": "Address: Flat {i}, Hill Road\n", "address_line": "Floor {i}, Pune 411001\n", "email": "u{i}@ex.org ",
    "ssn": "123-45-{j:04d} ", "ip": "10.0.{k}.7; ", "card": "4111 1111 1111 1111; ", "phone_shape": "(312) 555-{j:04d}, ",
    "phone_label": "Tel 98{i:08d}; ", "birth_date": "born 3 May 19{m}, ", "name_label": "Name: Ann Lee; ",
    "contact_list": "Contact Person: Ann Lee\n", "titled_name": "Dr. Ann Lee, ", "company": "Blue Fir Ltd; ",
}


def text_of(name, n):
    return "".join(ONE[name].format(i=i, j=i % 10000, k=i % 200, m=50 + i % 50) for i in range(n))


@pytest.mark.parametrize("name", list(ONE))
def test_offsets_across_blocks(spark, name):
    text = "ünï " + text_of(name, 700)
    rank = detectors.detector(name).rank
    rows = spark.createDataFrame([(0, 0, "body", text)], "doc_id bigint, para_idx int, story string, text string")
    found = detectors.span_rows(detectors.candidates(rows, (detectors.detector(name),)), "candidates").collect()
    assert sorted((r["start"], r["end"], r["pii_type"], r["detector_rank"]) for r in found) == sorted(f for f in model.finds(text) if f[3] == rank)
    assert len(found) >= 700


def seconds(spark, name, n):
    rows = spark.createDataFrame([(0, 0, "body", text_of(name, n))], "doc_id bigint, para_idx int, story string, text string").cache()
    rows.count()
    start = time.perf_counter()
    assert detectors.span_rows(detectors.candidates(rows, (detectors.detector(name),)), "candidates").count() >= n
    return time.perf_counter() - start


@pytest.mark.parametrize("name", ["email", "birth_date", "company", "address_line"])
def test_time_follows_the_number_of_finds(spark, name):
    seconds(spark, name, 1000)
    half, whole = seconds(spark, name, 50_000), seconds(spark, name, 100_000)
    assert whole < 3 * half + 1 and whole < 20


def chosen(spark, sets, few):
    rows = spark.createDataFrame([(i, [(a, b, k, "", r) for a, b, k, r in s]) for i, s in enumerate(sets)], f"i int, c {SPANS}")
    got = rows.select("i", S.resolve(F.col("c"), few).alias("kept")).collect()
    return {r["i"]: [(s["start"], s["end"], s["pii_type"], s["detector_rank"]) for s in r["kept"]] for r in got}


@pytest.mark.parametrize("few", [0, 4, S.FEW])
def test_choices_equal_brute_force(spark, few):
    draw = random.Random(3)
    kinds = list(fixed.PRIORITY)

    def spans(n, width, longest):
        out = set()
        while len(out) < n:
            a = draw.randrange(width)
            out.add((a, a + draw.randint(1, longest), draw.choice(kinds), draw.randint(1, 19)))
        return list(out)

    sets = [spans(n, width, longest) for n in (1, 2, 5, 30, 300) for width, longest in ((40, 8), (400, 60), (4000, 20), (300, 300)) for _ in range(3)]
    sets.append([(i * 10, i * 10 + 11, "phone", 7 + i % 2) for i in range(300)])  # a chain of ties
    sets.append([(i * 20, i * 20 + 40 - i % 7, "email", 3) for i in range(300)])
    sets.append([(0, 5000, "address", 2), *((i * 7, i * 7 + 6, "email", 3) for i in range(600))])
    sets.append([(0, i + 1, "name", 10) for i in range(200)])
    sets.append([(3, 9, "name", r) for r in (12, 10, 11)])
    for i, kept in chosen(spark, sets, few).items():
        assert kept == model.resolve(sets[i]), i


@pytest.mark.parametrize("shape", ["chain", "random", "covered"])
def test_very_many_candidates_in_one_paragraph(spark, shape):
    def seconds(n):
        i = F.sequence(F.lit(0), F.lit(n - 1))
        start = {"chain": lambda x: x * 10, "random": lambda x: F.pmod(F.xxhash64(x), F.lit(10 * n)).cast("int"), "covered": lambda x: x * 10}[shape]
        size = {"chain": lambda x: F.lit(11), "random": lambda x: F.pmod(F.hash(x), F.lit(40)) + 1, "covered": lambda x: F.when(x == 0, 10 * n).otherwise(6)}[shape]
        kind = lambda x: F.when((x == 0) & F.lit(shape == "covered"), "address").when(x % 2 == 0, "phone").otherwise("email")
        made = F.transform(i, lambda x: S.span(start(x), start(x) + size(x), kind(x), F.lit(""), x % 19))
        rows = spark.range(1).select(made.alias("c")).cache()
        rows.count()
        began = time.perf_counter()
        kept = rows.select(F.size(S.resolve(F.col("c")))).first()[0]
        assert kept == {"chain": n // 2, "covered": 1}.get(shape, kept) and kept >= 1
        return time.perf_counter() - began

    seconds(1000)
    half, whole = seconds(50_000), seconds(100_000)
    assert whole < 3 * half + 1 and whole < 20


def test_sweep_over_blocks(spark):
    rows = spark.createDataFrame([(list(range(n)),) for n in (0, 1, 4, 5, 9, 100)], "v array<int>")
    emit = lambda at, x: F.when(x % 3 != 1, at)
    running = sweep(F.col("v"), F.lit(0), lambda at, x: at + x, emit, "int", "int", stride=4)
    for r in rows.select("v", running.alias("sums")).collect():
        assert r["sums"] == [sum(range(x)) for x in r["v"] if x % 3 != 1]
