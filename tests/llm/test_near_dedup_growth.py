"""Near copies: families around the limit against brute force, and what a document costs in the shared folder."""

import collections
import os
import random

from pyspark.sql import functions as F

from maskwright.llm import common as C
from maskwright.llm import near_dedup


def shingles(text):
    words = text.split()
    return frozenset(zip(words, words[1:], strict=False))


def roots_of(texts):
    """doc_id -> the smallest doc_id that a chain of links reaches."""
    sets = {i: shingles(t) for i, t in texts.items()}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}


def families(seed, count, share):
    """Families of texts that keep about ``share`` of their first text's words, some of them cut short."""
    draw = random.Random(seed)
    words = [f"w{i}" for i in range(5000)]
    texts = {}
    for family in range(count):
        first = [draw.choice(words) for _ in range(draw.choice([12, 40, 90, 200]))]
        for copy in range(6):
            own = [w if copy == 0 or draw.random() < share else draw.choice(words) for w in first]
            texts[10 * family + copy] = " ".join(own[: len(own) - copy * len(own) // 40])
    return texts


def test_families_around_the_limit(spark):
    texts = {}
    for k, share in enumerate((0.85, 0.9, 0.94, 0.97)):
        texts |= {1000 * k + i: t for i, t in families(k, 15, share).items()}
    want = roots_of(texts)
    assert 1 < len(set(want.values())) < len(want)
    got = near_dedup.near_groups(spark.createDataFrame(sorted(texts.items()), "doc_id bigint, text string"), width=2)
    assert {r.doc_id: r.component_id for r in got.collect()} == want


def test_one_document_with_texts_of_several_sizes(spark):
    """Rows that repeat a doc_id link with what either of them links to."""
    long, short = [f"a{i}" for i in range(100)], [f"b{i}" for i in range(30)]
    rows = [(5, " ".join(long)), (5, " ".join(short)), (5, " ".join(short)), (2, " ".join(long[:-2])), (7, " ".join(short[:-2])), (9, "c d e f")]
    got = near_dedup.near_groups(spark.createDataFrame(rows, "doc_id bigint, text string"), width=2)
    want = [(2, 2), (5, 2), (5, 2), (5, 2), (7, 2), (9, 9)]
    assert sorted((r.doc_id, r.component_id) for r in got.collect()) == want


def test_shared_coordinates_of_other_sizes_make_no_candidates(spark):
    """Beginnings of one text share most coordinates, but their sizes allow no link: none is looked at more closely."""
    words = [f"s{i}" for i in range(1000)]
    texts = [(i, " ".join(words[: int(100 * 1.3**i)])) for i in range(9)]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string")
    staged = []
    keep, C.staged = C.staged, lambda rows: staged.append(keep(rows)) or staged[-1]
    try:
        got = near_dedup.near_groups(docs, width=2)
        assert all(r.kept for r in got.collect())
    finally:
        C.staged = keep
    candidates = [t for t in staged if "bits" in t.columns]
    assert candidates and all(t.isEmpty() for t in candidates)


def test_open_postings_keep_rows_with_a_partner_only(spark):
    posted = [(1, 1, 100), (1, 2, 100), (1, 3, 110), (1, 4, 300), (1, 5, 1000), (1, 6, 1001), (2, 1, 100), (2, 2, 100)]
    roots = [(2, 1), (6, 5)]
    rows = spark.createDataFrame(posted, "key bigint, node bigint, n bigint").withColumn("weight", F.lit(1))
    got = near_dedup._open(rows, spark.createDataFrame(roots, "node bigint, root bigint"), 80)
    # 1 and 2 are one component, near in size to 3; 4 has no partner; 5 and 6 are linked already.
    assert sorted((r.key, r.node) for r in got.collect()) == [(1, 1), (1, 2), (1, 3)]


def test_bytes_a_document_leaves_in_the_shared_folder(spark):
    """Documents without near copies: their signatures are written once, of 32 bits a coordinate."""
    draw = random.Random(1)
    texts = [(i, " ".join(f"v{draw.randrange(10**6)}" for _ in range(40))) for i in range(4000)]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string").repartition(2)

    def used():
        sizes = collections.Counter()
        for folder, _, names in os.walk(spark.conf.get("spark.checkpoint.dir").removeprefix("file:")):
            sizes.update({os.path.join(folder, n): os.path.getsize(os.path.join(folder, n)) for n in names})
        return sum(sizes.values())

    before = used()
    assert near_dedup.near_groups(docs, width=2).filter("kept").count() == len(texts)
    assert used() - before < 600 * len(texts)
