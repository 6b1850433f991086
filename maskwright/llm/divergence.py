"""Divergence of sources within a language, by sparse merges of term counts.

Every (lang, source) group holds, per block of term ids, one ascending array of ids with their counts.
A task is an unordered pair of groups and a block: the two arrays are co-grouped, a galloping search
intersects them, and the terms of both, of one side only and of neither are priced in both directions.

* A term is a run of ASCII letters and characters beyond ASCII, A-Z lower-cased; terms in at least
  ``MIN_DOCS`` documents of a language are kept. Null text, lang and source count as empty.
* Every document row counts, also repeated ones. No doc_id is read.
* A group without terms is priced like any other, its counts being zero. Without kept terms in a language the
  values of its pairs are 0. An empty table gives no rows. Columns beside text, lang and source are not read.
* Prices are integers: counts beyond 64 bits of price arithmetic are taken through unbounded integers.

Terms are counted in each task first; then keys are (lang, source, term). Blocks hold about ``BLOCK`` terms, so that
no task holds a vocabulary. All pairs of a language's sources are the result asked for, and no other pairs are made.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from maskwright.llm import common as C

MIN_DOCS = 3
TOP_TERMS = 200
BLOCK = 1 << 16
STRIDE = 256
HELD_TERMS = 400_000  # counts a task holds before it hands them on

# A-Z to a-z, everything else below U+0080 but a-z to a space: then a term is what split() gives.
_TO_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

_COUNTED = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_TO_TERMS).split()


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    size = 0

    def flush() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in held.items():
            terms = list(n)
            columns = [
                pa.array([lang] * (len(terms) + 1), pa.string()),
                pa.array([source] * (len(terms) + 1), pa.string()),
                pa.array([None, *terms], pa.binary()).cast(pa.string()),
                pa.array([0, *n.values()], pa.int64()),
                pa.array([0, *(docs[t] for t in terms)], pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, schema=_COUNTED)
        held.clear()

    for batch in C.text_batches(batches):
        for text, lang, source in zip(*(batch.column(i).to_pylist() for i in range(3))):
            n, docs = held.setdefault((lang, source), (Counter(), Counter()))
            counted = Counter(terms_of(text))
            size -= len(n)
            n.update(counted)
            docs.update(counted.keys())
            size += len(n)
            if size > HELD_TERMS:
                yield from flush()
                size = 0
    yield from flush()


def group_counts(docs: DataFrame) -> DataFrame:
    """``(lang, source, term, n, docs)``: occurrences and documents; one row with a null term per group."""
    empty = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    rows = docs.select(C.binary_text().alias("text"), empty("lang"), empty("source"))
    counted = rows.mapInArrow(_counts, "lang string, source string, term string, n bigint, docs bigint")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _price(n: str, whole: str) -> Column:
    return F.expr(f"1 + cast(1000000000 as decimal(10,0)) * cast({n} + 1 as decimal(20,0)) div cast({whole} as decimal(20,0))")


def _distance(p: Column, q: Column) -> Column:
    # (p - q)^2 is at most 10^18.
    return F.call_function("div", (p - q) * (p - q), q)


def prices(n: np.ndarray, whole: int) -> np.ndarray:
    """1 + floor(10^9 (n + 1) / whole), exact."""
    if len(n) and int(n.max()) >= 9_000_000_000:
        return np.array([1 + 10**9 * (int(x) + 1) // whole for x in n], np.int64)
    return 1 + 10**9 * (n + 1) // whole


def distances(p: np.ndarray | int, q: np.ndarray | int) -> np.ndarray | int:
    return (p - q) * (p - q) // q


def gallop(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """Where each of ``short`` stands in ``long``, or -1; both ascend. Windows double until they reach far enough."""
    out, at = np.full(len(short), -1, np.int64), 0
    for i in range(0, len(short), STRIDE):
        part, step = short[i : i + STRIDE], STRIDE
        while at + step < len(long) and long[at + step] < part[-1]:
            step *= 2
        window = long[at : at + step + 1]
        j = np.searchsorted(window, part)
        hit = j < len(window)
        hit[hit] = window[j[hit]] == part[hit]
        out[i : i + STRIDE][hit] = at + j[hit]
        at += int(j[-1])
    return out


def merge(ids_a: np.ndarray, n_a: np.ndarray, whole_a: int, ids_b: np.ndarray, n_b: np.ndarray, whole_b: int) -> tuple[int, int, int]:
    """Distances of a from b and of b from a over the terms that one of them has, and how many these are."""
    if len(ids_a) > len(ids_b):
        there, back, seen = merge(ids_b, n_b, whole_b, ids_a, n_a, whole_a)
        return back, there, seen
    at = gallop(ids_a, ids_b)
    both = at >= 0
    p, q = prices(n_a, whole_a), prices(n_b, whole_b)
    none_a, none_b = 1 + 10**9 // whole_a, 1 + 10**9 // whole_b
    only_b = np.ones(len(ids_b), bool)
    only_b[at[both]] = False
    there = distances(p[both], q[at[both]]).sum() + distances(p[~both], none_b).sum() + distances(none_a, q[only_b]).sum()
    back = distances(q[at[both]], p[both]).sum() + distances(none_b, p[~both]).sum() + distances(q[only_b], none_a).sum()
    return int(there), int(back), len(ids_a) + len(ids_b) - int(both.sum())


_PART = pa.schema([("lang", pa.string()), ("a", pa.string()), ("b", pa.string()), ("ab", pa.int64()), ("ba", pa.int64()), ("seen", pa.int64())])


def _merge_task(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
    def side(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        if not table.num_rows:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        return tuple(table.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in ("ids", "counts"))

    some = left if left.num_rows else right
    whole_a, whole_b = some.column("whole_a")[0].as_py(), some.column("whole_b")[0].as_py()
    ab, ba, seen = merge(*side(left), whole_a, *side(right), whole_b)
    return pa.Table.from_pylist([{"lang": key[0].as_py(), "a": key[1].as_py(), "b": key[2].as_py(), "ab": ab, "ba": ba, "seen": seen}], schema=_PART)


def divergences(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP_TERMS, block: int = BLOCK) -> DataFrame:
    """``(lang, source, part, item, value, rank)``: per group its distance from each other source of the language
    (part ``pair``), and the terms it has above their share in the language (part ``term``, the first ``top``)."""
    counted = C.staged(group_counts(docs))
    there = counted.filter("term is not null")
    kept = there.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n")).filter(F.col("docs") >= min_docs)
    kept = C.staged(kept.drop("docs"))
    blocks = max(1, -(-kept.count() // block))
    inside = Window.partitionBy("lang", "block").orderBy("term")
    numbered = kept.withColumn("block", F.pmod(F.xxhash64("term"), F.lit(blocks)).cast("int")).withColumn("id", F.row_number().over(inside))
    encoded = C.staged(there.select("lang", "source", "term", "n").join(numbered, ["lang", "term"]))

    of_lang = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("lang_n").alias("lang_total"))
    totals = encoded.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    zero = F.lit(0).cast("bigint")
    groups = (
        counted.filter("term is null").select("lang", "source")
        .join(of_lang, "lang", "left")
        .join(totals, ["lang", "source"], "left")
        .select("lang", "source", F.coalesce("v", zero).alias("v"), (F.coalesce("total", zero) + F.col("v")).alias("whole"), (F.col("lang_total") + F.col("v")).alias("lang_whole"))
    )
    groups = C.staged(groups)

    own = encoded.join(groups, ["lang", "source"]).withColumns({"p": _price("n", "whole"), "q": _price("lang_n", "lang_whole")})
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = (
        own.filter(F.col("p") > F.col("q"))
        .select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr("((p - q) * (p - q)) div q").alias("value"))
        .withColumn("rank", F.row_number().over(best))
        .filter(F.col("rank") <= top)
    )

    other = groups.select("lang", F.col("source").alias("b"), F.col("whole").alias("whole_b"))
    pairs = groups.select("lang", F.col("source").alias("a"), F.col("whole").alias("whole_a"), "v").join(other, "lang").filter(F.col("a") < F.col("b"))
    pairs = C.staged(pairs)
    arrays = (
        encoded.groupBy("lang", "source", "block")
        .agg(F.sort_array(F.collect_list(F.struct("id", "n"))).alias("pairs"))  # at most the terms of a block
        .select("lang", "source", "block", F.col("pairs.id").alias("ids"), F.col("pairs.n").alias("counts"))
    )
    task = ["lang", "a", "b", "block"]

    def as_side(name: str) -> DataFrame:
        rows = arrays.withColumnRenamed("source", name).join(pairs, ["lang", name])
        # Both sides come from one table: fresh columns tell them apart.
        return rows.select(*[F.col(c).alias(c) for c in (*task, "whole_a", "whole_b", "ids", "counts")])

    merged = as_side("a").groupBy(*task).cogroup(as_side("b").groupBy(*task)).applyInArrow(_merge_task, "lang string, a string, b string, ab bigint, ba bigint, seen bigint")
    summed = merged.groupBy("lang", "a", "b").agg(*[F.sum(c).alias(c) for c in ("ab", "ba", "seen")])
    # Terms that neither side has cost the same each.
    priced = pairs.join(summed, ["lang", "a", "b"], "left").withColumns({"p": _price("0", "whole_a"), "q": _price("0", "whole_b"), "absent": F.col("v") - F.coalesce("seen", zero)})
    total = lambda part, p, q: F.coalesce(part, zero) + F.coalesce(F.col("absent") * F.expr(f"(({p} - {q}) * ({p} - {q})) div {q}"), zero)
    ways = F.array(
        F.struct(F.col("a").alias("source"), F.col("b").alias("item"), F.when(F.col("v") > 0, total("ab", "p", "q")).otherwise(zero).alias("value")),
        F.struct(F.col("b").alias("source"), F.col("a").alias("item"), F.when(F.col("v") > 0, total("ba", "q", "p")).otherwise(zero).alias("value")),
    )
    both = priced.select("lang", F.lit("pair").alias("part"), F.inline(ways)).withColumn("rank", F.row_number().over(best))
    return both.select("lang", "source", "part", "item", "value", "rank").unionByName(terms)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergences(C.documents(spark, sf_dir, "text", "lang", "source"))


SQL = r"""
WITH docs AS (
    SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
    FROM documents
),
words AS (
    SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs
),
kept AS (
    SELECT lang, term, count(*)::HUGEINT AS n FROM words GROUP BY ALL HAVING count(DISTINCT r) >= 3
),
langs AS (SELECT lang, sum(n)::HUGEINT + count(*) AS whole FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM docs),
counts AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM words SEMI JOIN kept USING (lang, term) GROUP BY ALL),
cells AS (
    SELECT lang, source, term, coalesce(c.n, 0) AS n,
        sum(coalesce(c.n, 0)) OVER (PARTITION BY lang, source) + count(*) OVER (PARTITION BY lang, source) AS whole
    FROM groups JOIN kept USING (lang) LEFT JOIN counts AS c USING (lang, source, term)
),
priced AS (SELECT lang, source, term, n, (1 + (1000000000::HUGEINT * (n + 1)) // whole::HUGEINT)::HUGEINT AS p FROM cells),
pairs AS (
    SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
    FROM priced AS a JOIN priced AS b USING (lang, term) WHERE a.source <> b.source GROUP BY ALL
),
all_pairs AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(p.value, 0)::BIGINT AS value
    FROM groups AS a JOIN groups AS b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN pairs AS p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
),
of_lang AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (n + 1)) // whole AS q FROM kept JOIN langs USING (lang)),
terms AS (
    SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q) // q)::BIGINT AS value
    FROM priced JOIN of_lang USING (lang, term) WHERE n > 0 AND p > q
),
ranked AS (
    SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
    FROM (SELECT * FROM all_pairs UNION ALL SELECT * FROM terms)
)
SELECT lang, source, part, item, value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""
