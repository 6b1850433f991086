"""Near-duplicate linking by an inverted join over MinHash signature coordinates.

1. Every text becomes a set of word shingles, a signature of ``COORDINATES`` minima, and a class: equal
   sets are one class, represented by its smallest doc_id, so copies are never paired.
2. Representatives are posted under the values of two coordinates at a time. Of signatures that agree in
   at least ``MATCHES`` coordinates, so many of these couples agree too (``couples``): they share a posting
   among each one's couples without the most frequent ones (the prefix); those are skipped and only counted
   when a pair is checked. Two coordinates are seldom shared by chance, and a posting only counts for a
   document if it shows another one of a size that allows a link: most documents end here.
3. Inside a posting, documents first meet one hub, the one whose coordinates are the most common, instead
   of each other; agreeing coordinates are counted, pairs from ``MATCHES`` on are confirmed on the full
   sets, links are joined to components. Then only documents that a posting still shows in different
   components meet: those outside its largest component against the others, each pair under one key. That
   pass has no cap, so no pair is left out.
4. Pairs leave a join only if their parity sketches allow the similarity: each shingle flips one of
   ``BITS`` bits, so two sketches never differ in more bits than the sets do in shingles. The sketch
   drops no link.

At similarity 0.8, 37 of 64 agreeing coordinates are missed about once in 100,000 pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from maskwright.llm import common as C

COORDINATES = 64
MATCHES = 37
WIDTH = 5
PERCENT = 80
CACHE = 400_000
LANES = 16
BITS = 64 * LANES

_MIX = np.uint64(0x9E3779B97F4A7C15)
_PRIME = np.uint64(0xD6E8FEB86659FD93)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_hashes = _WordHashes()


def forget() -> None:
    """Empties this worker's memory of words."""
    _hashes.clear()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _PRIME
    return x ^ (x >> np.uint64(29))


def shingles(text: bytes, width: int) -> np.ndarray:
    """The sorted distinct 64-bit hashes of the ``width``-word shingles of a text, A-Z lower-cased.

    With fewer words, the whole sequence is one shingle; without words the set is empty.
    """
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(_hashes) > CACHE:
        _hashes.clear()
    codes = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    width = min(width, len(words))
    out = np.full(len(words) - width + 1, width, np.uint64)
    for i in range(width):
        out = _mixed(out * _MIX + codes[i : i + len(out)])
    return np.unique(out)


def _coordinates(count: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240229)
    draw = rng.integers(0, 1 << 63, size=(2, count), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return draw[0], draw[1]


def signatures(sets: list[np.ndarray], count: int = COORDINATES) -> np.ndarray:
    """One row of ``count`` minima per non-empty set, of each the low 32 bits: equal minima stay equal."""
    flat, starts = np.concatenate(sets), np.cumsum([0] + [len(s) for s in sets[:-1]])
    factor, offset = _coordinates(count)
    out = np.empty((len(sets), count), np.uint32)
    for k in range(count):
        out[:, k] = np.minimum.reduceat(flat * factor[k] + offset[k], starts).astype(np.uint32)
    return out.view(np.int32)


def signed(docs: DataFrame, width: int, count: int) -> DataFrame:
    """(doc_id, n_shingles, cls, sig); cls and sig are null for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.text_batches(batches):
            sets = [shingles(t, width) for t in batch.column(1).to_pylist()]
            sizes = np.array([len(s) for s in sets], np.int64)
            full = [s for s in sets if len(s)]
            values = signatures(full, count).reshape(-1) if full else np.empty(0, np.int32)
            nulls = pa.array(sizes == 0)
            offsets = np.concatenate([[0], np.cumsum(np.where(sizes > 0, count, 0))])
            sig = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values), mask=nulls)
            cls = pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary())
            yield pa.record_batch([batch.column(0), pa.array(sizes), cls, sig], ["doc_id", "n_shingles", "cls", "sig"])

    return docs.select("doc_id", C.binary_text()).mapInArrow(
        C.leaving_nothing(run, forget), "doc_id bigint, n_shingles bigint, cls binary, sig array<int>"
    )


def parity_sketches(sets: list[np.ndarray]) -> np.ndarray:
    """One row of ``LANES`` 64-bit words per set: bit i tells whether an odd number of shingles falls on i."""
    number = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    place = (np.concatenate([*sets, np.empty(0, np.uint64)]) >> np.uint64(32)).astype(np.int64) % BITS
    odd = np.bincount(number * BITS + place, minlength=len(sets) * BITS).astype(np.uint8) & 1
    return np.packbits(odd, bitorder="little").view("<i8").reshape(len(sets), LANES)


def sketched(texts: DataFrame, width: int) -> DataFrame:
    """(node, text, n, bits): the set's size and parity sketch beside each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.text_batches(batches):
            sets = [shingles(t, width) for t in batch.column(1).to_pylist()]
            bits = parity_sketches(sets).reshape(-1)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * LANES, pa.int32()), pa.array(bits))
            yield pa.record_batch([*batch.columns, pa.array([len(s) for s in sets], pa.int64()), lists], ["node", "text", "n", "bits"])

    return texts.select("node", "text").mapInArrow(
        C.leaving_nothing(run, forget), "node bigint, text binary, n bigint, bits array<bigint>"
    )


def sizes_allow(n: Column, o_n: Column, percent: int) -> Column:
    """Whether sets of these sizes can be linked; null beside a null, which ``least`` would pass over."""
    return (100 * n >= percent * o_n) & (100 * o_n >= percent * n)


def possible(n: Column, bits: Column, o_n: Column, o_bits: Column, percent: int) -> Column:
    """Whether the sketches allow the similarity: linked sets differ in at most (100 - p) / (100 + p) of their sizes' sum."""
    differing = sum((F.bit_count(bits[i].bitwiseXOR(o_bits[i])) for i in range(1, LANES)), F.bit_count(bits[0].bitwiseXOR(o_bits[0])))
    return sizes_allow(n, o_n, percent) & (differing * (100 + percent) <= (n + o_n) * (100 - percent))


def confirmed(pairs: DataFrame, percent: int, width: int) -> DataFrame:
    """Of pairs (u, v, text_u, text_v) those whose full shingle sets are similar enough.

    Texts travel rather than sets: they are smaller.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, one = b"", np.empty(0, np.uint64)
        for batch in C.text_batches(batches):
            near = []
            for text_u, text_v in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if text_u != hub:  # many pairs in a row share their hub
                    hub, one = text_u, shingles(text_u, width)
                two = shingles(text_v, width)
                common = len(np.intersect1d(one, two, assume_unique=True))
                near.append(100 * common >= percent * (len(one) + len(two) - common))
            yield pa.record_batch(batch.columns[:2], ["u", "v"]).filter(pa.array(near, pa.bool_()))

    return pairs.select("u", "v", "text_u", "text_v").mapInArrow(C.leaving_nothing(run, forget), "u bigint, v bigint")


def agreeing(a: Column, b: Column) -> Column:
    """How many coordinates of two signatures agree."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda same: same))


def couples(count: int, matches: int) -> tuple[int, int]:
    """How many coordinates are posted together, and how many such groups agree when ``matches`` of ``count`` coordinates do.

    Each coordinate that differs spoils one group at most. If that leaves none, coordinates are posted one by one.
    """
    together = 2 if count // 2 > count - matches else 1
    return together, count // together - (count - matches)


def prefixes(reps: DataFrame, count: int, matches: int, percent: int) -> DataFrame:
    """(node, n, prefix, weight): the rarest keys of each representative, of which any partner shares one; weight
    is how often all of its keys occur, so it is large in the middle of a group.

    A key counts if it has another document whose size allows a link. One between two sizes that allow it is
    allowed with both, so the neighbours by size tell. Postings are dealt once, and counted where they lie.
    """
    together, least = couples(count, matches)
    groups = [[F.col("sig")[i] for i in range(at, at + together)] for at in range(0, count - together + 1, together)]
    keys = F.array(*[F.xxhash64(F.lit(number), *group) for number, group in enumerate(groups)])
    posted = reps.select("node", "n", F.explode(keys).alias("key"))
    by_size = Window.partitionBy("key").orderBy("n")
    all_sizes = by_size.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    met = posted.select(
        *posted.columns,
        F.lag("n").over(by_size).alias("below"),
        F.lead("n").over(by_size).alias("above"),
        F.count(F.lit(1)).over(all_sizes).alias("times"),
    )
    allowed = [F.coalesce(sizes_allow(F.col("n"), F.col(c), percent), F.lit(False)) for c in ("below", "above")]
    shared = met.filter(allowed[0] | allowed[1])
    # Keys that no other document has are the rarest: they use up the prefix first.
    lists = shared.groupBy("node", "n").agg(F.sort_array(F.collect_list(F.struct("times", "key"))).alias("keys"))
    return lists.filter(F.size("keys") >= least).select(
        "node",
        "n",
        F.slice("keys.key", F.lit(1), F.size("keys") - (least - 1)).alias("prefix"),
        F.aggregate("keys.times", F.lit(0).cast("bigint"), lambda total, times: total + times).alias("weight"),
    )


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for the nodes of an edge table (u, v): the smallest node that each can reach.

    Every node takes the smallest of its neighbours and itself, paths are halved, and edges between
    what became one node vanish, until none is left.
    """
    edges, labels = C.checkpointed(edges.filter("u <> v").distinct()), None
    while not edges.isEmpty():
        both = edges.union(edges.select("v", "u"))
        up = both.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("p"))
        up = C.checkpointed(up)
        moved = True
        while moved:  # paths halve until every node points to a root
            above = up.select(F.col("u").alias("p"), F.col("p").alias("q"))
            to = F.coalesce("q", "p")
            jumped = C.checkpointed(up.join(above, "p", "left").select("u", to.alias("p"), (to != F.col("p")).alias("moved")))
            up, moved = jumped.select("u", "p"), not jumped.filter("moved").isEmpty()
        if labels is None:
            labels = up.select(F.col("u").alias("node"), F.col("p").alias("root"))
        else:
            merged = up.select(F.col("u").alias("root"), "p")
            labels = C.checkpointed(labels.join(merged, "root", "left").select("node", F.coalesce("p", "root").alias("root")))
        ends = up.select(F.col("u").alias("v"), F.col("p").alias("pv"))
        edges = edges.join(up, "u").join(ends, "v").select(F.col("p").alias("u"), F.col("pv").alias("v"))
        edges = C.checkpointed(edges.filter("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    if labels is None:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return labels


class _Links:
    """Checks pairs of representatives, first on sketches and signatures, then on full sets."""

    def __init__(self, profiles: DataFrame, texts: DataFrame, matches: int, percent: int, width: int) -> None:
        self.profiles, self.texts, self.matches, self.percent, self.width = profiles, texts, matches, percent, width

    def _joined(self, pairs: DataFrame, table: DataFrame, *values: str, last: Column | None = None) -> DataFrame:
        """Pairs with ``values`` of both ends. A staged table of few pairs is small enough for Spark to broadcast."""
        for end in ("v", "u"):
            side = table.select(F.col("node").alias(f"node_{end}"), *[F.col(c).alias(f"{c}_{end}") for c in values])
            on = F.col(end) == F.col(f"node_{end}")
            pairs = pairs.join(side, on if last is None or end == "v" else on & last)
        return pairs

    def found(self, pairs: DataFrame) -> DataFrame:
        near = possible(F.col("n_u"), F.col("bits_u"), F.col("n_v"), F.col("bits_v"), self.percent)
        met = self._joined(C.staged(pairs), self.profiles, "n", "bits", "sig", last=near)
        likely = C.staged(met.filter(agreeing(F.col("sig_u"), F.col("sig_v")) >= self.matches).select("u", "v").distinct())
        return C.checkpointed(confirmed(self._joined(likely, self.texts, "text"), self.percent, self.width).distinct())


def _open(posted: DataFrame, roots: DataFrame, percent: int) -> DataFrame:
    """(key, node, n, root) of the postings that show more than one component, as far as a row's size allows a link
    with another component: with the nearest smaller or larger size of one."""
    rows = posted.join(roots, "node", "left").select("key", "node", "n", F.coalesce("root", "node").alias("root"))
    several = rows.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b")).filter("a < b").select("key")
    rows = rows.join(several, "key")
    near = F.lit(False)
    for name, order in (("below", ("n", "root")), ("above", (F.desc("n"), F.desc("root")))):
        along = Window.partitionBy("key").orderBy(*order)
        # The size before the run of rows of one root is the nearest of another.
        before = F.when(F.lag("root").over(along) != F.col("root"), F.lag("n").over(along))
        rows = rows.withColumn(name, before)
        rows = rows.withColumn(name, F.last(name, ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, 0)))
        near = near | F.coalesce(sizes_allow(F.col("n"), F.col(name), percent), F.lit(False))
    return rows.filter(near).select("key", "node", "n", "root")


def _with_hubs(posted: DataFrame, percent: int) -> DataFrame:
    """Pairs (u, v) of each posting's hub, its node with the largest weight, and its other nodes of a size that allows a link."""
    hubs = posted.groupBy("key").agg(F.max(F.struct("weight", "node", "n")).alias("hub"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("key", "hub")
    met = posted.join(hubs, "key").filter(F.col("node") != F.col("hub.node")).filter(sizes_allow(F.col("n"), F.col("hub.n"), percent))
    return met.select(F.least("node", "hub.node").alias("u"), F.greatest("node", "hub.node").alias("v")).distinct()


def _rest(posted: DataFrame, profiles: DataFrame, percent: int) -> DataFrame:
    """All pairs of a posting that lie in different components and whose sketches allow a link."""
    parts = posted.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n"))
    open_ = parts.groupBy("key").agg(F.max(F.struct("n", "root")).alias("top"), F.count(F.lit(1)).alias("roots")).filter("roots > 1")
    rows = posted.join(open_.select("key", F.col("top.root").alias("top")), "key").join(profiles.select("node", "n", "bits"), ["node", "n"])
    outside = rows.filter("root <> top").select(*[F.col(c).alias(f"o_{c}") for c in ("key", "node", "root", "n", "bits")])
    apart = F.expr("root <> o_root AND (root = top OR o_node < node)")
    near = possible(F.col("n"), F.col("bits"), F.col("o_n"), F.col("o_bits"), percent)
    met = outside.join(rows, (F.col("o_key") == F.col("key")) & apart & near)
    return met.select(F.least("node", "o_node").alias("u"), F.greatest("node", "o_node").alias("v")).distinct()


def near_groups(
    docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, count: int = COORDINATES, matches: int = MATCHES
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept.

    Null or wordless texts link with nothing, nor do rows without a doc_id (component_id null, kept).
    Rows that repeat a doc_id are one document: what any of them links to, it links to. An empty
    table gives an empty one.
    """
    rows = C.staged(signed(docs, width, count))
    linkable = rows.filter("doc_id IS NOT NULL AND cls IS NOT NULL")
    alone = rows.filter("doc_id IS NULL OR cls IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("node"))
    # Signatures stay behind: they are many times larger than the rest of a row.
    members = C.with_group(linkable.drop("sig"), ["cls"], F.xxhash64("doc_id"), node=(F.col("doc_id"), "min"))
    members = C.checkpointed(members.select("doc_id", "n_shingles", "cls", "node"))
    copies = members.filter("doc_id <> node").select("doc_id", "cls").distinct()
    reps = linkable.dropDuplicates(["doc_id", "cls"]).join(copies, ["doc_id", "cls"], "left_anti")
    signed_sets = [F.col("doc_id").alias("node"), F.col("n_shingles").alias("n"), "sig"]
    heads = C.checkpointed(prefixes(reps.select(*signed_sets), count, matches, percent))
    texts = docs.select(F.col("doc_id").alias("node"), C.binary_text().alias("text"))
    texts = C.staged(sketched(C.in_table(texts, heads, "node"), width))
    profiles = C.in_table(linkable.select(*signed_sets), heads, "node").distinct()
    profiles = C.staged(profiles.join(texts.select("node", "n", "bits").distinct(), ["node", "n"]))
    posted = heads.select(F.explode("prefix").alias("key"), "node", "n", "weight")

    links = _Links(profiles, texts, matches, percent, width)
    found = links.found(_with_hubs(posted, percent))
    roots = components(found)
    more = links.found(_rest(C.checkpointed(_open(posted, roots, percent)), profiles, percent))
    if not more.isEmpty():
        roots = components(found.union(more))
    linked = members.select("doc_id", "n_shingles", "node").join(roots, "node", "left")
    linked = linked.select("doc_id", "n_shingles", F.coalesce("root", "node").alias("component_id"))
    all_rows = linked.unionByName(alone.withColumnRenamed("node", "component_id"))
    return all_rows.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near_copies(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """Of each group of near copies the document with the smallest doc_id, with the input's columns."""
    dropped = near_groups(docs, width, percent).filter("NOT kept").select(F.col("doc_id").alias("dropped")).distinct()
    rows = C.whole_rows(docs, id=F.col("doc_id"))
    return rows.join(dropped, rows["id"] == dropped["dropped"], "left_anti").select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: sets of two-word shingles, links from a similarity of 0.8."""
    return near_groups(C.documents(spark, sf_dir), width=2)
