"""The trie of conversations' prefixes, by ternary search trees over range shards.

Turns are dictionary-encoded, a conversation becomes its array of codes, and conversations are sorted by (codes, conv_id)
into range shards: equal conversations stand together, and a large group of them is cut between shards like any other
rows. Each shard inserts its distinct sequences, medians first, into a ternary search tree; one iterative traversal
gives members, children, leaves and savings of every node. A node whose subtree lies in one shard is final. The nodes
on a shard's first and last path may go on in its neighbours: how far is told by the common prefix of the sequences on both sides
of the bound. A shard counts a child, and the one copy that sharing keeps, where the node begins, and a leaf where it ends,
so that the parts of a boundary node simply add up.

* Turns are ordered by ``turn`` (null first), equal ones by role, then by the code of the turn, which follows the digest of
  role and text. Repeated rows are turns of their own. Null role or text count as empty.
* Rows without a conv_id belong to no conversation and are left out. An empty table has no nodes.
* Columns beside conv_id, turn, role and text are not read.
* One conversation's codes and text sizes are one row (12 bytes a turn); a shard's distinct sequences are held by one task.
* The conv_ids that end in a node of one shard are hashed there. Those of a boundary node are cut into pieces of ``PIECE`` ids, which one task hashes in
  order, a batch at a time: a SHA-256 has no parallel form.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from maskwright.llm import common as C

SALTS = 64
PIECE = 512
HEAD = 8  # no conversation takes more turns from another
NOTHING = hashlib.sha256(b"").hexdigest()


def coded_turns(conversations: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, code, size)``: equal (role, text) have equal codes; ``size`` is the text's bytes in UTF-8.

    Of a turn that very many conversations hold, each salt sends one row to the dictionary and meets one row of it.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256))
    rows = conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        "turn",
        role.alias("role"),
        F.octet_length(text).alias("size"),
        digest.alias("digest"),
        F.pmod(F.xxhash64("conv_id"), F.lit(SALTS)).cast("int").alias("salt"),
    )
    salts = rows.select("digest", "salt").distinct().groupBy("digest").agg(F.collect_list("salt").alias("salts"))
    # Codes follow the digests: 16 bits of the digest, then the row's number among those that share them.
    chunk = F.conv(F.hex(F.substring("digest", 1, 2)), 16, 10).cast("bigint")
    inside = Window.partitionBy("chunk").orderBy("digest")
    numbered = salts.withColumn("chunk", chunk).withColumn("code", F.shiftleft("chunk", 40) + F.row_number().over(inside))
    dictionary = numbered.select("digest", F.explode("salts").alias("salt"), "code")
    return rows.join(dictionary, ["digest", "salt"]).select("conv_id", "turn", "role", "code", "size")


def sequences(turns: DataFrame) -> DataFrame:
    """``(conv_id, codes, sizes)``: the turns of each conversation, in order."""
    ordered = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "code", "size"))).alias("turns"))
    return ordered.select("conv_id", F.col("turns.code").alias("codes"), F.col("turns.size").alias("sizes"))


def with_shared_heads(sequence: DataFrame) -> DataFrame:
    """Conversations rebuilt: the first h turns of conversation c - c % 5, then c's own after its first h, with h = crc32(c) % 9."""
    head = sequence.select(F.col("conv_id").alias("base"), F.slice("codes", 1, HEAD).alias("head_codes"), F.slice("sizes", 1, HEAD).alias("head_sizes"))
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(9)).cast("int")
    rows = sequence.withColumn("base", F.col("conv_id") - F.col("conv_id") % 5).withColumn("h", h).join(head, "base", "left")

    def joined(own: str, of_head: str, kind: str):
        first = F.slice(F.coalesce(F.col(of_head), F.array().cast(kind)), F.lit(1), F.col("h"))
        return F.concat(first, F.slice(F.col(own), F.col("h") + 1, F.greatest(F.size(own) - F.col("h"), F.lit(0)))).alias(own)

    return rows.select("conv_id", joined("codes", "head_codes", "array<bigint>"), joined("sizes", "head_sizes", "array<int>"))


class TernaryTree:
    """A ternary search tree of sequences; node 0 is the root above the first symbols.

    ``key``, ``lo``, ``hi`` order the children of one parent, ``eq`` leads to a node's own children.
    """

    def __init__(self) -> None:
        self.key, self.lo, self.eq, self.hi, self.parent, self.depth, self.size, self.end = [-1], [-1], [-1], [-1], [-1], [0], [0], [-1]

    def _new(self, key: int, parent: int, size: int) -> int:
        for column, value in ((self.key, key), (self.lo, -1), (self.eq, -1), (self.hi, -1), (self.parent, parent), (self.depth, self.depth[parent] + 1), (self.size, size), (self.end, -1)):
            column.append(value)
        return len(self.key) - 1

    def insert(self, codes: list[int], sizes: list[int], number: int) -> None:
        key, at = self.key, 0
        for code, size in zip(codes, sizes, strict=True):
            links, link, child = self.eq, at, self.eq[at]
            while child >= 0 and key[child] != code:
                links, link = (self.lo if code < key[child] else self.hi), child
                child = links[link]
            if child < 0:
                child = links[link] = self._new(code, at, size)
            at = child
        self.end[at] = number

    @classmethod
    def of(cls, ordered: list[tuple[list[int], list[int]]]) -> TernaryTree:
        """Of distinct sequences in ascending order: the middle one goes in first, then the middles of both halves."""
        tree, open_ = cls(), [(0, len(ordered))]
        while open_:
            first, last = open_.pop()
            if first < last:
                middle = (first + last) // 2
                tree.insert(*ordered[middle], middle)
                open_ += [(middle + 1, last), (first, middle)]
        return tree

    def path(self, codes: list[int]) -> list[int]:
        """The nodes of a sequence that is in the tree, root first."""
        nodes = [0]
        for code in codes:
            child = self.eq[nodes[-1]]
            while self.key[child] != code:
                child = self.lo[child] if code < self.key[child] else self.hi[child]
            nodes.append(child)
        return nodes

    def parents_first(self) -> list[int]:
        """All nodes, ascending within their parent, each after its parent."""
        order, open_ = [0], [(self.eq[0], False)]
        while open_:
            node, passed = open_.pop()
            if node < 0:
                continue
            if passed:
                order.append(node)
                open_.append((self.eq[node], False))
            else:
                open_ += [(self.hi[node], False), (node, True), (self.lo[node], False)]
        return order


_NODES = pa.schema(
    [("kind", pa.string()), ("shard", pa.int32()), ("digest", pa.binary()), ("parent", pa.binary()), ("conv_id", pa.int64()), ("depth", pa.int64()), ("parent_conv_id", pa.int64())]
    + [(c, pa.int64()) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    + [("ends_sha256", pa.string()), ("piece", pa.int64()), ("ids", pa.binary())]
)
_NODES_DDL = (
    "kind string, shard int, digest binary, parent binary, conv_id bigint, depth bigint, parent_conv_id bigint, "
    "n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string, piece bigint, ids binary"
)
_SUMS = ("n_convs", "n_children", "n_leaves", "saved_tokens")


class _Run:
    """One distinct sequence of a shard and the conversations that have it."""

    def __init__(self, codes: list[int], sizes: list[int], first: int) -> None:
        self.codes, self.sizes, self.first, self.n = codes, sizes, first, 0
        self.hash, self.pieces, self.sent = hashlib.sha256(), [], 0

    def add(self, conv_ids: list[int], keep: bool) -> None:
        text = ",".join(map(str, conv_ids)).encode()
        self.hash.update((b"," if self.n else b"") + text)
        self.n += len(conv_ids)
        if keep:
            self.pieces.append(text)

    def take_pieces(self, shard: int) -> pa.RecordBatch:
        n, digest = len(self.pieces), digests(self.codes, len(self.codes))[-1]
        columns = {"kind": ["piece"] * n, "shard": [shard] * n, "digest": [digest] * n, "piece": list(range(self.sent, self.sent + n)), "ids": self.pieces}
        self.pieces, self.sent = [], self.sent + n
        return _rows([columns.get(f.name, [None] * n) for f in _NODES])


def _rows(columns: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _NODES, strict=True)], schema=_NODES)


def digests(codes: list[int], depth: int) -> list[bytes]:
    """Names of the prefixes up to a depth, the same in every shard."""
    out = [hashlib.sha256(b"root").digest()]
    for code in codes[:depth]:
        out.append(hashlib.sha256(out[-1] + code.to_bytes(8, "little", signed=True)).digest())
    return out


def _shard_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes of one shard, whose rows (codes, sizes, conv_id, shard, shared_before, shared_after) come in order.

    Equal sequences follow each other. The first run may have begun in the shard before, and the last one may go on in
    the next: the conv_ids of such a run leave as pieces.
    """
    runs: list[_Run] = []
    shard = before = after = None
    begins = lambda number: number == 0 and before == len(runs[0].codes)
    for batch in C.text_batches(batches):
        if not batch.num_rows:
            continue
        column = dict(zip(batch.schema.names, batch.columns, strict=True))
        if shard is None:
            shard, before, after = (column[c][0].as_py() for c in ("shard", "shared_before", "shared_after"))
        codes, ids = column["codes"].to_pylist(), column["conv_id"].to_pylist()
        i = 0
        while i < len(ids):
            j = i + 1
            while j < len(ids) and j - i < PIECE and codes[j] == codes[i]:
                j += 1
            if not runs or runs[-1].codes != codes[i]:
                if runs and not begins(len(runs) - 1):
                    runs[-1].pieces = []  # not the last run after all
                runs.append(_Run(codes[i], column["sizes"][i].as_py(), ids[i]))
            run = runs[-1]
            run.add(ids[i:j], begins(len(runs) - 1) or after == len(run.codes))
            if len(run.pieces) >= PIECE:
                yield run.take_pieces(shard)
            i = j
    if not runs:
        return
    cut = {number for number in (0, len(runs) - 1) if begins(number) or (number == len(runs) - 1 and after == len(runs[number].codes))}
    tree = TernaryTree.of([(r.codes, r.sizes) for r in runs])
    order = tree.parents_first()
    n = len(tree.key)
    first_path, last_path = tree.path(runs[0].codes), tree.path(runs[-1].codes)
    begun, goes_on = set(first_path[: before + 1]), set(last_path[: after + 1])
    name: dict[int, bytes] = {}
    for path, run, depth in ((first_path, runs[0], before), (last_path, runs[-1], after)):
        if depth >= 0:
            name |= dict(zip(path, digests(run.codes, depth)))

    members, lowest, children, leaves, saved = [0] * n, [None] * n, [0] * n, [0] * n, [0] * n
    childless = [e < 0 for e in tree.eq]
    for node in reversed(order):
        if tree.end[node] >= 0:
            run = runs[tree.end[node]]
            members[node] += run.n
            lowest[node] = run.first if lowest[node] is None else min(lowest[node], run.first)
        if childless[node] and node not in goes_on:
            leaves[node] += 1
        saved[node] += (members[node] - (node not in begun)) * tree.size[node]
        up = tree.parent[node]
        if up >= 0:
            members[up] += members[node]
            lowest[up] = lowest[node] if lowest[up] is None else min(lowest[up], lowest[node])
            leaves[up] += leaves[node]
            saved[up] += saved[node]
            children[up] += node not in begun

    for at in range(0, len(order), 10_000):
        part = order[at : at + 10_000]
        inner = [x not in name for x in part]
        ends = [None if tree.end[x] < 0 or tree.end[x] in cut else runs[tree.end[x]].hash.hexdigest() for x in part]
        parents = [tree.parent[x] for x in part]
        yield _rows(
            [
                ["inner" if own else "boundary" for own in inner],
                [shard] * len(part),
                [name.get(x) for x in part],
                [name.get(p) for p in parents],
                [lowest[x] for x in part],
                [tree.depth[x] for x in part],
                [None if p < 0 or p in name else lowest[p] for p in parents],
                *([column[x] for x in part] for column in (members, children, leaves, saved)),
                ends,
                [None] * len(part),
                [None] * len(part),
            ]
        )
    for number in sorted(cut):
        if runs[number].pieces:
            yield runs[number].take_pieces(shard)


def _first_and_last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    first = last = shard = None
    for batch in batches:
        if batch.num_rows:
            last = batch.column(0)[batch.num_rows - 1].as_py()
            if first is None:
                first, shard = batch.column(0)[0].as_py(), batch.column(1)[0].as_py()
    if first is not None:
        kind = pa.list_(pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([first], kind), pa.array([last], kind)], names=["shard", "first", "last"])


def _hash_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each digest's pieces, which come in order and are joined by commas."""
    current, running = None, hashlib.sha256()
    answer = lambda: pa.RecordBatch.from_arrays([pa.array([current], pa.binary()), pa.array([running.hexdigest()])], names=["digest", "ends"])
    for batch in batches:
        for digest, ids in zip(batch.column(0).to_pylist(), batch.column(1)):
            if digest != current:
                if current is not None:
                    yield answer()
                current, running = digest, hashlib.sha256()
            else:
                running.update(b",")
            running.update(ids.as_py())
    if current is not None:
        yield answer()


def prefix_trie(sequence: DataFrame) -> DataFrame:
    """The nodes of the trie of ``(conv_id, codes, sizes)``, one row each."""
    ordered = C.checkpointed(sequence.select("codes", "sizes", "conv_id").repartitionByRange("codes", "conv_id").sortWithinPartitions("codes", "conv_id"))
    shards = ordered.withColumn("shard", F.spark_partition_id())
    # One row per shard from here to ``bounds``.
    edges = shards.select("codes", "shard").mapInArrow(_first_and_last, "shard int, first array<bigint>, last array<bigint>")
    along = Window.orderBy("shard")

    def common(a: str, b: str):
        """The length of the common prefix; -1 if there is no neighbour."""
        differs = F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), False)
        return F.when(F.col(b).isNull(), -1).when(differs == 0, F.size(a)).otherwise(differs - 1).cast("int")

    beside = edges.withColumns({"previous": F.lag("last").over(along), "next": F.lead("first").over(along)})
    bounds = beside.select("shard", common("first", "previous").alias("shared_before"), common("last", "next").alias("shared_after"))
    # As many rows as shards, three integers each.
    nodes = C.staged(shards.join(F.broadcast(bounds), "shard").mapInArrow(_shard_nodes, _NODES_DDL))

    boundary = nodes.filter("kind = 'boundary'")
    merged = boundary.groupBy("digest").agg(
        F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"), F.min("parent").alias("parent"), F.min("shard").alias("shard"),
        F.max("ends_sha256").alias("ends_sha256"), *[F.sum(c).alias(c) for c in _SUMS]
    )
    pieces = nodes.filter("kind = 'piece'").select("digest", "ids", "shard", "piece")
    in_order = pieces.repartition("digest").sortWithinPartitions("digest", "shard", "piece").select("digest", "ids")
    hashed = in_order.mapInArrow(_hash_pieces, "digest binary, ends string")
    merged = C.staged(merged.join(hashed, "digest", "left").withColumn("ends_sha256", F.coalesce("ends", "ends_sha256")).drop("ends"))

    # A child of a boundary node meets its parent's row for the child's own shard.
    parents = boundary.select(F.col("digest").alias("parent"), "shard").join(merged.select(F.col("digest").alias("parent"), F.col("conv_id").alias("above")), "parent")
    columns = ["conv_id", "depth", "parent_conv_id", *_SUMS, "ends_sha256"]
    open_ = nodes.filter("kind = 'inner' and parent is not null").select("shard", "parent", *columns)
    open_ = open_.unionByName(merged.withColumn("parent_conv_id", F.lit(None).cast("bigint")).select("shard", "parent", *columns))
    closed = nodes.filter("kind = 'inner' and parent is null").select(*columns)
    found = open_.join(parents, ["parent", "shard"], "left").withColumn("parent_conv_id", F.col("above"))
    return closed.unionByName(found.select(*columns)).fillna(NOTHING, "ends_sha256")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    C.ship(spark)
    turns = coded_turns(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return prefix_trie(with_shared_heads(C.staged(sequences(turns))))


SQL = """
WITH turns AS (
    SELECT conv_id, list({'role': coalesce(role, ''), 'text': coalesce(text, '')} ORDER BY turn NULLS FIRST) AS turns
    FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
),
crc AS (
    SELECT conv_id, turns, xor(list_reduce(
        list_concat([4294967295::BIGINT], list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ord(c)::BIGINT)),
        lambda s, b: list_reduce(
            list_concat([xor(s, b)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
            lambda r, i: CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384::BIGINT) ELSE r >> 1 END
        )
    ), 4294967295::BIGINT) % 9 AS h
    FROM turns
),
rebuilt AS (
    SELECT o.conv_id, list_concat(coalesce(b.turns[1:o.h], []), o.turns[o.h + 1:]) AS turns
    FROM crc AS o LEFT JOIN turns AS b ON b.conv_id = o.conv_id - o.conv_id % 5
),
prefixes AS (
    SELECT conv_id, d, turns[1:d] AS prefix, d = len(turns) AS ends
    FROM (SELECT conv_id, turns, unnest(range(0, len(turns) + 1)) AS d FROM rebuilt)
),
nodes AS (
    SELECT d, prefix, min(conv_id) AS conv_id, count(*) AS n_convs,
        sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256,
        CASE WHEN d = 0 THEN 0 ELSE (count(*) - 1) * strlen(prefix[d].text) END AS saved
    FROM prefixes GROUP BY d, prefix
),
children AS (SELECT d - 1 AS d, prefix[1:d - 1] AS prefix, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY ALL),
counted AS (SELECT n.*, coalesce(c.n_children, 0) AS n_children FROM nodes AS n LEFT JOIN children AS c USING (d, prefix)),
subtrees AS (
    SELECT up AS d, prefix[1:up] AS prefix, count(*) FILTER (n_children = 0) AS n_leaves, sum(saved) AS saved_tokens
    FROM (SELECT *, unnest(range(0, d + 1)) AS up FROM counted) GROUP BY ALL
)
SELECT n.conv_id, n.d::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, s.n_leaves,
    s.saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
FROM counted AS n JOIN subtrees AS s USING (d, prefix)
LEFT JOIN nodes AS p ON p.d = n.d - 1 AND p.prefix = n.prefix[1:n.d - 1]
"""
