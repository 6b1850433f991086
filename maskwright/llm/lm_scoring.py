"""Log-probabilities of texts under a smoothed n-gram model, by a weighted backoff automaton.

States are the histories seen in training, up to ``order - 1`` words; a seen n-gram is an arc with the logarithm of its smoothed probability, and every
state has a failure arc to its history without the oldest word, whose weight is what smoothing leaves for words unseen there. A
traversal reads a text from left to right, carries its state, follows failure arcs until the next word has an arc, and
adds up the weights.

Counts are smoothed towards the shorter history: p(w | h) = (c(h w) + m p(w | h')) / (c(h) + m), h' being h without its oldest
word and m the order's weight in ``MASS``. So a failure arc weighs m / (c(h) + m), and the probabilities of a state add up to one. Without a history, p(w)
is the base: (c(w) + 0.5) / (N + 0.5 (V + 1)).

No task holds the model. Documents are cut into blocks of about ``BLOCK_BYTES`` of text, each with a dictionary of its own.
A block asks for the counts of its distinct words and n-grams, and sends along how often its training documents have
them; slices of the key space add these up and answer every block in the order of its request. The block's
automaton then has exactly the states and arcs that its texts can reach. Slices follow the number of tokens, so both the
tasks and what they gather grow with the corpus, and a word that fills a third of it is one entry per block.

* Words are compared exactly; n-grams of two words and more by hashes of their words' hashes. These have 24 bits more than the
  number of tokens: the chance that an n-gram shares its hash with another one is about 2^-24 at every size.
* Tokens: A-Z lower-cased words, then one end. A null or empty text has the end alone. A document without doc_id is not held out.
* Repeated rows are trained on and scored each by itself. Without training documents all counts are 0, and a token's base is log10(1).
* An empty table gives no rows. Columns beside doc_id and text are not read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.llm import common as C

ORDER = 3
MASS = {2: 1000.0, 3: 50.0}
BLOCK_BYTES = 12 << 20
SLICE = 1_500_000  # tokens per slice of the key space, about
SPARE_BITS = 24
LANE = 1024  # a long text is traversed in lanes of so many tokens

_BLOCKS = pa.schema(
    [("block", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())), ("lengths", pa.list_(pa.int64())), ("tokens", pa.binary()), ("words", pa.binary())]
    + [("n_words", pa.int64()), ("n_tokens", pa.int64()), ("train_tokens", pa.int64()), ("train_docs", pa.int64())]
)
_BLOCKS_DDL = (
    "block bigint, doc_ids array<bigint>, held array<boolean>, lengths array<bigint>, tokens binary, words binary, "
    "n_words bigint, n_tokens bigint, train_tokens bigint, train_docs bigint"
)


def packed(numbers: np.ndarray) -> bytes:
    """Numbers from 0 on as byte planes, as many as the largest needs, compressed."""
    width = max(1, (int(numbers.max()).bit_length() + 7) // 8) if len(numbers) else 1
    planes = np.ascontiguousarray(numbers.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T)
    return bytes([width]) + len(numbers).to_bytes(8, "little") + pa.compress(planes.tobytes(), "zstd", asbytes=True)


def unpacked(data: bytes) -> np.ndarray:
    width, n = data[0], int.from_bytes(data[1:9], "little")
    out = np.zeros((n, 8), np.uint8)
    if n:
        out[:, :width] = np.frombuffer(pa.decompress(data[9:], n * width, "zstd", asbytes=True), np.uint8).reshape(width, n).T
    return out.reshape(-1).view("<u8")


def ascending(keys: np.ndarray) -> bytes:
    return packed(np.diff(keys, prepend=np.uint64(0)))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, held, text) as blocks, in their order."""

    def start() -> None:
        nonlocal words, doc_ids, held, lengths, tokens, size
        words = defaultdict(count().__next__)
        doc_ids, held, lengths, tokens, size = [], [], [], [], 0

    def block() -> pa.RecordBatch:
        train = [n + 1 for n, h in zip(lengths, held, strict=True) if not h]
        row = [
            (TaskContext.get().partitionId() << 32) + next(number), doc_ids, held, lengths, packed(np.concatenate(tokens)), b"\n".join(words),
            len(words), sum(lengths) + len(lengths), sum(train), len(train),
        ]
        return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, _BLOCKS, strict=True)], schema=_BLOCKS)

    number = count()
    words, doc_ids, held, lengths, tokens, size = defaultdict(), [], [], [], [], 0
    start()
    for batch in C.text_batches(batches):
        for doc_id, is_held, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            found = text.as_py().lower().split()
            doc_ids.append(doc_id)
            held.append(is_held)
            lengths.append(len(found))
            tokens.append(np.fromiter(map(words.__getitem__, found), np.uint32, len(found)))
            size += len(text.as_buffer())
            if size >= BLOCK_BYTES:
                yield block()
                start()
    if doc_ids:
        yield block()


class Block:
    """A block's texts as one row of ids: per document a start, its words and an end."""

    def __init__(self, row: dict) -> None:
        self.words = row["words"].split(b"\n") if row["n_words"] else []
        n = row["n_words"]
        self.end, self.start = n, n + 1
        self.lengths = np.array(row["lengths"], np.int64)
        self.held = np.array(row["held"], bool)
        self.doc_ids = row["doc_ids"]
        sizes = self.lengths + 2
        self.at = np.cumsum(sizes) - sizes  # where each document's start stands
        self.ids = np.full(int(sizes.sum()), self.end, np.int64)
        self.ids[self.at] = self.start
        inside = np.ones(len(self.ids), bool)
        inside[self.at] = inside[self.at + sizes - 1] = False
        self.ids[inside] = unpacked(row["tokens"])
        self.train = np.repeat(~self.held, sizes)
        self.behind = np.arange(len(self.ids)) - np.repeat(self.at, sizes)  # tokens before this one in its text, the start included

    def word_counts(self) -> np.ndarray:
        return np.bincount(self.ids[self.train], minlength=len(self.words) + 2)[: len(self.words)]

    def word_hashes(self) -> np.ndarray:
        return np.fromiter(map(xxhash.xxh64_intdigest, self.words), np.uint64, len(self.words))

    def ngrams(self, order: int, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For n = 2 … order: the positions that end an n-gram, and its key of so many bits."""
        own = np.append(self.word_hashes(), np.array([0xE1, 0x57], np.uint64))[self.ids]
        keys = own
        for n in range(2, order + 1):
            keys = _mixed(np.concatenate([np.zeros(1, np.uint64), keys[:-1]]) * np.uint64(0x9E3779B97F4A7C15) + own)
            where = np.flatnonzero(self.behind >= n - 1)
            yield where, keys[where] >> np.uint64(64 - bits)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_REQUEST = pa.schema([("slice", pa.int64()), ("block", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])
_REQUEST_DDL = "slice bigint, block bigint, keys binary, counts binary"
_ANSWER = pa.schema([("block", pa.int64()), ("slice", pa.int64()), ("counts", pa.binary()), ("seen", pa.int64())])
_ANSWER_DDL = "block bigint, slice bigint, counts binary, seen bigint"


def _requests(rows: list[tuple[int, int, bytes, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), _REQUEST, strict=True)], schema=_REQUEST)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def _slices_of(keys: np.ndarray, slices: int, bits: int = 64) -> np.ndarray:
    """Slices are equal ranges of the key space; their number is a power of two."""
    return (keys >> np.uint64(bits - (slices.bit_length() - 1))).astype(np.int64) if slices > 1 else np.zeros(len(keys), np.int64)


def _word_requests(slices: int):
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            block = Block(row)
            place, counts = _slices_of(block.word_hashes(), slices), block.word_counts()
            out = []
            for s in np.unique(place):
                mine = np.flatnonzero(place == s)
                out.append((int(s), row["block"], b"\n".join(block.words[i] for i in mine), packed(counts[mine])))
            if out:
                yield _requests(out)

    return ask


def _answered(table: pa.Table, totals: list[np.ndarray], distinct: int) -> pa.Table:
    n = table.num_rows
    columns = [table.column("block").combine_chunks(), table.column("slice").combine_chunks(), pa.array([packed(t) for t in totals], pa.binary()), pa.array([distinct] + [0] * (n - 1), pa.int64())]
    return pa.Table.from_arrays(columns, schema=_ANSWER)


def _add_words(table: pa.Table) -> pa.Table:
    """The corpus count of each word that blocks ask for, per block in its order; once per slice, how many have a count."""
    totals: dict[bytes, int] = {}
    asked = []
    for keys, counts in zip(table.column("keys"), table.column("counts")):
        words = keys.as_py().split(b"\n")
        asked.append(words)
        for word, n in zip(words, unpacked(counts.as_py()).tolist(), strict=True):
            totals[word] = totals.get(word, 0) + n
    answers = [np.fromiter(map(totals.__getitem__, words), np.uint64, len(words)) for words in asked]
    return _answered(table, answers, sum(1 for n in totals.values() if n))


def _ngram_requests(slices: int, order: int, bits: int):
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            block = Block(row)
            for n, (where, keys) in enumerate(block.ngrams(order, bits), 2):
                distinct, inverse = np.unique(keys, return_inverse=True)
                counts = np.bincount(inverse[block.train[where]], minlength=len(distinct))
                place = _slices_of(distinct, slices, bits)
                bounds = np.flatnonzero(np.diff(place, prepend=-1))
                out = []
                for a, b in zip(bounds, np.append(bounds[1:], len(distinct)), strict=True):
                    out.append((n * slices + int(place[a]), row["block"], ascending(distinct[a:b]), packed(counts[a:b])))
                if out:
                    yield _requests(out)

    return ask


def _add_ngrams(table: pa.Table) -> pa.Table:
    keys = [np.cumsum(unpacked(k.as_py()), dtype=np.uint64) for k in table.column("keys")]
    counts = np.concatenate([unpacked(c.as_py()) for c in table.column("counts")])
    ends = np.cumsum([len(k) for k in keys])
    keys = np.concatenate(keys)
    order = np.argsort(keys, kind="stable")
    new = np.diff(keys[order], prepend=keys[order[0]] + np.uint64(1)) != 0
    sums = np.add.reduceat(counts[order], np.flatnonzero(new))
    totals = np.empty(len(keys), np.uint64)
    totals[order] = sums[np.cumsum(new) - 1]
    return _answered(table, np.split(totals, ends[:-1]), len(sums))


class Automaton:
    """The states and arcs that one block's texts can reach.

    An n-gram of the block is a number; n-gram ``a`` of order n is the state after it (below the highest order) and the arc by its last word from the state
    of its first n - 1 words. ``arc[n][position]`` is the n-gram that ends at a position, or -1.
    """

    def __init__(self, block: Block, counts: dict[int, np.ndarray], base: np.ndarray, order: int, mass: dict[int, float], bits: int) -> None:
        """``counts`` by order, aligned with words (then end, start) or with the sorted keys; ``base``: p of each word without history."""
        self.block, self.order = block, order
        self.arc, self.seen = {1: block.ids}, {1: counts[1] > 0}
        self.weight, self.failure = {1: np.log10(base)}, {}
        probability = base
        for n, (where, keys) in enumerate(block.ngrams(order, bits), 2):
            _, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
            own = np.full(len(block.ids), -1, np.int32)
            own[where] = inverse
            first = where[first]
            history, shorter = self.arc[n - 1][first - 1], self.arc[n - 1][first]
            probability = (counts[n] + mass[n] * probability[shorter]) / (counts[n - 1][history] + mass[n])
            self.arc[n], self.seen[n], self.weight[n] = own, counts[n] > 0, np.log10(probability)
            self.failure[n - 1] = np.log10(mass[n] / (counts[n - 1] + mass[n]))

    def _step(self, at: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Reads the tokens at positions ``at`` in states of ``level`` words: weights, and the levels of the next states."""
        weight, after, open_ = np.zeros(len(at)), np.zeros(len(at), np.int64), np.ones(len(at), bool)
        level = level.copy()
        for n in range(self.order, 0, -1):
            here = np.flatnonzero(open_ & (level == n - 1))
            if not len(here):
                continue
            position = at[here]
            arc = self.arc[n][position]
            seen = self.seen[n][arc]
            if n == 1:  # the root reads every word
                weight[here] += self.weight[1][arc]
                after[here] = np.where(seen, min(1, self.order - 1), 0)
                continue
            taken = here[seen]
            weight[taken] += self.weight[n][arc[seen]]
            after[taken] = min(n, self.order - 1)
            open_[taken] = False
            failed = here[~seen]
            weight[failed] += self.failure[n - 1][self.arc[n - 1][position[~seen] - 1]]
            level[failed] = n - 2
        return weight, after

    def scores(self) -> np.ndarray:
        """Per document the sum of its weights. Lanes of all documents advance together.

        A lane that begins inside a text first reads the ``order - 1`` tokens before it from the root: no state is longer.
        """
        lengths, at = self.block.lengths + 1, self.block.at + 1
        lanes = -(-lengths // LANE)
        document = np.repeat(np.arange(len(lengths)), lanes)
        number = np.arange(len(document)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        begin = at[document] + number * LANE
        size = np.minimum(LANE, lengths[document] - number * LANE)
        level = np.where(number == 0, min(1, self.order - 1), 0)
        level[(number == 0) & ~self.seen[1][self.block.start]] = 0
        inner = np.flatnonzero(number > 0)
        for back in range(self.order - 1, 0, -1):
            _, level[inner] = self._step(begin[inner] - back, level[inner])
        total = np.zeros(len(document))
        longest_first = np.argsort(-size, kind="stable")
        active = np.searchsorted(-size[longest_first], -np.arange(1, LANE + 1), side="right")
        for step in range(int(size.max(initial=0))):
            lane = longest_first[: active[step]]
            weight, level[lane] = self._step(begin[lane] + step, level[lane])
            total[lane] += weight
        return np.bincount(document, total, len(lengths))


_SCORED_DDL = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
_SCORED = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def _score(tokens: int, types: int, train_docs: int, word_slices: int, order: int, mass: dict[int, float], bits: int):
    def score(blocks: pa.Table, answers: pa.Table) -> pa.Table:
        if not blocks.num_rows:
            return _SCORED.empty_table()
        block = Block(blocks.to_pylist()[0])
        by_order: dict[int, dict[int, np.ndarray]] = {n: {} for n in range(1, order + 1)}
        for n, s, counts in zip(*(answers.column(c).to_pylist() for c in ("order", "slice", "counts")), strict=True):
            by_order[n][s] = unpacked(counts)
        place = _slices_of(block.word_hashes(), word_slices)
        words = np.zeros(len(block.words) + 2, np.float64)
        for s, own in by_order[1].items():
            words[np.flatnonzero(place == s)] = own
        words[block.end] = words[block.start] = train_docs
        counts = {1: words} | {n: np.concatenate([by_order[n][s] for s in sorted(by_order[n])]).astype(np.float64) for n in range(2, order + 1) if by_order[n]}
        counts |= {n: np.zeros(0) for n in range(2, order + 1) if n not in counts}
        base = (words + 0.5) / (tokens + 0.5 * (types + 1))
        automaton = Automaton(block, counts, base, order, mass, bits)
        document = np.repeat(np.arange(len(block.lengths)), block.lengths + 2)
        read = block.ids != block.start
        sums = lambda values: np.bincount(document[read], values[block.ids[read]], len(block.lengths))
        columns = [
            block.doc_ids, block.held, block.lengths + 1, sums((words > 0).astype(float)).astype(np.int64),
            np.full(len(block.lengths), tokens), sums(np.log10(base)), automaton.scores(),
        ]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SCORED, strict=True)], schema=_SCORED)

    return score


def _power_of_two(n: int) -> int:
    return 1 << max(0, n - 1).bit_length()


def scored(docs: DataFrame, order: int = ORDER, mass: dict[int, float] = MASS, slice_tokens: int = SLICE) -> DataFrame:
    """Every document with the model's and the base's log10 probability. ``order`` may be 1 or more."""
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 1, F.lit(False))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), held.alias("held"), C.binary_text().alias("text"))
    blocks = C.staged(rows.mapInArrow(_blocks, _BLOCKS_DDL))
    sums = blocks.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_words", "n_tokens", "train_tokens", "train_docs")]).first()

    word_slices = _power_of_two(-(-sums["n_words"] // (slice_tokens // 3)))
    asked = blocks.mapInArrow(_word_requests(word_slices), _REQUEST_DDL)
    words = C.staged(asked.groupBy("slice").applyInArrow(_add_words, _ANSWER_DDL))
    types = words.agg(F.coalesce(F.sum("seen"), F.lit(0))).first()[0] + (sums["train_docs"] > 0)
    bits = min(64, sums["n_tokens"].bit_length() + SPARE_BITS)
    answers = words.select("block", F.lit(1).alias("order"), "slice", "counts")
    if order > 1:
        slices = _power_of_two(-(-sums["n_tokens"] // slice_tokens))
        asked = blocks.mapInArrow(_ngram_requests(slices, order, bits), _REQUEST_DDL)
        ngrams = asked.groupBy("slice").applyInArrow(_add_ngrams, _ANSWER_DDL)
        answers = answers.unionByName(ngrams.select("block", F.floor(F.col("slice") / slices).cast("int").alias("order"), "slice", "counts"))
    score = _score(sums["train_tokens"], types, sums["train_docs"], word_slices, order, mass, bits)
    texts = blocks.select("block", "doc_ids", "held", "lengths", "tokens", "words", "n_words")
    texts = texts.select(*[F.col(c).alias(c) for c in texts.columns])
    return texts.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(score, _SCORED_DDL)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(C.documents(spark, sf_dir))
