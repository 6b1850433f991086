"""Token files: ids coded by a static range asymmetric numeral system (rANS).

Documents are sorted by doc_id over range partitions, tokenised, and cut into independent blocks of
at most ``BLOCK`` ids; a document may run over several blocks. One frequency table, counted over all
documents, serves every block. A block interleaves ``LANES`` coders: id i belongs to lane i mod LANES.
Its bytes are

    header       magic, ids, lanes, steps between checkpoints, words, CRC-32 of table, ids and words
    checkpoints  for every ``CHECKPOINT`` steps: the position in the words, and the state of each lane
    words        32-bit words

so blocks, and stretches between checkpoints, decode in parallel, and damage is noticed. The files are a
Parquet table of blocks with the documents that lie in them, and a table with the frequencies.
"""

from __future__ import annotations

import hashlib
import re
import string
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from maskwright.llm import common as C

BLOCK, LANES, CHECKPOINT = 1 << 18, 1024, 128
BITS = 20  # frequencies add up to 2^20
LOW = 1 << 31  # states lie in [2^31, 2^63)
MAGIC = b"rANS"
HEADER = struct.Struct("<4s7I")
WORDS, PARTS_KEPT = 1_500_000, 1_000_000  # what a worker remembers; a memory that is full is emptied

# The parts of the tokenizer file's split pattern, with white space as a Unicode property.
PARTS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+"


class Table:
    """Frequencies scaled to 2^BITS; every id that occurs has at least one share."""

    def __init__(self, counts: np.ndarray) -> None:
        counts = counts.astype(np.float64)
        total, seen = 1 << BITS, counts > 0
        if seen.sum() > total:
            raise ValueError("more ids than shares")
        share = np.where(seen, np.maximum(1, np.floor(counts / max(1.0, counts.sum()) * total)), 0).astype(np.int64)
        # What rounding left over or overdrew is settled with the most frequent ids.
        for i in np.argsort(-share, kind="stable"):
            spare = total - share.sum()
            if not spare or not seen.any():
                break
            share[i] = max(1, share[i] + spare)
        self.frequency = share.astype(np.uint64)
        self.start = (np.cumsum(share) - share).astype(np.uint64)
        self.slots = np.repeat(np.arange(len(share)), share)
        self.crc = zlib.crc32(share.astype("<u4").tobytes())


def encode_block(ids: np.ndarray, table: Table, lanes: int = LANES, every: int = CHECKPOINT) -> bytes:
    n = len(ids)
    lanes = max(1, min(lanes, n))
    steps = -(-n // lanes)
    state = np.full(lanes, LOW, np.uint64)
    words: list[np.ndarray] = []
    saved: list[tuple[int, bytes]] = []
    written, bits, word = 0, np.uint64(BITS), np.uint64(32)
    frequency, start = table.frequency[ids], table.start[ids]
    limit = frequency << np.uint64(63 - BITS)
    for step in range(steps - 1, -1, -1):
        a, b = step * lanes, min(n, (step + 1) * lanes)
        x, f = state[: b - a], frequency[a:b]
        full = x >= limit[a:b]
        out = x[full]
        words.append(out.astype(np.uint32))
        written += len(out)
        x = np.where(full, x >> word, x)
        q = x // f
        state[: b - a] = (q << bits) + (x - q * f) + start[a:b]
        if step % every == 0:
            saved.append((written, state.astype("<u8").tobytes()))
    payload = np.concatenate(words[::-1]).astype("<u4").tobytes() if words else b""
    marks = b"".join(struct.pack("<I", written - at) + states for at, states in reversed(saved))
    crc = zlib.crc32(ids.astype("<u4").tobytes())
    return HEADER.pack(MAGIC, n, lanes, every, written, table.crc, crc, zlib.crc32(marks + payload)) + marks + payload


def decode_block(data: bytes, table: Table, first: int = 0, count: int | None = None) -> np.ndarray:
    """The ids of a block, or of ``count`` stretches between checkpoints from number ``first`` on."""
    magic, n, lanes, every, written, of_table, crc, of_body = HEADER.unpack_from(data)
    body = memoryview(data)[HEADER.size :]
    if magic != MAGIC or of_table != table.crc or zlib.crc32(body) != of_body:
        raise ValueError("damaged block, or another frequency table")
    steps = -(-n // lanes)
    marks = -(-steps // every)
    size = 4 + 8 * lanes
    words = np.frombuffer(body, "<u4", written, marks * size).astype(np.uint64)
    last = marks if count is None else min(marks, first + count)
    if first >= last:
        return np.empty(0, np.int64)
    (at,) = struct.unpack_from("<I", body, first * size)
    state = np.frombuffer(body, "<u8", lanes, first * size + 4).copy()
    begin, end = first * every, min(steps, last * every)
    out = np.empty(min(n, end * lanes) - begin * lanes, np.int64)
    bits, mask, word = np.uint64(BITS), np.uint64((1 << BITS) - 1), np.uint64(32)
    slots, frequency, start = table.slots, table.frequency, table.start
    for step in range(begin, end):
        a, b = step * lanes, min(n, (step + 1) * lanes)
        x = state[: b - a]
        low = x & mask
        ids = slots[low]
        out[a - begin * lanes : b - begin * lanes] = ids
        x = frequency[ids] * (x >> bits) + low - start[ids]
        short = np.flatnonzero(x < LOW)
        x[short] = (x[short] << word) | words[at : at + len(short)]
        at += len(short)
        state[: b - a] = x
    if first == 0 and last == marks and (zlib.crc32(out.astype("<u4").tobytes()) != crc or (state != LOW).any()):
        raise ValueError("damaged block")
    return out


# Words of letters below U+0250, about which all versions of Unicode agree, but for the dotted capital I; they are composed already.
PLAIN = re.compile("[\0-\u012f\u0131-\u024f]*").fullmatch


class WordTokenizer:
    """The tokenizers library's ids of whole texts, word by word.

    The tokenizer cuts the raw text at the strings of its added tokens, which get their ids; they hold no
    white space. Of the rest it drops white space and merges inside parts that its pattern finds in the
    composed, lower-cased text. So a text's ids are those of its words, one after another. Words with characters from
    U+0250 on go to the library as they are, parts of the rest together; each part's last id is one that ends a word.
    """

    def __init__(self, definition: str) -> None:
        self.library = Tokenizer.from_str(definition)
        added = self.library.get_added_tokens_decoder()
        if any(t.normalized or t.single_word or t.lstrip or t.rstrip or len(t.content.split()) != 1 for t in added.values()):
            raise ValueError("an added token is not a plain string without white space")
        self.added = {t.content: struct.pack("<I", i) for i, t in added.items()}
        longest_first = sorted(map(re.escape, self.added), key=len, reverse=True)
        self.cut = re.compile(f"({'|'.join(longest_first)})").split if added else lambda word: [word]
        first_signs = "".join(sorted({re.escape(t[0]) for t in self.added}))
        self.may_hold_added = re.compile(f"[{first_signs}]").search if added else lambda word: None
        vocabulary = self.library.get_vocab()
        self.size = max(vocabulary.values()) + 1
        self.ends = np.zeros(self.size, bool)
        self.ends[[i for piece, i in vocabulary.items() if piece.endswith("</w>")]] = True
        self.split = regex.compile(PARTS).findall
        self.words: dict[bytes, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def _learn(self, words: set[bytes]) -> None:
        split, other, simple = {}, {}, list(words)
        joined = b" ".join(simple).decode()
        if not PLAIN(joined) or self.may_hold_added(joined):
            simple = []
            for word, text in zip(words, joined.split(" "), strict=True):
                if not PLAIN(text):  # here the library's Unicode tables decide, not Python's: such words go to it as they are
                    other[word] = text
                elif self.may_hold_added(text):
                    split[word] = self._split(text)
                else:
                    simple.append(word)
            joined = b" ".join(simple).decode()
        single = {}  # a word of letters is one part, signs after it another
        for word, text in zip(simple, joined.lower().split(" ") if simple else (), strict=True):
            if text.isalpha():
                single[word] = text
            elif (letters := text.rstrip(string.punctuation)).isalpha():
                split[word] = [letters, text[len(letters) :]]
            else:
                split[word] = self.split(text)
        if other:
            lengths = np.array([len(t) + 1 for t in other.values()])
            found = self.library.encode(" ".join(other.values()), add_special_tokens=False)
            ids = np.array(found.ids, "<u4")
            of = np.searchsorted(np.cumsum(lengths) - lengths, np.array([at for at, _ in found.offsets], np.int64), "right")
            ends = np.searchsorted(of, np.arange(1, len(other) + 1), "right")
            for word, own in zip(other, np.split(ids, ends[:-1]), strict=True):
                self.words[word] = own.tobytes()
        parts = {p for own in split.values() for p in own if p not in self.added}
        new = list(parts.union(single.values()).difference(self.parts))
        if new:
            ids = np.array(self.library.encode_batch_fast([" ".join(new)], add_special_tokens=False)[0].ids, "<u4")  # no offsets
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) == len(new):
                data, at = ids.tobytes(), 0
                for part, cut in zip(new, (cuts * 4).tolist(), strict=True):
                    self.parts[part] = data[at:cut]
                    at = cut
            else:  # an id in the middle of a part looks like an end
                for part, found in zip(new, self.library.encode_batch(new, add_special_tokens=False), strict=True):
                    self.parts[part] = np.array(found.ids, "<u4").tobytes()
        parts, added = self.parts, self.added
        self.words.update(zip(single, map(parts.__getitem__, single.values())))
        for word, own in split.items():
            self.words[word] = b"".join([added.get(p) or parts[p] for p in own])

    def _split(self, word: str) -> list[str]:
        """Of a plain word: added tokens as they are, and the parts of what lies between them; no part equals an added token."""
        out: list[str] = []
        for i, piece in enumerate(self.cut(word)):
            out += [piece] if i % 2 else self.split(piece.lower())
        return out

    def encode(self, texts: list[bytes], end: int) -> list[bytes]:
        """Ids as little-endian 32-bit integers, each text's with ``end`` appended."""
        split = [t.split() for t in texts]
        if len(self.words) > WORDS:
            self.words.clear()
        if len(self.parts) > PARTS_KEPT:
            self.parts.clear()
        missing = set().union(*split).difference(self.words)
        if missing:
            self._learn(missing)
        find, last = self.words.__getitem__, struct.pack("<I", end)
        return [b"".join(map(find, words)) + last for words in split]


_tokenizers: dict[str, WordTokenizer] = {}


def tokenizer(definition: str) -> WordTokenizer:
    name = hashlib.sha256(definition.encode()).hexdigest()
    if name not in _tokenizers:
        _tokenizers[name] = WordTokenizer(definition)
    return _tokenizers[name]


_BLOCKS = "part int, block int, n bigint, doc_ids array<bigint>, lengths array<bigint>, before array<bigint>, ids binary"


def raw_blocks(docs: DataFrame, vocabulary: str, end: int) -> DataFrame:
    """Blocks of ids in ascending doc_id order, with the piece of each document that lies in them.

    ``before`` counts a document's ids in earlier blocks.
    """
    with open(vocabulary, encoding="utf-8") as file:
        definition = docs.sparkSession.sparkContext.broadcast(file.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part, block = tokenizer(definition.value), TaskContext.get().partitionId(), 0
        kind = "<u2" if own.size <= 1 << 16 else "<u4"
        ids: list[np.ndarray] = []
        pieces: list[tuple[int | None, int, int]] = []

        def closed() -> pa.RecordBatch:
            cells = [[part], [block], [sum(p[1] for p in pieces)], *[[[p[i] for p in pieces]] for i in range(3)], [np.concatenate(ids).astype(kind).tobytes()]]
            types = [pa.int32(), pa.int32(), pa.int64(), *[pa.list_(pa.int64())] * 3, pa.binary()]
            names = ["part", "block", "n", "doc_ids", "lengths", "before", "ids"]
            return pa.record_batch([pa.array(c, t) for c, t in zip(cells, types, strict=True)], names)

        free = BLOCK
        for batch in C.text_batches(batches):
            encoded = own.encode(batch.column(1).to_pylist(), end)
            for doc, data in zip(batch.column(0).to_pylist(), encoded, strict=True):
                row, done = np.frombuffer(data, "<u4"), 0
                while done < len(row):
                    take = min(free, len(row) - done)
                    ids.append(row[done : done + take])
                    pieces.append((doc, take, done))
                    done, free = done + take, free - take
                    if not free:
                        yield closed()
                        ids, pieces, free, block = [], [], BLOCK, block + 1
        if pieces:
            yield closed()

    ordered = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), C.binary_text().alias("text")).repartitionByRange("doc_id")
    return ordered.sortWithinPartitions("doc_id", "text").mapInArrow(run, _BLOCKS)


def _width(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, "<u2" if len(data) == 2 * n else "<u4")


def frequencies(blocks: DataFrame) -> DataFrame:
    """(id, n): how often each id occurs; at most one row per entry of the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for n, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                more = np.bincount(_width(data, n), minlength=len(total))
                more[: len(total)] += total
                total = more
        seen = np.flatnonzero(total)
        yield pa.record_batch([pa.array(seen), pa.array(total[seen])], ["id", "n"])

    return blocks.select("n", "ids").mapInArrow(run, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n"))


def write_files(docs: DataFrame, path: str, vocabulary: str, end: int) -> None:
    """Writes ``path``/blocks and ``path``/table. A null text has only the end id; rows with no doc_id come first."""
    spark = docs.sparkSession
    raw_blocks(docs, vocabulary, end).write.option("compression", "zstd").parquet(f"{path}/raw")
    raw = spark.read.schema(_BLOCKS).parquet(f"{path}/raw")
    frequencies(raw).repartition(1).write.parquet(f"{path}/table")
    table = spark.sparkContext.broadcast(_read_table(spark, path))
    names = ["part", "block", "n", "doc_ids", "lengths", "before"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Table(table.value)
        for batch in C.text_batches(batches):
            ids = zip(batch.column(2).to_pylist(), batch.column(6).to_pylist(), strict=True)
            data = [encode_block(_width(raw_ids, n), own) for n, raw_ids in ids]
            yield pa.record_batch([*batch.columns[:6], pa.array(data, pa.binary())], [*names, "data"])

    raw.mapInArrow(run, _BLOCKS.replace("ids binary", "data binary")).write.option("compression", "none").parquet(f"{path}/blocks")


def _read_table(spark: SparkSession, path: str) -> np.ndarray:
    """Counts by id; the vocabulary bounds their number."""
    rows = spark.read.schema("id bigint, n bigint").parquet(f"{path}/table").toPandas()
    counts = np.zeros(int(rows["id"].max()) + 1 if len(rows) else 1, np.int64)
    counts[rows["id"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    return counts


def combined_crc(first: int, second: int, length: int) -> int:
    """The CRC-32 of two stretches of bytes from theirs; ``length`` is the second's."""
    # The operator that appends one zero bit, squared for each bit of the length.
    operator = [0xEDB88320, *[1 << i for i in range(31)]]
    bits = length * 8
    while bits:
        if bits & 1:
            first = _times(operator, first)
        operator = [_times(operator, column) for column in operator]
        bits >>= 1
    return first ^ second


def _times(matrix: list[int], vector: int) -> int:
    out = 0
    for column in matrix:
        if vector & 1:
            out ^= column
        vector >>= 1
    return out


def _joined_crcs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        crcs = []
        for pieces in batch.column(3).to_pylist():
            crc = pieces[0]["crc"]
            for piece in pieces[1:]:
                crc = combined_crc(crc, piece["crc"], 4 * piece["n"])
            crcs.append(crc)
        yield pa.record_batch([*batch.columns[:3], pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files, each block decoded on its own."""
    table = spark.sparkContext.broadcast(_read_table(spark, path))
    blocks = spark.read.schema(_BLOCKS.replace("ids binary", "data binary")).parquet(f"{path}/blocks")
    narrow = blocks.select("part", "block", "n").withColumn("file", F.lit(0))
    starts = C.running_totals(narrow, "file", "part", ["block"], "n", "start").select("part", "block", "start")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Table(table.value)
        for batch in C.text_batches(batches):
            part, block = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            docs, lengths, before, data = (batch.column(i).to_pylist() for i in range(2, 6))
            for i in range(batch.num_rows):
                ids = decode_block(data[i], own).astype("<u4").tobytes()
                edges = np.cumsum([0, *lengths[i]])
                crc = [zlib.crc32(ids[4 * a : 4 * b]) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
                n = len(crc)
                yield pa.record_batch(
                    [pa.array([part[i]] * n, pa.int32()), pa.array([block[i]] * n, pa.int32()), pa.array(docs[i], pa.int64()),
                     pa.array(edges[:-1]), pa.array(lengths[i], pa.int64()), pa.array(before[i], pa.int64()), pa.array(crc, pa.int64())],
                    ["part", "block", "doc_id", "at", "n", "before", "crc"],
                )

    decoded = blocks.select("part", "block", "doc_ids", "lengths", "before", "data").mapInArrow(
        run, "part int, block int, doc_id bigint, at bigint, n bigint, before bigint, crc bigint"
    )
    pieces = decoded.join(starts, ["part", "block"]).withColumn("start", F.col("start") + F.col("at") - F.col("before"))
    docs = pieces.groupBy("doc_id", "start").agg(
        F.sum("n").alias("n_tokens"), F.sort_array(F.collect_list(F.struct("before", "n", "crc"))).alias("pieces")
    )
    return docs.mapInArrow(_joined_crcs, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: writes the ids of every whole text and reads the files back."""
    import public_tokenizers

    path = f"{C.shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    write_files(C.documents(spark, sf_dir), path, public_tokenizers.path("word_bpe_49k.json"), end=2)
    return read_files(spark, path)
