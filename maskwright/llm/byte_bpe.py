"""Byte-level BPE through a sentencepiece model that is written directly from a rank vocabulary.

Every vocabulary entry becomes a piece whose bytes are mapped to printable characters, scored by its
negative rank; normalisation is the identity. Nothing is trained. Texts are split by the vocabulary's
pattern and each part is encoded on its own; ids are decoded by the inverse mapping.

The vocabulary file is read on the driver and broadcast: its size is fixed and does not follow the data.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.llm import common as C

# A space between two other characters that are no white space. Python's \S leaves out a few more
# characters than the Unicode property, so some such spaces are not found, but never others.
LONE_SPACE = re.compile(r"(?<=\S) (?=\S)")

# Parts, and stretches, that a worker remembers during a task; a memory that is full is emptied.
CACHE = 500_000


def byte_characters() -> list[str]:
    """A printable character for each byte: itself where it is printable and no space, else one from U+0100 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    return [chr(b) if b in printable else chr(256 + rest.index(b)) for b in range(256)]


def read_ranks(lines: bytes) -> list[bytes]:
    """The entries of a rank file in the order of their ranks, which run from 0."""
    ranks = {int(rank): base64.b64decode(entry) for entry, rank in (line.split() for line in lines.splitlines() if line)}
    if sorted(ranks) != list(range(len(ranks))):
        raise ValueError("ranks must run from 0 without gaps")
    return [ranks[i] for i in range(len(ranks))]


def _field(number: int, kind: int, payload: bytes) -> bytes:
    return _varint(number << 3 | kind) + payload


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes(out + bytes([n]))


def _message(number: int, payload: bytes) -> bytes:
    return _field(number, 2, _varint(len(payload)) + payload)


def piece_model(entries: list[bytes]) -> bytes:
    """A serialised sentencepiece model whose piece ids are the ranks; the unknown piece comes last.

    Wire format of sentencepiece_model.proto: pieces (1) with text (1), score (2) and type (3);
    trainer (2) with model type (3), here 2 for BPE; normaliser (3) with name (1) and three switches (3-5).
    """
    shown, out = byte_characters(), bytearray()
    for rank, entry in enumerate(entries):
        text = "".join(shown[b] for b in entry).encode()
        out += _message(1, _message(1, text) + _field(2, 5, struct.pack("<f", -rank)) + _field(3, 0, _varint(1)))
    out += _message(1, _message(1, b"<unk>") + _field(2, 5, struct.pack("<f", 0.0)) + _field(3, 0, _varint(2)))
    # Ids of begin, end and padding: none (-1 as a 64-bit varint).
    none = _varint((1 << 64) - 1)
    out += _message(2, _field(3, 0, _varint(2)) + _field(40, 0, _varint(len(entries))) + b"".join(_field(n, 0, none) for n in (41, 42, 43)))
    out += _message(3, _message(1, b"identity") + b"".join(_field(n, 0, _varint(0)) for n in (3, 4, 5)))
    return bytes(out)


def portable(pattern: str) -> str:
    """The split pattern with white space as the Unicode property, which Python's \\s is not quite."""
    return pattern.replace("[^\\s", "[^\\p{White_Space}").replace("\\s", "\\p{White_Space}").replace("\\S", "\\P{White_Space}")


class _Memory(dict):
    """Remembers the results of a function of one string."""

    def __init__(self, function: Callable[[str], bytes]) -> None:
        self.function = function

    def __missing__(self, key: str) -> bytes:
        value = self[key] = self.function(key)
        return value

    def trim(self) -> None:
        if len(self) > CACHE:
            self.clear()


class Codec:
    """Encodes and decodes texts; remembers the parts and the space-led stretches met so far."""

    def __init__(self, ranks: bytes, pattern: str) -> None:
        self.entries = read_ranks(ranks)
        self.whole = {e: struct.pack("<I", i) for i, e in enumerate(self.entries)}
        self.model = sentencepiece.SentencePieceProcessor(model_proto=piece_model(self.entries))
        self.table = str.maketrans({chr(b): c for b, c in enumerate(byte_characters())})
        self.split = regex.compile(portable(pattern)).findall
        self.parts = _Memory(self._part)
        self.stretches = _Memory(lambda stretch: self._pattern(" " + stretch))

    def _part(self, part: str) -> bytes:
        """A part that is an entry is that entry; the others are merged by the model."""
        found = self.whole.get(part.encode())
        if found is None:
            ids = self.model.encode(part.encode().decode("latin-1").translate(self.table))
            found = struct.pack(f"<{len(ids)}I", *ids)
        return found

    def _pattern(self, text: str) -> bytes:
        return b"".join([self.parts[p] for p in self.split(text)])

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers.

        The pattern binds a lone space to what follows, so a text splits before each into stretches that
        match as they would in the text. Any longer run of white space stays inside its stretch.
        """
        self.parts.trim()
        self.stretches.trim()
        first, *rest = LONE_SPACE.split(text)
        return self._pattern(first) + b"".join(map(self.stretches.__getitem__, rest))

    def decode(self, ids: bytes) -> bytes:
        entries = self.entries
        return b"".join([entries[i] for i in np.frombuffer(ids, "<u4").tolist()])


_codecs: dict[tuple[str, str], Codec] = {}


def codec(ranks: bytes, pattern: str) -> Codec:
    """One codec per vocabulary and worker process."""
    name = (hashlib.sha256(ranks).hexdigest(), pattern)
    if name not in _codecs:
        _codecs[name] = Codec(ranks, pattern)
    return _codecs[name]


def forget() -> None:
    """Empties the memories of this worker's codecs; the vocabularies stay."""
    for own in _codecs.values():
        own.parts.clear()
        own.stretches.clear()


def encode_documents(docs: DataFrame, vocabulary: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 (and ids, an array, on request) of every document.

    Null and empty texts have no ids. Every row of the input gives one, whatever its doc_id.
    """
    with open(vocabulary, "rb") as file:
        ranks = docs.sparkSession.sparkContext.broadcast(file.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks.value, pattern)
        for batch in C.text_batches(batches):
            ids = [own.encode(text or "") for text in batch.column(1).to_pylist()]
            columns = [
                batch.column(0),
                pa.array([len(i) // 4 for i in ids], pa.int64()),
                pa.array([hashlib.sha256(i).hexdigest() for i in ids], pa.string()),
                pa.array([hashlib.sha256(own.decode(i)).hexdigest() for i in ids], pa.string()),
            ]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                flat = np.frombuffer(b"".join(ids), "<u4").astype(np.int32)
                offsets = np.concatenate([[0], np.cumsum([len(i) // 4 for i in ids])])
                columns.append(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat)))
                names.append("ids")
            yield pa.record_batch(columns, names)

    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(C.leaving_nothing(run, forget), schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: every whole text, encoded by the 50k byte vocabulary and decoded again."""
    import public_tokenizers

    return encode_documents(C.documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
