"""Repetition inside a text, by a suffix array over its words.

The suffixes of all texts of a batch are sorted together, by rank doubling: the text's number leads each
rank, so suffixes of different texts never compare as equal. Each doubling sorts only what is still
tied. The longest common prefix (LCP) of neighbours follows from the ranks of each doubling, largest
step first. An LCP interval is a maximal repeat; each of its suffixes starts an occurrence. The deepest
interval of a suffix, the larger of the LCPs on its two sides, covers all its others, so the union of
these spans is the union over all intervals.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from maskwright.llm import common as C

SYMBOLS = re.compile(rb"[#*$%&|<>]")

# Documented limits of the verdict: a repeat counts from REPEAT words on; repeats may cover a fifth
# of the words, and the longest may have LONGEST words. Words that repeats cover lie in repeated windows
# too, so COVERED_PERCENT only has effect below WINDOW_PERCENT.
REPEAT = 8
COVERED_PERCENT = 20
LONGEST = 100
# Base rules: at least this many words, and at most this share of them in repeated windows of three.
MIN_WORDS, WINDOW, WINDOW_PERCENT = 50, 3, 50

_CONTINUATION = bytes(range(0x80, 0xC0))


def suffix_order(words: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array over the texts ``text`` (ascending numbers) of words, and the LCP with the suffix before it.

    Both are in the order of (text, suffix).
    """
    n = len(words)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    last = np.searchsorted(text, text, side="right")  # the end of each word's text
    key = text.astype(np.int64) * (int(words.max()) + 1) + words
    order = np.argsort(key, kind="stable")
    rank = np.empty(n, np.int64)
    first = np.concatenate([[True], key[order][1:] != key[order][:-1]])
    rank[order] = np.flatnonzero(first)[np.cumsum(first) - 1]  # the place of the first suffix of its tie
    levels, step = [rank.copy()], 1
    tied = np.flatnonzero(~(first & np.concatenate([first[1:], [True]])))  # places whose suffix is in a tie
    while len(tied):
        at = order[tied]
        ahead = at + step
        # A suffix that ends is smaller than one that goes on.
        following = np.where(ahead < last[at], rank[np.minimum(ahead, n - 1)] + 1, 0)
        group = rank[at]
        sort = np.lexsort((following, group))
        at, following, group = at[sort], following[sort], group[sort]
        order[tied] = at
        new = np.concatenate([[True], (group[1:] != group[:-1]) | (following[1:] != following[:-1])])
        rank = rank.copy()
        rank[at] = tied[np.flatnonzero(new)[np.cumsum(new) - 1]]
        step *= 2
        levels.append(rank)
        tied = tied[~(new & np.concatenate([new[1:], [True]]))]
    lcp = np.zeros(n, np.int64)
    a, b, size = order[:-1], order[1:], 1 << (len(levels) - 1)
    got = np.zeros(n - 1, np.int64)
    same_text = text[a] == text[b]
    for level in reversed(levels):
        # Ranks of a level compare ``size`` words, of one text, that all exist.
        x, y = a + got, b + got
        fits = same_text & (np.maximum(x, y) + size <= last[a]) if size > 0 else same_text
        x, y = np.minimum(x, n - 1), np.minimum(y, n - 1)
        got += np.where(fits & (level[x] == level[y]), size, 0)
        size //= 2
    lcp[1:] = got
    return order, lcp


def repeated_spans(order: np.ndarray, lcp: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """For each word: whether a repeat of ``least`` words or more covers it; and the longest repeat that starts there."""
    n = len(order)
    deepest = np.zeros(n, np.int64)
    if n:
        deepest[order] = np.maximum(lcp, np.concatenate([lcp[1:], [0]]))
    ends = np.where(deepest >= least, np.arange(n) + deepest, 0)
    return np.maximum.accumulate(ends) > np.arange(n) if n else np.empty(0, bool), deepest


def _base(text: bytes, words: list[bytes]) -> tuple[int, int, int]:
    """word_chars, n_symbols, n_dup_lines."""
    joined = b"".join(words)
    lines = [line for line in text.split(b"\n") if line and not line.isspace()]
    return len(joined.translate(None, _CONTINUATION)), len(SYMBOLS.findall(text)), len(lines) - len(set(lines))


def score_batch(texts: list[bytes], least: int = REPEAT) -> dict[str, np.ndarray]:
    words = [t.split() for t in texts]
    counts = np.array([len(w) for w in words], np.int64)
    number = np.repeat(np.arange(len(texts)), counts)
    ids: dict[bytes, int] = {}
    codes = np.fromiter((ids.setdefault(w, len(ids)) for w in chain.from_iterable(words)), np.int64, int(counts.sum()))
    order, lcp = suffix_order(codes, number)
    covered, deepest = repeated_spans(order, lcp, least)
    window, _ = repeated_spans(order, lcp, WINDOW)
    # A repeat of three words or more makes every window inside it a repeated one.
    base = [_base(t, w) for t, w in zip(texts, words, strict=True)]
    add = lambda x: np.bincount(number, x, len(texts)).astype(np.int64)
    longest = np.zeros(len(texts), np.int64)
    np.maximum.at(longest, number, deepest)
    columns = np.array(base, np.int64).reshape(-1, 3)
    return {
        "n_words": counts, "word_chars": columns[:, 0], "n_symbols": columns[:, 1], "n_dup_lines": columns[:, 2],
        "n_repeat_words": add(window), "covered_words": add(covered), "longest_repeat": longest,
    }


_LONGS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "covered_words", "longest_repeat")


def repetition(docs: DataFrame, covered_percent: int = COVERED_PERCENT, longest: int = LONGEST, least: int = REPEAT) -> DataFrame:
    """One row per row of ``docs``: base counts, covered_words, longest_repeat, base_failed, kept.

    A null text has no words, so it fails the base rules, as does every text of under 50 words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.text_batches(batches):
            got = score_batch(batch.column(1).to_pylist(), least)
            failed = (got["n_words"] < MIN_WORDS) | (100 * got["n_repeat_words"] > WINDOW_PERCENT * got["n_words"])
            kept = ~failed & (100 * got["covered_words"] <= covered_percent * got["n_words"]) & (got["longest_repeat"] <= longest)
            yield pa.record_batch([batch.column(0), *[pa.array(got[k]) for k in _LONGS], pa.array(failed), pa.array(kept)], ["doc_id", *_LONGS, "base_failed", "kept"])

    schema = "doc_id bigint, " + ", ".join(f"{k} bigint" for k in _LONGS) + ", base_failed boolean, kept boolean"
    return docs.select("doc_id", C.binary_text()).mapInArrow(run, schema)


def repeat_spans(text: str, least: int = REPEAT) -> list[tuple[int, int]]:
    """The merged spans (first word, end) of a text that repeats of ``least`` words or more cover."""
    words = text.encode().split()
    ids: dict[bytes, int] = {}
    codes = np.array([ids.setdefault(w, len(ids)) for w in words], np.int64)
    order, lcp = suffix_order(codes, np.zeros(len(words), np.int64))
    covered, _ = repeated_spans(order, lcp, least)
    edges = np.flatnonzero(np.diff(np.concatenate([[False], covered, [False]]).astype(np.int8)))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: base counts and the repetition verdict of every whole text."""
    return repetition(C.documents(spark, sf_dir))
