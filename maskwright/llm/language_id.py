"""Language identification by mixture inference over character trigrams.

Each language is a smoothed distribution over hashed letter trigrams, counted on all documents with a
label. A text's trigrams are taken to come from a mixture of languages. Expectation-maximisation
estimates the proportions, first over all languages, then over the best one, two and so on, for as long as
the next language raises the likelihood less a penalty per language; the largest share of the set so chosen names
the text's language.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.llm import common as C

BUCKETS = 1 << 16  # the model has a number per language and bucket, so its size is known
SMOOTHING = 0.1
ROUNDS = 12
PENALTY = 3.0  # per language, times the logarithm of the number of trigrams
CELLS = 1 << 22  # trigrams times languages handled at once
UNKNOWN = "und"

_letters: np.ndarray | None = None


def _is_letter() -> np.ndarray:
    """Whether each code point is a letter."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _letters


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct (text, bucket) of the letter trigrams of lower-cased texts, their counts, and which texts have a letter.

    A run of other characters stands as one space, and so do the ends of a text.
    """
    lower = [f" {t.lower()} " for t in texts]
    points = np.frombuffer("".join(lower).encode("utf-32-le", "surrogatepass"), "<u4")
    number = np.repeat(np.arange(len(texts)), [len(t) for t in lower])
    letter = _is_letter()[points]
    has = np.bincount(number, letter, len(texts)) > 0
    # Of a run of other characters the first stays; so does the space that leads a text.
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    begins = np.concatenate([[True], number[1:] != number[:-1]])
    keep |= begins
    code = np.where(letter, points, 32).astype(np.uint64)[keep]
    number, letter = number[keep], letter[keep]
    if len(code) < 3:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64), has
    inside = letter[1:-1] & (number[:-2] == number[2:])
    mixed = (code[:-2] * np.uint64(0x9E3779B1) + code[1:-1]) * np.uint64(0x85EBCA77C2B2AE63) + code[2:]
    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    bucket = (mixed >> np.uint64(40)).astype(np.int64) % BUCKETS
    cell, count = np.unique((number[1:-1] * BUCKETS + bucket)[inside], return_counts=True)
    return cell // BUCKETS, cell % BUCKETS, count, has


class Model:
    def __init__(self, languages: list[str], counts: np.ndarray) -> None:
        self.languages = languages
        smooth = counts + SMOOTHING
        self.share = np.ascontiguousarray((smooth / smooth.sum(axis=1, keepdims=True)).T)  # bucket x language


def learn(docs: DataFrame) -> Model:
    """Counts the trigrams of all rows with a ``lang`` and a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in C.text_batches(batches):
            langs = batch.column(0).to_pylist()
            text, bucket, count, _ = trigrams(batch.column(1).to_pylist())
            names = np.array(langs)
            for lang in set(langs):
                mine = (names == lang)[text]
                more = np.bincount(bucket[mine], count[mine], BUCKETS).astype(np.int64)
                totals[lang] = totals.get(lang, 0) + more
        for lang, total in totals.items():
            seen = np.flatnonzero(total)
            yield pa.record_batch([pa.array([lang] * len(seen), pa.string()), pa.array(seen), pa.array(total[seen])], ["lang", "bucket", "n"])

    rows = docs.filter("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text").mapInArrow(run, "lang string, bucket bigint, n bigint")
    found = rows.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(found["lang"].unique())
    counts = np.zeros((len(languages), BUCKETS))
    place = {lang: i for i, lang in enumerate(languages)}
    counts[found["lang"].map(place).to_numpy(np.int64), found["bucket"].to_numpy(np.int64)] = found["n"].to_numpy(np.float64)
    return Model(languages, counts)


def _em(share: np.ndarray, count: np.ndarray, start: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Proportions and log-likelihood of each text. ``share``: trigram x language, ``start``: where a text begins."""
    texts, languages = len(start), share.shape[1]
    part = np.full((texts, languages), 1.0 / languages)
    total = np.add.reduceat(count, start)[:, None]
    for _ in range(ROUNDS if languages > 1 else 0):
        mixed = share * part[of]
        mixed *= (count / mixed.sum(axis=1))[:, None]
        part = np.add.reduceat(mixed, start, axis=0) / total
    return part, np.add.reduceat(count * np.log((share * part[of]).sum(axis=1)), start)


def infer(model: Model, texts: list[str]) -> tuple[list[str], list[float], list[list[str]]]:
    """The language, its share in the text and the selected set of each text."""
    text, bucket, count, _ = trigrams(texts)
    names, n = model.languages, len(texts)
    best, score, chosen = [UNKNOWN] * n, [0.0] * n, [[] for _ in range(n)]
    if not len(text) or not names:
        return best, score, chosen
    ids, starts = np.unique(text, return_index=True)
    ends = np.append(starts[1:], len(text))
    # Texts are taken together as long as their trigrams fit.
    piece = np.cumsum((ends - starts) * len(names)) // CELLS
    for group in np.split(np.arange(len(ids)), np.flatnonzero(np.diff(piece)) + 1):
        a, b = starts[group[0]], ends[group[-1]]
        own, weight = bucket[a:b], count[a:b].astype(np.float64)
        start, of = starts[group] - a, np.repeat(np.arange(len(group)), ends[group] - starts[group])
        part, _ = _em(model.share[own], weight, start, of)
        order = np.argsort(-part, axis=1, kind="stable")
        penalty = PENALTY * np.log(np.add.reduceat(weight, start) + 1)
        value, size, shares = np.full(len(group), -np.inf), np.zeros(len(group), np.int64), np.zeros((len(group), len(names)))
        growing = np.arange(len(group))  # texts whose last language raised the penalised likelihood
        for k in range(1, len(names) + 1):
            mine = np.isin(of, growing)
            there = of[mine]
            first = np.flatnonzero(np.diff(there, prepend=-1))
            within, likelihood = _em(model.share[own[mine][:, None], order[there, :k]], weight[mine], first, np.searchsorted(growing, there))
            gain = likelihood - k * penalty[growing]
            better = gain > value[growing]
            growing, within = growing[better], within[better]
            if not len(growing):
                break
            value[growing], size[growing] = gain[better], k
            shares[growing] = 0
            shares[growing, :k] = within
        top = shares.argmax(axis=1)
        for i, at in enumerate(ids[group].tolist()):
            best[at] = names[order[i, top[i]]]
            score[at] = float(min(1.0, shares[i, top[i]]))
            chosen[at] = [names[j] for j in order[i, : size[i]]]
    return best, score, chosen


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score, languages. Only the text is an input of a prediction.

    ``und`` with score 0 for null texts, texts without a letter, and a model without languages. A row
    without a doc_id is not held out.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.text_batches(batches):
            best, score, chosen = infer(shared.value, [t or "" for t in batch.column(2).to_pylist()])
            columns = [pa.array(best, pa.string()), pa.array(score, pa.float64()), pa.array([",".join(c) for c in chosen], pa.string())]
            yield pa.record_batch([batch.column(0), batch.column(1), *columns], ["doc_id", "held_out", "lang_pred", "score", "languages"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(_fold() == 1, F.lit(False)).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id bigint, held_out boolean, lang_pred string, score double, languages string")


def _fold() -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: learns on two thirds of the documents, predicts all."""
    docs = C.documents(spark, sf_dir, "doc_id", "text", "lang")
    return predict(docs.drop("lang"), learn(docs.filter(_fold() != 1)))
