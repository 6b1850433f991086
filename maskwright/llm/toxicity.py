"""Toxicity by cumulative-link (proportional odds) regression on sparse text features.

Features are words, stripped of punctuation and lower-cased, and their first four to six characters. All
thresholds between ordered grades share one weight per feature: P(grade <= k) = sigmoid(t_k - w.x), and
the expected grade is the severity.

The model is fitted on a bounded sample: the ``SAMPLE`` labelled documents that come first by a hash of
doc_id, and at most ``FEATURES`` features, those that tell toxic from clean documents of the sample
most clearly (chi-square). Every document is scored, on its whole text.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.llm import common as C

SAMPLE = 20_000
FEATURES = 1024
CLEAR = 20.0  # chi-square with which a feature must tell toxic from clean documents
STRONG = 1.5  # and the log odds by which it must differ
STEMS = (4, 5, 6)
THRESHOLD = 0.5
STEPS, RATE, RIDGE = 600, 0.2, 2e-5
CACHE = 500_000

_EDGES = "".join(chr(i) for i in range(33, 128) if not chr(i).isalnum()) + "¡¿«»‘’“”…–—"


def features(word: bytes) -> list[str]:
    """The features of one word of a text."""
    bare = word.decode("utf-8", "replace").lower().strip(_EDGES)
    return [f"={bare}", *[bare[:n] for n in STEMS if len(bare) > n]] if bare else []


class Model:
    """Weights per feature and ordered thresholds; without thresholds every text has severity 0."""

    def __init__(self, names: list[str], weights: np.ndarray, thresholds: np.ndarray) -> None:
        self.names, self.weights, self.thresholds = names, weights, thresholds

    def severity(self, scores: np.ndarray) -> np.ndarray:
        """Expected grade: the sum over thresholds of the probability to lie above."""
        return _sigmoid(scores[:, None] - self.thresholds[None, :]).sum(axis=1)


def fit_ordinal(rows: np.ndarray, columns: np.ndarray, values: np.ndarray, grades: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds by ever smaller gradient steps on the penalised likelihood of sparse rows (row, column, value)."""
    n, top = len(grades), int(grades.max())
    weights = np.zeros(width)
    above = np.array([(grades > k).mean() for k in range(top)]).clip(1e-4, 1 - 1e-4)
    # Thresholds are the first one and the logarithms of the gaps that follow, so they stay in order.
    first = np.log((1 - above) / above)
    free = np.concatenate([first[:1], np.log(np.diff(first).clip(0.1))])
    momentum, square = np.zeros(width + top), np.zeros(width + top)
    for step in range(1, STEPS + 1):
        gaps = np.exp(free[1:])
        cuts = free[0] + np.concatenate([[0.0], np.cumsum(gaps)])
        score = np.bincount(rows, values * weights[columns], n)
        upper, lower = np.append(cuts, np.inf)[grades], np.concatenate([[-np.inf], cuts])[grades]
        high, low = _sigmoid(upper - score), _sigmoid(lower - score)
        chance = (high - low).clip(1e-12)
        d_high, d_low = high * (1 - high) / chance, low * (1 - low) / chance
        by_score = -(d_high - d_low)
        by_cut = np.array([(d_high * (grades == k)).sum() - (d_low * (grades == k + 1)).sum() for k in range(top)])
        tail = np.cumsum(by_cut[::-1])[::-1]  # a gap moves all cuts from its own on
        gradient = np.concatenate([np.bincount(columns, values * by_score[rows], width) / n - RIDGE * weights, tail[:1] / n, tail[1:] * gaps / n])
        momentum = 0.9 * momentum + 0.1 * gradient
        square = 0.999 * square + 0.001 * gradient**2
        change = RATE * (1 - step / (STEPS + 1)) * (momentum / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
        weights, free = weights + change[:width], free + change[width:]
    return weights, free[0] + np.concatenate([[0.0], np.cumsum(np.exp(free[1:]))])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -50, 50)))


def _found(text: bytes) -> Counter:
    out: Counter = Counter()
    for word, n in Counter(text.split()).items():
        for feature in features(word):
            out[feature] += n
    return out


def labelled_sample(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, text, toxic) of the sample. Its bound is what allows the broadcast; several labels of a document: the highest counts."""
    chosen = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    return docs.select("doc_id", C.binary_text().alias("text")).join(F.broadcast(chosen), "doc_id")


def _feature_counts(sample: DataFrame) -> DataFrame:
    """(feature, toxic, clean): in how many documents of the sample each occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: tuple[Counter, Counter] = (Counter(), Counter())
        for batch in C.text_batches(batches):
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts[toxic].update({f for word in set(text.split()) for f in features(word)})
            if len(counts[0]) + len(counts[1]) > CACHE:
                yield _counted(counts)
                counts = (Counter(), Counter())
        yield _counted(counts)

    rows = sample.select("text", "toxic").mapInArrow(C.leaving_nothing(run), "feature string, clean bigint, toxic bigint")
    return rows.groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _counted(counts: tuple[Counter, Counter]) -> pa.RecordBatch:
    names = list(counts[0] | counts[1])
    return pa.record_batch(
        [pa.array(names, pa.string()), *[pa.array([c[n] for n in names], pa.int64()) for c in counts]], ["feature", "clean", "toxic"]
    )


def telling_features(sample: DataFrame, toxic: int, clean: int) -> list[tuple[str, float]]:
    """At most ``FEATURES`` features with their log odds ratios, the clearest first."""
    a, c = F.col("toxic") + 0.5, F.col("clean") + 0.5
    not_a, not_c = F.lit(toxic) - F.col("toxic") + 0.5, F.lit(clean) - F.col("clean") + 0.5
    square = F.pow(a * not_c - c * not_a, 2) * (toxic + clean) / ((a + c) * (not_a + not_c) * (a + not_a) * (c + not_c))
    rows = _feature_counts(sample).select("feature", F.log(a * not_c / (not_a * c)).alias("odds"), square.alias("square"))
    best = rows.filter((F.abs("odds") >= STRONG) & (F.col("square") >= CLEAR)).orderBy(F.desc("square"), "feature").limit(FEATURES)
    return [(r["feature"], r["odds"]) for r in best.collect()]


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fits the model on the sample.

    Labels only say toxic or not, so grades come from the sample: 0 is not toxic, and toxic documents
    are graded 1, or 2 if they hold more telling words of toxic documents than the median of them.
    """
    rows = C.checkpointed(labelled_sample(docs, labels, sample))
    totals = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    nothing = Model([], np.empty(0), np.empty(0))
    if not totals.get(0) or not totals.get(1):
        return nothing
    found = telling_features(rows, totals[1], totals[0])
    if not found:
        return nothing
    place = {name: i for i, (name, _) in enumerate(found)}
    worse = {name for name, odds in found if odds > 0}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.text_batches(batches):
            out: list[list] = [[], [], [], []]
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = Counter(text.split())
                bad = sum(n for word, n in words.items() if not worse.isdisjoint(features(word)))
                hits = sorted((place[f], math.log2(1 + n)) for f, n in _found(text).items() if f in place)
                for column, cell in zip(out, (toxic, bad, [h[0] for h in hits], [h[1] for h in hits]), strict=True):
                    column.append(cell)
            types = [pa.int32(), pa.float64(), pa.list_(pa.int32()), pa.list_(pa.float64())]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(out, types, strict=True)], ["toxic", "bad", "columns", "values"])

    # As many rows as the sample has, each with the features that are left.
    table = rows.select("text", "toxic").mapInArrow(
        C.leaving_nothing(run), "toxic int, bad double, columns array<int>, values array<double>"
    ).toPandas()
    toxic, bad = table["toxic"].to_numpy(np.int64), table["bad"].to_numpy(np.float64)
    grades = toxic * (1 + (bad > np.median(bad[toxic == 1])))
    sizes = table["columns"].map(len).to_numpy(np.int64)
    weights, thresholds = fit_ordinal(
        np.repeat(np.arange(len(table)), sizes), np.concatenate(table["columns"].to_list()).astype(np.int64),
        np.concatenate(table["values"].to_list()).astype(np.float64), grades, len(found),
    )
    return Model([name for name, _ in found], weights, thresholds)


class _Scorer(dict):
    """Scores texts; remembers the model's features in each word met so far."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.place = {name: i for i, name in enumerate(model.names)}

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        value = self[word] = tuple(self.place[f] for f in features(word) if f in self.place)
        return value

    def severity(self, texts: list[bytes]) -> np.ndarray:
        if len(self) > CACHE:
            self.clear()
        scores, weights = np.zeros(len(texts)), self.model.weights
        for i, text in enumerate(texts):
            hits = Counter(f for found in map(self.__getitem__, text.split()) if found for f in found)
            scores[i] = sum(weights[f] * math.log2(1 + n) for f, n in hits.items())
        return self.model.severity(scores)


def scored(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, severity (expected grade), toxic (severity at or over the threshold) and kept (not toxic).

    Null and empty texts have no features: their severity is that of the thresholds alone.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _Scorer(shared.value)
        for batch in C.text_batches(batches):
            severity = scorer.severity(batch.column(1).to_pylist())
            toxic = severity >= threshold
            yield pa.record_batch([batch.column(0), pa.array(severity), pa.array(toxic), pa.array(~toxic)], ["doc_id", "severity", "toxic", "kept"])

    rows = docs.select(F.col("doc_id").cast("bigint"), C.binary_text())
    return rows.mapInArrow(C.leaving_nothing(run), "doc_id bigint, severity double, toxic boolean, kept boolean")


def drop_toxic(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that are not toxic, with their own columns; each row is judged where it lies."""
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _Scorer(shared.value)
        for batch in C.text_batches(batches):
            severity = scorer.severity([(text or "").encode() for text in batch.column(at).to_pylist()])
            yield batch.filter(pa.array(severity < threshold))

    return docs.mapInArrow(C.leaving_nothing(run), docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: the severity of every document, learnt from the labels."""
    docs = C.documents(spark, sf_dir)
    return scored(docs, learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
