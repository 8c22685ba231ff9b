"""Toxicity scores: logistic regression over hashed word n-grams and skip-grams, trained by FTRL-proximal.

Features are single words, pairs of neighbouring words and pairs with one or two words between, each hashed to
one of DIM weights and counted once a text. FTRL-proximal gives each weight its own learning rate and its L1
term keeps weights at zero that too little speaks for, so the model is a short list of weights that every task
can hold.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspan.llm.bpe import Remembered
from shelfspan.llm.common import free_name, held_out, map_rows, small_batches, table

#: Number of weights: the model has at most as many entries, 12 MB.
DIM = 1 << 20
#: Labelled rows that are learned from at most: those with the least hashes of their ids. This bounds a task. On 0.1 GB, 5,000, 10,000 and 15,500 rows find 0.89, 0.94 and 0.97 of the held-out toxic texts.
SAMPLE = 20_000
#: Features of these rows that are learned from at most, 240 MB: rows are taken in order of their ids' hashes until they have so many. This bounds the task's memory whatever the texts' length.
FEATURES = 60_000_000
ALPHA, BETA, L1, L2, EPOCHS = 0.5, 1.0, 4.0, 1.0, 4
THRESHOLD = 0.3

WORD = regex.compile(r"[\p{L}\p{N}]+")


def features(text: str | None, hashed: Remembered) -> np.ndarray:
    """Distinct weight numbers of a text."""
    words = WORD.findall((text or "").lower())
    h = np.fromiter(map(hashed.__getitem__, words), np.uint64, len(words))
    parts = [h]
    for gap in (1, 2, 3):
        parts.append((h[:-gap] * np.uint64(0x9E3779B97F4A7C15) + h[gap:] * np.uint64(0xC2B2AE3D27D4EB4F)) ^ np.uint64(gap))
    # The high bits, since low bits of a product depend on low bits only.
    return np.unique((np.concatenate(parts) * np.uint64(0x9FB21C651E98DF25)) >> np.uint64(64 - (DIM.bit_length() - 1))).astype(np.int64)


def word_hashes() -> Remembered:
    return Remembered(lambda w: xxhash.xxh3_64_intdigest(w))


class Ftrl:
    """FTRL-proximal with a weight for each feature and one for the bias, which L1 leaves alone."""

    def __init__(self, dim: int = DIM):
        self.z, self.n = np.zeros(dim + 1), np.zeros(dim + 1)

    def weights(self, at: np.ndarray) -> np.ndarray:
        z = self.z[at]
        l1 = np.where(at == len(self.z) - 1, 0.0, L1)
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((BETA + np.sqrt(self.n[at])) / ALPHA + L2))

    def learn(self, at: np.ndarray, label: float) -> None:
        w, n = self.weights(at), self.n[at]
        g = sigmoid(w.sum()) - label
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + g * g


def sigmoid(x: float) -> float:
    return 1 / (1 + np.exp(-min(max(x, -30.0), 30.0)))


def training_rows(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str, rows: int = SAMPLE) -> DataFrame:
    """(doc_id, text, label): at most `rows` labelled documents that aren't held out. Of several labels of a document the highest counts, of several texts of an id the least; null labels and ids don't."""
    of = labels.where(F.col(doc_id).isNotNull() & F.col(label).isNotNull() & ~held_out(F.col(doc_id))).groupBy(F.col(doc_id).alias("of")).agg(F.max(label).cast("double").alias("label"))
    of = of.orderBy(F.xxhash64("of"), "of").limit(rows)
    return docs.join(F.broadcast(of), F.col(doc_id) == F.col("of")).select(F.col("of").alias("doc_id"), F.col(text).alias("text"), "label").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("label").alias("label"))


def featurise() -> Callable:
    hashed = word_hashes()

    def f(rows: dict[str, list]) -> dict[str, list]:
        place = [xxhash.xxh3_64_intdigest(n) - (1 << 63) for n in rows["name"]]
        return {"place": place, "name": rows["name"], "label": rows["label"], "at": [features(t, hashed).astype(np.int32) for t in rows["text"]]}

    return f


def fit(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """One batch (feature, weight) from batches with columns label and at, in the order given; rows after the one that brings the features to `most` aren't learned from."""
    rows, held = [], 0
    for b in batches:
        for y, at in zip(b.column("label").to_pylist(), b.column("at"), strict=True):
            if held < most:
                rows.append((np.append(at.values.to_numpy(), np.int32(DIM)), y))
                held += len(rows[-1][0])
    if not rows:
        return
    model = Ftrl()
    for _ in range(EPOCHS):
        for at, y in rows:
            model.learn(at, y)
    at = np.arange(DIM + 1)
    w = model.weights(at)
    used = w != 0
    yield pa.RecordBatch.from_arrays([pa.array(at[used]), pa.array(w[used])], names=["feature", "weight"])


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", most: int = FEATURES) -> tuple[np.ndarray, np.ndarray]:
    """(features, weights) that aren't zero, the bias as feature DIM; both empty if there is nothing to learn from.

    Texts of the sample of at most SAMPLE rows become features in many tasks; one task learns from these, in
    order of hashed ids, and holds at most `most` of them besides the last text's.
    """
    rows = training_rows(docs, labels, doc_id, text, label).select(F.col("doc_id").cast("string").alias("name"), "label", "text")
    ready = map_rows(rows, ["name", "label", "text"], "place long, name string, label double, at array<int>", featurise)
    ordered = ready.repartition(1).sortWithinPartitions("place", "name").select("label", "at")
    model = ordered.mapInArrow(lambda batches: fit(batches, most), "feature long, weight double").toPandas()  # at most DIM + 1 rows
    return model["feature"].to_numpy(np.int64), model["weight"].to_numpy(np.float64)


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], text: str = "text", into: str = "score") -> DataFrame:
    """docs with double column `into`: the probability of a toxic text, 0 to 1. Null and empty texts get the bias's; without a model all get 0.

    All rows and columns stay; a column that has the name `into` is replaced. One pass without a shuffle.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make() -> Callable:
        at, w = sent.value
        weight = np.zeros(DIM + 1)
        weight[at] = w
        hashed = word_hashes()

        def f(rows: dict[str, list]) -> dict[str, list]:
            return {into: [float(sigmoid(weight[features(t, hashed)].sum() + weight[DIM])) if len(at) else 0.0 for t in rows[text]]}

        return f

    return map_rows(docs, [text], f"`{into}` double", make, keep=True)


def reject(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs whose score is below the threshold, as they are. Null and empty texts have the bias's score; repeated rows all go or all stay; with nothing to learn from all stay."""
    into = free_name(docs, "__toxicity")
    return score(docs, train(docs, labels), into=into).where(F.col(into) < threshold).select(*(F.col(f"`{c}`") for c in docs.columns))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
