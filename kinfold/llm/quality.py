"""Quality classifier: hashed word n-gram logistic regression.

Words and word pairs are hashed to a fixed number of slots; weights are trained
with per-coordinate follow-the-regularised-leader updates on a bounded sample of
labelled documents, drawn by id hash; documents are scored as sparse dot products
against the weights, which have a fixed size and are broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.llm.words import grams, mix64, small_batches, text_words

#: Slots of the weight vector: 1 MiB of 32-bit floats.
SLOTS = 1 << 18


@dataclass
class Ftrl:
    """Per-coordinate FTRL-Proximal for the logistic loss."""

    alpha: float = 3.0
    beta: float = 1.0
    l1: float = 0.01
    l2: float = 0.1
    slots: int = SLOTS

    def __post_init__(self):
        self.z = np.zeros(self.slots + 1)  # the last is the bias, not regularised
        self.n = np.zeros(self.slots + 1)

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, root = self.z[at], np.sqrt(self.n[at])
        free = at < self.slots
        shrunk = np.sign(z) * np.maximum(np.abs(z) - self.l1 * free, 0)
        return -shrunk / ((self.beta + root) / self.alpha + self.l2 * free)

    def update(self, at: np.ndarray, values: np.ndarray, label: float, importance: float = 1.0) -> None:
        w = self.weights(at)
        p = 1 / (1 + np.exp(-np.clip(w @ values, -35, 35)))
        g = (p - label) * importance * values
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


def features(batch: pa.RecordBatch, text: str, slots: int = SLOTS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(slot, value, bounds): for every text its slots, the square roots of their counts, to unit length.

    Words enter with A-Z lower-cased.  A pair of the same word twice also counts
    as one pair common to all words, so that repetition shows whatever repeats.
    """
    words, starts = text_words(batch.column(text))
    pairs, owner = grams(words, starts, 2)
    rows = batch.num_rows
    docs = np.repeat(np.arange(rows), np.diff(starts))
    twice = docs[1:][(words[1:] == words[:-1]) & (docs[1:] == docs[:-1])]
    slot = np.concatenate([words % np.uint64(slots), mix64(pairs) % np.uint64(slots), np.zeros(len(twice), np.uint64)])
    slot = slot.astype(np.int64)
    docs = np.concatenate([docs, owner, twice])
    key, count = np.unique(docs * slots + slot, return_counts=True)
    docs, slot = np.divmod(key, slots)
    value = np.sqrt(count.astype(float))
    norm = np.sqrt(np.bincount(docs, value * value, rows))
    return slot, value / norm[docs], np.searchsorted(docs, np.arange(rows + 1))


def bounded_sample(rows: DataFrame, most: int) -> DataFrame:
    """The ``most`` rows with the smallest id hashes: the same ones whatever the partitions.

    A count first tells below which hash they all lie, so that the tasks' own
    smallest, which only one task can merge, are few however many tasks there are.
    """
    hashed = F.xxhash64(F.col("__id").cast("string"))
    n = rows.count()
    if n > 4 * most + 4000:
        part = (2 * most + 1000) / n  # the chance of fewer than ``most`` is nil
        rows = rows.where(F.pmod(hashed, F.lit(1 << 31)) < int(part * (1 << 31)))
        hashed = F.pmod(hashed, F.lit(1 << 31))
    return rows.orderBy(hashed, "__id").limit(most)


def train_quality(labelled: DataFrame, epochs: int = 4, seed: int = 5) -> np.ndarray:
    """Weights (SLOTS and the bias) from rows (__id, __text, __label), a bounded_sample() of all.

    One task trains on their whole texts.  Rows without a label are left out;
    without rows all weights are 0.
    """
    rows = labelled.where(F.col("__label").isin(0, 1)).select(
        F.xxhash64(F.col("__id").cast("string")).alias("__key"),
        "__text",
        F.col("__label").cast("int"),
    )

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots, values, labels, keys = [], [], [], []
        for batch in small_batches(batches, "__text", 2 << 20):
            slot, value, bounds = features(batch, "__text")
            for lo, hi in zip(bounds[:-1], bounds[1:]):
                slots.append(np.append(slot[lo:hi], SLOTS))
                values.append(np.append(value[lo:hi], 1.0))
            labels += batch.column("__label").to_pylist()
            keys += batch.column("__key").to_pylist()
        order = np.argsort(np.array(keys, np.int64), kind="stable")  # whatever the order of arrival
        model = Ftrl()
        share = np.clip(np.mean(labels), 0.02, 0.98) if labels else 0.5
        weight = {1: 0.5 / share, 0: 0.5 / (1 - share)}  # both labels count alike
        rng = np.random.default_rng(seed)
        for _ in range(epochs):
            for k in order[rng.permutation(len(labels))]:
                model.update(slots[k], values[k], labels[k], weight[labels[k]])
        w = model.weights(np.arange(SLOTS + 1)).astype("<f4")
        yield pa.RecordBatch.from_arrays([pa.array([w.tobytes()], pa.binary())], names=["w"])

    # the chosen rows are shuffled to the task that trains, so that all tasks scan for them
    found = rows.repartition(1).mapInArrow(fit, "w binary").collect()
    return np.frombuffer(found[0]["w"], "<f4") if found else np.zeros(SLOTS + 1, "<f4")


def score_quality(docs: DataFrame, weights: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) for every row: the logistic of the sparse dot product over the whole text.

    Null and empty texts have the bias alone.  Repeated rows and null ids are
    scored one by one; an empty table gives an empty table.
    """
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    slim = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    id_type = slim.schema["__id"].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value.astype(float)
        for batch in small_batches(batches, "__text", 2 << 20):
            slot, value, bounds = features(batch, "__text")
            rows = np.repeat(np.arange(batch.num_rows), np.diff(bounds))
            dot = np.bincount(rows, w[slot] * value, batch.num_rows) + w[SLOTS]
            p = 1 / (1 + np.exp(-np.clip(dot, -35, 35)))
            yield pa.RecordBatch.from_arrays([batch.column("__id"), pa.array(p)], names=["__id", "score"])

    return slim.mapInArrow(score, f"__id {id_type}, score double").withColumnRenamed("__id", id_col)


def quality_scores(docs: DataFrame, labels: DataFrame, sample: int = 6000, folds: int = 5) -> DataFrame:
    """(doc_id, held_out, score, predicted): trained without the fold whose crc32 of the id is 0.

    A document is predicted good from a score of 0.3.  Labels, language, source
    and id are inputs of no score.
    """
    fold = F.crc32(F.col("doc_id").cast("string")) % folds
    known = (
        labels.where(F.col("quality").isNotNull() & (fold != 0))
        .groupBy("doc_id").agg(F.min("quality").alias("__label"))
    )
    chosen = known.select(F.col("doc_id").alias("__id"), "__label")
    chosen = bounded_sample(chosen, sample)
    train = docs.select("doc_id", F.col("text").alias("__text")).join(
        chosen, F.col("doc_id") == F.col("__id")
    ).select("__id", "__text", "__label")
    weights = train_quality(train)
    return score_quality(docs.select("doc_id", "text"), weights).select(
        "doc_id",
        F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
    )
