"""Quality classifier: logistic regression on hashed word n-grams, trained with follow-the-regularised-leader updates.

Cases. Null or empty text: no features, the score is that of the bias alone. Repeated rows: each is scored alike. Null doc_id: not held out.
Empty tables, or labels of one class only: the model is the bias of the labels seen (0.5 with none). Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callweave.llm.common import bounded_batches, crc_fold, trimmed
from callweave.llm.textblocks import mixed, word_slices

BITS = 18
#: Labelled rows that the model is fitted to at most, those of the smallest hash of doc_id.
TRAIN_ROWS = 12_000
EPOCHS, ALPHA, BETA, L1, L2 = 2, 0.2, 1.0, 0.0005, 0.5
_SHIFT = np.uint64(64 - BITS)


def _features(words) -> tuple[np.ndarray, np.ndarray]:
    """(slot, document) of the n-grams: each word, each pair of neighbours, and, as words of the tail are rare, two that stand for many:
    the word's last two bytes, and one for any pair of equal words."""
    h, doc = words.hashes, words.doc_of_word()
    if not len(h):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    tail = words.data[words.end].astype(np.uint64) * np.uint64(256) + words.data[np.maximum(words.end - 1, words.begin)]
    pair = mixed(h[:-1] * np.uint64(3) + h[1:] * np.uint64(0x9E3779B97F4A7C15))
    pair[h[:-1] == h[1:]] = np.uint64(0x5851F42D4C957F2D)
    same = doc[:-1] == doc[1:]
    slots = np.concatenate([h, mixed(tail + np.uint64(1 << 40)), pair[same]]) >> _SHIFT
    return slots.astype(np.int64), np.concatenate([doc, doc, doc[:-1][same]])


def _sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, labels = batch.column(0), batch.column(1)
        for words in word_slices(batch.column(2)):
            slots, doc = _features(words)
            packed = []
            order = np.argsort(doc, kind="stable")
            ends = np.cumsum(np.bincount(doc, minlength=words.hi - words.lo))
            for k, end in enumerate(ends):
                own = slots[order[(ends[k - 1] if k else 0) : end]]
                slot, count = np.unique(own, return_counts=True)
                packed.append((slot.astype(np.uint32).tobytes(), (count / math.sqrt(max(1, len(own)))).astype(np.float32).tobytes()))
            n = words.hi - words.lo
            yield pa.RecordBatch.from_arrays(
                [keys.slice(words.lo, n), labels.slice(words.lo, n), pa.array([p[0] for p in packed], pa.binary()), pa.array([p[1] for p in packed], pa.binary())],
                names=["key", "label", "slots", "values"],
            )


class Ftrl:
    """Per-coordinate FTRL-proximal; slot 2**BITS is the bias, which has no penalty."""

    def __init__(self, size: int):
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        free = at == len(self.z) - 1
        l1, l2 = np.where(free, 0.0, L1), np.where(free, 0.0, L2)
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((BETA + np.sqrt(n)) / ALPHA + l2))

    def step(self, at: np.ndarray, x: np.ndarray, y: float) -> None:
        w = self.weights(at)
        p = 1 / (1 + math.exp(-max(-35.0, min(35.0, float(w @ x)))))
        g = (p - y) * x
        grown = self.n[at] + g * g
        self.z[at] += g - (np.sqrt(grown) - np.sqrt(self.n[at])) / ALPHA * w
        self.n[at] = grown


def _fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = []
    for batch in batches:
        rows += zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)
    model = Ftrl(1 << BITS)
    for _ in range(EPOCHS):
        for y, slots, values in rows:
            at = np.append(np.frombuffer(slots, np.uint32), np.uint32(1 << BITS)).astype(np.int64)
            model.step(at, np.append(np.frombuffer(values, np.float32), np.float32(1)).astype(np.float64), float(y))
    w = model.weights(np.arange((1 << BITS) + 1)).astype(np.float32)
    yield pa.RecordBatch.from_arrays([pa.array([w.tobytes()], pa.binary())], names=["w"])


def train(documents: DataFrame, labels: DataFrame, folds: int = 3, held: int = 1, train_rows: int = TRAIN_ROWS) -> np.ndarray:
    """Weights (2**BITS slots and the bias) from at most train_rows labelled documents outside the held fold.

    One task reads the sparse features of those rows in the order of their hash and makes the updates; nothing else is gathered.
    A document that has both labels counts as of the worse one.
    """
    bounded_batches(documents.sparkSession)
    chosen = (
        labels.where("doc_id is not null and quality in (0, 1)")
        .where(crc_fold(F.col("doc_id"), folds) != held)
        .groupBy("doc_id")
        .agg(F.min("quality").cast("double").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(train_rows)
    )
    texts = documents.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
    sparse = texts.select(F.xxhash64("doc_id").alias("key"), "label", "text").mapInArrow(trimmed(_sparse), "key long, label double, slots binary, values binary")
    row = sparse.repartition(1).sortWithinPartitions("key", "label", "slots").mapInArrow(trimmed(_fit), "w binary").collect()
    return np.frombuffer(row[0]["w"], np.float32) if row else np.zeros((1 << BITS) + 1, np.float32)


def _scored(documents: DataFrame, weights: np.ndarray, keep: list[str]) -> tuple[DataFrame, list[str]]:
    """The columns in keep under names of their own, and score; and those names."""
    bounded_batches(documents.sparkSession)
    names = [f"c{k}" for k in range(len(keep))]
    carried = "text" in keep and documents.schema["text"].dataType.simpleString() == "string"
    at = keep.index("text") if carried else len(names)
    table = documents.sparkSession.sparkContext.broadcast(weights)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = table.value.astype(np.float64)
        for batch in batches:
            p = np.empty(batch.num_rows)
            for words in word_slices(batch.column(at)):
                slots, doc = _features(words)
                n = np.bincount(doc, minlength=words.hi - words.lo)
                dot = np.bincount(doc, weights=w[slots], minlength=words.hi - words.lo) / np.sqrt(np.maximum(1, n)) + w[-1]
                p[words.lo : words.hi] = 1 / (1 + np.exp(-np.clip(dot, -35, 35)))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(p)], names=[*names, "score"])

    source = documents.select(*[documents[f"`{c}`"].alias(n) for c, n in zip(keep, names, strict=True)], *([] if carried else [documents["text"].cast("string").alias("t")]))
    schema = ", ".join([*(f"{n} {f.dataType.simpleString()}" for n, f in zip(names, source.schema.fields, strict=False)), "score double"])
    return source.mapInArrow(trimmed(scored), schema), names


def score(documents: DataFrame, weights: np.ndarray, keep: list[str]) -> DataFrame:
    """The columns in keep, and score: the probability of label 1 of the whole text."""
    out, names = _scored(documents, weights, keep)
    return out.select(*[F.col(n).alias(c) for c, n in zip(keep, names, strict=True)], "score")


def accepted(documents: DataFrame, weights: np.ndarray, least: float = 0.5) -> DataFrame:
    """The documents that score least or more, with all their columns."""
    out, names = _scored(documents, weights, documents.columns)
    return out.where(F.col("score") >= least).select(*[F.col(n).alias(c) for c, n in zip(documents.columns, names, strict=True)])


def judged(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    out = score(documents, train(documents, labels), ["doc_id"])
    return out.select("doc_id", (crc_fold(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
