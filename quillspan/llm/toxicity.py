"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Every coordinate has its own learning rate; the L1 term leaves most weights at exactly zero, so the model is
the list of its non-zero weights, at most ``DIM`` of them, and is sent to every task.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.llm.labelled import TRAIN_ROWS, held_out, in_one_task, training_rows
from quillspan.llm.words import HASHES, mix, rows, words

DIM = 1 << 20
SCORED = "doc_id long, score double"


@dataclass(frozen=True)
class Ftrl:
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 10.0
    l2: float = 0.1
    epochs: int = 5


def features(text: str | None) -> np.ndarray:
    """Hashed words without edge punctuation, pairs of neighbours, and pairs with one word between; with repeats."""
    h = HASHES.of([w.strip(b".,;:!?\"'()[]") for w in words(text)])
    pairs = [h, mix(h[:-1]) + h[1:], mix(h[:-2] + np.uint64(1)) + h[2:]]
    return (mix(np.concatenate(pairs)) % np.uint64(DIM)).astype(np.int32)


def _features(batches):
    for batch in batches:
        out = [(i, y, np.unique(features(t))) for i, y, t in rows([batch], "doc_id", "label", "text")]
        if out:
            ids, labels, found = zip(*out)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(labels, pa.int32()), pa.array(found, pa.list_(pa.int32()))], names=["doc_id", "label", "features"])


def train(examples: list[tuple[np.ndarray, int]], how: Ftrl) -> tuple[np.ndarray, np.ndarray, float]:
    """Indices and values of the non-zero weights, and the intercept, which has no penalty."""
    z, n = np.zeros(DIM), np.zeros(DIM)
    z0 = n0 = 0.0

    def weights(at):
        za = z[at]
        return -np.sign(za) * np.maximum(np.abs(za) - how.l1, 0) / ((how.beta + np.sqrt(n[at])) / how.alpha + how.l2)

    for _ in range(how.epochs):
        for at, y in examples:
            w, w0 = weights(at), -z0 / ((how.beta + math.sqrt(n0)) / how.alpha)
            g = 1 / (1 + math.exp(-min(max(w.sum() + w0, -35.0), 35.0))) - y
            root = np.sqrt(n[at])
            z[at] += g - (np.sqrt(n[at] + g * g) - root) / how.alpha * w
            n[at] += g * g
            z0 += g - (math.sqrt(n0 + g * g) - math.sqrt(n0)) / how.alpha * w0
            n0 += g * g
    every = weights(np.arange(DIM))
    kept = np.flatnonzero(every)
    return kept, every[kept], -z0 / ((how.beta + math.sqrt(n0)) / how.alpha)


def _train(how: Ftrl):
    def run(batches):
        examples = []
        for batch in batches:
            lists = batch.column(2)
            flat, at = lists.flatten().to_numpy(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
            examples += [(flat[a:b].copy(), y) for a, b, y in zip(at[:-1], at[1:], batch.column(1).to_pylist())]
        if examples:
            index, value, intercept = train(examples, how)
            yield pa.RecordBatch.from_arrays([pa.array([index.astype(np.int32)]), pa.array([value]), pa.array([intercept])], names=["index", "value", "intercept"])

    return run


def fit(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS, how: Ftrl = Ftrl()) -> tuple[np.ndarray, np.ndarray, float] | None:
    """The model from at most ``most`` labelled rows, or None without labelled rows."""
    found = training_rows(docs, labels, "toxic", most).mapInArrow(_features, "doc_id long, label int, features array<int>")
    model = in_one_task(found).mapInArrow(_train(how), "index array<int>, value array<double>, intercept double").first()
    return None if model is None else (np.array(model["index"], np.int32), np.array(model["value"]), model["intercept"])


def _score(model):
    def run(batches):
        index, value, intercept = model.value
        weights = np.zeros(DIM)
        weights[index] = value
        for batch in batches:
            ids, scores = [], []
            for doc_id, text in rows([batch], "doc_id", "text"):
                found = features(text)
                used = np.unique(found[weights[found] != 0])
                ids.append(doc_id)
                scores.append(1 / (1 + math.exp(-min(max(float(weights[used].sum()) + intercept, -35.0), 35.0))))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    return run


def toxicity(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS, how: Ftrl = Ftrl()) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs(doc_id, text)``.

    Labels come from ``labels(doc_id, toxic)`` rows whose crc32(doc_id) mod 5 is not 0, at most ``most`` of them.
    Only the text is an input of the score.  A null or empty text gets the score of the intercept alone.  Without
    labelled rows every score is 0.  A null doc_id counts as held out; repeated rows are scored each; an empty
    table gives no rows; other columns are ignored.
    """
    model = fit(docs, labels, most, how)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if model is None:
        scored = docs.select("doc_id", F.lit(0.0).alias("score"))
    else:
        scored = docs.mapInArrow(_score(docs.sparkSession.sparkContext.broadcast(model)), SCORED)
    return scored.select("doc_id", held_out().alias("held_out"), "score", F.expr("cast(score >= 0.5 as int)").alias("predicted"))
