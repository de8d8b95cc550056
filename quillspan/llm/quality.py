"""Quality by a generalised additive model with pairwise interactions.

Numeric features of the whole text are cut into bins.  Cyclic boosting fits one shallow tree at a time, feature
after feature, on the logistic gradients, and adds it to that feature's lookup table; then the strongest pairs
of features get two-way tables in the same manner.  A score is a sum of table entries, so whole batches are
scored by array look-ups.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.llm.labelled import TRAIN_ROWS, held_out, in_one_task, training_rows
from quillspan.llm.words import HASHES, mix, rows, words

FEATURES = (
    "log_bytes", "upper", "digit", "space", "newline", "exclaim", "pipe", "other_punct", "non_ascii", "lower",
    "log_words", "word_length", "word_length_sd", "longest_word", "distinct_words", "top_word", "short_words",
    "letterless_words", "repeated_pairs", "log_lines", "distinct_lines", "words_per_line", "sentence_ends", "repeated_byte",
)

_CLASS = np.zeros(256, np.uint8)
for _code, _chars in enumerate((range(65, 91), range(48, 58), b" \t\r\x0b\x0c", b"\n", b"!", b"|", b".", b"\"#$%&'()*+,-/:;<=>?@[\\]^_`{}~", range(128, 256), range(97, 123)), 1):
    _CLASS[list(_chars)] = _code


@dataclass(frozen=True)
class Gam:
    bins: int = 32
    rounds: int = 150
    rate: float = 0.15
    pairs: int = 6
    pair_rounds: int = 60
    l2: float = 4.0


def features(text: str | None) -> np.ndarray:
    """The numbers named in FEATURES, in that order; all 0 for an empty text."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    if not len(raw):
        return np.zeros(len(FEATURES), np.float32)
    n = len(raw)
    upper, digit, space, newline, exclaim, pipe, stop, punct, high, lower = np.bincount(_CLASS[raw], minlength=11)[1:] / n
    tokens = words(text)
    h = HASHES.of(tokens)
    k = max(len(h), 1)
    lengths = np.fromiter(map(len, tokens), np.int64, len(tokens)) if tokens else np.zeros(1, np.int64)
    counts = np.unique(h, return_counts=True)[1] if len(h) else np.zeros(1, np.int64)
    pairs = mix(h[:-1]) + h[1:]
    letterless = sum(not any(c > 64 for c in w) for w in tokens if len(w) <= 3)
    lines = text.split("\n")
    return np.array([
        np.log1p(n), upper, digit, space, newline, exclaim, pipe, punct, high, lower,
        np.log1p(len(h)), lengths.mean(), lengths.std(), lengths.max(), np.count_nonzero(counts) / k, counts.max() / k, (lengths <= 3).sum() / k,
        letterless / k, 1 - len(np.unique(pairs)) / max(len(pairs), 1), np.log1p(len(lines)), len(set(lines)) / len(lines), len(h) / len(lines), stop * n / k, (raw[1:] == raw[:-1]).mean() if n > 1 else 0,
    ], np.float32)


def _features(batches):
    for batch in batches:
        out = [(i, y, features(t)) for i, y, t in rows([batch], "doc_id", "label", "text")]
        if out:
            ids, labels, found = zip(*out)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(labels, pa.int32()), pa.array(found, pa.list_(pa.float32()))], names=["doc_id", "label", "features"])


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def _tree(g: np.ndarray, h: np.ndarray, l2: float, depth: int = 2) -> np.ndarray:
    """Leaf value for each bin of a tree of ``depth`` cuts along one feature."""
    if depth and len(g) > 1:
        left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
        gain = left_g**2 / (left_h + l2) + (g.sum() - left_g) ** 2 / (h.sum() - left_h + l2)
        cut = int(np.argmax(gain)) + 1
        if gain[cut - 1] > g.sum() ** 2 / (h.sum() + l2) + 1e-9:
            return np.concatenate([_tree(g[:cut], h[:cut], l2, depth - 1), _tree(g[cut:], h[cut:], l2, depth - 1)])
    return np.full(len(g), -g.sum() / (h.sum() + l2))


def _quadrants(g: np.ndarray, h: np.ndarray, l2: float) -> tuple[np.ndarray, float]:
    """The best pair of cuts, one along each feature: the table of its four leaf values, and the gain."""
    sums = []
    for m in (g, h):
        low = m.cumsum(0).cumsum(1)
        a = low[:-1, :-1]
        row, column, all_ = low[:-1, -1:], low[-1:, :-1], low[-1, -1]
        sums.append(np.stack([a, row - a, column - a, all_ - row - column + a]))
    gain = (sums[0] ** 2 / (sums[1] + l2)).sum(0)
    i, j = np.unravel_index(int(np.argmax(gain)), gain.shape)
    leaf = -sums[0][:, i, j] / (sums[1][:, i, j] + l2)
    table = np.empty(g.shape)
    table[: i + 1, : j + 1], table[: i + 1, j + 1 :], table[i + 1 :, : j + 1], table[i + 1 :, j + 1 :] = leaf
    return table, float(gain[i, j])


def train(x: np.ndarray, y: np.ndarray, how: Gam) -> dict:
    """``edges`` and ``tables`` by feature, ``pairs`` of features with their two-way tables, and the ``intercept``."""
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, how.bins + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(e, c, "right") for e, c in zip(edges, x.T)])
    tables = [np.zeros(len(e) + 1) for e in edges]
    intercept = float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
    margin = np.full(len(y), intercept)
    for _ in range(how.rounds):
        for f, b in enumerate(binned):
            p = _sigmoid(margin)
            step = how.rate * _tree(np.bincount(b, p - y, len(tables[f])), np.bincount(b, p * (1 - p), len(tables[f])), how.l2)
            tables[f] += step
            margin += step[b]

    def grids(i, j):
        p, shape = _sigmoid(margin), (len(tables[i]), len(tables[j]))
        flat = binned[i] * shape[1] + binned[j]
        return [np.bincount(flat, v, shape[0] * shape[1]).reshape(shape) for v in (p - y, p * (1 - p))], flat

    usable = [f for f in range(len(edges)) if len(tables[f]) > 1]
    strength = {ij: _quadrants(*grids(*ij)[0], how.l2)[1] for ij in combinations(usable, 2)}
    chosen = sorted(strength, key=lambda ij: (-strength[ij], ij))[: how.pairs]
    pairs = {ij: np.zeros((len(tables[ij[0]]), len(tables[ij[1]]))) for ij in chosen}
    for _ in range(how.pair_rounds):
        for ij in chosen:
            (g, h), flat = grids(*ij)
            step = how.rate * _quadrants(g, h, how.l2)[0]
            pairs[ij] += step
            margin += step.ravel()[flat]
    return {"edges": edges, "tables": tables, "pairs": pairs, "intercept": intercept}


def predict(model: dict, x: np.ndarray) -> np.ndarray:
    binned = [np.searchsorted(e, c, "right") for e, c in zip(model["edges"], x.T)]
    margin = np.full(len(x), model["intercept"])
    for table, b in zip(model["tables"], binned):
        margin += table[b]
    for (i, j), table in model["pairs"].items():
        margin += table[binned[i], binned[j]]
    return _sigmoid(margin)


def fit(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS, how: Gam = Gam()) -> dict | None:
    """The model from at most ``most`` labelled rows (a few numbers each), or None without labelled rows."""
    found = training_rows(docs, labels, "quality", most).mapInArrow(_features, "doc_id long, label int, features array<float>")
    got = in_one_task(found).select("label", "features").toPandas()
    return train(np.stack(got["features"]).astype(np.float64), got["label"].to_numpy(np.float64), how) if len(got) else None


def score(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS, how: Gam = Gam()) -> Column:
    """The score of ``text`` as a column, by a model of at most ``most`` labelled rows; 1 without any."""
    model = fit(docs, labels, most, how)
    if model is None:
        return F.lit(1.0)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        return pd.Series(predict(sent.value, np.stack([features(t) for t in texts]).astype(np.float64)) if len(texts) else [], dtype="float64")

    return scored(F.col("text").cast("string"))


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, most: int = TRAIN_ROWS, how: Gam = Gam()) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs(doc_id, text)``.

    Labels come from ``labels(doc_id, quality)`` rows whose crc32(doc_id) mod 5 is not 0, at most ``most`` of them.
    Only the text is an input of the score.  Null and empty texts have all features 0 and are scored like others.
    Without labelled rows every score is 1: nothing is rejected.  A null doc_id counts as held out; repeated rows
    are scored each; an empty table gives no rows; other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = docs.select("doc_id", score(docs, labels, most, how).alias("score"))
    return scored.select("doc_id", held_out().alias("held_out"), "score", F.expr(f"cast(score >= {threshold} as int)").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, most: int = TRAIN_ROWS, how: Gam = Gam()) -> DataFrame:
    """The rows of ``docs`` that score ``threshold`` or more, with all their columns."""
    return docs.filter(score(docs, labels, most, how) >= threshold)
