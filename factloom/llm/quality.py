"""Quality classifier: Naive Bayes support vectors on word n-grams.

The indicators of hashed unigrams and bigrams are scaled by class log-count ratios; a linear
hinge-loss model on them is fitted by dual coordinate descent in numpy on the driver, from a
bounded labelled sample. Scoring is one pass over the documents without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .batches import give_back, small_batches
from .columns import col
from .labels import labelled_sample, on_disk, pieces
from .text import U64, mix, slices, word_hashes

BITS = 18
#: Labelled documents that the model is fitted on, at most.
TRAIN_LIMIT = 8_000
#: Share of good held-out documents that the threshold may reject.
MAX_LOSS = 0.002
#: Indicators of sampled documents that a fit works on at once.
PIECE = 1 << 21


@dataclass
class QualityModel:
    """score(x) = weights of the n-grams in x, summed, over the root of their number, plus bias."""

    weights: np.ndarray
    bias: float
    threshold: float
    held_out: dict


def ngram_indicators(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed unigrams and bigrams of each text, as bucket numbers and n + 1 offsets.

    Words keep their case, runs of signs are words too, and a word after itself is one bigram
    whatever the word.
    """
    h, off = word_hashes(texts, marks=True, fold=False)
    doc = np.repeat(np.arange(len(texts), dtype=np.int64), np.diff(off))
    keys = (doc << BITS) | (h >> U64(64 - BITS)).astype(np.int64)
    if len(h) > 1:
        within = doc[1:] == doc[:-1]
        pair = mix(h[:-1] * U64(0x9E3779B97F4A7C15) + h[1:])
        pair[h[1:] == h[:-1]] = U64(0x1234567890ABCDEF)
        pair = (doc[1:] << BITS) | (pair >> U64(64 - BITS)).astype(np.int64)
        keys = np.concatenate([keys, pair[within]])
    keys.sort()
    if len(keys):
        keys = keys[np.append(True, keys[1:] != keys[:-1])]
    return (keys & ((1 << BITS) - 1)).astype(np.int32), np.searchsorted(keys, np.arange(len(texts) + 1, dtype=np.int64) << BITS)


@F.arrow_udf(T.BinaryType())
def _indicators(texts: pa.Array) -> pa.Array:
    parts = []
    for at, n in slices(texts):
        idx, off = ngram_indicators(texts.slice(at, n))
        parts.append(pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((4 * off).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(idx))]))
    return pa.concat_arrays(parts) if parts else pa.array([], pa.binary())


def fit_arrays(idx: np.ndarray, off: np.ndarray, y: np.ndarray, epochs: int = 12, c: float = 1.0, seed: int = 7) -> tuple[np.ndarray, float]:
    """Weights and bias by dual coordinate descent on the L1 hinge loss; y is 0 or 1.

    Each class weighs the same in sum. With one class only, the weights are 0 and the bias
    speaks for it.
    """
    return _fit_rows(idx, off[:-1], np.diff(off), y, epochs, c, seed)


def _fit_rows(idx: np.ndarray, starts: np.ndarray, lengths: np.ndarray, y: np.ndarray, epochs: int = 12, c: float = 1.0, seed: int = 7) -> tuple[np.ndarray, float]:
    """fit_arrays() of rows that lie anywhere in idx."""
    size = 1 << BITS
    if not len(y) or y.min() == y.max():
        return np.zeros(size, np.float32), float(2 * y[0] - 1) if len(y) else 1.0
    p, q = np.ones(size), np.ones(size)
    for own, off, at in pieces(idx, starts, lengths, PIECE):
        good = np.repeat(y[at] == 1, np.diff(off))
        p += np.bincount(own[good], minlength=size)
        q += np.bincount(own[~good], minlength=size)
    ratio = np.log((p / p.sum()) / (q / q.sum()))
    norm = 1.0 / np.sqrt(np.maximum(lengths, 1))
    squares = np.ones(len(y))
    for own, off, at in pieces(idx, starts, lengths, PIECE):
        row = np.repeat(np.arange(len(off) - 1), np.diff(off))
        value = ratio[own] * norm[at][row]
        squares[at] += np.bincount(row, value * value, minlength=len(off) - 1)
    upper = c * np.where(y == 1, len(y) / (2.0 * max(y.sum(), 1)), len(y) / (2.0 * max((1 - y).sum(), 1)))
    sign, alpha, w, bias = 2.0 * y - 1.0, np.zeros(len(y)), np.zeros(size), 0.0
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(y)):
            f = idx[starts[i] : starts[i] + lengths[i]]
            x = ratio[f] * norm[i]
            gradient = sign[i] * (w[f] @ x + bias) - 1.0
            new = min(max(alpha[i] - gradient / squares[i], 0.0), upper[i])
            step = (new - alpha[i]) * sign[i]
            if step:
                alpha[i] = new
                w[f] += step * x
                bias += step
    return (w * ratio).astype(np.float32), bias


def score_arrays(weights: np.ndarray, bias: float, idx: np.ndarray, off: np.ndarray) -> np.ndarray:
    """The score of each row of indicators."""
    sums = np.concatenate([[0.0], np.cumsum(weights[idx], dtype=np.float64)])
    return (sums[off[1:]] - sums[off[:-1]]) / np.sqrt(np.maximum(np.diff(off), 1)) + bias


def fit_quality(documents: DataFrame, labels: DataFrame, limit: int = TRAIN_LIMIT, max_loss: float = MAX_LOSS) -> QualityModel:
    """A model from at most limit labelled documents (labels: doc_id, quality 0 or 1).

    A fifth of the sample is held out: the threshold is 0, or lower where 0 would reject more
    than max_loss of the good documents held out. Without labels everything is kept.
    """
    try:
        return _fit_quality(documents, labels, limit, max_loss)
    finally:
        give_back()


def _fit_quality(documents: DataFrame, labels: DataFrame, limit: int, max_loss: float) -> QualityModel:
    sample = labelled_sample(documents, labels, "quality", limit).select("y", F.xxhash64("doc_id").alias("h"), _indicators("text").alias("f"))
    with on_disk(sample, "f") as (rows, off, idx):
        return _fit_sample(rows, off, idx, max_loss)


def _fit_sample(rows: list, off: np.ndarray, idx: np.ndarray, max_loss: float) -> QualityModel:
    """A model of rows (y, h), in the order of h, whose indicators lie in idx."""
    if not rows:
        return QualityModel(np.zeros(1 << BITS, np.float32), 1.0, 0.0, {"rows": 0})
    order = np.argsort(np.array([r["h"] for r in rows], np.int64), kind="stable")
    y, starts, lengths = np.array([r["y"] for r in rows], np.int64)[order], off[:-1][order], np.diff(off)[order]
    out = np.arange(len(y)) % 5 == 4
    weights, bias = _fit_rows(idx, starts[~out], lengths[~out], y[~out])
    t = y[out]
    s = np.concatenate([np.zeros(0), *[score_arrays(weights, bias, own, o) for own, o, _ in pieces(idx, starts[out], lengths[out], PIECE)]])
    threshold = 0.0
    if (t == 1).any():
        # the largest threshold up to 0 that rejects no more than max_loss of the good ones
        good = np.sort(s[t == 1])
        threshold = min(0.0, float(good[int(max_loss * len(good))]) - 1e-9)
    keep = s >= threshold
    held = {"rows": len(t), "good_kept": float(keep[t == 1].mean()) if (t == 1).any() else None, "bad_rejected": float((~keep)[t == 0].mean()) if (t == 0).any() else None}
    return QualityModel(weights, bias, threshold, held)


def quality_score(spark: SparkSession, model: QualityModel, text: Column | str = "text") -> Column:
    """A Column with the score of a text as double; null for a null text, the bias for a text without words."""
    small_batches(spark)
    shared = spark.sparkContext.broadcast((model.weights, model.bias))  # 1 MB, whatever the data

    @F.arrow_udf(T.DoubleType())
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        weights, bias = shared.value
        for texts in batches:
            parts = [score_arrays(weights, bias, *ngram_indicators(texts.slice(at, n))) for at, n in slices(texts)]
            found = np.concatenate(parts) if parts else np.zeros(0)
            yield pa.array(found, pa.float64(), mask=texts.is_null().to_numpy(zero_copy_only=False))

    return score(text)


def classify_quality(documents: DataFrame, model: QualityModel, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, score, keep) for every row of documents.

    A null text scores null and is rejected; an empty text and one without words score the
    bias; a null doc_id stays null; repeated rows each get their row; an empty table gives an
    empty result. Other columns are left aside, whatever their names. Whole texts count.
    """
    spark = documents.sparkSession
    scored = documents.select(col(id_col).alias("doc_id"), quality_score(spark, model, col(text_col)).alias("score"))
    return scored.withColumn("keep", F.coalesce(F.col("score") >= F.lit(model.threshold), F.lit(False)))


def keep_quality(documents: DataFrame, model: QualityModel, text_col: str = "text") -> DataFrame:
    """The rows of documents that the model keeps, with all their columns, whatever their names.

    Rows with a null text go; empty texts and those without words go or stay by the model's
    bias; repeated rows all go or all stay; an empty table gives an empty result. Whole texts
    count, however long.
    """
    return documents.where(quality_score(documents.sparkSession, model, col(text_col)) >= F.lit(model.threshold))
