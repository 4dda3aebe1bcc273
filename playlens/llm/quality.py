"""A quality classifier learned from positives and unlabelled text (PU learning).

A text is described by the square roots of its byte-pair frequencies, hashed into bins, and a few shares (upper case,
digits, marks, repeated lines and words). A linear model is trained on trusted positives P and unlabelled web text U by the
non-negative risk  pi R+(P) + max(0, R-(U) - pi R-(P))  with the logistic loss: where the second part would fall below
zero, only the first is followed. The class prior pi is estimated from the labels of the training fold.

Bound: the model is fitted on at most ``max_rows`` positives and ``max_rows`` unlabelled rows, those of the smallest
hashes of their ids; every row is scored. Rows of the held-out fold teach nothing. Empty and null texts have no pairs and
get the score of the bias and the length. Without labelled positives every score is 0.5. A score doesn't depend on ids,
labels, sources or languages; equal texts get equal scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType

from playlens.llm.common import crc_fold, text_of

BINS = 1024
SHARES = 9
MAX_ROWS = 12_000
FOLDS, HELD_OUT = 5, 0
THRESHOLD = 0.3

_PAIRS = np.arange(65536, dtype=np.uint64)
#: The bin of each byte pair: a multiplicative hash.
_BIN = ((_PAIRS * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(54)).astype(np.int64)
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_MARK = np.zeros(256, bool)
_MARK[33:48] = _MARK[58:65] = _MARK[91:97] = _MARK[123:127] = True


def features(text: str) -> np.ndarray:
    out = np.zeros(BINS + SHARES, np.float32)
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    if not len(raw):
        return out
    if len(raw) > 1:
        pairs = (raw[:-1].astype(np.uint16) << 8) | raw[1:]
        out[:BINS] = np.sqrt(np.bincount(_BIN[pairs], minlength=BINS) / len(pairs))
    counts = np.bincount(raw, minlength=256) / len(raw)
    lines, words = text.split("\n"), text.split()
    again = sum(map(eq, words, islice(words, 1, None))) / max(len(words), 1)
    out[BINS:] = (
        min(np.log1p(len(raw)) / 12, 1), counts[_UPPER].sum(), counts[_DIGIT].sum(), counts[_MARK].sum(), counts[32],
        len(set(lines)) / len(lines), counts[128:].sum(), again, len(set(words)) / max(len(words), 1),
    )
    return out


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    bias: float
    prior: float

    def score(self, texts: list[str]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        x = np.stack([features(t) for t in texts])
        return 1 / (1 + np.exp(-np.clip(x @ self.weights + self.bias, -30, 30).astype(np.float64)))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 300, rate: float = 0.3, decay: float = 1e-5, threshold: float = THRESHOLD) -> Model:
    """Minimise the non-negative risk by Adam over all rows given.

    The rate falls to zero, and the weights of the second half of the steps are averaged. The bias is then set so that the
    share 1 - prior of the unlabelled texts scores below ``threshold``: the ranking is learned, the cut follows the prior.
    """
    if not len(positive) or not len(unlabelled):
        return Model(np.zeros(BINS + SHARES, np.float32), 0.0, prior)
    p, u = positive, unlabelled
    w = np.zeros(p.shape[1] + 1)  # the last one is the bias
    m, v, total = np.zeros_like(w), np.zeros_like(w), np.zeros_like(w)
    mean = lambda x, s: np.append(x.T @ s.astype(np.float32), s.sum()) / len(x)
    for step in range(1, steps + 1):
        now = w[:-1].astype(np.float32)
        gp, gu = p @ now + w[-1], u @ now + w[-1]
        sp, su = (1 / (1 + np.exp(-np.clip(g, -30, 30))) for g in (gp, gu))
        # Logistic losses: l(+) = log(1+e^-g), l(-) = log(1+e^g); their slopes are s-1 and s.
        negative = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
        grad = prior * mean(p, sp - 1) + decay * w
        if negative > 0:
            grad += mean(u, su) - prior * mean(p, sp)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w -= rate * (1 - (step - 1) / steps) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        if 2 * step > steps:
            total += w
    weights = (total[:-1] / (steps - steps // 2)).astype(np.float32)
    bias = np.log(threshold / (1 - threshold)) - np.quantile(u @ weights, 1 - prior) + 1e-6
    return Model(weights, float(bias), prior)


def _described(rows: DataFrame) -> np.ndarray:
    """Features of a bounded set of rows (text), as half floats to the driver."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"x": [features(t).astype(np.float16).tobytes() for t in pdf["text"]]})

    got = rows.select("text").mapInPandas(run, "x binary").toPandas()["x"]
    out = np.empty((len(got), BINS + SHARES), np.float32)
    for i, x in enumerate(got):
        out[i] = np.frombuffer(x, np.float16)
    return out


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Model:
    """``docs`` (doc_id, text) and ``labels`` (doc_id, quality); rows of the held-out fold and null labels are left out."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    known = known.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (crc_fold("doc_id", FOLDS) != HELD_OUT))
    prior = known.agg(F.avg("quality")).first()[0]
    fold = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).filter(crc_fold("doc_id", FOLDS) != HELD_OUT)
    order = lambda seed: F.xxhash64("doc_id", F.lit(seed))
    trusted = known.filter("quality = 1").select("doc_id").distinct().orderBy(order(1), "doc_id").limit(max_rows)
    some = fold.select("doc_id").orderBy(order(2), "doc_id").limit(max_rows)
    # Both id lists hold max_rows rows at most.
    positive = fold.join(F.broadcast(trusted), "doc_id", "left_semi")
    unlabelled = fold.join(F.broadcast(some), "doc_id", "left_semi")
    return fit(_described(positive), _described(unlabelled), min(max(prior or 0.5, 0.01), 0.99))


def score_of(model: Model, text_col: str = "text") -> Column:
    """The score of each row's own text."""

    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(np.concatenate([model.score(texts.iloc[i : i + 1000].tolist()) for i in range(0, len(texts), 1000)] or [np.zeros(0)]))

    return F.pandas_udf(run, DoubleType())(text_of(text_col))


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    held_out = crc_fold(id_col, FOLDS) == HELD_OUT
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out.alias("held_out"), score_of(model, text_col).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
