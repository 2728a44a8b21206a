"""Quality classifier by positive-unlabelled learning.

Trusted positives are rows labelled 1; every other row is unlabelled web text, and labels of 0 are never used. The class prior
(share of good texts among unlabelled ones) is estimated from scores of a first positive-against-unlabelled fit; then the
non-negative unbiased risk is minimised: ``prior * R+(g)`` plus ``max(0, R-u(g) - prior * R-p(g))``, with the gradient turned
round where the second part falls below zero.

A text is seen as 40 shares of its characters, words and lines, counted over the whole text in Arrow batches; the model is
linear in these and their squares. It is fitted on the driver from a bounded sample: ``FIT_ROWS`` rows of each kind, those with
the smallest hash of their id. Scoring reads every row in its place, without a shuffle.

Defined cases: null and empty texts have zero features and get a score like any other; rows without an id or label are
unlabelled and are not used for fitting when held out; without any positive row all scores are the prior 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from selroute.llm.common import raw_texts

FIT_ROWS = 8_000
_GROUPS = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" ", b"\n", b"\t\r", b".", b",", b"!", b"?",
           b"*", b"$", b"%", b"&", b"#", b"|", b"<>", b"()[]{}", b"'\"`", b":;", b"-_", b"=+/\\", b"@~^"]
_GROUP_OF = np.full(256, len(_GROUPS), dtype=np.int64)
for _i, _g in enumerate(_GROUPS):
    _GROUP_OF[list(_g)] = _i
_BUCKETS = len(_GROUPS) + 1  # the last one: bytes above ASCII and control bytes
_UPPER = [i for i in range(256) if 65 <= i <= 90]
WIDTH = _BUCKETS + 16


def features(text: bytes) -> np.ndarray:
    """Shares of byte groups, of word shapes and of line shapes, and the length on a log scale."""
    out = np.zeros(WIDTH)
    if not text:
        return out
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    out[:_BUCKETS] = np.bincount(_GROUP_OF, weights=counts, minlength=_BUCKETS) / len(text)
    words = text.split()
    lines = text.split(b"\n")
    n, distinct = max(1, len(words)), len(set(words))
    lengths = np.fromiter(map(len, words), np.int64, count=len(words))
    rest = out[_BUCKETS:]
    rest[0] = np.log1p(len(text)) / 10
    rest[1] = np.log1p(len(words)) / 10
    rest[2] = lengths.mean() / 10 if len(words) else 0
    rest[3] = lengths.std() / 10 if len(words) else 0
    rest[4] = (lengths > 12).sum() / n
    rest[5] = (lengths <= 3).sum() / n
    rest[6] = distinct / n
    rest[7] = sum(w.isupper() for w in words) / n
    rest[8] = sum(w[-1] in b"!*$%&#|" for w in words) / n
    rest[9] = sum(w.istitle() for w in words) / n
    rest[10] = sum(x[-1:] in (b".", b"!", b"?") for x in lines) / len(lines)
    rest[11] = len(set(lines)) / len(lines)
    rest[12] = np.log1p(len(text) / len(lines)) / 10
    rest[13] = sum(w in (b"|", b"*", b"-") for w in words) / n
    again = sum(map(bytes.__eq__, words, words[1:])) / n
    rest[14], rest[15] = again, min(1.0, 5 * again)
    return out


def feature_column(text: Column) -> Column:
    def extract(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([features(t) for t in raw_texts(batch)], pa.list_(pa.float64()))

    return F.arrow_udf(extract, "array<double>")(text)


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        return _expand((x - self.mean) / self.scale) @ self.weights + self.bias


def _expand(z: np.ndarray) -> np.ndarray:
    z = np.clip(z, -6, 6)
    return np.concatenate([z, z * z / 3], axis=1)


def _sigmoid(v: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(v, -30, 30)))


def _descend(z, gradient, steps: int, rate: float) -> tuple[np.ndarray, float]:
    """Adam on (weights, bias)."""
    theta = np.zeros(z + 1)
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for k in range(1, steps + 1):
        g = gradient(theta)
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        theta -= rate * (first / (1 - 0.9**k)) / (np.sqrt(second / (1 - 0.999**k)) + 1e-8)
    return theta[:-1], theta[-1]


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Share of positives among the unlabelled: the lowest ratio of the two upper score distributions, over the thresholds that
    keep at least a tenth of the positives (the ratio of densities is at least the prior everywhere and reaches it at the top)."""
    cuts = np.quantile(positive, np.linspace(0.02, 0.9, 45))
    p = np.array([(positive >= c).mean() for c in cuts])
    u = np.array([(unlabelled >= c).mean() for c in cuts])
    error = np.sqrt(u * (1 - u) / len(unlabelled)) + np.sqrt(p * (1 - p) / len(positive))
    return float(np.clip(np.min((u + error) / p), 0.05, 0.98))


def _with_ones(x: np.ndarray) -> np.ndarray:
    return np.c_[x, np.ones(len(x))]


def fit(positive: np.ndarray, unlabelled: np.ndarray, steps: int = 400, rate: float = 0.05) -> Model:
    """Minimise the non-negative risk with the logistic loss. The prior comes from scores of rows that a first fit has not seen."""
    both = np.concatenate([positive, unlabelled])
    mean, scale = both.mean(axis=0), both.std(axis=0) + 1e-3
    pb, ub = (_with_ones(_expand((x - mean) / scale)) for x in (positive, unlabelled))
    width, decay = pb.shape[1] - 1, 1e-3 + 2 / min(len(pb), len(ub))

    def against_unlabelled(p, u):
        def gradient(theta):
            return p.T @ (_sigmoid(p @ theta) - 1) / len(p) + u.T @ _sigmoid(u @ theta) / len(u) + decay * theta

        return np.append(*_descend(width, gradient, steps, rate))

    seen = []
    for k in (0, 1):  # each half is scored by the other half's fit; ranks make the two fits comparable
        theta = against_unlabelled(pb[k::2], ub[k::2])
        p, u = pb[1 - k :: 2] @ theta, ub[1 - k :: 2] @ theta
        place = np.sort(u)
        seen.append((np.searchsorted(place, p) / len(u), np.searchsorted(place, u) / len(u)))
    prior = estimate_prior(*(np.concatenate(x) for x in zip(*seen, strict=True)))

    def non_negative(theta):
        sp, su = _sigmoid(pb @ theta), _sigmoid(ub @ theta)
        negative = np.logaddexp(0, ub @ theta).mean() - prior * np.logaddexp(0, pb @ theta).mean()
        rest = ub.T @ su / len(ub) - prior * (pb.T @ sp) / len(pb)
        sure = prior * (pb.T @ (sp - 1)) / len(pb)
        return (sure + rest if negative >= 0 else -rest) + decay * theta

    weights, bias = _descend(width, non_negative, 2 * steps, rate)
    return Model(mean, scale, weights, float(bias), prior)


def fit_model(
    docs: DataFrame, labels: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text",
    label_col: str = "quality", fit_rows: int = FIT_ROWS,
) -> Model | None:
    """Fit on at most ``fit_rows`` positives and as many unlabelled rows among those that are ``usable`` (an expression over the id).

    The unlabelled rows are documents whatever their label, which is not looked at; both are those with the smallest hash of the id."""
    order = F.xxhash64(F.col("id"), F.lit(5))
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("label")).filter(usable & (F.col("label") == 1))
    positives = known.select("id").distinct().orderBy(order).limit(fit_rows)
    others = docs.select(F.col(id_col).alias("id")).filter(usable).distinct().orderBy(order).limit(fit_rows)
    chosen = positives.withColumn("positive", F.lit(True)).unionByName(others.withColumn("positive", F.lit(False)))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")
    rows = texts.select("positive", feature_column(F.col("text")).alias("x")).toPandas()  # at most 2 * fit_rows short vectors
    x = np.stack(rows["x"].to_numpy()) if len(rows) else np.zeros((0, WIDTH))
    is_positive = rows["positive"].to_numpy(dtype=bool)
    if is_positive.sum() < 2 or (~is_positive).sum() < 2:
        return None
    return fit(x[is_positive], x[~is_positive])


def score_column(text: Column, model: Model | None) -> Column:
    """Probability of a good text, between 0 and 1."""

    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            texts = raw_texts(batch)
            if model is None or not texts:
                yield pa.array(np.full(len(texts), 0.5), pa.float64())
            else:
                yield pa.array(_sigmoid(model.logits(np.stack([features(t) for t in texts]))), pa.float64())

    return F.arrow_udf(score, "double")(text)
