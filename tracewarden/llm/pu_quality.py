"""Quality classifier by positive-unlabelled learning.

A linear model over hashed text features minimises the non-negative unbiased risk

    prior * E_pos[l(+g)] + max(0, E_unl[l(-g)] - prior * E_pos[l(-g)])

with the logistic loss l, from trusted positives and unlabelled text. Texts marked as bad enter
only through the estimate of the class prior, the share of positives among the labelled rows.

Nulls: a null text is an empty text and gets a score like any other; labels without id or mark are
left out. Without trusted positives every score is 0.5. Repeated rows get equal scores. Columns of
the documents with other names are kept as they are.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewarden.llm import features
from tracewarden.llm.common import fresh, text_or_empty

#: Bound of the rows fitted on: this many trusted positives and this many unlabelled texts.
FIT_ROWS = 4096
THRESHOLD = 0.3
#: Added to the spread of each feature, so that a text far from all samples in a rare trigram doesn't outweigh the rest.
FLOOR = np.repeat([0.02, 0.02, 0.001], [features.GRAMS, 256, features.SHAPES])


@dataclass
class QualityModel:
    weights: np.ndarray
    bias: float
    prior: float


def held_out(doc_id: str = "doc_id") -> Column:
    """True for the fifth of the ids that no label is learnt from; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def sample_ids(ids: DataFrame, rows: int, column: str = "doc_id") -> DataFrame:
    """At most `rows` different ids, chosen by a hash: repeatable and bounded, so it may be broadcast."""
    ids = ids.select(column).where(F.col(column).isNotNull()).distinct()
    return F.broadcast(ids.orderBy(F.xxhash64(F.lit(11), column), column).limit(rows))


def sample_vectors(docs: DataFrame, ids: DataFrame, rows: int, keep: str | None = None) -> list:
    """Feature vectors of the sampled ids' texts, at most `rows` (ids may repeat)."""
    extra = [keep] if keep else []
    picked = docs.join(ids, "doc_id", "left_semi").select(*extra, text_or_empty().alias("text"))
    picked = picked.withColumn("h", F.xxhash64(F.lit(11), "text"))

    def run(batches):
        for b in batches:
            v = pa.array([x.tobytes() for x in features.vectors(b.column("text"))], pa.binary())
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in extra), b.column("h"), v], [*extra, "h", "v"])

    schema = (f"{keep} string, " if keep else "") + "h long, v binary"
    return picked.mapInArrow(run, schema).orderBy("h", "v", *extra).limit(rows).collect()


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 400, rate: float = 0.05, decay: float = 1e-4) -> QualityModel:
    """Minimise the non-negative risk with Adam over all sampled rows at once."""
    mean = np.concatenate([positive, unlabelled]).mean(0)
    std = np.concatenate([positive, unlabelled]).std(0) + FLOOR
    p, u = ((x - mean) / std for x in (positive, unlabelled))
    p, u = np.clip(p, -8, 8).astype(np.float32), np.clip(u, -8, 8).astype(np.float32)
    w, b = np.zeros(p.shape[1], np.float32), 0.0
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    sig = lambda x: 1 / (1 + np.exp(-np.clip(x, -30, 30)))
    for t in range(1, steps + 1):
        gp, gu = p @ w + b, u @ w + b
        negative = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
        dp, du = -prior * sig(-gp) / len(gp), np.zeros(len(gu))
        if negative >= 0:
            dp, du = dp - prior * sig(gp) / len(gp), sig(gu) / len(gu)
        else:  # step back until the negative part is no longer overfitted
            dp, du = prior * sig(gp) / len(gp), -sig(gu) / len(gu)
        grad = np.append(dp.astype(np.float32) @ p + du.astype(np.float32) @ u + decay * w, dp.sum() + du.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8) / np.sqrt(t)
        w, b = w - step[:-1].astype(np.float32), b - step[-1]
    weights = w / std
    return QualityModel(weights.astype(np.float64), float(b - (weights * mean).sum()), prior)


def train(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> QualityModel | None:
    """Model from the labels of documents that are not held out; None without positives."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out())
    known = known.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    good, n = known.agg(F.sum(F.when(F.col("quality") == 1, 1).otherwise(0)), F.count("*")).first()
    if not good:
        return None
    prior = float(np.clip((good + 1) / (n + 2), 0.05, 0.95))
    pos = _matrix(sample_vectors(docs, sample_ids(known.where("quality = 1"), rows), rows))
    unl = _matrix(sample_vectors(docs, sample_ids(docs.where(~held_out()), rows), rows))
    if not len(pos) or not len(unl):
        return None
    return fit(pos, unl, prior)


def _matrix(rows: list) -> np.ndarray:
    return np.array([np.frombuffer(r["v"], np.float32) for r in rows]).reshape(len(rows), features.SIZE)


def score(docs: DataFrame, model: QualityModel | None, columns: list[str], threshold: float = THRESHOLD) -> DataFrame:
    """The given columns of each document with score (0 to 1) and predicted (score >= threshold)."""
    (name,) = fresh(docs, "score")
    if model is None:
        out = docs.select(*columns).withColumn(name, F.lit(0.5))
    else:
        weights, bias = model.weights, np.array([model.bias])

        # only the text goes to Python and only the score comes back
        @F.arrow_udf("double")
        def scored(texts: pa.Array) -> pa.Array:
            g = features.scores(texts, weights, bias)[:, 0]
            return pa.array(1 / (1 + np.exp(-np.clip(g, -500, 500))))

        out = docs.select(*columns, scored(text_or_empty()).alias(name))
    return out.withColumn(fresh(docs, "predicted")[0], (F.col(name) >= threshold).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that the classifier does not reject, with their own columns only."""
    scored = score(docs, train(docs, labels), docs.columns, threshold)
    return scored.where(F.col(scored.columns[-1]) == 1).select(*docs.columns)
