"""Mixing sources to target weights with soft membership.

A classifier trained on labelled rows (multinomial logistic regression over hashed text features)
gives every document a posterior over the domains. Non-negative rates, one per document, are then
fitted by projected gradient: with t_i tokens, posteriors p_i and rates r_i, the expected totals
sum_i r_i t_i p_i are to match the targets in least squares. Starting from 1, every round is

    r_i <- max(0, r_i - p_i . g),   g = M^-1 (totals - targets),   M = sum_i t_i p_i p_i^T

which is the gradient step of length 1 in the metric of the tokens, with the residual measured in
the norm of M^-1, so that one length fits all data. Each step starts a little beyond the last rates,
further along the way they came (Nesterov's momentum, begun anew whenever the error has grown), as
plain steps close in too slowly on targets that leave many rates at 0. A round is one distributed sum
over the table of posteriors; a rate depends on its document's posterior and the gradients so far
only, so that nothing but these few numbers is carried from round to round. The rounds end once the
totals match or the error has stopped falling; the largest error of a total, as a share of all tokens,
comes with the rates, and a warning is given if it is above `REPORTED` (a target that the documents
can't reach, for instance). A document is written floor(r) or
floor(r) + 1 times, by a hash of its id and text.

Nulls: a null text is an empty text of no tokens; labelled rows without domain are left out. Without
labelled rows, or without tokens, every rate is 1. Targets name domains; those that no labelled row
has are left out and the rest scaled to 1. Repeated rows get equal rates and equal copies.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from tracewarden.llm import features
from tracewarden.llm.common import STEP_BYTES, chunks, fresh, stored, text_or_empty, words
from tracewarden.llm.pu_quality import sample_ids, sample_vectors

#: Bound of the labelled rows that the classifier is fitted on.
FIT_ROWS = 4096
#: The fit ends here at last; it ends before if the best error has not fallen by a hundredth in PATIENCE rounds.
ROUNDS = 400
PATIENCE = 40
TOLERANCE = 1e-6
#: Error of a total, as a share of all tokens, from which on a warning is given.
REPORTED = 1e-3


@dataclass
class DomainModel:
    domains: list[str]
    weights: np.ndarray
    bias: np.ndarray


def train(docs: DataFrame, labels: DataFrame, domain: str, rows: int = FIT_ROWS, steps: int = 200, rate: float = 0.05, decay: float = 1e-4) -> DomainModel | None:
    """Classifier of the domain column of the documents from at most `rows` that the table of labels has."""
    known = docs.where(F.col(domain).isNotNull()).select("doc_id", "text", F.col(domain).cast("string").alias("domain"))
    sample = sample_vectors(known, sample_ids(labels, rows), rows, keep="domain")
    if not sample:
        return None
    names = sorted({r["domain"] for r in sample})
    x = np.array([np.frombuffer(r["v"], np.float32) for r in sample])
    y = np.array([names.index(r["domain"]) for r in sample])
    mean, std = x.mean(0), x.std(0) + np.repeat([0.02, 0.02, 0.001], [features.GRAMS, 256, features.SHAPES])
    z = np.clip((x - mean) / std, -8, 8).astype(np.float32)
    w, b = np.zeros((len(names), z.shape[1]), np.float32), np.zeros(len(names))
    m, v = np.zeros((len(names), z.shape[1] + 1)), np.zeros((len(names), z.shape[1] + 1))
    goal = np.eye(len(names), dtype=np.float32)[y]
    for t in range(1, steps + 1):
        e = (softmax(z @ w.T + b) - goal) / len(z)
        grad = np.hstack([e.T.astype(np.float32) @ z + decay * w, e.sum(0)[:, None]])
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8) / np.sqrt(t)
        w, b = w - step[:, :-1].astype(np.float32), b - step[:, -1]
    weights = (w / std).astype(np.float64)
    return DomainModel(names, weights, b - weights @ mean)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def posteriors(docs: DataFrame, model: DomainModel) -> DataFrame:
    """doc_id, th (hash of the text), tokens (words) and p (posterior of each domain) of every row."""

    def run(batches):
        for b in batches:
            texts = b.column("text")
            p = softmax(features.scores(texts, model.weights, model.bias))
            n = np.zeros(b.num_rows, np.int64)
            for at, end, data, off in chunks(texts, STEP_BYTES):
                start, _ = words(data, off)
                n[at:end] = np.bincount(np.searchsorted(off, start, "right") - 1, minlength=end - at)
            p = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * p.shape[1]), pa.array(p.ravel()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("th"), pa.array(n), p], ["doc_id", "th", "tokens", "p"])

    rows = docs.select("doc_id", text_or_empty().alias("text")).withColumn("th", F.xxhash64("text"))
    return rows.mapInArrow(run, rows.select("doc_id", "th").schema.add("tokens", "long").add("p", ArrayType(DoubleType())))


Step = tuple[float, np.ndarray]


def state_of(p: Column, steps: list[Step]) -> Column:
    """Struct (r, y): the rate of a document after the given steps, and where the next gradient is taken.

    A step is (momentum, gradient): r' = max(0, y - p . gradient), y' = r' + momentum (r' - r).
    """
    first = F.struct(F.lit(1.0).alias("r"), F.lit(1.0).alias("y"))
    if not steps:
        return first
    rounds = F.array(*(F.struct(F.lit(float(m)).alias("m"), F.array(*map(F.lit, map(float, g))).alias("g")) for m, g in steps))
    along = lambda g: F.aggregate(F.zip_with(p, g, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    moved = lambda s, x: F.struct(s["r"].alias("was"), F.greatest(F.lit(0.0), s["y"] - along(x["g"])).alias("r"), x["m"].alias("m"))
    ahead = lambda s: F.struct(s["r"].alias("r"), (s["r"] + s["m"] * (s["r"] - s["was"])).alias("y"))
    return F.aggregate(rounds, first, lambda s, x: F.element_at(F.transform(F.array(moved(s, x)), ahead), 1))


def rate_of(p: Column, steps: list[Step]) -> Column:
    """The rate of a document after the given steps."""
    return state_of(p, steps)["r"]


def fit(table: DataFrame, targets: np.ndarray, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> tuple[list[Step], float]:
    """Steps up to the best round, and its largest error of a total as a share of all tokens."""
    d = len(targets)
    p = lambda k: F.col("p")[k]
    moments = table.agg(F.sum("tokens").alias("t"), *(F.sum(F.col("tokens") * p(i) * p(j)).alias(f"m{i}_{j}") for i in range(d) for j in range(i, d))).first()
    if not moments["t"]:
        return [], 0.0
    metric = np.array([[moments[f"m{min(i, j)}_{max(i, j)}"] for j in range(d)] for i in range(d)])
    inverse = np.linalg.pinv(metric + 1e-12 * np.trace(metric) * np.eye(d), rcond=1e-9)
    goal = targets * moments["t"]
    steps: list[Step] = []
    best, kept, lowest, since, speed, last = np.inf, 0, np.inf, 0, 1.0, np.inf
    for k in range(rounds + 1):
        # the state runs along with the totals: the rates' own, and those where the next gradient is taken
        rows = table.select("tokens", "p", state_of(F.col("p"), steps).alias("s"))
        sums = rows.agg(*(F.sum(F.col("tokens") * F.col(f"s.{c}") * p(i)).alias(f"{c}{i}") for c in "ry" for i in range(d))).first()
        gap, ahead = (np.array([sums[f"{c}{i}"] for i in range(d)]) - goal for c in "ry")
        error = float(np.abs(gap).max() / moments["t"])
        if error < best:
            best, kept = error, len(steps)
        since = 0 if best < 0.99 * lowest else since + 1
        lowest = best if not since else lowest
        if best <= tolerance or since >= PATIENCE or k == rounds:
            break
        value = float(gap @ inverse @ gap)
        if value > last and steps and steps[-1][0]:
            steps[-1] = (0.0, steps[-1][1])  # the momentum led uphill: on from the rates themselves
            ahead, speed = gap, 1.0
        last = value
        faster = (1 + (1 + 4 * speed**2) ** 0.5) / 2
        steps.append(((speed - 1) / faster, inverse @ ahead))
        speed = faster
    return steps[:kept], best


def rated(docs: DataFrame, labels: DataFrame, domain: str, targets: dict[str, float]) -> tuple[DataFrame, list[str], float]:
    """doc_id, th, tokens, p, rate of every row, the domains that p lists, and the largest error of a total."""
    model = train(docs, labels, domain)
    if model is None:
        rows = docs.select("doc_id", F.xxhash64(text_or_empty()).alias("th"), F.size(F.split(F.trim(text_or_empty()), r"\s+")).cast("long").alias("tokens"))
        return rows.withColumns({"p": F.array().cast("array<double>"), "rate": F.lit(1.0)}), [], 0.0
    wanted = np.array([max(0.0, targets.get(x, 0.0)) for x in model.domains])
    table = stored(posteriors(docs, model), "posteriors")
    steps, error = fit(table, wanted / wanted.sum()) if wanted.sum() else ([], 0.0)
    if error > REPORTED:
        warnings.warn(f"targets are missed by up to {error:.2%} of all tokens", stacklevel=2)
    return table.withColumn("rate", rate_of(F.col("p"), steps)), model.domains, error


def rates(docs: DataFrame, labels: DataFrame, domain: str, targets: dict[str, float]) -> tuple[DataFrame, list[str]]:
    """The rated rows and the domains that p lists."""
    return rated(docs, labels, domain, targets)[:2]


def copies(rate: Column, doc_id: str = "doc_id", th: str = "th") -> Column:
    """floor(rate) or one more, by a hash that falls evenly between 0 and 1."""
    even = F.pmod(F.xxhash64(F.lit(23), F.col(doc_id), F.col(th)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    return F.floor(rate + even).cast("int")


def mix(docs: DataFrame, labels: DataFrame, domain: str, targets: dict[str, float]) -> DataFrame:
    """The documents with their own columns, each as often as its rate says."""
    none, first, th, n = fresh(docs, "_none", "_first", "_th", "_n")
    rated, _ = rates(docs, labels, domain, targets)
    times = rated.select(F.col("doc_id").isNull().alias(none), F.coalesce("doc_id", F.lit(0)).alias(first), F.col("th").alias(th), copies(F.col("rate")).alias(n)).distinct()
    tagged = docs.withColumns({none: F.col("doc_id").isNull(), first: F.coalesce("doc_id", F.lit(0)), th: F.xxhash64(text_or_empty())})
    rows = tagged.join(times.where(F.col(n) > 0), [none, first, th])
    return rows.withColumn(n, F.explode(F.sequence(F.lit(1), F.col(n)))).select(*docs.columns)
