"""URL filters: rules first, then logistic regression on hashed character n-grams of host and path.

A rule (host, path, verdict) fits its host and all subdomains if the url's path starts with the
rule's path; the longest rule wins (then the one with the longer host). Where no rule fits, the
verdict is the classifier's, trained from a small table of labelled urls: character n-grams of
the host and of the path, marked by which of the two they come from and with their borders, are
hashed into a fixed number of weights.

Nulls: a null url, or one without "://", has an empty host and path and is judged like any other.
Urls of any length are read whole. Labelled urls without label are left out; without labelled urls the classifier allows everything.
Repeated rows give equal rows. Further columns play no part.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewarden.llm.common import MIX, chunks, mixed
from tracewarden.llm.features import row_sums

#: Bound of the labelled urls that are fitted on.
FIT_ROWS = 4096
BUCKETS = 1 << 16
GRAMS = (3, 4, 5)
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    allow: bool

    @property
    def text(self) -> str:
        return self.host + self.path


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path of a url; both empty without "://"."""
    host = F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _UPPER.lower())
    return host, F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def first_rule(rules: list[Rule], host: Column, path: Column) -> Column:
    """Struct (rule, allow) of the longest rule that fits, else null."""
    out = None
    for rule in sorted(rules, key=lambda r: (-len(r.text), -len(r.host), r.text)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        value = F.struct(F.lit(rule.text).alias("rule"), F.lit(rule.allow).alias("allow"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return F.lit(None).cast("struct<rule:string,allow:boolean>") if out is None else out


def grams(column: pa.Array, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of all n-grams of a string column, with a mark before and after each string."""
    rows, buckets = [], []
    for at, end, data, off in chunks(column):
        n = end - at
        size = np.diff(off) + 2
        new = np.concatenate([[0], np.cumsum(size)])
        marked = np.empty(new[-1], np.uint64)
        marked[new[:-1]], marked[new[1:] - 1] = 1, 2
        inner = np.ones(new[-1], bool)
        inner[new[:-1]] = inner[new[1:] - 1] = False
        marked[inner] = data
        row = np.repeat(np.arange(n), size)
        for g in GRAMS:
            if len(marked) < g:
                continue
            h = np.zeros(len(marked) - g + 1, np.uint64)
            for k in range(g):
                h = (h << np.uint64(8)) | marked[k : k + len(h)]
            ok = row[: len(h)] == row[g - 1 :]
            h = mixed(h[ok] * MIX + np.uint64(salt * 31 + g))
            rows.append(row[: len(ok)][ok] + at)
            buckets.append((h % np.uint64(BUCKETS)).astype(np.int64))
    none = np.zeros(0, np.int64)
    return (np.concatenate(rows), np.concatenate(buckets)) if rows else (none, none)


def both_grams(host: pa.Array, path: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    (a, x), (b, y) = grams(host, 1), grams(path, 2)
    row, bucket = np.concatenate([a, b]), np.concatenate([x, y])
    order = np.argsort(row, kind="stable")
    return row[order], bucket[order]


def linear(host: pa.Array, path: pa.Array, weights: np.ndarray, bias: float) -> np.ndarray:
    """Log odds that a url is to be blocked: weights of its n-grams over the root of their number."""
    row, bucket = both_grams(host, path)
    off = np.searchsorted(row, np.arange(len(host) + 1))
    return row_sums(weights[bucket], off) / np.sqrt(np.maximum(np.diff(off), 1)) + bias


@dataclass
class UrlModel:
    weights: np.ndarray
    bias: float


def train(labelled: DataFrame, rows: int = FIT_ROWS, steps: int = 1500, rate: float = 1.0, decay: float = 3e-5, prior: float = 0.3) -> UrlModel:
    """Model from a table (url, block): at most `rows` different urls, chosen by hash, fitted on the driver.

    `prior` is the share of urls to be blocked that the model reckons with, whatever the table's share.
    """
    host, path = parts(F.col("url"))
    known = labelled.where(F.col("block").isNotNull()).groupBy(host.alias("host"), path.alias("path")).agg(F.max(F.col("block").cast("int")).alias("block"))
    sample = known.orderBy(F.xxhash64("host", "path"), "host", "path").limit(rows).collect()
    if not sample:
        return UrlModel(np.zeros(BUCKETS), -1.0)
    y = np.array([r["block"] for r in sample], float)
    row, bucket = both_grams(pa.array([r["host"] for r in sample]), pa.array([r["path"] for r in sample]))
    scale = 1 / np.sqrt(np.maximum(np.bincount(row, minlength=len(y)), 1))
    w, b, mw, mb = np.zeros(BUCKETS), 0.0, np.zeros(BUCKETS), 0.0
    share = np.where(y == 1, 1 / max(1, y.sum()), 1 / max(1, (1 - y).sum())) * np.where(y == 1, prior, 1 - prior)
    for _ in range(steps):
        z = np.bincount(row, w[bucket], len(y)) * scale + b
        e = (1 / (1 + np.exp(-z)) - y) * share
        mw = 0.9 * mw + np.bincount(bucket, (e * scale)[row], BUCKETS) + decay * w
        mb = 0.9 * mb + e.sum()
        w, b = w - rate * mw, b - rate * mb
    return UrlModel(w, b)


def judge(pages: DataFrame, rules: list[Rule], model: UrlModel, threshold: float = 0.5) -> DataFrame:
    """page_id, host, path, rule, verdict and score (the classifier's, 0 to 1: higher for block)."""

    def run(batches):
        for b in batches:
            z = linear(b.column("host"), b.column("path"), model.weights, model.bias)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(1 / (1 + np.exp(-np.clip(z, -500, 500))))], [*b.schema.names, "score"])

    host, path = parts(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    scored = rows.mapInArrow(run, rows.select("*").schema.add("score", "double"))
    fits = first_rule(rules, F.col("host"), F.col("path"))
    blocked = F.coalesce(~F.col("fit.allow"), F.col("score") >= threshold)
    return scored.withColumn("fit", fits).select("page_id", "host", "path", F.col("fit.rule").alias("rule"), F.when(blocked, "block").otherwise("allow").alias("verdict"), "score")
