"""Hashed text features that need no vocabulary: byte trigrams, bytes and a few shapes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from tracewarden.llm.common import MIX, STEP_BYTES, chunks, span_hashes, words

#: Buckets of hashed byte trigrams, single bytes, and shapes.
GRAMS = 1024
SHAPES = 6
SIZE = GRAMS + 256 + SHAPES
#: Added to the lengths that shares are taken of: a few bytes say little.
DAMP = 64


def _grams(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Bucket of the trigram that starts at each byte; those that cross a row's end get bucket 0's slot -1."""
    n = len(data)
    out = np.full(n, -1, np.int64)
    if n >= 3:
        x = data[:-2].astype(np.uint64) | data[1:-1].astype(np.uint64) << np.uint64(8) | data[2:].astype(np.uint64) << np.uint64(16)
        out[:-2] = ((x * MIX) >> np.uint64(64 - GRAMS.bit_length() + 1)).astype(np.int64)
        ends = off[1:]
        for back in (1, 2):
            at = ends - back
            out[at[(at >= 0) & (at >= off[:-1])]] = -1
    return out


def row_sums(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sum of each row's values."""
    total = np.zeros(len(off) - 1, np.float64)
    full = np.flatnonzero(off[1:] > off[:-1])
    if len(full):
        total[full] = np.add.reduceat(values, off[full])
    return total


def shapes(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Per row: log length, log words, bytes a word, share of words equal to the one before, share of
    words equal to the one two before, 1 for a text without words."""
    start, end = words(data, off)
    h = span_hashes(data, start, end)
    row = np.searchsorted(off, start, "right") - 1
    rows = len(off) - 1
    count = np.bincount(row, minlength=rows).astype(np.float64)
    out = np.zeros((rows, SHAPES))
    for k in (1, 2):
        same = np.flatnonzero((h[k:] == h[:-k]) & (row[k:] == row[:-k])) + k
        out[:, 2 + k] = np.bincount(row[same], minlength=rows) / (count + 3)
    length = (off[1:] - off[:-1]).astype(np.float64)
    out[:, 0] = np.log1p(length) / 10
    out[:, 1] = np.log1p(count) / 10
    out[:, 2] = np.log1p(length / np.maximum(count, 1)) / 10
    out[:, 5] = count == 0
    return out


def vectors(texts: pa.Array) -> np.ndarray:
    """Feature rows (float32): shares of trigram buckets and of bytes, then shapes."""
    out = np.zeros((len(texts), SIZE), np.float32)
    for at, end, data, off in chunks(texts, STEP_BYTES):
        rows = end - at
        row = np.repeat(np.arange(rows), np.diff(off))
        length = (np.diff(off) + DAMP)[:, None]
        g = _grams(data, off)
        ok = g >= 0
        flat = np.bincount(row[ok] * GRAMS + g[ok], minlength=rows * GRAMS).reshape(rows, GRAMS)
        out[at:end, :GRAMS] = flat / length
        out[at:end, GRAMS : GRAMS + 256] = np.bincount(row * 256 + data, minlength=rows * 256).reshape(rows, 256) / length
        out[at:end, GRAMS + 256 :] = shapes(data, off)
    return out


def scores(texts: pa.Array, weights: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """Linear scores, one column per class, of whole texts; the vectors are never built."""
    w = np.atleast_2d(weights)
    out = np.zeros((len(texts), len(w)))
    for at, end, data, off in chunks(texts, STEP_BYTES):
        length = np.diff(off) + DAMP
        g, s = _grams(data, off), shapes(data, off)
        for k, v in enumerate(w):
            grams = np.append(v[:GRAMS], 0.0)
            out[at:end, k] = row_sums(grams[g] + v[GRAMS : GRAMS + 256][data], off) / length + s @ v[GRAMS + 256 :] + bias[k]
    return out
