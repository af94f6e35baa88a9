import hashlib
import math
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tracewarden.llm import vector_codes as V


def brute(rows, rounds=V.ROUNDS):
    """Codes, errors, label errors and digests by plain integers: one list per row, in the rows' order."""
    kept = [(i, lab, [math.floor(V.SCALE * float(x)) for x in v]) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out, sums = [], defaultdict(int)
    for dim in {len(q) for _, _, q in kept}:
        own = [r for r in kept if len(r[2]) == dim]
        cut = V.bounds(dim)
        first = sorted(own, key=lambda r: (r[0] is None, r[0] or 0, r[2]))[: V.ENTRIES]
        books = [[r[2][a:b] for r in first] for a, b in zip(cut, cut[1:])]
        dist = lambda x, e: sum((p - q) ** 2 for p, q in zip(x, e))
        pick = lambda x, book: min(range(len(book)), key=lambda k: (dist(x, book[k]), k))
        for _ in range(rounds):
            for p, (a, b) in enumerate(zip(cut, cut[1:])):
                members = defaultdict(list)
                for r in own:
                    members[pick(r[2][a:b], books[p])].append(r[2][a:b])
                books[p] = [[sum(c) // len(members[k]) for c in zip(*members[k])] if k in members else e for k, e in enumerate(books[p])]
        sha = hashlib.sha256(",".join(str(c) for book in books for e in book for c in e).encode()).hexdigest()
        for i, lab, q in own:
            best = [pick(q[a:b], books[p]) for p, (a, b) in enumerate(zip(cut, cut[1:]))]
            error = sum(dist(q[a:b], books[p][k]) for p, (a, b, k) in enumerate(zip(cut, cut[1:], best)))
            out.append((i, lab, "".join(f"{k:02x}" for k in best), error, sha))
            sums[lab] += error
    return sorted((str(i), code, error, sums[lab], sha) for i, lab, code, error, sha in out)


def ours(spark, rows, label="int"):
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<double>, label {label}").repartition(3)
    for name in ("row", "dim", "q", "pos", "entry", "part", "code", "error", "moved", "_key"):
        df = df.withColumn(name, df["vec_id"])
    got = V.with_label_errors(V.coded(df))
    return sorted((str(r["vec_id"]), r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in got.collect())


@settings(max_examples=80, deadline=None)
@given(st.integers(1, 40), st.integers(0, 5), st.integers(1, 16), st.integers(0, 2**32), st.sampled_from([3, 1 << 20, 1 << 29, 1 << 45]))
def test_nearest_is_exact(n, m, k, seed, most):
    rng = np.random.default_rng(seed)
    x, book = rng.integers(-most, most + 1, (n, m)), rng.integers(-most, most + 1, (k, m)).tolist()
    best, d = V.nearest(x, book)
    for r, i, got in zip(x.tolist(), best.tolist(), d):
        every = [sum((a - b) ** 2 for a, b in zip(r, e)) for e in book]
        assert got == min(every) and i == every.index(min(every))


def test_awkward_vectors(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(0, 0.2, 16).round(2).tolist(), i % 3 if i % 4 else None) for i in range(90)]
    rows += [(500 + i, [0.25] * 16, 1) for i in range(60)]  # one vector holds much of the table
    rows += [(7, rows[7][1], 1), (7, rows[7][1], 1), (None, rows[8][1], 2), (None, None, 1)]  # repeats, null ids
    rows += [(900, [1.0, None] * 8, 1), (901, [float("nan")] * 16, 1), (902, [float("-inf")] * 16, None)]
    rows += [(910 + i, rng.normal(0, 1, 11).tolist(), 0) for i in range(5)] + [(920, [], 0), (921, [0.5], 0)]  # other lengths
    assert ours(spark, rows) == brute(rows)


def test_large_values(spark):
    rng = np.random.default_rng(2)
    rows = [(i, (rng.normal(0, 1, 8) * 10.0 ** int(rng.integers(0, 5))).tolist(), None) for i in range(60)]
    assert ours(spark, rows) == brute(rows)
    with pytest.raises(Exception, match="does not fit"):
        ours(spark, rows + [(99, [1e30] * 8, None)])


def test_empty_table_and_few_rows(spark):
    assert ours(spark, []) == []
    assert ours(spark, [(1, None, 1)]) == []
    rows = [(3, [0.1] * 8, "a"), (1, [0.2] * 8, None), (2, [0.1] * 8, "")]
    assert ours(spark, rows, "string") == brute(rows)


def test_small_owners(spark, monkeypatch):
    monkeypatch.setattr(V, "OWNER_ROWS", 7)
    rng = np.random.default_rng(4)
    rows = [(i, (rng.integers(0, 4, 2).repeat(4) + rng.normal(0, 0.1, 8)).tolist(), i % 2) for i in range(150)]
    assert ours(spark, rows) == brute(rows)
