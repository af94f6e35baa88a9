import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tracewarden.llm import bit_sliced as B


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 150), st.integers(1, 6), st.integers(0, 2**31), st.integers(1, 2000))
def test_slices_add_up(n, size, seed, most):
    rng = np.random.default_rng(seed)
    q = rng.integers(-most, most + 1, (n, size))
    index, _ = B.slices_of(q)
    x = rng.integers(-most, most + 1, size)
    scores = B.block_scores(index, x)
    assert (B.values(scores, np.arange(n), 1 << (len(scores) - 1)) == q @ x).all()
    every = np.packbits(np.arange(index.shape[2] * 64) < n, bitorder="little").view(np.uint64)
    for k in (1, 10, n):
        assert set(B.select(scores, every, k).tolist()) == set(sorted(range(n), key=lambda i: (-(q @ x)[i], i))[:k])


def brute(vectors, k=10):
    ok = {i: np.floor(1024 * np.array(v, float)).astype(int) for i, v in vectors}
    rows = [(i, np.floor(1024 * np.array(v, float)).astype(int)) for i, v in vectors]
    out = {}
    for i in sorted(ok):
        if i % 100 == 0:
            best = sorted(((-int(x @ ok[i]), j) for j, x in rows if j != i))[:k]
            out[i] = [(j, -s) for s, j in best]
    return out


@pytest.mark.parametrize("n", [0, 1, 5, 300])
def test_against_brute_force(spark, n):
    rng = np.random.default_rng(n)
    good = [(i, rng.normal(0, 0.2, 4).round(2).tolist()) for i in range(n)]
    good += [(7000 + i, [0.25, 0.25, 0.25, 0.25]) for i in range(40 if n > 5 else 0)]  # ties
    odd = [(9000, None), (9100, [1.0, None, 0.0, 0.0]), (9200, [float("nan")] * 4), (9300, [float("inf"), 0.0, 0.0, 0.0]), (None, [0.1] * 4), (9400, [0.1]), (9500, [])]
    rows = spark.createDataFrame([(*r, "x") for r in good + odd], "vec_id long, embedding array<double>, q string").repartition(3)
    v = B.quantised(rows)
    got = {}
    for r in B.top_k(v, v.where("id % 100 = 0"), 10).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(got[r["query_id"]])
    assert got == {q: x for q, x in brute(good).items() if x}


def test_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(B, "BLOCK", 70)
    monkeypatch.setattr(B, "QUERY_BLOCK", 2)
    rng = np.random.default_rng(3)
    good = [(i * 20, rng.normal(0, 0.2, 3).tolist()) for i in range(400)]
    v = B.quantised(spark.createDataFrame(good, "vec_id long, embedding array<double>"))
    got = {}
    for r in B.top_k(v, v.where("id % 100 = 0"), 10).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert got == brute(good)


def test_large_values_and_mixed_lengths(spark, monkeypatch):
    monkeypatch.setattr(B, "BLOCK", 50)
    rng = np.random.default_rng(5)
    wide = [(i * 20, rng.normal(0, 3e5, 2).tolist()) for i in range(60)] + [(0, [2e6, 1.0]), (0, [2e6, 1.0])]
    long = [(10_000 + i * 20, rng.normal(0, 0.2, 5).tolist()) for i in range(60)]
    rows = spark.createDataFrame([(*r, 1) for r in wide + long], "vec_id long, embedding array<double>, size int").repartition(3)
    v = B.quantised(rows)
    got = {}
    for r in B.top_k(v, v.where("id % 100 = 0"), 10).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    # the repeated id asks three times, once a row; the others are compared
    for some in (wide, long):
        want = brute(some)
        assert all(got[i] == want[i] for i in want if i), some


def test_scores_beyond_64_bits_are_an_error(spark):
    rows = spark.createDataFrame([(0, [1e14, 1.0]), (1, [1e14, 1.0])], "vec_id long, embedding array<double>")
    v = B.quantised(rows)
    with pytest.raises(Exception, match="pass 64 bits"):
        B.top_k(v, v.where("id % 100 = 0"), 10).collect()
