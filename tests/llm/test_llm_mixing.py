import numpy as np
from pyspark.sql import functions as F

from tracewarden.llm import source_mixing as M


def table(spark, p, tokens):
    return spark.createDataFrame([(int(t), [float(x) for x in q]) for t, q in zip(tokens, p)], "tokens long, p array<double>")


def run(p, steps):
    r = y = np.ones(len(p))
    for m, g in steps:
        new = np.maximum(0, y - np.asarray(p) @ g)
        r, y = new, new + m * (new - r)
    return r


def test_totals_match_targets(spark):
    rng = np.random.default_rng(0)
    p = rng.dirichlet([0.3] * 4, 500)
    tokens = rng.integers(0, 900, 500)
    steps, error = M.fit(table(spark, p, tokens), np.array([0.1, 0.2, 0.3, 0.4]))
    r = run(p, steps)
    assert error < 1e-6 and (r >= 0).all()
    assert np.allclose((p * (tokens * r)[:, None]).sum(0) / tokens.sum(), [0.1, 0.2, 0.3, 0.4], atol=1e-5)


def test_rates_that_would_be_negative_stop_at_zero(spark):
    p = np.array([[0.9, 0.1]] * 50 + [[0.1, 0.9]] * 50)
    steps, error = M.fit(table(spark, p, np.full(100, 10)), np.array([0.12, 0.88]))
    r = run(p, steps)
    assert error < 1e-6 and r.min() >= 0 and (r[:50] < 0.1).all()


def test_unreachable_targets_end(spark):
    steps, error = M.fit(table(spark, [[0.6, 0.4]] * 20, [5] * 20), np.array([0.0, 1.0]), rounds=5)
    assert len(steps) <= 5 and np.isfinite(error)


def test_far_targets_are_reached_and_missed_ones_told(spark):
    rng = np.random.default_rng(1)
    p = rng.beta(0.2, 0.2, 2000)
    p = np.stack([p, 1 - p], 1)
    tokens = rng.integers(1, 900, 2000)
    rows = table(spark, p, tokens).coalesce(1).cache()
    steps, error = M.fit(rows, np.array([0.98, 0.02]))
    total = (p * (tokens * run(p, steps))[:, None]).sum(0) / tokens.sum()
    assert error < 1e-5 and np.allclose(total, [0.98, 0.02], atol=1e-4)
    _, error = M.fit(table(spark, [[0.6, 0.4]] * 20, [5] * 20).coalesce(1).cache(), np.array([0.0, 1.0]))
    assert error > 0.2


def test_given_tables(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    goal = {"en": 0.4, "de": 0.2, "fr": 0.2, "es": 0.2}
    rated, names = M.rates(docs, labels, "lang", goal)
    rows = rated.join(docs.select("doc_id", "lang", "text"), "doc_id").collect()
    assert sum(names[int(np.argmax(r["p"]))] == r["lang"] for r in rows) / len(rows) > 0.97
    assert all(r["tokens"] == len(r["text"].encode().split()) for r in rows)
    total = np.array([[x * r["tokens"] * r["rate"] for x in r["p"]] for r in rows]).sum(0)
    assert np.allclose(total / sum(r["tokens"] for r in rows), [goal[n] for n in names], atol=1e-4)
    mixed = M.mix(docs, labels, "lang", goal)
    assert mixed.columns == docs.columns
    share = {r["lang"]: r["n"] for r in mixed.groupBy("lang").agg(F.sum("n_chars").alias("n")).collect()}
    assert 0.3 < share["en"] / sum(share.values()) < 0.5


def test_awkward_rows(awkward, labels, no_docs, no_labels):
    goal = {"en": 1.0, "xx": 3.0}
    rated, names = M.rates(awkward, labels, "lang", goal)
    rows = rated.collect()
    assert len(rows) == awkward.count() and all(r["rate"] >= 0 for r in rows)
    assert M.mix(awkward, labels, "lang", goal).columns == awkward.columns
    # without labels every rate is 1, and every row stays once (equal rows count as they are)
    kept = M.mix(awkward, no_labels, "lang", goal)
    assert kept.count() == awkward.count()
    assert M.mix(no_docs, labels, "lang", goal).count() == 0
