import zlib

import numpy as np
import pyarrow as pa

from tracewarden.llm import features, pu_quality

SF = "/root/testdata/sf0.01"


def test_scores_are_the_product_of_vectors_and_weights():
    texts = pa.array(["abc abc abc", "", None, "ÄÖ", "a", "x y z " * 400])
    w = np.random.default_rng(1).normal(size=(2, features.SIZE))
    assert np.allclose(features.scores(texts, w, np.array([1.0, 2.0])), features.vectors(texts).astype(float) @ w.T + [1, 2], atol=1e-4)


def test_risk_is_not_negative_and_separates():
    rng = np.random.default_rng(2)
    good, bad = rng.normal(0, 1, (600, features.SIZE)), rng.normal(0, 1, (200, features.SIZE))
    bad[:, :5] += 4
    good[:, 20:] = bad[:, 20:] = 0  # far fewer features than rows
    unlabelled = np.vstack([good[300:], bad[:100]]).astype(np.float32)
    m = pu_quality.fit(good[:300].astype(np.float32), unlabelled, 0.75)
    hold = lambda x: (x @ m.weights + m.bias)
    assert np.mean(hold(bad[100:]) < np.median(hold(good[300:]))) > 0.95


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = pu_quality.train(docs, labels)
    got = pu_quality.score(docs, model, ["doc_id"]).join(labels, "doc_id").withColumn("held_out", pu_quality.held_out()).toPandas()
    assert (got["held_out"] == [zlib.crc32(str(d).encode()) % 5 == 0 for d in got["doc_id"]]).all()
    got = got[got["held_out"]]
    pos, neg = (got[got["quality"] == q]["score"].to_numpy() for q in (1, 0))
    assert (pos[:, None] > neg[None, :]).mean() > 0.95
    assert (pos >= 0.3).mean() > 0.97


def test_labels_of_held_out_ids_change_nothing(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    from pyspark.sql import functions as F

    flipped = labels.withColumn("quality", F.when(pu_quality.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = pu_quality.train(docs, labels), pu_quality.train(docs, flipped)
    assert np.array_equal(a.weights, b.weights) and a.bias == b.bias


def test_awkward_rows(awkward, labels, no_docs, no_labels):
    model = pu_quality.train(awkward, labels)
    rows = pu_quality.score(awkward, model, awkward.columns).collect()
    assert len(rows) == awkward.count()
    scores = [r["_score"] for r in rows]
    assert all(0 <= s <= 1 for s in scores)
    empty = {r["_score"] for r in rows if not r["text"]}
    assert len(empty) == 1
    kept = pu_quality.keep_good(awkward, labels)
    assert kept.columns == awkward.columns
    assert pu_quality.train(awkward, no_labels) is None and pu_quality.train(no_docs, labels) is None
    assert pu_quality.keep_good(awkward, no_labels).count() == awkward.count()
    assert pu_quality.keep_good(no_docs, labels).count() == 0
