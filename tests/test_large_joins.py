"""Joins and selections whose plain forms multiply rows or order everything in one task."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewarden.operators import behaviour, joins, learning, rules


@pytest.mark.parametrize("coarse", [1, 4, 1024])
def test_nested_ranges(spark, coarse):
    rng = random.Random(coarse)
    rg = [(a << 24, (a + 1 << 24) - 1) for a in range(8)] + [(x, x) for x in (rng.randrange(1 << 27) for _ in range(200))]
    rg += [(s, s + rng.randrange(1 << 20)) for s in (rng.randrange(1 << 27) for _ in range(100))] + [(-50, 70), (5, 4), (0, (1 << 61))]
    rng.shuffle(rg)
    ranges = [(s, e, f"v{i}" if i % 9 else None, i) for i, (s, e) in enumerate(rg)]
    nums = [rng.choice(rg)[rng.randrange(2)] + rng.randrange(-1, 2) for _ in range(400)] + [0, -51, -50, None, 7, 7, 7]
    df = spark.createDataFrame(list(enumerate(nums)), "id int, n bigint")
    r = spark.createDataFrame(ranges, "start bigint, end bigint, value string, seq int")
    got = {x["id"]: x["value"] for x in joins.range_lookup(df, "n", r, coarse).collect()}
    inside = {x["id"] for x in joins.in_ranges(df, "n", r, True, coarse).collect()}
    outside = {x["id"] for x in joins.in_ranges(df, "n", r, False, coarse).collect()}
    assert len(got) == len(nums)
    for i, n in enumerate(nums):
        hit = [v for s, e, v, _ in ranges if n is not None and s <= n <= e]
        assert got[i] == (hit[-1] if hit else None)
        assert (i in inside) == bool(hit) and (i in outside) != bool(hit)


def test_blocks_of_ranges(spark):
    got = joins.dyadic_blocks(spark.createDataFrame([(5, 21), (8, 8), (-3, 2), (4, 3)], "start bigint, end bigint")).collect()
    held = {}
    for x in got:
        held.setdefault((x["start"], x["end"]), []).extend(range(x["prefix"] << x["level"], x["prefix"] + 1 << x["level"]))
    assert {k: sorted(v) for k, v in held.items()} == {(5, 21): list(range(5, 22)), (8, 8): [8], (-3, 2): list(range(-3, 3))}


def test_many_nested_ranges_stay_linear(spark):
    one = spark.range(100_000).select((F.col("id") * 40).alias("start"), (F.col("id") * 40).alias("end"))
    eight = spark.range(2000).select(F.lit(0).cast("bigint").alias("start"), F.lit((1 << 24) - 1).cast("bigint").alias("end"))
    r = one.unionByName(eight).withColumn("seq", F.monotonically_increasing_id()).withColumn("value", F.col("seq").cast("string"))
    assert joins.dyadic_blocks(r).count() == 102_000
    got = joins.range_lookup(spark.range(0, 4_000_000, 1000).withColumnRenamed("id", "n"), "n", r)
    assert got.filter("value IS NOT NULL").count() == 4000


def test_rules_are_filed_under_their_rarest_piece(spark):
    docs = [(i, "aaaa common text " + ("<script zq9x" if i % 50 == 0 else "plain")) for i in range(200)] + [(900, None), (901, "")]
    pats = ["aaaa common text <script zq9x", "zq9x", "a", "xt pl", "never", "aaaa common text plainer", ""]
    r = spark.createDataFrame([(p, "t", 1) for p in pats], "pattern string, type string, severity int")
    df = spark.createDataFrame(docs, "id int, text string")
    got = {(x["id"], x["pattern"]) for x in rules.learned_rule_hits(df, ["id"], "text", r).collect()}
    assert got == {(i, p) for i, t in docs if t for p in pats if p and p in t}
    assert rules.learned_rule_hits(df, ["id"], "text", r.filter("pattern = ''")).count() == 0


def template_brute(requests, learned, least=10, share=0.8):
    out = {}
    for i, m, t, names in requests:
        for lm, lt, want, samples, bad in learned:
            if (lm, lt) == (m, t) and samples >= least and not bad:
                if not want or len(set(want) & set(names)) / max(len(want), 1) >= share:
                    out[i] = max(out.get(i, 0), samples)
    return out


def test_template_sets(spark):
    rng = random.Random(4)
    names = [f"n{k}" for k in range(12)]
    some = lambda k: rng.sample(names, rng.randrange(k))
    requests = [(i, rng.choice(["GET", "POST"]), rng.choice(["/a", "/b"]), some(12)) for i in range(300)]
    learned = [(rng.choice(["GET", "POST"]), "/a" if rng.random() < 0.9 else "/b", some(10), rng.randrange(5, 90), rng.random() < 0.2) for _ in range(60)]
    df = spark.createDataFrame(requests, "id int, m string, t string, names array<string>")
    kept = spark.createDataFrame(learned, "m string, t string, names array<string>, samples bigint, degraded boolean")
    got = {x["id"]: x["samples"] for x in learning.template_match(df, ["id"], "m", "t", "names", kept).collect()}
    assert got == template_brute(requests, learned)


def test_a_hot_template_does_not_multiply(spark):
    """One shape with very many learned sets that all hold two common names and one of their own."""
    learned = spark.range(100_000).select(F.lit("GET").alias("m"), F.lit("/a").alias("t"), F.array(F.lit("page"), F.lit("lang"), F.concat(F.lit("x"), "id")).alias("names"), F.lit(20).alias("samples"), F.lit(False).alias("degraded"))
    df = spark.range(500).select("id", F.lit("GET").alias("m"), F.lit("/a").alias("t"), F.array(F.lit("page"), F.lit("lang"), F.concat(F.lit("x"), F.col("id") * 7)).alias("names"))
    assert learning.template_match(df, ["id"], "m", "t", "names", learned).count() == 500


@pytest.mark.parametrize("values", [[], [3.0], [1.0] * 9 + [2.0], [10.0 ** k for k in range(-200, 200, 7)], [-1e308, 1e308, 0.0, 5e-324, -5e-324], [None, float("nan"), 4.0, 1.0]])
def test_quantiles(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "x double")
    kept = [v for v in values if v is not None and not math.isnan(v)]
    for q in (0.0, 0.5, 0.95, 1.0):
        got = behaviour.exact_quantile(df, "x", q, 16)
        assert got is None if not kept else got == pytest.approx(float(np.quantile(kept, q)), rel=1e-9)
