"""Piecewise windows against brute force, with a hot key, ties and several piece lengths."""

import random

import pytest
from pyspark.sql import functions as F

from tracewarden.operators import behaviour, chains, joins, learning
from tracewarden.operators import sequences as sq
from tracewarden.operators import timeline as tl


def rows(seed, n=400):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        key = 1 if rnd.random() < 0.4 else rnd.randrange(2, 8)
        out.append((i, key, rnd.randrange(0, 2000), rnd.randrange(0, 6), round(rnd.random() * 100, 2)))
    return out


@pytest.fixture(scope="module")
def data(spark):
    r = rows(7)
    return r, spark.createDataFrame(r, "id bigint, key bigint, t bigint, v bigint, x double").repartition(5)


@pytest.mark.parametrize("closed", [False, True])
@pytest.mark.parametrize("piece", [50, 333, 5000])
def test_sliding_sums_and_distinct(data, piece, closed):
    r, df = data
    width = 50

    def near(a, b):
        age = a[2] - b[2]
        return a[1] == b[1] and 0 <= age and (age <= width if closed else age < width)

    s = tl.sliding_sums(df, ["key"], "t", {"n": (width, F.lit(1)), "s": (30, F.col("v"))}, closed=closed, piece=piece)
    d = tl.sliding_distinct(s, ["key"], "t", "v", width, "dv", closed=closed, piece=piece)
    got = {x["id"]: (x["n"], x["dv"]) for x in d.collect()}
    want = {a[0]: (sum(near(a, b) for b in r), len({b[3] for b in r if near(a, b)})) for a in r}
    assert got == want


@pytest.mark.parametrize("piece", [20, 700])
def test_previous_running_sessions(data, piece):
    r, df = data
    d = tl.with_previous(df, ["key"], "t", "id", {"pv": "v"}, piece)
    d = tl.running(d, ["key"], "t", "id", {"rs": ("sum", F.col("v")), "rm": ("max", F.col("v"))}, piece)
    d = tl.numbered(d, ["key"], "t", "id", "rn", piece)
    d = tl.sessions(d, ["key"], "t", "id", 8, "ses", piece)
    want = {}
    for key in {x[1] for x in r}:
        mine = sorted((x for x in r if x[1] == key), key=lambda x: (x[2], x[0]))
        total, best, ses = 0, -1, 0
        for i, x in enumerate(mine):
            total, best = total + x[3], max(best, x[3])
            ses += i == 0 or x[2] - mine[i - 1][2] > 8
            want[x[0]] = (mine[i - 1][3] if i else None, total, best, i + 1, ses)
    assert {x["id"]: (x["pv"], x["rs"], x["rm"], x["rn"], x["ses"]) for x in d.collect()} == want


@pytest.mark.parametrize("piece", [15, 900])
def test_trailing_baseline_reaches_over_empty_pieces(data, piece):
    r, df = data
    got = {x["id"]: x["base_x"] for x in behaviour.trailing_baseline(df, ["key"], "t", "id", ["x"], n=4, piece=piece).collect()}
    for key in {x[1] for x in r}:
        mine = sorted((x for x in r if x[1] == key), key=lambda x: (x[2], x[0]))
        for i, x in enumerate(mine):
            prior = mine[max(0, i - 4):i]
            if not prior:
                assert got[x[0]] is None
                continue
            w = [0.5 + 0.5 * (j + 1) / len(prior) for j in range(len(prior))]
            assert got[x[0]] == pytest.approx(sum(a * b[4] for a, b in zip(w, prior)) / sum(w))


def test_decayed_sum(data):
    r, df = data
    got = {x["id"]: x["accumulated"] for x in behaviour.decayed_sum(df, ["key"], "t", "x", F.col("x") > 30, window=300, half_life=100).collect()}
    for a in r:
        # Rows at the very instant of the row count as its peers.
        want = sum(b[4] * 0.15 * 2 ** ((b[2] - a[2]) / 100) for b in r if b[1] == a[1] and b[0] != a[0] and 0 <= a[2] - b[2] <= 300 and b[4] > 30)
        assert got[a[0]] == pytest.approx(want, abs=1e-6)


def test_result_does_not_depend_on_layout(spark, data):
    _, df = data
    ref = sorted(map(tuple, sq.sliding_rate(df, ["key"], "t", 40, 3).collect()))
    for n in (1, 3, 16):
        spark.conf.set("spark.sql.shuffle.partitions", str(n))
        assert sorted(map(tuple, sq.sliding_rate(df.orderBy(F.rand(n)), ["key"], "t", 40, 3).collect())) == ref
    spark.conf.set("spark.sql.shuffle.partitions", "8")


@pytest.mark.parametrize("bins", [2, 1024])
def test_exact_quantile(spark, bins):
    import numpy as np

    rnd = random.Random(1)
    for n in (5, 200, 5000):
        xs = [round(rnd.gauss(0, 10), 1) for _ in range(n)]
        df = spark.createDataFrame([(x,) for x in xs], "x double").repartition(4)
        got = behaviour.exact_quantile(df, "x", 0.95, bins)
        assert got == pytest.approx(float(np.quantile(xs, 0.95)))


def test_feedback_folds_like_single_steps(spark):
    rnd = random.Random(3)
    fb = [(i, rnd.choice("ab"), rnd.random() < 0.5) for i in range(500)]
    df = spark.createDataFrame([(i, k, i * 1000, f) for i, k, f in fb], "id bigint, kind string, t bigint, fp boolean")
    want = {}
    for _, k, f in fb:
        want[k] = max(-5, min(5, want.get(k, 0) + (-1 if f else 1)))
    got = {x["kind"]: round(x["adjustment"] * 10) for x in learning.feedback_adjustment(df, "kind", "t", "id", "fp", fold=4, levels=4).collect()}
    assert got == want


def lcs(a, b):
    m = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            m[i + 1][j + 1] = m[i][j] + 1 if x == y else max(m[i][j + 1], m[i + 1][j])
    return m[-1][-1]


def test_chain_matches_and_switches(spark):
    from tracewarden.tables import CHAIN_PHASES, CHAIN_TEMPLATES

    rnd = random.Random(5)
    seqs = {k: [rnd.choice(CHAIN_PHASES) for _ in range(rnd.randrange(2, 14))] for k in range(25)}
    df = spark.createDataFrame([(k, i, p) for k, s in seqs.items() for i, p in enumerate(s)], "k int, t bigint, phase string").withColumn("id", F.col("t"))

    def collapse(s):
        return [p for i, p in enumerate(s) if i == 0 or p != s[i - 1]]

    def best(s):
        c = collapse(s)
        top = (0.0, None)
        for key, ph, _ in CHAIN_TEMPLATES if len(c) >= 2 else []:
            n = lcs(c, ph)
            if n >= 2 and n / max(len(c), len(ph)) > top[0]:
                top = (n / max(len(c), len(ph)), key)
        return top[1] if top[0] >= 0.3 else None

    want, switches = set(), {}
    for k, s in seqs.items():
        c = collapse(s)
        found = [(key, lcs(c, ph), max(len(c), len(ph))) for key, ph, _ in CHAIN_TEMPLATES] if len(c) >= 2 else []
        want |= {(k, key, n) for key, n, _ in found if n >= 2}
        active = sum(n >= 2 and n / m >= 0.3 for _, n, m in found)
        a, b = best(s[:len(s) // 2]), best(s[len(s) // 2:])
        sw = len(s) >= 6 and active >= 1 and a is not None and b is not None and a != b
        switches[k] = (active, sw, min(40, (20 if active >= 2 else 0) + (15 if sw else 0)))
    got = chains.chain_matches(df, ["k"], "t", "id", "phase").collect()
    assert {(x["k"], x["template"], x["lcs"]) for x in got} == want
    assert {x["k"]: (x["chains"], x["switched"], x["switch_anomaly"]) for x in chains.chain_switches(df, ["k"], "t", "id", "phase").collect()} == switches


def test_chain_risk_of_a_full_chain(spark):
    from tracewarden.tables import chain_pairs

    probs = {(a, b): p for a, b, p in chain_pairs()}
    phases = ["RECON", "SCAN", "ENUM", "INJECT", "EXPLOIT", "EXFIL"]
    df = spark.createDataFrame([(1, i * 30_000_000, i, p, f"/{i}", 50) for i, p in enumerate(phases)] + [(2, 0, 9, "RECON", "/", 0)],
                               "k int, t bigint, id int, phase string, prefix string, logic int")
    got = {x["k"]: x for x in chains.chain_risk(df, ["k"], "t", "id", "phase", "prefix", "logic", probs).collect()}
    assert (got[1]["chain"], got[1]["similarity"], got[1]["progress"], got[1]["score"], got[1]["band"], got[1]["block_early"]) == (
        "sql_injection_recon", 1.0, 100, 100, "critical", True)
    assert got[1]["base"] == 100 and got[1]["lateral"] == 35 and got[1]["transition"] == 10
    assert (got[2]["chain"], got[2]["score"], got[2]["band"], got[2]["block_early"]) == (None, 10, "clean", False)


def test_ban_intervals(spark):
    rnd = random.Random(9)
    bans = [(rnd.randrange(3), s := rnd.randrange(500), None if rnd.random() < 0.05 else s + rnd.randrange(1, 60)) for _ in range(40)]
    req = [(i, rnd.randrange(4), rnd.randrange(600)) for i in range(300)]
    b = spark.createDataFrame(bans, "key int, start bigint, expire bigint")
    r = spark.createDataFrame(req, "id bigint, key int, t bigint")
    got = {x["id"] for x in joins.under_ban(r, "key", "t", "id", b, spark.createDataFrame([(2,)], "key int"), piece=70).collect()}
    assert got == {i for i, k, t in req if k != 2 and any(k == bk and s <= t and (e is None or t < e) for bk, s, e in bans)}


def test_range_lookup_last_listed_wins(spark):
    rnd = random.Random(2)
    rg = [(s := rnd.randrange(0, 900), s + rnd.randrange(0, 200), f"c{i % 5}", i) for i in range(30)]
    nums = [(i, rnd.randrange(0, 1200)) for i in range(200)]
    got = {x["id"]: x["value"] for x in joins.range_lookup(spark.createDataFrame(nums, "id int, n bigint"), "n",
                                                         spark.createDataFrame(rg, "start bigint, end bigint, value string, seq int"), 37).collect()}
    for i, n in nums:
        hit = [c for s, e, c, _ in rg if s <= n <= e]
        assert got[i] == (hit[-1] if hit else None)
