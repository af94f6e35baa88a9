"""Structural features and their comparison with known payloads: cheap forms with the plain forms' results."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tracewarden import family_rules, rulesets
from tracewarden.functions import text as tx
from tracewarden.operators import joins

EDGE = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"
ODD = ["", "ORDER or\nand-OR_ or9 ünion UNION", "éor orö OR", "a" * 30, "<<img <script> ''\"\" ;;|| a | b ..../ ... \\\\ = == href= x-y=", "KK lIİke selectſ", "世界 😀 % %4f %u00e9 %zz", None, "rm -rf # -- `id` $(x)", "ab" * 10, "dead" * 5]


def plain(pattern):
    return pattern.replace(r"\b", EDGE)


@pytest.mark.parametrize("pattern", sorted({p for p, _, _ in rulesets.detection_rules()} | {r[3] for r in family_rules.rule_rows()} | set(tx.FLAG_PATTERNS.values()) | {tx.DENSE_WORDS}))
def test_word_edges(pattern):
    if r"\b" not in pattern:
        assert tx.java_regex(pattern) == pattern
        return
    rng = random.Random(pattern)
    words = [w for w in re.findall(r"[A-Za-z0-9_]+", pattern.replace(r"\b", " "))] + ["or", "x"]
    a, b = re.compile(plain(pattern), re.A), re.compile(tx.java_regex(pattern), re.A)
    for _ in range(60):
        t = "".join(rng.choice(words) + rng.choice(["", " ", "(", "=", "'", "é", ".", "_", "-", "<", "[", "/"]) for _ in range(12))
        assert [m.span() for m in a.finditer(t)] == [m.span() for m in b.finditer(t)]


def test_word_edges_cost_one_look():
    assert EDGE not in tx.java_regex(r"(?i)\bOR\b") and EDGE not in tx.java_regex(tx.DENSE_WORDS)
    for kept in (r"\bs?x", r"\b(?:a|\w+)\b", r"\x2E\b", r"[ab]\b", r"\bx*y"):
        assert EDGE in tx.java_regex(kept)


def test_features(spark):
    df = spark.createDataFrame(list(enumerate(ODD)), "id int, t string")
    got = {r["id"]: r for r in df.select("id", *[c.alias(n) for n, c in tx.structural_features(F.col("t")).items()]).collect()}
    for i, t in enumerate(ODD):
        if t is None:
            assert all(v is None for k, v in got[i].asDict().items() if k != "id")
            continue
        for n, chars in tx.COUNTED_CHARS.items():
            assert got[i][n] == sum(t.count(c) for c in chars)
        for n, p in tx.FLAG_PATTERNS.items():
            low = re.compile("(?a)" + plain(p)) if "(?i)" not in p else re.compile(plain(p), re.A)
            assert got[i][n] == int(bool(low.search(t))), (t, n)
        kept = re.sub(r"[a-zA-Z0-9\s]", "", t, flags=re.A)
        assert got[i]["special_ratio"] == len(kept.encode()) / max(1, len(t.encode()))
    plan = df.select(tx.structural_features(F.col("t"))["quote_count"])._jdf.queryExecution().toString()
    assert "translate" not in plan.lower()


def test_similarity(spark):
    payloads = joins.KNOWN_PAYLOADS
    texts = [(i, t) for i, t in enumerate(ODD)] + [(100 + i, p) for i, (_, _, p) in enumerate(payloads)] + [(100, "<b>"), (None, "`id`"), (None, "x")]
    df = spark.createDataFrame(texts, "id int, t string")
    feats = [n for n in tx.structural_features(F.lit(""))]
    rows = lambda d: [[r[n] for n in feats] for r in d.select(*[c.cast("double").alias(n) for n, c in tx.structural_features(F.col("t")).items()]).collect()]
    mine = rows(df.coalesce(1))
    known = rows(spark.createDataFrame([(p,) for _, _, p in payloads], "t string").coalesce(1))
    want = {}
    for (i, _), a in zip(texts, mine):
        for (fam, name, _), b in zip(payloads, known):
            m = t = 0.0
            for n, x, y in zip(feats, a, b):
                w = joins.FEATURE_WEIGHTS.get(n, 1)
                share = n in tx.RATIO_FEATURES and x
                m += (1 - min(1.0, abs(x - y) / max(x, y, 1.0))) * w if share else w if x == y and x else 0
                t += w if share or x or y else 0
            want[i, fam] = max(want.get((i, fam), (0.0, "")), (m / t if t else 0.0, name))
    out = joins.pattern_similarity(df, ["id"], "t", payloads, joins.FEATURE_WEIGHTS, 0.3)
    got = {(r["id"], r["family"]): (r["similarity"], r["pattern"]) for r in out.collect()}
    assert got == {k: (pytest.approx(s, abs=1e-12), n) for k, (s, n) in want.items() if s >= 0.3}
    # a row a family leaves a text, not one a payload
    assert "zip_with" not in out._jdf.queryExecution().toString()
