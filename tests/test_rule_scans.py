"""Rule scans, learned rules and tokens: cheap forms with the plain forms' results."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tracewarden import rulesets
from tracewarden.functions import text as tx
from tracewarden.operators import learning, rules
from tracewarden.operators import verdict as vd

EDGE = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"
CALL = r"(?i)(?<![A-Za-z0-9_])([a-z_]{3,20})\s*\("
VERB = r"(?i)(?<![A-Za-z0-9_])((?:union|select|insert|drop|delete|update|create)\s+\w+)"


def reads(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD")


def test_edges_before_groups_cost_one_look():
    for _, pattern, *_ in [r for r in rulesets.EVIDENCE if re.search(r"^\(\?i\)\\b\(\?:", r[1])]:
        assert not tx.java_regex(pattern).startswith("(?i)" + EDGE), pattern
    assert EDGE not in tx.java_regex(r"(?i)\b(?:or|and)\s+x+") and EDGE not in tx.java_regex(r"\b(?:0x[0-9a-f]+|0b[01]+)z")
    for kept in (r"\b(?:or|and)?x", r"\b(?:or|\.)x", r"\b(?:or|)x", r"x(?:\.\b|or)", r"\b[^a]", r"\b(?:a?b|c)"):
        assert EDGE in tx.java_regex(kept), kept


@pytest.mark.parametrize("pattern", sorted({r[1] for r in rulesets.EVIDENCE if r"\b" in r[1]}))
def test_edges_of_evidence(pattern):
    rng = random.Random(pattern)
    words = re.findall(r"[A-Za-z0-9_]+", pattern.replace(r"\b", " ")) + ["or", "x", "=", "(", "/etc/"]
    a, b = re.compile(pattern.replace(r"\b", EDGE), re.A), re.compile(tx.java_regex(pattern), re.A)
    for _ in range(60):
        t = "".join(rng.choice(words) + rng.choice(["", " ", "(", "=", "'", "\u00e9", ".", "_", "-", "1", ";", "/"]) for _ in range(12))
        assert [m.span() for m in a.finditer(t)] == [m.span() for m in b.finditer(t)]


def test_tokens(spark):
    rng = random.Random(5)
    texts = ["", None, "(", "run(", "x\u00e9run (", "9run(", "a" * 20 + "(", "a" * 21 + "(", "IF (Foo \n\t(", "f((ab_c(", "foo\u0085(", "foo\u00a0(", "../etc/passwd c:\\w /ETC/x", "DROP  table uselect x", "<SVG ><img>"]
    texts += ["".join(rng.choice(["foo", "If", "_x", "9", "(", " ", "\n", "\u00fc", "select", "Create", "..", "/", "/var/", "C:\\", "<iframe", ">", "a" * 9]) for _ in range(25)) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    all_of = lambda p: F.transform(F.regexp_extract_all("t", F.lit(p), 1), lambda x: F.lower(x))
    common = F.array(*map(F.lit, learning.COMMON_CALLS))
    calls = F.transform(F.filter(all_of(CALL), lambda c: ~F.array_contains(common, c)), lambda c: F.concat(c, F.lit("(")))
    want = F.array_distinct(F.concat(calls, all_of(VERB), all_of(learning.TOKEN_SHAPES["path"]), F.transform(all_of(learning.TOKEN_SHAPES["tag"]), lambda t: F.concat(F.lit("<"), t))))
    got = df.select("t", learning.tokens(F.col("t")).alias("a"), want.alias("b")).collect()
    assert [x["t"] for x in got if x["a"] != x["b"]] == []


def test_few_and_many_learned_rules(spark, monkeypatch):
    docs = [(1, "run TRACK(1) and go"), (1, "track(2)"), (2, "tracks"), (None, "track("), (3, "\u4e16\u754c \U0001f600x"), (4, None), (5, ""), (6, "a.b")]
    df = spark.createDataFrame(docs, "id int, text string")
    r = spark.createDataFrame([(p, "learned", 60) for p in ("track(", "Track", "\U0001f600x", "a.", ".", "none at all", "")], "pattern string, type string, severity int")
    few = rules.learned_rule_hits(df, ["id"], "text", r)
    assert reads(few) == 1  # the texts alone: the rules are written, not worked out again for each use
    monkeypatch.setattr(rules, "FEW_PIECES", 0)
    many = rules.learned_rule_hits(df, ["id"], "text", r)
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, many.collect()))
    assert {(x["id"], x["pattern"]) for x in few.collect()} == {(1, "track("), (1, "track"), (2, "track"), (3, "\U0001f600x"), (6, "a."), (6, ".")}


def test_marked_rules_as_one_by_one(spark):
    found = rulesets.detection_rules()
    texts = ["", None, "a walk by the lake", "eval( $x ) <?php ../ | ls; `id` or 1=1", "union select {{7*7}} 'or' 1=1 -- load_file", "<script src='x' onerror=1>"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    got = {(x["id"], x["rule_id"]) for x in rules.rule_hits(df, ["id"], "t").collect()}
    low = df.withColumn("t", F.lower("t"))
    want = low.select("id", F.explode(F.array(*[F.when(F.col("t").rlike(tx.java_regex(p)), F.lit(i)) for i, (p, _, _) in enumerate(found)])).alias("r")).filter("r is not null").collect()
    assert got == {(x["id"], x["r"]) for x in want} and len(got) > 10


def test_counted_runs(spark):
    texts = ["", "aB", "\u00e9aa\U0001f600bZ z", "ABC" * 9, None]
    got = [x[0] for x in spark.createDataFrame([(t,) for t in texts], "t string").select(tx.count_runs(F.col("t"), "[a-z]")).collect()]
    assert got == [None if t is None else len(re.findall("[a-z]", t)) for t in texts]


def test_verdict_scans_the_rules_once(spark):
    df = spark.createDataFrame([(1, "/a?x=1", "b")], "id int, u string, b string")
    assert reads(vd.request_verdicts(df, "id", "u", "b")) <= 3  # families of both parts and the evidence
