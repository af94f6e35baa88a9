"""Verdicts and decisions on literal requests."""

import pytest
from pyspark.sql import functions as F

from tracewarden.operators import rules
from tracewarden.operators import verdict as vd
from tracewarden.tables import NEXT_PATHS

REQUESTS = [
    (1, "/shop/item?id=1", "", False), (2, "/search?q=blue+shoes", "", False), (3, "/contact", "name=Ann&message=Hello there, see you soon", False), (4, None, None, False),
    (5, "/list?id=1' union select 1,2 from users--", "", True), (6, "/page?q=<script>alert(1)</script>", "", True), (7, "/file?path=../../etc/passwd", "", True),
    (8, "/x", "<?php system($_GET[1]);", True), (9, "/api", '<!DOCTYPE a [<!ENTITY b SYSTEM "file:///etc/passwd">]><a>&b;</a>', True),
]


@pytest.fixture(scope="module")
def verdicts(spark):
    # ``url``, ``phase`` and ``total`` clash with names of the operator
    df = spark.createDataFrame([(i, u, b, "x", -1.0) for i, u, b, _ in REQUESTS], "id int, uri string, body string, phase string, total double")
    return {r["id"]: r for r in vd.request_verdicts(df, "id", "uri", "body").collect()}


def test_attacks_and_plain_requests(verdicts):
    assert sorted(verdicts) == [r[0] for r in REQUESTS]
    for i, uri, body, attack in REQUESTS:
        assert verdicts[i]["is_attack"] == attack, (uri, body, verdicts[i])
    assert verdicts[4]["semantic"] == 0 and verdicts[4]["is_false_positive"] and verdicts[4]["action"] == "pass"


def test_parts_and_disguise(spark, verdicts):
    assert verdicts[9]["part"] == "data" and verdicts[9]["fusion"] > 0
    once, twice = "/q?x=%253Cscript%253E", "/q?x=%25253Cscript%25253E"
    rows = {r["id"]: r for r in vd.payloads(spark.createDataFrame([(1, once, ""), (2, twice, ""), (3, "/q?x=a", "")], "id int, u string, b string"), "id", "u", "b").collect()}
    assert [rows[i]["depth"] for i in (1, 2, 3)] == [2, 3, 0]
    assert "double_encoding" in rows[1]["techniques"] and rows[3]["techniques"] == []


def test_repeated_use_learns_paths(spark):
    plain = [(i, f"/shop/{i}?id={i}", "") for i in range(20)] + [(100, "/shop/5?zz=1", ""), (101, "/other", "")]
    d = {r["id"]: r["deviation"] for r in vd.request_verdicts(spark.createDataFrame(plain, "id int, u string, b string"), "id", "u", "b").collect()}
    assert d[3] == 0 and d[101] > 0


def test_extra_scores(spark):
    df = spark.createDataFrame([(1, "/a", "")], "id int, u string, b string")
    more = spark.createDataFrame([(1, 80.0, 60.0)], "id int, bayes double, behaviour double")
    low = vd.request_verdicts(df, "id", "u", "b").first()["total"]
    high = vd.request_verdicts(df, "id", "u", "b", bayes=more, behaviour=more).first()["total"]
    assert high > low + 15


def test_empty(spark):
    assert vd.request_verdicts(spark.createDataFrame([], "id int, u string, b string"), "id", "u", "b").count() == 0


def test_decisions(spark):
    rows = [
        ("a", 1, "/robots.txt", "recon", 0.0, False), ("a", 2, "/.git/x", "none", 0.0, False), ("b", 3, "/trap/x", None, 0.0, False), ("c", 4, "/x", "recon", 0.0, False),
        ("c", 5, "/y", "delivery", 0.0, False), ("d", 6, "/z", "c2", 0.0, True), ("e", 7, "/trapper", None, 75.0, True), ("e", 8, "/k", None, 75.0, False), ("e", 9, "/k", None, 45.0, False),
        ("f", 10, "/k", None, 0.0, False),
    ]
    df = spark.createDataFrame(rows, "client string, id long, uri string, phase string, total double, is_false_positive boolean").withColumns(
        {"us": F.col("id") * 1_000_000, "risk": F.lit("clean")})
    chains = spark.createDataFrame([("f", True)], "client string, block_early boolean")
    got = {r["id"]: (r["decision"], r["reason"]) for r in vd.request_decisions(df, "client", "us", "id", "uri", NEXT_PATHS, ["/trap"], chains).collect()}
    assert got == {1: ("allow", "none"), 2: ("block", "predicted_path"), 3: ("block", "decoy"), 4: ("allow", "none"), 5: ("block", "phase_jump"), 6: ("block", "phase_jump"),
                   7: ("allow", "false_positive"), 8: ("block", "score"), 9: ("monitor", "score"), 10: ("block", "attack_chain")}


def test_decoded_scan_and_summary(spark):
    shell = "<?php system($_GET['c']); eval(base64_decode('x')); ?>"
    hidden = shell.encode().hex(" ").split(" ")
    for _ in range(4):  # percent-encoded once, the sign itself three times more
        hidden = ["%" + h if not h.startswith("%") else h.replace("%", "%25", 1) for h in hidden]
    df = spark.createDataFrame([(1, shell), (2, "".join(hidden)), (3, "a walk by the lake"), (4, ""), (5, None)], "id int, text string")
    plain = {r["id"]: r for r in rules.content_scan(df, ["id"], "text").collect()}
    deep = {r["id"]: r for r in rules.content_scan(df, ["id"], "text", decode=True).collect()}
    assert plain[2]["hits"] == 0 and deep[2]["hits"] >= 2 and deep[2]["encoded"] >= 15 and deep[2]["engines"] >= 2
    assert deep[1]["malicious"] and deep[1]["type"] is not None and not any(deep[i]["malicious"] for i in (3, 4, 5))
    manifest = spark.createDataFrame([(1, "approved")], "id int, status string")
    got = {(r["part"], r["item"]): (r["n"], r["malicious"]) for r in rules.scan_summary(rules.content_scan(df, ["id"], "text", decode=True), ["id"], manifest).collect()}
    assert got[("status", "approved")] == (1, 1) and sum(n for (p, _), (n, _) in got.items() if p == "band") == 5
