"""Operators on small literal rows: attack families, decoding, logs, the text model."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from tracewarden.functions import audit, net, text, uri
from tracewarden.operators import bayes, bots, learning, params, rules
from tracewarden.sources import files, logs
from tracewarden.streaming import runner, windows


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "x string").select(fn(F.col("x")).alias("y")).first()["y"]


ATTACKS = [("1' union select 1,2 from t", "sqli"), ("<script>alert(1)</script>", "xss"), ("../../etc/passwd", "path_traversal"),
           ("eval(base64_decode('x'))", "rce"), ("<?php system($_GET[1]);", "webshell")]


def test_detection_scores(spark):
    plain = [("a summer walk by the lake",), ("price 12.50 for two",)]
    df = spark.createDataFrame([(p,) for p, _ in ATTACKS] + plain, "text string").withColumn("id", F.monotonically_increasing_id())
    got = {x["text"]: x for x in df.join(rules.detection_score(rules.rule_hits(df, ["id"], "text"), ["id"]), "id").collect()}
    for payload, kind in ATTACKS:
        assert got[payload]["score"] >= 70 and got[payload]["is_attack"], payload
    assert got[ATTACKS[0][0]]["top_type"] == "sqli" and got[ATTACKS[1][0]]["top_type"] == "xss"
    assert not any(p in got for (p,) in plain)


FAMILY = [("ldap", "filter", "(&(objectClass=*)(uid=*))"), ("xpath", "query", "//user[name='' or '1'='1']"), ("xxe", "xml", '<!DOCTYPE a [<!ENTITY b SYSTEM "file:///etc/passwd">]>'),
          ("deserialization", "data", 'O:8:"stdClass":0:{}'), ("file_inclusion", "page", "php://filter/convert.base64-encode/resource=x"),
          ("open_redirect", "next", "//evil.example"), ("template", "page", "{{x.__class__}}"), ("nosql", "q", "{ $ne : 1 }"), ("crlf", "q", "a%0d%0aLocation: b"),
          ("cache", "q", "%0d%0aSet-Cookie: a=b"), ("ssrf", "url", "http://169.254.169.254/latest"), ("api_values", "p", "/proc/self/environ")]


def test_family_hits(spark):
    df = spark.createDataFrame([(f, n, v) for f, n, v in FAMILY] + [("none", "q", "blue shoes")], "want string, name string, value string")
    got = {(x["want"], x["family"]): x["detected"] for x in rules.family_hits(df).collect()}
    for fam, _, _ in FAMILY:
        assert got.get((fam, fam)), fam
    assert not any(w == "none" for w, _ in got)


# Expectations written by hand: name, value, families that find it.
FOUND = [
    ("id", '{"$gt":""}', {"nosql"}), ("query", '{"$where": "1"}', {"nosql"}), ("filter", "{'$in':['a']}", {"nosql"}), ("title", "delete everything", set()),
    ("url", "http://[::1]/", {"ssrf"}), ("url", "http://100.64.0.1/", {"ssrf"}), ("url", "http://user@127.0.0.1:80/x", {"ssrf"}), ("price", "10.50", set()), ("url", "localhosting.com", set()),
    ("url", "10.50", set()), ("host", "localhosting.com", set()), ("url", "http://metadata.google.internal/computeMetadata", {"ssrf"}),
    ("page", "{{os.popen('id')}}", {"template"}), ("page", "{{ user.name }}", set()), ("next", "evil.example", {"open_redirect"}), ("note", "evil.example", set()),
    ("q", "C:\\new", {"api_values"}), ("note", "two\r\nlines", set()), ("note", "x\r\nSet-Cookie: a=b", {"crlf", "cache"}), ("page", "0", set()),
    ("data", "\u00ac\u00ed\x00\x05x", {"deserialization", "api_values"}), ("xpath", "a[1]/b[2]", set()), ("note", "a summer walk by the lake", set()),
]


def test_families_on_written_cases(spark):
    df = spark.createDataFrame([(i, n, v) for i, (n, v, _) in enumerate(FOUND)], "i int, name string, value string")
    got = {i: set() for i in range(len(FOUND))}
    for x in rules.family_hits(df).filter("detected").collect():
        got[x["i"]].add(x["family"])
    for i, (n, v, want) in enumerate(FOUND):
        assert got[i] - {"open_redirect", "file_inclusion"} == want - {"open_redirect"}, (n, v, got[i])
        assert not want & {"open_redirect"} or "open_redirect" in got[i], (n, v)


def test_rule_hits_carry_ids(spark):
    df = spark.createDataFrame([("xml", "<!DOCTYPE a>")], "name string, value string")
    assert {(x["rule_id"], x["category"], x["score"]) for x in rules.family_rule_hits(df).filter("family = 'xxe'").collect()} == {("xxe-2", "entity", 75)}


def test_ids_in_parameters(spark):
    rows = [("user_id", "-1", "/blog", 75), ("id", "7", "/blog", 35), ("id", "7", "/admin/x", 45), ("order_id", "0", "/api/order", 71), ("page", "0", "/admin", None), ("user_ids", "1,2,3", "/", 65), ("id", "null", "/administrator", 50)]
    df = spark.createDataFrame([r[:3] for r in rows], "name string, value string, path string")
    got = {(x["name"], x["value"], x["path"]): x["score"] for x in rules.id_hits(df).collect()}
    assert got == {r[:3]: r[3] for r in rows if r[3]}


def test_every_match_of_a_line(spark):
    df = spark.createDataFrame([(1, "@ a @ b @\nx\n\n@@")], "id int, text string")
    got = sorted((x["line_no"], x["position"]) for x in rules.hit_lines(df, ["id"], "text", [(r"@", "mail", 1)]).collect())
    assert got == [(1, 1), (1, 5), (1, 9), (4, 1), (4, 2)]


def test_family_factor_depends_on_name(spark):
    df = spark.createDataFrame([("filter", "uid=*"), ("color", "uid=*")], "name string, value string")
    got = {x["name"]: (x["score"], x["detected"]) for x in rules.family_hits(df).filter("family = 'ldap'").collect()}
    assert got == {"filter": (70, True), "color": (42, False)}


def test_family_context(spark):
    """Quote logic counts in full only beside a path, XML rules in full beside an XML head."""
    df = spark.createDataFrame([("query", "' or '1'='1"), ("query", "/a' or '1'='1"), ("note", "file:///x"), ("note", "<?xml?>file:///x")], "name string, value string")
    got = {(x["value"], x["family"]): x["score"] for x in rules.family_hits(df).collect()}
    assert got[("' or '1'='1", "xpath")] == 47 and got[("/a' or '1'='1", "xpath")] == 95
    assert got[("file:///x", "xxe")] == 42 and got[("<?xml?>file:///x", "xxe")] == 85


def test_learned_rules_equal_plain_search(spark):
    rnd = random.Random(4)
    docs = [(i, "".join(rnd.choice("abcd é") for _ in range(rnd.randrange(0, 60)))) for i in range(60)]
    pats = {"".join(rnd.choice("abcd") for _ in range(rnd.randrange(1, 8))) for _ in range(25)}
    r = spark.createDataFrame([(p, "x", 60) for p in pats], "pattern string, type string, severity int")
    got = {(x["id"], x["pattern"]) for x in rules.learned_rule_hits(spark.createDataFrame(docs, "id int, text string"), ["id"], "text", r).collect()}
    assert got == {(i, p) for i, t in docs for p in pats if p in t}


@pytest.mark.parametrize("raw,want,depth", [
    ("%2527%2520or", "' or", 2), ("ＳＥＬＥＣＴ", "select", 0), ("ѕеlесt", "select", 0), ("un​ion", "union", 0), ("se/**/lect", "se lect", 0),
    ("PHNjcmlwdD5hbGVydCgxKTwvc2NyaXB0Pg==", "<script>alert(1)</script>", 1), ("100%", "100%", 0),
    ("%25252525253cscript%25252525253e", "<script>", 6)])
def test_decoding(spark, raw, want, depth):
    r = text.decode_layers(spark.createDataFrame([(raw,)], "x string"), "x").first()
    assert (r["decoded"], r["depth"]) == (want, depth)


def test_byte_entropy(spark):
    assert one(spark, "abab", text.byte_entropy) == pytest.approx(1.0)
    assert one(spark, "", text.byte_entropy) == 0.0


@pytest.mark.parametrize("u,want", [("/api/users/123/posts/abc123def4567890", "/api/users/{id}/posts/{hash}"), ("http://h/x", "/x")])
def test_templates(spark, u, want):
    assert one(spark, u, uri.template_segments) == want


@pytest.mark.parametrize("u,m,want", [
    ("/user/login/", "POST", "hard_skip"), ("/login", "GET", "soft_skip"), ("/loginabc", "POST", "full_check"), ("/x?s=1", "GET", "soft_skip"),
    ("/wp-comments-post.php", "POST", "hard_skip"), ("/login/../shop", "POST", "full_check"), ("/a?view=checkout", "POST", "hard_skip")])
def test_scene(spark, u, m, want):
    assert one(spark, u, lambda x: uri.scene(x, F.lit(m))) == want


@pytest.mark.parametrize("ip,n", [("1.2.3.4", 16909060), ("256.1.1.1", None), ("x", None), ("0.0.0.0", 0)])
def test_ip_number(spark, ip, n):
    assert one(spark, ip, net.ip_number) == n


@pytest.mark.parametrize("name,cat", [("user_id", "identifier"), ("userId", "identifier"), ("returnUrl", "redirect"), ("page", "numeric"), ("zzz", "unknown")])
def test_name_category(spark, name, cat):
    assert one(spark, name, params.name_category) == cat


@pytest.mark.parametrize("value,kind", [
    ("12", "numeric"), ("", "empty"), ("../x", "traversal"), ("javascript:1", "danger_protocol"), ("' or 1=1", "sql"), ("a; cat", "command"), ("<b>x</b>", "html"),
    ('{"a":1}', "json"), ("a@b.org", "email"), ("http://x", "url"), ("/a/b", "path"), ("hello", "text")])
def test_value_type(spark, value, kind):
    assert one(spark, value, params.value_type) == kind


def test_json_params_at_any_depth(spark):
    deep = "1"
    for _ in range(12):
        deep = '{"n":' + deep + "}"
    for doc, want in [('{"a":{"b":{"c":{"d":1}}}}', {("a.b.c.d", "1")}), ('[[[[{"x":[2,{"y":3}]}]]]]', {("0.0.0.0.x.0", "2"), ("0.0.0.0.x.1.y", "3")}), (deep, {(".".join("n" * 12), "1")}),
                      ('{"a":{"b":{"c":{"d":"{bad"}}}}', {("a.b.c.d", "{bad")}), ('{"a":null}', {("a", None)}), (None, set()), ("", set())]:
        assert {(p["name"], p["value"]) for p in one(spark, doc, params.json_params)} == want, doc


def test_json_params_are_flattened(spark):
    doc = json.dumps({"a": 1, "b": {"c": "x", "d": {"e": True}}, "f": [1, {"g": 2}]})
    got = {(p["name"], p["value"]) for p in one(spark, doc, params.json_params)}
    assert got == {("a", "1"), ("b.c", "x"), ("b.d.e", "true"), ("f.0", "1"), ("f.1.g", "2")}


def test_consecutive_ids_over_block_borders(spark):
    vals = [99_998, 99_999, 100_000, 100_001, 100_002, 7, 8, 300_000]
    df = spark.createDataFrame([(1, str(v)) for v in vals] + [(2, "5"), (2, "x")], "k int, value string")
    got = {x["k"]: (x["longest_run"], x["score"]) for x in params.consecutive_ids(df, ["k"]).collect()}
    assert got == {1: (5, 70), 2: (1, 0)}


def test_block_log_drops_other_lines(spark, tmp_path):
    (tmp_path / "dt=2024-01-02").mkdir()
    (tmp_path / "dt=2024-01-02" / "a.log").write_text(
        "2024-01-02 03:04:05 | IP: 1.2.3.4 | URI: /x?a=1 | Msg: SQL hit\nbroken\n2024-01-02 03:04:06 | IP: 1.2.3.4 | URI: /a|b | Msg: no\n")
    (tmp_path / "dt=2023-01-02").mkdir()
    (tmp_path / "dt=2023-01-02" / "a.log").write_text("2023-01-02 03:04:05 | IP: 9.9.9.9 | URI: / | Msg: old\n")
    got = logs.read_block_log(spark, str(tmp_path), F.lit("2024-01-03").cast("date")).withColumn("c", audit.message_class(F.col("msg"))).collect()
    assert [(x["ip"], x["uri"], x["c"]) for x in got] == [("1.2.3.4", "/x?a=1", "sql_injection")]


def test_corrupt_requests_are_kept_apart(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"request_id": 1, "uri": "/a"}\n{"request_id": oops\n')
    got = logs.read_requests(spark, str(tmp_path)).cache().collect()
    assert sorted((x["request_id"] is None, x["_corrupt_record"] is not None) for x in got) == [(False, False), (True, True)]


def test_inventory(spark, tmp_path):
    (tmp_path / "skip").mkdir()
    for p, c in (("a.php", "x"), ("b.php", "yy" * 50), ("c.txt", "z"), ("skip/d.php", "q")):
        (tmp_path / p).write_text(c)
    got = {x["path"].rsplit("/", 1)[1]: (x["md5"], x["size"]) for x in files.inventory(spark, str(tmp_path), "*.php", ["skip"]).collect()}
    assert got == {"a.php": ("9dd4e461268c8034f5c8564e155c67a6", 1), "b.php": (hashlib.md5(b"yy" * 50).hexdigest(), 100)}
    assert [x["content"] for x in files.inventory(spark, str(tmp_path), "a.php", content=True).collect()] == ["x"]


def test_digest_in_pieces(spark, tmp_path):
    (tmp_path / "sp ace").mkdir()
    big = bytes(range(256)) * 5000
    for p, c in (("big.bin", big), ("none.bin", b""), ("sp ace/x.bin", b"x")):
        (tmp_path / p).write_bytes(c)
    rows = spark.createDataFrame([(f"file:{tmp_path}/{p}",) for p in ("big.bin", "none.bin", "sp ace/x.bin", "gone.bin")] + [(f"file://{tmp_path}/big.bin",)], "path string")
    got = {x["path"]: x["md5"] for x in files.with_digests(rows, chunk=1000).collect()}
    want = {"big.bin": big, "none.bin": b"", "sp ace/x.bin": b"x"}
    assert got == {f"file:{tmp_path}/{p}": hashlib.md5(c).hexdigest() for p, c in want.items()} | {
        f"file:{tmp_path}/gone.bin": None, f"file://{tmp_path}/big.bin": hashlib.md5(big).hexdigest()}


def test_bayes_separates_and_stays_cold(spark):
    attack = [f"union select {i} from users where 1=1" for i in range(20)]
    normal = [f"article {i} about gardens and rivers" for i in range(20)]
    train = spark.createDataFrame([(i, t, "attack") for i, t in enumerate(attack)] + [(100 + i, t, "normal") for i, t in enumerate(normal)], "id int, text string, label string")
    test = spark.createDataFrame([(1, "union select password from users"), (2, "rivers and gardens in spring")], "id int, text string")
    got = {x["id"]: x for x in bayes.score(test, ["id"], "text", *bayes.train(train, "text", "label")).collect()}
    assert got[1]["class"] == "attack" and got[1]["score"] > 90 and got[2]["class"] == "normal" and got[2]["score"] < 10
    cold = bayes.score(test, ["id"], "text", *bayes.train(train.filter("id < 5"), "text", "label")).first()
    assert (cold["class"], cold["probability"], cold["confidence"], cold["score"]) == ("unknown", 0.5, 0.0, 0.0)


def test_bot_agents(spark):
    df = spark.createDataFrame([("Googlebot/2.1",), ("sqlmap/1.7",), ("Googlebot curl",), ("Mozilla/5.0 Firefox",), (None,)], "a string")
    assert [x["agent_kind"] for x in bots.agent_class(df, "a").collect()] == ["search_engine", "tool", "forged", "browser", "empty"]


def test_hot_signatures_leave_out_common_calls(spark):
    r = spark.createDataFrame([("trim(", "rce", 30, 80), ("system(", "rce", 12, 72), ("x(", "rce", 3, 60)], "token string, type string, hit_count bigint, severity bigint")
    assert [(x["token"], x["weight"]) for x in learning.hot_signatures(r).collect()] == [("system(", 15)]


def test_late_rows_are_dropped_and_counted(spark, tmp_path):
    import time

    schema = "id bigint, ts timestamp"
    for i, (a, b) in enumerate(((1000, 1010), (2000, 2010), (0, 10))):
        df = spark.range(a, b).select("id", F.timestamp_seconds("id").alias("ts")).coalesce(1)
        df.write.parquet(str(tmp_path / f"p{i}"))
        time.sleep(0.05)
    s = runner.file_stream(spark, str(tmp_path), spark.createDataFrame([], schema).schema, per_trigger=1)
    out, progress = runner.run_to_table(windows.tumbling_counts(s, "ts", [], "10 seconds", "10 seconds"), "late")
    assert {x["start_us"] // 1_000_000 for x in out.collect()} == {1000}
    assert runner.late_rows(progress) > 0


@pytest.mark.parametrize("path,want", [("/login/a/b/c/d/e/../../../../../../blog", "/blog"), ("/a//B/./c/", "/a/b/c/"), ("/../..", "/"), ("a/b/..", "/a/"), ("", "/")])
def test_paths_settle_at_any_depth(spark, path, want):
    assert one(spark, path, uri.settle_path) == want


def test_files_without_digest_are_not_new(spark):
    from tracewarden.operators import joins

    old = spark.createDataFrame([("a", "1"), ("b", None), ("c", "3"), ("d", "4")], "path string, md5 string")
    new = spark.createDataFrame([("a", "1"), ("b", None), ("c", "x"), ("e", None)], "path string, md5 string")
    got = {x["path"]: x["status"] for x in joins.snapshot_diff(old, new, "path", "md5").collect()}
    assert got == {"a": "same", "b": "unverified", "c": "changed", "d": "removed", "e": "added"}


@pytest.mark.parametrize("value,want", [("2047", 70), ("u7@example.org", 25), ("10.0.12.7", 35), ("2024-01-09", 30), ("C4CA4238A0B923820DCC509A6F75849B", 30), ("<b>", 0), ("", None)])
def test_ordinary_discount_of_codes(spark, value, want):
    got = one(spark, value, text.ordinary_discount)
    assert want is None or got == want


def test_escape_depth_has_no_small_limit(spark):
    from urllib.parse import quote

    x = "a b<"
    for depth in range(9):
        assert one(spark, x, text.escape_depth) == depth
        x = quote(x, safe="")
    assert one(spark, "100% sure", text.escape_depth) == 0
