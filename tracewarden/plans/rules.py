"""Queries over rule scans, evidence and content checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewarden import family_rules, rulesets
from tracewarden.operators import joins as jn
from tracewarden.operators import learning as ln
from tracewarden.operators import rules as rl
from tracewarden.plans.columns import _features_sql, documents, pages, sql_text
from tracewarden.plans.registry import query, table
from tracewarden.tables import KILL_CHAIN, values_sql

RULES = rulesets.detection_rules()
RULES_SQL = f"rules(rule_id, pattern, type, severity) AS (VALUES {values_sql([(i, p, t, s) for i, (p, t, s) in enumerate(RULES)])})"
HITS_SQL = "hits AS (SELECT page_id, rule_id, type, severity FROM pages JOIN rules ON regexp_matches(lower(html), pattern))"

# Rules that do occur in the prose of the documents.
DOC_RULES = [(r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}", "address", 85), (r"@", "mail", 60), (r"\d{4,}", "number", 40), (r"<[a-z]+", "tag", 90), (r"#{2,}", "junk", 30)]
DOC_SQL = f"rules(rule_id, pattern, type, severity) AS (VALUES {values_sql([(i, p, t, s) for i, (p, t, s) in enumerate(DOC_RULES)])})"


@query("j3_rule_scan", f"WITH {DOC_SQL} SELECT doc_id, rule_id, type, severity FROM documents JOIN rules ON regexp_matches(lower(text), pattern)")
def _(spark, d):
    return rl.rule_hits(documents(spark, d), ["doc_id"], "text", DOC_RULES)


@query("j3_rule_scan_pages", f"WITH {RULES_SQL}, {HITS_SQL} SELECT * FROM hits")
def _(spark, d):
    return rl.rule_hits(pages(spark, d), ["page_id"], "html")


def _family_sql() -> str:
    rows = [
        (i, fam, c, p, sev, also, gated, "," + ",".join(f.names) + "," if f.names else "", float(f.other), float(f.short), f.context)
        for i, fam, c, p, sev, also, gated in family_rules.rule_rows()
        for f in [family_rules.FAMILIES[fam]]
    ]
    return f"""r(rule_id, family, category, pattern, severity, also, gated, names, other, short, context) AS (VALUES {values_sql(rows)}),
p AS (SELECT page_id, 'url' AS name, trim(url) AS value FROM pages UNION ALL SELECT page_id, 'data', trim(html) FROM pages),
m AS (SELECT page_id, name, value, r.*, names = '' OR contains(names, ',' || name || ',') AS own FROM p JOIN r ON regexp_matches(value, pattern)),
h AS (SELECT page_id, name, rule_id, family, category, CAST(floor(severity * CASE WHEN own OR (context <> '' AND regexp_matches(value, context)) THEN 1.0::DOUBLE ELSE other END
  * CASE WHEN also = '' OR regexp_matches(value, also) THEN 1.0::DOUBLE ELSE short END) AS INTEGER) AS score FROM m WHERE gated = 0 OR own)"""


def _params(spark, d):
    p = pages(spark, d).withColumn("host", F.regexp_extract("url", "://([^/?#]*)", 1))
    return p.select("page_id", "host", F.lit("url").alias("name"), F.col("url").alias("value")).unionByName(p.select("page_id", "host", F.lit("data").alias("name"), F.col("html").alias("value")))


@query("j4_family_scan", f"WITH {_family_sql()} SELECT page_id, name, family, max(score) AS score, max(score) >= 50 AS detected FROM h WHERE score > 0 GROUP BY 1, 2, 3")
def _(spark, d):
    found = rl.family_rule_hits(_params(spark, d)).groupBy("page_id", "name", "family").agg(F.max("score").alias("score"))
    return found.withColumn("detected", F.col("score") >= 50)


@query("j4_rules_by_host", f"""WITH {_family_sql()}
SELECT rule_id, regexp_extract(url, '://([^/?#]*)', 1) AS host, count(*) AS hits FROM h JOIN pages USING (page_id) WHERE score >= 50 GROUP BY 1, 2""")
def _(spark, d):
    return rl.family_rule_hits(_params(spark, d)).filter("score >= 50").groupBy("rule_id", "host").agg(F.count("*").alias("hits"))


def _pick(rows, col: str) -> str:
    return " ".join(f"WHEN regexp_matches({col}, {sql_text(p)}) THEN {v}" for p, v in rows)


@query("j4_object_ids", f"""
WITH p AS (SELECT o_orderkey, unnest(['order_id', 'user_id', 'ids', 'status']) AS name, unnest([o_orderkey::VARCHAR, o_custkey::VARCHAR, o_orderkey || ',' || o_custkey, o_orderstatus]) AS value,
  CASE WHEN o_orderstatus = 'F' THEN '/order/' || o_orderkey ELSE '/shop' END AS path FROM orders),
b AS (SELECT *, CASE {_pick(family_rules.ID_NAMES, "name")} ELSE 0 END AS one, CASE WHEN contains(value, ',') THEN greatest(0, {', '.join(f"CASE {_pick([r], 'name')} ELSE 0 END" for r in family_rules.BATCH_NAMES)}) ELSE 0 END AS many,
  greatest(0, {', '.join(f"CASE {_pick([(p, v)], 'value')} ELSE 0 END" for _, p, v in family_rules.ID_VALUES)}) AS odd FROM p),
s AS (SELECT *, CASE WHEN one > 0 THEN greatest(one, odd) ELSE 0 END AS base FROM b),
r AS (SELECT *, CAST(greatest(CASE WHEN starts_with(path, '/order/') THEN least(100, floor(base * 1.3::DOUBLE)) ELSE base END, many) AS INT) AS score FROM s)
SELECT o_orderkey, name, score, score >= 50 AS detected FROM r WHERE score > 0""")
def _(spark, d):
    o = table(spark, d, "orders")
    key, cust = F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")
    parts = F.array(*[F.struct(F.lit(n).alias("name"), v.alias("value")) for n, v in (("order_id", key), ("user_id", cust), ("ids", F.concat_ws(",", key, cust)), ("status", F.col("o_orderstatus")))])
    path = F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("/order/"), key)).otherwise("/shop")
    return rl.id_hits(o.select("o_orderkey", path.alias("path"), F.explode(parts).alias("p")).select("o_orderkey", "path", "p.*")).select("o_orderkey", "name", "score", "detected")


TOKENS_SQL = r"""tok AS (SELECT page_id, html, unnest(list_distinct(
  list_transform(list_filter(list_transform(regexp_extract_all(html, '(?i)\b([a-z_]{3,20})\s*\(', 1), lambda x: lower(x)),
    lambda x: NOT list_contains(['if','for','while','echo','print','array','strlen','count','isset','empty','date','time'], x)), lambda x: x || '(')
  || list_transform(regexp_extract_all(html, '(?i)\b((?:union|select|insert|drop|delete|update|create)\s+\w+)', 1), lambda x: lower(x))
  || list_transform(regexp_extract_all(html, '(?i)(\.\.[/\\]|/etc/\w+|/var/\w+|/proc/\w+|[a-z]:\\\w+)', 1), lambda x: lower(x))
  || list_transform(regexp_extract_all(html, '(?i)<(script|iframe|img|svg|object|embed)[^>]', 1), lambda x: '<' || lower(x)))) AS token FROM pages)"""


@query("j8_learned_rules", f"""
WITH {TOKENS_SQL}, r AS (SELECT DISTINCT token FROM tok) SELECT page_id, token AS pattern FROM pages JOIN r ON contains(lower(html), token)""")
def _(spark, d):
    p = pages(spark, d)
    learned = p.select(F.explode(ln.tokens(F.col("html"))).alias("pattern")).distinct().withColumn("type", F.lit("learned")).withColumn("severity", F.lit(60))
    return rl.learned_rule_hits(p, ["page_id"], "html", learned).select("page_id", "pattern")


SIG, REX = len(rulesets.SIGNATURES), len(RULES)


@query("u1_union_hits", f"""
WITH {RULES_SQL}, {HITS_SQL}, {TOKENS_SQL}, r AS (SELECT DISTINCT token FROM tok),
l AS (SELECT page_id, 'learned' AS type, 60 AS severity FROM pages JOIN r ON contains(lower(html), token))
SELECT page_id, type, severity FROM hits WHERE rule_id < {SIG} UNION ALL SELECT page_id, type, severity FROM hits WHERE rule_id >= {SIG} UNION ALL SELECT * FROM l""")
def _(spark, d):
    p = pages(spark, d)
    cols = ["page_id", "type", "severity"]
    learned = p.select(F.explode(ln.tokens(F.col("html"))).alias("pattern")).distinct().withColumn("type", F.lit("learned")).withColumn("severity", F.lit(60))
    return rl.rule_hits(p, ["page_id"], "html", RULES[:SIG]).select(cols).unionByName(rl.rule_hits(p, ["page_id"], "html", RULES[SIG:]).select(cols)) \
        .unionByName(rl.learned_rule_hits(p, ["page_id"], "html", learned).select(cols))


W_SQL = "CASE type " + " ".join(f"WHEN '{t}' THEN {w}" for t, w in rulesets.TYPE_WEIGHTS.items()) + " ELSE 1.0 END"
SCORE_SQL = f"""pt AS (SELECT page_id, type, least(100.0, sum(severity * ({W_SQL})::DOUBLE)) AS s, count(*) AS n, count(*) FILTER (WHERE severity >= 80) AS h FROM hits GROUP BY 1, 2),
a AS (SELECT page_id, max(s) AS b, arg_max(type, (s, type)) AS top_type, sum(n)::BIGINT AS hits, sum(h)::BIGINT AS high_hits FROM pt GROUP BY 1),
c AS (SELECT *, least(100.0, b * CASE WHEN hits >= 5 THEN 1.4 WHEN hits >= 3 THEN 1.2 ELSE 1 END) AS b1 FROM a),
sc AS (SELECT *, round(least(100.0, b1 * CASE WHEN high_hits >= 2 THEN 1.3 ELSE 1 END), 1) AS score FROM c)"""


@query("a2_detection_score", f"""
WITH {RULES_SQL}, {HITS_SQL}, {SCORE_SQL}
SELECT page_id, top_type, hits, high_hits, score, score >= 70 AS is_attack, least(100, 50 + hits * 10 + high_hits * 15) AS confidence FROM sc""")
def _(spark, d):
    r = rl.detection_score(rl.rule_hits(pages(spark, d), ["page_id"], "html"), ["page_id"])
    return r.select("page_id", "top_type", "hits", "high_hits", "score", "is_attack", "confidence")


PHASE_LIST = "[" + ", ".join(f"'{p}'" for p in KILL_CHAIN) + "]"


@query("a26_intent_evidence", f"""
WITH r(intent, pattern, weight, phase, node) AS (VALUES {values_sql(rulesets.EVIDENCE)}),
h AS (SELECT page_id, r.*, list_position({PHASE_LIST}, phase) AS o FROM pages JOIN r ON regexp_matches(html, pattern)),
g AS (SELECT page_id, intent, sum(weight) AS w0, count(*) AS n, count(DISTINCT node) AS nodes, max(o) AS o FROM h GROUP BY 1, 2),
b AS (SELECT *, w0 + CASE WHEN n >= 4 THEN 12 WHEN n = 3 THEN 10 WHEN n = 2 THEN 5 ELSE 0 END + CASE WHEN nodes >= 3 THEN 8 WHEN nodes = 2 THEN 4 ELSE 0 END AS w FROM g),
t AS (SELECT page_id, arg_max(intent, (w, n, intent)) AS intent, max(w) AS weight, arg_max(n, (w, n, intent)) AS pn, sum(n) AS evidence, count(*) AS intents, max(o) AS o FROM b GROUP BY 1)
SELECT page_id, intent, CAST(weight AS BIGINT) AS weight, CAST(evidence AS BIGINT) AS evidence, intents, {PHASE_LIST}[o] AS phase,
  round(least(100.0, least(40.0, evidence * 12) + least(25.0, pn * 8) + CASE WHEN intents >= 3 THEN 20 WHEN intents = 2 THEN 12 ELSE 0 END + o / 7.0 * 15), 4) AS confidence FROM t""")
def _(spark, d):
    r = rl.intent_evidence(rl.evidence_hits(pages(spark, d), ["page_id"], "html"), ["page_id"])
    return r.withColumn("confidence", F.round("confidence", 4))


def _intent_sql() -> str:
    rows = [(i, name, w, len(ps), p) for i, (name, (w, ps)) in enumerate(rulesets.INTENTS.items()) for p in ps]
    return f"""
WITH r(ord, intent, weight, total, pattern) AS (VALUES {values_sql(rows)}),
h AS (SELECT page_id, ord, intent, weight, total, count(*) AS n FROM pages JOIN r ON regexp_matches(html || ' ' || url, pattern) GROUP BY ALL),
s AS (SELECT *, least(100, round(n * 100.0::DOUBLE / total * CASE WHEN n >= 3 THEN 1.3::DOUBLE WHEN n = 2 THEN 1.15::DOUBLE ELSE 1 END * (weight / 100.0::DOUBLE))) AS score FROM h),
b AS (SELECT page_id, arg_max(intent, (score, -ord)) AS intent, max(score) AS score, arg_max(n, (score, -ord)) AS n FROM s GROUP BY 1)
SELECT page_id, CAST(coalesce(score, 0) AS BIGINT) AS score, coalesce(intent, 'unknown') AS intent,
  CAST(CASE WHEN score > 0 THEN least(100, round(score * 0.7 + n * 8)) ELSE 0 END AS BIGINT) AS confidence FROM pages LEFT JOIN b USING (page_id)"""


@query("a41_keyword_intent", _intent_sql())
def _(spark, d):
    return rl.keyword_intents(pages(spark, d), ["page_id"], F.concat_ws(" ", "html", "url"))


def _content_sql() -> str:
    sig = " + ".join(f"CASE WHEN regexp_matches(html, {sql_text(p)}) THEN {w} ELSE 0 END" for p, w in SCAN_SIGNATURES)
    return rf"""
WITH {RULES_SQL}, {HITS_SQL}, hh AS (SELECT page_id, max(severity) AS det, count(*) AS hits FROM hits GROUP BY 1),
b AS (SELECT page_id, least(80, {sig}) AS signature, len(regexp_extract_all(html, '(?i)base64_decode\s*\(')) AS b64, len(regexp_extract_all(html, '(?i)chr\s*\(\s*\d+\s*\)')) AS chrs,
  len(regexp_extract_all(html, '(?i)goto\s+\w+\s*;')) AS gotos, list_max(list_transform(string_split(html, chr(10)), lambda x: strlen(x))) AS longest,
  len(regexp_extract_all(html, '\$[O0lI]{{4,}}')) AS odd FROM pages),
h AS (SELECT *, least(40, CASE WHEN b64 > 2 THEN least(15, b64 * 4) ELSE 0 END + CASE WHEN chrs > 5 THEN least(12, chrs * 2) ELSE 0 END + (gotos > 3)::INT * 10
  + (longest > 2000)::INT * 10 + (odd > 3)::INT * 8) AS heuristic FROM b),
d AS (SELECT h.*, coalesce(det, 0) AS detection, coalesce(hits, 0) AS hits, coalesce(det >= 70 AND hits >= 2, false) AS found FROM h LEFT JOIN hh USING (page_id)),
e AS (SELECT *, (signature > 0)::INT + found::INT + (heuristic > 0)::INT AS engines, least(100.0, round(least(signature * 0.6, 40.0) + CASE WHEN found THEN least(detection * 0.35, 35.0) ELSE 0 END
  + least(heuristic * 0.4, 15.0), 1))::DOUBLE AS score FROM d),
f AS (SELECT *, CASE WHEN engines = 3 THEN 40 WHEN engines = 2 THEN 45 ELSE 50 END AS threshold FROM e)
SELECT page_id, signature, heuristic, hits, engines, score, threshold, score >= threshold AS malicious,
  CASE WHEN score >= 80 THEN 'malicious' WHEN score >= 40 THEN 'suspicious' ELSE 'clean' END AS band FROM f"""


# Signatures that occur in the given pages, next to the built-in ones.
SCAN_SIGNATURES = rulesets.CONTENT_SIGNATURES + [(r"(?i)<script", 30), (r"(?i)track\(\d*[02468]\)", 25)]


def _scan(spark, d):
    return rl.content_scan(pages(spark, d), ["page_id"], "html", SCAN_SIGNATURES)


@query("a32_content_scan", _content_sql())
def _(spark, d):
    return _scan(spark, d).select("page_id", "signature", "heuristic", "hits", "engines", "score", "threshold", "malicious", "band")


@query("a31_scan_summary", f"WITH s AS ({_content_sql()}) SELECT band, count(*) AS scanned, count(*) FILTER (WHERE malicious) AS malicious, round(avg(score), 4) AS mean_score FROM s GROUP BY 1")
def _(spark, d):
    return _scan(spark, d).groupBy("band").agg(F.count("*").alias("scanned"), F.count_if("malicious").alias("malicious"), F.round(F.avg("score"), 4).alias("mean_score"))


@query("a31_scan_types", f"""
WITH s AS ({_content_sql()}), {RULES_SQL}, {HITS_SQL}, t AS (SELECT page_id, arg_max(type, (severity, type)) AS type FROM hits GROUP BY 1), j AS (SELECT * FROM s LEFT JOIN t USING (page_id))
SELECT 'band' AS part, band AS item, count(*) AS n, count(*) FILTER (WHERE malicious) AS malicious FROM j GROUP BY 2
UNION ALL SELECT 'type', type, count(*), count(*) FILTER (WHERE malicious) FROM j WHERE type IS NOT NULL GROUP BY 2""")
def _(spark, d):
    return rl.scan_summary(_scan(spark, d), ["page_id"])


@query("a32_decoded_scan")
def _(spark, d):
    r = rl.content_scan(pages(spark, d), ["page_id"], "html", SCAN_SIGNATURES, decode=True)
    return r.select("page_id", "signature", "heuristic", "encoded", "type", "hits", "engines", "score", "threshold", "malicious", "band")


@query("a33_hit_lines", f"""
WITH RECURSIVE {DOC_SQL}, l AS (SELECT doc_id, unnest(string_split(lower(text), chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents),
m AS (SELECT doc_id, line_no, rule_id, pattern, line AS rest, 0::BIGINT AS done, regexp_extract(line, pattern) AS hit FROM l JOIN rules ON regexp_matches(line, pattern)
  UNION ALL
  SELECT * FROM (SELECT doc_id, line_no, rule_id, pattern, rest[strpos(rest, hit) + length(hit):] AS rest, done + strpos(rest, hit) + length(hit) - 1 AS done,
    regexp_extract(rest[strpos(rest, hit) + length(hit):], pattern) AS hit FROM m) WHERE hit <> '')
SELECT doc_id, line_no, rule_id, CAST(done + strpos(rest, hit) AS INTEGER) AS position FROM m""")
def _(spark, d):
    return rl.hit_lines(documents(spark, d), ["doc_id"], "text", DOC_RULES)


def _similarity_sql() -> str:
    pats = [(f, n, p) for f, n, p in jn.KNOWN_PAYLOADS]
    feats = _features_sql().replace(", 6)", ", 12)")
    weights = values_sql(list(jn.FEATURE_WEIGHTS.items()))
    return f"""
WITH w(feature, weight) AS (VALUES {weights}), k(family, pattern, text) AS (VALUES {values_sql(pats)}),
kf AS (SELECT family, pattern, {feats} FROM k), pf AS (SELECT page_id, {feats} FROM (SELECT page_id, html AS text FROM pages)),
ku AS (UNPIVOT (SELECT family, pattern, COLUMNS(lambda c: c NOT IN ('family', 'pattern'))::DOUBLE FROM kf) ON COLUMNS(* EXCLUDE (family, pattern)) INTO NAME feature VALUE b),
pu AS (UNPIVOT (SELECT page_id, COLUMNS(lambda c: c <> 'page_id')::DOUBLE FROM pf) ON COLUMNS(* EXCLUDE (page_id)) INTO NAME feature VALUE a),
j AS (SELECT page_id, family, pattern, a, b, coalesce(weight, 1) AS w, feature IN ('special_ratio', 'space_ratio', 'keyword_density') AND a <> 0 AS r
  FROM pu JOIN ku USING (feature) LEFT JOIN w USING (feature)),
s AS (SELECT page_id, family, pattern, sum(CASE WHEN r THEN (1 - least(1.0::DOUBLE, abs(a - b) / greatest(a, b, 1))) * w WHEN a = b AND a > 0 THEN w ELSE 0 END)
  / sum(CASE WHEN r OR a > 0 OR b > 0 THEN w ELSE 0 END) AS similarity FROM j GROUP BY 1, 2, 3)
SELECT page_id, family, round(max(similarity), 4) AS similarity FROM s GROUP BY 1, 2 HAVING max(similarity) >= 0.3"""


@query("j17_pattern_similarity", _similarity_sql())
def _(spark, d):
    r = jn.pattern_similarity(pages(spark, d), ["page_id"], "html", jn.KNOWN_PAYLOADS, jn.FEATURE_WEIGHTS, 0.3)
    return r.select("page_id", "family", F.round("similarity", 4).alias("similarity"))
