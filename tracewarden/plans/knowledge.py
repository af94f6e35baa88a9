"""Queries over learning, joins, reports, the text model, bots and scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewarden.functions import audit, uri
from tracewarden.functions.scores import first_of
from tracewarden.operators import bayes as nb
from tracewarden.operators import bots as bt
from tracewarden.operators import joins as jn
from tracewarden.operators import learning as ln
from tracewarden.operators import params as pr
from tracewarden.operators import report as rp
from tracewarden.operators import scoring as sc
from tracewarden.operators.timeline import DAY
from tracewarden.plans.columns import PAIRS_SQL, PATH, documents, pages, stored
from tracewarden.plans.registry import EVENTS_SQL, events, query, table
from tracewarden.plans.rules import TOKENS_SQL
from tracewarden.plans.windows import hours
from tracewarden.session import new_path
from tracewarden.tables import values_sql

AS_OF = "2024-01-20"
DAYS = f"CAST(ts AS DATE) > DATE '{AS_OF}' - 7 AND CAST(ts AS DATE) <= DATE '{AS_OF}'"
AS_OF_US = 1705708800000000


def as_of():
    return F.lit(AS_OF).cast("date")


# ---- reports -------------------------------------------------------------------------------

SUMMARY_SQL = f"""s AS (SELECT 'total' AS part, 'all' AS item, count(*) AS n FROM ev UNION ALL SELECT 'type', event_type, count(*) FROM ev GROUP BY 2
  UNION ALL SELECT 'day', CAST(CAST(ts AS DATE) AS VARCHAR), count(*) FROM ev GROUP BY 2)"""


@query("a1_dashboard_summary", f"""
WITH {EVENTS_SQL}, {SUMMARY_SQL}, c AS (SELECT CAST(user_id AS VARCHAR) AS item, count(*) AS n FROM ev GROUP BY 1 ORDER BY n DESC, item LIMIT 10)
SELECT * FROM s UNION ALL SELECT 'client', item, n FROM c""")
def _(spark, d):
    return rp.dashboard(events(spark, d).withColumn("day", F.to_date("ts")), "user_id", "event_type", "day")


@query("t1_top_clients", f"WITH {EVENTS_SQL} SELECT user_id, count(*) AS n FROM ev GROUP BY 1 ORDER BY n DESC, user_id LIMIT 10")
def _(spark, d):
    return rp.top_n(events(spark, d), "user_id", 10)


GEO_SQL = """r AS (SELECT n_nationkey AS seq, n_nationkey * 50 AS s, n_nationkey * 50 + 89 AS e, n_name AS country FROM nation),
g AS (SELECT c_custkey, arg_max(country, seq) AS country FROM customer JOIN r ON c_custkey BETWEEN s AND e GROUP BY 1)"""


def ranges(spark, d):
    n = table(spark, d, "nation")
    return n.select((F.col("n_nationkey") * 50).cast("bigint").alias("start"), (F.col("n_nationkey") * 50 + 89).cast("bigint").alias("end"),
                    F.col("n_name").alias("value"), F.col("n_nationkey").alias("seq"))


@query("t1_top_countries", f"WITH {GEO_SQL} SELECT country, count(*) AS n FROM orders JOIN g ON o_custkey = c_custkey GROUP BY 1 ORDER BY n DESC, country LIMIT 20")
def _(spark, d):
    o = jn.range_lookup(table(spark, d, "orders"), "o_custkey", ranges(spark, d), 64).filter(F.col("value").isNotNull())
    return rp.top_n(o.withColumnRenamed("value", "country"), "country", 20)


@query("t2_latest_with_country", f"""
WITH {GEO_SQL}, l AS (SELECT o_orderkey, o_custkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 20)
SELECT o_orderkey, coalesce(country, 'UNKNOWN') AS country FROM l LEFT JOIN g ON o_custkey = c_custkey""")
def _(spark, d):
    top = rp.latest(table(spark, d, "orders"), "o_orderdate", "o_orderkey", 20)
    return jn.range_lookup(top, "o_custkey", ranges(spark, d), 64).select("o_orderkey", F.coalesce("value", F.lit("UNKNOWN")).alias("country"))


@query("a1_dashboard_panels", f"""
WITH {EVENTS_SQL}, {GEO_SQL}, c AS (SELECT country, count(*) AS n FROM orders JOIN g ON o_custkey = c_custkey GROUP BY 1 ORDER BY n DESC, country LIMIT 20),
l AS (SELECT o_orderkey, o_custkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 20), m AS (SELECT count(*) AS n FROM ev WHERE us > (SELECT max(us) FROM ev) - 60000000)
SELECT 'country' AS panel, country AS item, n FROM c UNION ALL SELECT 'latest', coalesce(country, 'UNKNOWN'), o_orderkey FROM l LEFT JOIN g ON o_custkey = c_custkey
UNION ALL SELECT 'per_minute', 'all', n FROM m UNION ALL SELECT 'per_hour', 'all', n * 60 FROM m""")
def _(spark, d):
    e = events(spark, d)
    return rp.panels(table(spark, d, "orders"), "o_custkey", "o_orderdate", "o_orderkey", ranges(spark, d), rp.rate_per_minute(e, "us", e.agg(F.max("us")).scalar()), 64)


@query("t3_top_payloads", f"WITH {EVENTS_SQL} SELECT md5(CAST(k AS VARCHAR)) AS payload_id, count(*) AS seen FROM ev GROUP BY 1 ORDER BY seen DESC, payload_id LIMIT 10")
def _(spark, d):
    p = ln.payload_frequency(events(spark, d), "k", "us", "event_type")
    return p.orderBy(F.desc("seen"), "payload_id").limit(10).select("payload_id", "seen")


@query("t4_recent_risky_clients", f"""
WITH {EVENTS_SQL}, h AS (SELECT user_id, max((us, event_id)) AS m FROM ev WHERE value >= 150 GROUP BY 1 ORDER BY m DESC LIMIT 20),
r AS (SELECT e.user_id, e.event_id, row_number() OVER (PARTITION BY e.user_id ORDER BY us DESC, event_id DESC) AS pos FROM ev e JOIN h USING (user_id))
SELECT * FROM r WHERE pos <= 5""")
def _(spark, d):
    return rp.recent_risky_clients(events(spark, d), "user_id", "us", "event_id", "value", 150).select("user_id", "event_id", "pos")


@query("t6_top_paths", f"SELECT split_part(url, '?', 1) AS path, count(*) AS n FROM pages GROUP BY 1 ORDER BY n DESC, path LIMIT 10")
def _(spark, d):
    return rp.top_paths(pages(spark, d), "url")


@query("a5_type_trend", f"""
WITH {EVENTS_SQL} SELECT CAST(ts AS DATE) AS day, count(*) FILTER (WHERE event_type = 'error') AS error, count(*) FILTER (WHERE event_type = 'view') AS view,
  count(*) FILTER (WHERE event_type = 'click') AS click FROM ev WHERE {DAYS} GROUP BY 1""")
def _(spark, d):
    return ln.type_trend(events(spark, d).withColumn("day", F.to_date("ts")), "day", "event_type", ["error", "view", "click"], as_of())


@query("a27_bot_counts", f"WITH {EVENTS_SQL} SELECT event_type AS category, CASE WHEN value >= 75 THEN 'block' WHEN value >= 50 THEN 'challenge' ELSE 'allow' END AS action, count(*) AS n FROM ev GROUP BY 1, 2")
def _(spark, d):
    v = F.col("value")
    e = events(spark, d).select(F.col("event_type").alias("category"), first_of([(v >= 75, "block"), (v >= 50, "challenge")], "allow").alias("action"))
    return rp.category_counts(e, ["category", "action"])


@query("a27_recent_bots", f"WITH {EVENTS_SQL} SELECT event_id, event_type AS category FROM ev WHERE event_type <> 'view' ORDER BY us DESC, event_id DESC LIMIT 50")
def _(spark, d):
    return rp.latest(events(spark, d).filter(F.col("event_type") != "view"), "us", "event_id", 50).select("event_id", F.col("event_type").alias("category"))


@query("a30_credential_census", """
SELECT format, count(*) AS n FROM (SELECT CASE doc_id % 7 WHEN 0 THEN 'md5' WHEN 1 THEN 'sha1' WHEN 2 THEN 'sha256' WHEN 3 THEN 'bcrypt' WHEN 4 THEN 'phpass' WHEN 5 THEN 'argon2id'
  ELSE CASE WHEN text = '' THEN 'empty' ELSE 'unknown' END END AS format FROM documents) GROUP BY 1""")
def _(spark, d):
    return rp.category_counts(stored(spark, d).select(audit.credential_format(F.col("stored")).alias("format")), ["format"])


@query("s8_retention_keys", f"WITH {EVENTS_SQL} SELECT event_id FROM ev JOIN (SELECT user_id, k, max(us) AS m FROM ev GROUP BY 1, 2) USING (user_id, k) WHERE m >= {AS_OF_US} - {hours(240)}")
def _(spark, d):
    e = events(spark, d).withColumn("key", F.concat_ws("/", "user_id", "k"))
    return ln.keep_recent(e, "key", "us", F.lit(AS_OF_US), hours(240)).select("event_id")


@query("s8_keep_newest", f"WITH {EVENTS_SQL} SELECT event_id FROM ev ORDER BY us DESC, event_id DESC LIMIT 1000")
def _(spark, d):
    return ln.keep_newest(events(spark, d), "us", "event_id", 1000).select("event_id")


# ---- learning ------------------------------------------------------------------------------

@query("a3_adaptive_weights", f"""
WITH {EVENTS_SQL}, c AS (SELECT event_type AS type, count(*) AS n FROM ev WHERE {DAYS} AND event_type <> 'click' GROUP BY 1),
w AS (SELECT *, CASE type WHEN 'view' THEN 1.2 WHEN 'error' THEN 1.5 WHEN 'purchase' THEN 0.7 ELSE 1.9 END::DOUBLE + n / max(n) OVER () * 0.3 AS w FROM c),
f AS (SELECT *, CASE type WHEN 'signup' THEN 0.5 WHEN 'purchase' THEN -0.5 END AS adj FROM w)
SELECT type, n, round(CASE WHEN adj IS NULL THEN w ELSE greatest(0.5, least(2.0, w + adj)) END, 6) AS weight FROM f""")
def _(spark, d):
    fb = spark.createDataFrame([("signup", 0.5), ("purchase", -0.5)], "type string, adjustment double")
    r = ln.adaptive_weights(events(spark, d).withColumn("day", F.to_date("ts")), "event_type", "day", as_of(), {"view": 1.2, "error": 1.5, "purchase": 0.7, "signup": 1.9}, fb)
    return r.withColumn("weight", F.round("weight", 6))


@query("a4_payload_frequency", f"""
WITH {EVENTS_SQL}, c AS (SELECT k, event_type, count(*) AS n FROM ev GROUP BY 1, 2), m AS (SELECT k, arg_min(event_type, (-n, event_type)) AS main_type FROM c GROUP BY 1)
SELECT md5(CAST(k AS VARCHAR)) AS payload_id, count(*) AS seen, min(us) AS first_seen, max(us) AS last_seen, any_value(main_type) AS main_type FROM ev JOIN m USING (k) GROUP BY 1""")
def _(spark, d):
    return ln.payload_frequency(events(spark, d), "k", "us", "event_type")


PAYLOAD_SQL = r"""x AS (SELECT page_id, unnest(string_split_regex(html, '[\n>;0-9]+')) AS html FROM pages)"""


@query("a6_learned_rules", f"""
WITH {PAYLOAD_SQL}, {TOKENS_SQL.replace('FROM pages)', 'FROM x)')},
p AS (SELECT html AS payload, CASE WHEN page_id % 3 = 0 THEN 'xss' ELSE 'rce' END AS type, count(*) AS n FROM x GROUP BY 1, 2),
q AS (SELECT payload, sum(n) AS n, arg_min(type, (-n, type)) AS type FROM p GROUP BY 1 HAVING sum(n) >= 3),
t AS (SELECT DISTINCT html AS payload, token FROM tok),
g AS (SELECT token, type, sum(n - 2) AS hit_count, list_sort(list(DISTINCT md5(payload)))[1:5] AS src FROM q JOIN t USING (payload) GROUP BY 1, 2)
SELECT token, type, CAST(hit_count AS BIGINT) AS hit_count, CAST(CASE WHEN hit_count >= 10 THEN least(80, 60 + hit_count) ELSE 60 END AS BIGINT) AS severity,
  array_to_string(src, ',') AS sources FROM g""")
def _(spark, d):
    r = ln.learn_rules(_payloads(spark, d), "payload", "type")
    return r.select("token", "type", "hit_count", "severity", F.concat_ws(",", "sources").alias("sources"))


def _payloads(spark, d):
    """The whole page, cut at line, tag and statement ends and at numbers, so that pieces repeat."""
    kind = F.when(F.col("page_id") % 3 == 0, "xss").otherwise("rce").alias("type")
    return pages(spark, d).select(F.explode(F.split("html", r"[\n>;0-9]+")).alias("payload"), kind)


@query("a7_hot_signatures", f"""
WITH {PAYLOAD_SQL}, {TOKENS_SQL.replace('FROM pages)', 'FROM x)')},
p AS (SELECT html AS payload, CASE WHEN page_id % 3 = 0 THEN 'xss' ELSE 'rce' END AS type, count(*) AS n FROM x GROUP BY 1, 2),
q AS (SELECT payload, sum(n) AS n, arg_min(type, (-n, type)) AS type FROM p GROUP BY 1 HAVING sum(n) >= 3),
t AS (SELECT DISTINCT html AS payload, token FROM tok), g AS (SELECT token, type, sum(n - 2)::BIGINT AS hit_count FROM q JOIN t USING (payload) GROUP BY 1, 2)
SELECT token, type, hit_count, CAST(15 AS BIGINT) AS weight FROM g WHERE hit_count >= 10 ORDER BY hit_count DESC, token, type LIMIT 50""")
def _(spark, d):
    return ln.hot_signatures(ln.learn_rules(_payloads(spark, d), "payload", "type"))


NAMES_SQL = f"{EVENTS_SQL}, nm AS (SELECT *, ['P' || k % 7, 'q'] AS names, '/' || event_type || '/' || user_id % 20 AS path FROM ev)"


def named(spark, d):
    return events(spark, d).withColumn("names", F.array(F.concat(F.lit("P"), (F.col("k") % 7).cast("string")), F.lit("q"))).withColumn(
        "path", F.concat(F.lit("/"), "event_type", F.lit("/"), (F.col("user_id") % 20).cast("string")))


@query("a8_normal_paths", f"""
WITH {NAMES_SQL}, u AS (SELECT path, unnest(names) AS name FROM nm WHERE value < 20), n AS (SELECT path, count(DISTINCT lower(name)) AS names FROM u GROUP BY 1)
SELECT path, count(*) AS seen, min(us) AS first_seen, max(us) AS last_seen, any_value(n.names) AS names FROM nm JOIN n USING (path) WHERE value < 20 GROUP BY 1""")
def _(spark, d):
    return ln.normal_paths(named(spark, d).filter("value < 20"), "path", "us", "names")


@query("j6_normal_deviation", f"""
WITH {NAMES_SQL}, b AS (SELECT * FROM nm WHERE value < 2), p AS (SELECT path, count(*) AS seen FROM b GROUP BY 1), k2 AS (SELECT DISTINCT path, lower(unnest(names)) AS name FROM b),
u AS (SELECT event_id, path, lower(unnest(names)) AS name FROM nm), x AS (SELECT event_id, count(*) AS n FROM u ANTI JOIN k2 USING (path, name) GROUP BY 1),
r AS (SELECT nm.event_id, CASE WHEN seen IS NULL THEN 0.3 WHEN seen < 5 THEN 0.2 ELSE coalesce(n, 0) / 2 END::DOUBLE + CASE WHEN user_id % 4 = 0 THEN 0.6 ELSE 0 END * 0.3 AS dv
  FROM nm LEFT JOIN p USING (path) LEFT JOIN x USING (event_id))
SELECT event_id, round(least(1.0, dv), 4) AS deviation FROM r""")
def _(spark, d):
    e = named(spark, d).withColumn("risk", F.when(F.col("user_id") % 4 == 0, 0.6).otherwise(0.0))
    base = e.filter("value < 2")
    r = ln.normal_deviation(e, ["event_id"], "path", "names", ln.normal_paths(base, "path", "us", "names"), ln.normal_names(base, "path", "names"), "risk")
    return r.select("event_id", F.round("deviation", 4).alias("deviation"))


@query("a12_feedback_adjustment", f"""
WITH {EVENTS_SQL}, l AS (SELECT event_type, list(CASE WHEN k % 3 = 0 THEN -1 ELSE 1 END ORDER BY us, event_id) AS ms FROM ev GROUP BY 1)
SELECT event_type, round(list_reduce(ms, lambda a, m: least(5, greatest(-5, a + m)), 0) * 0.1::DOUBLE, 6) AS adjustment FROM l""")
def _(spark, d):
    e = events(spark, d).withColumn("fp", F.col("k") % 3 == 0)
    return ln.feedback_adjustment(e, "event_type", "us", "event_id", "fp")


@query("a13_client_event_risk", f"""
WITH {EVENTS_SQL}, g AS (SELECT user_id, count(*) AS events, ({AS_OF_US + 11 * DAY} - max(us)) / {DAY}.0 AS age FROM ev WHERE value >= 120 GROUP BY 1)
SELECT user_id, events, round(CASE WHEN age > 30 THEN 0 ELSE CASE WHEN events >= 10 THEN 1.0 WHEN events >= 3 THEN 0.6 ELSE 0.3 END * CASE WHEN age > 7 THEN 0.5 ELSE 1 END END::DOUBLE, 4) AS risk, events >= 3 AS frozen FROM g""")
def _(spark, d):
    r = ln.client_event_risk(events(spark, d).filter("value >= 120"), "user_id", "us", F.lit(AS_OF_US + 11 * DAY))
    return r.withColumn("risk", F.round("risk", 4))


@query("a14_parameter_safelist", f"""
WITH {EVENTS_SQL}, p AS (SELECT 'p' || k % 40 || '_' || event_type AS name, value < 150 AS safe FROM ev)
SELECT name, count(*) FILTER (WHERE safe) AS safe, count(*) FILTER (WHERE NOT safe) AS blocked, CASE WHEN count(*) FILTER (WHERE NOT safe) > 0 THEN 0.0
  WHEN count(*) FILTER (WHERE safe) >= 20 THEN 1.0 WHEN count(*) FILTER (WHERE safe) >= 5 THEN 0.7 ELSE 0.0 END::DOUBLE AS confidence FROM p GROUP BY 1""")
def _(spark, d):
    e = events(spark, d).withColumn("name", F.concat(F.lit("P"), (F.col("k") % 40).cast("string"), F.lit("_"), F.col("event_type")))
    return ln.parameter_safelist(e, "name", F.col("value") < 150)


TEMPL_SQL = f"""{EVENTS_SQL}, rq AS (SELECT event_id, value, 'GET' AS method, '/' || event_type AS template, ['a' || k % 3, 'b' || k % 4] AS names FROM ev),
sm AS (SELECT method, template, names, count(*) AS n FROM rq WHERE value < 3 GROUP BY 1, 2, 3),
fb AS (SELECT method, template, names, count(*) AS f FROM rq WHERE value >= 190 GROUP BY 1, 2, 3),
lt AS (SELECT method, template, names, CASE WHEN f IS NULL THEN n ELSE greatest(coalesce(n, 0), 10) END AS samples, coalesce(f, 0) >= 3 AS degraded FROM sm FULL JOIN fb USING (method, template, names))"""


def requests(spark, d):
    k = F.col("k")
    return events(spark, d).select("event_id", "value", F.lit("GET").alias("method"), F.concat(F.lit("/"), "event_type").alias("template"),
                                   F.array(F.concat(F.lit("a"), (k % 3).cast("string")), F.concat(F.lit("b"), (k % 4).cast("string"))).alias("names"))


def templates(r):
    fb = r.filter("value >= 190").groupBy("method", "template", "names").agg(F.count("*").alias("false_positives"))
    return ln.learn_templates(r, "method", "template", "names", "value", fb, below=3)


@query("a15_learned_templates", f"WITH {TEMPL_SQL} SELECT template, array_to_string(names, ',') AS names, samples, degraded FROM lt")
def _(spark, d):
    return templates(requests(spark, d)).select("template", F.concat_ws(",", "names").alias("names"), "samples", "degraded")


@query("j7_template_match", f"""
WITH {TEMPL_SQL} SELECT event_id, max(samples) AS samples FROM rq JOIN lt ON rq.template = lt.template AND lt.samples >= 10 AND NOT degraded
  AND len(list_intersect(rq.names, lt.names)) / 2 >= 0.8 GROUP BY 1""")
def _(spark, d):
    r = requests(spark, d)
    return ln.template_match(r, ["event_id"], "method", "template", "names", templates(r))


# ---- joins ---------------------------------------------------------------------------------

@query("j1_range_country", f"WITH {GEO_SQL} SELECT o_orderkey, country FROM orders LEFT JOIN g ON o_custkey = c_custkey")
def _(spark, d):
    return jn.range_lookup(table(spark, d, "orders"), "o_custkey", ranges(spark, d), 64).select("o_orderkey", F.col("value").alias("country"))


BLOCKS_SQL = "b AS (SELECT s_suppkey * 13 AS s, s_suppkey * 13 + 4 AS e FROM supplier)"


@query("j2_block_members", f"WITH {BLOCKS_SQL} SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM b WHERE o_custkey BETWEEN s AND e)")
def _(spark, d):
    return jn.in_ranges(table(spark, d, "orders"), "o_custkey", blocks(spark, d), True, 64).select("o_orderkey")


@query("j2_block_others", f"WITH {BLOCKS_SQL} SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM b WHERE o_custkey BETWEEN s AND e)")
def _(spark, d):
    return jn.in_ranges(table(spark, d, "orders"), "o_custkey", blocks(spark, d), False, 64).select("o_orderkey")


def blocks(spark, d):
    return table(spark, d, "supplier").select((F.col("s_suppkey") * 13).alias("start"), (F.col("s_suppkey") * 13 + 4).alias("end"))


@query("j10_under_ban", f"""
WITH {EVENTS_SQL} SELECT event_id FROM ev a WHERE EXISTS (SELECT 1 FROM ev b WHERE b.user_id = a.user_id AND b.event_type = 'error' AND b.value >= 80
  AND a.us >= b.us AND (a.us < b.us + {hours(36)} OR b.value >= 250)) AND user_id NOT IN (SELECT user_id FROM ev WHERE value >= 350)""")
def _(spark, d):
    e = events(spark, d)
    bans = e.filter((F.col("event_type") == "error") & (F.col("value") >= 80)).select(
        "user_id", F.col("us").alias("start"), F.when(F.col("value") < 250, F.col("us") + hours(36)).alias("expire"))
    return jn.under_ban(e, "user_id", "us", "event_id", bans, e.filter("value >= 350")).select("event_id")


INVENTORY = """(SELECT path, arg_max(k, us) AS v FROM (SELECT '/' || user_id || '/' || k % 5 AS path, k, us FROM ev WHERE {}) GROUP BY 1)"""
CUTS = f"us >= {AS_OF_US - 4 * DAY} AND us < {AS_OF_US}", f"us >= {AS_OF_US - 2 * DAY} AND us < {AS_OF_US + 2 * DAY}"


@query("j11_snapshot_diff", f"""
WITH {EVENTS_SQL}, a AS {INVENTORY.format(CUTS[0])}, b AS {INVENTORY.format(CUTS[1])}
SELECT path, CASE WHEN a.v IS NULL THEN 'added' WHEN b.v IS NULL THEN 'removed' WHEN a.v <> b.v THEN 'changed' ELSE 'same' END AS status FROM a FULL JOIN b USING (path)""")
def _(spark, d):
    e = events(spark, d).withColumn("path", F.concat(F.lit("/"), F.col("user_id").cast("string"), F.lit("/"), (F.col("k") % 5).cast("string")))
    a, b = (e.filter(c).groupBy("path").agg(F.md5(F.max_by("k", "us").cast("string")).alias("md5")) for c in CUTS)
    return jn.snapshot_diff(a, b, "path", "md5")


@query("j12_line_diff", """
WITH l AS (SELECT conv_id, role, unnest(string_split(text, chr(10))) AS line FROM conversations), x AS (SELECT conv_id, role, md5(trim(line)) AS h FROM l WHERE role IN ('user', 'assistant')),
d AS (SELECT conv_id, 'added' AS change FROM x a WHERE role = 'assistant' AND NOT EXISTS (SELECT 1 FROM x b WHERE b.conv_id = a.conv_id AND b.role = 'user' AND b.h = a.h)
  UNION ALL SELECT conv_id, 'removed' FROM x a WHERE role = 'user' AND NOT EXISTS (SELECT 1 FROM x b WHERE b.conv_id = a.conv_id AND b.role = 'assistant' AND b.h = a.h))
SELECT conv_id, change, count(*) AS lines FROM d GROUP BY 1, 2""")
def _(spark, d):
    c = table(spark, d, "conversations")
    r = jn.line_diff(c.filter("role = 'user'"), c.filter("role = 'assistant'"), ["conv_id"], "text")
    return r.groupBy("conv_id", "change").agg(F.count("*").alias("lines"))


@query("j13_decoy_hits", f"""
WITH {EVENTS_SQL}, h AS (SELECT * FROM ev WHERE event_type IN ('error', 'signup'))
SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY us RANGE BETWEEN {hours(72) - 1} PRECEDING AND CURRENT ROW) AS recent FROM h""")
def _(spark, d):
    e = events(spark, d).withColumn("uri", F.concat(F.lit("/"), "event_type", F.lit("/x?k=1")))
    return jn.decoy_hits(e, "user_id", "us", "uri", ["/error", "/signup/"[:-1]], hours(72)).select("event_id", "recent")


@query("j18_endpoint_coverage", f"""
WITH {EVENTS_SQL}, kn AS (SELECT DISTINCT k FROM ev WHERE value >= 300) SELECT user_id, count(DISTINCT k) AS visited, round(count(DISTINCT k) / (SELECT count(*) FROM kn), 4) AS coverage
FROM ev WHERE k IN (SELECT k FROM kn) GROUP BY 1""")
def _(spark, d):
    e = events(spark, d)
    return jn.endpoint_coverage(e, "user_id", "k", e.filter("value >= 300")).withColumn("coverage", F.round("coverage", 4))


@query("u2_new_values", f"""
WITH {EVENTS_SQL} SELECT user_id, k FROM (SELECT DISTINCT user_id, k FROM ev WHERE us >= {AS_OF_US}) EXCEPT SELECT user_id, k FROM ev WHERE us < {AS_OF_US}""")
def _(spark, d):
    e = events(spark, d)
    return e.filter(F.col("us") >= AS_OF_US).select("user_id", "k").subtract(e.filter(F.col("us") < AS_OF_US).select("user_id", "k"))


@query("u3_name_overlap", f"""
WITH {EVENTS_SQL}, a AS (SELECT user_id, list(DISTINCT k % 40) FILTER (WHERE us < {AS_OF_US}) AS x, list(DISTINCT k % 40) FILTER (WHERE us >= {AS_OF_US}) AS y FROM ev GROUP BY 1)
SELECT user_id, round(len(list_intersect(x, y)) / len(x), 4) AS share FROM a WHERE x IS NOT NULL AND y IS NOT NULL""")
def _(spark, d):
    e = events(spark, d).withColumn("v", F.col("k") % 40)
    a = e.groupBy("user_id").agg(F.collect_set(F.when(F.col("us") < AS_OF_US, F.col("v"))).alias("x"), F.collect_set(F.when(F.col("us") >= AS_OF_US, F.col("v"))).alias("y"))
    return a.filter((F.size("x") > 0) & (F.size("y") > 0)).select("user_id", F.round(F.size(F.array_intersect("x", "y")) / F.size("x"), 4).alias("share"))


@query("u4_distinct_labels", f"WITH {EVENTS_SQL} SELECT DISTINCT user_id, event_type AS label FROM ev WHERE value >= 100")
def _(spark, d):
    return events(spark, d).filter("value >= 100").select("user_id", F.col("event_type").alias("label")).distinct()


# ---- text model ----------------------------------------------------------------------------

BAYES_SQL = r"""tx AS (SELECT doc_id, CASE WHEN toxic = 1 THEN 'attack' ELSE 'normal' END AS class, lower(trim(text)) AS t FROM documents LEFT JOIN labels USING (doc_id)),
gr AS (SELECT doc_id, unnest(list_transform(range(1, length(t)), lambda i: substr(t, i, 2)) || list_transform(range(1, length(t) - 1), lambda i: substr(t, i, 3))) AS token FROM tx WHERE length(t) >= 4
  UNION ALL SELECT doc_id, t FROM tx WHERE length(t) < 4 AND t <> ''
  UNION ALL SELECT doc_id, m FROM tx, (VALUES MARKS) AS v(m, p) WHERE length(t) >= 4 AND regexp_matches(t, p)),
tc AS (SELECT doc_id, token, count(*) AS n FROM gr GROUP BY 1, 2),
md AS (SELECT class, token, sum(n)::BIGINT AS n FROM tc JOIN tx USING (doc_id) JOIN labels USING (doc_id) GROUP BY 1, 2),
cl AS (SELECT class, count(*) AS n FROM tx JOIN labels USING (doc_id) WHERE t <> '' GROUP BY 1)""".replace("MARKS", values_sql(nb.MARKERS))


def _labelled(spark, d):
    lab = table(spark, d, "labels")
    return documents(spark, d).join(lab, "doc_id").select("doc_id", "text", F.when(F.col("toxic") == 1, "attack").otherwise("normal").alias("label"))


@query("a9_bayes_train", f"WITH {BAYES_SQL} SELECT class, token, n FROM md")
def _(spark, d):
    return nb.train(_labelled(spark, d), "text", "label")[1]


@query("j9_token_scores", f"""
WITH {BAYES_SQL}, pv AS (SELECT token, coalesce(sum(n) FILTER (WHERE class = 'attack'), 0) AS a, coalesce(sum(n) FILTER (WHERE class = 'normal'), 0) AS b FROM md GROUP BY 1),
v AS (SELECT count(*) AS v, sum(a) AS ta, sum(b) AS tb FROM pv)
SELECT token, round(ln((a + 1) / (ta + v)) - ln((b + 1) / (tb + v)), 5) AS log_odds FROM pv, v""")
def _(spark, d):
    tokens = nb.train(_labelled(spark, d), "text", "label")[1]
    m = tokens.groupBy("token").agg(F.sum(F.when(F.col("class") == "attack", F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("class") == "normal", F.col("n")).otherwise(0)).alias("b"))
    t = m.agg(F.count("*").alias("v"), F.sum("a").alias("ta"), F.sum("b").alias("tb"))
    for c in ("v", "ta", "tb"):
        m = m.withColumn(c, t.select(c).scalar())
    return m.select("token", F.round(F.log((F.col("a") + 1) / (F.col("ta") + F.col("v"))) - F.log((F.col("b") + 1) / (F.col("tb") + F.col("v"))), 5).alias("log_odds"))


@query("a10_bayes_score", f"""
WITH {BAYES_SQL}, pv AS (SELECT token, coalesce(sum(n) FILTER (WHERE class = 'attack'), 0) AS a, coalesce(sum(n) FILTER (WHERE class = 'normal'), 0) AS b FROM md GROUP BY 1),
v AS (SELECT count(*) AS v, sum(a) AS ta, sum(b) AS tb FROM pv), c AS (SELECT sum(n) FILTER (WHERE class = 'attack') AS na, sum(n) FILTER (WHERE class = 'normal') AS nb FROM cl),
s AS (SELECT doc_id, sum(n * ln((coalesce(a, 0) + 1) / (ta + v))) AS la, sum(n * ln((coalesce(b, 0) + 1) / (tb + v))) AS lb,
  count(*) FILTER (WHERE a > 0 OR b > 0) / sum(n) AS match FROM tc LEFT JOIN pv USING (token), v GROUP BY 1),
p AS (SELECT doc_id, match, round(1 / (1 + exp(least(700, lb + ln((nb + 1) / (na + nb + 2)) - la - ln((na + 1) / (na + nb + 2))))), 4) AS pr FROM s, c),
f AS (SELECT *, round(abs(pr - 0.5) * 2 * CASE WHEN match < 0.1 THEN 0.5 ELSE 1 END, 4) AS cf FROM p)
SELECT doc_id, CASE WHEN pr > 0.5 THEN 'attack' ELSE 'normal' END AS class, pr AS probability, cf AS confidence, round(least(100, pr * 100 * cf), 1) AS score FROM f""")
def _(spark, d):
    classes, tokens = nb.store(nb.train(_labelled(spark, d), "text", "label"), new_path(spark, "model"))
    return nb.score(documents(spark, d), ["doc_id"], "text", classes, tokens).select("doc_id", "class", "probability", "confidence", "score")


@query("a11_model_merge", f"WITH {BAYES_SQL}, b2 AS (SELECT class, token, n FROM md UNION ALL SELECT 'normal', token, sum(n)::BIGINT FROM tc GROUP BY 2) SELECT class, token, sum(n)::BIGINT AS n FROM b2 GROUP BY 1, 2")
def _(spark, d):
    old = nb.train(_labelled(spark, d), "text", "label")[1]
    new = nb.train(documents(spark, d).withColumn("label", F.lit("normal")), "text", "label")[1]
    return nb.merge(old, new, ["class", "token"])


# ---- bots ----------------------------------------------------------------------------------

AGENTS = ["Mozilla/5.0 (compatible; Googlebot/2.1)", "curl/8.0", "Mozilla/5.0 HeadlessChrome/120", "GPTBot/1.0", "Twitterbot/1.0", "Mozilla/5.0 (Windows NT 10.0) Firefox/120",
          "Googlebot python-requests/2.31", "", "AhrefsBot/7.0", "Mozilla/5.0 Bingbot/2.0 Puppeteer"]
KINDS = ["search_engine", "tool", "headless", "ai", "social", "browser", "forged", "empty", "search_engine", "forged"]


def agents(spark, d):
    k = F.col("k")
    agent = F.element_at(F.array(*[F.lit(a) for a in AGENTS]), (k % 10 + 1).cast("int"))
    e = events(spark, d).withColumn("agent", agent)
    h = F.filter(F.array(*[F.struct(F.lit(n).alias("k"), v.alias("v")) for n, v in (
        ("host", F.when(k % 7 > 0, "example.org")), ("user-agent", F.nullif("agent", F.lit(""))), ("accept", F.when(k % 3 == 0, "*/*").when(k % 3 == 1, "text/html")),
        ("accept-language", F.when(k % 4 < 2, "en-US,en;q=0.5")), ("accept-encoding", F.when(k % 5 > 0, "gzip")), ("x-forwarded-for", F.when(k % 11 == 0, "1, 2, 3, 4, 5")),
        ("referer", F.when(k % 2 == 0, "https://example.org/")))]), lambda x: x["v"].isNotNull())
    return e.withColumn("headers", F.map_from_entries(h))


AGENT_SQL = f"""{EVENTS_SQL}, ag AS (SELECT *, {str(AGENTS)}[k % 10 + 1] AS agent, {str(KINDS)}[k % 10 + 1] AS kind FROM ev)"""


@query("p17_agent_class", f"WITH {AGENT_SQL} SELECT event_id, CASE k % 10 WHEN 0 THEN 'Google' WHEN 4 THEN 'Twitter_X' WHEN 6 THEN 'Google' WHEN 8 THEN 'Ahrefs' WHEN 9 THEN 'Bing' END AS engine, kind AS agent_kind FROM ag")
def _(spark, d):
    return bt.agent_class(agents(spark, d), "agent").select("event_id", "engine", "agent_kind")


HEADER_SQL = f"""{AGENT_SQL}, hs AS (SELECT *, k % 10 IN (0, 4, 6, 8, 9) AS se, agent <> '' AS ua, k % 10 IN (0, 2, 5, 9) AS moz,
  (k % 3 = 2)::INT + (k % 4 >= 2)::INT + (k % 5 = 0)::INT AS miss FROM ag), hx AS (SELECT *, CASE WHEN se THEN 0.3::DOUBLE ELSE 1 END AS cut FROM hs),
hw AS (SELECT *, CASE WHEN miss >= 2 THEN round(miss * 10 * cut) ELSE 0 END AS w1, CASE WHEN k % 3 = 2 AND ua AND NOT se THEN 12 ELSE 0 END AS w2, CASE WHEN k % 3 = 0 THEN round(18 * cut) ELSE 0 END AS w3,
  CASE WHEN k % 4 >= 2 AND ua AND NOT se THEN 15 ELSE 0 END AS w4, CASE WHEN k % 7 = 0 AND ua THEN 25 ELSE 0 END AS w5, CASE WHEN k % 2 = 1 AND moz AND NOT se THEN 6 ELSE 0 END AS w6,
  CASE WHEN k % 11 = 0 THEN 15 ELSE 0 END AS w7 FROM hx)"""


@query("p18_header_signals", f"WITH {HEADER_SQL} SELECT event_id, CAST(w1 + w2 + w3 + w4 + w5 + w6 + w7 AS BIGINT) AS header_score FROM hw")
def _(spark, d):
    a = bt.agent_class(agents(spark, d), "agent")
    return bt.header_signals(a, "headers", F.col("engine").isNotNull()).select("event_id", F.col("header_score").cast("bigint").alias("header_score"))


def _voted(spark, d):
    a = bt.header_signals(bt.agent_class(agents(spark, d), "agent"), "headers", F.col("engine").isNotNull())
    k, v = F.col("k"), F.col("value")
    return bt.category_vote(a, verified=k % 4 < 2, fingerprint=F.col("header_score"), semantic=v, chain=v / 2, variety=k, uniformity=(k * 3) % 101, bias=(k * 7) % 101)


@query("a28_bot_category", f"""
WITH {HEADER_SQL}, vt AS (SELECT *, w1 + w2 + w3 + w4 + w5 + w6 + w7 AS fp, se AND k % 10 IN (6, 9) AS forged, k % 10 IN (1, 6) AS tool, k % 10 IN (2, 9) AS headless, k % 4 < 2 AS ver FROM hw),
sv AS (SELECT *, CASE WHEN fp < 25 AND value < 30 AND value / 2 < 20 THEN 40 ELSE 0 END AS v0, CASE WHEN se AND ver AND NOT forged THEN 50 ELSE 0 END AS v1, CASE WHEN k % 10 = 4 THEN 45 ELSE 0 END AS v2,
  CASE WHEN k % 10 = 3 THEN 70 ELSE 0 END AS v3,
  CASE WHEN se AND NOT (ver AND NOT forged) THEN 20 ELSE 0 END + CASE WHEN agent = '' THEN 25 ELSE 0 END + CASE WHEN w1 > 0 THEN 15 ELSE 0 END + CASE WHEN w3 > 0 THEN 15 ELSE 0 END + CASE WHEN w4 > 0 THEN 15 ELSE 0 END
    + CASE WHEN w5 > 0 THEN 15 ELSE 0 END + CASE WHEN w7 > 0 THEN 15 ELSE 0 END + CASE WHEN k >= 60 THEN 20 ELSE 0 END + CASE WHEN k * 3 % 101 >= 70 THEN 20 ELSE 0 END
    + CASE WHEN value >= 60 AND NOT tool AND NOT headless THEN 15 ELSE 0 END AS v4,
  CASE WHEN tool THEN 40 ELSE 0 END + CASE WHEN tool AND se THEN 35 ELSE 0 END + CASE WHEN headless AND se THEN 45 ELSE 0 END + CASE WHEN k * 7 % 101 >= 70 THEN 20 ELSE 0 END + CASE WHEN value / 2 >= 50 THEN 30 ELSE 0 END
    + CASE WHEN value >= 60 AND (tool OR headless) THEN 15 ELSE 0 END AS v5 FROM vt),
l AS (SELECT event_id, unnest([v0, v1, v2, v3, v4, v5]) AS v, unnest([0, 1, 2, 3, 4, 5]) AS i FROM sv),
r AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY v DESC, i) AS rn FROM l),
t AS (SELECT event_id, max(v) FILTER (WHERE rn = 1) AS a, max(v) FILTER (WHERE rn = 2) AS b, max(i) FILTER (WHERE rn = 1) AS i FROM r GROUP BY 1)
SELECT event_id, CASE WHEN a < 15 THEN 'human' ELSE ['human', 'search_engine', 'social_media', 'ai', 'crawler', 'malicious_bot'][i + 1] END AS category,
  CAST(CASE WHEN a < 15 THEN 50 ELSE least(100, greatest(30, round(40 + a * 0.5 + (a - b) * 1.5))) END AS BIGINT) AS category_confidence FROM t""")
def _(spark, d):
    return _voted(spark, d).select("event_id", "category", "category_confidence")


@query("a29_bot_total", f"""
WITH {EVENTS_SQL}, s AS (SELECT event_id, k, value, event_type, least(100, trunc(least(30, k * 0.3)) + trunc(least(25, (k * 3 % 101) * 0.25)) + trunc(least(25, (k * 7 % 101) * 0.25))
    + CASE WHEN value > 120 THEN 20 WHEN value > 60 THEN 12 WHEN value > 30 THEN 6 ELSE 0 END) AS bs,
  least(100, trunc(least(60, (k * 5 % 101) * 0.6)) + least(25, k % 8 * 5) + CASE WHEN k > 50 THEN 15 WHEN k > 20 THEN 8 ELSE 0 END + CASE WHEN event_type = 'error' THEN 10 ELSE 0 END) AS cs FROM ev),
t AS (SELECT *, CAST(least(100, round((k * 11 % 101) * 0.30 + (k * 13 % 101) * 0.30 + bs * 0.25 + cs * 0.15)) AS BIGINT) AS total,
  CASE event_type WHEN 'view' THEN 'human' WHEN 'click' THEN 'crawler' WHEN 'signup' THEN 'ai' WHEN 'error' THEN 'malicious_bot' ELSE 'unknown' END AS cat FROM s)
SELECT event_id, total, CASE WHEN cat = 'ai' THEN CASE WHEN total >= 85 THEN 'challenge' ELSE 'allow' END WHEN cat = 'malicious_bot' THEN CASE WHEN total >= 75 THEN 'block' WHEN total >= 50 THEN 'limit' ELSE 'challenge' END
  WHEN cat IN ('crawler', 'human') THEN CASE WHEN total >= 75 THEN 'limit' WHEN total >= 50 THEN 'challenge' ELSE 'allow' END
  ELSE CASE WHEN total >= 75 THEN 'block' WHEN total >= 50 THEN 'challenge' ELSE 'allow' END END AS action FROM t""")
def _(spark, d):
    k, v, t = F.col("k"), F.col("value"), F.col("event_type")
    b = bt.behaviour_score(k, (k * 3) % 101, (k * 7) % 101, v)
    c = bt.probing_score((k * 5) % 101, k % 8, k, t == "error")
    e = events(spark, d).withColumn("total", bt.bot_total((k * 11) % 101, (k * 13) % 101, b, c))
    cat = first_of([(t == "view", "human"), (t == "click", "crawler"), (t == "signup", "ai"), (t == "error", "malicious_bot")], "unknown")
    return e.select("event_id", "total", bt.bot_action(cat, F.col("total")).alias("action"))


# ---- scoring -------------------------------------------------------------------------------

VECTORS = ["path", "query", "post", "headers", "user_agent", "referer", "cookie", "body"]
VEC_SQL = f"""{EVENTS_SQL}, vc AS (SELECT event_id, value, {', '.join(f"greatest(0, (k * {i * 2 + 3}) % 61 - 20) AS {n}" for i, n in enumerate(VECTORS))} FROM ev)"""
LIST = "[" + ", ".join(VECTORS) + "]"


def vectors(spark, d):
    e = events(spark, d)
    return e.select("event_id", "value", "k", *[F.greatest(F.lit(0), (F.col("k") * (i * 2 + 3)) % 61 - 20).alias(n) for i, n in enumerate(VECTORS)])


@query("a22_vector_fusion", f"""
WITH {VEC_SQL}, c AS (SELECT *, list_max({LIST}) AS mx, len(list_filter({LIST}, lambda x: x >= 30)) AS hi, len(list_filter({LIST}, lambda x: x >= 15 AND x < 30)) AS mid, len(list_filter({LIST}, lambda x: x > 0)) AS act FROM vc)
SELECT event_id, least(100, mx + CASE WHEN hi >= 2 THEN 15 WHEN hi >= 1 AND mid >= 1 THEN 8 ELSE 0 END + CASE WHEN act >= 5 THEN 10 ELSE 0 END) AS fusion, act AS active,
  {str(VECTORS)}[list_position({LIST}, mx)] AS "primary" FROM c""")
def _(spark, d):
    return sc.fuse_vectors(vectors(spark, d), VECTORS).select("event_id", "fusion", "active", "primary")


COMPS = list(sc.COMPONENT_WEIGHTS)


@query("a23_component_score", f"""
WITH {EVENTS_SQL}, c AS (SELECT event_id, k, value, {' + '.join(f"((k * {i + 2}) % 71) * {w}::DOUBLE" for i, w in enumerate(sc.COMPONENT_WEIGHTS.values()))} AS t,
  {' + '.join(f"((k * {i + 2}) % 71 >= 50)::INT" for i in range(len(COMPS)))} AS hi FROM ev)
SELECT event_id, round(least(100, t + CASE WHEN k >= 30 THEN k * 0.08 ELSE 0 END + CASE WHEN value >= 50 THEN value * 0.12 WHEN value >= 30 THEN value * 0.06 ELSE 0 END
  + CASE WHEN hi >= 6 THEN 18 WHEN hi >= 5 THEN 15 WHEN hi >= 4 THEN 10 WHEN hi >= 3 THEN 6 WHEN hi >= 2 THEN 3 ELSE 0 END), 5) AS score FROM c""")
def _(spark, d):
    comps = {n: (F.col("k") * (i + 2)) % 71 for i, n in enumerate(COMPS)}
    return events(spark, d).select("event_id", F.round(sc.component_score(comps, F.col("k"), F.col("value")), 5).alias("score"))


@query("a24_final_score", f"""
WITH {EVENTS_SQL}, b AS (SELECT *, least(100, round((k * 3 % 101) * 0.08::DOUBLE + ln(value + 1) * 15 * 0.45::DOUBLE + (k * 11 % 101) * 0.20::DOUBLE + (k * 13 % 101) * 0.12::DOUBLE + (k * 17 % 101) * 0.08::DOUBLE + k % 20, 1)) AS base FROM ev),
c AS (SELECT *, greatest(0, base - CASE WHEN event_type IN ('view', 'click') THEN CASE WHEN k >= 90 THEN 30 WHEN k >= 75 THEN 15 ELSE 5 END ELSE 0 END) AS x FROM b),
d AS (SELECT *, least(100, greatest(greatest(0, x - CASE WHEN k % 5 = 0 THEN 10 ELSE 0 END), CASE WHEN event_type = 'error' THEN 72 ELSE 0 END) + least(25, value * 0.3)) AS total FROM c)
SELECT event_id, round(total, 4) AS total, CASE WHEN total >= 75 THEN 'block' WHEN total >= 50 THEN 'observe' WHEN total >= 30 THEN 'log' ELSE 'pass' END AS action,
  CASE WHEN total >= 80 THEN 'critical' WHEN total >= 60 THEN 'high' WHEN total >= 40 THEN 'medium' WHEN total >= 20 THEN 'low' ELSE 'clean' END AS risk FROM d""")
def _(spark, d):
    k, t = F.col("k"), F.col("event_type")
    r = sc.final_score(events(spark, d), entropy=k * 3 % 101, semantic=F.log(F.col("value") + 1) * 15, structure=k * 11 % 101, deviation=k * 13 % 101, bayes=k * 17 % 101, bonus=k % 20,
                       false_positive=t.isin("view", "click"), fp_confidence=k, verify=k % 5 == 0, evidence=F.when(t == "error", 72.0).otherwise(0.0), behaviour=F.col("value"))
    return r.select("event_id", F.round("total", 4).alias("total"), "action", "risk")


@query("a38_context_score", f"""
WITH {EVENTS_SQL} SELECT event_id, CAST(least(100, round(greatest((k * 3 % 101) * 0.30::DOUBLE, (k * 5 % 101) * 0.25::DOUBLE, (k * 7 % 101) * 0.30::DOUBLE, (k * 11 % 101) * 0.25::DOUBLE, (k * 13 % 101) * 0.30::DOUBLE,
  (k * 17 % 101) * 0.25::DOUBLE) / 100 / 0.30::DOUBLE * 100)) AS BIGINT) AS score FROM ev""")
def _(spark, d):
    k = F.col("k")
    risks = {n: k * m % 101 for n, m in zip(sc.CONTEXT_WEIGHTS, (3, 5, 7, 11, 13, 17))}
    return events(spark, d).select("event_id", sc.context_score(risks).cast("bigint").alias("score"))


@query("a39_encoding_bonus", f"""
WITH {EVENTS_SQL}, c AS (SELECT *, k % 6 AS dp, CASE k % 4 WHEN 0 THEN 0 WHEN 1 THEN 3 WHEN 2 THEN 11 ELSE 17 END AS worth, k % 4 AS kn FROM ev)
SELECT event_id, CASE WHEN dp <= 0 OR value < 20 THEN 0 WHEN value < 35 THEN least(5, dp) ELSE least(45, CASE WHEN dp >= 4 THEN 12 WHEN dp >= 3 THEN 8 WHEN dp >= 2 THEN 4 ELSE 2 END + worth
  + CASE WHEN k >= 70 THEN 8 WHEN k >= 50 THEN 5 WHEN k >= 30 THEN 2 ELSE 0 END + CASE WHEN k % 30 >= 20 THEN 6 WHEN k % 30 >= 10 THEN 3 ELSE 0 END
  + CASE WHEN value >= 60 AND dp >= 2 THEN 8 WHEN value >= 45 THEN 4 ELSE 0 END + CASE WHEN kn >= 3 THEN 6 WHEN kn >= 2 THEN 3 ELSE 0 END) END AS bonus FROM c""")
def _(spark, d):
    k = F.col("k")
    tech = F.slice(F.array(*[F.lit(t) for t in ("base64", "unicode_percent_u", "zero_width_remove")]), 1, (k % 4).cast("int"))
    return events(spark, d).select("event_id", sc.encoding_bonus(k % 6, tech, F.col("value"), k, k % 30).alias("bonus"))


@query("f8_trusted_template", r"""
SELECT page_id, CASE WHEN contains(url, 'page=') OR contains(url, '/admin') OR page_id % 4 = 1 THEN CASE WHEN page_id % 4 = 1 THEN 'json_data' WHEN contains(url, 'page=') THEN 'api_pagination' END END AS template FROM pages""")
def _(spark, d):
    u = F.col("url")
    h = F.when(F.col("page_id") % 4 == 1, F.create_map(F.lit("content-type"), F.lit("application/json"))).otherwise(F.create_map(F.lit("host"), F.lit("x")))
    only = [t for t in sc.TRUSTED_TEMPLATES if t[0] in ("json_data", "api_pagination", "csrf_token_param", "wp_rest_api")]
    only = [(n, {k: v for k, v in c.items() if k != "value"}) for n, c in only]
    return pages(spark, d).select("page_id", sc.trusted_template(u, F.lit("GET"), h, uri.query_pairs(u), only).alias("template"))


@query("a25_false_positive", f"""
WITH {EVENTS_SQL}, b AS (SELECT *, value >= 80 AS top, (k % 10) / 10.0 AS ts2 FROM ev),
c AS (SELECT *, (k % 2 = 0 AND NOT top)::INT * 10 + (k % 3 = 0 AND NOT top)::INT * 15 + CASE WHEN ts2 >= 0.8 AND NOT top THEN 10 WHEN ts2 >= 0.5 THEN 5 ELSE 0 END + (k % 5 = 0 AND NOT top)::INT * 10
  + (k % 7 < 3)::INT * 15 + (k % 11 < 6)::INT * 15 + (k % 13 < 5)::INT * 10 + (event_type <> 'error')::INT * 15 + (k % 4 = 1)::INT * 10 + CASE WHEN NOT top THEN k % 16 ELSE 0 END AS raw FROM b),
d AS (SELECT *, CASE WHEN top THEN least(raw, 40) ELSE raw END + CASE WHEN NOT top AND k % 10 >= 5 THEN 10 ELSE 0 END AS cf FROM c),
e AS (SELECT *, CASE WHEN value < 10 AND event_type <> 'error' THEN 100 ELSE cf END AS fp_confidence FROM d)
SELECT event_id, CAST(fp_confidence AS BIGINT) AS fp_confidence, fp_confidence >= 60 AS is_false_positive, value >= 50 AND fp_confidence >= 40 AND fp_confidence < 70 AS needs_verification FROM e""")
def _(spark, d):
    k, t = F.col("k"), F.col("event_type")
    r = sc.false_positive(events(spark, d), score=F.col("value"), template=k % 2 == 0, learned=k % 3 == 0, trusted_share=(k % 10) / 10, safelisted=k % 5 == 0, weak=k % 7 < 3,
                          consistent=k % 11 < 6, uneven=k % 13 < 5, harmless=t != "error", clean=k % 4 == 1, mismatch=k % 16, reduction=1 - (k % 10) / 10, keyword=t == "error")
    return r.select("event_id", "fp_confidence", "is_false_positive", "needs_verification")


@query("a40_decision", f"""
WITH {EVENTS_SQL} SELECT event_id, CASE WHEN k % 17 = 0 OR k % 19 = 0 OR k % 23 = 0 OR k % 29 = 0 THEN 'block' WHEN event_type = 'view' THEN 'allow' WHEN value >= 70 THEN 'block' WHEN value >= 40 THEN 'monitor' ELSE 'allow' END AS action,
  CASE WHEN k % 17 = 0 THEN 'decoy' WHEN k % 19 = 0 THEN 'predicted_path' WHEN k % 23 = 0 THEN 'attack_chain' WHEN k % 29 = 0 THEN 'phase_jump' WHEN event_type = 'view' THEN 'false_positive' WHEN value >= 40 THEN 'score'
    WHEN k % 3 = 0 THEN 'suspicious' ELSE 'none' END AS reason FROM ev""")
def _(spark, d):
    k = F.col("k")
    action, reason = sc.decide(k % 17 == 0, k % 19 == 0, k % 23 == 0, k % 29 == 0, k % 3 == 0, F.col("event_type") == "view", F.col("value"))
    return events(spark, d).select("event_id", action.alias("action"), reason.alias("reason"))
