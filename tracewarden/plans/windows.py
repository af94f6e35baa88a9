"""Queries over ordered events: rates, replay, sessions, escalation."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewarden.operators import sequences as sq
from tracewarden.operators import timeline as tl
from tracewarden.operators.timeline import HOUR, SECOND
from tracewarden.plans.registry import EVENTS_SQL, events, query, table

KEY = ["user_id"]


def hours(h: float) -> int:
    return int(h * HOUR)


def frame(keys: str, width: int, closed: bool = False) -> str:
    w = width if closed else width - 1
    return f"OVER (PARTITION BY {keys} ORDER BY us RANGE BETWEEN {w} PRECEDING AND CURRENT ROW)"


@query("w1_sliding_rate", f"""
WITH {EVENTS_SQL}, c AS (SELECT event_id, user_id, count(*) {frame('user_id', hours(24))} AS in_window FROM ev)
SELECT event_id, user_id, in_window, in_window - 1 >= 4 AS refused FROM c""")
def _(spark, d):
    r = sq.sliding_rate(events(spark, d), KEY, "us", hours(24), 4, piece=hours(48))
    return r.select("event_id", "user_id", "in_window", "refused")


@query("w2_path_limits", f"""
WITH {EVENTS_SQL}, m AS (
  SELECT *, CASE WHEN event_type = 'signup' THEN 'login' WHEN event_type IN ('click', 'view') THEN 'api' END AS rule FROM ev),
c AS (
  SELECT event_id, rule, CASE WHEN rule = 'login' THEN count(*) {frame('rule, user_id', hours(72))}
    ELSE count(*) {frame('rule, user_id', hours(24))} END AS in_window FROM m WHERE rule IS NOT NULL)
SELECT event_id, rule, in_window, in_window > CASE WHEN rule = 'login' THEN 2 ELSE 3 END AS refused FROM c""")
def _(spark, d):
    rules = [("login", F.col("event_type") == "signup", 2, hours(72)),
             ("api", F.col("event_type").isin("click", "view", "signup"), 3, hours(24))]
    return sq.path_limits(events(spark, d), KEY, "us", rules).select("event_id", "rule", "in_window", "refused")


@query("w3_login_attempts", f"""
WITH {EVENTS_SQL}, c AS (SELECT event_id, count(*) {frame('user_id', hours(120))} AS in_window FROM ev WHERE event_type = 'signup')
SELECT event_id, in_window, in_window - 1 >= 3 AS refused FROM c""")
def _(spark, d):
    logins = events(spark, d).filter(F.col("event_type") == "signup")
    return sq.sliding_rate(logins, KEY, "us", hours(120), 3).select("event_id", "in_window", "refused")


@query("w4_window_pattern", f"""
WITH {EVENTS_SQL}, c AS (SELECT event_id, event_type, count(*) {frame('user_id', hours(6), True)} AS n_short,
  count(*) {frame('user_id', hours(24), True)} AS n_mid, count(*) {frame('user_id', hours(96), True)} AS n_long FROM ev),
p AS (SELECT *, CASE WHEN n_long < 2 THEN 'normal' WHEN n_short > 3 THEN 'burst' WHEN n_mid > 5 THEN 'sustained'
  WHEN n_long >= 5 AND n_short <= 2 AND n_mid <= 4 THEN 'slow_burn' ELSE 'normal' END AS pattern FROM c)
SELECT event_id, n_short, n_mid, n_long, pattern, pattern = 'slow_burn' AND event_type <> 'view' AS stealth,
  CAST(CASE pattern WHEN 'burst' THEN 25 + least(15, trunc((n_short - 3) / 4.0))
    WHEN 'sustained' THEN 15 + least(10, trunc((n_mid - 5) / 12.0))
    WHEN 'slow_burn' THEN 5 + CASE WHEN event_type <> 'view' THEN 15 ELSE 0 END ELSE 0 END AS BIGINT) AS anomaly
FROM p""")
def _(spark, d):
    r = sq.window_pattern(events(spark, d), KEY, "us", F.col("event_type") != "view", hours(6), hours(24), hours(96),
                          burst=3, sustained=5, slow=(5, 2, 4))
    return r.select("event_id", "n_short", "n_mid", "n_long", "pattern", "stealth", "anomaly")


LAST = """h AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY us DESC, event_id DESC) AS dn,
  count(*) OVER (PARTITION BY user_id) AS total FROM ev) WHERE dn <= {n}),
hr AS (SELECT *, least(total, {n}) - dn + 1 AS rn, least(total, {n}) AS kept FROM h)"""


@query("w5_gap_statistics", f"""
WITH {EVENTS_SQL}, {LAST.format(n=200)}, g AS (
  SELECT user_id, (us - lag(us) OVER (PARTITION BY user_id ORDER BY rn)) / 1000000.0 AS gap FROM hr),
a AS (SELECT user_id, count(*) AS n, avg(gap) AS m, stddev_pop(gap) AS s FROM g GROUP BY user_id)
SELECT user_id, n, round(m, 3) AS mean_gap, round(s, 3) AS sd_gap, round(s / m, 4) AS cv,
  round(greatest(0, 100 * (1 - s / m)), 4) AS uniformity,
  CAST(CASE WHEN s < 40000 THEN 25 ELSE 0 END + CASE WHEN s / m < 1 THEN 20 ELSE 0 END AS BIGINT) AS score
FROM a WHERE n >= 5""")
def _(spark, d):
    r = sq.gap_statistics(events(spark, d), KEY, "us", "event_id", robot_sd=40_000, robot_cv=1.0)
    return r.select("user_id", "n", F.round("mean_gap", 3).alias("mean_gap"), F.round("sd_gap", 3).alias("sd_gap"),
                    F.round("cv", 4).alias("cv"), F.round("uniformity", 4).alias("uniformity"), "score")


@query("w6_burst_runs", f"""
WITH {EVENTS_SQL}, g AS (SELECT *, coalesce(us - lag(us) OVER w < {hours(12)}, false) AS short FROM ev
  WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id)),
r AS (SELECT *, sum(CASE WHEN short THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY us, event_id) AS run FROM g),
c AS (SELECT user_id, run, count(*) FILTER (WHERE short) AS n FROM r GROUP BY 1, 2)
SELECT user_id, max(n) AS longest_run, max(n) >= 5 AS burst FROM c GROUP BY 1""")
def _(spark, d):
    return sq.burst_runs(events(spark, d), KEY, "us", "event_id", gap=hours(12))


@query("w7_pace_pattern", f"""
WITH {EVENTS_SQL}, {LAST.format(n=100)}, g AS (
  SELECT user_id, us, us - lag(us) OVER (PARTITION BY user_id ORDER BY rn) AS gap FROM hr),
a AS (SELECT user_id, count(*) AS n, (max(us) - min(us)) / {HOUR}.0 / nullif(count(*) - 1, 0) AS avg_gap,
  count(*) FILTER (WHERE gap <= {HOUR}) AS short FROM g GROUP BY user_id)
SELECT user_id, n, round(coalesce(avg_gap, 0), 4) AS avg_gap,
  CASE WHEN n < 2 THEN 'normal' WHEN n >= 20 AND avg_gap <= 2 OR n >= 10 AND avg_gap <= 5 THEN 'burst'
    WHEN n >= 50 AND avg_gap <= 30 OR n >= 20 AND avg_gap <= 60 THEN 'sustained'
    WHEN n BETWEEN 5 AND 15 AND avg_gap BETWEEN 30 AND 300 THEN 'stealth' ELSE 'normal' END AS pattern,
  CAST(CASE WHEN n < 2 THEN 0 WHEN n >= 20 AND avg_gap <= 2 THEN 15 WHEN n >= 10 AND avg_gap <= 5 THEN 10
    WHEN n >= 50 AND avg_gap <= 30 THEN 8 WHEN n >= 20 AND avg_gap <= 60 THEN 5
    WHEN n BETWEEN 5 AND 15 AND avg_gap BETWEEN 30 AND 300 THEN 3 ELSE 0 END AS BIGINT) AS anomaly,
  CASE WHEN short >= greatest(3, CAST(floor(n * 0.3) AS BIGINT)) THEN short ELSE 0 END AS burst_count
FROM a""")
def _(spark, d):
    r = sq.pace_pattern(events(spark, d), KEY, "us", "event_id", unit=HOUR)
    return r.withColumn("avg_gap", F.round("avg_gap", 4))


@query("w8_replay", f"""
WITH {EVENTS_SQL}, c AS (SELECT event_id, count(*) {frame('user_id, event_type', hours(48), True)} AS same_short,
  count(*) {frame('user_id, event_type', hours(120), True)} AS same_long, count(*) {frame('user_id', hours(120), True)} AS all_long FROM ev),
s AS (SELECT *, CAST(CASE WHEN same_short >= 3 THEN 25 ELSE 0 END + CASE WHEN same_long / all_long > 0.5 THEN 20 ELSE 0 END AS BIGINT) AS score FROM c)
SELECT *, score >= 25 AS is_replay FROM s""")
def _(spark, d):
    r = sq.replay(events(spark, d), KEY, "us", "event_type", hours(48), hours(120))
    return r.select("event_id", "same_short", "same_long", "all_long", "score", "is_replay")


@query("w9_duplicate_submissions", f"""
WITH {EVENTS_SQL}, b AS (SELECT *, k % 10 AS p, CAST(event_type IN ('purchase', 'signup') AS INT) AS chg,
  CAST(event_type = 'purchase' AS INT) AS sen FROM ev),
c AS (SELECT event_id, chg, sen, count(*) {frame('user_id, event_type', hours(48), True)} - 1 AS same_url,
  count(*) {frame('user_id, event_type', hours(12), True)} - 1 AS same_url_burst,
  count(*) {frame('user_id, event_type, p', hours(48), True)} - 1 AS same_params,
  CAST(sum(chg) {frame('user_id, event_type', hours(48), True)} - chg AS BIGINT) AS changing_before,
  CAST(sum(chg) {frame('user_id, event_type, p', hours(48), True)} - chg AS BIGINT) AS changing_same,
  CAST(sum(sen) {frame('user_id', hours(120), True)} - sen AS BIGINT) AS sensitive_before,
  CAST(sum(sen) {frame('user_id, event_type, p', hours(120), True)} - sen AS BIGINT) AS sensitive_same FROM b)
SELECT event_id, same_url, same_url_burst, same_params, changing_before, changing_same, sensitive_before, sensitive_same,
  CAST(greatest(CASE WHEN same_url >= 10 THEN 90 WHEN same_params >= 3 THEN 80 WHEN same_url_burst >= 2 THEN 75 WHEN same_url >= 3 THEN 65 ELSE 0 END,
    CASE WHEN chg = 0 THEN 0 WHEN changing_same >= 2 THEN 85 WHEN changing_before >= 2 THEN 70 ELSE 0 END,
    CASE WHEN sen = 0 THEN 0 WHEN sensitive_same >= 5 THEN 95 WHEN sensitive_same >= 2 THEN 85 WHEN sensitive_before >= 3 THEN 60 ELSE 0 END) AS BIGINT) AS score
FROM c""")
def _(spark, d):
    e = events(spark, d).withColumn("p", F.col("k") % 10)
    r = sq.duplicate_submissions(e, KEY, "us", "event_type", "p", F.col("event_type").isin("purchase", "signup"),
                                 F.col("event_type") == "purchase", hours(48), hours(12), hours(120),
                                 per_window=3, per_burst=2, changing_limit=2)
    return r.select("event_id", "same_url", "same_url_burst", "same_params", "changing_before", "changing_same",
                    "sensitive_before", "sensitive_same", "score")


@query("w10_session_anomaly", f"""
WITH {EVENTS_SQL}, f AS (SELECT *, row_number() OVER (PARTITION BY k, event_type ORDER BY us, event_id) AS fa,
  row_number() OVER (PARTITION BY k, user_id ORDER BY us, event_id) AS fc FROM ev),
c AS (SELECT event_id, CAST(sum(CASE WHEN fa = 1 THEN 1 ELSE 0 END) OVER w AS BIGINT) AS agents,
  CAST(sum(CASE WHEN fc = 1 THEN 1 ELSE 0 END) OVER w AS BIGINT) AS clients,
  first_value(event_type) OVER w = 'signup' AND us - first_value(us) OVER w <= {hours(100)} AS hot
  FROM f WINDOW w AS (PARTITION BY k ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT event_id, agents, clients, CAST(CASE WHEN agents > 2 THEN 20 ELSE 0 END + CASE WHEN clients > 3 THEN 25 ELSE 0 END
  + CASE WHEN hot THEN 30 ELSE 0 END AS BIGINT) AS score FROM c""")
def _(spark, d):
    r = sq.session_anomaly(events(spark, d), "k", "us", "event_id", "event_type", "user_id",
                           F.col("event_type") == "signup", hours(100))
    return r.select("event_id", "agents", "clients", "score")


@query("w11_session_drift", """
WITH b AS (SELECT conv_id, turn, role, regexp_replace(text, '[^ -~]', '', 'g') AS agent,
    role || ',' || CAST(turn % 3 AS VARCHAR) AS lang, CAST(length(text) % 5 AS VARCHAR) AS net FROM conversations),
f AS (SELECT *, first_value(agent) OVER w AS fa, first_value(lang) OVER w AS fl, first_value(net) OVER w AS fn,
    first_value(role) OVER w AS fr FROM b WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
s AS (SELECT *, CASE WHEN agent = fa THEN 1.0 WHEN length(agent) = 0 OR length(fa) = 0 THEN 0.0
    ELSE 1 - CAST(levenshtein(agent, fa) AS DOUBLE) / greatest(length(agent), length(fa)) END AS sim FROM f),
t AS (SELECT conv_id, turn, round(sim, 4) AS similarity, CAST(least(100,
    CASE WHEN sim < 0.3 THEN 30 WHEN sim < 0.6 THEN 21 WHEN sim < 0.9 THEN 9 ELSE 0 END
    + CASE WHEN lang = fl THEN 0 WHEN split_part(lang, ',', 1) <> split_part(fl, ',', 1) THEN 15 ELSE 6 END
    + CASE WHEN net <> fn THEN 35 WHEN role <> fr THEN 7 ELSE 0 END) AS BIGINT) AS score FROM s)
SELECT *, score >= 50 AS drifted FROM t""")
def _(spark, d):
    c = table(spark, d, "conversations").select(
        "conv_id", "turn", "role",
        F.regexp_replace("text", "[^ -~]", "").alias("agent"),
        F.concat_ws(",", "role", (F.col("turn") % 3).cast("string")).alias("lang"),
        (F.length("text") % 5).cast("string").alias("net"))
    r = sq.session_drift(c, "conv_id", "turn", "role", "agent", "lang", "net", "role", piece=10_000)
    return r.select("conv_id", "turn", F.round("similarity", 4).alias("similarity"), "score", "drifted")


@query("w20_ban_escalation", f"""
WITH {EVENTS_SQL}, o AS (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) AS offence FROM ev WHERE event_type = 'error')
SELECT event_id, offence, CAST(CASE offence WHEN 1 THEN 86400 WHEN 2 THEN 604800 WHEN 3 THEN 2592000 ELSE 0 END AS BIGINT) AS ban_s,
  least(10, offence) * 86400 AS ban_multiplied_s FROM o""")
def _(spark, d):
    e = events(spark, d).filter(F.col("event_type") == "error")
    return sq.ban_escalation(e, KEY, "us", "event_id").select("event_id", "offence", "ban_s", "ban_multiplied_s")


@query("w21_attempt_counter", f"""
WITH {EVENTS_SQL}, g AS (SELECT *, CASE WHEN us - lag(us) OVER w < {hours(24)} THEN 0 ELSE 1 END AS brk FROM ev
  WHERE event_type IN ('signup', 'error') WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id)),
s AS (SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY us, event_id) AS sess FROM g)
SELECT event_id, row_number() OVER (PARTITION BY user_id, sess ORDER BY us, event_id) AS attempt FROM s""")
def _(spark, d):
    e = events(spark, d).filter(F.col("event_type").isin("signup", "error"))
    return sq.attempts(e, KEY, "us", "event_id", hours(24)).select("event_id", "attempt")


@query("w22_crawl_behaviour", f"""
WITH {EVENTS_SQL}, b AS (SELECT *, k % 7 AS depth, k % 3 AS agent, event_type IN ('view', 'click', 'error') AS api,
  event_type = 'purchase' AS st FROM ev),
c AS (SELECT a.event_id, count(*) AS n, count(DISTINCT b.event_type) AS paths, count(DISTINCT b.agent) AS agents,
  avg(b.depth) AS md, avg(CASE WHEN b.depth >= 4 THEN 1.0 ELSE 0 END) AS deep,
  sum(CASE WHEN b.api AND NOT b.st THEN 1 ELSE 0 END) / nullif(sum(CASE WHEN b.api OR b.st THEN 1 ELSE 0 END), 0) AS share
  FROM b a JOIN b ON a.user_id = b.user_id AND b.us BETWEEN a.us - {hours(96)} AND a.us GROUP BY 1)
SELECT event_id, n, paths, agents, round(CASE WHEN n < 3 THEN 0 ELSE paths / n * 100 * least(1.0, n / 20.0) END, 4) AS path_variety,
  round(CASE WHEN n >= 5 AND share >= 0.9 THEN share * 100 ELSE 0 END, 4) AS api_bias,
  CAST(CASE WHEN n < 5 THEN 0 WHEN agents >= 5 THEN 100 WHEN agents >= 3 THEN 70 WHEN agents >= 2 THEN 30 ELSE 0 END AS BIGINT) AS agent_rotation,
  CAST(CASE WHEN n < 5 THEN 0 ELSE least(100, CASE WHEN md >= 6 THEN 100 WHEN md >= 4 THEN 70 WHEN md >= 3 THEN 40 ELSE 0 END
    + CASE WHEN deep >= 0.5 THEN 20 ELSE 0 END) END AS BIGINT) AS crawl_depth FROM c""")
def _(spark, d):
    e = events(spark, d).withColumn("depth", F.col("k") % 7).withColumn("agent", F.col("k") % 3)
    r = sq.crawl_behaviour(e, KEY, "us", "event_type", "agent", "depth",
                           F.col("event_type").isin("view", "click", "error"), F.col("event_type") == "purchase", hours(96))
    return r.select("event_id", "n", "paths", "agents", F.round("path_variety", 4).alias("path_variety"),
                    F.round("api_bias", 4).alias("api_bias"), "agent_rotation", "crawl_depth")


@query("w23_last_rows", f"""
WITH {EVENTS_SQL}, {LAST.format(n=20)} SELECT event_id, user_id, rn, kept FROM hr""")
def _(spark, d):
    return tl.last_rows(events(spark, d), KEY, "us", "event_id", 20).select("event_id", "user_id", "rn", "kept")


@query("w24_ordered_visit", f"""
WITH {EVENTS_SQL}, {LAST.format(n=200)}, f AS (SELECT user_id, min(rn) FILTER (WHERE event_type = 'signup') AS first_login,
  min(rn) FILTER (WHERE event_type = 'error') AS first_admin, min(rn) FILTER (WHERE event_type = 'purchase') AS first_api FROM hr GROUP BY 1)
SELECT *, coalesce(first_login < first_admin AND first_admin < first_api, false) AS in_order FROM f""")
def _(spark, d):
    t = F.col("event_type")
    return sq.ordered_visit(events(spark, d), KEY, "us", "event_id",
                            [("login", t == "signup"), ("admin", t == "error"), ("api", t == "purchase")])


@query("w26_api_abuse", f"""
WITH {EVENTS_SQL}, c AS (SELECT a.event_id, count(DISTINCT b.k) AS endpoints, count(DISTINCT b.k) FILTER (WHERE b.k < 10) AS known,
  count(DISTINCT b.k) FILTER (WHERE b.k >= 90) AS sensitive
  FROM ev a JOIN ev b ON a.user_id = b.user_id AND b.us BETWEEN a.us - {hours(120)} AND a.us GROUP BY 1)
SELECT event_id, endpoints, known, sensitive, round(known / 10.0, 4) AS coverage, CAST(CASE WHEN endpoints > 10 THEN 30 ELSE 0 END
  + CASE WHEN known / 10.0 > 0.2 THEN 25 ELSE 0 END + CASE WHEN sensitive >= 2 THEN 20 ELSE 0 END AS BIGINT) AS score FROM c""")
def _(spark, d):
    r = sq.api_abuse(events(spark, d), KEY, "us", "k", 10, F.col("k") < 10, F.col("k") >= 90, hours(120), many=10, coverage=0.2)
    return r.select("event_id", "endpoints", "known", "sensitive", F.round("coverage", 4).alias("coverage"), "score")
