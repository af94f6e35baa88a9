"""Queries over phase sequences and client behaviour."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewarden.functions.scores import first_of
from tracewarden.operators import behaviour as bh
from tracewarden.operators import chains as ch
from tracewarden.operators.timeline import HOUR
from tracewarden.plans.registry import EVENTS_SQL, events, query, table
from tracewarden.plans.windows import KEY, LAST, frame, hours
from tracewarden.tables import CHAIN_PHASES, CHAIN_TEMPLATES, INTENT_TRANSITIONS, NEXT_PARAMS, NEXT_PATHS, chain_pairs, kill_chain_pairs, transition_table, values_sql

# Which phase an event type stands for.
CHAIN_OF = {"view": "RECON", "click": "SCAN", "signup": "ENUM", "error": "INJECT", "purchase": "EXPLOIT"}
KILL_OF = {"view": "recon", "click": "weaponization", "signup": "delivery", "error": "exploitation", "purchase": "unknown"}
INTENT_OF = {"view": "sql_injection", "click": "path_traversal", "signup": "xss", "error": "code_execution", "purchase": "command_injection"}
REQUEST_OF = {"view": "none", "click": "recon", "signup": "probe", "error": "attempt", "purchase": "attack"}


def mapped(df, names: dict[str, str], out: str = "phase"):
    return df.withColumn(out, first_of([(F.col("event_type") == k, v) for k, v in names.items()], "none"))


def case(names: dict[str, object]) -> str:
    return "CASE event_type " + " ".join(f"WHEN '{k}' THEN " + (f"'{v}'" if isinstance(v, str) else str(v)) for k, v in names.items()) + " END"


ORDERED = "OVER (PARTITION BY user_id ORDER BY us, event_id)"


@query("w12_phase_progress", f"""
WITH {EVENTS_SQL}, p AS (SELECT *, {case({k: CHAIN_PHASES.index(v) for k, v in CHAIN_OF.items()})} AS i FROM ev),
w AS (SELECT event_id, i, lag(i) {ORDERED} AS pi, max(i) {ORDERED} AS furthest FROM p)
SELECT event_id, furthest, CAST(round((furthest + 1) / 7.0 * 100) AS BIGINT) AS progress FROM w WHERE pi IS NULL OR pi <> i""")
def _(spark, d):
    r = ch.phase_progress(mapped(events(spark, d), CHAIN_OF), KEY, "us", "event_id", "phase")
    return r.select("event_id", "furthest", "progress")


def _transition_sql(names, pairs, anomaly):
    return f"""
WITH {EVENTS_SQL}, p AS (SELECT *, {case(names)} AS phase FROM ev),
w AS (SELECT event_id, phase, lag(phase) {ORDERED} AS from_phase FROM p),
t(f, g, p) AS (VALUES {values_sql(pairs)})
SELECT event_id, from_phase, phase, CAST(t.p AS DOUBLE) AS p, CAST({anomaly} AS BIGINT) AS anomaly
FROM w LEFT JOIN t ON t.f = from_phase AND t.g = phase WHERE from_phase IS NOT NULL"""


@query("j20_transition_probability", _transition_sql(CHAIN_OF, chain_pairs(), """CASE WHEN from_phase = phase THEN 0 WHEN t.p IS NULL THEN 30
  WHEN t.p >= 0.2 THEN 0 WHEN t.p >= 0.1 THEN 5 WHEN t.p >= 0.05 THEN 10 WHEN t.p >= 0.01 THEN 20 ELSE 30 END"""))
def _(spark, d):
    r = ch.transitions(mapped(events(spark, d), CHAIN_OF), KEY, "us", "event_id", "phase", transition_table(spark, chain_pairs()))
    return r.select("event_id", "from_phase", "phase", "p", "anomaly")


@query("w13_kill_chain_transitions", _transition_sql(KILL_OF, kill_chain_pairs(), """CASE WHEN from_phase = phase THEN 0 WHEN t.p IS NULL THEN 70
  WHEN t.p < 0.05 THEN 60 WHEN t.p < 0.1 THEN 40 ELSE 0 END"""))
def _(spark, d):
    r = ch.transitions(mapped(events(spark, d), KILL_OF), KEY, "us", "event_id", "phase",
                       transition_table(spark, kill_chain_pairs()), ch.kill_chain_anomaly)
    return r.select("event_id", "from_phase", "phase", "p", "anomaly")


@query("w13_intent_transitions", _transition_sql(INTENT_OF, INTENT_TRANSITIONS, """CASE WHEN from_phase = phase THEN 0
  WHEN coalesce(t.p, 0) < 0.05 THEN 30 WHEN t.p < 0.2 THEN 20 ELSE 0 END"""))
def _(spark, d):
    r = ch.transitions(mapped(events(spark, d), INTENT_OF), KEY, "us", "event_id", "phase",
                       transition_table(spark, INTENT_TRANSITIONS), ch.intent_anomaly)
    return r.select("event_id", "from_phase", "phase", "p", "anomaly")


REQ_I = {"view": 0, "click": 1, "signup": 2, "error": 3, "purchase": 4}


@query("w14_phase_jump", f"""
WITH {EVENTS_SQL}, p AS (SELECT *, {case(REQ_I)} AS i FROM ev), w AS (SELECT event_id, i, lag(i) {ORDERED} AS pi FROM p)
SELECT event_id, CASE WHEN i >= 4 THEN 'direct' WHEN i > pi + 1 THEN 'jump' ELSE 'none' END AS jump FROM w""")
def _(spark, d):
    return ch.phase_jumps(mapped(events(spark, d), REQUEST_OF), KEY, "us", "event_id", "phase").select("event_id", "jump")


def lcs_sql(seq: str, tpl: str) -> str:
    """Longest common subsequence by folding the table rows over the sequence."""
    return f"""list_reduce(list_transform({seq}, lambda p: {{'p': p, 'r': []::INT[]}}), lambda a, x: {{'p': x.p, 'r': list_reduce(
  list_transform(range(1, len({tpl}) + 1), lambda j: [j::INT]), lambda c, j: list_append(c, CASE WHEN {tpl}[j[1]] = x.p THEN a.r[j[1]] + 1 ELSE greatest(a.r[j[1] + 1], c[j[1]]) END), [0::INT])}},
  {{'p': '', 'r': list_transform(range(0, len({tpl}) + 1), lambda j: 0::INT)}}).r[-1]"""


def collapse_sql(seq: str) -> str:
    return f"list_filter({seq}, lambda p, i: i = 1 OR p <> {seq}[i - 1])"


TEMPLATES_SQL = f"tp(ord, template, phases, risk) AS (VALUES {values_sql([(i, k, ph, r) for i, (k, ph, r) in enumerate(CHAIN_TEMPLATES)])})"
HIST_SQL = f"""{LAST.format(n=12)}, hs AS (SELECT user_id, list({case(CHAIN_OF)} ORDER BY rn) AS ps, list(us ORDER BY rn) AS ts, list(k % 5 ORDER BY rn) AS px,
  list(value ORDER BY rn) AS vs, count(*) AS n FROM hr GROUP BY 1), sq AS (SELECT *, {collapse_sql('ps')} AS seq, {collapse_sql('ps[1:n // 2]')} AS e, {collapse_sql('ps[n // 2 + 1:n]')} AS l FROM hs)"""


def _match_sql(name: str, seq: str) -> str:
    return f"""{name}_l AS (SELECT user_id, ord, template, risk, len(phases) AS m, len({seq}) AS s, {lcs_sql(seq, 'phases')} AS lcs FROM sq, tp WHERE len({seq}) >= 2),
{name} AS (SELECT *, lcs / greatest(m, s) AS sim FROM {name}_l WHERE lcs >= 2),
{name}_b AS (SELECT user_id, arg_max(template, (sim, -ord)) AS key, arg_max(risk, (sim, -ord)) AS risk, max(sim) AS sim, arg_max(CAST(round(lcs / m * 100) AS BIGINT), (sim, -ord)) AS progress
  FROM {name} GROUP BY 1 HAVING max(sim) >= 0.3)"""


SWITCH_SQL = f"""{TEMPLATES_SQL}, {HIST_SQL}, {_match_sql('al', 'seq')}, {_match_sql('ea', 'e')}, {_match_sql('la', 'l')},
ac AS (SELECT user_id, count(*) FILTER (WHERE sim >= 0.3) AS c FROM al GROUP BY 1),
sw AS (SELECT sq.*, coalesce(c, 0) AS chains, coalesce(n >= 6 AND c >= 1 AND ea_b.key <> la_b.key, false) AS switched FROM sq LEFT JOIN ac USING (user_id) LEFT JOIN ea_b USING (user_id) LEFT JOIN la_b USING (user_id)),
sa AS (SELECT *, CAST(least(40, (chains >= 2)::INT * 20 + switched::INT * 15) AS BIGINT) AS switch_anomaly FROM sw)"""


@query("j15_chain_match", f"""
WITH {EVENTS_SQL}, {TEMPLATES_SQL}, {HIST_SQL}, {_match_sql('al', 'seq')}
SELECT user_id, template, risk, lcs, round(sim, 6) AS similarity, CAST(round(lcs / m * 100) AS BIGINT) AS progress FROM al""")
def _(spark, d):
    return ch.chain_matches(mapped(events(spark, d), CHAIN_OF), KEY, "us", "event_id", "phase", history=12).withColumn("similarity", F.round("similarity", 6))


@query("w25_chain_switch", f"WITH {EVENTS_SQL}, {SWITCH_SQL} SELECT user_id, n, chains, switched, switch_anomaly FROM sa")
def _(spark, d):
    return ch.chain_switches(mapped(events(spark, d), CHAIN_OF), KEY, "us", "event_id", "phase", history=12)


@query("a37_lateral_movement", f"""
WITH {EVENTS_SQL}, {LAST.format(n=100)}, g AS (SELECT user_id, count(DISTINCT k % 5) AS prefixes FROM hr WHERE event_type IN ('error', 'purchase') GROUP BY 1)
SELECT user_id, prefixes, CAST(30 + least(20, (prefixes - 2) * 5) AS BIGINT) AS score FROM g WHERE prefixes >= 2""")
def _(spark, d):
    e = mapped(events(spark, d), CHAIN_OF).withColumn("prefix", F.col("k") % 5)
    return ch.lateral_movement(e, KEY, "us", "event_id", "phase", "prefix")


@query("w27_chain_risk", f"""
WITH {EVENTS_SQL}, {SWITCH_SQL}, pr(f, g, p) AS (VALUES {values_sql(chain_pairs())}),
x AS (SELECT sa.*, b.key AS chain, coalesce(b.sim, 0) AS sim, coalesce(b.progress, 0) AS progress, b.risk, list_max(list_transform(ps, lambda p: list_position({CHAIN_PHASES}, p) - 1)) AS pi,
  (ts[-1] - ts[1]) / {HOUR}.0 / nullif(n - 1, 0) AS gap, len(list_filter(vs, lambda v: v >= 40)) AS hot, len(list_filter(ts, lambda t: t >= ts[-1] - {hours(6)})) AS s1,
  len(list_filter(ts, lambda t: t >= ts[-1] - {hours(24)})) AS s2, len(list_filter(ts, lambda t: t >= ts[-1] - {hours(96)})) AS s3,
  len(list_distinct(list_filter(list_transform(ps, lambda p, i: CASE WHEN p IN ('INJECT', 'EXPLOIT', 'PERSIST', 'EXFIL') THEN px[i] END), lambda v: v IS NOT NULL))) AS pre, seq[-2] AS pf, seq[-1] AS pt
  FROM sa LEFT JOIN al_b b USING (user_id)),
y AS (SELECT x.*, CASE WHEN pi = 0 THEN 10 WHEN pi <= 2 THEN 20 WHEN pi <= 4 THEN 35 ELSE 50 END AS phs, CASE WHEN sim >= 0.6 THEN 70 + trunc((sim - 0.6) / 0.4 * 20) WHEN sim >= 0.3 THEN 40 + trunc((sim - 0.3) / 0.3 * 20) ELSE 0 END AS chs,
  CASE WHEN n >= 20 AND gap <= 2 THEN 15 WHEN n >= 10 AND gap <= 5 THEN 10 WHEN n >= 50 AND gap <= 30 THEN 8 WHEN n >= 20 AND gap <= 60 THEN 5 WHEN n BETWEEN 5 AND 15 AND gap BETWEEN 30 AND 300 THEN 3 ELSE 0 END AS tmp,
  CASE WHEN hot >= 5 THEN 10 WHEN hot >= 3 THEN 5 ELSE 0 END AS hp,
  CAST(CASE WHEN n < 2 THEN 0 WHEN s1 > 3 THEN 25 + least(15, (s1 - 3) // 4) WHEN s2 > 5 THEN 15 + least(10, (s2 - 5) // 12) WHEN s3 >= 5 AND s1 <= 2 AND s2 <= 4 THEN CASE WHEN pi > 0 THEN 20 ELSE 5 END ELSE 0 END AS BIGINT) AS timing,
  CAST(CASE WHEN pre >= 2 THEN 30 + least(20, (pre - 2) * 5) ELSE 0 END AS BIGINT) AS lat,
  CAST(CASE WHEN len(seq) < 2 THEN 0 WHEN pr.p IS NULL THEN 30 WHEN pr.p >= 0.2 THEN 0 WHEN pr.p >= 0.1 THEN 5 WHEN pr.p >= 0.05 THEN 10 WHEN pr.p >= 0.01 THEN 20 ELSE 30 END AS BIGINT) AS transition
  FROM x LEFT JOIN pr ON f = pf AND g = pt),
z AS (SELECT *, CAST(least(100, greatest(phs, chs) + tmp + hp) AS BIGINT) AS base FROM y), q AS (SELECT *, least(100, base + switch_anomaly + timing + lat + transition) AS score FROM z)
SELECT user_id, n, chain, round(sim, 6) AS similarity, progress, base, switch_anomaly, timing, lat AS "lateral", transition, score,
  CASE WHEN score >= 80 THEN 'critical' WHEN score >= 60 THEN 'high' WHEN score >= 40 THEN 'medium' WHEN score >= 15 THEN 'low' ELSE 'clean' END AS band,
  coalesce(score >= 70 OR (chain IS NOT NULL AND progress >= 50 AND risk IN ('critical', 'high')), false) AS block_early FROM q""")
def _(spark, d):
    e = mapped(events(spark, d), CHAIN_OF).withColumn("prefix", F.col("k") % 5)
    probs = {(a, b): p for a, b, p in chain_pairs()}
    return ch.chain_risk(e, KEY, "us", "event_id", "phase", "prefix", "value", probs, history=12, unit=HOUR,
                         windows=(6, 24, 96), burst=3, sustained=5, slow=(5, 2, 4)).withColumn("similarity", F.round("similarity", 6))


PATHS = [("view", "CLICK", 80), ("view", "sign", 50), ("click", "err", 70), ("error", "purch", 65), ("purchase", "vie", 90), ("signup", "ic", 60)]


@query("j14_predicted_path", f"""
WITH {EVENTS_SQL}, w AS (SELECT event_id, event_type, lag(event_type) {ORDERED} AS prev FROM ev), t(phase, path, prob, seq) AS (
  VALUES {values_sql([(a, b, c, i) for i, (a, b, c) in enumerate(PATHS)])}),
h AS (SELECT event_id, path, prob, row_number() OVER (PARTITION BY event_id ORDER BY seq) AS rn
  FROM w JOIN t ON t.phase = w.prev AND t.prob >= 60 AND contains(lower(event_type), lower(path)))
SELECT event_id, path, CAST(prob AS BIGINT) AS prob FROM h WHERE rn = 1""")
def _(spark, d):
    r = ch.predicted_path_hits(events(spark, d), KEY, "us", "event_id", "event_type", "event_type", PATHS)
    return r.select("event_id", "path", "prob")


@query("t5_top_predictions", f"""
WITH {EVENTS_SQL}, s AS (SELECT user_id, event_type AS item, CASE WHEN k % 3 = 0 THEN 'phase' WHEN k % 3 = 1 THEN 'type' ELSE 'history' END AS source,
  max(k) AS prob FROM ev GROUP BY ALL),
p AS (SELECT user_id, item, max(prob) FILTER (WHERE source = 'phase') AS a, max(prob) FILTER (WHERE source = 'type') AS b,
  max(prob) FILTER (WHERE source = 'history') AS c FROM s GROUP BY 1, 2),
q AS (SELECT user_id, item, least(100.0, coalesce(a, b, c) + CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN b / 2 ELSE 0 END
  + CASE WHEN coalesce(a, b) IS NOT NULL AND c IS NOT NULL THEN 15 ELSE 0 END) AS prob FROM p),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY prob DESC, item) AS rank FROM q)
SELECT user_id, item, CAST(prob AS DOUBLE) AS prob, rank FROM r WHERE rank <= 3""")
def _(spark, d):
    e = events(spark, d).select("user_id", F.col("event_type").alias("item"), F.col("k").alias("prob"),
                                first_of([(F.col("k") % 3 == 0, "phase"), (F.col("k") % 3 == 1, "type")], "history").alias("source"))
    return ch.top_predictions(e, KEY, "item", 3)


@query("t5_next_steps", f"""
WITH {EVENTS_SQL}, p AS (SELECT *, {case(REQUEST_OF)} AS phase FROM ev), l AS (SELECT user_id, arg_max(phase, (us, event_id)) AS phase FROM p GROUP BY 1),
s(phase, kind, item, prob) AS (VALUES {values_sql([(p, "path", i, q) for p, i, q in NEXT_PATHS] + [(p, "parameter", i, q) for p, i, q in NEXT_PARAMS])}),
r AS (SELECT *, row_number() OVER (PARTITION BY phase, kind ORDER BY prob DESC, item) AS rank FROM s)
SELECT user_id, phase, kind, item, prob::DOUBLE AS prob, rank FROM l JOIN r USING (phase) WHERE rank <= 5""")
def _(spark, d):
    return ch.next_steps(mapped(events(spark, d), REQUEST_OF), KEY, "us", "event_id", "phase", NEXT_PATHS, NEXT_PARAMS)


PREV10 = "OVER (PARTITION BY user_id ORDER BY us, event_id ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)"


def _wmean(col: str) -> str:
    return f"(list_sum(list_transform({col}, lambda x, i: x * (0.5 + 0.5 * i / len({col})))) / (0.75 * len({col}) + 0.25))"


@query("w15_trailing_baseline", f"""
WITH {EVENTS_SQL}, b AS (SELECT event_id, list(value) {PREV10} AS v, list(k) {PREV10} AS ks, min(us) {PREV10} AS u0, max(us) {PREV10} AS u1,
  count(*) {PREV10} AS n FROM ev)
SELECT event_id, n AS base_n, round({_wmean('v')}, 7) AS base_value, round({_wmean('ks')}, 7) AS base_k,
  round(CASE WHEN n > 1 THEN (u1 - u0) / (n - 1) / 1e6 ELSE 0 END, 3) AS gap_s FROM b""")
def _(spark, d):
    r = bh.trailing_baseline(events(spark, d), KEY, "us", "event_id", ["value", "k"])
    return r.select("event_id", "base_n", F.round("base_value", 7).alias("base_value"), F.round("base_k", 7).alias("base_k"),
                    F.round(F.col("base_gap") / 1e6, 3).alias("gap_s"))


@query("w16_deviations", f"""
WITH {EVENTS_SQL}, b AS (SELECT *, k % 10 AS pk, hour(ts) AS h, value / 2 AS cx, k % 5 AS ind, count(*) {frame('user_id', hours(24), True)} AS recent FROM ev),
w AS (SELECT *, list(event_type) {PREV10} AS su, list(pk) {PREV10} AS sp, list(h) {PREV10} AS sh, list(cx) {PREV10} AS lc, list(value) {PREV10} AS lv,
  list(ind) {PREV10} AS li, (max(us) {PREV10} - min(us) {PREV10}) / nullif(count(*) {PREV10} - 1, 0) AS gap, count(*) {PREV10} AS n FROM b),
m AS (SELECT *, {_wmean('lc')} AS bc, {_wmean('lv')} AS br, {_wmean('li')} AS bi, {_wmean('sp')} AS bp FROM w WHERE n >= 5),
f AS (SELECT *, NOT list_contains(su, event_type) AS a1, NOT list_contains(sp, pk) AS a2n, abs(pk - bp) > greatest(2, bp) AS a2c,
  CASE WHEN gap > 0 AND recent / ({hours(24)} / gap) >= 10 AND recent >= 2 THEN 20 WHEN gap > 0 AND recent / ({hours(24)} / gap) >= 3 AND recent >= 2 THEN 15
    WHEN gap = 0 AND recent >= 4 THEN 15 ELSE 0 END AS a3, NOT list_contains(sh, h) AS a4,
  CASE WHEN bc > 0 AND cx >= bc * 3 AND cx >= 30 THEN 15 WHEN bc > 0 AND cx >= bc * 2 AND cx >= 25 THEN 12 ELSE 0 END AS a5,
  CASE WHEN value >= 50 AND br <= 15 THEN 20 WHEN value >= 30 AND br <= 10 THEN 15 ELSE 0 END AS a6, ind >= 3 AND bi <= 1 AS a7 FROM m),
s AS (SELECT event_id, concat_ws(',', CASE WHEN a1 THEN 'new_uri' END, CASE WHEN a2n OR a2c THEN 'param_set_change' END, CASE WHEN a3 > 0 THEN 'freq_burst' END,
    CASE WHEN a4 THEN 'off_hours' END, CASE WHEN a5 > 0 THEN 'complexity_spike' END, CASE WHEN a6 > 0 THEN 'risk_score_spike' END, CASE WHEN a7 THEN 'indicators_burst' END) AS deviations,
  a1::INT + (a2n OR a2c)::INT + (a3 > 0)::INT + a4::INT + (a5 > 0)::INT + (a6 > 0)::INT + a7::INT AS dimensions,
  least(100, a1::INT * 12 + CASE WHEN a2n THEN 12 WHEN a2c THEN 10 ELSE 0 END + a3 + a4::INT * 10 + a5 + a6 + a7::INT * 12) AS raw FROM f)
SELECT event_id, deviations, CAST(dimensions AS BIGINT) AS dimensions, CAST(raw + CASE WHEN dimensions >= 4 THEN 15 WHEN dimensions = 3 THEN 10 WHEN dimensions = 2 THEN 5 ELSE 0 END AS BIGINT) AS score FROM s""")
def _(spark, d):
    e = events(spark, d).withColumn("pk", F.col("k") % 10).withColumn("h", F.hour("ts")).withColumn("cx", F.col("value") / 2) \
        .withColumn("ind", F.col("k") % 5).withColumn("names", F.array("pk"))
    r = bh.deviations(e, KEY, "us", "event_id", "event_type", "names", "h", "pk", "cx", "value", "ind", hours(24), busy=(2, 4))
    return r.select("event_id", F.concat_ws(",", "deviations").alias("deviations"), "dimensions", "score")


@query("w17_drift", f"""
WITH {EVENTS_SQL}, {LAST.format(n=100)}, x AS (SELECT *, kept // 2 AS half, kept - rn AS back, {case(REQ_I)} AS pi, k % 9 AS uri FROM hr),
g AS (SELECT user_id, max(kept) AS n, max(half) AS half, count(DISTINCT uri) FILTER (WHERE rn <= half) AS u1, count(DISTINCT uri) FILTER (WHERE rn > half) AS u2,
  regr_slope(value, rn) FILTER (WHERE back < 5) AS slope, arg_max(value, rn) AS v1, arg_min(value, rn) FILTER (WHERE back < 5) AS v0,
  count(DISTINCT uri) FILTER (WHERE back < 10) AS u10,
  avg(pi) FILTER (WHERE back < 6 AND back >= ceil(least(kept, 6) / 2.0)) AS pf, avg(pi) FILTER (WHERE back < ceil(least(kept, 6) / 2.0)) AS pl FROM x GROUP BY 1),
c AS (SELECT user_id, uri, count(*) AS c, sum(count(*)) OVER (PARTITION BY user_id) AS t FROM x WHERE back < 10 GROUP BY 1, 2),
e AS (SELECT user_id, -sum(c / t * log2(c / t)) AS entropy FROM c GROUP BY 1),
f AS (SELECT g.*, entropy, half >= 3 AND u2 / (n - half) > u1 / half * 2 AND u2 >= 4 AS d1, n >= 4 AND slope > 0.5 AND v1 > v0 + 15 AS d2,
  n >= 4 AND pl > pf AND pl >= 2 AS d3, entropy > 2.5 AND u10 >= 6 AS d4 FROM g JOIN e USING (user_id) WHERE n >= 5)
SELECT user_id, n, round(slope, 4) AS slope, round(entropy, 4) AS entropy,
  concat_ws(',', CASE WHEN d1 THEN 'uri_diversity_rising' END, CASE WHEN d2 THEN 'risk_rising' END, CASE WHEN d3 THEN 'phase_escalation' END,
    CASE WHEN d4 THEN 'behavior_entropy_spike' END) AS drifts,
  CAST(least(25, d1::INT * 15 + d2::INT * 15 + d3::INT * 15 + d4::INT * 10) AS BIGINT) AS score FROM f""")
def _(spark, d):
    e = mapped(events(spark, d), REQUEST_OF).withColumn("uri", F.col("k") % 9)
    r = bh.drift(e, KEY, "us", "event_id", "uri", "value", "phase")
    return r.select("user_id", "n", F.round("slope", 4).alias("slope"), F.round("entropy", 4).alias("entropy"),
                    F.concat_ws(",", "drifts").alias("drifts"), "score")


@query("w18_half_change", f"""
WITH {EVENTS_SQL}, {LAST.format(n=10)}, x AS (SELECT *, rn > kept // 2 AS late, {case(REQ_I)} AS pi, k % 9 AS uri,
  CASE WHEN value >= 70 THEN 3 WHEN value >= 50 THEN 2 WHEN value >= 25 THEN 1 ELSE 0 END AS rk FROM hr WHERE kept >= 5),
u AS (SELECT DISTINCT user_id, uri, late FROM x),
s AS (SELECT user_id, avg(CASE WHEN NOT EXISTS (SELECT 1 FROM u b WHERE b.user_id = a.user_id AND b.uri = a.uri AND NOT b.late) THEN 1.0 ELSE 0 END) AS share
  FROM u a WHERE late GROUP BY 1),
g AS (SELECT user_id, count(*) AS n, avg(rk) FILTER (WHERE late) - avg(rk) FILTER (WHERE NOT late) AS rr, avg(pi) FILTER (WHERE late) - avg(pi) FILTER (WHERE NOT late) AS pr FROM x GROUP BY 1)
SELECT user_id, n, round(share, 4) AS new_share, round(rr, 4) AS risk_rise, round(pr, 4) AS phase_rise,
  CAST((share > 0.5)::INT * 10 + (rr > 1)::INT * 10 + (pr > 1)::INT * 10 AS BIGINT) AS change_score,
  (share > 0.5)::INT + (rr > 1)::INT + (pr > 1)::INT >= 2 AS pattern_changed FROM g JOIN s USING (user_id)""")
def _(spark, d):
    e = mapped(events(spark, d), REQUEST_OF).withColumn("uri", F.col("k") % 9)
    r = bh.half_change(e, KEY, "us", "event_id", "uri", "value", "phase")
    return r.select("user_id", "n", F.round("new_share", 4).alias("new_share"), F.round("risk_rise", 4).alias("risk_rise"),
                    F.round("phase_rise", 4).alias("phase_rise"), "change_score", "pattern_changed")


@query("w19_decayed_sum", f"""
WITH {EVENTS_SQL}, c AS (SELECT a.event_id, coalesce(sum(b.value * 0.15 * pow(2, (b.us - a.us) / {hours(48)}.0)), 0) AS acc, count(b.event_id) AS prior
  FROM ev a LEFT JOIN ev b ON a.user_id = b.user_id AND b.us >= a.us - {hours(144)} AND b.us < a.us AND b.value >= 20 GROUP BY 1)
SELECT event_id, round(acc, 3) AS accumulated, prior, CAST(least(20, round(acc) + CASE WHEN prior >= 5 THEN 10 WHEN prior >= 3 THEN 5 ELSE 0 END) AS BIGINT) AS score FROM c""")
def _(spark, d):
    r = bh.decayed_sum(events(spark, d), KEY, "us", "value", F.col("value") >= 20, hours(144), hours(48))
    return r.select("event_id", (F.round("accumulated", 3) + 0.0).alias("accumulated"), "prior", "score")


PROFILE = """a AS (SELECT user_id, count(*) AS total, count(DISTINCT k % 9) AS paths, count(*) FILTER (WHERE value >= 40) AS high_risk,
  count(*) FILTER (WHERE event_type IN ('click', 'signup')) AS recon, bool_and(value <= 5) AS all_clean FROM ev GROUP BY 1)"""


@query("a16_client_profile", f"WITH {EVENTS_SQL}, {PROFILE} SELECT * FROM a")
def _(spark, d):
    e = mapped(events(spark, d), REQUEST_OF).withColumn("uri", F.col("k") % 9)
    return bh.client_profile(e, KEY, "uri", "value", "phase")


@query("a17_actor_type", f"""
WITH {EVENTS_SQL}, {PROFILE}, l AS (SELECT user_id, max(us) AS last FROM ev GROUP BY 1),
r AS (SELECT user_id, count(*) AS recent FROM ev JOIN l USING (user_id) WHERE us >= last - {hours(48)} GROUP BY 1)
SELECT user_id, total, recent, CASE WHEN total < 3 THEN 'unknown' WHEN recent >= 7 THEN 'scanner' WHEN recent >= 6 AND paths / total >= 0.5 AND paths >= 4 THEN 'scanner'
  WHEN recon >= 2 AND high_risk >= 1 AND recent <= 3 THEN 'manual_attacker' WHEN high_risk >= 30 AND recon >= 1 THEN 'manual_attacker'
  WHEN high_risk >= 2 AND recon >= 1 THEN 'manual_attacker' WHEN recent >= 3 AND all_clean AND paths >= 4 THEN 'crawler' ELSE 'normal' END AS actor FROM a JOIN r USING (user_id)""")
def _(spark, d):
    e = mapped(events(spark, d), REQUEST_OF).withColumn("uri", F.col("k") % 9)
    r = bh.actor_types(e, KEY, "us", "event_id", "uri", "value", "phase", hours(48), heavy=7, busy=6, calm=3)
    return r.select("user_id", "total", "recent", "actor")


@query("a18_attacker_profile", f"""
WITH {EVENTS_SQL}, a AS (SELECT user_id, event_type AS kind, count(*) AS n, CASE WHEN count(*) >= 2 THEN (max(us) - min(us)) / {HOUR}.0 / (count(*) - 1) ELSE 0 END AS g,
  count(DISTINCT k) AS payloads, count(DISTINCT k % 4) AS patterns FROM ev GROUP BY 1, 2)
SELECT user_id, kind, n, round(g, 4) AS mean_gap, payloads, patterns, CASE WHEN g < 2 AND n >= 10 AND payloads < 5 THEN 'automated_scanner'
  WHEN g BETWEEN 2 AND 30 AND payloads < 10 AND patterns <= 2 THEN 'script_kiddie' WHEN g > 30 AND n >= 5 AND payloads >= 10 AND patterns >= 3 THEN 'advanced_attacker'
  WHEN n > 0 AND g > 300 THEN 'persistent' ELSE 'script_kiddie' END AS profile FROM a""")
def _(spark, d):
    e = events(spark, d).withColumn("kind", F.col("event_type")).withColumn("pattern", F.col("k") % 4)
    return bh.attacker_profile(e, ["user_id", "kind"], "us", "k", "pattern", HOUR).withColumn("mean_gap", F.round("mean_gap", 4))


@query("a19_population_outliers", f"""
WITH {EVENTS_SQL}, g AS (SELECT user_id, avg(value) AS r, avg(k) AS p, avg(k * k) AS z, count(*) AS n FROM ev GROUP BY 1),
s AS (SELECT quantile_cont(r, 0.95) AS rq, quantile_cont(n::DOUBLE, 0.95) AS nq, avg(p) AS mp, stddev_pop(p) AS sp, avg(z) AS ms, stddev_pop(z) AS ss, count(*) AS c FROM g),
f AS (SELECT *, rq > 0 AND r > rq AS r1, nq > 0 AND n > nq AS r2, sp > 0 AND abs(p - mp) > 2 * sp AS r3, ss > 0 AND abs(z - ms) > 2 * ss AS r4 FROM g, s WHERE c >= 5)
SELECT user_id, n, round(CASE WHEN r1 THEN r - rq ELSE 0 END + CASE WHEN r2 THEN (n - nq) * 5 ELSE 0 END + CASE WHEN r3 THEN abs(p - mp) * 10 ELSE 0 END
  + CASE WHEN r4 THEN abs(z - ms) / 100 ELSE 0 END, 4) AS deviation, concat_ws(',', CASE WHEN r1 THEN 'risk_score' END, CASE WHEN r2 THEN 'request_count' END,
  CASE WHEN r3 THEN 'param_count' END, CASE WHEN r4 THEN 'payload_size' END) AS dimensions FROM f WHERE r1 OR r2 OR r3 OR r4""")
def _(spark, d):
    e = events(spark, d).withColumn("size", F.col("k") * F.col("k"))
    r = bh.population_outliers(e, KEY, "value", "k", "size")
    return r.select("user_id", "n", F.round("deviation", 4).alias("deviation"), F.concat_ws(",", "dimensions").alias("dimensions"))


@query("a20_multi_baseline", f"""
WITH {EVENTS_SQL}, {LAST.format(n=100)}, c AS (SELECT user_id, event_type, count(*) AS c FROM hr GROUP BY 1, 2), m AS (SELECT user_id, max(c) AS top FROM c GROUP BY 1)
SELECT user_id, count(*) AS n, round(max(top) / count(*), 4) AS concentration, round(avg(k), 4) AS params_mean, round(stddev_pop(k), 4) AS params_sd,
  round(avg(value), 4) AS size_mean, round(stddev_pop(value), 4) AS size_sd, round(regr_slope(value, rn), 4) AS risk_slope,
  count(DISTINCT k % 4) AS agents, array_to_string(list_sort(list(DISTINCT hour(ts))), ',') AS hours
FROM hr JOIN m USING (user_id) GROUP BY 1""")
def _(spark, d):
    e = events(spark, d).withColumn("h", F.hour("ts")).withColumn("agent", F.col("k") % 4)
    r = bh.multi_baseline(e, KEY, "us", "event_id", "event_type", "k", "value", "value", "h", "agent")
    cols = ["concentration", "params_mean", "params_sd", "size_mean", "size_sd", "risk_slope"]
    return r.select("user_id", "n", *[F.round(c, 4).alias(c) for c in cols], "agents", F.concat_ws(",", F.col("hours").cast("array<string>")).alias("hours"))


@query("a21_vector_distance", """
WITH l AS (SELECT label, vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS dim FROM embeddings),
n AS (SELECT label, max(vec_id) AS last, count(*) AS c FROM embeddings GROUP BY 1),
g AS (SELECT label, dim, avg(x) FILTER (WHERE vec_id < last) AS m, max(x) FILTER (WHERE vec_id = last) AS x FROM l JOIN n USING (label) WHERE c >= 2 GROUP BY 1, 2),
s AS (SELECT label, sqrt(sum((x - m) * (x - m))) AS distance FROM g GROUP BY 1)
SELECT label, round(distance, 4) AS distance, distance > 0.5 AS flagged FROM s""")
def _(spark, d):
    r = bh.vector_distance(table(spark, d, "embeddings"), "label", "vec_id", "embedding")
    return r.withColumn("distance", F.round("distance", 4))


@query("j16_cohort_comparison", f"""
WITH {EVENTS_SQL}, g AS (SELECT user_id % 7 AS segment, user_id, avg(value) AS m FROM ev GROUP BY 1, 2),
p AS (SELECT a.segment, a.user_id, a.m, avg(b.m) AS pm, stddev_pop(b.m) AS ps, count(b.m) AS c FROM g a JOIN g b ON a.segment = b.segment AND a.user_id <> b.user_id GROUP BY 1, 2, 3)
SELECT segment, user_id, round(m, 4) AS mean_risk, round(pm, 4) AS peer_mean, round(ps, 3) AS peer_sd, ps > 0 AND m - pm > 1.5 * ps AND m - pm >= 8 AS deviates FROM p WHERE c >= 3""")
def _(spark, d):
    e = events(spark, d).withColumn("segment", F.col("user_id") % 7)
    r = bh.cohort_comparison(e, "user_id", "segment", "value", least=8.0)
    return r.select("segment", "user_id", F.round("mean_risk", 4).alias("mean_risk"), F.round("peer_mean", 4).alias("peer_mean"),
                    F.round("peer_sd", 3).alias("peer_sd"), "deviates")
