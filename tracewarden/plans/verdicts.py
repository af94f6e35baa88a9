"""One verdict and one decision for each page, taken as a request: host = client, page_id = order."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewarden import rulesets
from tracewarden.functions import uri
from tracewarden.operators import params as pr
from tracewarden.operators import scoring as sc
from tracewarden.operators import verdict as vd
from tracewarden.plans.columns import OBFUSCATION_SQL, PAIRS_SQL, PATH, PAYLOAD_SQL, pages, sql_text
from tracewarden.plans.registry import ORACLES, query
from tracewarden.plans.rules import RULES_SQL
from tracewarden.tables import NEXT_PATHS, values_sql

DECOYS = ["/admin", "/login"]
TYPES = sorted({t for _, t, _ in rulesets.detection_rules()})


def _template_sql() -> str:
    """Trusted templates that a GET request without headers can meet."""
    cases = []
    for _, c in sc.TRUSTED_TEMPLATES:
        if {"method", "type", "accept", "headers"} & set(c):
            continue
        ok = [f"regexp_matches(url, {sql_text(c['uri'])})"] if "uri" in c else []
        ok += [f"list_has_{k}(names, {c[k]})" for k in ("any", "all") if k in c]
        ok += [f"(len(vals) = 0 OR len(list_filter(vals, lambda v: regexp_matches(v, {sql_text(c['value'])}))) > 0)"] if "value" in c else []
        cases.append("(" + " AND ".join(ok) + ")")
    return " OR ".join(cases)


def _verdict_sql() -> str:
    w = rulesets.TYPE_WEIGHTS
    sums = ", ".join(f"max(severity) FILTER (WHERE type = '{t}') AS m_{t}, least(100.0, sum(severity * {float(w.get(t, 1.0))}::DOUBLE) FILTER (WHERE type = '{t}')) AS s_{t}" for t in TYPES)
    fams = ", ".join(f"max(score) FILTER (WHERE family = '{f}') AS f_{f}" for f in vd.COMPONENT_FAMILIES.values())
    comps = {c: [f"m_{t}" for t in vd.COMPONENT_TYPES.get(c, ())] + ([f"f_{vd.COMPONENT_FAMILIES[c]}"] if c in vd.COMPONENT_FAMILIES else []) for c in vd.COMPONENTS[:-2]}
    parts = [f"greatest(0, {', '.join(f'coalesce({x}, 0)' for x in xs)}) AS c_{c}" for c, xs in comps.items()] + ["least(100, coalesce(weight, 0)) AS c_intent", "obfuscation AS c_adversarial"]
    total = " + ".join(f"c_{c} * {sc.COMPONENT_WEIGHTS[c]}::DOUBLE" for c in vd.COMPONENTS)
    most = lambda least: " + ".join(f"(c_{c} >= {least})::INT" for c in vd.COMPONENTS)
    worth = " + ".join(f"CASE WHEN list_contains(string_split(techniques, ','), '{t}') THEN {v} ELSE 0 END" for t, v in sc.TECHNIQUE_VALUES.items())
    known = " + ".join(f"list_contains(string_split(techniques, ','), '{t}')::INT" for t in sc.TECHNIQUE_VALUES)
    evidence = ORACLES["a26_intent_evidence"].replace("FROM pages JOIN r ON regexp_matches(html, pattern)", "FROM pl JOIN r ON regexp_matches(x, pattern)")
    return rf"""{PAYLOAD_SQL}, ob AS (WITH {OBFUSCATION_SQL}), {PAIRS_SQL}, {RULES_SQL},
nv AS (SELECT page_id, list(name) AS names, list(value) AS vals FROM qp GROUP BY 1),
hit AS (SELECT page_id, count(*) AS hits, count(*) FILTER (WHERE severity >= 80) AS high, {sums} FROM pl JOIN rules ON regexp_matches(lower(x), pattern) GROUP BY 1),
fm AS (SELECT page_id, {fams}, max(score) FILTER (WHERE name = 'url') AS v_url, max(score) FILTER (WHERE name = 'data') AS v_data FROM ({ORACLES["j4_family_scan"]}) GROUP BY 1),
clue AS ({evidence}), st AS ({ORACLES["p22_structure_score"]}),
tp AS (SELECT page_id, template AS path, count(*) OVER (PARTITION BY template) AS seen FROM ({ORACLES["p2_template_prefix_ids"]})),
j AS (SELECT pages.page_id, url, path, seen, s.x, s.dp, s.e, obfuscation, techniques, bypass_intent, st.score AS structure, coalesce(hits, 0) AS hits, coalesce(high, 0) AS high, hit.* EXCLUDE (page_id, hits, high),
  fm.* EXCLUDE (page_id), intent, weight, phase, coalesce(names, []) AS names, coalesce(vals, []) AS vals
  FROM pages JOIN s USING (page_id) JOIN ob USING (page_id) JOIN st USING (page_id) JOIN tp USING (page_id) LEFT JOIN hit USING (page_id) LEFT JOIN fm USING (page_id)
  LEFT JOIN clue USING (page_id) LEFT JOIN nv USING (page_id)),
k AS (SELECT *, {', '.join(parts)}, coalesce(v_url, 0) AS vu, coalesce(v_data, 0) AS vd, CASE WHEN seen < 5 THEN 0.2 ELSE 0 END::DOUBLE AS dv,
  least(100.0, greatest({', '.join(f'coalesce(s_{t}, 0)' for t in TYPES)}) * CASE WHEN dp >= 4 THEN 1.5 WHEN dp >= 2 THEN 1.2 ELSE 1 END)::DOUBLE AS r0,
  {_template_sql()} AS tmpl, CASE WHEN len(names) = 0 THEN 0 ELSE len(list_filter(names, lambda n: list_contains({pr.TRUSTED_NAMES}, lower(n)))) / len(names) END AS trusted,
  least(100.0, greatest(0.0, e / 8 * 100 - CASE WHEN len(regexp_extract_all(x, '[\x{{4E00}}-\x{{9FFF}}]')) / strlen(x) > 0.3 THEN 15 ELSE 0 END) * 0.5::DOUBLE
    + len(regexp_extract_all(x, '[<>"''%;|&`$(){{}}\\/*#=?!]')) / strlen(x) * 150) AS entropy FROM j),
k1 AS (SELECT *, round(least(100.0, least(100.0, r0 * CASE WHEN hits >= 5 THEN 1.4 WHEN hits >= 3 THEN 1.2 ELSE 1 END) * CASE WHEN high >= 2 THEN 1.3 ELSE 1 END), 1) AS detection,
  least(100, greatest(vu, vd) + CASE WHEN least(vu, vd) >= 30 THEN 15 WHEN greatest(vu, vd) >= 30 AND least(vu, vd) >= 15 THEN 8 ELSE 0 END) AS fusion,
  CASE WHEN vd > vu THEN 'data' ELSE 'url' END AS part, {most(50)} AS h50, {most(40)} AS h40,
  greatest(0.0, {', '.join(f'CASE WHEN c_{c} >= {vd.CLEAR} THEN {v} ELSE 0.0 END' for c, v in vd.FLOORS.items())})::DOUBLE AS evidence FROM k),
k2 AS (SELECT *, round(least(100.0, {total} + CASE WHEN fusion >= 30 THEN fusion * 0.08::DOUBLE ELSE 0 END + CASE WHEN obfuscation >= 50 THEN obfuscation * 0.12::DOUBLE WHEN obfuscation >= 30 THEN obfuscation * 0.06::DOUBLE ELSE 0 END
  + CASE WHEN h50 >= 6 THEN 18 WHEN h50 >= 5 THEN 15 WHEN h50 >= 4 THEN 10 WHEN h50 >= 3 THEN 6 WHEN h50 >= 2 THEN 3 ELSE 0 END), 4) AS semantic,
  least(100.0, dv * 60 + CASE WHEN dp >= 4 THEN 20 WHEN dp >= 2 THEN 10 ELSE 0 END + CASE WHEN dp >= 2 THEN 15 ELSE 0 END) AS deviation FROM k1),
k3 AS (SELECT *, CASE WHEN dp <= 0 OR semantic < 20 THEN 0 WHEN semantic < 35 THEN least(5, dp) ELSE least(45, CASE WHEN dp >= 4 THEN 12 WHEN dp >= 3 THEN 8 WHEN dp >= 2 THEN 4 ELSE 2 END + {worth}
    + CASE WHEN obfuscation >= 70 THEN 8 WHEN obfuscation >= 50 THEN 5 WHEN obfuscation >= 30 THEN 2 ELSE 0 END + CASE WHEN bypass_intent >= 20 THEN 6 WHEN bypass_intent >= 10 THEN 3 ELSE 0 END
    + CASE WHEN semantic >= 60 AND dp >= 2 THEN 8 WHEN semantic >= 45 THEN 4 ELSE 0 END + CASE WHEN {known} >= 3 THEN 6 WHEN {known} >= 2 THEN 3 ELSE 0 END) END AS bonus, semantic >= 80 AS top FROM k2),
k4 AS (SELECT *, CASE WHEN semantic < 10 AND hits = 0 THEN 100 ELSE least(CASE WHEN top THEN 40 ELSE 1000 END, (tmpl AND NOT top)::INT * 10 + (dv = 0 AND NOT top)::INT * 15
  + CASE WHEN trusted >= 0.8 AND NOT top THEN 10 WHEN trusted >= 0.5 THEN 5 ELSE 0 END + (trusted = 1 AND NOT top)::INT * 10 + (hits <= 2)::INT * 15 + (semantic < 30)::INT * 15 + (semantic >= 40 AND h40 <= 1)::INT * 10
  + (evidence = 0)::INT * 15 + (obfuscation < 20 AND dp <= 2)::INT * 10 + CASE WHEN NOT top AND semantic >= 50 AND regexp_matches(path, '(?i)\.(?:{"|".join(uri.STATIC_EXTENSIONS)})$') THEN 20 ELSE 0 END) END AS fp FROM k3),
k5 AS (SELECT *, least(100.0, round(entropy * 0.08::DOUBLE + semantic * 0.45::DOUBLE + structure * 0.20::DOUBLE + deviation * 0.12::DOUBLE + bonus, 1)) AS base FROM k4),
k6 AS (SELECT *, greatest(greatest(0.0, greatest(0.0, base - CASE WHEN fp >= 90 THEN 30 WHEN fp >= 75 THEN 15 WHEN fp >= 60 THEN 5 ELSE 0 END) - CASE WHEN semantic >= 50 AND fp BETWEEN 40 AND 69 THEN 10 ELSE 0 END), evidence) AS total FROM k5)"""


VERDICT_SQL = _verdict_sql()
ACTION_SQL = "CASE WHEN total >= 75 THEN 'block' WHEN total >= 50 THEN 'observe' WHEN total >= 30 THEN 'log' ELSE 'pass' END"
RISK_SQL = "CASE WHEN total >= 80 THEN 'critical' WHEN total >= 60 THEN 'high' WHEN total >= 40 THEN 'medium' WHEN total >= 20 THEN 'low' ELSE 'clean' END"


def verdicts(spark, d):
    """Every page is traffic to learn the normal requests of a path from, as none is known to be normal."""
    return vd.request_verdicts(pages(spark, d), "page_id", "url", "html", calm=101.0)


@query("a24_request_verdict", f"""WITH {VERDICT_SQL}
SELECT page_id, round(entropy, 4) AS entropy, structure, round(deviation, 4) AS deviation, detection, fusion::BIGINT AS fusion, part, obfuscation, semantic, bonus::BIGINT AS bonus, fp::BIGINT AS fp_confidence,
  fp >= 60 AS is_false_positive, evidence, round(total, 4) AS total, {ACTION_SQL} AS action, {RISK_SQL} AS risk, intent, phase, detection >= 70 OR total >= 70 AS is_attack FROM k6""")
def _(spark, d):
    r = verdicts(spark, d)
    wide = {c: F.col(c).cast("bigint") for c in ("structure", "fusion", "bonus", "obfuscation", "fp_confidence")}
    return r.withColumns(wide | {c: F.round(c, 4) for c in ("entropy", "deviation", "total")})


@query("a40_request_decision", f"""WITH {VERDICT_SQL}, m(kp, rp, i) AS (VALUES {values_sql([(k, v, ["none", "recon", "probe", "attempt", "attack", "exploit"].index(v)) for k, v in vd.REQUEST_PHASE_OF.items()])}),
np(phase, nxt, prob) AS (VALUES {values_sql([r for r in NEXT_PATHS if r[2] >= 60])}),
o AS (SELECT k6.*, regexp_extract(url, '://([^/?#:]*)', 1) AS host, coalesce(rp, 'none') AS ph, coalesce(i, 0) AS pi FROM k6 LEFT JOIN m ON k6.phase = kp),
l AS (SELECT *, lag(ph) OVER w AS before, lag(pi) OVER w AS bi FROM o WINDOW w AS (PARTITION BY host ORDER BY page_id)),
q AS (SELECT *, regexp_matches({PATH}, '(?i)^(?:{"|".join(DECOYS)})(?:$|/)') AS decoy, EXISTS (SELECT 1 FROM np WHERE np.phase = before AND contains(lower(url), lower(nxt))) AS likely, pi >= 4 OR coalesce(pi > bi + 1, false) AS jump FROM l)
SELECT page_id, host, ph AS phase, CASE WHEN decoy OR likely OR jump THEN 'block' WHEN fp >= 60 THEN 'allow' WHEN total >= 70 THEN 'block' WHEN total >= 40 THEN 'monitor' ELSE 'allow' END AS decision,
  CASE WHEN decoy THEN 'decoy' WHEN likely THEN 'predicted_path' WHEN jump THEN 'phase_jump' WHEN fp >= 60 THEN 'false_positive' WHEN total >= 40 THEN 'score' ELSE 'none' END AS reason FROM q""")
def _(spark, d):
    place = pages(spark, d).select("page_id", "url", uri.host_of(F.col("url")).alias("host"), (F.col("page_id") * 1_000_000).alias("us"))
    r = vd.request_decisions(verdicts(spark, d).join(place, "page_id"), "host", "us", "page_id", "url", NEXT_PATHS, DECOYS)
    phase = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in vd.REQUEST_PHASE_OF.items() for x in kv]), F.col("phase")), F.lit("none"))
    return r.select("page_id", "host", phase.alias("phase"), "decision", "reason")
