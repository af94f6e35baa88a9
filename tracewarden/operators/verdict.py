"""One verdict for each request, composed of the partial analyses, and the decision that follows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewarden import rulesets
from tracewarden.functions import text as tx
from tracewarden.functions import uri as ur
from tracewarden.functions.scores import first_of
from tracewarden.operators import chains, learning, params, rules, scoring
from tracewarden.session import new_path

#: Component of the score <- families and rule types that speak for it.
COMPONENT_FAMILIES = {"path": "file_inclusion", "xxe": "xxe", "ssrf": "ssrf", "ssti": "template", "deser": "deserialization", "crlf": "crlf"}
COMPONENT_TYPES = {"sql": ("sqli", "sqli_blind"), "html": ("xss",), "php": ("webshell",), "command": ("rce",),
                   "path": ("path_traversal", "file_inclusion", "file_read"), "xxe": ("xxe",)}
COMPONENTS = ["sql", "html", "php", "path", "command", "xxe", "ssrf", "ssti", "deser", "crlf", "intent", "adversarial"]
#: Least total of a request whose component is clear, and from when on it counts as clear.
FLOORS = {"php": 72.0, "command": 75.0, "sql": 72.0, "html": 72.0, "path": 72.0, "xxe": 72.0, "ssrf": 75.0}
CLEAR = 90
#: Kinds of encoding that a payload may hold.
ENCODINGS = {"percent": "%[0-9a-fA-F]{2}", "entity": "&(?:#[0-9]+|#x[0-9a-fA-F]+|[a-zA-Z]+);", "hex": r"\\x[0-9a-fA-F]{2}", "unicode": r"\\u[0-9a-fA-F]{4}"}
SPECIAL = "<>\"'%;|&`$(){}\\/*#=?!"
#: Request phase of each kill-chain phase.
REQUEST_PHASE_OF = {"recon": "recon", "weaponization": "probe", "delivery": "attempt", "exploitation": "attack", "installation": "exploit", "c2": "exploit", "actions": "exploit"}


def entropy_score(text: Column, entropy: Column) -> Column:
    """Points for the entropy of the bytes and the share of special characters; 0 below two bytes."""
    n = F.octet_length(text)
    plain = F.greatest(F.lit(0.0), F.least(F.lit(100.0), entropy / 8 * 100) - tx.ordinary_discount(text))
    return F.when(n <= 1, 0.0).otherwise(F.least(F.lit(100.0), plain * 0.5 + tx.count_chars(text, SPECIAL) / F.greatest(n, F.lit(1)) * 150))


def payload(uri: str, body: str) -> Column:
    """Both texts with a space between, without one that is null or empty."""
    return F.concat_ws(" ", F.nullif(F.col(uri), F.lit("")), F.nullif(F.col(body), F.lit("")))


def payloads(df: DataFrame, key: str, uri: str, body: str) -> DataFrame:
    """key, ``_u`` (uri), ``_x`` (uri and body), ``depth`` of percent-encoding of the uri, entropy ``_ent`` and the
    columns of `text.obfuscation` from them. A null uri or body is an empty text."""
    u, x = F.col("_u"), F.col("_x")
    d = df.select(F.col(key), F.coalesce(uri, F.lit("")).alias("_u"), payload(uri, body).alias("_x"))
    d = d.withColumns({"_ent": tx.byte_entropy(x), "depth": tx.escape_depth(u)})
    kinds = sum((tx.matches(x, p, x).cast("int") for p in ENCODINGS.values()), F.lit(0))
    return tx.obfuscation(d, "_x", F.col("depth"), kinds, F.col("depth") >= 2, F.col("_ent"))


def own_features(df: DataFrame, key: str, uri: str, body: str) -> DataFrame:
    """What a request's own text tells, without a shuffle; the texts stay behind.

    Columns: key, path, names, entropy, structure, depth, obfuscation, techniques, bypass_intent,
    template, trusted.
    """
    u, x = F.col("_u"), F.col("_x")
    d = payloads(df, key, uri, body).withColumn("_p", ur.query_pairs(u))
    names = F.transform("_p", lambda p: p["name"])
    none = F.create_map(F.lit(""), F.lit(""))
    return d.select(
        key, ur.template_prefix_ids(u).alias("path"), names.alias("names"), entropy_score(x, F.col("_ent")).alias("entropy"),
        ur.structure_score(u, F.col("_p")).alias("structure"), "depth", "obfuscation", "techniques", "bypass_intent",
        scoring.trusted_template(u, F.lit("GET"), none, F.col("_p")).alias("template"), params.trusted_share(names).alias("trusted"))


def rule_scores(df: DataFrame, key: str, text: Column) -> DataFrame:
    """Per request with a rule hit: best severity of each type (``_m_``), weighted sums (``_s_``), hits and severe hits."""
    found = rules.rule_hits(df.select(key, text.alias("_x")), [key], "_x")
    out = []
    for t in sorted({t for _, t, _ in rulesets.detection_rules()}):
        own = F.when(F.col("type") == t, F.col("severity"))
        out += [F.max(own).alias(f"_m_{t}"), F.least(F.lit(100.0), F.sum(own * float(rulesets.TYPE_WEIGHTS.get(t, 1.0)))).alias(f"_s_{t}")]
    return found.groupBy(key).agg(*out, F.count("*").alias("_hits"), F.count_if(F.col("severity") >= 80).alias("_high"))


def detection(depth: Column) -> Column:
    """The score of `rules.detection_score` over the columns of `rule_scores`; 0 without a hit."""
    x = F.greatest(*[F.coalesce(f"_s_{t}", F.lit(0.0)) for t in sorted({t for _, t, _ in rulesets.detection_rules()})])
    for by in (first_of([(depth >= 4, 1.5), (depth >= 2, 1.2)], 1.0), first_of([(F.col("_hits") >= 5, 1.4), (F.col("_hits") >= 3, 1.2)], 1.0),
               F.when(F.col("_high") >= 2, 1.3).otherwise(1.0)):
        x = F.least(F.lit(100.0), x * by)
    return F.round(x, 1)


def family_scores(df: DataFrame, key: str, parts: dict[str, str]) -> DataFrame:
    """Per request: best score of each family used as a component (``_f_``), of each part (``_v_``), number of families found."""
    rows = [df.select(key, F.lit(n).alias("name"), F.col(c).alias("value")) for n, c in parts.items()]
    both = rows[0]
    for r in rows[1:]:
        both = both.unionByName(r)
    found = rules.family_rule_hits(both)
    fams = [F.max(F.when(F.col("family") == f, F.col("score"))).alias(f"_f_{f}") for f in COMPONENT_FAMILIES.values()]
    vecs = [F.max(F.when(F.col("name") == n, F.col("score"))).alias(f"_v_{n}") for n in parts]
    return found.groupBy(key).agg(*fams, *vecs)


def request_verdicts(df: DataFrame, key: str, uri: str, body: str, *, bayes: DataFrame | None = None, behaviour: DataFrame | None = None,
                     calm: float = 50.0, seen: int = 5, block: float = 70.0) -> DataFrame:
    """One row per request: partial scores, total, action, risk, intent, phase and verdict.

    Partial scores: entropy, structure of the uri, deviation from the normal requests of its path
    (those of ``df`` with a detection score below ``calm``), rule and family components fused with
    intent and disguise, and, if given, ``bayes`` (key, bayes) and ``behaviour`` (key, behaviour).
    Discounts for probable false positives, a floor by clear evidence and the share of the
    behaviour follow. A request is an attack if the detection score or the total reaches ``block``.

    Texts are read where they lie; only scores travel, by the key of the request, which is unique. The scores
    from the own text and the rules are written once, as the normal requests are learned from them too.
    A request without any hit has zeros; null texts are empty texts.
    """
    d = df.select(key, F.coalesce(uri, F.lit("")).alias("url"), F.coalesce(body, F.lit("")).alias("data"))
    own = own_features(d, key, "url", "data")
    hit = rule_scores(d, key, payload("url", "data"))
    fam = family_scores(d, key, {"url": "url", "data": "data"})
    clue = rules.intent_evidence(rules.evidence_hits(d.select(key, payload("url", "data").alias("_x")), [key], "_x"), [key])
    s = own.join(hit, key, "left").na.fill(0, ["_hits", "_high"]).withColumn("detection", detection(F.col("depth")))
    path = new_path(df.sparkSession, "request-scores")
    s.write.parquet(path)
    s = df.sparkSession.read.schema(s.schema).parquet(path)

    normal = s.filter(F.col("detection") < calm)
    paths = normal.groupBy("path").agg(F.count("*").alias("seen"))
    dev = learning.normal_deviation(s, [key], "path", "names", paths, learning.normal_names(normal, "path", "names"), min_seen=seen)
    s = s.join(dev.select(key, F.col("deviation").alias("_dev")), key).join(fam, key, "left") \
        .join(clue.select(key, "intent", F.col("weight").alias("_w"), "phase"), key, "left")
    for extra, name in ((bayes, "bayes"), (behaviour, "behaviour")):
        s = s.withColumn(name, F.lit(0.0)) if extra is None else s.join(extra.select(key, name), key, "left").na.fill(0, [name])

    comps = {}
    for c in COMPONENTS[:-2]:
        from_rules = [F.col(f"_m_{t}") for t in COMPONENT_TYPES.get(c, ())]
        if c in COMPONENT_FAMILIES:
            from_rules.append(F.col(f"_f_{COMPONENT_FAMILIES[c]}"))
        comps[c] = F.greatest(F.lit(0), *[F.coalesce(x, F.lit(0)) for x in from_rules])
    comps["intent"] = F.least(F.lit(100), F.coalesce("_w", F.lit(0)))
    comps["adversarial"] = F.col("obfuscation")
    s = s.withColumns({f"_c_{c}": x.cast("double") for c, x in comps.items()} | {v: F.coalesce(f"_v_{v}", F.lit(0)) for v in ("url", "data")})
    comps = {c: F.col(f"_c_{c}") for c in COMPONENTS}
    s = scoring.fuse_vectors(s, ["url", "data"])
    s = s.withColumn("semantic", F.round(scoring.component_score(comps, F.col("fusion"), F.col("obfuscation")), 4))
    depth, sem = F.col("depth"), F.col("semantic")
    s = s.withColumn("bonus", scoring.encoding_bonus(depth, F.col("techniques"), sem, F.col("obfuscation"), F.col("bypass_intent")))
    s = s.withColumn("deviation", F.least(F.lit(100.0), F.col("_dev") * 60 + first_of([(depth >= 4, 20), (depth >= 2, 10)], 0) + F.when(depth >= 2, 15).otherwise(0)))

    strong = sum((F.when(c >= 40, 1).otherwise(0) for c in comps.values()), F.lit(0))
    clear = F.greatest(F.lit(0.0), *[F.when(comps[c] >= CLEAR, v).otherwise(0.0) for c, v in FLOORS.items()])
    s = s.withColumn("evidence", clear)
    s = scoring.false_positive(
        s, score=sem, template=F.col("template").isNotNull(), learned=F.col("_dev") == 0, trusted_share=F.col("trusted"), safelisted=F.col("trusted") == 1.0,
        weak=F.col("_hits") <= 2, consistent=(F.col("behaviour") < 10) & (sem < 30), uneven=(sem >= 40) & (strong <= 1), harmless=F.col("evidence") == 0,
        clean=(F.col("obfuscation") < 20) & (depth <= 2), mismatch=F.when((sem >= 50) & ur.is_static(F.col("path")), 20).otherwise(0), reduction=F.lit(1.0), keyword=F.col("_hits") > 0)
    s = scoring.final_score(s, entropy=F.col("entropy"), semantic=sem, structure=F.col("structure"), deviation=F.col("deviation"), bayes=F.col("bayes"), bonus=F.col("bonus"),
                            false_positive=F.col("is_false_positive"), fp_confidence=F.col("fp_confidence"), verify=F.col("needs_verification"), evidence=F.col("evidence"),
                            behaviour=F.col("behaviour"))
    attack = (F.col("detection") >= block) | (F.col("total") >= block)
    return s.select(key, "entropy", "structure", "deviation", "detection", "fusion", F.col("primary").alias("part"), "obfuscation", "semantic", "bonus", "fp_confidence",
                    "is_false_positive", "evidence", "total", "action", "risk", "intent", "phase", attack.alias("is_attack"))


def request_decisions(verdicts: DataFrame, client: str, t: str, tie: str, uri: str, predictions: Sequence[tuple[str, str, int]], decoys: Sequence[str],
                      chains_of: DataFrame | None = None) -> DataFrame:
    """Adds ``decision`` and ``reason`` to verdicts that also have a client, time and uri.

    Decoy paths, paths that the client's previous phase made likely, known attack chains (``chains_of``:
    client, block_early) and phase jumps block; then a false positive passes; then the score decides.
    """
    v = verdicts.withColumn("_now", F.coalesce(first_of([(F.col("phase") == k, F.lit(p)) for k, p in REQUEST_PHASE_OF.items()], None), F.lit("none")))
    v = chains.phase_jumps(v, [client], t, tie, "_now")
    likely = chains.predicted_path_hits(v.select(client, t, tie, "_now", uri), [client], t, tie, "_now", uri, list(predictions)).select(tie, F.lit(True).alias("_likely"))
    v = v.join(likely, tie, "left").withColumn("_likely", F.coalesce("_likely", F.lit(False)))
    v = v.withColumn("_chain", F.lit(False)) if chains_of is None else v.join(chains_of.select(client, F.col("block_early").alias("_chain")), client, "left").na.fill(False, ["_chain"])
    bait = F.coalesce(ur.path_of(F.col(uri)).rlike("(?i)^(?:" + "|".join(rulesets.literal(d) for d in decoys) + r")(?:$|/)"), F.lit(False))
    action, reason = scoring.decide(bait, F.col("_likely"), F.col("_chain"), F.col("jump") != "none", F.col("risk") == "medium", F.col("is_false_positive"), F.col("total"))
    return v.withColumns({"decision": action, "reason": reason}).drop("_now", "_likely", "_chain", "jump")
