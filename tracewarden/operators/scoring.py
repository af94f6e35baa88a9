"""Fusion of partial scores into request scores, false-positive control and decisions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewarden.functions.audit import header
from tracewarden.functions.scores import action_band, first_of, points, risk_band


def fuse_vectors(df: DataFrame, vectors: Sequence[str]) -> DataFrame:
    """Adds ``fusion``, ``active`` and ``primary`` for score columns of request parts.

    The best score, 15 more for two from 30 on or 8 for one and a further from 15 on, 10 more
    for five active parts, at most 100. The first part wins a tie.
    """
    s = F.array(*[F.col(v) for v in vectors])
    high, mid, active = F.size(F.filter(s, lambda x: x >= 30)), F.size(F.filter(s, lambda x: (x >= 15) & (x < 30))), F.size(F.filter(s, lambda x: x > 0))
    extra = first_of([(high >= 2, 15), ((high >= 1) & (mid >= 1), 8)], 0) + F.when(active >= 5, 10).otherwise(0)
    best = F.array_max(F.array(*[F.struct(F.col(v).alias("s"), F.lit(-i).alias("r"), F.lit(v).alias("n")) for i, v in enumerate(vectors)]))
    return df.withColumn("fusion", F.least(F.lit(100), F.array_max(s) + extra)).withColumn("active", active).withColumn("primary", best["n"])


# Weights of the partial analyses.
COMPONENT_WEIGHTS = {
    "char": 0.02, "word": 0.02, "structure": 0.04, "param": 0.03, "business": 0.03, "logic": 0.05, "intent": 0.07, "chain": 0.04, "memory": 0.03, "adversarial": 0.04,
    "sql": 0.10, "html": 0.08, "php": 0.08, "path": 0.08, "command": 0.08, "xxe": 0.07, "ssrf": 0.07, "ssti": 0.07, "deser": 0.07, "crlf": 0.05, "expr": 0.06,
    "graphql": 0.07, "websocket": 0.06, "csv": 0.06, "yaml": 0.07, "redos": 0.06, "param_position": 0.05, "request_context": 0.06,
}


def component_score(components: dict[str, Column], fusion: Column, obfuscation: Column, weights=None) -> Column:
    """Weighted sum of partial scores with shares of fusion and obfuscation and a bonus for
    several partial scores from 50 on."""
    weights = COMPONENT_WEIGHTS if weights is None else weights
    total = F.lit(0.0)
    for n, c in components.items():
        total = total + c * weights.get(n, 0.0)
    high = F.lit(0)
    for c in components.values():
        high = high + F.when(c >= 50, 1).otherwise(0)
    total = total + F.when(fusion >= 30, fusion * 0.08).otherwise(0.0) + first_of([(obfuscation >= 50, obfuscation * 0.12), (obfuscation >= 30, obfuscation * 0.06)], F.lit(0.0))
    total = total + first_of([(high >= 6, 18), (high >= 5, 15), (high >= 4, 10), (high >= 3, 6), (high >= 2, 3)], 0)
    return F.least(F.lit(100.0), total)


def final_score(df: DataFrame, *, entropy: Column, semantic: Column, structure: Column, deviation: Column, bayes: Column, bonus: Column, false_positive: Column,
                fp_confidence: Column, verify: Column, evidence: Column, behaviour: Column) -> DataFrame:
    """Adds ``total``, ``action`` and ``risk``: the weighted sum, discounts for probable false
    positives, a floor by clear evidence and a share of the behaviour score."""
    base = F.least(F.lit(100.0), F.round(entropy * 0.08 + semantic * 0.45 + structure * 0.20 + deviation * 0.12 + bayes * 0.08 + bonus, 1))
    cut = F.when(false_positive, first_of([(fp_confidence >= 90, 30), (fp_confidence >= 75, 15)], 5)).otherwise(0)
    x = F.greatest(F.lit(0.0), base - cut)
    x = F.greatest(F.lit(0.0), x - F.when(verify, 10).otherwise(0))
    x = F.greatest(x, evidence) + F.least(F.lit(25.0), behaviour * 0.3)
    d = df.withColumn("total", F.least(F.lit(100.0), x))
    return d.withColumn("action", action_band(F.col("total"))).withColumn("risk", risk_band(F.col("total")))


# Worth of a disguise technique.
TECHNIQUE_VALUES = {"utf8_overlong": 10, "unicode_percent_u": 8, "homoglyph_normalize": 7, "zero_width_remove": 6, "fullwidth_normalize": 5, "base64": 3,
                    "hex_escape": 4, "octal_escape": 4, "unicode_escape": 4, "html_numeric_entity": 3, "html_named_entity": 2}


def encoding_bonus(depth: Column, techniques: Column, semantic: Column, adversarial: Column, bypass: Column) -> Column:
    """Bonus for disguised texts, 0 below a semantic score of 20, at most 45."""
    table = F.create_map(*[x for k, v in TECHNIQUE_VALUES.items() for x in (F.lit(k), F.lit(v))])
    worth = F.transform(F.array_distinct(techniques), lambda t: F.coalesce(F.try_element_at(table, t), F.lit(0)))
    known = F.size(F.filter(worth, lambda v: v > 0))
    full = first_of([(depth >= 4, 12), (depth >= 3, 8), (depth >= 2, 4)], 2) + F.aggregate(worth, F.lit(0), lambda a, v: a + v) \
        + first_of([(adversarial >= 70, 8), (adversarial >= 50, 5), (adversarial >= 30, 2)], 0) + first_of([(bypass >= 20, 6), (bypass >= 10, 3)], 0) \
        + first_of([((semantic >= 60) & (depth >= 2), 8), ((semantic >= 45) & (depth >= 1), 4)], 0) + first_of([(known >= 3, 6), (known >= 2, 3)], 0)
    return first_of([((depth <= 0) | (semantic < 20), F.lit(0)), (semantic < 35, F.least(F.lit(5), depth))], F.least(F.lit(45), full))


CONTEXT_WEIGHTS = {"csrf": 0.30, "replay": 0.25, "session": 0.30, "timing": 0.25, "api": 0.30, "pattern": 0.25}


def context_score(risks: dict[str, Column]) -> Column:
    """Best weighted context risk on a scale to 100."""
    best = F.greatest(*[c * CONTEXT_WEIGHTS[n] / 100 for n, c in risks.items()])
    return F.greatest(F.lit(0), F.least(F.lit(100), F.round(best / 0.30 * 100).cast("int")))


# Templates of trusted requests. Conditions: uri, method, content type and accept
# patterns, any of the parameter names, all of the names, any of the headers, a value pattern.
TRUSTED_TEMPLATES: list[tuple[str, dict]] = [
    ("search_query", {"uri": r"(?i)(?:search|query|keyword|q)\b", "any": ["q", "query", "keyword", "s", "search"]}),
    ("url_encoded", {"all": ["url", "link", "redirect", "next", "return_url"], "value": r"(?i)^https?://[\w\-\.]+(?:/[\w\-\./?%&=]*)?$"}),
    ("markdown_content", {"uri": r"(?i)(?:edit|post|content|write|blog)\b"}), ("code_snippet", {"uri": r"(?i)(?:code|gist|snippet|paste)\b"}),
    ("json_data", {"type": r"(?i)application/json", "value": r"^\s*\{[\s\S]*\}\s*$"}), ("xml_data", {"type": r"(?i)application/xml|text/xml", "value": r"^\s*<\?xml"}),
    ("file_upload", {"uri": r"(?i)(?:upload|file)\b", "method": "POST", "type": r"(?i)multipart/form-data"}),
    ("api_request", {"uri": r"(?i)(?:api|v1|v2|v3)\b", "accept": r"(?i)application/json", "headers": ["authorization", "x-api-key", "x-request-id"]}),
    ("login_request", {"uri": r"(?i)(?:login|signin|auth)\b", "any": ["username", "email", "password", "captcha"]}),
    ("normal_form", {"method": "POST", "type": r"(?i)application/x-www-form-urlencoded", "at_most": 10}),
    ("wp_post_edit", {"uri": r"(?i)wp-admin/(?:post|post-new|page|page-new)\.php", "method": "POST", "any": ["post_title", "post_content", "post_excerpt", "content"]}),
    ("wp_comment", {"uri": r"(?i)wp-comments-post\.php", "method": "POST", "any": ["comment", "author", "email", "url"]}),
    ("wp_theme_customize", {"uri": r"(?i)wp-admin/customize\.php", "method": "POST", "any": ["customized", "wp_customize"]}),
    ("wp_ajax", {"uri": r"(?i)(?:admin-ajax|wp-json)\b", "method": "POST", "any": ["action", "_ajax_nonce", "nonce"]}),
    ("wp_rest_api", {"uri": r"(?i)wp-json/wp/v\d+", "headers": ["x-wp-nonce"]}),
    ("wp_media_upload", {"uri": r"(?i)wp-admin/(?:async-upload|media-new|upload)\.php", "method": "POST", "type": r"(?i)multipart/form-data"}),
    ("wp_plugin_settings", {"uri": r"(?i)wp-admin/(?:options|settings|plugins|themes)\.php", "method": "POST"}),
    ("wp_heartbeat", {"uri": r"(?i)/wp-admin/admin-ajax\.php", "method": "POST", "any": ["action"]}),
    ("graphql_request", {"uri": r"(?i)/(?:api/)?graphql\b", "method": "POST", "type": r"(?i)application/json"}),
    ("api_pagination", {"any": ["page", "per_page", "p", "offset", "limit", "pagesize"]}), ("i18n_param", {"any": ["lang", "language", "locale"]}),
    ("csrf_token_param", {"any": ["_token", "csrf_token", "_csrf", "_csrf_token"]}), ("wp_cron", {"uri": r"(?i)/wp-cron\.php", "any": ["doing_wp_cron"]}),
]


def trusted_template(uri: Column, method: Column, headers: Column, params: Column, templates=TRUSTED_TEMPLATES) -> Column:
    """Name of the first template whose conditions all hold; ``params`` is (name, value) structs."""
    names = F.transform(params, lambda p: p["name"])

    def holds(c: dict) -> Column:
        ok = F.lit(True)
        if "uri" in c:
            ok = ok & uri.rlike(c["uri"])
        if "method" in c:
            ok = ok & (F.upper(method) == c["method"])
        for key, h in (("type", "content-type"), ("accept", "accept")):
            if key in c:
                ok = ok & header(headers, h).rlike(c[key])
        if "any" in c:
            ok = ok & F.arrays_overlap(names, F.array(*[F.lit(x) for x in c["any"]]))
        if "all" in c:
            ok = ok & (F.size(F.array_except(F.array(*[F.lit(x) for x in c["all"]]), names)) == 0)
        if "headers" in c:
            any_h = F.lit(False)
            for x in c["headers"]:
                any_h = any_h | F.map_contains_key(headers, x)
            ok = ok & any_h
        if "at_most" in c:
            ok = ok & (F.size(params) <= c["at_most"])
        if "value" in c:
            ok = ok & ((F.size(params) == 0) | F.exists(params, lambda p: p["value"].rlike(c["value"])))
        return ok

    return first_of([(holds(c), n) for n, c in templates], None)


def false_positive(df: DataFrame, *, score: Column, template: Column, learned: Column, trusted_share: Column, safelisted: Column, weak: Column, consistent: Column,
                   uneven: Column, harmless: Column, clean: Column, mismatch: Column, reduction: Column, keyword: Column) -> DataFrame:
    """Adds ``fp_confidence``, ``is_false_positive`` and ``needs_verification``.

    ``mismatch`` is the points for a context that does not fit, ``reduction`` the share of
    the score that is left, ``keyword`` whether an attack word occurs. From a score of 80 on
    the confidence stays at 40 or below.
    """
    top = score >= 80
    d = df.withColumn("_top", top).withColumn("_score", score)
    low = ~F.col("_top")
    conf = points((template & low, 10), (learned & low, 15), ((trusted_share >= 0.8) & low, 10), ((trusted_share >= 0.5) & ~((trusted_share >= 0.8) & low), 5),
                  (safelisted & low, 10), (weak, 15), (consistent, 15), (uneven, 10), (harmless, 15), (clean, 10)) + F.when(low, mismatch).otherwise(0)
    conf = F.when(F.col("_top"), F.least(conf, F.lit(40))).otherwise(conf) + F.when(low & (reduction <= 0.5), 10).otherwise(0)
    tiny = (F.col("_score") < 10) & ~keyword
    d = d.withColumn("fp_confidence", F.when(tiny, 100).otherwise(conf).cast("bigint"))
    return d.withColumn("is_false_positive", F.col("fp_confidence") >= 60).withColumn(
        "needs_verification", (F.col("_score") >= 50) & F.col("fp_confidence").between(40, 69)).drop("_top", "_score")


def decide(decoy: Column, predicted: Column, chain: Column, jump: Column, watch: Column, false_positive: Column, score: Column, block: int = 70, monitor: int = 40) -> tuple[Column, Column]:
    """Action and reason: decoy, predicted path, chain and phase jump block; then a false
    positive passes; then the score decides."""
    reason = first_of([(decoy, "decoy"), (predicted, "predicted_path"), (chain, "attack_chain"), (jump, "phase_jump"), (false_positive, "false_positive"),
                       (score >= block, "score"), (score >= monitor, "score"), (watch, "suspicious")], "none")
    action = first_of([(decoy | predicted | chain | jump, "block"), (false_positive, "allow"), (score >= block, "block"), (score >= monitor, "monitor")], "allow")
    return action, reason
