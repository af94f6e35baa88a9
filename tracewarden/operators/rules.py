"""Rule scans over texts and parameters, and the scores that follow from the hits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewarden import family_rules, rulesets
from tracewarden.family_rules import Family
from tracewarden.functions.scores import band, first_of, points, whole
from tracewarden.functions.text import char_grams, decode_layers, java_regex, matches, required_pieces
from tracewarden.session import new_path
from tracewarden.tables import KILL_CHAIN


def _sql(value) -> str:
    """A literal in SQL text."""
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return str(value)


#: Characters that many rules need and few texts hold.
MARKS = "`\\^~$@|[{%*#'}]!&;?+_(:="


def _cases(low: str, cases: Sequence[tuple[list[str] | None, str]]) -> str:
    """SQL array of the cases (pieces of which a match needs one, SQL text), those that need a character of
    ``MARKS`` looked at only where the lower-case column has it: one byte scan for all of them."""
    groups: dict[str | None, list[str]] = {}
    for pieces, case in cases:
        groups.setdefault(next((m for m in MARKS if pieces and all(m in p for p in pieces)), None), []).append(case)
    arrays = [f"if(contains({low}, {_sql(m)}), array({', '.join(g)}), array())" if m else f"array({', '.join(g)})" for m, g in groups.items()]
    return f"flatten(array({', '.join(arrays)}))"


def hits(text: str, low: str, rules: Sequence[tuple], fields: Sequence[str]) -> Column:
    """Array of the rules (pattern, values..) that the text column matches; ``low`` names its
    lower-case column.

    A rule is (pattern, values) or (pattern, values, second pattern that must match too).
    Rules of an operator are settings, compiled into the expression: each pattern is
    compiled once per task, and no row is multiplied before a rule has hit. Given to Spark
    as one SQL text, which is far quicker than hundreds of calls from Python. A rule's
    pattern runs only where a substring that it needs is found.
    """
    cases = []
    for pattern, values, *also in rules:
        cond = f"{text} rlike {_sql(java_regex(pattern))}"
        pieces = required_pieces(pattern)
        if pieces:
            cond = "(" + " or ".join(f"contains({low}, {_sql(p)})" for p in pieces) + f") and {cond}"
        if also and also[0]:
            cond += f" and {text} rlike {_sql(java_regex(also[0]))}"
        rule = ", ".join(f"{_sql(f)}, {_sql(v)}" for f, v in zip(fields, values))
        cases.append((pieces, f"case when {cond} then named_struct({rule}) end"))
    return F.expr(f"filter({_cases(low, cases)}, h -> h is not null)")


def rule_hits(df: DataFrame, ids: Sequence[str], text: str, rules=None) -> DataFrame:
    """One row per text and matched rule: (ids, rule_id, type, severity)."""
    rules = rulesets.detection_rules() if rules is None else rules
    keyed = [(p, (i, t, s)) for i, (p, t, s) in enumerate(rules)]
    low = df.select(*ids, F.lower(text).alias("_t"))
    return low.select(*ids, F.explode(hits("_t", "_t", keyed, ["rule_id", "type", "severity"])).alias("h")).select(*ids, "h.*")


#: Up to so many pieces are looked for one by one, more are met by a join with all pieces of the texts.
FEW_PIECES = 256


def learned_rule_hits(df: DataFrame, ids: Sequence[str], text: str, rules: DataFrame, gram: int = 4) -> DataFrame:
    """Matches of a table of learned substrings (pattern, type, severity) of any size.

    A substring is filed under the rarest of its pieces of ``gram`` characters, by the number of
    texts that hold each, and is looked for only in texts with that piece; substrings with a piece
    that no text holds are in none. Shorter substrings are pieces themselves. Pieces carry the ids only;
    the rules and they are written once; the texts come back by a join on the ids for the candidates.
    """
    def stored(rows: DataFrame, name: str) -> DataFrame:
        path = new_path(df.sparkSession, name)
        rows.write.parquet(path)
        return df.sparkSession.read.schema(rows.schema).parquet(path)

    r = stored(rules.select(F.lower("pattern").alias("pattern"), "type", "severity").distinct().filter(F.length("pattern") > 0), "learned-rules")
    n = F.least(F.lit(gram), F.length("pattern"))
    whole = F.expr(f"transform(sequence(1, length(pattern) - least({gram}, length(pattern)) + 1), i -> substr(pattern, i, {gram}))")
    filed = r.select("pattern").distinct().select("pattern", n.alias("_n"), F.explode(F.array_distinct(whole)).alias("_g"))
    low = df.select(*ids, F.lower(text).alias("_t"))
    used = filed.select("_n", "_g").distinct()
    lengths = sorted(x[0] for x in used.select("_n").distinct().collect())
    if not lengths:
        return low.join(r, F.lit(False)).drop("_t")

    def of_length(k: int) -> Column:
        return F.transform(F.array_distinct(char_grams(F.col("_t"), k)), lambda g: F.struct(F.lit(k).alias("_n"), g.alias("_g")))

    few = used.limit(FEW_PIECES + 1).collect()
    if len(few) <= FEW_PIECES:
        pieces = F.array(*[F.when(F.contains("_t", F.lit(x["_g"])), F.struct(F.lit(x["_n"]).alias("_n"), F.lit(x["_g"]).alias("_g"))) for x in few])
        grams = low.select(*ids, F.explode(pieces).alias("_p")).filter(F.col("_p").isNotNull()).select(*ids, "_p.*")
    else:
        pieces = F.concat(*map(of_length, lengths))
        grams = low.select(*ids, F.explode(pieces).alias("_p")).select(*ids, "_p.*").join(used, ["_n", "_g"], "left_semi")
    grams = stored(grams, "rule-grams")
    texts = grams.groupBy("_n", "_g").agg(F.count("*").alias("_d"))
    rarest = filed.join(texts, ["_n", "_g"], "left").groupBy("pattern").agg(
        F.min(F.struct(F.coalesce("_d", F.lit(0)).alias("d"), F.col("_n"), F.col("_g"))).alias("_m")).filter("_m.d > 0")
    found = grams.join(rarest.select("pattern", "_m._n", "_m._g"), ["_n", "_g"]).join(r, "pattern")
    return found.select(*ids, "pattern", "type", "severity").join(low, list(ids)).filter(F.contains("_t", F.col("pattern"))).drop("_t")


def family_rule_hits(params: DataFrame, families: dict[str, Family] | None = None) -> DataFrame:
    """One row per parameter and matched rule: the columns of ``params`` (with ``name`` and ``value``),
    rule_id, family, category and score.

    The score is the severity times the weight of the name times the share for a missing second
    pattern. Every pattern runs once on a value, second patterns and contexts only where a first one
    has hit, and rules that hold for certain names run only there.
    """
    families = family_rules.FAMILIES if families is None else families
    rows = family_rules.rule_rows(families)
    d = params.withColumn("_v", F.trim("value")).withColumn("_l", F.lower("_v"))
    named = {f"_n_{fam}": F.coalesce(F.lower("name").isin(f.names), F.lit(False)) if f.names else F.lit(True) for fam, f in families.items()}
    d = d.withColumns(named)
    cases = []
    for rule_id, fam, category, pattern, severity, also, gated in rows:
        f = families[fam]
        here = f"_n_{fam}" + (f" or _v rlike {_sql(java_regex(f.context))}" if f.names and f.context else "")
        second = f"_v rlike {_sql(java_regex(also))}" if also else ""
        score = f"{severity} * if({here}, 1.0D, {f.other}D)" + (f" * if({second}, 1.0D, {f.short}D)" if also else "")
        cond = f"_v rlike {_sql(java_regex(pattern))}"
        if pieces := required_pieces(pattern):
            cond = "(" + " or ".join(f"contains(_l, {_sql(p)})" for p in pieces) + f") and {cond}"
        if gated:
            cond = f"_n_{fam} and {cond}"
        if also and not f.short:
            cond += f" and {second}"
        cases.append((pieces, f"case when {cond} then named_struct('rule_id', {_sql(rule_id)}, 'family', {_sql(fam)}, 'category', {_sql(category)}, 'score', cast(floor({score}) as int)) end"))
    d = d.withColumn("_h", F.expr(f"filter({_cases('_l', cases)}, h -> h is not null and h.score > 0)")).drop("_v", "_l", *named)
    # an outer explode: for a plain one Spark would put the whole expression into a filter once more
    return d.select(*params.columns, F.explode_outer("_h").alias("_h")).filter(F.col("_h").isNotNull()).select(*params.columns, "_h.*")


def family_hits(params: DataFrame, families: dict[str, Family] | None = None) -> DataFrame:
    """Best score per parameter row and family, and whether it is found (from 50).

    Equal parameter rows are one; give them an id to keep them apart.
    """
    best = family_rule_hits(params, families).groupBy(*params.columns, "family").agg(F.max("score").alias("score"))
    return best.withColumn("detected", F.col("score") >= 50)


def id_hits(params: DataFrame) -> DataFrame:
    """Parameters that carry object ids: ``params`` has ``name``, ``value`` and ``path``.

    The first name rule that fits gives the score, an odd value may raise it, and a sensitive path
    counts 1.3 times. Names of many ids count by themselves.
    """
    name, value, path = F.col("name"), F.trim("value"), F.lower("path")
    one = first_of([(name.rlike(p), F.lit(s)) for p, s in family_rules.ID_NAMES], F.lit(0))
    many = F.greatest(*[F.when(name.rlike(p) & value.contains(","), s).otherwise(0) for p, s in family_rules.BATCH_NAMES])
    odd = F.greatest(*[F.when(value.rlike(p), s).otherwise(0) for _, p, s in family_rules.ID_VALUES])
    base = F.when(one > 0, F.greatest(one, odd)).otherwise(0)
    near = F.exists(F.array(*map(F.lit, family_rules.SENSITIVE_PATHS)), lambda x: (path == x) | path.startswith(F.concat(x, F.lit("/"))))
    score = F.greatest(F.when(F.coalesce(near, F.lit(False)), F.least(F.lit(100), F.floor(base * 1.3))).otherwise(base), many).cast("int")
    return params.withColumn("score", score).filter(F.col("score") > 0).withColumn("detected", F.col("score") >= 50)


def detection_score(found: DataFrame, ids: Sequence[str], weights: dict[str, float] | None = None, depth: DataFrame | None = None,
                    limit: float = 70.0) -> DataFrame:
    """Score per text from its hits (type, severity).

    Per type the weighted severities are summed up to 100; the best type is raised for many
    hits, several severe ones and, if ``depth`` (ids, depth) is given, for encoded texts.
    """
    w = rulesets.TYPE_WEIGHTS if weights is None else weights
    weight = first_of([(F.col("type") == t, F.lit(float(x))) for t, x in w.items()], F.lit(1.0))
    per_type = found.groupBy(*ids, "type").agg(F.least(F.lit(100.0), F.sum(F.col("severity") * weight)).alias("s"), F.count("*").alias("n"),
                                               F.count_if(F.col("severity") >= 80).alias("high"))
    d = per_type.groupBy(*ids).agg(F.max("s").alias("base"), F.max_by("type", F.struct("s", "type")).alias("top_type"), F.sum("n").alias("hits"),
                                   F.sum("high").alias("high_hits"))
    factor = F.lit(1.0)
    if depth is not None:
        d = d.join(depth, list(ids), "left")
        factor = first_of([(F.col("depth") >= 4, 1.5), (F.col("depth") >= 2, 1.2)], 1.0)

    def raised(x: Column, by: Column) -> Column:
        return F.least(F.lit(100.0), x * by)

    x = raised(F.col("base"), factor)
    x = raised(x, first_of([(F.col("hits") >= 5, 1.4), (F.col("hits") >= 3, 1.2)], 1.0))
    x = raised(x, F.when(F.col("high_hits") >= 2, 1.3).otherwise(1.0))
    d = d.withColumn("score", F.round(x, 1))
    return d.withColumn("is_attack", F.col("score") >= limit).withColumn(
        "confidence", F.least(F.lit(100), 50 + F.col("hits") * 10 + F.col("high_hits") * 15)).drop("base")


def evidence_hits(df: DataFrame, ids: Sequence[str], text: str, rules=None) -> DataFrame:
    """One row per text and matched evidence rule: (ids, intent, weight, phase, node)."""
    rules = rulesets.EVIDENCE if rules is None else rules
    keyed = [(p, (c, w, ph, n)) for c, p, w, ph, n in rules]
    d = df.select(*ids, F.col(text).alias("_t"), F.lower(text).alias("_l"))
    return d.select(*ids, F.explode(hits("_t", "_l", keyed, ["intent", "weight", "phase", "node"])).alias("h")).select(*ids, "h.*")


def intent_evidence(found: DataFrame, ids: Sequence[str]) -> DataFrame:
    """Top intent, deepest phase and confidence per text from its evidence."""
    order = F.array_position(F.array(*[F.lit(p) for p in KILL_CHAIN]), F.col("phase"))
    g = found.withColumn("o", order).groupBy(*ids, "intent").agg(
        F.sum("weight").alias("w"), F.count("*").alias("n"), F.count_distinct("node").alias("nodes"), F.max("o").alias("o"))
    w = F.col("w") + first_of([(F.col("n") >= 4, 12), (F.col("n") == 3, 10), (F.col("n") == 2, 5)], 0) \
        + first_of([(F.col("nodes") >= 3, 8), (F.col("nodes") == 2, 4)], 0)
    g = g.withColumn("w", w)
    best = F.max_by(F.struct("intent", "w", "n"), F.struct("w", "n", "intent")).alias("b")
    d = g.groupBy(*ids).agg(best, F.sum("n").alias("evidence"), F.count("*").alias("intents"), F.max("o").alias("o"))
    conf = F.least(F.lit(40.0), F.col("evidence") * 12.0) + F.least(F.lit(25.0), F.col("b.n") * 8.0) \
        + first_of([(F.col("intents") >= 3, 20.0), (F.col("intents") == 2, 12.0)], 0.0) + F.col("o") / 7.0 * 15.0
    return d.select(*ids, F.col("b.intent").alias("intent"), F.col("b.w").alias("weight"), "evidence", "intents",
                    F.element_at(F.array(*[F.lit(p) for p in KILL_CHAIN]), F.col("o").cast("int")).alias("phase"),
                    F.least(F.lit(100.0), conf).alias("confidence"))


def keyword_intents(df: DataFrame, ids: Sequence[str], text: Column, intents=None) -> DataFrame:
    """Top intent by the share of its indicators found, with a confidence."""
    intents = rulesets.INTENTS if intents is None else intents
    df = df.withColumn("_t", text).withColumn("_l", F.lower("_t"))
    items = []
    for i, (name, (weight, patterns)) in enumerate(intents.items()):
        n = F.lit(0)
        for p in patterns:
            n = n + matches(F.col("_t"), p, F.col("_l")).cast("int")
        items.append(F.struct(n.alias("n"), F.lit(len(patterns)).alias("of"), F.lit(weight).alias("weight"), F.lit(-i).alias("rank"), F.lit(name).alias("intent")))
    found = F.filter(F.array(*items), lambda x: x["n"] > 0)
    scored = F.transform("_n", lambda x: F.struct(
        F.least(F.lit(100.0), F.round(x["n"] * 100.0 / x["of"] * first_of([(x["n"] >= 3, 1.3), (x["n"] == 2, 1.15)], 1.0) * (x["weight"] / 100.0))).alias("score"),
        x["rank"].alias("rank"), x["intent"].alias("intent"), x["n"].alias("n")))
    d = df.select(*ids, found.alias("_n")).select(*ids, F.array_max(scored).alias("b"))
    score = F.coalesce(F.col("b.score"), F.lit(0.0)).cast("bigint")
    return d.select(*ids, score.alias("score"), F.coalesce("b.intent", F.lit("unknown")).alias("intent"),
                    F.when(score > 0, F.least(F.lit(100.0), F.round(score * 0.7 + F.col("b.n") * 8))).otherwise(0).cast("bigint").alias("confidence"))


CONTENT_BANDS = [(80, "malicious"), (40, "suspicious")]


def content_scan(df: DataFrame, ids: Sequence[str], text: str, signatures=None, limit: int = 50, decode: bool = False) -> DataFrame:
    """Per file or text: signature, heuristic and detection engines combined.

    With ``decode`` the detection rules read the decoded text, and a fourth engine gives points for
    complex or deep encodings and for a length that decoding changes. The threshold falls by 5, 10
    or 15 when two, three or four engines agree. ``type`` is that of the most severe hit.
    """
    signatures = rulesets.CONTENT_SIGNATURES if signatures is None else signatures
    df = df.select(*ids, F.col(text).alias("_t"), F.lower(text).alias("_l"))
    read, encoded = F.col("_l"), F.lit(0)
    if decode:
        df = decode_layers(df, "_t")
        n = F.octet_length("_t")
        changed = F.abs(F.octet_length("decoded") - n) / F.nullif(n, F.lit(0)) > 0.3
        read = F.lower("decoded")
        encoded = first_of([(F.col("complexity") > 50, 10), (F.col("complexity") > 30, 5)], 0) + points((F.col("depth") >= 4, 10), (F.coalesce(changed, F.lit(False)), 5))
    t, low = F.col("_t"), F.col("_l")
    raw = F.lit(0)
    for p, w in signatures:
        raw = raw + F.when(matches(t, p, low), w).otherwise(0)
    b64, chrs, gotos = (F.regexp_count(t, F.lit(p)) for p in (r"(?i)base64_decode\s*\(", r"(?i)chr\s*\(\s*\d+\s*\)", r"(?i)goto\s+\w+\s*;"))
    packed = matches(t, r"(?i)(?:eval|base64_decode|assert|system|exec|passthru|shell_exec|str_rot13|gzinflate|gzuncompress)\s*\([^)]*[A-Za-z0-9+/]{80,}={0,2}", low)
    heuristic = F.when(b64 > 2, F.least(F.lit(15), b64 * 4)).otherwise(0) + F.when(chrs > 5, F.least(F.lit(12), chrs * 2)).otherwise(0) + points(
        (packed, 10), (gotos > 3, 10), (F.array_max(F.transform(F.split(t, "\n"), lambda x: F.octet_length(x))) > 2000, 10),
        (F.regexp_count(t, F.lit(r"\$[O0lI]{4,}")) > 3, 8))
    d = df.select(*ids, read.alias("_l"), F.least(F.lit(80), raw).alias("signature"), F.least(F.lit(40), heuristic).alias("heuristic"), encoded.alias("encoded"))
    keyed = [(p, (ty, s)) for p, ty, s in rulesets.detection_rules()]
    d = d.select(*ids, "signature", "heuristic", "encoded", hits("_l", "_l", keyed, ["type", "severity"]).alias("_h"))
    worst = F.array_max(F.transform("_h", lambda x: F.struct(x["severity"].alias("severity"), x["type"].alias("type"))))
    d = d.select(*ids, "signature", "heuristic", "encoded", worst.alias("_w"), F.size("_h").alias("hits"))
    d = d.select(*ids, "signature", "heuristic", "encoded", F.coalesce("_w.severity", F.lit(0)).alias("detection"), F.col("_w.type").alias("type"), "hits")
    detected = (F.col("detection") >= 70) & (F.col("hits") >= 2)
    engines = (F.col("signature") > 0).cast("int") + detected.cast("int") + (F.col("heuristic") > 0).cast("int") + (F.col("encoded") > 0).cast("int")
    score = F.least(F.col("signature") * 0.6, F.lit(40.0)) + F.when(detected, F.least(F.col("detection") * 0.35, F.lit(35.0))).otherwise(0.0) \
        + F.least(F.col("heuristic") * 0.4, F.lit(15.0)) + F.col("encoded")
    d = d.withColumn("engines", engines).withColumn("score", F.least(F.lit(100.0), F.round(score, 1)))
    threshold = first_of([(F.col("engines") >= 4, max(35, limit - 15)), (F.col("engines") == 3, max(40, limit - 10)), (F.col("engines") == 2, max(45, limit - 5))], limit)
    return d.withColumn("threshold", threshold).withColumn("malicious", F.col("score") >= F.col("threshold")) \
        .withColumn("band", band(F.col("score"), CONTENT_BANDS, "clean"))


def tagged(rule: Column):
    """Function from a position to (rule, position)."""
    return lambda x: F.struct(rule, x.alias("position"))


def hit_lines(df: DataFrame, ids: Sequence[str], text: str, rules=None) -> DataFrame:
    """Where rules hit: (ids, line_no, position, rule_id), counted from 1; every match of a line.

    The matches of a rule follow one another from the left. A match's position is the length of
    what stands before it: the pieces between matches and the matches so far.
    """
    rules = rulesets.detection_rules() if rules is None else rules
    lines = df.select(*ids, F.posexplode(F.split(F.lower(text), "\n")).alias("pos", "line"))
    found = []
    for i, r in enumerate(rules):
        pattern = java_regex(r[0])
        texts = F.regexp_extract_all("line", F.lit(pattern), F.lit(0))
        gaps = F.split("line", pattern, -1)
        start = F.struct(F.lit(1).alias("at"), F.array().cast("array<int>").alias("all"))
        pairs = F.zip_with(texts, F.slice(gaps, F.lit(1), F.size(texts)), lambda m, g: F.struct(F.length(m).alias("m"), F.length(g).alias("g")))
        places = F.aggregate(pairs, start, lambda s, p: F.struct((s["at"] + p["g"] + p["m"]).alias("at"), F.array_append(s["all"], s["at"] + p["g"]).alias("all")), lambda s: s["all"])
        where = F.when(F.col("line").rlike(pattern), places)
        rule = F.lit(i).alias("rule_id")
        found.append(F.transform(F.coalesce(where, F.array().cast("array<int>")), tagged(rule)))
    return lines.select(*ids, (F.col("pos") + 1).alias("line_no"), F.explode(F.concat(*found)).alias("h")).select(*ids, "line_no", "h.*")


def scan_summary(scanned: DataFrame, ids: Sequence[str], manifest: DataFrame | None = None) -> DataFrame:
    """Counts of a content scan: part, item, n, malicious.

    Parts are band, type (of texts with a hit) and, if ``manifest`` (ids, status) is given, status of
    quarantine; a malicious text that the manifest lacks is ``pending_review``.
    """
    d = scanned.select(*ids, "band", "type", "malicious")
    parts = [F.struct(F.lit("band").alias("part"), F.col("band").alias("item")), F.struct(F.lit("type").alias("part"), F.col("type").alias("item"))]
    if manifest is not None:
        d = d.join(manifest.select(*ids, "status"), list(ids), "left")
        status = F.coalesce("status", F.when(F.col("malicious"), F.lit("pending_review")))
        parts.append(F.struct(F.lit("status").alias("part"), status.alias("item")))
    d = d.select("malicious", F.explode(F.array(*parts)).alias("p")).select("malicious", "p.*").filter(F.col("item").isNotNull())
    return d.groupBy("part", "item").agg(F.count("*").alias("n"), F.count_if("malicious").alias("malicious"))
