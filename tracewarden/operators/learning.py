"""Learning from the log: payload counts, token rules, weights, normal patterns, templates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewarden import rulesets
from tracewarden.functions.scores import first_of
from tracewarden.functions.text import required_pieces
from tracewarden.operators import timeline as tl



def payload_frequency(df: DataFrame, payload: str, t: str, kind: str) -> DataFrame:
    """Per payload: count, first and last time, and its most frequent type (the first by name on ties)."""
    by_kind = df.groupBy(F.md5(F.col(payload).cast("string")).alias("payload_id"), kind).agg(
        F.count("*").alias("n"), F.min(t).alias("a"), F.max(t).alias("b"))
    return by_kind.groupBy("payload_id").agg(
        F.sum("n").alias("seen"), F.min("a").alias("first_seen"), F.max("b").alias("last_seen"),
        F.min_by(kind, F.struct(-F.col("n"), F.col(kind))).alias("main_type"))


def type_trend(df: DataFrame, day: str, kind: str, kinds: Sequence[str], as_of: Column, days: int = 7) -> DataFrame:
    """Day by type counts of the trailing days."""
    d = df.filter((F.col(day) > F.date_sub(as_of, days)) & (F.col(day) <= as_of))
    return d.groupBy(day).pivot(kind, list(kinds)).count().na.fill(0)


# Call names too common to learn from.
COMMON_CALLS = ["if", "for", "while", "echo", "print", "array", "strlen", "count", "isset", "empty", "date", "time"]
# Call names that never become a signature for others.
NEVER_SHARED = COMMON_CALLS + ["substr", "trim", "explode", "implode", "sprintf", "printf"]
# The name of a call at the end of a text, and the shapes of the other learnable tokens.
CALL_NAME = r"(?i)(?<![A-Za-z0-9_])([a-z_]{3,20})\z"
TOKEN_SHAPES = {
    "verb": r"(?i)(?=[cdisu])(?<![A-Za-z0-9_])((?:union|select|insert|drop|delete|update|create)\s+\w+)",
    "path": r"(?i)(\.\.[/\\]|/etc/\w+|/var/\w+|/proc/\w+|[a-z]:\\\w+)", "tag": r"(?i)<(script|iframe|img|svg|object|embed)[^>]",
}


def tokens(text: Column) -> Column:
    """Distinct learnable tokens of a payload: calls, statement verbs, paths and tags."""
    def all_of(shape: str) -> Column:
        return F.transform(F.regexp_extract_all(text, F.lit(TOKEN_SHAPES[shape]), 1), lambda x: F.lower(x))

    common = F.array(*[F.lit("")] + [F.lit(c) for c in COMMON_CALLS])
    # a call ends at a parenthesis, so its name is looked for only in the end of what stands before one
    before = F.split(text, r"\(", -1)
    names = F.transform(F.slice(before, F.lit(1), F.size(before) - 1), lambda x: F.lower(F.regexp_extract(F.right(F.rtrim(x, F.lit(" \t\n\x0b\f\r")), F.lit(21)), CALL_NAME, 1)))
    calls = F.transform(F.filter(names, lambda c: ~F.array_contains(common, c)), lambda c: F.concat(c, F.lit("(")))
    tags = F.transform(all_of("tag"), lambda t: F.concat(F.lit("<"), t))
    some = F.array(*[F.contains(F.lower(text), F.lit(p)) for p in required_pieces(TOKEN_SHAPES["path"])])
    paths = F.when(F.array_contains(some, True), all_of("path")).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(calls, all_of("verb"), paths, tags))


def learn_rules(df: DataFrame, payload: str, kind: str, seen: int = 3, sources: int = 5) -> DataFrame:
    """Token rules from payloads seen at least ``seen`` times.

    A payload teaches from its ``seen``-th sighting on, so a token's hits are the sightings
    beyond ``seen - 1`` over its payloads. Severity is 60, from 10 hits on 60 + hits up to 80.
    The first ``sources`` source ids by value are kept with each rule.
    """
    # by digest and tokens: a long payload itself is not sent
    own = df.select(F.md5(payload).alias("id"), F.col(kind).alias("_kind"), tokens(F.col(payload)).alias("_tokens"))
    p = own.filter(F.size("_tokens") > 0).groupBy("id", "_kind").agg(F.count("*").alias("n"), F.any_value("_tokens").alias("_tokens")).groupBy("id").agg(
        F.sum("n").alias("n"), F.min_by("_kind", F.struct(-F.col("n"), F.col("_kind"))).alias("type"), F.any_value("_tokens").alias("_tokens")).filter(F.col("n") >= seen)
    t = p.select("id", "n", "type", F.explode("_tokens").alias("token"))
    w = Window.partitionBy("token", "type").orderBy("id")
    kept = t.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= sources).groupBy("token", "type").agg(
        F.array_sort(F.collect_list("id")).alias("sources"))
    g = t.groupBy("token", "type").agg(F.sum(F.col("n") - (seen - 1)).alias("hit_count"))
    sev = F.when(F.col("hit_count") >= 10, F.least(F.lit(80), 60 + F.col("hit_count"))).otherwise(60)
    return g.withColumn("severity", sev.cast("bigint")).join(kept, ["token", "type"])


def hot_signatures(rules: DataFrame, hits: int = 10, n: int = 50) -> DataFrame:
    """Top ``n`` learned tokens fit to be shared, weight severity/4 up to 15 and at least 5."""
    shared = rules.filter((F.col("hit_count") >= hits) & ~F.col("token").rlike("^(?:" + "|".join(NEVER_SHARED) + r")\("))
    w = F.floor(F.least(F.col("severity") / 4, F.lit(15.0))).cast("bigint")
    return shared.withColumn("weight", w).filter(F.col("weight") >= 5).orderBy(F.desc("hit_count"), "token", "type").limit(n) \
        .select("token", "type", "hit_count", "weight")


def adaptive_weights(df: DataFrame, kind: str, day: str, as_of: Column, base: dict[str, float], feedback: DataFrame | None = None,
                     days: int = 7, boost: float = 0.3) -> DataFrame:
    """Type weights raised by their share of recent attacks, then moved by feedback.

    ``feedback`` (type, adjustment) is one row per type; the moved weight stays in 0.5..2.
    """
    recent = df.filter((F.col(day) > F.date_sub(as_of, days)) & (F.col(day) <= as_of)).groupBy(F.col(kind).alias("type")).agg(F.count("*").alias("n"))
    known = recent.filter(F.col("type").isin(list(base)))
    # One row per attack type: the window holds a handful of rows.
    w = known.withColumn("top", F.max("n").over(Window.partitionBy(F.lit(1))))
    w = w.withColumn("weight", first_of([(F.col("type") == t, F.lit(float(b))) for t, b in base.items()], 1.0) + F.col("n") / F.col("top") * boost)
    if feedback is not None:
        w = w.join(feedback, "type", "left").withColumn("weight", F.when(
            F.col("adjustment").isNotNull(), F.greatest(F.lit(0.5), F.least(F.lit(2.0), F.col("weight") + F.col("adjustment")))).otherwise(F.col("weight")))
    return w.select("type", "n", "weight")


def feedback_adjustment(df: DataFrame, kind: str, t: str, tie: str, false_positive: str, step: float = 0.1, bound: float = 0.5,
                        fold: int = 4096, levels: int = 3) -> DataFrame:
    """Adjustment per type after all feedback, clamped at every step, in order of time.

    A stretch of clamped steps acts like x -> min(hi, max(lo, x + shift)), and two stretches
    in a row are one again. So stretches of ``fold`` rows are folded to (shift, lo, hi), then
    stretches of those, ``levels`` times: no task holds more than ``fold`` items of a type up
    to fold**(levels + 1) rows. Counted in whole steps, so the result is exact.
    """
    top = int(round(bound / step))
    d = tl.numbered(df, [kind], t, tie, "rn").select(
        kind, "rn", F.when(F.col(false_positive), -1).otherwise(1).alias("s"), F.lit(-top).alias("lo"), F.lit(top).alias("hi"))

    def clamp(x: Column, f: Column) -> Column:
        return F.least(f["hi"], F.greatest(f["lo"], x))

    def then(a: Column, f: Column) -> Column:
        # Shifts beyond the whole range all act alike.
        s = F.greatest(F.lit(-4 * top), F.least(F.lit(4 * top), a["s"] + f["s"]))
        return F.struct(s.alias("s"), clamp(a["lo"] + f["s"], f).alias("lo"), clamp(a["hi"] + f["s"], f).alias("hi"))

    same = F.struct(F.lit(0).alias("s"), F.lit(-4 * top).alias("lo"), F.lit(4 * top).alias("hi"))
    for level in range(levels + 1):
        group = [kind] if level == levels else [kind, F.floor((F.col("rn") - 1) / fold).alias("g")]
        g = d.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("rn", "s", "lo", "hi"))).alias("fs"))
        f = F.aggregate("fs", same, then)
        d = g.select(kind, (F.lit(1) if level == levels else F.col("g") + 1).alias("rn"), f["s"].alias("s"), f["lo"].alias("lo"), f["hi"].alias("hi"))
    value = F.least(F.col("hi"), F.greatest(F.col("lo"), F.col("s")))
    return d.select(kind, F.round(value * step, 6).alias("adjustment"))


def normal_paths(df: DataFrame, path: str, t: str, names: str) -> DataFrame:
    """Per path: count, first and last time, number of distinct parameter names."""
    base = df.groupBy(path).agg(F.count("*").alias("seen"), F.min(t).alias("first_seen"), F.max(t).alias("last_seen"))
    n = normal_names(df, path, names).groupBy(path).agg(F.count("*").alias("names"))
    return base.join(n, path, "left").na.fill(0, ["names"])


def normal_names(df: DataFrame, path: str, names: str) -> DataFrame:
    """Distinct (path, name): the parameter names known for a path, one row each."""
    return df.select(path, F.explode(names).alias("name")).select(path, F.lower("name").alias("name")).distinct()


def normal_deviation(df: DataFrame, ids: Sequence[str], path: str, names: str, paths: DataFrame, known: DataFrame, risk: str | None = None,
                     min_seen: int = 5) -> DataFrame:
    """How far a request is from the normal pattern of its path, 0..1.

    Unknown path 0.3, rarely seen path 0.2, else the share of unknown names; 0.3 times the
    client's risk is added. ``paths`` (path, seen) and ``known`` (path, name) are tables.
    """
    req = df.select(*ids, path, F.size(names).alias("_total"),
                    (F.coalesce(F.col(risk), F.lit(0.0)) if risk else F.lit(0.0)).alias("_risk"))
    per_name = df.select(*ids, path, F.explode(names).alias("name")).withColumn("name", F.lower("name"))
    unknown = per_name.join(known, [path, "name"], "left_anti").groupBy(*ids).agg(F.count("*").alias("_unknown"))
    d = req.join(paths.select(path, "seen"), path, "left").join(unknown, list(ids), "left")
    share = F.least(F.lit(1.0), F.coalesce(F.col("_unknown"), F.lit(0)) / F.greatest(F.col("_total"), F.lit(1)))
    base = first_of([(F.col("seen").isNull(), 0.3), (F.col("seen") < min_seen, 0.2)], share)
    return d.select(*ids, path, F.least(F.lit(1.0), base + F.col("_risk") * 0.3).alias("deviation"))


def client_event_risk(df: DataFrame, key: str, t: str, as_of: Column, freeze: int = 3) -> DataFrame:
    """Client risk from its file events: by count, halved after 7 days, none after 30."""
    day = tl.DAY
    g = df.groupBy(key).agg(F.count("*").alias("events"), F.max(t).alias("last"))
    age = (as_of - F.col("last")) / day
    base = first_of([(F.col("events") >= 10, 1.0), (F.col("events") >= 3, 0.6)], 0.3)
    risk = first_of([(age > 30, F.lit(0.0)), (age > 7, base * 0.5)], base)
    return g.select(key, "events", risk.alias("risk"), (F.col("events") >= freeze).alias("frozen"))


def parameter_safelist(df: DataFrame, name: str, safe: Column) -> DataFrame:
    """Per parameter name: safe and blocked sightings and the trust they give."""
    g = df.groupBy(F.lower(name).alias("name")).agg(F.count_if(safe).alias("safe"), F.count_if(~safe).alias("blocked"))
    clean = F.col("blocked") == 0
    return g.withColumn("confidence", first_of([(clean & (F.col("safe") >= 20), 1.0), (clean & (F.col("safe") >= 5), 0.7)], 0.0))


def learn_templates(df: DataFrame, method: str, template: str, names: str, score: str, feedback: DataFrame | None = None, below: int = 30,
                    least: int = 10, degrade: int = 3) -> DataFrame:
    """Templates (method, template, names) with their sample counts from harmless requests.

    ``names`` is the sorted array of parameter names. ``feedback`` (method, template, names,
    false_positives) lifts a template to ``least`` samples and degrades it at ``degrade``.
    """
    keys = [method, template, names]
    g = df.filter(F.col(score) < below).groupBy(*keys).agg(F.count("*").alias("samples"))
    if feedback is None:
        return g.withColumn("degraded", F.lit(False))
    d = g.join(feedback, keys, "full_outer")
    told = F.col("false_positives").isNotNull()
    n = F.coalesce(F.col("samples"), F.lit(0))
    return d.select(*keys, F.when(told, F.greatest(n, F.lit(least))).otherwise(n).cast("bigint").alias("samples"),
                    (F.coalesce(F.col("false_positives"), F.lit(0)) >= degrade).alias("degraded"))


def template_match(df: DataFrame, ids: Sequence[str], method: str, template: str, names: str, learned: DataFrame, least: int = 10, share: float = 0.8) -> DataFrame:
    """Requests that fit a learned template: same method and shape, most of its names present.

    Different name sets meet, not rows. A learned set of n names fits only if the request has one of
    its n - ceil(share * n) + 1 rarest names, so a learned set is filed under these and a hot shape
    with very many sets brings a request together with those alone that share a rare name.
    """
    shape = [method, template]
    plain = F.array_sort(F.array_distinct(F.filter(names, lambda x: x.isNotNull())))
    usable = learned.filter((F.col("samples") >= least) & ~F.col("degraded"))
    sets = usable.groupBy(*shape, plain.alias("_want"), F.greatest(F.size(names), F.lit(1)).alias("_size")).agg(F.max("samples").alias("samples"))
    asked = df.select(*shape, plain.alias("_got")).distinct()
    common = sets.select(*shape, F.explode("_want").alias("_x")).groupBy(*shape, "_x").agg(F.count("*").alias("_c"))
    ranked = sets.withColumn("_x", F.explode("_want")).join(common, [*shape, "_x"]).groupBy(*shape, "_want", "_size", "samples").agg(F.array_sort(F.collect_list(F.struct("_c", "_x"))).alias("_o"))
    # the fewest names that are enough, as the share is tested below
    need = F.greatest(F.lit(1), F.ceil(F.lit(share) * F.col("_size") - 1e-9).cast("int"))
    first = F.transform(F.slice("_o", F.lit(1), F.greatest(F.size("_want") - need + 1, F.lit(0))), lambda x: x["_x"])
    filed = ranked.select(*shape, "_want", "_size", "samples", F.explode(first).alias("_x"))
    met = asked.withColumn("_x", F.explode("_got")).join(filed, [*shape, "_x"])
    fits = F.size(F.array_intersect("_want", "_got")) / F.col("_size") >= share
    some = met.filter(fits).select(*shape, "_got", "samples")
    free = sets.filter(F.size("_want") == 0).filter(F.col("_size") == 1).groupBy(*shape).agg(F.max("samples").alias("samples"))
    best = some.unionByName(asked.join(free, shape)).groupBy(*shape, "_got").agg(F.max("samples").alias("samples"))
    return df.select(*ids, *shape, plain.alias("_got")).join(best, [*shape, "_got"]).groupBy(*ids).agg(F.max("samples").alias("samples"))


def keep_recent(df: DataFrame, key: str, t: str, as_of: Column, age: int) -> DataFrame:
    """Rows of the keys seen within ``age`` microseconds before ``as_of``."""
    live = df.groupBy(key).agg(F.max(t).alias("_last")).filter(F.col("_last") >= as_of - F.lit(age)).select(key)
    return df.join(live, key, "left_semi")


def keep_newest(df: DataFrame, t: str, tie: str, n: int) -> DataFrame:
    """The newest ``n`` rows of the whole table."""
    return df.orderBy(F.desc(t), F.desc(tie)).limit(n)
