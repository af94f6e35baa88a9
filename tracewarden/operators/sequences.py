"""Rate, replay, race, session and escalation operators over ordered events.

Times are microsecond longs in column ``t``; windows and limits are parameters. Windows
documented as open leave out rows exactly one window old, closed ones include them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewarden.functions.scores import first_of, points, whole
from tracewarden.operators import timeline as tl
from tracewarden.operators.timeline import SECOND



def _flag(c: Column) -> Column:
    return F.when(c, 1).otherwise(0)


def sliding_rate(df, keys, t, window=60 * SECOND, limit=120, piece=None) -> DataFrame:
    """Requests in the trailing open window and whether the row is over the limit.

    Attempts are counted, not admissions: a row is refused when at least ``limit`` earlier
    ones lie in the window. ``limit`` may be a column.
    """
    n = tl.sliding_sums(df, keys, t, {"in_window": (window, F.lit(1))}, piece=piece)
    return n.withColumn("refused", F.col("in_window") - 1 >= limit)


def path_limits(df, keys, t, rules: list[tuple[str, Column, int, int]], piece=None) -> DataFrame:
    """Limits per path rule; the first matching of (name, condition, limit, window) counts.

    Rows that match no rule are left out. The row itself counts.
    """
    matched = (
        df.withColumn("rule", first_of([(c, n) for n, c, _, _ in rules], None))
        .filter(F.col("rule").isNotNull())
        .withColumn("_limit", first_of([(F.col("rule") == n, lim) for n, _, lim, _ in rules], 0))
        .withColumn("_window", first_of([(F.col("rule") == n, F.lit(w).cast("bigint")) for n, _, _, w in rules], 0))
    )
    span = tl.Span(F.col(t), F.col(t) + F.col("_window"), F.lit(1))
    n = tl.span_sums(matched, ["rule", *keys], t, {"in_window": span}, max(w for *_, w in rules), piece)
    return n.withColumn("refused", F.col("in_window") > F.col("_limit")).drop("_limit", "_window")


def window_pattern(df, keys, t, advanced: Column, short=60 * SECOND, mid=600 * SECOND, long=3600 * SECOND,
                   burst=20, sustained=60, slow=(5, 5, 30)) -> DataFrame:
    """Burst, sustained, slow-burn or normal from three closed windows, with a score.

    ``slow``: at least so many in the long, at most so many in the short and middle window.
    """
    n = tl.sliding_sums(
        df, keys, t,
        {"n_short": (short, F.lit(1)), "n_mid": (mid, F.lit(1)), "n_long": (long, F.lit(1))}, closed=True,
    )
    s, m, g = F.col("n_short"), F.col("n_mid"), F.col("n_long")
    pattern = first_of(
        [(s > burst, "burst"), (m > sustained, "sustained"),
         ((g >= slow[0]) & (s <= slow[1]) & (m <= slow[2]), "slow_burn")],
        "normal",
    )
    p = F.col("pattern")
    n = n.withColumn("pattern", F.when(g < 2, "normal").otherwise(pattern))
    n = n.withColumn("stealth", (p == "slow_burn") & advanced)
    return n.withColumn(
        "anomaly",
        first_of(
            [(p == "burst", 25 + F.least(F.lit(15), whole((s - burst) / 4))),
             (p == "sustained", 15 + F.least(F.lit(10), whole((m - sustained) / 12))),
             (p == "slow_burn", 5 + F.when(F.col("stealth"), 15).otherwise(0))],
            0,
        ).cast("bigint"),
    )


def gap_statistics(df, keys, t, tie, history=200, min_rows=5, robot_sd=0.5, robot_cv=0.05) -> DataFrame:
    """Per key: mean, deviation and regularity of the gaps of its newest rows."""
    w = Window.partitionBy(*keys).orderBy("rn")
    gaps = tl.last_rows(df, keys, t, tie, history).withColumn("_gap", (F.col(t) - F.lag(t).over(w)) / SECOND)
    g = (
        gaps.groupBy(*keys)
        .agg(F.count("*").alias("n"), F.avg("_gap").alias("mean_gap"), F.stddev_pop("_gap").alias("sd_gap"))
        .filter(F.col("n") >= min_rows)
    )
    cv = F.when(F.col("mean_gap") > 0, F.col("sd_gap") / F.col("mean_gap"))
    return (
        g.withColumn("cv", cv)
        .withColumn("uniformity", F.coalesce(F.greatest(F.lit(0.0), 100 * (1 - cv)), F.lit(0.0)))
        .withColumn("score", points((F.col("sd_gap") < robot_sd, 25),
                                    (F.coalesce(cv < robot_cv, F.lit(False)), 20)).cast("bigint"))
    )


def burst_runs(df, keys, t, tie, gap: int = 100_000, need: int = 5) -> DataFrame:
    """Per key: longest run of consecutive gaps below ``gap`` microseconds, flag at ``need``."""
    prev = tl.with_previous(df, keys, t, tie, {"_prev_t": t})
    short = F.coalesce(F.col(t) - F.col("_prev_t") < F.lit(gap), F.lit(False))
    runs = tl.running(prev.withColumn("_short", short), keys, t, tie,
                      {"_run": ("sum", F.when(F.col("_short"), 0).otherwise(1).cast("bigint"))})
    return (
        runs.groupBy(*keys, "_run").agg(F.sum(_flag(F.col("_short"))).alias("_n"))
        .groupBy(*keys).agg(F.max("_n").alias("longest_run"))
        .withColumn("burst", F.col("longest_run") >= need)
    )


def pace_pattern(df, keys, t, tie, history=100, unit=SECOND) -> DataFrame:
    """Per key: burst, sustained or stealth by row count and mean gap of its newest rows."""
    w = Window.partitionBy(*keys).orderBy("rn")
    g = (
        tl.last_rows(df, keys, t, tie, history)
        .withColumn("_gap", F.col(t) - F.lag(t).over(w))
        .groupBy(*keys)
        .agg(F.count("*").alias("n"), (F.max(t) - F.min(t)).alias("_span"),
             F.sum(_flag(F.col("_gap") <= unit)).alias("_short"))
    )
    n, avg = F.col("n"), F.col("avg_gap")
    g = g.withColumn("avg_gap", F.when(n > 1, F.col("_span") / unit / (n - 1)).otherwise(F.lit(0.0)))
    bands = [
        ((n >= 20) & (avg <= 2), "burst", 15), ((n >= 10) & (avg <= 5), "burst", 10),
        ((n >= 50) & (avg <= 30), "sustained", 8), ((n >= 20) & (avg <= 60), "sustained", 5),
        ((n >= 5) & (n <= 15) & (avg >= 30) & (avg <= 300), "stealth", 3),
    ]
    known = n >= 2
    need = F.greatest(F.lit(3), whole(n * 0.3))
    return (
        g.withColumn("pattern", F.when(known, first_of([(c, p) for c, p, _ in bands], "normal")).otherwise("normal"))
        .withColumn("anomaly", F.when(known, first_of([(c, s) for c, _, s in bands], 0)).otherwise(0).cast("bigint"))
        .withColumn("burst_count", F.when(F.col("_short") >= need, F.col("_short")).otherwise(0).cast("bigint"))
        .drop("_span", "_short")
    )


def replay(df, keys, t, signature, short=60 * SECOND, long=300 * SECOND, times=3, share=0.5) -> DataFrame:
    """Repeats of the same signature by one key, the row included, closed windows."""
    own = tl.sliding_sums(df, [*keys, signature], t,
                          {"same_short": (short, F.lit(1)), "same_long": (long, F.lit(1))}, closed=True)
    both = tl.sliding_sums(own, keys, t, {"all_long": (long, F.lit(1))}, closed=True)
    score = points((F.col("same_short") >= times, 25), (F.col("same_long") / F.col("all_long") > share, 20))
    return both.withColumn("score", score.cast("bigint")).withColumn("is_replay", F.col("score") >= 25)


def duplicate_submissions(df, keys, t, path, params, changing: Column, sensitive: Column,
                          window=SECOND, burst=SECOND // 10, sensitive_window=5 * SECOND,
                          per_window=5, per_burst=3, changing_limit=3) -> DataFrame:
    """Near-simultaneous repeats: only earlier rows of the key count, closed windows."""
    d = df.withColumn("_chg", _flag(changing)).withColumn("_sen", _flag(sensitive))
    d = tl.sliding_sums(d, [*keys, path], t,
                        {"_u1": (window, F.lit(1)), "_ub": (burst, F.lit(1)), "_uc": (window, F.col("_chg"))}, closed=True)
    d = tl.sliding_sums(d, [*keys, path, params], t,
                        {"_p1": (window, F.lit(1)), "_pc": (window, F.col("_chg")),
                         "_ps": (sensitive_window, F.col("_sen"))}, closed=True)
    d = tl.sliding_sums(d, keys, t, {"_s": (sensitive_window, F.col("_sen"))}, closed=True)
    d = d.select(
        *df.columns, "_chg", "_sen",
        (F.col("_u1") - 1).alias("same_url"), (F.col("_ub") - 1).alias("same_url_burst"),
        (F.col("_p1") - 1).alias("same_params"),
        (F.col("_uc") - F.col("_chg")).alias("changing_before"), (F.col("_pc") - F.col("_chg")).alias("changing_same"),
        (F.col("_s") - F.col("_sen")).alias("sensitive_before"), (F.col("_ps") - F.col("_sen")).alias("sensitive_same"),
    )

    def best(*rules):
        return F.greatest(F.lit(0), *[F.when(c, n).otherwise(0) for c, n in rules])

    c = F.col
    rate = best((c("same_url") >= per_window, 65), (c("same_url_burst") >= per_burst, 75),
                (c("same_params") >= per_window, 80), (c("same_url") >= 10, 90))
    chg = F.when(c("_chg") == 1, best((c("changing_before") >= changing_limit, 70), (c("changing_same") >= 2, 85))).otherwise(0)
    sen = F.when(c("_sen") == 1, best((c("sensitive_before") >= 3, 60), (c("sensitive_same") >= 2, 85),
                                      (c("sensitive_same") >= 5, 95))).otherwise(0)
    return d.withColumn("score", F.greatest(rate, chg, sen).cast("bigint")).drop("_chg", "_sen")


def running_distinct(df, keys, t, tie, value, out) -> DataFrame:
    """Distinct values of the key up to and including the row."""
    seen = tl.numbered(df, [*keys, value], t, tie, "_seen")
    fresh = _flag((F.col("_seen") == 1) & F.col(value).isNotNull()).cast("bigint")
    return tl.running(seen, keys, t, tie, {out: ("sum", fresh)}).drop("_seen")


def session_anomaly(df, session, t, tie, agent, client, sensitive_start: Column, fresh=60 * SECOND) -> DataFrame:
    """Agents and clients seen so far in the session, and a sensitive first URI."""
    d = running_distinct(df, [session], t, tie, agent, "agents")
    d = running_distinct(d, [session], t, tie, client, "clients")
    first = F.struct(F.col(t).alias("t"), F.col(tie).alias("tie"), sensitive_start.alias("hot"))
    d = tl.running(d, [session], t, tie, {"_first": ("min", first)})
    hot = F.col("_first.hot") & (F.col(t) - F.col("_first.t") <= fresh)
    score = points((F.col("agents") > 2, 20), (F.col("clients") > 3, 25), (hot, 30))
    return d.withColumn("score", score.cast("bigint")).drop("_first")


def text_similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length, in characters; 1 for equal, 0 if one is empty."""
    longest = F.greatest(F.length(a), F.length(b))
    return first_of(
        [(a == b, F.lit(1.0)), ((F.length(a) == 0) | (F.length(b) == 0), F.lit(0.0))],
        1 - F.levenshtein(a, b) / longest,
    )


def session_drift(df, session, t, tie, agent, language, subnet, address, piece=tl.DAY,
                  agent_weight=30, language_weight=15, subnet_weight=35) -> DataFrame:
    """How far the row's agent, language and network are from the session's first row."""
    first = F.struct(*[F.col(c).alias(n) for c, n in
                       ((t, "t"), (tie, "tie"), (agent, "agent"), (language, "language"), (subnet, "subnet"), (address, "address"))])
    d = tl.running(df, [session], t, tie, {"_first": ("min", first)}, piece)
    sim = text_similarity(F.col(agent), F.col("_first.agent"))
    d = d.withColumn("similarity", sim)
    s = F.col("similarity")
    agent_score = first_of(
        [(s < 0.3, agent_weight), (s < 0.6, int(agent_weight * 0.7)), (s < 0.9, int(agent_weight * 0.3))], 0)

    def primary(c):
        return F.lower(F.trim(F.regexp_extract(F.trim(c), r"^([^,;\-]*)", 1)))

    lang, first_lang = F.col(language), F.col("_first.language")
    lang_score = first_of(
        [(lang == first_lang, 0), (primary(lang) != primary(first_lang), language_weight)], int(language_weight * 0.4))
    net_score = first_of(
        [(F.col(subnet) != F.col("_first.subnet"), subnet_weight),
         (F.col(address) != F.col("_first.address"), int(subnet_weight * 0.2))], 0)
    total = F.least(F.lit(100), agent_score + lang_score + net_score)
    return d.withColumn("score", total.cast("bigint")).withColumn("drifted", F.col("score") >= 50).drop("_first")


def ban_escalation(df, keys, t, tie, steps=(86_400, 604_800, 2_592_000), base=86_400, cap=10) -> DataFrame:
    """Duration in seconds of the nth ban (0 = for ever) and the multiplied variant."""
    n = tl.numbered(df, keys, t, tie, "offence")
    stepwise = first_of([(F.col("offence") == i + 1, F.lit(s).cast("bigint")) for i, s in enumerate(steps)],
                        F.lit(0).cast("bigint"))
    return n.withColumn("ban_s", stepwise).withColumn("ban_multiplied_s", F.least(F.lit(cap), F.col("offence")) * base)


def attempts(df, keys, t, tie, gap=900 * SECOND) -> DataFrame:
    """Attempt number; every attempt moves the expiry, so a pause above ``gap`` resets it."""
    s = tl.sessions(df, keys, t, tie, gap - 1, "_session")
    return tl.numbered(s, [*keys, "_session"], t, tie, "attempt").drop("_session")


def crawl_behaviour(df, keys, t, path, agent, depth, api: Column, static: Column, window=300 * SECOND) -> DataFrame:
    """Path variety, depth, API-only share and agent rotation in the closed trailing window.

    The window is kept whole; there is no cap on its rows.
    """
    d = df.withColumn("_api", _flag(api & ~static)).withColumn("_static", _flag(static))
    d = tl.sliding_sums(
        d, keys, t,
        {"n": (window, F.lit(1)), "_depth": (window, F.col(depth)), "_deep": (window, _flag(F.col(depth) >= 4)),
         "_na": (window, F.col("_api")), "_ns": (window, F.col("_static"))}, closed=True)
    d = tl.sliding_distinct(d, keys, t, path, window, "paths", closed=True)
    d = tl.sliding_distinct(d, keys, t, agent, window, "agents", closed=True)
    n = F.col("n")
    share = F.col("_na") / F.nullif(F.col("_na") + F.col("_ns"), F.lit(0))
    mean_depth, deep = F.col("_depth") / n, F.col("_deep") / n
    depth_score = first_of([(mean_depth >= 6, 100), (mean_depth >= 4, 70), (mean_depth >= 3, 40)], 0)
    return (
        d.withColumn("path_variety", F.when(n < 3, F.lit(0.0)).otherwise(
            F.col("paths") / n * 100 * F.least(F.lit(1.0), n / 20)))
        .withColumn("api_bias", F.when((n >= 5) & (share >= 0.9), share * 100).otherwise(F.lit(0.0)))
        .withColumn("agent_rotation", F.when(n < 5, 0).otherwise(
            first_of([(F.col("agents") >= 5, 100), (F.col("agents") >= 3, 70), (F.col("agents") >= 2, 30)], 0)).cast("bigint"))
        .withColumn("crawl_depth", F.when(n < 5, 0).otherwise(
            F.least(F.lit(100), depth_score + F.when(deep >= 0.5, 20).otherwise(0))).cast("bigint"))
        .drop("_api", "_static", "_depth", "_deep", "_na", "_ns")
    )


def ordered_visit(df, keys, t, tie, classes: list[tuple[str, Column]], history=200) -> DataFrame:
    """Per key: whether the first visits of the given classes come in the given order."""
    d = tl.last_rows(df, keys, t, tie, history)
    firsts = d.groupBy(*keys).agg(*[F.min(F.when(c, F.col("rn"))).alias(f"first_{n}") for n, c in classes])
    names = [f"first_{n}" for n, _ in classes]
    in_order = F.lit(True)
    for a, b in zip(names, names[1:]):
        in_order = in_order & (F.col(a) < F.col(b))
    return firsts.withColumn("in_order", F.coalesce(in_order, F.lit(False)))


def api_abuse(df, keys, t, endpoint, known_total: int, known: Column, sensitive: Column,
              window=300 * SECOND, many=20, coverage=0.5) -> DataFrame:
    """Distinct, known and sensitive endpoints of the key in the closed trailing window."""
    d = df.withColumn("_known", F.when(known, F.col(endpoint))).withColumn("_hot", F.when(sensitive, F.col(endpoint)))
    for value, out in ((endpoint, "endpoints"), ("_known", "known"), ("_hot", "sensitive")):
        d = tl.sliding_distinct(d, keys, t, value, window, out, closed=True)
    return d.withColumn("coverage", F.col("known") / known_total).withColumn(
        "score",
        points((F.col("endpoints") > many, 30), (F.col("coverage") > coverage, 25), (F.col("sensitive") >= 2, 20)).cast("bigint"),
    ).drop("_known", "_hot")
