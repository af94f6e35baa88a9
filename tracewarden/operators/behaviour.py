"""Client behaviour: trailing baselines, deviations, drift, profiles, cohorts, outliers."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewarden.functions.scores import first_of, labels, points, whole
from tracewarden.operators import timeline as tl
from tracewarden.operators.chains import histories, phase_index
from tracewarden.operators.timeline import SECOND
from tracewarden.session import new_path
from tracewarden.tables import REQUEST_PHASES



def trailing_baseline(df, keys, t, tie, means: Sequence[str], sets: Sequence[str] = (), n=10, piece=tl.DAY) -> DataFrame:
    """Weighted means of the ``n`` rows before each row, newer ones weighing more (0.5 to 1).

    Adds ``base_n``, ``base_<col>`` per mean, ``base_gap`` (mean gap in microseconds) and
    ``seen_<col>`` (values) per set column.
    """
    laid = tl.with_context(df, keys, t, tie, n, [*means, *sets], piece)
    w = tl.piece_window(keys, t, tie).rowsBetween(-n, -1)
    cols = list(dict.fromkeys([*means, *sets]))
    d = tl.home_rows(laid.withColumn("_h", F.collect_list(F.struct(F.col(t).alias("_t"), *cols)).over(w)))
    m = F.size("_h")
    total = m * 0.5 + (m + 1) * 0.25

    def mean(c: str) -> Column:
        parts = F.transform("_h", lambda r, i: r[c] * (0.5 + 0.5 * (i + 1) / m))
        return F.when(m > 0, F.aggregate(parts, F.lit(0.0), lambda a, x: a + x) / total)

    gap = F.when(m > 1, (F.element_at("_h", -1)["_t"] - F.element_at("_h", 1)["_t"]) / (m - 1)).otherwise(0.0)
    return d.select("*", m.cast("bigint").alias("base_n"), *[mean(c).alias(f"base_{c}") for c in means],
                    gap.alias("base_gap"), *[F.col(f"_h.{c}").alias(f"seen_{c}") for c in sets]).drop("_h")


def deviations(df, keys, t, tie, uri, param, hour, param_count, complexity, risk, indicators,
               window=60 * SECOND, min_rows=5, n=10, busy=(5, 10)) -> DataFrame:
    """Labels and points for how a row departs from its key's trailing baseline.

    ``param`` is the row's array of names. ``busy``: rows in the window from which a rate
    counts as a burst with and without a known gap.
    """
    d = tl.sliding_sums(df, keys, t, {"recent": (window, F.lit(1))}, closed=True)
    d = trailing_baseline(d, keys, t, tie, [param_count, complexity, risk, indicators], [uri, param, hour], n)
    c = F.col
    new_uri = ~F.array_contains(f"seen_{uri}", c(uri))
    new_param = F.size(F.array_except(param, F.flatten(c(f"seen_{param}")))) > 0
    count_jump = F.abs(c(param_count) - c(f"base_{param_count}")) > F.greatest(F.lit(2.0), c(f"base_{param_count}"))
    ratio = c("recent") / (F.lit(float(window)) / F.nullif(c("base_gap"), F.lit(0.0)))
    has_gap = c("base_gap") > 0
    burst = first_of([(has_gap & (ratio >= 10) & (c("recent") >= busy[0]), 20), (has_gap & (ratio >= 3) & (c("recent") >= busy[0]), 15),
                      (~has_gap & (c("recent") >= busy[1]), 15)], 0)
    off_hours = (c("base_n") >= 5) & ~F.array_contains(f"seen_{hour}", c(hour))
    bc, br = c(f"base_{complexity}"), c(f"base_{risk}")
    cx = first_of([((bc > 0) & (c(complexity) >= bc * 3) & (c(complexity) >= 30), 15),
                   ((bc > 0) & (c(complexity) >= bc * 2) & (c(complexity) >= 25), 12)], 0)
    rs = first_of([((c(risk) >= 50) & (br <= 15), 20), ((c(risk) >= 30) & (br <= 10), 15)], 0)
    ind = (c(indicators) >= 3) & (c(f"base_{indicators}") <= 1)
    par = first_of([(new_param, 12), (count_jump, 10)], 0)
    score = points((new_uri, 12), (off_hours, 10), (ind, 12)) + par + burst + cx + rs
    d = d.filter(c("base_n") >= min_rows).withColumn("deviations", labels(
        (new_uri, "new_uri"), (par > 0, "param_set_change"), (burst > 0, "freq_burst"), (off_hours, "off_hours"),
        (cx > 0, "complexity_spike"), (rs > 0, "risk_score_spike"), (ind, "indicators_burst")))
    d = d.withColumn("dimensions", F.size("deviations").cast("bigint")).withColumn("raw_score", F.least(F.lit(100), score).cast("bigint"))
    bonus = first_of([(c("dimensions") >= 4, 15), (c("dimensions") == 3, 10), (c("dimensions") == 2, 5)], 0)
    return d.withColumn("score", c("raw_score") + bonus).drop(f"seen_{uri}", f"seen_{param}", f"seen_{hour}")


def entropy_of(values: Column) -> Column:
    """Shannon entropy in bits of the value frequencies of an array."""
    total = F.size(values)

    def part(acc, v):
        p = F.size(F.filter(values, lambda x: x == v)) / total
        return acc - p * F.log2(p)

    return F.aggregate(F.array_distinct(values), F.lit(0.0), part)


def _slope(ys: Column) -> Column:
    """Least-squares slope over positions 0, 1, 2, ..; 0 for fewer than two values."""
    n = F.size(ys)
    sx = n * (n - 1) / 2
    sxx = (n - 1) * n * (2 * n - 1) / 6
    sy = F.aggregate(ys, F.lit(0.0), lambda a, y: a + y)
    sxy = F.aggregate(F.transform(ys, lambda y, i: y * i), F.lit(0.0), lambda a, y: a + y)
    return F.when(n >= 2, (n * sxy - sx * sy) / (n * sxx - sx * sx)).otherwise(0.0)


def _mean(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x) / F.size(xs)


def _tail(xs: Column, n: int) -> Column:
    return F.slice(xs, F.greatest(F.size(xs) - n + 1, F.lit(1)), n)


def drift(df, keys, t, tie, uri, risk, phase, history=100, min_rows=5, order=REQUEST_PHASES) -> DataFrame:
    """Slow changes within each key's newest rows: variety, risk trend, phases, entropy."""
    h = histories(df, keys, t, tie, [uri, risk, phase], history)
    n = F.size("h")
    half = whole(n / 2).cast("int")
    uris, risks = F.col(f"h.{uri}"), F.col(f"h.{risk}")
    d = h.select(
        *keys, n.cast("bigint").alias("n"), half.alias("half"),
        F.size(F.array_distinct(F.slice(uris, 1, half))).alias("u1"),
        F.size(F.array_distinct(F.slice(uris, half + 1, n))).alias("u2"),
        _tail(risks, 5).alias("r5"), _tail(F.transform(F.col(f"h.{phase}"), lambda p: F.coalesce(phase_index(p, order), F.lit(0))), 6).alias("p6"),
        _tail(uris, 10).alias("u10"))
    c = F.col
    cut = whole(F.size("p6") / 2).cast("int")
    p_first, p_last = _mean(F.slice("p6", 1, cut)), _mean(F.slice("p6", cut + 1, F.size("p6")))
    rising = (c("half") >= 3) & (c("u2") / (c("n") - c("half")) > c("u1") / c("half") * 2) & (c("u2") >= 4)
    risk_up = (F.size("r5") >= 4) & (c("slope") > 0.5) & (F.element_at("r5", -1) > F.element_at("r5", 1) + 15)
    phase_up = (F.size("p6") >= 4) & (c("p_last") > c("p_first")) & (c("p_last") >= 2)
    spike = (c("entropy") > 2.5) & (F.size(F.array_distinct("u10")) >= 6)
    d = d.filter(c("n") >= min_rows).withColumn("slope", _slope(c("r5"))).withColumn("p_first", p_first) \
        .withColumn("p_last", p_last).withColumn("entropy", entropy_of(c("u10")))
    return d.select(
        *keys, "n", "slope", "entropy",
        labels((rising, "uri_diversity_rising"), (risk_up, "risk_rising"), (phase_up, "phase_escalation"),
               (spike, "behavior_entropy_spike")).alias("drifts"),
        F.least(F.lit(25), points((rising, 15), (risk_up, 15), (phase_up, 15), (spike, 10))).cast("bigint").alias("score"))


RISK_STEPS = [(70, 3), (50, 2), (25, 1)]


def half_change(df, keys, t, tie, pattern, risk, phase, recent=10, min_rows=5, order=REQUEST_PHASES) -> DataFrame:
    """Second half of each key's newest rows against the first: patterns, risk class, phase."""
    h = histories(df, keys, t, tie, [pattern, risk, phase], recent)
    n = F.size("h")
    half = whole(n / 2).cast("int")
    first, second = F.slice("h", 1, half), F.slice("h", half + 1, n)

    def step(x):
        return first_of([(x >= lo, v) for lo, v in RISK_STEPS], 0)

    def level(xs, f):
        return _mean(F.transform(xs, f))

    p1, p2 = F.array_distinct(F.transform(first, lambda r: r[pattern])), F.array_distinct(F.transform(second, lambda r: r[pattern]))
    fresh = F.size(F.array_except(p2, p1)) / F.size(p2)

    def idx(r):
        return F.coalesce(phase_index(r[phase], order), F.lit(0))

    d = h.filter((n >= min_rows) & (half >= 2)).select(
        *keys, n.cast("bigint").alias("n"), fresh.alias("new_share"),
        (level(second, lambda r: step(r[risk])) - level(first, lambda r: step(r[risk]))).alias("risk_rise"),
        (level(second, idx) - level(first, idx)).alias("phase_rise"))
    conds = [F.col("new_share") > 0.5, F.col("risk_rise") > 1, F.col("phase_rise") > 1]
    return d.withColumn("change_score", points(*[(x, 10) for x in conds]).cast("bigint")) \
        .withColumn("pattern_changed", points(*[(x, 1) for x in conds]) >= 2)


def decayed_sum(df, keys, t, score, recorded: Column, window=1800 * SECOND, half_life=600 * SECOND, discount=0.15) -> DataFrame:
    """Discounted sum of the key's earlier recorded scores, halving every ``half_life``.

    The decay is split into a factor at the recorded row and one at the row that looks
    back, both relative to the piece's start, so a running total does it and no factor
    exceeds 2^(window / half_life) or so.
    """
    length = max(tl.HOUR, window + 1)
    value = F.when(recorded, F.col(score) * discount).otherwise(0.0)
    mark = F.when(recorded, 1.0).otherwise(0.0)

    def weighted(start: Column) -> Column:
        return value * F.pow(F.lit(2.0), (F.col(t) - start) / half_life)

    end = F.col(t) + F.lit(window + 1)
    own_start = tl.piece_of(F.col(t), length) * F.lit(length)
    d = tl.span_sums(df, keys, t, {"_acc": tl.Span(F.col(t), end, weighted, "w"), "_cnt": tl.Span(F.col(t), end, mark, "w")},
                     window + 1, tl.HOUR, dtype="double")
    d = d.withColumn("accumulated", F.col("_acc") * F.pow(F.lit(2.0), (own_start - F.col(t)) / half_life) - value) \
        .withColumn("prior", F.round(F.col("_cnt") - mark).cast("bigint"))
    bonus = first_of([(F.col("prior") >= 5, 10), (F.col("prior") >= 3, 5)], 0)
    return d.withColumn("score", F.least(F.lit(20), F.round("accumulated").cast("bigint") + bonus).cast("bigint")).drop("_acc", "_cnt")


def client_profile(df, keys, uri, risk, phase) -> DataFrame:
    """Totals, variety, high-risk and reconnaissance rows per key."""
    return df.groupBy(*keys).agg(
        F.count("*").alias("total"), F.count_distinct(uri).alias("paths"),
        F.count_if(F.col(risk) >= 40).alias("high_risk"), F.count_if(F.col(phase).isin("recon", "probe")).alias("recon"),
        F.bool_and(F.col(risk) <= 5).alias("all_clean"))


def actor_types(df, keys, t, tie, uri, risk, phase, window=60 * SECOND, heavy=20, busy=10, calm=8) -> DataFrame:
    """Scanner, manual attacker, crawler or normal, from the profile and the newest row's rate."""
    rate = tl.sliding_sums(df.select(*keys, t, tie), keys, t, {"recent": (window, F.lit(1))}, closed=True) \
        .groupBy(*keys).agg(F.max_by("recent", F.struct(t, tie)).alias("recent"))
    p = client_profile(df, keys, uri, risk, phase).join(rate, list(keys))
    c = F.col
    kind = first_of([
        (c("total") < 3, "unknown"), (c("recent") >= heavy, "scanner"),
        ((c("recent") >= busy) & (c("paths") / c("total") >= 0.5) & (c("paths") >= 4), "scanner"),
        ((c("recon") >= 2) & (c("high_risk") >= 1) & (c("recent") <= calm), "manual_attacker"),
        ((c("high_risk") >= 2) & (c("recon") >= 1), "manual_attacker"),
        ((c("recent") >= calm) & c("all_clean") & (c("paths") >= 4), "crawler")], "normal")
    return p.withColumn("actor", kind)


def attacker_profile(df, keys, t, payload, attack_type, unit=SECOND) -> DataFrame:
    """Scanner, script kiddie, advanced or persistent attacker from gap and variety."""
    g = df.groupBy(*keys).agg(
        F.count("*").alias("n"), ((F.max(t) - F.min(t)) / unit).alias("_span"),
        F.count_distinct(F.md5(F.col(payload).cast("string"))).alias("payloads"), F.count_distinct(attack_type).alias("patterns"))
    c = F.col
    gap = F.when(c("n") >= 2, c("_span") / (c("n") - 1)).otherwise(0.0)
    return g.withColumn("mean_gap", gap).drop("_span").withColumn("profile", first_of([
        ((c("mean_gap") < 2) & (c("n") >= 10) & (c("payloads") < 5), "automated_scanner"),
        (c("mean_gap").between(2, 30) & (c("payloads") < 10) & (c("patterns") <= 2), "script_kiddie"),
        ((c("mean_gap") > 30) & (c("n") >= 5) & (c("payloads") >= 10) & (c("patterns") >= 3), "advanced_attacker"),
        ((c("n") > 0) & (c("mean_gap") > 300), "persistent")], "script_kiddie"))


def exact_quantile(df: DataFrame, col: str, q: float, bins: int = 1024) -> float | None:
    """Linearly interpolated quantile, exact, by histograms that follow one another.

    Each counts the values between two ends in ``bins`` bins; the next one takes the bin that holds
    the wanted place, from its least to its greatest value, until these are equal. The driver sees
    one row a bin; no row is ordered, and a table of any size goes the same way. ``df`` is read a few
    times, so it should be a table.
    """
    v = df.select(F.col(col).cast("double").alias("v")).filter(F.col("v").isNotNull() & ~F.isnan("v"))
    n, lo, hi = v.agg(F.count("*"), F.min("v"), F.max("v")).first()
    if not n:
        return None
    rank = (n - 1) * q
    found: dict[int, float] = {}
    for place in sorted({math.floor(rank), math.ceil(rank)}):
        a, b, below = lo, hi, 0
        while a < b:
            width = b / 2 - a / 2  # halves, since the whole width may leave the range of a double
            at = F.when(F.col("v") > a, 1).otherwise(0) if width == 0 else F.least(F.floor((F.col("v") / 2 - a / 2) / width * bins), F.lit(bins - 1))
            rows = v.filter(F.col("v").between(a, b)).groupBy(at.alias("k")).agg(F.count("*").alias("c"), F.min("v").alias("a"), F.max("v").alias("b"))
            for r in sorted(rows.collect(), key=lambda r: r["k"]):
                if below + r["c"] > place:
                    a, b = r["a"], r["b"]
                    break
                below += r["c"]
        found[place] = a
    low, high = found[math.floor(rank)], found[math.ceil(rank)]
    return low + (rank - math.floor(rank)) * (high - low)


def population_outliers(df, keys, risk, params, size, q=0.95, min_clients=5) -> DataFrame:
    """Keys above the quantile in mean risk or row count, or two deviations off in the rest."""
    spark, path = df.sparkSession, new_path(df.sparkSession, "clients")
    df.groupBy(*keys).agg(F.avg(risk).alias("avg_risk"), F.avg(params).alias("avg_params"), F.avg(size).alias("avg_size"),
                          F.count("*").alias("n")).write.parquet(path)
    g = spark.read.parquet(path)
    s = g.agg(F.count("*").alias("clients"), F.avg("avg_params").alias("mp"), F.stddev_pop("avg_params").alias("sp"),
              F.avg("avg_size").alias("ms"), F.stddev_pop("avg_size").alias("ss"))
    d = g.withColumn("risk_q", F.lit(exact_quantile(g, "avg_risk", q)).cast("double")).withColumn("n_q", F.lit(exact_quantile(g, "n", q)).cast("double"))
    for c, value in s.first().asDict().items():
        d = d.withColumn(c, F.lit(value))
    c = F.col
    r1, r2 = (c("risk_q") > 0) & (c("avg_risk") > c("risk_q")), (c("n_q") > 0) & (c("n") > c("n_q"))
    r3 = (c("sp") > 0) & (F.abs(c("avg_params") - c("mp")) > 2 * c("sp"))
    r4 = (c("ss") > 0) & (F.abs(c("avg_size") - c("ms")) > 2 * c("ss"))
    dev = F.when(r1, c("avg_risk") - c("risk_q")).otherwise(0.0) + F.when(r2, (c("n") - c("n_q")) * 5).otherwise(0.0) \
        + F.when(r3, F.abs(c("avg_params") - c("mp")) * 10).otherwise(0.0) + F.when(r4, F.abs(c("avg_size") - c("ms")) / 100).otherwise(0.0)
    return d.filter((c("clients") >= min_clients) & (r1 | r2 | r3 | r4)).select(
        *keys, "n", dev.alias("deviation"),
        labels((r1, "risk_score"), (r2, "request_count"), (r3, "param_count"), (r4, "payload_size")).alias("dimensions"))


def multi_baseline(df, keys, t, tie, uri, params, size, risk, hour, agent, history=100) -> DataFrame:
    """Per key, from its newest rows: concentration, spread, hours, risk trend, agents."""
    g = tl.last_rows(df, keys, t, tie, history).groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg(params).alias("params_mean"), F.stddev_pop(params).alias("params_sd"),
        F.avg(size).alias("size_mean"), F.stddev_pop(size).alias("size_sd"),
        F.array_sort(F.collect_set(hour)).alias("hours"), F.regr_slope(F.col(risk), F.col("rn")).alias("risk_slope"),
        F.size(F.collect_set(agent)).cast("bigint").alias("agents"), F.collect_list(uri).alias("_u"))
    top = F.array_max(F.transform(F.array_distinct("_u"), lambda u: F.size(F.filter("_u", lambda x: x == u))))
    return g.withColumn("concentration", top / F.col("n")).withColumn("risk_slope", F.coalesce("risk_slope", F.lit(0.0))).drop("_u")


def vector_distance(df, key, order, vector, limit=0.5) -> DataFrame:
    """Distance of each key's newest vector to the mean of its earlier ones."""
    long = df.select(key, order, F.posexplode(vector).alias("dim", "x")).withColumn("x", F.col("x").cast("double"))
    d = long.groupBy(key, "dim").agg(F.sum("x").alias("s"), F.count("*").alias("n"), F.max_by("x", order).alias("x"))
    diff = F.col("x") - (F.col("s") - F.col("x")) / (F.col("n") - 1)
    return d.filter(F.col("n") >= 2).groupBy(key).agg(F.sqrt(F.sum(diff * diff)).alias("distance")) \
        .withColumn("flagged", F.col("distance") > limit)


def cohort_comparison(df, key, segment, risk, sds=1.5, least=25.0, peers=3) -> DataFrame:
    """Keys whose mean risk lies well above that of the other keys of their segment."""
    g = df.groupBy(segment, key).agg(F.avg(risk).alias("m"))
    s = g.groupBy(segment).agg(F.count("*").alias("c"), F.sum("m").alias("s1"), F.sum(F.col("m") * F.col("m")).alias("s2"))
    d = g.join(s, segment)
    n = F.col("c") - 1
    mean = (F.col("s1") - F.col("m")) / F.nullif(n, F.lit(0))
    var = (F.col("s2") - F.col("m") * F.col("m")) / F.nullif(n, F.lit(0)) - mean * mean
    d = d.filter(F.col("c") - 1 >= peers).select(segment, key, F.col("m").alias("mean_risk"), mean.alias("peer_mean"),
                                                 F.sqrt(F.greatest(var, F.lit(0.0))).alias("peer_sd"))
    above = F.col("mean_risk") - F.col("peer_mean")
    return d.withColumn("deviates", (F.col("peer_sd") > 0) & (above > sds * F.col("peer_sd")) & (above >= least))
