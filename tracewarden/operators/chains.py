"""Phase sequences, transitions, chain templates and next-step predictions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewarden.functions.scores import chain_risk_band, first_of, points, whole
from tracewarden.operators import timeline as tl
from tracewarden.operators.timeline import SECOND
from tracewarden.tables import CHAIN_PHASES, CHAIN_TEMPLATES, DEEP_PHASES, REQUEST_PHASES


def phase_index(phase: Column, order: Sequence[str] = CHAIN_PHASES) -> Column:
    """Position of the phase in the order, from 0; null if unknown."""
    return F.nullif(F.array_position(F.array(*[F.lit(p) for p in order]), phase), F.lit(0)).cast("int") - 1


def phase_progress(df, keys, t, tie, phase, order=CHAIN_PHASES) -> DataFrame:
    """Rows where the phase changes, with the furthest phase so far and its share in percent."""
    prev = tl.with_previous(df, keys, t, tie, {"previous_phase": phase})
    run = tl.running(prev, keys, t, tie, {"furthest": ("max", phase_index(F.col(phase), order))})
    changed = F.col("previous_phase").isNull() | (F.col("previous_phase") != F.col(phase))
    return run.filter(changed).withColumn("progress", F.round((F.col("furthest") + 1) / len(order) * 100).cast("bigint"))


def chain_anomaly(p: Column, same: Column) -> Column:
    """Points for an unlikely chain-phase change; ``p`` is null for an unknown pair."""
    return first_of([(same, 0), (p.isNull(), 30), (p >= 0.20, 0), (p >= 0.10, 5), (p >= 0.05, 10), (p >= 0.01, 20)], 30)


def kill_chain_anomaly(p: Column, same: Column) -> Column:
    return first_of([(same, 0), (p.isNull(), 70), (p < 0.05, 60), (p < 0.10, 40)], 0)


def intent_anomaly(p: Column, same: Column) -> Column:
    q = F.coalesce(p, F.lit(0.0))
    return first_of([(same, 0), (q < 0.05, 30), (q < 0.20, 20)], 0)


def transitions(df, keys, t, tie, phase, table: DataFrame, anomaly=chain_anomaly) -> DataFrame:
    """Change from the key's previous phase, its probability and the points for it.

    ``table`` (from_phase, to_phase, p) holds one row per pair of phases; Spark broadcasts it if its size allows.
    """
    prev = tl.with_previous(df, keys, t, tie, {"from_phase": phase}).filter(F.col("from_phase").isNotNull())
    hit = prev.join(
        table.withColumnRenamed("to_phase", "_to").withColumnRenamed("from_phase", "_from"),
        (F.col("from_phase") == F.col("_from")) & (F.col(phase) == F.col("_to")), "left",
    ).drop("_from", "_to")
    return hit.withColumn("anomaly", anomaly(F.col("p"), F.col("from_phase") == F.col(phase)).cast("bigint"))


def phase_jumps(df, keys, t, tie, phase, order=REQUEST_PHASES, direct=4) -> DataFrame:
    """Straight to a late phase (``direct``) or over at least one phase (``jump``)."""
    i = phase_index(F.col(phase), order)
    d = tl.with_previous(df.withColumn("_i", i), keys, t, tie, {"_prev": "_i"})
    return d.withColumn("jump", first_of([(F.col("_i") >= direct, "direct"), (F.col("_i") > F.col("_prev") + 1, "jump")], "none")) \
        .drop("_i", "_prev")


def lcs_length(seq: Column, template: Column) -> Column:
    """Longest common subsequence with a short sequence, one table row per step."""
    def step(prev: Column, x: Column) -> Column:
        return F.aggregate(
            F.sequence(F.lit(1), F.size(template)), F.array(F.lit(0)),
            lambda cur, j: F.concat(cur, F.array(
                F.when(x == F.element_at(template, j), F.element_at(prev, j) + 1)
                .otherwise(F.greatest(F.element_at(prev, j + 1), F.element_at(cur, j))))),
        )

    return F.element_at(F.aggregate(seq, F.array_repeat(F.lit(0), F.size(template) + 1), step), -1)


def collapse(seq: Column) -> Column:
    """Drops repeats that follow each other."""
    return F.filter(seq, lambda x, i: (i == 0) | (x != F.get(seq, i - 1)))


def template_matches(seq: Column, templates=CHAIN_TEMPLATES) -> Column:
    """Per template (similarity, rank, key, risk, lcs, progress) for a collapsed sequence of
    at least two phases; no templates for a shorter one.

    Make it a column of its own: what reads it twice would work it out twice.
    """
    table = F.array(*[F.struct(F.lit(k).alias("key"), F.lit(r).alias("risk"), F.lit(-i).alias("rank"), F.array(*[F.lit(p) for p in ph]).alias("ph"))
                      for i, (k, ph, r) in enumerate(templates)])
    scored = F.transform(table, lambda t: F.struct(t["key"].alias("key"), t["risk"].alias("risk"), t["rank"].alias("rank"), F.size(t["ph"]).alias("n"),
                                                   lcs_length(seq, t["ph"]).alias("lcs")))
    full = F.transform(scored, lambda m: F.struct(
        (m["lcs"] / F.greatest(F.size(seq), m["n"])).alias("similarity"), m["rank"].alias("rank"), m["key"].alias("key"), m["risk"].alias("risk"),
        m["lcs"].alias("lcs"), F.round(m["lcs"] / m["n"] * 100).cast("bigint").alias("progress")))
    return F.when(F.size(seq) >= 2, full).otherwise(F.array().cast(_MATCHES))


_MATCHES = "array<struct<similarity:double,rank:int,key:string,risk:string,lcs:int,progress:bigint>>"


def with_best(df: DataFrame, matches: str, out: str, least: float = 0.3) -> DataFrame:
    """Adds the most similar template of a match column (the first on ties), null below ``least``."""
    best = F.array_max(F.filter(matches, lambda m: m["lcs"] >= 2))
    return df.withColumn("_b", best).withColumn(out, F.when(F.col("_b.similarity") >= least, F.col("_b"))).drop("_b")


def histories(df, keys, t, tie, cols: Sequence[str], n=100) -> DataFrame:
    """One row per key with its newest ``n`` rows as an array ordered by time."""
    return tl.last_rows(df, keys, t, tie, n).groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("rn", F.col(t).alias("t"), *[c for c in cols]))).alias("h"))


def chain_matches(df, keys, t, tie, phase, templates=CHAIN_TEMPLATES, history=100) -> DataFrame:
    """Similarity of each key's phase sequence to each template with at least two common steps."""
    h = histories(df, keys, t, tie, [phase], history)
    seq = h.select(*keys, F.col(f"h.{phase}").alias("seq")).withColumn("seq", collapse(F.col("seq")))
    return (
        seq.select(*keys, F.explode(template_matches(F.col("seq"), templates)).alias("m"))
        .filter(F.col("m.lcs") >= 2)
        .select(*keys, F.col("m.key").alias("template"), "m.risk", "m.lcs", "m.similarity", "m.progress")
    )


def lateral_movement(df, keys, t, tie, phase, prefix, deep=DEEP_PHASES, history=100) -> DataFrame:
    """Keys active in a late phase under at least two path prefixes."""
    d = tl.last_rows(df, keys, t, tie, history).filter(F.col(phase).isin(list(deep)))
    g = d.groupBy(*keys).agg(F.count_distinct(prefix).alias("prefixes")).filter(F.col("prefixes") >= 2)
    return g.withColumn("score", (30 + F.least(F.lit(20), (F.col("prefixes") - 2) * 5)).cast("bigint"))


def _chain_switch(h: DataFrame, phase: str) -> DataFrame:
    phases = F.col(f"h.{phase}")
    n = F.size("h")
    mid = whole(n / 2).cast("int")
    d = h.withColumn("n", n).withColumn("_mid", mid).withColumn("_ph", phases)
    for name, part in (("seq", F.col("_ph")), ("_e", F.slice("_ph", 1, F.col("_mid"))), ("_l", F.slice("_ph", F.col("_mid") + 1, F.col("n")))):
        d = d.withColumn(name, part).withColumn(name, collapse(F.col(name)))
        d = d.withColumn(f"_m{name}", template_matches(F.col(name)))
        d = with_best(d, f"_m{name}", f"_b{name}")
    d = d.withColumn("chains", F.size(F.filter("_mseq", lambda m: (m["lcs"] >= 2) & (m["similarity"] >= 0.3))))
    switched = (F.col("n") >= 6) & (F.col("chains") >= 1) & F.coalesce(F.col("_b_e.key") != F.col("_b_l.key"), F.lit(False))
    return d.withColumn("switched", switched).withColumn(
        "switch_anomaly", F.least(F.lit(40), points((F.col("chains") >= 2, 20), (F.col("switched"), 15))).cast("bigint")
    ).withColumnRenamed("_bseq", "best").drop("_e", "_l", "_mid", "_ph", "_mseq", "_m_e", "_m_l", "_b_e", "_b_l")


def chain_switches(df, keys, t, tie, phase, history=100) -> DataFrame:
    """Parallel chains, and another best chain in the second half than in the first."""
    h = _chain_switch(histories(df, keys, t, tie, [phase], history), phase)
    return h.select(*keys, "n", "chains", "switched", "switch_anomaly")


PACE = [  # at least rows, at most rows, mean gap from, to, pattern, points
    (20, None, None, 2, "burst", 15), (10, None, None, 5, "burst", 10), (50, None, None, 30, "sustained", 8),
    (20, None, None, 60, "sustained", 5), (5, 15, 30, 300, "stealth", 3),
]


def pace_points(n: Column, gap: Column) -> Column:
    rules = []
    for lo, hi, g0, g1, _, pts in PACE:
        cond = (n >= lo) & (gap <= g1)
        if hi is not None:
            cond = cond & (n <= hi) & (gap >= g0)
        rules.append((cond, pts))
    return F.when(n >= 2, first_of(rules, 0)).otherwise(0)


def chain_risk(df, keys, t, tie, phase, prefix, logic, table: dict[tuple[str, str], float], history=100,
               unit=SECOND, windows=(60, 600, 3600), burst=20, sustained=60, slow=(5, 5, 30)) -> DataFrame:
    """Per key: chain score from its newest rows, and whether to stop it early.

    Base from the furthest phase or the chain similarity, plus pace and high-logic rows;
    then chain switch, window pattern at the newest row, lateral movement and the last
    phase change are added, at most 100. ``unit`` scales all time limits.
    """
    h = _chain_switch(histories(df, keys, t, tie, [phase, prefix, logic], history), phase)
    arr, n = F.col("h"), F.col("n")
    idx = F.array_max(F.transform(F.col(f"h.{phase}"), lambda p: phase_index(p)))
    last_t, first_t = F.element_at("h", -1)["t"], F.element_at("h", 1)["t"]
    gap = F.when(n > 1, (last_t - first_t) / unit / (n - 1)).otherwise(0.0)

    def within(s):
        return F.size(F.filter(arr, lambda r: r["t"] >= last_t - F.lit(int(s * unit))))

    d = h.withColumn("phase_idx", idx).withColumn("temporal", pace_points(n, gap)) \
        .withColumn("_hot", F.size(F.filter(arr, lambda r: r[logic] >= 40))) \
        .withColumn("_s", within(windows[0])).withColumn("_m", within(windows[1])).withColumn("_g", within(windows[2]))
    sim = F.coalesce(F.col("best.similarity"), F.lit(0.0))
    phase_score = first_of([(F.col("phase_idx") == 0, 10), (F.col("phase_idx") <= 2, 20), (F.col("phase_idx") <= 4, 35)], 50)
    chain_score = first_of([(sim >= 0.6, 70 + whole((sim - 0.6) / 0.4 * 20)), (sim >= 0.3, 40 + whole((sim - 0.3) / 0.3 * 20))],
                           F.lit(0).cast("bigint"))
    hot = first_of([(F.col("_hot") >= 5, 10), (F.col("_hot") >= 3, 5)], 0)
    s, m, g = F.col("_s"), F.col("_m"), F.col("_g")
    timing = first_of(
        [(n < 2, F.lit(0).cast("bigint")),
         (s > burst, 25 + F.least(F.lit(15), whole((s - burst) / 4))),
         (m > sustained, 15 + F.least(F.lit(10), whole((m - sustained) / 12))),
         ((g >= slow[0]) & (s <= slow[1]) & (m <= slow[2]), F.when(F.col("phase_idx") > 0, 20).otherwise(5).cast("bigint"))],
        F.lit(0).cast("bigint"))
    deep = F.array(*[F.lit(p) for p in DEEP_PHASES])
    prefixes = F.size(F.array_distinct(F.transform(
        F.filter(arr, lambda r: F.array_contains(deep, r[phase])), lambda r: r[prefix])))
    lateral = F.when(prefixes >= 2, 30 + F.least(F.lit(20), (prefixes - 2) * 5)).otherwise(0)
    pairs = F.create_map(*[x for (a, b), p in table.items() for x in (F.lit(f"{a}>{b}"), F.lit(p))])
    seq = F.col("seq")
    change = F.when(F.size(seq) >= 2, F.concat_ws(">", F.get(seq, F.size(seq) - 2), F.element_at(seq, -1)))
    step = F.when(change.isNotNull(), chain_anomaly(F.get(F.array(pairs), F.lit(0))[change], F.lit(False))).otherwise(0)
    d = d.withColumn("base", F.least(F.lit(100), F.greatest(phase_score, chain_score) + F.col("temporal") + hot).cast("bigint")) \
        .withColumn("timing", timing).withColumn("lateral", lateral.cast("bigint")).withColumn("transition", step.cast("bigint"))
    d = d.withColumn("score", F.least(F.lit(100), F.col("base") + F.col("switch_anomaly") + F.col("timing")
                                      + F.col("lateral") + F.col("transition")))
    progress = F.coalesce(F.col("best.progress"), F.lit(0).cast("bigint"))
    early = (F.col("score") >= 70) | (F.col("best").isNotNull() & (progress >= 50) & F.col("best.risk").isin("critical", "high"))
    return d.select(*keys, "n", F.col("best.key").alias("chain"), sim.alias("similarity"), progress.alias("progress"), "base",
                    "switch_anomaly", "timing", "lateral", "transition", "score", chain_risk_band(F.col("score")).alias("band"),
                    F.coalesce(early, F.lit(False)).alias("block_early"))


def predicted_path_hits(df, keys, t, tie, phase, uri, predictions: list[tuple[str, str, int]], least=60) -> DataFrame:
    """Rows whose URI holds a path that the key's previous phase made likely; first listed path wins."""
    by_phase: dict[str, list] = {}
    for p, path, prob in predictions:
        if prob >= least:
            by_phase.setdefault(p, []).append(F.struct(F.lit(path).alias("path"), F.lit(prob).cast("bigint").alias("prob")))
    prev = tl.with_previous(df, keys, t, tie, {"_phase": phase})
    none = F.array().cast("array<struct<path:string,prob:bigint>>")
    likely = first_of([(F.col("_phase") == p, F.array(*s)) for p, s in by_phase.items()], none)
    hit = F.get(F.filter(likely, lambda x: F.contains(F.lower(F.col(uri)), F.lower(x["path"]))), F.lit(0))
    return prev.withColumn("_hit", hit).filter(F.col("_hit").isNotNull()) \
        .withColumn("path", F.col("_hit.path")).withColumn("prob", F.col("_hit.prob")).drop("_hit", "_phase")


def top_predictions(predictions: DataFrame, keys, item: str, n: int) -> DataFrame:
    """Best ``n`` items per key from (key, item, source, prob), an item named twice boosted.

    Sources in order phase, type, history: the first gives the probability, a further type
    adds half its own, a further history 15; at most 100.
    """
    g = predictions.groupBy(*keys, item).agg(
        *[F.max(F.when(F.col("source") == s, F.col("prob"))).cast("double").alias(s) for s in ("phase", "type", "history")])
    base = F.coalesce("phase", "type", "history")
    boost = F.when(F.col("phase").isNotNull() & F.col("type").isNotNull(), F.col("type") / 2).otherwise(0.0) \
        + F.when(F.coalesce("phase", "type").isNotNull() & F.col("history").isNotNull(), 15.0).otherwise(0.0)
    w = Window.partitionBy(*keys).orderBy(F.desc("prob"), F.asc(item))
    return g.select(*keys, item, F.least(F.lit(100.0), base + boost).alias("prob")) \
        .withColumn("rank", F.row_number().over(w).cast("bigint")).filter(F.col("rank") <= n)


def next_steps(df: DataFrame, keys, t, tie, phase, paths: Sequence[tuple[str, str, int]], names: Sequence[tuple[str, str, int]], n_paths=5, n_names=5) -> DataFrame:
    """Likely next paths and parameter names of each key by the phase of its last row: kind, item, prob, rank.

    ``paths`` and ``names`` are (phase, item, probability) settings, a few dozen rows.
    """
    steps = [(p, k, i, float(q)) for k, rows in (("path", paths), ("parameter", names)) for p, i, q in rows]
    steps = df.sparkSession.createDataFrame(steps, "_phase string, kind string, item string, prob double")
    w = Window.partitionBy("_phase", "kind").orderBy(F.desc("prob"), "item")
    best = steps.withColumn("rank", F.row_number().over(w).cast("bigint")).filter(F.col("rank") <= F.when(F.col("kind") == "path", n_paths).otherwise(n_names))
    last = df.groupBy(*keys).agg(F.max_by(phase, F.struct(t, tie)).alias("_phase"))
    # settings, ranked once for all keys
    return last.join(F.broadcast(best), "_phase").select(*keys, F.col("_phase").alias("phase"), "kind", "item", "prob", "rank")
