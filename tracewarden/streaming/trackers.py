"""Keyed state operators as steps ``(batch, state, context) -> (output, new state)`` of `runner.run_keyed`.

Each runs the batch operator over the state rows and the batch together and gives out the batch's rows, so
stream and batch results agree. With a clock the rows come in order of time; what the clock has passed by
more than a key's lifetime leaves the state.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewarden.functions.scores import first_of
from tracewarden.operators import bayes, behaviour, chains, sequences
from tracewarden.operators import timeline as tl

NEW = "_new"
NEVER = 1 << 62


def _both(batch: DataFrame, state: DataFrame) -> DataFrame:
    return batch.withColumn(NEW, F.lit(True)).unionByName(state.withColumn(NEW, F.lit(False)), allowMissingColumns=True)


def _fresh(df: DataFrame) -> DataFrame:
    return df.filter(NEW).drop(NEW)


def chain_tracker(key: str, t: str, tie: str, phase: str, order=chains.CHAIN_PHASES, idle: int | None = None):
    """Phase changes and furthest phase; a key idle for more than ``idle`` starts anew.

    State: the key's last row and furthest phase. It may go once the clock has passed ``t`` by ``idle``.
    """
    def step(batch: DataFrame, state: DataFrame, context):
        rows = _both(batch.select(key, t, tie, phase), state).withColumn("_i", F.coalesce("furthest", chains.phase_index(F.col(phase), order)))
        keys, prev = [key], tl.with_previous(rows.drop("furthest"), [key], t, tie, {"_p": phase, "_prev_t": t})
        if idle is not None:
            # one look back gives the sessions and the phase before; what is read twice is written once
            begins = F.col("_prev_t").isNull() | (F.col(t) - F.col("_prev_t") > F.lit(idle))
            prev = context.keep(prev.withColumns({"_begins": begins.cast("bigint"), "_p": F.when(~begins, F.col("_p"))}))
            prev = context.keep(tl.running(prev, [key], t, tie, {"_s": ("sum", F.col("_begins"))}))
            keys = [key, "_s"]
        run = context.keep(tl.running(prev, keys, t, tie, {"furthest": ("max", F.col("_i"))}))
        newest = run.groupBy(key).agg(F.max_by(F.struct(t, tie, phase, "furthest"), F.struct(t, tie)).alias("x")).select(key, "x.*")
        changed = F.col("_p").isNull() | (F.col("_p") != F.col(phase))
        out = run.filter(F.col(NEW) & changed).select(key, t, tie, phase, "furthest", F.round((F.col("furthest") + 1) / len(order) * 100).cast("bigint").alias("progress"))
        return out, newest

    return step


def baseline_tracker(key: str, t: str, tie: str, value: str, recorded: Column, window: int, half_life: int, n: int = 10):
    """Trailing weighted mean and decayed sum. State: the rows that later ones look back at, equal rows each."""
    def step(batch: DataFrame, state: DataFrame, context):
        rows = context.keep(_both(batch.select(key, t, tie, value), state))
        d = behaviour.trailing_baseline(rows, [key], t, tie, [value], n=n)
        d = behaviour.decayed_sum(d, [key], t, value, recorded, window, half_life)
        # later rows lie behind the clock, and look back from there
        young = F.lit(False) if context.now is None else F.col(t) > context.now - window
        old = tl.last_rows(rows, [key], t, tie, n).filter(~young)
        return _fresh(d), rows.filter(young).select(key, t, tie, value).unionByName(old.select(key, t, tie, value))

    return step


def ban_tracker(key: str, t: str, tie: str, steps=(86_400, 604_800, 2_592_000), after=86_400):
    """Number and duration in seconds of bans (0 = for ever), of which each counts until ``after`` seconds past its end.

    State: the ends of the bans that may still count, and the number of those for ever. Once as many as
    there are steps are for ever, all later ones are. The bans up to there depend on each other; as each
    counts for a day at least, no more than the first 2 * len(steps) of a day can be among them, so this
    part is a short array for any client. All later bans are counted as rows.
    """
    second, day, full = tl.SECOND, tl.DAY, len(steps)
    if min(steps) + after < 86_400:
        raise ValueError("a ban counts for a day at least")
    lasts = lambda offence: first_of([(offence == i + 1, F.lit(s).cast("bigint")) for i, s in enumerate(steps)], F.lit(0).cast("bigint"))
    result = f"array<struct<{t}:bigint,{tie}:bigint,offence:bigint>>"
    kind = f"struct<ends:array<bigint>,lasting:bigint,first:struct<{t}:bigint,{tie}:bigint>,done:{result}>"
    place = lambda a, b: F.struct(a.cast("bigint").alias(t), b.cast("bigint").alias(tie))

    def counted(acc: Column, x: Column) -> Column:
        live = F.filter(acc["ends"], lambda e: e >= x[t])
        offence = F.size(live) + acc["lasting"] + 1
        ever = offence > full
        lasting = acc["lasting"] + ever.cast("bigint")
        row = F.struct(x[t].alias(t), x[tie].cast("bigint").alias(tie), offence.alias("offence"))
        ends = F.when(ever, live).otherwise(F.array_append(live, x[t] + (lasts(offence) + after) * second))
        moved = F.struct(ends.alias("ends"), lasting.alias("lasting"), F.when(lasting >= full, place(x[t], x[tie])).alias("first"), F.array_append(acc["done"], row).alias("done"))
        return F.when(acc["first"].isNotNull(), acc).otherwise(moved).cast(kind)

    def step(batch: DataFrame, state: DataFrame, context):
        rows = batch.select(key, t, tie)
        nth = Window.partitionBy(key, tl.piece_of(F.col(t), day)).orderBy(t, tie)
        few = rows.withColumn("_n", F.row_number().over(nth)).filter(F.col("_n") <= 2 * full).groupBy(key).agg(F.array_sort(F.collect_list(F.struct(t, tie))).alias("_few"))
        known = few.join(state, key, "full").select(
            key, F.coalesce("_few", F.array().cast(f"array<struct<{t}:bigint,{tie}:bigint>>")).alias("_few"), F.coalesce("ends", F.array().cast("array<bigint>")).alias("ends"), F.coalesce("lasting", F.lit(0)).alias("lasting"))
        begun = F.when(F.col("lasting") >= full, place(F.lit(-NEVER), F.lit(-NEVER)))
        start = F.struct(F.col("ends"), F.col("lasting"), begun.alias("first"), F.array().cast(result).alias("done")).cast(kind)
        folded = context.keep(known.select(key, F.aggregate("_few", start, counted).alias("x")).select(key, "x.*"))
        early = folded.select(key, F.explode("done").alias("d")).select(key, "d.*")
        late = rows.join(folded.filter("first IS NOT NULL").select(key, "lasting", "first", "ends"), key)
        late = late.filter(place(F.col(t), F.col(tie)) > F.col("first"))
        late = tl.numbered(late, [key], t, tie, "_n")
        late = late.select(key, t, F.col(tie).cast("bigint").alias(tie), (F.col("lasting") + F.col("_n") + F.size(F.filter("ends", lambda e: e >= F.col(t)))).alias("offence"))
        out = early.unionByName(late).withColumn("ban_s", lasts(F.col("offence")))
        more = late.groupBy(key).agg(F.count("*").alias("_more"))
        new = folded.join(more, key, "left").select(key, "ends", (F.col("lasting") + F.coalesce("_more", F.lit(0))).cast("bigint").alias("lasting"))
        return out, new

    return step


def ban_end() -> Column:
    """When a row of `ban_tracker`'s state may go."""
    return F.when(F.col("lasting") > 0, F.lit(NEVER)).otherwise(F.coalesce(F.array_max("ends"), F.lit(0)))


def race_tracker(key: str, t: str, tie: str, path: str, params: str, changing: Column, sensitive: Column, window: int, burst: int, sensitive_window: int, **limits):
    """Near-simultaneous repeats. State: the rows themselves, until the clock has passed them by the longest window."""
    def step(batch: DataFrame, state: DataFrame, context):
        cols = list(dict.fromkeys([key, t, tie, path, params]))
        rows = context.keep(_both(batch.select(*cols), state))
        d = sequences.duplicate_submissions(rows, [key], t, path, params, changing, sensitive, window, burst, sensitive_window, **limits)
        return _fresh(d), rows.select(*cols)

    return step


def path_learner(path: str, t: str, control: DataFrame | None = None):
    """Normal paths with counts and times, added up over batches.

    ``control`` (since, frozen) is a short table of switches; a row is not learned from if the
    last switch before it, or at its time, is on.
    """
    def step(batch: DataFrame, state: DataFrame, context):
        rows = batch
        if control is not None:
            until = F.coalesce(F.lead("since").over(Window.orderBy("since")), F.lit(NEVER))
            spans = control.withColumn("_until", until).filter("frozen").select(F.col("since").alias("_since"), "_until")
            rows = rows.join(spans, (F.col(t) >= F.col("_since")) & (F.col(t) < F.col("_until")), "left_anti")
        new = context.keep(rows.groupBy(path).agg(F.count("*").alias("seen"), F.min(t).alias("first_seen"), F.max(t).alias("last_seen")))
        merged = state.unionByName(new).groupBy(path).agg(F.sum("seen").alias("seen"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))
        return new, merged

    return step


def token_learner():
    """Token counts of the text model, added up over batches, of which `bayes.train` has counted each."""
    def step(batch: DataFrame, state: DataFrame, context):
        return batch, bayes.merge(state, batch, ["class", "token"])

    return step


def change_tracker(path: str, digest: str, t: str):
    """Added and changed files per batch, by each one's newest entry. State: the inventory, with the times."""
    def step(batch: DataFrame, state: DataFrame, context):
        new = batch.groupBy(path).agg(F.max_by(F.struct(t, digest), F.struct(t, digest)).alias("x")).select(path, "x.*")
        d = context.keep(state.select(path, F.col(t).alias("_t"), F.col(digest).alias("_old")).join(new, path, "full"))
        # an entry older than the one held says nothing
        newer = F.col(t).isNotNull() & (F.col("_t").isNull() | (F.col(t) >= F.col("_t")))
        status = first_of([(F.col("_t").isNull(), "added"), (F.col(digest).isNull() | F.col("_old").isNull(), "unverified"), (F.col("_old") != F.col(digest), "changed")], "same")
        held = lambda a, b: F.when(newer, F.col(a)).otherwise(F.col(b))
        return d.filter(newer).select(path, status.alias("status")), d.select(path, held(t, "_t").alias(t), held(digest, "_old").alias(digest))

    return step
