"""Ordered work per key that stays spread out when one key holds most rows.

A plain ``Window.partitionBy(key)`` puts the whole history of a key in one task. Here
each key is cut into *pieces* of fixed event-time length, windows run per piece, and the
little that a piece must know about earlier ones (spans still open, the last n rows, the
running totals) is put in front of it as context. Results equal the plain window.

All times are microseconds since the epoch (bigint).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SECOND = 1_000_000
HOUR = 3600 * SECOND
DAY = 24 * HOUR

PIECE = "_piece"
HOME = "_home"


def micros(ts: Column) -> Column:
    """Event time as microseconds since the epoch (session time zone must be UTC)."""
    return F.unix_micros(ts.cast("timestamp"))


def piece_of(t: Column, length: int) -> Column:
    return ((t - F.pmod(t, F.lit(length).cast("bigint"))) / F.lit(length)).cast("bigint")


@dataclass(frozen=True)
class Span:
    """Adds ``value`` to every row of the same key with ``start <= t < end``.

    ``value`` may be a function of the piece's start time, for weights that are
    relative to it.
    """

    start: Column
    end: Column
    value: Column | Callable[[Column], Column]
    # Spans of one group have the same start and end, and so share their marks.
    group: str | None = None

    def at(self, piece_start: Column) -> Column:
        return self.value(piece_start) if callable(self.value) else self.value


def piece_length(piece: int | None, longest: int) -> int:
    """Length of the pieces for windows of at most ``longest``: four windows if none is given.

    Long enough that few rows reach into the next piece, short enough that a key with very
    many rows per window still makes many pieces.
    """
    return max(4 * longest if piece is None else piece, longest)


def span_sums(
    df: DataFrame,
    keys: Sequence[str],
    t: str,
    spans: dict[str, Span],
    longest: int,
    piece: int | None = None,
    dtype: str = "bigint",
) -> DataFrame:
    """Rows plus, per span name, the sum of all spans of the key that cover the row.

    Each span becomes a plus at its start and a minus at its end, and the sum is a
    running total: linear in the rows however many fall into one window, where a sliding
    range frame adds every frame up anew. Spans are at most ``longest`` long, so a span
    reaches at most one piece further, where it is opened again at the piece's start.
    """
    length = piece_length(piece, longest)
    rows = df.withColumn("_span_t", F.col(t))
    zero = F.lit(0).cast(dtype)

    def entry(at: Column, p: Column, is_row: Column, deltas: dict[str, Column]) -> Column:
        return F.struct(
            at.cast("bigint").alias("at"),
            p.alias("piece"),
            is_row.alias("is_row"),
            *[deltas.get(n, zero).cast(dtype).alias(n) for n in spans],
        )

    def start_of(p: Column) -> Column:
        return p * F.lit(length)

    groups: dict[str, dict[str, Span]] = {}
    for n, s in spans.items():
        groups.setdefault(s.group or n, {})[n] = s
    own_piece = piece_of(F.col("_span_t"), length)
    entries = [
        entry(
            F.col("_span_t"), own_piece, F.lit(True),
            {n: F.when(s.start == F.col("_span_t"), s.at(start_of(own_piece))).otherwise(zero)
             for n, s in spans.items()},
        )
    ]
    for members in groups.values():
        first = next(iter(members.values()))
        p0, p1 = piece_of(first.start, length), piece_of(first.end, length)

        def plus(p: Column, members=members) -> dict[str, Column]:
            return {n: s.at(start_of(p)) for n, s in members.items()}

        entries += [
            F.when(first.start != F.col("_span_t"), entry(first.start, p0, F.lit(False), plus(p0))),
            F.when(p1 > p0, entry(start_of(p1), p1, F.lit(False), plus(p1))),
            entry(first.end, p1, F.lit(False), {n: -x for n, x in plus(p1).items()}),
        ]
    useful = F.filter(
        F.array(*entries),
        lambda e: e.isNotNull() & (e["is_row"] | (F.greatest(*[F.abs(e[n]) for n in spans], zero) > 0)),
    )
    # Flat columns, so that those nobody asks for are pruned down to the scan; empty on marks.
    cut = rows.select("*", F.explode(useful).alias("_span")).select(
        *[F.col(k).alias(f"_span_k{i}") for i, k in enumerate(keys)],
        *[F.when(F.col("_span.is_row"), F.col(c)).alias(c) for c in df.columns],
        F.col("_span.at").alias("_span_at"), F.col("_span.piece").alias("_span_piece"), F.col("_span.is_row").alias("_span_row"),
        *[F.col(f"_span.{n}").alias(f"_span_d_{n}") for n in spans],
    )
    w = (
        Window.partitionBy(*[f"_span_k{i}" for i in range(len(keys))], "_span_piece")
        .orderBy("_span_at")
        .rangeBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        cut.select(*df.columns, "_span_row", *[F.sum(f"_span_d_{n}").over(w).alias(n) for n in spans])
        .filter("_span_row")
        .select(*df.columns, *spans)
    )


def sliding_sums(
    df: DataFrame,
    keys: Sequence[str],
    t: str,
    frames: dict[str, tuple[int, Column]],
    closed: bool = False,
    piece: int | None = None,
) -> DataFrame:
    """Trailing-window sums of whole numbers, the row and its peers included.

    ``frames`` maps an output name to (window length, value). The window is
    ``(t - length, t]``, or ``[t - length, t]`` when ``closed``.
    """
    extra = 1 if closed else 0
    spans = {n: Span(F.col(t), F.col(t) + F.lit(w + extra), v, f"w{w}") for n, (w, v) in frames.items()}
    return span_sums(df, keys, t, spans, max(w for w, _ in frames.values()) + extra, piece)


def sliding_distinct(
    df: DataFrame,
    keys: Sequence[str],
    t: str,
    value: str,
    width: int,
    out: str,
    closed: bool = False,
    piece: int | None = None,
) -> DataFrame:
    """Number of distinct non-null values in the trailing window of each row.

    A value is present from an occurrence until ``width`` later; an occurrence adds only
    the part that the previous one of the same value does not cover already. The
    previous one is looked up in a per-value piece holding copies of rows young enough.
    """
    reach = width + (1 if closed else 0)
    length = piece_length(piece, reach)
    own = piece_of(F.col(t), length)
    copies = F.array_distinct(F.array(own, piece_of(F.col(t) + F.lit(reach), length)))
    w = Window.partitionBy(*keys, value, PIECE).orderBy(t)
    prior = (
        df.withColumn(PIECE, F.explode(copies))
        .withColumn(HOME, F.col(PIECE) == own)
        .withColumn("_prev", F.lag(t).over(w))
        .filter(HOME)
        .drop(PIECE, HOME)
    )
    start = F.greatest(F.col(t), F.coalesce(F.col("_prev") + F.lit(reach), F.col(t)))
    span = Span(start, F.col(t) + F.lit(reach), F.when(F.col(value).isNotNull(), 1).otherwise(0))
    return span_sums(prior, keys, t, {out: span}, reach, piece).drop("_prev")


def with_context(
    df: DataFrame, keys: Sequence[str], t: str, tie: str, n: int, cols: Sequence[str], piece: int = DAY
) -> DataFrame:
    """Pieces of each key with copies of the ``n`` rows before the piece in front.

    Adds ``_piece`` and ``_home`` (false for copies, which carry only ``cols``). Row
    frames of at most ``n`` preceding rows over ``piece_window`` are then right for all
    home rows; drop the copies afterwards with ``home_rows``.
    """
    base = df.withColumn(PIECE, piece_of(F.col(t), piece))
    kept = list(dict.fromkeys([t, tie, *cols]))
    item = F.struct(*kept)
    if n == 1:
        tails = base.groupBy(*keys, PIECE).agg(F.array(F.max_by(item, F.struct(t, tie))).alias("_tail"))
    else:
        newest = Window.partitionBy(*keys, PIECE).orderBy(F.desc(t), F.desc(tie))
        tails = (
            base.withColumn("_n", F.row_number().over(newest))
            .filter(F.col("_n") <= n)
            .groupBy(*keys, PIECE)
            .agg(F.array_sort(F.collect_list(item)).alias("_tail"))
        )
    before = Window.partitionBy(*keys).orderBy(PIECE).rowsBetween(-n, -1)
    heads = tails.withColumn("_head", F.flatten(F.collect_list("_tail").over(before))).select(
        *keys, PIECE, F.explode(F.slice(F.col("_head"), F.greatest(F.size("_head") - n + 1, F.lit(1)), n)).alias("_h")
    )
    copies = heads.select(*keys, PIECE, *[F.col(f"_h.{c}") for c in kept if c not in keys], F.lit(False).alias(HOME))
    return base.withColumn(HOME, F.lit(True)).unionByName(copies, allowMissingColumns=True)


def piece_window(keys: Sequence[str], t: str, tie: str):
    return Window.partitionBy(*keys, PIECE).orderBy(t, tie)


def home_rows(df: DataFrame) -> DataFrame:
    return df.filter(HOME).drop(HOME, PIECE)


def with_previous(
    df: DataFrame, keys: Sequence[str], t: str, tie: str, cols: dict[str, str], piece: int = DAY
) -> DataFrame:
    """Adds the previous row's values of the key: ``cols`` maps new name to column."""
    w = piece_window(keys, t, tie)
    laid = with_context(df, keys, t, tie, 1, list(cols.values()), piece)
    return home_rows(laid.select("*", *[F.lag(c).over(w).alias(n) for n, c in cols.items()]))


def running(
    df: DataFrame,
    keys: Sequence[str],
    t: str,
    tie: str,
    totals: dict[str, tuple[str, Column]],
    piece: int = DAY,
    inclusive: bool = True,
) -> DataFrame:
    """Running aggregates from the key's first row on.

    ``totals`` maps an output name to (``sum`` | ``max`` | ``min``, value). Per piece the
    total of all earlier pieces is put in front as one row.
    """
    fns = {"sum": F.sum, "max": F.max, "min": F.min}
    base = df.withColumn(PIECE, piece_of(F.col(t), piece))
    for n, (_, v) in totals.items():
        base = base.withColumn(f"_v_{n}", v)
    before = Window.partitionBy(*keys).orderBy(PIECE).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        base.groupBy(*keys, PIECE)
        .agg(*[fns[f](f"_v_{n}").alias(f"_v_{n}") for n, (f, _) in totals.items()])
        .select(*keys, PIECE, *[fns[f](f"_v_{n}").over(before).alias(f"_v_{n}") for n, (f, _) in totals.items()])
        .withColumn(HOME, F.lit(False))
    )
    laid = base.withColumn(HOME, F.lit(True)).unionByName(offsets, allowMissingColumns=True)
    w = (
        Window.partitionBy(*keys, PIECE)
        .orderBy(HOME, t, tie)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow if inclusive else -1)
    )
    return home_rows(
        laid.select("*", *[fns[f](f"_v_{n}").over(w).alias(n) for n, (f, _) in totals.items()])
    ).drop(*[f"_v_{n}" for n in totals])


def numbered(df: DataFrame, keys: Sequence[str], t: str, tie: str, out: str, piece: int = DAY) -> DataFrame:
    """Position of the row in its key's history, from 1."""
    return running(df, keys, t, tie, {out: ("sum", F.lit(1).cast("bigint"))}, piece)


def sessions(
    df: DataFrame, keys: Sequence[str], t: str, tie: str, gap: int, out: str, piece: int = DAY
) -> DataFrame:
    """Session number per key: a new one starts after more than ``gap`` without a row."""
    prev = with_previous(df, keys, t, tie, {"_prev_t": t}, piece)
    starts = (F.col("_prev_t").isNull() | (F.col(t) - F.col("_prev_t") > F.lit(gap))).cast("bigint")
    return running(prev, keys, t, tie, {out: ("sum", starts)}, piece).drop("_prev_t")


def last_rows(df: DataFrame, keys: Sequence[str], t: str, tie: str, n: int) -> DataFrame:
    """The newest ``n`` rows per key; adds ``rn`` (1 = oldest kept) and ``kept`` (their count).

    Spark cuts every map partition to n rows per key before the shuffle, so what follows
    works on groups of at most n rows.
    """
    newest = Window.partitionBy(*keys).orderBy(F.desc(t), F.desc(tie))
    group = Window.partitionBy(*keys)
    return (
        df.withColumn("_n", F.row_number().over(newest))
        .filter(F.col("_n") <= n)
        .withColumn("kept", F.count("*").over(group))
        .withColumn("rn", (F.col("kept") - F.col("_n") + 1).cast("bigint"))
        .drop("_n")
    )
